"""Every query with SQL against DuckDB on the same tables, and every other one for rows."""

import math

import duckdb
import pytest

from quillgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_mid):
    own = duckdb.connect()
    own.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_mid}/{t}.parquet'")
    return own


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, con, sf_mid, name):
    got = registry.QUERIES[name](spark, sf_mid)
    cursor = con.execute(registry.ORACLE_SQL[name])
    want_names, want = rows([d[0] for d in cursor.description], cursor.fetchall())
    got_names, have = rows(got.columns, [tuple(r) for r in got.collect()])
    assert got_names == want_names
    assert len(have) == len(want) and want
    for a, b in zip(have, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, sf_mid, name):
    assert registry.QUERIES[name](spark, sf_mid).count() > 0
