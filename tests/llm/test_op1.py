import duckdb
import pytest

from quillgraph.llm import op1_chat_snapshots as op


def brute(rows):
    by = {}
    for c, t, r, x in sorted(set(rows), key=lambda z: (z[0] is None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "unknown", z[3] or "")):
        if c is not None:
            by.setdefault(c, []).append((r or "unknown", x or ""))
    out = {}
    for c, turns in by.items():
        same = [d for d, u in by.items() if u == turns]
        if c == min(same) and not any(len(u) > len(turns) and u[: len(turns)] == turns for u in by.values()):
            out[c] = (len(turns), len(same), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in turns))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in df.collect()}


ROWS = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, None, None, None), (5, None, None, None), (None, 0, "user", "hi"),
        (6, 0, "user", "hi"), (6, 1, "assistant", "yo"), (6, 2, "user", ""), (7, 0, "b", "tie"), (7, 0, "a", "tie")]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as k", "2 as n_turns", "3 as h0")
    assert got(op.collapse(df)) == brute(rows)


def test_sql(spark, sf_mid):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_mid}/conversations.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(op.SQL).fetchall()}
    assert got(op.query(spark, sf_mid)) == want
