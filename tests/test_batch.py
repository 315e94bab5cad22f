"""A batch of questions against the same questions one by one."""

import pytest
from pyspark.sql import functions as F

from quillgraph.plans.answering import Engine
from quillgraph.plans.batch import answer_all
from quillgraph.plans.ingest import Ingestion
from quillgraph.plans.providers import Providers
from quillgraph.sources.catalog import Catalog
from tests.test_engine import LEAVE, SMALL, TRAVEL

NOW = "2025-01-01 01:00:00"
ASKED = [("a", "How is parental leave connected to Acme Corporation?"), ("b", "calculate the sum of 2 and 3.5 days of leave"), ("c", "travel by train"), ("d", None)]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    own = Catalog(spark, f"file://{tmp_path_factory.mktemp('catalog')}")
    files = spark.createDataFrame([(p, len(t), t.encode()) for p, t in (("a.md", LEAVE), ("b.txt", TRAVEL))], "path string, length bigint, content binary")
    Ingestion(own, Providers(), SMALL, F.lit("2025-01-01 00:00:00").cast("timestamp")).ingest(files).collect()
    return own


def test_equals_single_questions(spark, catalog):
    def fail(query, *rest):
        if "fail" in query:
            raise ValueError("no model")
        return Providers().answer(query, *rest)

    engine = Engine(catalog, Providers(answer=fail), SMALL, F.lit(NOW).cast("timestamp"))
    rows = spark.createDataFrame(ASKED + [("e", "let it fail")], "query_id string, query string")
    got = {r.query_id: r for r in answer_all(engine, rows).collect()}
    assert set(got) == set("abcde") and not any(r.cached for r in got.values())
    assert got["e"].error == "no model" and got["e"].answer == "An error occurred while answering."
    assert got["d"].query == "" and got["b"].answer.startswith("Calculation (sum): 5.5 (from numbers: [2.0, 3.5])")
    again = {r.query_id: r for r in answer_all(engine, rows).collect()}
    assert again["a"].cached and again["a"].answer == got["a"].answer and again["a"].chunk_ids == got["a"].chunk_ids
    assert catalog.read("query_logs").count() == 10
    catalog.truncate("semantic_cache")
    for key, query in ASKED[:3]:
        one = engine.query(query)
        assert one.error is None and not one.cached
        assert (one.answer, one.query_type, [r["chunk_id"] for r in one.chunks], one.passes == 1) == (got[key].answer, got[key].query_type, got[key].chunk_ids, got[key].covered)


def test_no_questions(spark, catalog):
    engine = Engine(catalog, Providers(), SMALL, F.lit(NOW).cast("timestamp"))
    assert answer_all(engine, spark.createDataFrame([], "query_id string, query string")).count() == 0
