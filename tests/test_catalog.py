import threading

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import catalog as module
from quillgraph.sources.catalog import Catalog, ConcurrentWrite


def messages(spark, ids, content="x"):
    return spark.range(1).select(F.explode(F.array(*[F.lit(str(i)) for i in ids])).alias("id")).select("id", F.lit("c").alias("conversation_id"), F.lit("user").alias("role"), F.lit(content).alias("content"))


@pytest.fixture
def own(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/c")


def pieces(own, table="messages"):
    return own._manifest(table, own.version(table))["pieces"]


def test_upsert_rewrites_its_buckets_only(spark, own, monkeypatch):
    monkeypatch.setattr(module, "BUCKETS", 64)
    own.write("messages", spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("user").alias("role"), F.lit("old").alias("content")))
    before = pieces(own)
    assert len(before) == 64
    own.upsert("messages", messages(spark, range(0, 20), "new"))
    after = pieces(own)
    changed = {b for b in after if after[b] != before[b]}
    assert 0 < len(changed) <= 20 and after.keys() == before.keys()
    found = {r.id: r.content for r in own.read("messages").collect()}
    assert len(found) == 2000 and all((c == "new") == (int(i) < 20) for i, c in found.items())
    own.delete("messages", F.col("id") == "7")
    assert sum(pieces(own)[b] != after[b] for b in pieces(own)) == 1 and own.read("messages").count() == 1999
    own.merge("messages", messages(spark, ["new"]), own.read("messages").filter("id in ('8', '9')").select("id"))
    assert own.read("messages").count() == 1998
    assert own.read("messages", 1).filter("content = 'old'").count() == 2000


def test_appends_add_segments(spark, own, monkeypatch):
    monkeypatch.setattr(module, "SEGMENTS", 3)
    row = spark.createDataFrame([("a", "q")], "id string, query string")
    first = None
    for n in range(1, 6):
        own.append("query_logs", row)
        assert own.read("query_logs").count() == n and len(pieces(own, "query_logs")) <= 3
        first = first or next(iter(pieces(own, "query_logs")))
        assert (first in pieces(own, "query_logs")) == (n <= 3)
    with pytest.raises(ValueError):
        own.append("messages", messages(spark, ["1", "1"]))
    assert own.version("messages") == 0


def test_two_writers(spark, own):
    own.write("messages", messages(spark, ["1"]))
    base, rows = own.version("messages"), own.read("messages")
    own.upsert("messages", messages(spark, ["2"]))
    with pytest.raises(ConcurrentWrite):
        own.write("messages", rows, base)
    with pytest.raises(ConcurrentWrite):
        own._commit("messages", base, {"buckets": 8, "pieces": {}})
    assert own.read("messages").count() == 2


def test_writers_at_once(spark, own):
    problems = []

    def work(k):
        try:
            Catalog(spark, own.root).upsert("messages", messages(spark, [f"{k}-{i}" for i in range(3)]))
        except Exception as problem:  # told below
            problems.append(problem)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not problems and own.version("messages") == 4
    assert own.read("messages").count() == 12


def test_growth_and_vacuum(spark, own, monkeypatch):
    monkeypatch.setattr(module, "BUCKET_BYTES", 1500)
    own.write("messages", messages(spark, range(50)))
    own.write("messages", own.read("messages"))
    assert own._manifest("messages", 2)["buckets"] > module.BUCKETS
    own.upsert("messages", messages(spark, ["51"]))
    assert own.read("messages").count() == 51
    assert own.vacuum("messages", 1) == 1 and own.read("messages").count() == 51
    own.truncate("messages")
    assert own.read("messages").count() == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, own, monkeypatch):
    monkeypatch.setattr(module, "BUCKETS", 1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16384")
    try:
        own.write("messages", spark.range(0, 4000, 1, 8).select(F.col("id").cast("string").alias("id"), F.lit("user").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("content")))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(pieces(own)) == 1 and len(own.read("messages").inputFiles()) > 4
    assert own.read("messages").distinct().count() == 4000
