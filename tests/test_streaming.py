"""Streams with state against the same work on whole tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillgraph.operators import versions
from quillgraph.streaming.versions import FirstOfText, version_stream

FILES = "seq long, filename string, content_hash string, at timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def files(n, seed):
    """Files in order of time, a third of them of one text and a third of one name, with ties of time."""
    deal = random.Random(seed)
    return [(i, "hot" if deal.random() < 0.33 else f"f{deal.randrange(9)}", "copy" if deal.random() < 0.33 else f"h{deal.randrange(n)}", START + timedelta(seconds=i // 2)) for i in range(n)]


def run(spark, rows, folder, late="1 hour", known=None):
    """Each part of ``rows`` arrives as a file of its own and is a batch; the query stops and starts again after each part."""
    schema = spark.createDataFrame([], FILES).schema
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        told = version_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), late, known)
        query = told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return {(r.filename, r.version, r.seq, r.content_hash) for r in spark.read.schema("filename string, version long, seq long, content_hash string").parquet(f"{folder}/out").collect()}


def by_table(spark, rows, known):
    empty = "id string, filename string, content_hash string, version int, status string, ingested_at timestamp, deprecated_at timestamp"
    old = spark.createDataFrame([(f"k{i}", n, h, v, "active", START, None) for i, (n, h, v) in enumerate(known)], empty)
    _, told = versions.track(old, spark.createDataFrame(rows, FILES).drop("at"), F.lit(START))
    return {(r.filename, r.version, r.seq, r.content_hash) for r in told.filter("is_new").collect()}


END = [(10**6, "end", "end", START + timedelta(days=9))]


@pytest.mark.parametrize("known", [[], [("hot", "copy", 4), ("f1", "h1", 2)]])
def test_shuffled_batches_and_restarts_equal_the_table(spark, tmp_path, known):
    rows = files(120, 7)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    old = spark.createDataFrame(known, "filename string, content_hash string, version int") if known else None
    got = run(spark, [mixed[:50], mixed[50:], END], tmp_path, known=old)
    want = by_table(spark, rows, known)
    assert {r for r in got if r[0] != "end"} == want and len(want) > 20


def test_order_within_the_delay_nulls_and_late_files(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [(2, "a", "y", at(20)), (1, "a", "x", at(10)), (5, None, "n", at(1)), (6, "a", None, at(1)), (7, "a", "z", None)],
        [(0, "a", "y", at(5)), (3, "a", "w", at(5000))],
        [(8, "a", "too late", at(30)), (9, "a", "x", at(5001)), (9, "b", "x", at(5001))],
        END,
    ]
    got = run(spark, parts, tmp_path, late="60 seconds")
    assert {r for r in got if r[0] != "end"} == {("a", 1, 0, "y"), ("a", 2, 1, "x"), ("a", 3, 3, "w")}


class Recorder:
    """State and timers of one key, and the calls that were made."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_text_asks_for_its_state_once_a_batch():
    """Rows are plain ones and calls are few, since most texts come once; data frames for each text took twice the time."""
    row, state, own = Row("content_hash", "seq", "filename", "at", "micros"), Recorder(), FirstOfText()
    own.init(state)
    comes = lambda *rows: (state.calls.clear(), list(own.handleInputRows(("h",), iter([row("h", s, n, None, m) for s, n, m in rows]), None)), state.calls[:])[1:]
    assert comes((7, "b", 5001), (6, "a", 5001), (1, "c", 9000)) == ([], ["get", "timer", "update"])
    assert state.value == (6, "a", 5001, False) and state.timers == {6}
    assert comes((8, "d", 5001)) == ([], ["get"])
    assert comes((2, "e", 2000)) == ([], ["get", "timer", "update"]) and state.timers == {2}
    (told,) = own.handleExpiredTimer(("h",), None, None)
    assert (told["seq"], told["filename"], told["at"].timestamp()) == (2, "e", 0.002)
    assert comes((0, "f", 1)) == ([], ["get"])
