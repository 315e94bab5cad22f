import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.sources import files


def test_a_batch_is_worked_on_by_slices():
    column = pa.array([f"{i} " + "x" * 20_000 for i in range(1000)])
    tracemalloc.start()
    made = files._sliced(lambda own: [x.upper() for x in own], pa.string(), column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist() == [x.upper() for x in column.to_pylist()]
    assert most < 6 * files.ROWS * 20_000  # all 1,000 rows would take 20 MB, and their results as much
    assert len(files._sliced(lambda own: own, pa.string(), column.slice(0, 0))) == 0


def test_failures_stay_beside_their_files(spark):
    def parse(path, content):
        if int(path) % 7 == 3:
            raise ValueError("no")
        return [path, None, content.decode()] if int(path) % 2 else []

    error = F.when(F.col("id") % 5 == 0, "known")
    rows = spark.range(0, 300, 1, 2).select(F.col("id").cast("string").alias("path"), F.lit(b"c").alias("content"), error.alias("error"))
    got = {int(r["path"]): (r["pages"], r["error"]) for r in files.parsed(rows, parse).collect()}
    for i in range(300):
        want = (None, "known") if i % 5 == 0 else (None, "parse: no") if i % 7 == 3 else ([str(i), None, "c"] if i % 2 else [], None)
        assert got[i] == want
    pages = spark.range(200).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("<h1>"), "id", F.lit("</h1>"))).alias("h"), "id")
    assert {r["id"]: r["m"] for r in pages.select("id", files.html_to_markdown("h").alias("m")).collect()} == {i: f"# {i}" if i % 3 else "" for i in range(200)}
