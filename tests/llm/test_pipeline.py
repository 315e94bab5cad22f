import corpus_pipeline as pipe

from quillgraph.llm import common
from tests.llm import test_op6, test_op8, test_op10


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in pipe.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token output"]
    for name, stage in pipe.STAGES[:-1]:
        after = common.cut(stage(spark, before, sf_small))
        assert after.columns == columns
        own, kept = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert all(own[i] == r for i, r in kept.items())
        if name.startswith("n-gram"):
            want = test_op6.brute([(i, r.text) for i, r in own.items()])
            assert set(kept) == {i for i, (_, c) in want.items() if c == i}
        if name.startswith("benchmark"):
            items = [test_op8.split(r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
            for i in kept:
                assert not any(" ".join(w) in " ".join(test_op8.split(own[i].text)) for w in items)
        if name.startswith(("language", "mixing")):
            assert len(kept) > 0.8 * len(own)
        before = after
    assert test_op10.got(pipe.STAGES[-1][1](spark, before, sf_small)) == test_op10.brute([(r.doc_id, r.text) for r in before.collect()])


def test_empty(spark, tmp_path, sf_small):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0
