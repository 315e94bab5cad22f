"""Very long texts go through every operator on documents."""

from quillgraph.llm import op2_target_mixing, op3_block_naming, op4_line_runs, op5_secret_grammar, op6_ngram_jaccard, op7_language_id, op8_decontamination, op9_suffix_dedup, op10_token_output
from tests.llm import test_op3, test_op4, test_op5, test_op6, test_op9, test_op10


def test_long(spark):
    body = "\n".join(f"line {i} of the text é {i * i % 977}" for i in range(30_000))
    rows = [(1, body), (2, body), (3, body[:-50] + " end"), (4, "short text"), (5, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert test_op3.got(op3_block_naming.exact_groups(df)) == test_op3.brute(rows)
    assert test_op4.got(op4_line_runs.drop_later_runs(df)) == test_op4.brute(rows, 2)
    assert test_op6.got(op6_ngram_jaccard.components(df)) == test_op6.brute(rows)
    assert test_op9.got(op9_suffix_dedup.remove_repeats(df)) == test_op9.brute(rows)
    assert test_op10.got(op10_token_output.tokens(df)) == test_op10.brute(rows)
    spans = {r.doc_id: r.spans for r in op5_secret_grammar.digest(op5_secret_grammar.scan(df)).collect()}
    assert all(spans[i] == test_op5.brute(t) for i, t in rows)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "line 77 of the text é 67 line")], "item_id bigint, text string")
    langs = df.selectExpr("*", "'en' as lang")
    assert op2_target_mixing.mix(df, labels).count() == op7_language_id.annotate(langs).count() == op8_decontamination.annotate(df, items).count() == 5
    assert op8_decontamination.annotate(df, items).filter("__n_items > 0").count() == 3
