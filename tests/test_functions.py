import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions import decisions, text, vectors
from quillgraph.functions.stemming import stem
from quillgraph.operators import assembly, entity_dedup, retrieval
from quillgraph.sources.files import page_markdown


def value(spark, column, *rows):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("content,table,code,want", [
    ("x", True, False, "TABLE"), ("x", False, True, "CODE"), ("x", True, True, "TABLE"), ("# Introduction", False, False, "HEADING"), ("- a\n- b\n- c\n- d", False, False, "LIST"), ("1. a\n2. b\n3. c\n4. d", False, False, "LIST"),
    ("A plain sentence.", False, False, "PARAGRAPH"), ('"Owner" means a person', False, False, "DEFINITION"), ("Section 1\nsection 2\nPart 3", False, False, "INDEX"), ("Provided that it holds", False, False, "DEFINITION"),
])
def test_chunk_type(spark, content, table, code, want):
    assert value(spark, text.chunk_type(F.lit(content), F.lit(table), F.lit(code))) == want


@pytest.mark.parametrize("days,low,high", [(0, 0.99, 1), (182, 0.49, 0.51), (365, 0, 0.0001), (500, 0, 0)])
def test_freshness(spark, days, low, high):
    now = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    got = value(spark, text.freshness(F.lit(now - dt.timedelta(days=days)), F.lit(now)))
    assert low <= got <= high
    boost = value(spark, text.freshness_boost(F.lit(2.0), F.lit(now - dt.timedelta(days=days)), F.lit(now)))
    assert abs(boost - 2 * (1 + 0.05 * max(0, 1 - days / 365))) < 1e-9


def test_embedding_texts(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None).cast("array<string>")
    assert value(spark, text.chunk_embedding_text(F.lit("c"), F.lit("s"), F.lit("sum"), a("a", "b"), a("q1", "q2"))) == "Section: s\n\nSummary: sum\n\nKeywords: a, b\n\nQuestions: q1 q2\n\nc"
    assert value(spark, text.chunk_embedding_text(F.lit("c"), F.lit(""), F.lit(None).cast("string"), none, F.array().cast("array<string>"))) == "c"
    assert value(spark, text.community_embedding_text(a("A"), a("T"), none, F.lit("s"))) == "Entities: A\nEntity types: T\nSummary: s"
    assert value(spark, text.community_embedding_text(a("A"), a("T"), a("R"), F.lit(None).cast("string"))) == ""


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    got = [value(spark, vectors.cosine(v(*a), v(*b))) for a, b in (((1, 2), (1, 2)), ((1, 0), (0, 1)), ((1, 2), (-1, -2)), ((0, 0), (1, 2)))]
    assert [round(x, 9) for x in got] == [1, 0, -1, 0]
    assert value(spark, vectors.l2_normalize(v(0, 0))) == [0, 0]
    assert value(spark, vectors.mean_pool(F.array(v(1, 2, 3), v(3, 4, 5)), 3)) == [2, 3, 4]
    assert value(spark, vectors.mean_pool(F.array().cast("array<array<double>>"), 4)) == [0] * 4
    cut = value(spark, vectors.truncate_normalize(F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda x: x.cast("double")), 512))
    assert len(cut) == 512 and abs(sum(x * x for x in cut) - 1) < 1e-9
    text_part, part = v(*range(1, 5)), F.array(v(1, 0), v(0, 1))
    none = F.array().cast("array<array<double>>")
    for s, t in ((part, part), (part, none), (none, none)):
        h = value(spark, vectors.hybrid(text_part, s, t, 4, 2))
        assert len(h) == 8 and abs(sum(x * x for x in h) - 1) < 1e-9
    assert value(spark, vectors.hybrid(text_part, none, none, 4, 2)) == value(spark, vectors.query_hybrid(text_part, 4, 2))


def test_names_and_sentences(spark):
    assert value(spark, text.normalize_name(F.lit("  John Smith.;"))) == "john smith"
    assert value(spark, text.pack_sentences(F.lit("One two. Three four. Five six seven eight nine. X"), 7)) == ["One two. Three four.", "Five six seven eight nine. X"]
    assert value(spark, text.trailing_sentences(F.lit("Aa bb. Cc dd. Ee."), F.lit(5))) == "Cc dd. Ee."


def test_ratio():
    assert round(entity_dedup.token_sort_ratio("smith, john", "john smith"), 1) == 95.2
    assert round(entity_dedup.token_sort_ratio("acme corporation", "acme corporations"), 1) == 97.0
    assert round(entity_dedup.token_sort_ratio("acme corp", "acme corporation"), 1) == 72.0


def test_stems():
    words = "caresses ponies ties cats feed agreed plastered motoring conflated hopping falling relational conditional vietnamization formaliti goodness electricity adjustment generously skies dying news consistency happily knack running"
    want = "caress poni tie cat feed agre plaster motor conflat hop fall relat condit vietnam formal good electr adjust generous sky die news consist happili knack run"
    assert [stem(w) for w in words.split()] == want.split()


@pytest.mark.parametrize("positions,want", [([[1], [2]], 0.1 / 1.1), ([[1], [4]], (0.1 / 3) / (1 + 0.1 / 3)), ([[3, 9]], 0.2 / 1.2), ([[1, 5], [2, 6]], None)])
def test_cover_density(positions, want):
    got = retrieval.cover_density(positions)
    if want is None:
        r = 0.1 + 0.1 / (1 + 2) + 0.1
        want = r / (r + 1)
    assert abs(got - want) < 1e-9


def test_rrf(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id int, chunk_id string, rank int")
    got = retrieval.reciprocal_rank_fusion([rows((1, "a", 1), (1, "b", 2), (1, "c", 3)), rows((1, "b", 1), (1, "d", 2))], 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "d", "c"]
    assert [round(r.score, 9) for r in got] == [round(x, 9) for x in (1 / 62 + 1 / 61, 1 / 61, 1 / 62, 1 / 63)]


def test_history(spark):
    rows = [("c", i, i, "user" if i % 2 == 0 else "assistant", "x" * 10) for i in range(9)]
    df = spark.createDataFrame(rows, "conversation_id string, id int, created_at int, role string, content string")
    kept = lambda n, chars: sorted(r.id for r in assembly.trim_history(df, EngineConfig(history_messages=n, history_chars=chars)).collect())
    assert kept(4, 1000) == [6, 7, 8] and kept(10, 25) == [8] and kept(10, 5) == [] and kept(10, 1000) == list(range(9))


def test_context_stops_at_the_first_that_does_not_fit(spark):
    rows = [("q", i, str(i), "x" * n, float(-i), "s", None, "f") for i, n in enumerate([10, 60, 5])]
    df = spark.createDataFrame(rows, "query_id string, seq int, chunk_id string, content string, score double, section_path string, chunk_type string, filename string")
    assert assembly.context(df, EngineConfig(context_tokens=20)).first()["context"] == "[0] (file: f, section: s)\nxxxxxxxxxx"
    assert assembly.context(df, EngineConfig(context_tokens=2)).first()["context"] == ""


def test_conflicts(spark):
    side = "version int, ingested_at string, has_table boolean, score double"
    cases = [((2, "x", False, 0.1), (1, "y", True, 0.9), "a"), ((1, "2024", False, 0.1), (1, "2025", True, 0.9), "b"), ((1, "", False, 0.9), (1, "x", True, 0.1), "b"), ((1, "x", True, 0.5), (1, "x", True, 0.5), "a")]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], f"a struct<{side.replace(' ', ':').replace(',:', ',')}>, b struct<{side.replace(' ', ':').replace(',:', ',')}>, want string")
    assert all(r.got == r.want for r in df.select("want", decisions.conflict_winner("a", "b")["winner"].alias("got")).collect())


@pytest.mark.parametrize("op,nums,want", [("sum", [1, 2.5], 3.5), ("ratio", [1, 0], 0), ("ratio", [3], 0), ("difference", [5, 2, 1], 3), ("percentage_change", [50, 75], 50), ("count", [1, 1, 1], 3), ("median", [1], None), ("sum", [], None)])
def test_calculate(spark, op, nums, want):
    assert value(spark, decisions.calculate(F.lit(op), F.array(*[F.lit(float(n)) for n in nums]).cast("array<double>"))) == want


def test_html():
    html = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><h1>Top &amp; more</h1><p>One <b>two</b>.</p><ul><li>a</li><li>b</li></ul><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table><pre>code\n  more</pre><script>x</script></body></html>"
    assert page_markdown(html) == "# Top & more\n\nOne two.\n\n- a\n\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n  more\n```"
    assert DEFAULT.rrf_k == 60


def test_settings_from_the_session(spark):
    spark.conf.set("quillgraph.rrf_k", "10")
    spark.conf.set("quillgraph.excluded_types", "INDEX,LIST")
    try:
        own = EngineConfig.from_session(spark)
        assert own.rrf_k == 10 and own.excluded_types == ("INDEX", "LIST") and own.margin == 1.0
    finally:
        spark.conf.unset("quillgraph.rrf_k")
        spark.conf.unset("quillgraph.excluded_types")
