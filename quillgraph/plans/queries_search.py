"""Queries on vectors, text and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import decisions, text, vectors
from quillgraph.operators import assembly, retrieval, text_index, vector_index
from quillgraph.plans.registry import query

CLOCK = "2024-06-01 00:00:00"


def now():
    return F.lit(CLOCK).cast("timestamp")


def _asked(t):
    """Every vector whose id is divisible by 50 as a query."""
    return t("embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _texts(t, step=1):
    """The whole texts of benchmark items whose id is divisible by ``step`` as full-text queries."""
    return t("benchmark").filter(F.col("item_id") % step == 0).select(F.col("item_id").alias("query_id"), "text")


def _whole(t):
    """Documents as chunks of their whole texts."""
    return t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _chunks(t):
    """Documents as chunks with the columns that filters look at."""
    return t("documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), F.col("source").alias("filename"),
        F.concat_ws(" > ", "source", "lang").alias("section_path"), F.col("lang").alias("category_id"),
        F.when(F.col("doc_id") % 7 == 0, "deprecated").otherwise("active").alias("status"),
        F.when(F.col("doc_id") % 5 == 0, "HEADING").when(F.col("doc_id") % 5 == 1, "DEFINITION").when(F.col("doc_id") % 5 == 2, "INDEX").alias("chunk_type"),
        (1.0 / (1 + F.col("doc_id") % 97)).alias("score"),
    )


CHUNKS_SQL = """c AS (SELECT doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, text AS content, source AS filename, source || ' > ' || lang AS section_path, lang AS category_id,
 CASE WHEN doc_id % 7 = 0 THEN 'deprecated' ELSE 'active' END AS status,
 CASE doc_id % 5 WHEN 0 THEN 'HEADING' WHEN 1 THEN 'DEFINITION' WHEN 2 THEN 'INDEX' END AS chunk_type, 1.0 / (1 + doc_id % 97) AS score FROM documents)"""
SCORES = "s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"
LEXEMES = "p AS (SELECT doc_id AS chunk_id, w AS lexeme, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) GROUP BY ALL)"
def _asked_sql(step=1):
    return f"q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS lexeme FROM benchmark WHERE item_id % {step} = 0), k AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY query_id)"


ASKED, ASKED_50 = _asked_sql(), _asked_sql(50)


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 20")
def vec_topk_cosine(t):
    found = retrieval.nearest(t("embeddings").withColumnRenamed("vec_id", "chunk_id"), _asked(t), 20)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 20")
def vec_index_topk(t):
    """The rows of vec_topk_cosine by an index whose cells are skipped where no member can be near enough."""
    index = vector_index.build(t("embeddings").withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    return vector_index.search(index, _asked(t), 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0.75) SELECT query_id, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def vec_threshold(t):
    found = retrieval.nearest(t("embeddings").withColumnRenamed("vec_id", "chunk_id"), _asked(t), 5, above=0.75)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, len(v) AS dim, round(list_sum(list_transform(v, lambda a: a / sqrt(list_sum(list_transform(v, lambda b: b * b))))), 6) AS total,
 round(v[1] / sqrt(list_sum(list_transform(v, lambda b: b * b))), 6) AS head FROM x""")
def vec_truncate_norm(t):
    v = vectors.truncate_normalize("embedding", 16)
    own = t("embeddings").select("vec_id", v.alias("v"))
    return own.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("v")[0], 6).alias("head"))


@query("""WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM x GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS label, count(*) AS dim, round(sqrt(sum(v * v)), 6) AS norm, round(sum(v * (i + 1)), 4) AS mark FROM m GROUP BY label""")
def vec_mean_pool_by_label(t):
    parts = t("embeddings").select("label", F.posexplode(vectors.as_doubles("embedding")).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    return parts.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("dim"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"), F.round(F.sum(F.col("v") * (F.col("i") + 1)), 4).alias("mark"))


_UNIT = "list_transform({v}, lambda a: a / sqrt(list_sum(list_transform({v}, lambda b: b * b))))"


@query(f"""WITH x AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS va, CAST(embedding[1:8] AS DOUBLE[]) AS vp, CAST(embedding[9:16] AS DOUBLE[]) AS vq FROM embeddings),
y AS (SELECT vec_id, list_concat({_UNIT.format(v='va')}, {_UNIT.format(v='vp')}, CASE WHEN vec_id % 2 = 0 THEN {_UNIT.format(v='vq')} ELSE [0.0, 0, 0, 0, 0, 0, 0, 0] END) AS h FROM x)
SELECT vec_id, len(h) AS dim, round(h[1] / sqrt(list_sum(list_transform(h, lambda b: b * b))), 6) AS head, round(h[33] / sqrt(list_sum(list_transform(h, lambda b: b * b))), 6) AS mid FROM y""")
def vec_hybrid_concat(t):
    v = vectors.as_doubles("embedding")
    none = F.array().cast("array<array<double>>")
    h = vectors.hybrid(v, F.array(F.slice(v, 1, 8)), F.when(F.col("vec_id") % 2 == 0, F.array(F.slice(v, 9, 8))).otherwise(none), 32, 8)
    own = t("embeddings").select("vec_id", h.alias("h"))
    return own.select("vec_id", F.size("h").cast("long").alias("dim"), F.round(F.col("h")[0], 6).alias("head"), F.round(F.col("h")[32], 6).alias("mid"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b
ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.25 WHERE a.vec_id % 50 = 0""")
def vec_pairwise_similar(t):
    e = t("embeddings")
    asked = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label")
    found = retrieval.nearest(e, asked, None, "vec_id", "embedding", above=0.25 - 1e-12, same="label")
    return found.filter("query_id < vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.round("score", 6).alias("score"))


@query(f"WITH {LEXEMES}, {ASKED} SELECT q.query_id, p.chunk_id, CAST(sum(p.n) AS BIGINT) AS hits FROM p JOIN q ON p.lexeme = q.lexeme JOIN k ON q.query_id = k.query_id GROUP BY q.query_id, p.chunk_id, k.wanted HAVING count(*) = k.wanted")
def lex_and_match(t):
    found = retrieval.match_texts(_whole(t), retrieval.query_lexemes(_texts(t)))
    return found.select("query_id", "chunk_id", "hits")


@query(f"""WITH {LEXEMES}, {ASKED_50}, l AS (SELECT chunk_id, sum(n) AS length FROM p GROUP BY chunk_id), w AS (SELECT count(*) AS chunks, avg(length) AS mean FROM l), d AS (SELECT lexeme, count(*) AS df FROM p GROUP BY lexeme)
SELECT q.query_id, p.chunk_id, round(sum(ln(1 + (chunks - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))), 5) AS score FROM p JOIN q ON p.lexeme = q.lexeme JOIN d ON d.lexeme = p.lexeme JOIN l ON l.chunk_id = p.chunk_id, w GROUP BY q.query_id, p.chunk_id""")
def lex_bm25(t):
    asked = retrieval.query_lexemes(_texts(t, 50))
    index = retrieval.postings(t("documents"), "doc_id", "text", only=asked).withColumnRenamed("doc_id", "chunk_id")
    length = retrieval.lengths(t("documents"), "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    return retrieval.bm25(index, asked, length=length).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query(f"""WITH {LEXEMES}, {ASKED}, l AS (SELECT chunk_id, sum(n) AS length FROM p GROUP BY chunk_id), w AS (SELECT count(*) AS chunks, avg(length) AS mean FROM l), d AS (SELECT lexeme, count(*) AS df FROM p GROUP BY lexeme),
s AS (SELECT q.query_id, p.chunk_id, round(sum(ln(1 + (chunks - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM p JOIN q ON p.lexeme = q.lexeme JOIN d ON d.lexeme = p.lexeme JOIN l ON l.chunk_id = p.chunk_id, w GROUP BY q.query_id, p.chunk_id)
SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20""")
def lex_blocks_topk(t):
    """The 20 best documents for every benchmark item, from blocks of postings that can hold one."""
    index = text_index.build(t("documents").withColumnRenamed("doc_id", "chunk_id"), "chunk_id", "text")
    return text_index.search(index, retrieval.query_lexemes(_texts(t)), 20).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {LEXEMES} SELECT lexeme, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM p GROUP BY lexeme")
def postings_stats(t):
    index = retrieval.postings(t("documents"), "doc_id", "text")
    return index.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("positions")).cast("long").alias("cf"))


@query()
def lex_cover_density(t):
    asked = retrieval.query_lexemes(_texts(t), english=True)
    found = retrieval.match_texts(_whole(t), asked, english=True).withColumn("score", retrieval.density())
    return retrieval.ranked(found, 20).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_RANKED = f"""{SCORES}, {LEXEMES}, {ASKED},
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20),
m AS (SELECT q.query_id, p.chunk_id, sum(p.n) AS hits FROM p JOIN q ON p.lexeme = q.lexeme JOIN k ON q.query_id = k.query_id GROUP BY q.query_id, p.chunk_id, k.wanted HAVING count(*) = k.wanted),
x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM m) WHERE rank <= 20),
u AS (SELECT query_id, chunk_id, rank, 0 AS list FROM v UNION ALL SELECT query_id, chunk_id, rank, 1 FROM x),
f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY query_id, chunk_id)"""


def _lists(t):
    by_vector = retrieval.nearest(t("embeddings").withColumnRenamed("vec_id", "chunk_id"), _asked(t), 20)
    matched = retrieval.match_texts(_whole(t), retrieval.query_lexemes(_texts(t)))
    by_text = retrieval.ranked(matched.withColumn("score", F.col("hits").cast("double")), 20)
    return by_vector, by_text


@query(f"WITH {_RANKED} SELECT query_id, chunk_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id) AS rank FROM f) WHERE rank <= 10")
def hybrid_topk(t):
    """The flagship: vector and full-text lists fused by reciprocal ranks. Documents and vectors of equal id are paired."""
    return retrieval.reciprocal_rank_fusion(list(_lists(t)), 10).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query("""WITH r AS (SELECT label AS query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r1, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r2 FROM embeddings),
u AS (SELECT query_id, chunk_id, r1 AS rank FROM r WHERE r1 <= 30 UNION ALL SELECT query_id, chunk_id, r2 FROM r WHERE r2 <= 30)
SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY query_id, chunk_id""")
def rrf_fusion(t):
    w = Window.partitionBy("label")
    own = t("embeddings").select(F.col("label").cast("long").alias("query_id"), "label", F.col("vec_id").alias("chunk_id"))
    lists = [own.withColumn("rank", F.row_number().over(w.orderBy(c))).filter("rank <= 30") for c in (F.asc("chunk_id"), F.desc("chunk_id"))]
    return retrieval.reciprocal_rank_fusion(lists, 10**6).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


@query(f"WITH {SCORES} SELECT chunk_id, query_id AS best_query, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, query_id) AS r FROM s WHERE score > 0.2) WHERE r = 1")
def multi_query_merge(t):
    """Several phrasings of one query: each chunk once, with its best score."""
    found = retrieval.best_query(t("embeddings").withColumnRenamed("vec_id", "chunk_id"), _asked(t), above=0.2)
    return found.select("chunk_id", F.col("query_id").alias("best_query"), F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS_SQL}, r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, doc_id, n_chars FROM documents) SELECT lang, doc_id, n_chars FROM r WHERE pos = 1")
def dedup_first_seen(t):
    own = t("documents").select(F.lit(0).alias("query_id"), F.col("lang").alias("chunk_id"), "doc_id", F.col("doc_id").alias("seq"), "n_chars")
    return retrieval.dedup_first(own).select(F.col("chunk_id").alias("lang"), "doc_id", "n_chars")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id FROM c WHERE status = 'active' AND coalesce(chunk_type, 'PARAGRAPH') NOT IN ('HEADING', 'INDEX')")
def filter_excl_types(t):
    return retrieval.scope(_chunks(t)).select("chunk_id")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id FROM c WHERE status = 'active' AND coalesce(chunk_type, 'PARAGRAPH') NOT IN ('HEADING', 'INDEX') AND section_path ILIKE '%C1 > E%' AND filename ILIKE '%SRC%'")
def filter_ilike(t):
    return retrieval.scope(_chunks(t), document_id="c1 > e", filename="SRC").select("chunk_id")


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, category_id FROM c WHERE status = 'active' AND coalesce(chunk_type, 'PARAGRAPH') NOT IN ('HEADING', 'INDEX') AND category_id IN ('fr', 'es')")
def filter_category_scope(t):
    return retrieval.scope(_chunks(t), categories=["fr", "es"]).select("chunk_id", "category_id")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F')")
def row_value_in(t):
    wanted = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return t("lineitem").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")


@query("""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars, CAST(max(length(sentence)) AS BIGINT) AS longest FROM s GROUP BY doc_id""")
def sentence_split(t):
    own = t("documents").select("doc_id", F.explode(text.sentences("text")).alias("sentence"))
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max(F.length("sentence")).cast("long").alias("longest"))


@query()
def sentence_pack(t):
    return t("documents").select("doc_id", F.posexplode(text.pack_sentences("text", 128)).alias("piece", "content")).withColumn("tokens", text.token_count("content"))


@query()
def trailing_overlap(t):
    return t("documents").select("doc_id", text.trailing_sentences("text", 40).alias("overlap"))


_TYPED = """CASE WHEN doc_id % 11 = 0 THEN 'Explanation. ' || text WHEN doc_id % 11 = 1 THEN '# ' || source WHEN doc_id % 11 = 2 THEN '- a' || chr(10) || '- b' || chr(10) || '2) c'
 WHEN doc_id % 11 = 3 THEN 'Section 1' || chr(10) || 'Chapter 2 ... 9' || chr(10) || 'clause 33' WHEN doc_id % 11 = 4 THEN text || chr(10) || '  For the purpose of this rule' ELSE text END"""


@query(f"""WITH x AS (SELECT doc_id, trim({_TYPED}, ' ' || chr(10) || chr(9)) AS content FROM documents),
y AS (SELECT doc_id, content, len(regexp_extract_all(content, '(?i)\\b(?:Section|Chapter|Part|Schedule|Clause)\\s+\\d+')) AS refs, string_split(content, chr(10)) AS lines,
 len(regexp_extract_all(content, '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]')) AS tokens FROM x)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'TABLE' WHEN doc_id % 13 = 1 THEN 'CODE' WHEN content LIKE '#%' AND tokens < 20 THEN 'HEADING'
 WHEN refs >= 3 AND (contains(content, '...') OR len(list_filter(lines, lambda l: length(trim(l)) < 60)) / len(lines) > 0.7) THEN 'INDEX'
 WHEN regexp_matches(content, '(?im)(?:^|\\n)\\s*(?:Explanation[\\s.:—\\-]|Provided\\s+that\\b|Proviso[\\s.:—\\-]|For\\s+the\\s+purposes?\\s+of\\s+(?:this|the)\\b|\\"[A-Za-z\\s]+\\"\\s+(?:means?|includes?|shall\\s+mean)|hereinafter\\s+(?:referred|called)\\b)') THEN 'DEFINITION'
 WHEN len(list_filter(lines, lambda l: regexp_matches(l, '^\\s*([-*+]|\\d+[.)]) '))) / len(lines) > 0.5 THEN 'LIST' ELSE 'PARAGRAPH' END AS chunk_type, CAST(refs AS BIGINT) AS refs FROM y""")
def chunk_type_classify(t):
    own = t("documents").withColumn("content", F.expr(_TYPED.replace("chr(10)", "char(10)")))
    return own.select("doc_id", text.chunk_type("content", F.col("doc_id") % 13 == 0, F.col("doc_id") % 13 == 1).alias("chunk_type"), text.section_references("content").cast("long").alias("refs"))


@query(f"SELECT event_id, round(greatest(0.0, 1 - (epoch_us(TIMESTAMP '{CLOCK}') - epoch_us(ts)) / 86400000000.0 / 365), 4) AS freshness, round(value * (1 + 0.05 * greatest(0.0, 1 - (epoch_us(TIMESTAMP '{CLOCK}') - epoch_us(ts)) / 86400000000.0 / 365)), 6) AS boosted FROM events")
def freshness_score(t):
    at = F.col("ts").cast("timestamp")
    return t("events").select("event_id", text.freshness(at, now()).alias("freshness"), F.round(text.freshness_boost("value", at, now()), 6).alias("boosted"))


@query("""SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), 'Section: ' || source, CASE WHEN doc_id % 3 = 0 THEN 'Summary: ' || lang END, CASE WHEN doc_id % 2 = 0 THEN 'Keywords: ' || lang || ', ' || source END, CASE WHEN doc_id % 5 = 0 THEN 'Questions: a? b?' END, text)) AS digest FROM documents""")
def embed_text_build(t):
    none = F.array().cast("array<string>")
    own = text.chunk_embedding_text("text", "source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(none), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a?"), F.lit("b?"))))
    return t("documents").select("doc_id", F.sha2(own.cast("binary"), 256).alias("digest"))


@query("SELECT doc_id, regexp_replace(lower(trim('  ' || source || ' ' || upper(lang) || '.;  ')), '[.,;:!?]+$', '') AS name FROM documents")
def name_normalise(t):
    return t("documents").select("doc_id", text.normalize_name(F.concat(F.lit("  "), "source", F.lit(" "), F.upper("lang"), F.lit(".;  "))).alias("name"))


_QUESTION = """CASE conv_id % 8 WHEN 0 THEN 'Calculate the total of ' || turn WHEN 1 THEN 'compare these two' WHEN 2 THEN 'Is it related to that?' WHEN 3 THEN 'notwithstanding the rule' WHEN 4 THEN 'how does a affect b' WHEN 5 THEN 'sum without digits' WHEN 6 THEN 'under what conditions' ELSE text END"""


@query(f"""WITH x AS (SELECT conv_id, turn, {_QUESTION} AS q FROM conversations),
y AS (SELECT *, regexp_matches(q, '(?i)\\b(calculate|sum|average|total|mean|percentage|ratio|difference)\\b.*\\d') AS calc,
 regexp_matches(q, '(?i)\\b(compare|contrast|distinguish|under\\s+what\\s+conditions|exhaustive|contradiction)\\b') AS ana,
 regexp_matches(q, '(?i)\\b(relationship|connected|relate[sd]?\\s+to|link(?:ed|s)?\\s+(?:to|with)|how does .+ (?:affect|impact|influence))\\b') AS gra,
 regexp_matches(q, '(?i)\\b(contradict[s]?|conflicting?|notwithstanding|contrary\\s+to)\\b') AS con FROM x)
SELECT conv_id, turn, CASE WHEN calc OR ana THEN 'ANALYTICAL' WHEN gra OR con THEN 'GRAPH' ELSE 'SIMPLE' END AS query_type, calc OR ana OR gra OR con AS activate_graph, calc AS activate_calculator FROM y""")
def query_classify(t):
    own = t("conversations").select("conv_id", "turn", decisions.execution_plan(F.expr(_QUESTION)).alias("p"))
    return own.select("conv_id", "turn", "p.query_type", "p.activate_graph", "p.activate_calculator")


@query("""WITH x AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(list_sum(n), 4) AS s, round(list_avg(n), 4) AS m, round(CASE WHEN len(n) > 1 THEN n[1] - n[2] ELSE 0 END, 4) AS d, round(CASE WHEN len(n) > 1 AND n[2] <> 0 THEN n[1] / n[2] ELSE 0 END, 4) AS r,
 round(CASE WHEN len(n) > 1 AND n[1] <> 0 THEN (n[2] - n[1]) / n[1] * 100 ELSE 0 END, 4) AS p, list_min(n) AS lo, list_max(n) AS hi, CAST(len(n) AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS unknown FROM x""")
def calc_ops(t):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"])
    own = t("lineitem").groupBy("l_orderkey").agg(ordered.alias("n"))
    names = {"s": "sum", "m": "mean", "d": "difference", "r": "ratio", "p": "percentage_change", "lo": "min", "hi": "max", "c": "count", "unknown": "median"}
    return own.select("l_orderkey", *[decisions.calculate(F.lit(o), "n").alias(c) for c, o in names.items()])


@query("""WITH x AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, CAST(a.l_suppkey % 3 AS INT) AS va, CAST(b.l_suppkey % 3 AS INT) AS vb, CAST(a.l_shipdate AS VARCHAR) AS ta, CAST(b.l_shipdate AS VARCHAR) AS tb, a.l_returnflag = 'R' AS ha, b.l_returnflag = 'R' AS hb, a.l_tax AS sa, b.l_tax AS sb
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN va <> vb THEN CASE WHEN va > vb THEN 'a' ELSE 'b' END WHEN ta <> tb THEN CASE WHEN ta > tb THEN 'a' ELSE 'b' END WHEN ha <> hb THEN CASE WHEN ha THEN 'a' ELSE 'b' END WHEN sa >= sb THEN 'a' ELSE 'b' END AS winner FROM x""")
def conflict_winner(t):
    side = F.struct((F.col("l_suppkey") % 3).cast("int").alias("version"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"), (F.col("l_returnflag") == "R").alias("has_table"), F.col("l_tax").alias("score"))
    own = t("lineitem")
    a = own.select("l_orderkey", F.col("l_linenumber").cast("long").alias("i"), side.alias("a"))
    b = own.select("l_orderkey", F.col("l_linenumber").cast("long").alias("j"), side.alias("b"))
    return a.join(b, "l_orderkey").filter("i < j").select("l_orderkey", "i", "j", decisions.conflict_winner("a", "b")["winner"].alias("winner"))


@query("""SELECT conv_id, turn, turn > 0 AND turn % 5 <> 4 AND conv_id % 9 <> 0 AND NOT (CASE conv_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END) AS ok,
 turn < 2 AND (conv_id % 4 IN (0, 3) OR turn < CASE WHEN conv_id % 3 = 0 THEN 3 ELSE 2 END OR (conv_id % 3 < 2 AND length(CASE conv_id % 4 WHEN 0 THEN 'I could NOT find it' WHEN 1 THEN 'An Error Occurred' WHEN 2 THEN text ELSE 'Insufficient ' || text END) < 200)) AS again FROM conversations""")
def cacheable_and_coverage(t):
    answer = F.expr("CASE conv_id % 4 WHEN 0 THEN 'I could NOT find it' WHEN 1 THEN 'An Error Occurred' WHEN 2 THEN text ELSE 'Insufficient ' || text END")
    kind = F.when(F.col("conv_id") % 3 == 0, "ANALYTICAL").when(F.col("conv_id") % 3 == 1, "GRAPH").otherwise("SIMPLE")
    ok = decisions.cacheable(answer, "turn", F.when(F.col("conv_id") % 9 == 0, "x"), F.col("turn") % 5 == 4)
    return t("conversations").select("conv_id", "turn", ok.alias("ok"), decisions.needs_another_pass(answer, "turn", kind, "turn").alias("again"))


@query(f"""WITH x AS (SELECT vec_id, embedding, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) AS score FROM embeddings q, x WHERE q.vec_id % 50 = 0 AND x.label < 8)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE score > 0.95) WHERE r = 1""")
def cache_lookup(t):
    cache = t("embeddings").select(F.col("vec_id").alias("id"), "embedding", (now() + F.expr("make_dt_interval(0, 8 - label)")).alias("expires_at"))
    return assembly.cache_lookup(cache, _asked(t), now()).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {CHUNKS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY coalesce(chunk_type = 'DEFINITION', false) DESC, score DESC, chunk_id) AS pos,
 '[' || substr(CAST(chunk_id AS VARCHAR), 1, 12) || '] (file: ' || filename || ', section: ' || section_path || ')' || chr(10) || content AS entry FROM c),
w AS (SELECT *, sum(length(entry) + 2) OVER (PARTITION BY category_id ORDER BY pos) - 2 AS used FROM o)
SELECT category_id, chunk_id, pos FROM w WHERE used <= 8192""")
def context_budget(t):
    rows = _chunks(t).withColumn("query_id", F.col("category_id")).withColumn("seq", F.col("chunk_id")).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return assembly.ordered_context(rows).select("category_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {CHUNKS_SQL}, d AS (SELECT category_id, chunk_id, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, chunk_id) AS r, content FROM c)
SELECT category_id, bool_or(regexp_matches(content, '\\d')) AS digits FROM d WHERE r <= 10 GROUP BY category_id""")
def digit_gate(t):
    rows = _chunks(t).withColumn("query_id", F.col("category_id"))
    return assembly.has_digits(rows, order=(F.desc("score"), "chunk_id")).select(F.col("query_id").alias("category_id"), "digits")


@query(f"""WITH {CHUNKS_SQL}, b AS (SELECT category_id, chunk_id, score, row_number() OVER (PARTITION BY category_id ORDER BY score DESC, chunk_id) AS rank FROM c),
e AS (SELECT b.*, epoch_us(TIMESTAMP '{CLOCK}') - chunk_id * 86400000000 AS made FROM b WHERE rank <= 10)
SELECT category_id, chunk_id, round(score * (1 + 0.05 * greatest(0.0, 1 - (epoch_us(TIMESTAMP '{CLOCK}') - made) / 86400000000.0 / 365)), 8) AS score FROM e""")
def rerank_fresh(t):
    w = Window.partitionBy("category_id").orderBy(F.desc("score"), "chunk_id")
    rows = _chunks(t).withColumn("rank", F.row_number().over(w)).withColumn("query_id", F.col("category_id")).withColumn("ingested_at", F.timestamp_micros(F.unix_micros(now()) - F.col("chunk_id") * 86_400_000_000))
    return retrieval.rerank(rows, None, now()).select("category_id", "chunk_id", F.round("score", 8).alias("score"))
