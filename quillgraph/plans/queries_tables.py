"""Queries on documents, versions, catalog listings, logs and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.operators import assembly, chunking, listings, versions
from quillgraph.plans.queries_search import CLOCK, now
from quillgraph.plans.registry import query
from quillgraph.sources import catalog, files


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_docs(t):
    own = t("documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return own.filter("copies > 1")


def _known(t):
    return t("documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("text")).select(
        F.concat(F.lit("old-"), "source").alias("id"), F.col("source").alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.lit(3).alias("version"), F.lit("active").alias("status"), now().alias("ingested_at"), F.lit(None).cast("timestamp").alias("deprecated_at"))


@query("""WITH k AS (SELECT source AS filename, sha256(arg_min(text, doc_id)) AS content_hash, 3 AS version FROM documents GROUP BY source),
k1 AS (SELECT min(filename) AS filename, content_hash, min(version) AS version FROM k GROUP BY content_hash),
f AS (SELECT doc_id AS seq, source AS filename, sha256(text) AS content_hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS turn FROM documents),
n AS (SELECT f.*, coalesce(m.version, 0) + row_number() OVER (PARTITION BY f.filename ORDER BY f.seq) AS version, lead(f.seq) OVER (PARTITION BY f.filename ORDER BY f.seq) IS NULL AS latest
 FROM f LEFT JOIN k1 ON f.content_hash = k1.content_hash LEFT JOIN (SELECT filename, max(version) AS version FROM k GROUP BY filename) m ON m.filename = f.filename WHERE turn = 1 AND k1.content_hash IS NULL)
SELECT filename, version, CASE WHEN latest THEN 'active' ELSE 'deprecated' END AS status, content_hash FROM n
UNION ALL SELECT k.filename, k.version, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.filename = k.filename) THEN 'deprecated' ELSE 'active' END, k.content_hash FROM k""")
def version_track(t):
    new = t("documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    after, _ = versions.track(_known(t), new, now())
    return after.select("filename", F.col("version").cast("long").alias("version"), "status", "content_hash")


@query("""WITH r AS (SELECT source, n_chars, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents WHERE doc_id % 4 <> 0)
SELECT source AS filename, n_chars AS version, doc_id FROM r WHERE r = 1""")
def active_version(t):
    own = t("documents").select(F.col("source").alias("filename"), F.struct("n_chars", "doc_id").alias("version"), F.when(F.col("doc_id") % 4 == 0, "deprecated").otherwise("active").alias("status"))
    return versions.active(own).select("filename", F.col("version.n_chars").alias("version"), F.col("version.doc_id").alias("doc_id"))


@query("""WITH n AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS document_id, CAST(doc_id // 50 AS INT) AS chunk_index, sha256(text) AS h FROM documents),
o AS (SELECT document_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN h ELSE 'x' END AS h FROM n WHERE chunk_index % 3 <> 2)
SELECT n.document_id, CAST(n.chunk_index AS BIGINT) AS chunk_index, o.document_id IS NULL AS is_new FROM n LEFT JOIN o ON n.document_id = o.document_id AND n.chunk_index = o.chunk_index WHERE n.h IS DISTINCT FROM o.h""")
def change_detect(t):
    new = t("documents").select((F.col("doc_id") % 50).cast("string").alias("document_id"), F.expr("cast(doc_id div 50 as int)").alias("chunk_index"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    old = new.filter("chunk_index % 3 <> 2").withColumn("content_hash", F.when(F.col("chunk_index") % 2 == 0, F.col("content_hash")).otherwise("x"))
    return chunking.changed_chunks(new, old).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_custkey % 7 = 0")
def keyed_upsert(t):
    own = t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    rows = own.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("NEW")).unionByName(own.filter("c_custkey % 7 = 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("NEW").alias("segment")))
    return catalog.upsert(own, rows, ("c_custkey",))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT DISTINCT l_orderkey, 1, 0.0 FROM lineitem WHERE l_orderkey % 5 = 0)")
def replace_group(t):
    own = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    rows = own.filter("l_orderkey % 5 = 0").select("l_orderkey", F.lit(1).cast("long").alias("l_linenumber"), F.lit(0.0).alias("l_quantity")).distinct()
    return catalog.replace_group(own, rows, "l_orderkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'changed' ELSE p_brand END AS p_brand FROM part")
def keyed_update(t):
    own = t("part").select("p_partkey", "p_brand")
    rows = t("part").filter("p_partkey % 4 = 0").select("p_partkey", F.lit("changed").alias("p_brand")).unionByName(own.limit(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("unknown").alias("p_brand")))
    return catalog.update(own, rows, ("p_partkey",), ("p_brand",))


@query("""SELECT d.doc_id, d.source AS filename, d.lang AS category, count(l.doc_id) AS chunk_count FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 7 <> 0 GROUP BY d.doc_id, d.source, d.lang""")
def doc_listing_counts(t):
    docs = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("filename"), F.col("lang").alias("category_id"), F.lit(1).alias("version"), F.lit(now()).alias("ingested_at"), F.when(F.col("doc_id") % 7 == 0, "deprecated").otherwise("active").alias("status"))
    chunks = t("labels").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("id"))
    names = t("documents").select(F.col("lang").alias("id"), F.col("lang").alias("name")).distinct()
    return listings.documents(docs, chunks, names).select(F.col("id").alias("doc_id"), "filename", F.col("category_name").alias("category"), F.col("chunk_count"))


@query("SELECT n_name AS name, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS document_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def category_filtered_count(t):
    names = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(now()).alias("created_at"))
    docs = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("category_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("deprecated").alias("status"))
    return listings.categories(names, docs).select("name", "document_count")


def _messages(t):
    return t("conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


@query("SELECT conv_id, count(*) AS message_count, substr(arg_max(text, turn), 1, 100) AS last_message FROM conversations GROUP BY conv_id")
def conv_latest_message(t):
    heads = t("conversations").select(F.col("conv_id").alias("id"), F.lit("").alias("title"), F.lit(now()).alias("created_at"), F.lit(now()).alias("updated_at")).distinct()
    return listings.conversations(heads, _messages(t)).select(F.col("id").alias("conv_id"), "message_count", "last_message")


@query("""WITH b AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS size FROM conversations),
s AS (SELECT conv_id, max(back) AS start FROM b WHERE role = 'user' AND back <= 10 AND size <= 1500 GROUP BY conv_id) SELECT b.conv_id, turn FROM b JOIN s ON b.conv_id = s.conv_id WHERE back <= start""")
def conv_history_trim(t):
    own = assembly.trim_history(_messages(t), EngineConfig(history_chars=1500))
    return own.select(F.col("conversation_id").alias("conv_id"), F.col("id").alias("turn"))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, length(coalesce(before || chr(10), '') || text) AS chars FROM c""")
def coref_window(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", F.length(F.concat_ws("\n", F.lag("text").over(w), "text")).cast("long").alias("chars"))


@query("""SELECT event_type AS status, count(*) AS files, count(DISTINCT user_id) AS names, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def ingest_log_rollup(t):
    return t("events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("user_id").alias("names"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS rows FROM events GROUP BY user_id""")
def log_latest_per_id(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type AS query_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def query_log_tumbling(t):
    own = t("events").withColumn("at", F.col("ts").cast("timestamp"))
    return own.groupBy(F.window("at", "1 hour")["start"].cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("query_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT 'documents' AS "table", count(*) AS rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations""")
def table_counts(t):
    every = None
    for name in ("documents", "pages", "conversations"):
        own = t(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        every = own if every is None else every.unionByName(own)
    return every


@query("""SELECT page_id, lower(regexp_extract(url, '[^./]+$')) IN ('html', 'md') AND octet_length(encode(html)) <= 52428800 AS ok, sha256(html) AS content_hash FROM pages""")
def validate_files(t):
    own = t("pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return files.validated(own, EngineConfig(allowed_suffixes=("html", "md"))).select("page_id", F.col("error").isNull().alias("ok"), "content_hash")


@query()
def chunk_pages_markdown(t):
    pages = t("pages").select(F.col("page_id").cast("string").alias("document_id"), files.html_to_markdown("html").alias("markdown"))
    return chunking.chunk_documents(pages)


@query()
def chunk_documents(t):
    return chunking.chunk_documents(t("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("markdown")))


@query(f"SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '{CLOCK}' - INTERVAL 140 DAY")
def ttl_live(t):
    expires = F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.lit(24))
    return t("events").filter(expires > now() - F.expr("INTERVAL 140 DAYS")).select("event_id")
