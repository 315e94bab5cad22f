"""Row types of the engine's tables, as Spark DDL."""

METADATA = (
    "struct<summary:string,keywords:array<string>,hypothetical_questions:array<string>,"
    "entities:struct<people:array<string>,organizations:array<string>,dates:array<string>,money:array<string>>,"
    "chunk_type:string,freshness_score:double,document_id:string,section_path:string,version:int,"
    "content_hash:string,ingested_at:timestamp,enriched_at:timestamp>"
)

TABLES = {
    "documents": "id string, filename string, content_hash string, version int, status string, page_count int, full_markdown string, ingested_at timestamp, deprecated_at timestamp, metadata map<string,string>, category_id string",
    "chunks": f"id string, document_id string, chunk_index int, content string, token_count int, section_path string, has_table boolean, has_code boolean, overlap_tokens int, content_hash string, metadata {METADATA}",
    "postings": "chunk_id string, lexeme string, positions array<int>",
    "ingestion_logs": "id string, seq bigint, filename string, status string, step string, error string, attempt int, at timestamp, timings map<string,double>",
    "chunk_embeddings": "chunk_id string, embedding array<float>, hybrid array<float>",
    "entity_embeddings": "name string, type string, structural array<float>, text array<float>, transe array<float>",
    "relation_embeddings": "relation_type string, embedding array<float>",
    "community_embeddings": "community_id int, embedding array<float>",
    "semantic_cache": "id string, query string, embedding array<float>, result_json string, expires_at timestamp, scope_key string",
    "query_logs": "id string, query string, query_type string, chunks int, cached boolean, total_ms double, created_at timestamp",
    "conversations": "id string, title string, created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, created_at timestamp",
    "categories": "id string, name string, created_at timestamp",
    "agents": "id string, name string, description string, system_prompt string, created_at timestamp",
    "agent_categories": "agent_id string, category_id string",
    "entities": "name string, type string, source_document_ids array<string>, source_chunk_index int, confidence double, properties map<string,string>, status string, community_id int",
    "relationships": "edge_id string, src_name string, src_type string, dst_name string, dst_type string, rel_type string, source_document_id string, source_chunk_index int, confidence double, properties map<string,string>",
    "communities": "community_id int, summary string, entity_count int, entity_names array<string>, entity_types array<string>, relationship_types array<string>",
    "model_params": "model string, param string, row int, value array<double>",
}

KEYS = {
    "documents": ("id",),
    "chunks": ("id",),
    "chunk_embeddings": ("chunk_id",),
    "entity_embeddings": ("name", "type"),
    "relation_embeddings": ("relation_type",),
    "community_embeddings": ("community_id",),
    "semantic_cache": ("id",),
    "conversations": ("id",),
    "messages": ("id",),
    "categories": ("id",),
    "agents": ("id",),
    "agent_categories": ("agent_id", "category_id"),
    "entities": ("name", "type"),
    "relationships": ("edge_id",),
    "communities": ("community_id",),
    "model_params": ("model", "param", "row"),
}

#: Columns by which rows are dealt to buckets. Those of KEYS are unique, too.
PLACED = KEYS | {"postings": ("chunk_id",)}

#: Values that a column may have; rows with others are refused on write.
ALLOWED = {
    ("documents", "status"): ("active", "deprecated"),
    ("ingestion_logs", "status"): ("pending", "processing", "completed", "failed", "skipped"),
    ("messages", "role"): ("user", "assistant", "system"),
}
