"""Settings that change results. Every operator takes what it needs from an ``EngineConfig``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    # Defaults that results depend on.
    allowed_suffixes: tuple[str, ...] = ("pdf", "docx", "pptx", "txt", "md", "html")
    max_file_bytes: int = 50 * 1024 * 1024
    chunk_max_tokens: int = 512
    chunk_overlap: float = 0.12
    enumeration_overflow: float = 1.5
    min_tokens: int = 10
    fuzzy_threshold: float = 85.0
    entity_cosine: float = 0.92
    text_dim: int = 512
    part_dim: int = 128
    vector_top_k: int = 20
    lexical_top_k: int = 20
    fused_top_k: int = 10
    rrf_k: int = 60
    excluded_types: tuple[str, ...] = ("HEADING", "INDEX")
    max_hops: int = 2
    graph_top_k: int = 10
    seed_top_k: int = 5
    seed_cosine: float = 0.75
    max_paths: int = 30
    max_degree: int = 15
    rerank_candidates: int = 20
    rerank_chars: int = 4096
    rerank_top: int = 10
    freshness_days: float = 365.0
    freshness_weight: float = 0.05
    context_tokens: int = 2048
    context_chunks: int = 10
    history_messages: int = 10
    history_chars: int = 6000
    cache_cosine: float = 0.95
    cache_hours: int = 24
    max_passes: int = 2
    min_chunks: int = 2
    min_chunks_analytical: int = 3
    min_answer_chars: int = 200
    community_resolution: float = 1.0
    community_min_size: int = 2
    sage_dims: tuple[int, int, int] = (256, 128, 128)
    sage_neighbours: int = 25
    train_epochs: int = 200
    learning_rate: float = 0.01
    negatives: int = 5
    margin: float = 1.0
    seed: int = 42

    @classmethod
    def from_session(cls, spark) -> EngineConfig:
        """The defaults with what the session sets as ``quillgraph.<name>``; lists are comma-separated."""
        own = cls()
        for f in fields(cls):
            value = spark.conf.get(f"quillgraph.{f.name}", None)
            if value is not None:
                default = getattr(own, f.name)
                kind = type(default[0]) if isinstance(default, tuple) else type(default)
                own = replace(own, **{f.name: tuple(map(kind, value.split(","))) if isinstance(default, tuple) else kind(value)})
        return own


DEFAULT = EngineConfig()
