"""Text operators as columns: names, tokens, chunk types, freshness and the texts that are embedded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions.vectors import _col

# Patterns that decide a chunk's type, with Java's inline flags.
LIST_LINE = r"^\s*([-*+]|\d+[.)]) "
SECTION_REFERENCE = r"(?i)\b(?:Section|Chapter|Part|Schedule|Clause)\s+\d+"
DOT_LEADER = r"\.{3,}"
DEFINITION = (
    r"(?im)(?:^|\n)\s*(?:Explanation[\s.:—\-]|Provided\s+that\b|Proviso[\s.:—\-]|For\s+the\s+purposes?\s+of\s+(?:this|the)\b"
    r"|\"[A-Za-z\s]+\"\s+(?:means?|includes?|shall\s+mean)|hereinafter\s+(?:referred|called)\b)"
)
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
# End of fixed values.


def token_count(text) -> Column:
    """Tokens by the default tokenizer: runs of letters, runs of digits, and single other characters."""
    return F.regexp_count(_col(text), F.lit(TOKEN))


def normalize_name(name) -> Column:
    trimmed = F.regexp_replace(_col(name), r"^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"[.,;:!?]+$", "")


def sentences(text) -> Column:
    return F.split(_col(text), SENTENCE_END)


def pack_sentences(text, max_tokens: int) -> Column:
    """Sentences joined greedily into pieces of at most ``max_tokens`` tokens (one sentence may exceed it)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s, sentence):
        n = token_count(sentence)
        full = s["open"].isNotNull() & (s["n"] + n > max_tokens)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full | s["open"].isNull(), sentence).otherwise(F.concat(s["open"], F.lit(" "), sentence)).alias("open"),
            F.when(full, n).otherwise(s["n"] + n).alias("n"),
        )

    return F.aggregate(sentences(text), start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def trailing_sentences(text, max_tokens) -> Column:
    """The last whole sentences that fit in ``max_tokens`` together."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(s, sentence):
        n = s["n"] + token_count(sentence)
        over = s["over"] | (n > max_tokens)
        return F.struct(
            F.when(over, s["kept"]).when(s["kept"] == "", sentence).otherwise(F.concat(sentence, F.lit(" "), s["kept"])).alias("kept"),
            F.when(over, s["n"]).otherwise(n).alias("n"),
            over.alias("over"),
        )

    return F.aggregate(F.reverse(sentences(text)), start, step, lambda s: s["kept"])


def line_share(text, test) -> Column:
    lines = F.split(_col(text), "\n")
    return F.size(F.filter(lines, test)) / F.greatest(F.size(lines), F.lit(1))


def section_references(text) -> Column:
    return F.regexp_count(_col(text), F.lit(SECTION_REFERENCE))


def chunk_type(content, has_table, has_code, tokens: Column | None = None) -> Column:
    """The first that holds of table, code, heading, index, definition and list, or else paragraph."""
    text = F.regexp_replace(_col(content), r"^\s+|\s+$", "")
    tokens = token_count(text) if tokens is None else tokens
    short_lines = line_share(text, lambda line: F.length(F.trim(line)) < 60)
    is_index = (section_references(text) >= 3) & (text.rlike(DOT_LEADER) | (short_lines > 0.7))
    return (
        F.when(_col(has_table), "TABLE")
        .when(_col(has_code), "CODE")
        .when(text.startswith("#") & (tokens < 20), "HEADING")
        .when(is_index, "INDEX")
        .when(text.rlike(DEFINITION), "DEFINITION")
        .when(line_share(text, lambda line: line.rlike(LIST_LINE)) > 0.5, "LIST")
        .otherwise("PARAGRAPH")
    )


def _days(now, then) -> Column:
    return (F.unix_micros(_col(now)) - F.unix_micros(_col(then))) / F.lit(86_400_000_000.0)


def freshness(ingested_at, now, config: EngineConfig = DEFAULT) -> Column:
    """1 for now, falling to 0 over ``freshness_days``; 4 decimals."""
    return F.round(F.greatest(F.lit(0.0), 1 - _days(now, ingested_at) / config.freshness_days), 4)


def freshness_boost(score, ingested_at, now, config: EngineConfig = DEFAULT) -> Column:
    fresh = F.greatest(F.lit(0.0), 1 - _days(now, ingested_at) / config.freshness_days)
    return _col(score) * F.coalesce(1 + config.freshness_weight * fresh, F.lit(1.0))


def _labelled(label: str, value, sep: str | None = None) -> Column:
    value = _col(value)
    text = value if sep is None else F.array_join(value, sep)
    return F.when(value.isNotNull() & (text != ""), F.concat(F.lit(label), text))


def chunk_embedding_text(content, section_path, summary, keywords, questions) -> Column:
    return F.concat_ws("\n\n", _labelled("Section: ", section_path), _labelled("Summary: ", summary), _labelled("Keywords: ", keywords, ", "), _labelled("Questions: ", questions, " "), _col(content))


def community_embedding_text(names, types, relations, summary) -> Column:
    text = F.concat_ws("\n", _labelled("Entities: ", names, ", "), _labelled("Entity types: ", types, ", "), _labelled("Relationships: ", relations, ", "), _labelled("Summary: ", summary))
    return F.when(F.coalesce(_col(summary), F.lit("")) == "", F.lit("")).otherwise(text)


def search_text(content, summary, questions, keywords) -> Column:
    """What full-text search sees of a chunk."""
    empty = F.lit("")
    return F.concat_ws(" ", _col(content), F.coalesce(_col(summary), empty), F.coalesce(F.array_join(_col(questions), " "), empty), F.coalesce(F.array_join(_col(keywords), " "), empty))
