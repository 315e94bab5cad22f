"""Row-wise decisions of query understanding and answer assembly, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig
from quillgraph.functions.vectors import _col

# Patterns and phrases that decide how a query is handled.
CALCULATION = r"(?i)\b(calculate|sum|average|total|mean|percentage|ratio|difference)\b.*\d"
ANALYTICAL = (
    r"(?i)\b(all\s+(?:the\s+)?(?:remedies|provisions|conditions|obligations|rights|penalties|exceptions)"
    r"|what\s+(?:would|could|should)\s+(?:be|happen)\s+(?:different|if)|under\s+what\s+conditions|compare|contrast|distinguish"
    r"|proviso\s+(?:says|states|provides)|how\s+do\s+(?:these|they|the\s+\w+)\s+interact|exhaustive|comprehensive\s+list"
    r"|contradiction|conflict\s+between|what\s+are\s+(?:the\s+)?(?:promoter'?s?|buyer'?s?|authority'?s?)\s+obligations"
    r"|obligations?\s+(?:regarding|concerning|related\s+to|under))\b"
)
GRAPH = r"(?i)\b(relationship|connected|relate[sd]?\s+to|link(?:ed|s)?\s+(?:to|with)|how does .+ (?:affect|impact|influence))\b"
CONFLICT = r"(?i)\b(contradict[s]?|conflicting?|proviso\s+says|but\s+the\s+same\s+section|reconcil[e]|apparent\s+tension|inconsisten[ct]|notwithstanding|contrary\s+to)\b"
DECLINE_PHRASES = ("could not find", "no relevant information", "unable to find", "insufficient context", "failed to generate", "an error occurred")
COVERAGE_PHRASES = ("insufficient", "could not find", "no relevant information", "unable to locate", "not enough context", "failed to generate")
OPERATIONS = ("sum", "mean", "difference", "ratio", "percentage_change", "min", "max", "count")
# End of fixed values.


def heuristic_type(query) -> Column:
    """The query's type where a pattern decides it, else null."""
    q = _col(query)
    return F.when(q.rlike(CALCULATION) | q.rlike(ANALYTICAL), "ANALYTICAL").when(q.rlike(GRAPH) | q.rlike(CONFLICT), "GRAPH")


def execution_plan(query, model_type=None) -> Column:
    """Type and activated steps; ``model_type`` is what a classifier model says where no pattern decides."""
    q = _col(query)
    said = F.upper(_col(model_type)) if model_type is not None else F.lit(None).cast("string")
    kind = F.coalesce(heuristic_type(q), F.when(said.isin("SIMPLE", "GRAPH", "ANALYTICAL"), said), F.lit("SIMPLE"))
    return F.struct(
        kind.alias("query_type"),
        F.lit(True).alias("activate_vector"),
        (kind.isin("GRAPH", "ANALYTICAL") | q.rlike(CONFLICT)).alias("activate_graph"),
        q.rlike(CALCULATION).alias("activate_calculator"),
        F.lit(True).alias("activate_conflict"),
    )


def _says(answer, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.lower(_col(answer)).contains(phrase)
    return found


def cacheable(answer, n_chunks, error, skipped) -> Column:
    no_error = F.coalesce(_col(error), F.lit("")) == ""
    return (_col(n_chunks) > 0) & no_error & ~F.coalesce(_col(skipped), F.lit(False)) & ~_says(answer, DECLINE_PHRASES)


def needs_another_pass(answer, n_chunks, query_type, pass_count, config: EngineConfig = DEFAULT) -> Column:
    kind = _col(query_type)
    least = F.when(kind == "ANALYTICAL", config.min_chunks_analytical).otherwise(config.min_chunks)
    short = kind.isin("GRAPH", "ANALYTICAL") & (F.length(_col(answer)) < config.min_answer_chars)
    return (_col(pass_count) < config.max_passes) & (_says(answer, COVERAGE_PHRASES) | (_col(n_chunks) < least) | F.coalesce(short, F.lit(False)))


def calculate(operation, numbers) -> Column:
    """The operation's result to 4 decimals; null without numbers or for an unknown operation."""
    n, op = _col(numbers), _col(operation)
    one, two = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
    pair = F.size(n) >= 2
    results = {
        "sum": total,
        "mean": total / F.nullif(F.size(n), F.lit(0)),
        "difference": F.when(pair, one - two).otherwise(0.0),
        "ratio": F.when(pair & (two != 0), one / F.nullif(two, F.lit(0.0))).otherwise(0.0),
        "percentage_change": F.when(pair & (one != 0), (two - one) / F.nullif(one, F.lit(0.0)) * 100).otherwise(0.0),
        "min": F.array_min(n),
        "max": F.array_max(n),
        "count": F.size(n).cast("double"),
    }
    chosen = F.lit(None).cast("double")
    for name in OPERATIONS:
        chosen = F.when(op == name, results[name]).otherwise(chosen)
    return F.when(n.isNotNull() & (F.size(n) > 0), F.round(chosen, 4))


def conflict_winner(a: str, b: str) -> Column:
    """(winner 'a' or 'b', rule) for two chunk structs; newer version, then ingestion, then a table, then score."""
    va, vb = F.col(f"{a}.version"), F.col(f"{b}.version")
    ta, tb = F.col(f"{a}.ingested_at"), F.col(f"{b}.ingested_at")
    ha, hb = (F.coalesce(F.col(f"{x}.has_table"), F.lit(False)) for x in (a, b))
    dated = (F.coalesce(ta, F.lit("")) != "") & (F.coalesce(tb, F.lit("")) != "") & (ta != tb)

    def pick(first, rule):
        return F.struct(F.when(first, "a").otherwise("b").alias("winner"), F.lit(rule).alias("rule"))

    return (
        F.when(va != vb, pick(va > vb, "version"))
        .when(dated, pick(ta > tb, "ingestion date"))
        .when(ha != hb, pick(ha, "table"))
        .otherwise(pick(F.col(f"{a}.score") >= F.col(f"{b}.score"), "score"))
    )
