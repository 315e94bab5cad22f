"""Secret scans by grammar inference.

One pass over the texts finds the base spans (fixed patterns) and all other tokens that could be credentials: runs of
MIN_TOKEN or more characters of their alphabet. The base spans are labelled credentials: from a bounded sample for each
kind (SAMPLE distinct values, first by hash) ALERGIA infers a probabilistic automaton. It builds the prefix tree of
the values, as words over character classes, and merges states whose frequencies of ending and of each next class
differ by no more than a Hoeffding bound, their successors included. A sample of the other tokens that have no
digit gives the automaton of ordinary text (those with digits may be credentials without a label). Every token outside the base spans is then scored by its log-likelihood per
symbol, its end included, under the kinds' automata less that under ordinary text; THRESHOLD or more adds a span of kind `format`.

Texts are read once; what is gathered from them (spans and tokens) is small and goes with the corpus.

Offsets are code points, ends exclusive. Defined cases: a null text is empty and has no spans; without labelled values
nothing is added; equal rows give equal rows; a null doc_id is carried through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm import common

# Fixed patterns and least lengths of the base kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of the class is one match, so the least length can stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

MIN_TOKEN = 12
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
SAMPLE = 400
ALPHA = 0.05
LEAST_COUNT = 12
THRESHOLD = 0.6

_CLASS = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "f"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "z"), **dict.fromkeys("ABCDEF", "F"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "Z")}
_SIZE = {c: list(_CLASS.values()).count(c) for c in set(_CLASS.values())}
#: The classes and the single marks of a token's alphabet, and the end of a word.
SYMBOLS = len(_SIZE) + len("+/_.=-") + 1


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) in order of start, then kind."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def free_tokens(text: str, own: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Tokens that no base span reaches into; both lists are in order of start and are swept once."""
    found, k, reach = [], 0, -1
    for m in TOKEN.finditer(text):
        while k < len(own) and own[k][0] < m.end():
            reach, k = max(reach, own[k][1]), k + 1
        if reach <= m.start():
            found.append((m.start(), m.end()))
    return found


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("tokens", pa.list_(_SPAN))])
_FOUND_SQL = "doc_id bigint, spans array<struct<start:int,end:int,kind:string,value:string>>, tokens array<struct<start:int,end:int,kind:string,value:string>>"


def _scan(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            spans, tokens = [], []
            for text in part.column(1).to_pylist():
                own = base_spans(text or "")
                spans.append([{"start": s, "end": e, "kind": k, "value": text[v:e]} for s, e, k, v in own])
                tokens.append([{"start": s, "end": e, "kind": "format", "value": text[s:e]} for s, e in free_tokens(text or "", own)])
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "spans": spans, "tokens": tokens}, schema=_FOUND)


class Automaton:
    """A probabilistic automaton over character classes, inferred from words by state merging."""

    def __init__(self, words: list[str]):
        self.count, self.final, self.next = [0], [0], [{}]
        for word in sorted(words):
            state = 0
            self.count[0] += 1
            for c in word:
                symbol = _CLASS.get(c, c)
                if symbol not in self.next[state]:
                    self.next[state][symbol] = [len(self.count), 0]
                    self.count.append(0)
                    self.final.append(0)
                    self.next.append({})
                edge = self.next[state][symbol]
                edge[1] += 1
                state = edge[0]
                self.count[state] += 1
            self.final[state] += 1
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.count[a], self.count[b]
            if min(n1, n2) < LEAST_COUNT or a == b:
                continue
            if self._differ(self.final[a], n1, self.final[b], n2):
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(symbol, (None, 0)), self.next[b].get(symbol, (None, 0))
                if self._differ(x[1], n1, y[1], n2):
                    return False
                if x[0] is not None and y[0] is not None:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Take the tree below ``b`` into ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for symbol, (child, n) in self.next[b].items():
                if symbol in self.next[a]:
                    self.next[a][symbol][1] += n
                    todo.append((self.next[a][symbol][0], child))
                else:
                    self.next[a][symbol] = [child, n]

    def _infer(self) -> None:
        kept = [0]
        while True:
            edge = next(((r, s) for r in kept for s, (child, _) in sorted(self.next[r].items()) if child not in kept), None)
            if edge is None:
                break
            child = self.next[edge[0]][edge[1]][0]
            like = next((r for r in kept if self._compatible(r, child)), None)
            if like is None:
                kept.append(child)
            else:
                self.next[edge[0]][edge[1]][0] = like
                self._fold(like, child)
        place = {s: i for i, s in enumerate(kept)}
        self.states = [({s: (place[c], n) for s, (c, n) in self.next[k].items()}, self.final[k], self.count[k]) for k in kept]
        del self.count, self.final, self.next

    def score(self, word: str) -> float:
        """Log-likelihood of the word, its end included, per symbol.

        A state gives each class and the end half a count more than it has seen. A class that it hasn't seen leads to
        a state without counts, where all are alike.
        """
        state, total = 0, 0.0
        for c in [*word, None]:
            symbol = _CLASS.get(c, c)
            edges, final, n = self.states[state] if state is not None else ({}, 0, 0)
            state, seen = edges.get(symbol, (None, 0)) if c is not None else (state, final)
            total += math.log((seen + 0.5) / (n + 0.5 * SYMBOLS) / _SIZE.get(symbol, 1))
        return total / (len(word) + 1)


def learn(found: DataFrame) -> tuple[list[Automaton], Automaton | None]:
    """Automata of the labelled kinds and of other tokens, from at most SAMPLE values of each."""
    values = found.select(F.explode(F.concat("spans", "tokens")).alias("s")).select("s.kind", "s.value").filter("kind <> 'format' or not value rlike '[0-9]'").distinct()
    sample = common.first_by_hash(values, "kind", "value", SAMPLE).select("kind", "value").collect()  # SAMPLE rows a kind at most
    words: dict[str, list[str]] = defaultdict(list)
    for r in sample:
        words[r["kind"]].append(r["value"])
    return [Automaton(words[k]) for k in KINDS if words[k]], Automaton(words["format"]) if words["format"] else None


def score(value: str, kinds: list[Automaton], other: Automaton | None) -> float:
    if not kinds or other is None:
        return -math.inf
    return max(k.score(value) for k in kinds) - other.score(value)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, added): arrays of (start, end, kind, value) of the base and of those the automata add."""
    found = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _FOUND_SQL))
    kinds, other = learn(found)
    marked = found.select("doc_id", "spans", F.posexplode_outer("tokens").alias("i", "token")).filter("token is not null").select(F.col("token.value").alias("value")).distinct()

    @F.pandas_udf(T.BooleanType())
    def like_secret(value: pd.Series) -> pd.Series:
        return value.map(lambda v: score(v, kinds, other) >= THRESHOLD).astype(bool)

    secret = marked.filter(like_secret("value"))
    rows = found.withColumn("row", F.monotonically_increasing_id())
    rows = common.cut(rows)
    hits = rows.select("row", F.explode("tokens").alias("token")).join(secret, F.col("token.value") == F.col("value"), "left_semi").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("added"))
    return rows.join(hits, "row", "left").select("doc_id", "spans", F.coalesce("added", F.slice("spans", 1, 0)).alias("added"))


def digest(scanned: DataFrame) -> DataFrame:
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    # A base span never starts where an added one does, for these don't overlap.
    every = F.array_sort(F.concat("spans", "added"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(_turn(a) - _turn(b)))
    return scanned.select("doc_id", *[count(k) for k in KINDS], common.sha256_text(text(F.col("spans"))).alias("base_sha256"), text(every).alias("spans"))


def _turn(span):
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "format")]), span["kind"]).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(common.table(spark, sf_dir, "documents")))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()
