"""Markdown to structure-aware chunks: one Arrow function from a document to its chunks.

Chunks follow from a left-to-right pass (a chunk's overlap depends on that of the one before), so a document is one
unit of work; documents are independent, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT, EngineConfig

# What marks headings, fences, table rows, sub-clauses, sentence ends and tokens.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
FENCE = re.compile(r"^```")
TABLE_ROW = re.compile(r"^\|.*\|")
SUB_CLAUSE = re.compile(r"^\s*(?:\([a-z]\)|\([ivx]+\)|\([A-Z]\))")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
# End of fixed values.
PATH = " > "
GAP = "\n\n"


def count_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def blocks(markdown: str) -> Iterator[tuple[str, str]]:
    """(kind, text) with kinds HEADING, TABLE, CODE and PARAGRAPH; an open fence runs to the end."""
    fenced, fence_no, labelled = False, 0, []
    for number, line in enumerate(markdown.split("\n")):
        if fenced:
            labelled.append((("CODE", fence_no), line))
            fenced = not FENCE.match(line)
        elif HEADING.match(line):
            labelled.append((("HEADING", number), line))
        elif FENCE.match(line):
            fenced, fence_no = True, number
            labelled.append((("CODE", number), line))
        elif TABLE_ROW.match(line):
            labelled.append((("TABLE", 0), line))
        else:
            labelled.append((("PARAGRAPH", 0) if line.strip() else None, line))
    for label, run in groupby(labelled, key=lambda x: x[0]):
        if label:
            yield label[0], "\n".join(line for _, line in run)


def pack(sentences: list[str], most: int, count: Callable[[str], int]) -> list[str]:
    """Greedy joins of sentences up to ``most`` tokens."""
    pieces: list[list[str]] = []
    room = 0
    for sentence in sentences:
        need = count(sentence)
        if not pieces or need > room:
            pieces.append([])
            room = most
        pieces[-1].append(sentence)
        room -= need
    return [" ".join(p) for p in pieces]


class _Draft:
    """Chunks of one document as they grow."""

    def __init__(self, config: EngineConfig, count: Callable[[str], int]):
        self.config, self.count = config, count
        self.done: list[dict] = []
        self.trail: list[tuple[int, str]] = []
        self._open()

    def _open(self) -> None:
        self.parts: list[str] = []
        self.tokens, self.body, self.listing = 0, False, False
        self.kinds: set[str] = set()

    def close(self) -> None:
        if self.parts:
            content = GAP.join(self.parts)
            self.done.append({"content": content, "token_count": self.count(content), "section_path": PATH.join(t for _, t in self.trail), "has_table": "TABLE" in self.kinds, "has_code": "CODE" in self.kinds, "overlap_tokens": 0})
        self._open()

    def put(self, kind: str, text: str, tokens: int) -> None:
        self.parts.append(text)
        self.tokens += tokens
        self.body = self.body or kind != "HEADING"
        self.kinds.add(kind)

    def heading(self, text: str, tokens: int) -> None:
        if self.body:
            self.close()
        marks, title = HEADING.match(text).groups()
        self.trail = [(level, t) for level, t in self._above(len(marks))] + [(len(marks), title.strip())]
        self.put("HEADING", text, tokens)

    def _above(self, level: int) -> list[tuple[int, str]]:
        kept = list(self.trail)
        while kept and kept[-1][0] >= level:
            kept.pop()
        return kept

    def whole(self, kind: str, text: str, tokens: int) -> None:
        """Tables and code are never split."""
        most = self.config.chunk_max_tokens
        if self.parts and self.tokens + tokens > most:
            self.close()
        alone = not self.parts and tokens > most
        self.put(kind, text, tokens)
        if alone:
            self.close()

    def paragraph(self, text: str, tokens: int) -> None:
        most, clause = self.config.chunk_max_tokens, bool(SUB_CLAUSE.match(text.lstrip()))
        if tokens > most and not clause:
            self.close()
            for piece in pack(SENTENCE_GAP.split(text), most, self.count):
                self.put("PARAGRAPH", piece, self.count(piece))
                self.close()
            return
        listing = self.listing
        limit = int(most * self.config.enumeration_overflow) if listing or clause else most
        if self.tokens + tokens > limit and not (listing and clause):
            self.close()
        self.put("PARAGRAPH", text, tokens)
        self.listing = clause

    def finish(self) -> list[dict]:
        self.close()
        if len(self.done) > 1 and all(HEADING.match(line) or not line.strip() for line in self.done[-1]["content"].split("\n")):
            tail = self.done.pop()
            content = GAP.join([self.done[-1]["content"], tail["content"]])
            self.done[-1] |= {"content": content, "token_count": self.count(content), "section_path": tail["section_path"]}
        return self.done


def _siblings(a: str, b: str) -> bool:
    return PATH in a and PATH in b and a.rpartition(PATH)[0] == b.rpartition(PATH)[0]


def last_sentences(text: str, most: int, count: Callable[[str], int]) -> str:
    kept: list[str] = []
    for sentence in reversed(SENTENCE_GAP.split(text)):
        most -= count(sentence)
        if most < 0:
            break
        kept.append(sentence)
    return " ".join(reversed(kept))


def chunk_markdown(markdown: str, config: EngineConfig = DEFAULT, count: Callable[[str], int] = count_tokens) -> list[dict]:
    draft = _Draft(config, count)
    for kind, text in blocks(markdown):
        add = {"HEADING": draft.heading, "PARAGRAPH": draft.paragraph}.get(kind) or (lambda t, n, kind=kind: draft.whole(kind, t, n))
        add(text, count(text))
    chunks = draft.finish()
    for before, chunk in zip(chunks, chunks[1:]):
        share = config.chunk_overlap * (2 if _siblings(before["section_path"], chunk["section_path"]) else 1)
        most = int(before["token_count"] * share)
        shared = last_sentences(before["content"], most, count) if most > 0 else ""
        if shared:
            n = count(shared)
            chunk |= {"content": GAP.join([shared, chunk["content"]]), "token_count": chunk["token_count"] + n, "overlap_tokens": n}
    for index, chunk in enumerate(chunks):
        chunk |= {"chunk_index": index, "content_hash": hashlib.sha256(chunk["content"].encode()).hexdigest()}
    return chunks


_FIELDS = [("document_id", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("token_count", pa.int32()), ("section_path", pa.string()), ("has_table", pa.bool_()), ("has_code", pa.bool_()), ("overlap_tokens", pa.int32()), ("content_hash", pa.string())]


def chunk_documents(documents: DataFrame, config: EngineConfig = DEFAULT, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of (document_id, markdown) rows, with a deterministic ``id``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [{"document_id": d, **c} for d, t in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist(), strict=True) for c in chunk_markdown(t or "", config, count)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS))

    made = documents.select(F.col("document_id").cast("string"), "markdown").mapInArrow(run, "document_id string, chunk_index int, content string, token_count int, section_path string, has_table boolean, has_code boolean, overlap_tokens int, content_hash string")
    return made.withColumn("id", F.sha2(F.concat_ws("|", "document_id", "chunk_index", "content_hash"), 256))


def changed_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """(document_id, chunk_index, is_new) of chunks that are new or whose hash differs from the one of the same index."""
    before = old.select("document_id", "chunk_index", F.col("content_hash").alias("__old"), F.lit(True).alias("__known"))
    both = new.select("document_id", "chunk_index", "content_hash").join(before, ["document_id", "chunk_index"], "left")
    return both.filter(~F.col("content_hash").eqNullSafe(F.col("__old"))).select("document_id", "chunk_index", F.col("__known").isNull().alias("is_new"))
