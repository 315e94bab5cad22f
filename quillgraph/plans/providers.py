"""What an external model would do, as plain functions with deterministic local defaults.

A provider is any object with the same attributes; each is called inside Arrow functions or on the driver as said.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import coreference
from quillgraph.functions.stemming import STOP_WORDS, stem
from quillgraph.sources.files import page_markdown
from quillgraph.sources.office import READERS

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_NAME = re.compile(r"\b[A-Z][\w-]+(?:\s+[A-Z][\w-]+)*")


def hash_vector(text: str, dim: int) -> list[float]:
    """Signed feature hashing of stems, scaled to length one."""
    import zlib

    out = np.zeros(dim)
    for word, n in Counter(stem(w) for w in _WORD.findall((text or "").lower()) if w not in STOP_WORDS).items():
        h = zlib.crc32(word.encode())
        out[h % dim] += (1 if h >> 31 else -1) * n
    return (out / (np.linalg.norm(out) or 1.0)).tolist()


def hashed_embedding(text, dim: int) -> Column:
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: hash_vector(t, dim))

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(F.col(text) if isinstance(text, str) else text)


def parse_file(path: str, content: bytes) -> list[str]:
    """Pages of a text, markdown, HTML, PDF, DOCX or PPTX file; scans need a provider of their own."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("txt", "md"):
        return content.decode("utf-8", "replace").split("\f")
    if suffix == "html":
        return [page_markdown(content.decode("utf-8", "replace"))]
    if suffix in READERS:
        return READERS[suffix](content)
    raise ValueError(f"no parser for .{suffix}")


def keywords(text: str, n: int = 5) -> list[str]:
    words = Counter(w for w in _WORD.findall(text.lower()) if w not in STOP_WORDS and len(w) > 2 and not w.isdigit())
    return [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:n]]


def enrich(content: str) -> dict:
    """Summary, keywords, questions and entities taken from the text itself."""
    names = list(dict.fromkeys(_NAME.findall(content)))
    words = keywords(content)
    return {
        "summary": " ".join(_SENTENCE.split(content.strip())[:2]),
        "keywords": words,
        "hypothetical_questions": [f"What is said about {w}?" for w in words[:3]],
        "entities": {"people": [], "organizations": names[:10], "dates": re.findall(r"\b\d{4}-\d{2}-\d{2}\b", content), "money": re.findall(r"[$€£]\s?\d[\d.,]*", content)},
    }


def extract_graph(content: str) -> dict:
    """Names as entities, and names of one sentence as related."""
    entities, relationships = {}, []
    for sentence in _SENTENCE.split(content):
        names = [n for n in dict.fromkeys(_NAME.findall(sentence)) if n.lower() not in STOP_WORDS]
        for n in names:
            entities.setdefault(n, {"name": n, "type": "Name", "confidence": 0.5})
        relationships += [{"source": a, "target": b, "type": "MENTIONED_WITH", "confidence": 0.5} for a, b in zip(names, names[1:])]
    return {"entities": list(entities.values()), "relationships": relationships}


def answer(query: str, context: str, calculation: str | None, history: list[dict], prompt: str | None) -> str:
    """The context's sentences that share most stems with the query, with their chunks' marks."""
    wanted = {stem(w) for w in _WORD.findall(query.lower()) if w not in STOP_WORDS}
    scored = []
    for entry in context.split("\n\n") if context else []:
        mark, _, body = entry.partition("\n")
        for pos, sentence in enumerate(_SENTENCE.split(body or mark)):
            score = len(wanted & {stem(w) for w in _WORD.findall(sentence.lower())})
            if score:
                scored.append((-score, len(scored), f"{sentence.strip()} {mark.split(' ')[0] if mark.startswith('[') else ''}".strip()))
    if not scored and calculation is None:
        return "I could not find relevant information."
    return "\n".join([calculation] * (calculation is not None) + [s for *_, s in sorted(scored)[:5]])


def numbers_and_operation(query: str, texts: list[str]) -> tuple[str, list[float]]:
    words = {"average": "mean", "mean": "mean", "difference": "difference", "ratio": "ratio", "percentage": "percentage_change"}
    operation = next((o for w, o in words.items() if w in query.lower()), "sum")
    source = [query] if re.search(r"\d", query) else texts
    return operation, [float(x) for t in source for x in re.findall(r"(?<![\w.])-?\d+(?:\.\d+)?", t)]


def retried(work: Callable, *args, attempts: int = 3, pause: float = 0.5):
    """Call ``work`` up to ``attempts`` times, with pauses that double."""
    for turn in range(attempts):
        try:
            return work(*args)
        except Exception:
            if turn + 1 == attempts:
                raise
            time.sleep(pause * 2**turn)


@dataclass
class Providers:
    """Replace any of these by calls to a model. ``None`` leaves a step out, as where the model isn't installed."""

    parse: Callable[[str, bytes], list[str]] = parse_file
    embed: Callable[[str | Column, int], Column] = hashed_embedding
    embed_query: Callable[[str, int], list[float]] = hash_vector
    enrich: Callable[[str], dict] = enrich
    extract: Callable[[str], dict] = extract_graph
    answer: Callable = answer
    numbers: Callable[[str, list[str]], tuple[str, list[float]]] = numbers_and_operation
    classify: Callable[[str], dict] | None = None
    hyde: Callable[[str], str] | None = None
    conflicts: Callable[[str, list[dict]], list[tuple[str, str]]] | None = None
    relevance: Callable | None = None
    coref: Callable[[str, str], list[tuple[int, int, str]]] | None = coreference.replacements
    transcribe: Callable[[bytes], str] | None = None
    summarise_community: Callable[[list[str], list[str]], str] = field(default=lambda names, kinds: f"{', '.join(names[:5])} ({', '.join(kinds)}).")
