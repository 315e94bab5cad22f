"""Files as rows: validation, hashes and parsing to markdown pages."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.config import DEFAULT, EngineConfig


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, content, modificationTime) of files in any store."""
    return spark.read.format("binaryFile").load(paths)


def validated(files: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``files`` with suffix, content_hash and ``error``, which is null for a file that may be parsed."""
    suffix = F.lower(F.regexp_extract("path", r"[^./]+$", 0))
    error = (
        F.when(~suffix.isin(*config.allowed_suffixes), F.concat(F.lit("unsupported file type: "), suffix))
        .when(F.col("length") > config.max_file_bytes, F.lit("file too large"))
    )
    return files.withColumn("suffix", suffix).withColumn("error", error).withColumn("content_hash", F.sha2("content", 256))


class _Markdown(HTMLParser):
    """The readable part of a page as markdown."""

    # Elements without content of their own, and those that end a block.
    HIDDEN = frozenset("script style nav footer header aside noscript template title head".split())
    BLOCK = frozenset("p div section article main ul ol table tr li pre blockquote br h1 h2 h3 h4 h5 h6".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text, self.mark, self.hidden, self.fenced = "", "", 0, False
        self.row: list[str] | None = None
        self.rows = 0

    def flush(self):
        text = self.text if self.fenced else " ".join(self.text.split())
        if text.strip():
            self.blocks.append(f"```\n{text.strip(chr(10))}\n```" if self.fenced else self.mark + text)
        self.text, self.mark = "", ""

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN and tag != "head":
            self.hidden += 1
        if tag in self.BLOCK and self.row is None:
            self.flush()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.mark = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.mark = "- "
        elif tag == "pre":
            self.fenced = True
        elif tag == "table":
            self.rows = 0
        elif tag == "tr":
            self.row, self.text = [], ""

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and tag != "head":
            self.hidden = max(0, self.hidden - 1)
        if tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join(self.text.split()))
            self.text = ""
        elif tag == "tr" and self.row is not None:
            line = "| " + " | ".join(self.row) + " |"
            if self.rows:
                self.blocks[-1] += "\n" + line
            else:
                self.blocks.append(line + "\n|" + "---|" * len(self.row))
            self.rows, self.row = self.rows + 1, None
        elif tag in self.BLOCK and self.row is None:
            self.flush()
        if tag == "pre":
            self.fenced = False

    def handle_data(self, data):
        if not self.hidden:
            self.text += data


def page_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


#: Files whose texts a task holds as Python objects at once; the rest of a batch stays in Arrow's memory.
ROWS = 64


def _sliced(work: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What ``work`` makes of lists of the columns' values, by slices of ROWS rows."""
    parts = [pa.array(work(*(c.slice(at, ROWS).to_pylist() for c in columns)), kind) for at in range(0, len(columns[0]), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def html_to_markdown(html) -> Column:
    def run(column: pa.Array) -> pa.Array:
        return _sliced(lambda own: [page_markdown(h or "") for h in own], pa.string(), column)

    return F.arrow_udf(run, T.StringType())(F.col(html) if isinstance(html, str) else html)


def parsed(files: DataFrame, parse: Callable[[str, bytes], list[str]]) -> DataFrame:
    """Valid ``files`` with ``pages`` and ``full_markdown`` (pages joined by a blank line); a failure goes to ``error``."""

    def told(paths: list, contents: list, errors: list) -> list[dict]:
        out = []
        for p, c, e in zip(paths, contents, errors, strict=True):
            pages = None
            if e is None:
                try:
                    pages = list(parse(p, c))
                except Exception as problem:  # a file that can't be parsed must not stop the others
                    e = f"parse: {problem}"
            out.append({"pages": pages, "error": e})
        return out

    kind = pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string())])

    def run(path: pa.Array, content: pa.Array, error: pa.Array) -> pa.Array:
        return _sliced(told, kind, path, content, error)

    result = F.arrow_udf(run, T.StructType([T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
    own = files.withColumn("__parsed", result("path", "content", "error"))
    return own.withColumn("pages", F.col("__parsed.pages")).withColumn("error", F.col("__parsed.error")).drop("__parsed").withColumn("full_markdown", F.array_join("pages", "\n\n")).withColumn("page_count", F.size("pages"))
