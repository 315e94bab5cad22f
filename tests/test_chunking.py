from dataclasses import replace

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.config import DEFAULT
from quillgraph.operators import chunking as ck

WORDS = " ".join(f"Word{i} follows here." for i in range(70))
MANUAL = f"""# HR Policy Manual

## Overview

{WORDS}

## California

### Parental Leave

| Benefit | Weeks |
|---|---|
| Maternity Leave | 12 |
| Paternity Leave | 8 |
| Adoption | 8 |
| Foster Care | 4 |

### Sick Leave

Five days a year. More on request.

## Engineering Standards

### Code Review Process

```python
class ReviewChecklist:

    pass
```

## Conclusion

That is all."""


def test_blocks():
    kinds = [k for k, _ in ck.blocks(MANUAL)]
    assert set(kinds) == {"HEADING", "TABLE", "CODE", "PARAGRAPH"} and kinds.count("TABLE") == kinds.count("CODE") == 1
    assert next(ck.blocks(MANUAL)) == ("HEADING", "# HR Policy Manual")
    assert list(ck.blocks("```\nopen\n# not a heading")) == [("CODE", "```\nopen\n# not a heading")]
    assert list(ck.blocks("a\nb\n\nc\n|x|y|\nd")) == [("PARAGRAPH", "a\nb"), ("PARAGRAPH", "c"), ("TABLE", "|x|y|"), ("PARAGRAPH", "d")]
    assert list(ck.blocks("```a```\nx\n```\ny")) == [("CODE", "```a```\nx\n```"), ("PARAGRAPH", "y")]


def test_manual():
    chunks = ck.chunk_markdown(MANUAL)
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    table = [c for c in chunks if c["has_table"]]
    assert "Maternity Leave" in table[0]["content"] and "Foster Care" in table[0]["content"]
    code = [c for c in chunks if c["has_code"]]
    assert code[0]["content"].count("```") == 2
    assert all("California" in c["section_path"] for c in chunks if "Parental Leave" in c["section_path"])
    assert any(c["overlap_tokens"] > 0 for c in chunks)
    assert all(len(c["content_hash"]) == 64 for c in chunks)


def test_same_content_same_hash():
    a, b = (ck.chunk_markdown("# Test\nSame content here.") for _ in range(2))
    assert a[0]["content_hash"] == b[0]["content_hash"]


def test_long_paragraph_and_clauses():
    small = replace(DEFAULT, chunk_max_tokens=20, chunk_overlap=0.0)
    pieces = ck.chunk_markdown(WORDS, small)
    assert all(c["token_count"] <= 20 for c in pieces) and " ".join(c["content"] for c in pieces) == WORDS
    clauses = "\n\n".join(f"({x}) a clause of six or so words" for x in "abcdefgh")
    assert len(ck.chunk_markdown(clauses, small)) == 1
    solid = ck.chunk_markdown("Intro text.\n\n" + "\n".join("| a b c d e | f g |" for _ in range(9)) + "\n\nAfter.", small)
    assert [c["has_table"] for c in solid] == [False, True, False]


def test_trailing_heading_joins_the_chunk_before():
    chunks = ck.chunk_markdown("# A\n\nbody\n\n## B\n\n### C")
    assert len(chunks) == 1 and chunks[0]["section_path"] == "A > B > C" and chunks[0]["content"].endswith("## B\n\n### C")


def test_overlap():
    config = replace(DEFAULT, chunk_overlap=0.5)
    first, second = ck.chunk_markdown("# A\n\nOne two three. Four five.\n\n# B\n\nSix.", config)
    assert first["token_count"] == 9 and second["content"] == "Four five.\n\n# B\n\nSix." and second["overlap_tokens"] == 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# H", "## K", "text one. Two three", "| a | b |", "```", "", "(a) clause", "  "]), max_size=30))
def test_nothing_is_lost(lines):
    chunks = ck.chunk_markdown("\n".join(lines), replace(DEFAULT, chunk_overlap=0.0, chunk_max_tokens=12))
    got = [x for c in chunks for x in c["content"].split()]
    assert sorted(got) == sorted(x for line in lines for x in line.split())


def test_changes(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "document_id string, chunk_index int, content_hash string")
    new = rows(*[("d", i, h) for i, h in enumerate("Abcd")])
    got = {(r.chunk_index, r.is_new) for r in ck.changed_chunks(new, rows(("d", 0, "a"), ("d", 1, "b"))).collect()}
    assert got == {(0, False), (2, True), (3, True)}


def test_same_for_any_partitioning(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").selectExpr("cast(doc_id as string) document_id", "text markdown")
    one, many = (sorted(r.id for r in ck.chunk_documents(docs.repartition(n)).select("id").collect()) for n in (1, 8))
    assert one == many
