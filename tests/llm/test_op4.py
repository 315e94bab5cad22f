import duckdb
import pytest

from quillgraph.llm import op4_line_runs as op


def brute(rows, m):
    docs = {i: (t or "").split("\n") for i, t in rows}
    seen, gone = set(), {i: set() for i in docs}
    for i in sorted(docs):
        for k in range(len(docs[i]) - m + 1):
            run = tuple(docs[i][k : k + m])
            if run in seen:
                gone[i].update(range(k, k + m))
            seen.add(run)
    return {i: (len(x), len(gone[i]), sum(k - 1 not in gone[i] for k in gone[i]), "\n".join(y for k, y in enumerate(x) if k not in gone[i])) for i, x in docs.items()}


def got(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in df.collect()}


ROWS = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\na\na\na\na"), (4, None), (5, ""), (6, "\n\n\n"), (7, "a\nb\nc\nd"), (8, "b\nc\ny\nb\nc\nd"), (9, "q")]


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_small(spark, m):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "1 as line", "2 as rank", "3 as gone")
    assert got(op.drop_later_runs(df, m)) == brute(ROWS, m)


@pytest.mark.parametrize("rows", [[], [(None, "a"), (3, "x\nx"), (3, "x\nx")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(op.drop_later_runs(df)) == brute({i: (i, t) for i, t in rows if i is not None}.values(), 2)


def test_sql(spark, sf_mid):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_mid}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(op.SQL).fetchall()}
    assert {r[0]: tuple(r)[1:] for r in op.query(spark, sf_mid).collect()} == want


def test_maximal_runs(spark):
    """Each run's copy is equal to its first one as far as it goes, and no line further; runs of 2 to 50 lines."""
    import random

    rnd = random.Random(9)
    line = lambda: f"l{rnd.randrange(10**6)}"
    runs = [[line() for _ in range(n)] for n in (2, 3, 5, 8, 13, 31, 50)]
    docs = {}
    for k in range(25):
        text = [line() for _ in range(rnd.randrange(4))]
        for _ in range(rnd.randrange(1, 4)):
            run = rnd.choice(runs)
            cut = rnd.randrange(len(run) - 1)
            text += run[cut:] + [line() for _ in range(rnd.randrange(3))]
        docs[k] = text
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in docs.items()], "doc_id bigint, text string")
    for m in (2, 3):
        found = op.later_runs(df, m).collect()
        assert found and max(r.n_lines for r in found) > 20
        for r in found:
            a, b, n = docs[r.doc_id][r.line :], docs[r.first_doc][r.first_line :], r.n_lines
            assert n >= m and a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])
            assert (r.first_doc, r.first_line) < (r.doc_id, r.line)
        assert got(op.drop_later_runs(df, m)) == brute([(k, "\n".join(x)) for k, x in docs.items()], m)


def test_long_lines(spark):
    """Later copies of a single line go if it has enough words, whatever stands around it; shorter ones stay."""
    long, short = " ".join(f"w{k}" for k in range(50)), " \t ".join(f"w{k}" for k in range(49))
    spaced = long.replace(" ", " \t\x0b ")
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, f"{short}\nx"), (5, f"y\n{short}"), (6, f"{spaced}\nz"), (7, f"q\n{spaced}\n{spaced}\na"), (8, f"a\n{long}\ne")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "true as long", "1 as words")
    kept = {i: r[3] for i, r in got(op.drop_later_runs(df)).items()}
    # Document 8 begins with a run of two lines that stands in document 1.
    assert kept == {1: rows[0][1], 2: "c\nd", 3: "", 4: rows[3][1], 5: rows[4][1], 6: rows[5][1], 7: "q\na", 8: "e"}
    assert {i: r[1:3] for i, r in got(op.drop_later_runs(df, 2, 10**6)).items()} == {i: r[1:3] for i, r in brute(rows, 2).items()}
    assert {r.doc_id: r.n_lines for r in op.later_runs(df).collect()} == {8: 2}
