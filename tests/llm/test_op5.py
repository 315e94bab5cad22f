import itertools
import math
import random
import re
import time

from quillgraph.llm import op5_secret_grammar as op

A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    t = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in A.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(x[2] for x in sorted(found))


def test_base_and_table(spark, sf_mid):
    import hashlib

    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    rows = {r.doc_id: r for r in op.query(spark, sf_mid).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        base = brute(t)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        own = [s for s in rows[i].spans.split(",") if s and not s.startswith("format:")]
        assert ",".join(own) == base
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(base.count(f"{k}:") for k in op.KINDS)


def test_inference(spark):
    rnd = random.Random(2)
    key = lambda n=24: "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789abcdefghijkmnpqrstuvwxyz") for _ in range(n))
    word = lambda: "".join(rnd.choice(["the", "and", "tion", "er", "ing", "re"]) for _ in range(8))
    rows = [(i, f"text token = {key()} more {word()} é secret=short") for i in range(150)]
    rows += [(500 + i, f"é plain {key()} and {word()}") for i in range(20)]
    rows += [(900, None), (901, ""), (902, "secret=ab token: abcdefghijklmn"), (902, "x"), (None, "AKIA" + "A1" * 8), (903, "ſecret=abcdefghijklmn password='q" + "a" * 15)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as spans", "2 as row")
    got = op.digest(op.scan(df)).collect()
    assert len(got) == len(rows)
    added = {r.doc_id: r.spans for r in got if r.doc_id is not None and 500 <= r.doc_id < 520}
    assert sum(s.startswith("format:8:32") and s.count(",") == 0 for s in added.values()) >= 18
    assert all("format" not in r.spans for r in got if r.doc_id is not None and r.doc_id < 150)
    assert {r.spans for r in got if r.doc_id == 902} == {brute(rows[-4][1]), ""}
    assert op.scan(df.limit(0)).count() == 0


def test_free_tokens():
    """The sweep gives what looking at every base span for every token gives."""
    rnd = random.Random(4)
    parts = ["secret = " + "k" * 30, "AKIA" + "Z" * 20, "0123456789abcdef" * 2, "plainwordthatislong", "x", "=" * 20, "token:"]
    for _ in range(300):
        text = rnd.choice([" ", ""]).join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        own = op.base_spans(text)
        free = [(m.start(), m.end()) for m in op.TOKEN.finditer(text)]
        assert op.free_tokens(text, own) == [(s, e) for s, e in free if not any(s < y and x < e for x, y, *_ in own)]
    began = time.time()
    op.free_tokens(("secret = " + "k" * 30 + " plainwordthatislong ") * 10_000, op.base_spans(("secret = " + "k" * 30 + " plainwordthatislong ") * 10_000))
    assert time.time() - began < 20


def test_held_out_recall_and_precision():
    """Formats learned from labelled values find unlabelled ones; ordinary text is left alone."""
    rnd = random.Random(6)
    body = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = [lambda: "sk-live-" + body("0123456789", 6) + body("abcdef", 18), lambda: "ghx_" + body(alnum, 30), lambda: body("ABCDEF", 4) + "-" + body("0123456789", 8) + "-" + body(alnum, 12)]
    secrets = [m() for m in made for _ in range(200)]
    ordinary = ["".join(rnd.choice(["tion", "er", "ing", "ment", "al", "over", "con", "ness"]) for _ in range(6)) for _ in range(400)]
    ordinary += ["-".join(rnd.choice(["state", "of", "the", "art", "well", "known", "long"]) for _ in range(4)) + "x" * 6 for _ in range(200)]
    assign, other = op.Automaton(secrets[::2]), op.Automaton(ordinary[::2])
    assert len(assign.states) > 3
    found = [op.score(x, [assign], other) >= op.THRESHOLD for x in secrets[1::2]]
    false = [op.score(x, [assign], other) >= op.THRESHOLD for x in ordinary[1::2]]
    recall, precision = sum(found) / len(found), sum(found) / max(1, sum(found) + sum(false))
    print(f"recall {recall:.3f}, precision {precision:.3f}, states {len(assign.states)}")
    assert recall >= 0.9 and precision >= 0.9


def test_likelihoods_are_a_distribution():
    """Each state's classes and its end add up to one, so words of a bounded length add up to less."""
    own = op.Automaton(["00", "0", "0z", "0z", "00", "z"] * 10)
    assert all(n == final + sum(seen for _, seen in edges.values()) for edges, final, n in own.states)
    letters = {"0": "0", "f": "a", "z": "g", "F": "A", "Z": "G"} | {c: c for c in "+/_.=-"}
    assert len(letters) + 1 == op.SYMBOLS
    total = 0.0
    for length in range(4):
        for word in itertools.product(letters, repeat=length):
            size = math.prod(op._SIZE.get(c, 1) for c in word)
            total += size * math.exp(own.score("".join(letters[c] for c in word)) * (length + 1))
    assert 0.5 < total < 1


def test_ends_count():
    """Values of one length are told from longer ones of the same classes."""
    rnd = random.Random(9)
    made = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    own = op.Automaton([made(16) for _ in range(400)])
    assert own.score(made(16)) * 17 > own.score(made(17)) * 18 + math.log(10)


def test_short_tokens(spark):
    """Candidates start at the least length of a labelled value."""
    rnd = random.Random(3)
    key = lambda: "".join(rnd.choice("ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(13))
    word = lambda: "".join(rnd.choice(["the", "and", "tion", "er", "ing", "re"]) for _ in range(6))
    rows = [(i, f"token = {key()} more {word()}") for i in range(200)] + [(500 + i, f"plain {key()} {word()}") for i in range(20)]
    got = {r.doc_id: r.spans for r in op.digest(op.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert sum(got[500 + i] == "format:6:19" for i in range(20)) >= 18 and not any("format" in got[i] for i in range(200))
