import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillgraph.llm import op13_importance_resampling as op

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(rows, target):
    s, t = {}, {}
    for texts, count in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            for f in runs(x)[1]:
                count[bucket(f)] = count.get(bucket(f), 0) + 1
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (total_s + 10000) / ((s.get(b, 0) + 1) * (total_t + 10000)))) for b in range(10000)]
    made, able = {}, []
    for i, x in rows:
        words, own = runs(x)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made[i] = [len(own), weight, score, None]
        if len(words) >= 20:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        made[i][3] = rank
    return {i: tuple(x) for i, x in made.items()}


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in rows}


@pytest.mark.parametrize("bins", [4096, 3])
def test_documents(spark, sf_mid, monkeypatch, bins):
    monkeypatch.setattr(op, "BINS", bins)
    docs, items = (spark.read.parquet(f"{sf_mid}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    assert got(op.query(spark, sf_mid)) == want
    assert sum(x[3] is not None for x in want.values()) > 30


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, ""), (2, "É" * 9000 + " x"), (3, "A b-c " * 5000), (4, "\x00\x7f!!")], [(None, "a"), (3, "x y"), (3, "x y")]])
@pytest.mark.parametrize("target", [[], [None, "b c a", "b c a", ""]])
def test_odd_tables(spark, rows, target):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as rank", "true as eligible", "3 as bucket")
    items = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id bigint, text string").selectExpr("*", "1 as n")
    assert got(op.resample(df, items)) == brute(list({i: (i, t) for i, t in rows if i is not None}.values()), target)


@pytest.mark.parametrize("wanted", [0, 1, 7, 50, 333, 399, 400, 1000])
def test_draw_of_ties(spark, wanted):
    """Scores that many rows share are numbered by doc_id."""
    rnd = random.Random(wanted)
    rows = [(i, rnd.choice([-5, 0, 0, 0, 3, 10**6]), i % 5 > 0) for i in range(500)]
    made = op.draw(spark.createDataFrame(rows, "doc_id bigint, score bigint, eligible boolean"), wanted).collect()
    order = sorted((-s, i) for i, s, able in rows if able)[:wanted]
    want = {i: n for n, (_, i) in enumerate(order, 1)}
    assert {r.doc_id: r["rank"] for r in made} == {i: want.get(i) for i, _, _ in rows}


def test_codes():
    rnd = random.Random(4)
    for _ in range(20):
        words = [bytes(rnd.choices(range(128, 256), k=rnd.choice([1, 2, 5, 63, 64, 65, 127, 128, 700]))) for _ in range(rnd.randrange(1, 40))]
        data, at = np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))])
        own = op.Features(data, at)
        for n, found in zip((1, 2, 3), own.buckets):
            assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) % 10000 for i in range(len(words) - n + 1)]


def test_long_text(spark):
    text = " ".join(f"wört{i * i % 977}" for i in range(200_000)) + " " + "x" * 300_000
    rows = [(1, text), (2, "short " * 30), (3, text[:-20])]
    assert got(op.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("wört1 wört4",)], "text string"))) == brute(rows, ["wört1 wört4"])
