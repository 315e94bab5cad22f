"""Clusters of mentions, against clusters made by hand."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.functions.coreference import clusters, replacements
from quillgraph.plans import ingest
from quillgraph.plans.providers import Providers


def named(text):
    return {best: [text[s:e] for s, e in places] for best, places in clusters(text)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mr. John Smith joined in May. He left. Smith was tired.", {"Mr. John Smith": ["Mr. John Smith", "He", "Smith"]}),
        ("Acme Corporation bought Beta Ltd. The corporation paid its debts.", {"Acme Corporation": ["Acme Corporation", "The corporation", "its"]}),
        ("We met International Business Machines in June. Later IBM said that they agree.", {"International Business Machines": ["International Business Machines", "IBM"]}),
        ("Acme Inc. sells ropes. They are red.", {"Acme Inc": ["Acme Inc", "They"]}),
        ("Mrs. Jane Doe met Mr. Max Roe. She greeted him.", {"Mrs. Jane Doe": ["Mrs. Jane Doe", "She"], "Mr. Max Roe": ["Mr. Max Roe", "him"]}),
        ("Jane Doe met Max Roe. She spoke. He listened.", {"Jane Doe": ["Jane Doe", "She"], "Max Roe": ["Max Roe", "He"]}),
        ("John Smith and Ann Smith met. Smith spoke.", {}),
        ("Acme Corporation grew. It is clear that it was late.", {"Acme Corporation": ["Acme Corporation", "it"]}),
        ("Old Bank Group fell. One. Two. Three came. It rose.", {}),
        ("Reading is fun. Trees grow. It helps.", {}),
        ("Model 7 Corporation is in FRANCE. Its price fell.", {"Model 7 Corporation": ["Model 7 Corporation", "Its"]}),
        ("Acme Corporation and Beta Company met. The firm won.", {}),
        ("", {}),
    ],
)
def test_clusters_by_hand(text, want):
    assert named(text) == want


def test_the_chunk_before_is_seen_and_not_changed():
    assert replacements("Acme Corporation was founded in Rome.", "It pays its staff. Acme Corporation grows.") == [(0, 2, "Acme Corporation"), (8, 11, "Acme Corporation")]
    assert replacements(None, "It pays its staff.") == [] == replacements("Acme Corporation", None)
    assert replacements("", "") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("Acme Smith Corporation IBM He it its they The company Mr. Dr. . ! 7 é Éa of and x \n\n O'Neil's 's - A. Ünal".split(" ")), max_size=60).map(" ".join))
def test_places_are_apart_and_in_the_text(text):
    places = sorted(p for _, own in clusters(text) for p in own)
    assert all(0 <= s < e <= len(text) for s, e in places)
    assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))
    half = len(text) // 2
    assert all(0 <= s < e <= len(text) - half for s, e, _ in replacements(text[:half], text[half:]))


def test_long_texts_take_linear_time():
    text = "".join(f"Mr. Name{i} Smith met Acme{i} Corporation. He paid it. " for i in range(8000))
    began = time.monotonic()
    assert len(clusters(text)) > 7000
    assert time.monotonic() - began < 30


def test_chunks_take_the_default_rules(spark):
    rows = [("d", 0, "Acme Corporation is in Rome.", 20), ("d", 1, "It grows.", 20), ("d", 2, "It shrinks.", 9), ("e", 0, "It is here.", 20), ("e", 1, None, 20)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, content string, token_count int")
    got = {(r.document_id, r.chunk_index): r.content for r in ingest.coref(chunks, Providers()).collect()}
    assert got == {("d", 0): rows[0][2], ("d", 1): "Acme Corporation grows.", ("d", 2): "It shrinks.", ("e", 0): "It is here.", ("e", 1): None}
