"""Rank-order profiles against plain Python, and held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hedonica.llm import language as L
from hedonica.llm.common import table
from hypothesis import given, settings
from hypothesis import strategies as st


def brute_grams(text):
    counts = Counter()
    for word in re.sub(r"[\W\d_]+", " ", (text or "").lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            grams = [padded[i : i + n] for i in range(len(padded) - n + 1)]
            counts.update(g for g in grams if g != " " and not (n == 3 and g[1] == " "))
    return counts


def name(code):
    return "".join(chr(code >> s & (1 << 21) - 1) for s in (0, 21, 42) if code >> s & (1 << 21) - 1)


@given(st.text(alphabet="abé Zİ中12_.\n", max_size=80), st.integers(1, 90))
@settings(max_examples=300, deadline=None)
def test_ngrams(text, chunk):
    old, L.CHUNK = L.CHUNK, chunk
    try:
        codes, counts = L.ngrams(text)
    finally:
        L.CHUNK = old
    assert {name(int(c)): int(n) for c, n in zip(codes, counts)} == brute_grams(text)


def test_distance_is_out_of_place():
    a, b = L.profile("aab"), L.profile("abb c")
    ranks = np.arange(len(b), dtype=np.int32)
    order = np.argsort(b)
    c = L.Classifier(["x"], b[order], np.zeros(len(b), np.int32), ranks[order])
    place = {int(g): i for i, g in enumerate(b)}
    want = sum(abs(place[int(g)] - i) if int(g) in place else L.RANKS for i, g in enumerate(a))
    assert c.distances(a).tolist() == [want]


def test_cases(spark, documents):
    rows = [(i, "the cat and the dog of the house", "en", "s") for i in range(20)]
    rows += [(100 + i, "der Hund und die Katze des Hauses", "de", "s") for i in range(20)]
    rows += [(50, None, "en", "s"), (51, "12 ?! _ ²½", "de", "s"), (52, "", None, None), (None, "the dog", "xx", "s")]
    rows += [(53, "the house " * 200_000, "en", "s"), (54, "und die Katze", None, None), (54, "und die Katze", None, None)]
    got = L.held_out_predictions(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by[r.doc_id] = r
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert by[50].lang_pred == by[51].lang_pred == by[52].lang_pred == "und"
    assert by[53].lang_pred == "en" and by[54].lang_pred == "de" and by[None].lang_pred == "en"
    assert all(by[i].lang_pred == ("en" if i < 100 else "de") for i in by if i is not None and i not in (50, 51, 52, 53, 54))


def test_nothing_to_learn_from(spark, documents):
    got = L.held_out_predictions(documents([(1, "words", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert L.held_out_predictions(documents([(1, "x")]).limit(0)).collect() == []


@pytest.mark.parametrize("at_once", [1, 2, 3])
def test_languages_in_slices(spark, documents, small_dir, at_once):
    docs = table(spark, small_dir, "documents").select("doc_id", "text", "lang")
    rows = [(-1, None, "zz", "s"), (-2, "", "aa", "s"), (-3, "12 3", "ab", "s"), (-4, "\u4e2d\u6587", None, "s"), (-4, "\u4e2d\u6587", None, "s")]
    docs = docs.union(documents(rows).select("doc_id", "text", "lang"))
    assert docs.where("text is not null").select("lang").distinct().count() > 4
    whole = L.identified(docs, docs, ["doc_id"]).collect()
    parts = L.identified(docs, docs, ["doc_id"], at_once=at_once).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_held_out_accuracy(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    got = L.held_out_predictions(docs).join(docs.select("doc_id", "lang", "text"), "doc_id")
    got = got.where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 20 and right >= 0.97 * len(got)
