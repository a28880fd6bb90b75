"""SimHash against comparison of all pairs."""

import re

import numpy as np
import pytest
import xxhash
from hedonica.llm import simhash as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(values):
    """The least member of each value's component, by comparing all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


@pytest.mark.parametrize("keep", [None, ["doc_id"], ["text", "doc_id"]])
def test_a_text_is_sent_to_python_once(spark, documents, keep, monkeypatch):
    docs, sent = documents(["a b C", None, "\xe9 \x85x", ""]), []
    kind = type(docs)
    asked = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a: sent.append(df.columns) or asked(df, *a))
    marked = S.with_fingerprint(docs, "f", keep)
    assert marked.columns == [*(keep or docs.columns), "f"]
    assert sorted(sent[0]) == sorted({*(keep or docs.columns), "text"})
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = marked.collect()
    assert {r.doc_id: r.f % 2**64 for r in rows} == {i: brute_fingerprint(t) for i, t in texts.items()}
    assert "text" not in marked.columns or {r.doc_id: r.text for r in rows} == texts


@given(st.text(alphabet="aB é\t\n\x0b\x1c\x85 .", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)


def test_shingle_hash_is_that_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("one two é three, and a longer shingle of words"))).first()
    assert row[0] % 2**64 == xxhash.xxh64_intdigest("one two é three, and a longer shingle of words".encode(), 42)


def around(rng, centre, n, bits, within=64):
    out = [centre]
    for _ in range(n - 1):
        v = centre
        for b in rng.integers(0, within, bits):
            v ^= 1 << int(b)
        out.append(v)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_large_group_parts(seed):
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 2**63))
    values = np.unique(np.array(around(rng, base, 300, 3 + seed, 16), dtype=np.uint64))
    child, root = S.linked_large(values, 5)
    got = {v: v for v in values.tolist()} | dict(zip(child.tolist(), root.tolist()))
    assert got == parts(values.tolist())


def test_small_groups_together():
    rng = np.random.default_rng(3)
    groups = [np.unique(np.array(around(rng, int(rng.integers(0, 2**63)), int(rng.integers(2, 64)), 3, 16), dtype=np.uint64)) for _ in range(40)]
    values = np.concatenate(groups)
    child, root = S.linked_small(values, np.repeat(np.arange(40), [len(g) for g in groups]))
    got = list(zip(child.tolist(), root.tolist()))
    want = [(v, r) for g in groups for v, r in parts(g.tolist()).items() if v != r]
    assert sorted(got) == sorted(want)


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 2**63, 50)]
    for v in values[:6]:
        values += around(rng, v, 30, 4)
    walk = values[10]
    for i in range(40):  # a long chain of links
        walk ^= 1 << i | 1 << (i + 20)
        values.append(walk)
    values += around(rng, 2**64 - 1, 5, 2)
    values = sorted(set(values))
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fingerprint bigint")
    got = {v: v for v in values}
    for u, v in S.components(S.links(df)).collect():
        got[u % 2**64] = v % 2**64
    want = parts(values)
    by = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert by(got) == by(want)


TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here to there " * 12
ROWS = [
    (5, TEXT), (3, TEXT), (9, TEXT.upper()), (4, TEXT + "end"), (7, None), (6, ""), (8, " \n"), (1, "two words"),
    (2, "two  WORDS"), (2, "two  WORDS"), (None, "lonely text of some words"), (None, TEXT), (11, "x " * 50_000 + "y"),
]


def want_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = parts(fps)
    out = []
    for (doc_id, _), fp in zip(rows, fps):
        ids = [i for (i, _), f in zip(rows, fps) if root[f] == root[fp] and i is not None]
        out.append((doc_id, fp, min(ids, default=None)))
    return out


def test_near_duplicates(spark, documents):
    got = [(r[0], r[1] % 2**64, r[2]) for r in S.near_duplicates(documents(ROWS, extra=True)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want_components(ROWS)))


def test_one_of_each_component_stays(spark, documents):
    docs = documents(ROWS, extra=True).withColumnRenamed("part", "row")
    kept = S.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in want_components(ROWS)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))


def test_empty_table(spark, documents):
    assert S.near_duplicates(documents(ROWS).limit(0)).collect() == []
    assert S.without_near_duplicates(documents(ROWS).limit(0)).collect() == []
