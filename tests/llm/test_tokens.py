"""Token files, packing and token counts against the tokenizers library, row by row."""

import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hedonica.llm import packing, simple8b, token_counts, token_files, word_ids as word_ids_module
from hedonica.llm.common import tokenizer
from hedonica.llm.word_ids import WORD_BPE, word_ids
from hedonica.session import fresh_path
from hypothesis import given, settings
from hypothesis import strategies as st

ODD = st.text(
    alphabet=st.sampled_from(list("ab Zé'sıİ\n\t\r\x00\x1c\x85  　中JǨ̇̊1٣.,!😀_<|>")), max_size=40
)
CASES = [None, "", " ", "\n \n", "<|endoftext|> a  <|endoftext|>", "J̌ x", "a" * 5000, "don't it's", "é" * 300 + " b"]


def ids_of(text, name=WORD_BPE):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_word_ids_equal_the_library(text):
    assert np.frombuffer(word_ids().of(text), "<u4").tolist() == ids_of(text)


@given(st.one_of(ODD, st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "<|endoftext|>", "é", "12", "."])).map("".join)))
@settings(max_examples=400, deadline=None)
def test_counts_equal_the_library(text):
    lengths = token_counts.part_lengths(token_counts.BYTE_BPE, *token_counts.length_table([" a", "a", "  "]))
    assert lengths.of(text) == len(ids_of(text, token_counts.BYTE_BPE))


@given(st.lists(st.one_of(st.none(), ODD), max_size=8), st.sampled_from([1, 30, 16 << 20]), st.integers(0, 2))
@settings(max_examples=200, deadline=None)
def test_word_ids_of_a_column_are_those_of_its_texts(texts, size, skipped):
    column = pa.array(texts, pa.string()).slice(skipped)
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(word_ids_module, "SLICE", size)
        got = list(word_ids().of_column(column))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [ids_of(t) for t in texts[skipped:]]


def test_a_part_is_looked_up_once_a_slice(monkeypatch):
    encoder = word_ids_module.WordIds(WORD_BPE)
    asked, known = [], encoder.ids_of_part
    monkeypatch.setattr(encoder, "ids_of_part", lambda part: asked.append(part) or known(part))
    assert len(list(encoder.of_column(pa.array(["a b\na", "b  a", None, ""] * 50)))) == 200
    assert sorted(asked) == ["", "a", "b"]


def test_a_slice_frees_what_it_was_cut_from(monkeypatch):
    encoder, held = word_ids_module.WordIds(WORD_BPE), []
    known = encoder.ids_of_part
    seen = lambda part: held.append(pa.total_allocated_bytes() - before) or known(part)
    texts = pa.array(["some words " * 200] * 6000)
    before = pa.total_allocated_bytes()
    monkeypatch.setattr(encoder, "ids_of_part", seen)
    found = encoder.of_column(texts)
    first = next(found)
    held.append(pa.total_allocated_bytes() - before)
    assert max(held) < texts.nbytes
    assert all(ids == first for ids in found)


def test_what_a_worker_remembers_is_small():
    parts, pre_tokens = word_ids_module.PARTS, word_ids_module.PRE_TOKENS
    entry = sys.getsizeof("a word") + sys.getsizeof(b"two ids.") + 60  # in a dict that has just grown
    assert 2 * (parts + pre_tokens) * entry < 200e6


BLANKS = st.text(alphabet=st.sampled_from(list("a1.    \xa0\xa0\u3000\t\n\r\x85\u2003\x1c")), max_size=30)


@given(BLANKS)
@settings(max_examples=400, deadline=None)
def test_counts_of_white_space_equal_the_library(text):
    lengths = token_counts.part_lengths(token_counts.BYTE_BPE, *token_counts.length_table([" a", " ", "\xa0"]))
    assert "".join(token_counts.PART.findall(text)) == text
    assert lengths.of(text) == len(ids_of(text, token_counts.BYTE_BPE))


@pytest.mark.parametrize("pairs", [1, 2, 3, 5, 9])
def test_no_break_spaces_between_blanks(pairs):
    text = "Home" + " \xa0" * pairs + " About"
    lengths = token_counts.part_lengths(token_counts.BYTE_BPE, *token_counts.length_table([" \xa0", " About"]))
    assert lengths.of(text) == len(ids_of(text, token_counts.BYTE_BPE))


@given(st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 70000), st.integers(0, 3), st.just(0)), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    data = simple8b.encode(np.array(values, dtype=np.uint64))
    assert simple8b.decode(data).tolist() == values
    assert simple8b.decode(data, 1, 2).tolist() == values[512:1024]


def test_simple8b_is_compact():
    assert len(simple8b.encode(np.zeros(51200))) < 51200 / 10
    assert len(simple8b.encode(np.full(51200, 1000))) < 1.5 * 51200


def test_token_files(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "RECORD_IDS", 50)
    rows = [(i * 7 % 100, f"text {i} of words " * (i % 5)) for i in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(CASES)] + [(5, "tie"), (5, "tie"), (None, "no id"), (-3, "x")]
    path = fresh_path(spark, "t")
    token_files.write_tokens(documents(rows, extra=True), path, 2)
    got = [tuple(r) for r in token_files.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    got.sort(key=lambda r: r[1])
    want = defaultdict(list)
    for doc_id, text in rows:
        ids = np.array([*ids_of(text), 2], dtype="<u4")
        want[doc_id].append((len(ids), zlib.crc32(ids)))
    at, seen = 0, defaultdict(list)
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        seen[doc_id].append((n, crc))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in seen.items()}
    order = [float("-inf") if r[0] is None else r[0] for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("operator", ["files", "pack", "count"])
def test_empty_table(spark, documents, operator):
    empty = documents([("x")]).limit(0)
    if operator == "files":
        path = fresh_path(spark, "t")
        token_files.write_tokens(empty, path, 2)
        df = token_files.token_digests(spark, path)
    else:
        df = packing.pack_documents(empty, 1) if operator == "pack" else token_counts.count_tokens(empty)
    assert df.collect() == []


@given(st.lists(st.integers(1, 2048), max_size=60))
@settings(max_examples=60, deadline=None)
def test_differencing_deals_every_size_once(sizes):
    dealt = packing.pack(sizes)
    assert sorted(i for held in dealt for i in held) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in held) <= 2048 for held in dealt)
    assert len(dealt) >= -(-sum(sizes) // 2048)


def test_differencing_is_karmarkar_karp():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in held) for held in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_packing(spark, documents):
    rows = [(i, "some words here " * (i * 13 % 400)) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(CASES)] + [(None, "no id")]
    pieces = packing.pack_documents(documents(rows, extra=True).repartition(2), 1).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    for doc_id, text in rows:
        ids, at = np.array([*ids_of(text), 1], dtype="<u4"), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    total = padding = 0
    for held in by_seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
        total, padding = total + at, padding + 2048 - at
    assert padding < 0.02 * total + 2 * 2048


def test_counts(spark, documents):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(1, "two words"), (None, "x y")]
    got = token_counts.count_tokens(documents(rows, extra=True)).collect()
    want = [(i, len((t or "").encode()), len(ids_of(t, token_counts.BYTE_BPE))) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_frequent_parts(spark, documents):
    parts = token_counts.frequent_parts(documents(["a b b", "b b", None]), size=1)
    assert parts == [" b"]
