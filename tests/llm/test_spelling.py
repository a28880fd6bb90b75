import random
import re
import zlib
from collections import Counter

import pytest
from hedonica.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def simple_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def simple_variants(docs):
    counts = simple_words(docs)
    rows = {}
    for w, n in counts.items():
        near = sorted((-counts[x], x) for x in counts if one_edit(w, x))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        rows[w] = (n, len(near), form, counts[form] if form else None)
    out = set()
    for w, row in rows.items():
        root = w
        while rows[root][2]:
            root = rows[root][2]
        out.add((w, *row, root))
    return out


def random_docs(seed, docs=80, letters="aeinsté"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)]

    def typed(word):
        i, kind = rng.randrange(len(word)), rng.randrange(8)
        c = rng.choice(letters)
        edits = [word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]]
        return edits[kind] if kind < 3 else word

    texts = []
    for i in range(docs):
        out = [typed(typed(rng.choice(base[: rng.choice([3, 40])]))) for _ in range(150)]
        texts.append((i - 5, " ".join(w.upper() if rng.random() < 0.1 else w for w in out)))
    return texts


def found(docs):
    rows = spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_comparing_all_words(documents, seed):
    texts = random_docs(seed)
    wanted = simple_variants(texts)
    assert sum(form is not None for _, _, _, form, _, _ in wanted) > 20
    assert found(documents(texts, extra=True)) == wanted


def test_gaps_ties_and_repeats(documents):
    texts = [
        (1, "garden " * 25 + "gardan " * 5 + "guarden " * 25), (1, None), (2, ""), (None, "Garden"),
        (3, "tÜren TÜREN " * 3 + "×÷aaaa" * 1), (3, "tÜren TÜREN " * 3),
        (4, "aaaaaa " * 30 + "aaaaaaa " * 6 + "aaaaaaaa " * 1), (4, "x1garden2 short five5"),
    ]
    assert found(documents(texts)) == simple_variants(texts)


def test_very_long_text_and_run(documents):
    texts = [(1, "longer " * 60_000 + "longar " * 7), (2, ("q" * 30_000 + " ") * 6)]
    assert found(documents(texts)) == simple_variants(texts)


def test_empty_table(documents):
    assert found(documents([])) == set()


def test_hot_keys_are_dealt_to_parts(spark):
    rng = random.Random(4)
    words = list({"zq" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(400)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    wanted = {(a, b) for a in words for b in words if one_edit(a, b)}
    for key_rows in (3, 2_000):
        assert {tuple(r) for r in spelling.near_pairs(df, key_rows).collect()} == wanted


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(3)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.randint(3, 6)))
        cost = [rng.randint(1, 9) for _ in places]
        chosen = spelling.pivots_of(places, cost)
        at = dict(zip(places, cost))
        assert len(chosen) == 2 and abs(chosen[0] - chosen[1]) >= 2
        assert sum(at[p] for p in chosen) == min(
            at[p] + at[q] for p in places for q in places if q - p >= 2
        )


def test_any_edit_keeps_a_pivot_in_a_prefix():
    """The claim that the join rests on, on random words and orders with repeated grams."""
    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(6, 9)))
        i, c = rng.randrange(len(a)), rng.choice("abcd")
        b = rng.choice([a[:i] + c + a[i:], a[:i] + c + a[i + 1 :], a[:i] + a[i + 1 :]])
        if a == b or len(b) < 6:
            continue
        all_grams = sorted(set(spelling.grams(a) + spelling.grams(b)))
        rank = dict(zip(rng.sample(all_grams, len(all_grams)), range(99)))
        parts = []
        for w in (a, b):
            ranks = [rank[g] for g in spelling.grams(w)]
            places = spelling.prefix_of(ranks)
            parts.append((max(ranks[p] for p in places), w, places, spelling.pivots_of(places, [ranks[p] for p in places])))
        (_, x, _, pivots), (_, y, prefix, _) = sorted(parts, key=lambda p: p[0])
        grow = len(y) - len(x)
        allowed = {0} if grow == 0 else {0, grow}
        assert any(x[p : p + 2] == y[q : q + 2] and q - p in allowed for p in pivots for q in prefix)
