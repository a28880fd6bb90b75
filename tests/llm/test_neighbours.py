import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hedonica.llm import neighbours, queries
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact_score(a, b):
    return math.fsum(float(x) * float(y) for x, y in zip(a, b))


def simple(rows, every=20, top=20):
    """Every query's nearest, by comparing it with all rows."""
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i, tuple(np.float32(v).tolist())] = None
    lengths = defaultdict(int)
    for i, v in rows:
        if (i, tuple(np.float32(v).tolist()) if v and None not in v else None) in usable:
            lengths[len(v)] += 1
    if not lengths:
        return {}
    dims = min(lengths, key=lambda n: (-lengths[n], n))
    usable = [x for x in usable if len(x[1]) == dims]
    out = defaultdict(list)
    for q, v in usable:
        if q % every == 0:
            near = sorted((-exact_score(v, w), i) for i, w in usable if i != q)
            out[q] += [(r, i, -s) for r, (s, i) in enumerate(near[:top], start=1)]
    return {q: sorted(rows) for q, rows in out.items()}


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumns(
        {c: F.lit("x") for c in ["id", "vector", "cell", "block", "rank", "score", "query"]}
    )
    out = defaultdict(list)
    for r in neighbours.search(df.repartition(3), **how).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(rows) for q, rows in out.items()}


def recall(got, wanted):
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in wanted[q]}) for q in wanted)
    return hits / sum(map(len, wanted.values()))


def clustered(seed, n, dims=16, noise=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (40, dims))
    return [(i, (middle[rng.integers(40)] + rng.normal(0, noise, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "noise"])
def test_exact_search_equals_comparing_all(spark, monkeypatch, kind):
    for name, value in {"FIRST": 50, "BLOCK": 40, "CELL": 4, "BLOCK_QUERIES": 7}.items():
        monkeypatch.setattr(neighbours, name, value)
    rows = clustered(1, 700, noise=0.05 if kind == "clustered" else 3.0)
    assert found(spark, rows, exact=True) == simple(rows)


def test_given_table(spark, small_dir):
    table = pq.read_table(f"{small_dir}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    got = defaultdict(list)
    for r in queries.op12_neighbours(spark, small_dir).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    wanted = simple(rows)
    assert recall(got, wanted) >= 0.9
    vectors = dict(rows)
    for q, near in got.items():
        assert [r for r, _, _ in sorted(near)] == list(range(1, 21))
        assert all(s == exact_score(vectors[q], vectors[i]) for _, i, s in near)


def test_recall_where_an_index_helps_least_and_share_where_it_helps(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FIRST", 200)
    rng = np.random.default_rng(8)
    noise = [(i, rng.normal(0, 1, 32).tolist()) for i in range(3000)]
    assert recall(found(spark, noise), simple(noise)) >= 0.9
    rows = clustered(2, 3000)
    assert recall(found(spark, rows), simple(rows)) >= 0.9
    # the share of entries that a query of clustered vectors reaches, taken here
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    ready = neighbours.taking_part(df, "vec_id", "embedding")
    _, index = neighbours.build(ready, 3000, 16, 20)
    z = neighbours.deviations(index, 3000, 20, 0.9)
    wanted = simple(rows)
    seen = []
    for q in list(wanted)[:50]:
        cells = neighbours.reached(index, np.array(rows[q][1]), wanted[q][-1][2], None, z)
        seen.append(sum(index.counts[c] for c in cells) / index.counts.sum())
    assert np.mean(seen) < 0.35


def test_copies_ties_gaps_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(3)
    same, other = [0.5, -0.25, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0]
    rows = [(i, same) for i in range(0, 120)] + [(i, other) for i in range(120, 150)]
    rows += [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150, 400)]
    rows += [(0, same), (0, same), (40, other), (-20, other), (-7, same), (None, same), (1000, None)]
    rows += [(1020, [0.0] * 4), (1040, [None, 1.0, 1.0, 1.0]), (1060, [math.nan, 1.0, 1.0, 1.0])]
    rows += [(1080, [math.inf, 1.0, 1.0, 1.0]), (1100, []), (1120, [1.0] * 5), (1140, [1.0] * 3)]
    assert found(spark, rows, exact=True) == simple(rows)


def test_few_rows_and_none(spark):
    assert found(spark, []) == {}
    assert found(spark, [(20, None)]) == {}
    assert found(spark, [(20, [1.0, 2.0])]) == {}
    assert found(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == {}
    rows = [(20, [1.0]), (1, [2.0]), (40, [-3.0])]
    assert found(spark, rows) == simple(rows)


def test_pairs_come_by_descending_sum():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(-5, 6, 7).astype(float), rng.integers(-5, 6, 4).astype(float)
        out = list(neighbours.pairs_by_sum(a, b))
        assert sorted((i, j) for _, i, j in out) == [(i, j) for i in range(7) for j in range(4)]
        assert [t for t, _, _ in out] == sorted((x + y for x in a for y in b), reverse=True)


def test_blocks_hold_whole_cells_and_large_cells_get_their_own():
    first, parts = neighbours.dealt(np.array([3, 4, 9, 0, 25, 1, 2]), block=10)
    assert first.tolist() == [0, 0, 1, 1, 2, 5, 5] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1]
