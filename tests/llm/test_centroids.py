import hashlib
import math
import random

import numpy as np
import pytest
from hedonica.llm import centroids
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def simple(rows, clusters=16, rounds=3, dims=64):
    """(id, cluster, distance) of every vector kept and the final centroids, in plain Python."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    hashed = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)
    if any(i is None for i, _ in kept):
        hashed = sorted((none, "" if none else h, v) for none, h, v in hashed)
    found = [v for _, _, v in hashed[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(found))

    for _ in range(rounds):
        held = [[] for _ in found]
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        found = [[sum(x) // len(h) for x in zip(*h)] if h else m for m, h in zip(found, held)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], found


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumns(
        {c: F.lit("x") for c in ["id", "cluster", "distance", "dim", "vector"]}
    )
    found = centroids.cluster_vectors(df.repartition(3), **how)
    wanted, final = simple(rows, **{"dims" if k == "dimensions" else k: v for k, v in how.items()})
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.assigned.collect()), key=order) == sorted(wanted, key=order)
    assert found.centroids == final
    return centroids.with_inertia(found).collect() if wanted else []


def vectors(seed, n, dims=64, spread=0.2):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(rng.choice([-0.3, 0.0, 0.4]), spread, dims).tolist()) for i in range(n)]


def test_same_as_plain_python(spark):
    rows = vectors(1, 120)
    out = check(spark, rows)
    assert len({r["centroid_sha256"] for r in out}) == len({r["cluster"] for r in out}) > 5
    assert {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}
    for c in {r["cluster"] for r in out}:
        own = [r for r in out if r["cluster"] == c]
        assert {r["cluster_inertia"] for r in own} == {sum(r["distance"] for r in own)}


def test_gaps_are_left_out_and_ties_go_to_the_first(spark):
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [math.nan] + [0.5] * 63, [math.inf] + [0.1] * 63]
    rows = [(100 + i, v) for i, v in enumerate(odd)] + [(i, [0.25] * 64) for i in range(30)]
    rows += [(7, [0.25] * 64), (7, [-0.001] * 64), (None, [0.9] * 64), (None, [0.9] * 64), (-3, [0.9] * 64)]
    check(spark, rows)


def test_few_rows_and_none(spark):
    check(spark, vectors(2, 5))
    assert check(spark, []) == []
    assert check(spark, [(1, None)]) == []
    assert check(spark, [(None, [0.5] * 64)])[0]["distance"] == 0


def test_tables_begin_anew_when_full():
    rng = np.random.default_rng(5)
    middle = rng.integers(-9, 9, (4, 3))
    tables = centroids.Tables(middle, most=8)
    for _ in range(20):
        found = rng.integers(-50, 50, (rng.integers(1, 12), 3))
        wanted = ((found[:, None, :] - middle) ** 2).sum(axis=2)
        assert (tables.distances(found) == wanted).all()


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(60)]
    check(spark, rows, dimensions=4, clusters=5)
    df = spark.createDataFrame([(1, [3e6] * 4, 1)], SCHEMA)
    with pytest.raises(Exception, match="exceed a long"):
        centroids.cluster_vectors(df, dimensions=4)


def test_a_task_sends_a_row_for_each_centroid_and_dimension(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors(3, 500, 4)], SCHEMA).repartition(2)
    whole = centroids.integers(df, "vec_id", "embedding", 4, 64)
    sums = centroids.cluster_sums(whole, centroids.first_centroids(whole, 3, 1))
    assert "partial_sum" in sums._jdf.queryExecution().executedPlan().toString()
    assert sums.count() <= 3 * 5
