import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hedonica.operators.split import stratified_split, stratified_splits
from pyspark.sql import functions as F

N = 4001


def outcome(spark):
    rng = np.random.default_rng(5)
    # A third of the rows share one value.
    y = np.where(rng.random(N) < 0.33, 4.5, rng.normal(5, 1, N).round(3))
    return [(f"k{i}", float(v)) for i, v in enumerate(y)]


def simple(rows, share, seed, cuts):
    strata = defaultdict(list)
    for key, y in rows:
        s = 1 + sum(y > c for c in cuts)
        strata[s].append((hashlib.md5(f"{seed}|{key}".encode()).hexdigest(), key))
    return {k for draws in strata.values()
            for _, k in sorted(draws)[: math.ceil(share * len(draws))]}


@pytest.mark.parametrize("finish_rows", [100_000, 3])
def test_same_rows_as_the_simple_form(spark, finish_rows):
    rows = outcome(spark)
    df = spark.createDataFrame(rows, "key string, y double")
    split = stratified_split(df, "y", "key", 0.25, 1, finish_rows=finish_rows, bins=16)
    assert split.cuts == tuple(sorted(set(np.quantile([y for _, y in rows], [0.25, 0.5, 0.75]))))
    train = {r["key"] for r in split.train(df).collect()}
    rest = {r["key"] for r in split.holdout(df).collect()}
    assert train == simple(rows, 0.25, 1, split.cuts)
    assert not train & rest and len(train | rest) == N


def test_exact_sizes_whatever_the_partitioning(spark):
    df = spark.createDataFrame(outcome(spark), "key string, y double")
    first = stratified_split(df, "y", "key", 0.1, 7)
    again = stratified_split(df.repartition(13, F.rand()), "y", "key", 0.1, 7)
    assert (first.cuts, first.last_draw) == (again.cuts, again.last_draw)
    counts = Counter(r[0] for r in first.train(df).select(first.stratum()).collect())
    for stratum, (need, total) in first.rows.items():
        assert counts[stratum] == need == math.ceil(0.1 * total)
    assert sum(total for _, total in first.rows.values()) == N


def test_other_seed_other_rows(spark):
    df = spark.createDataFrame(outcome(spark), "key string, y double")
    one = stratified_split(df, "y", "key", 0.25, 1)
    two = stratified_split(df, "y", "key", 0.25, 2)
    assert one.cuts == two.cuts and one.last_draw != two.last_draw


def test_the_split_is_a_plain_filter(spark):
    df = spark.createDataFrame(outcome(spark), "key string, y double")
    split = stratified_split(df, "y", "key", 0.25, 1)
    plan = split.train(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_repeated_keys_and_missing_outcomes_are_refused(spark):
    same = spark.createDataFrame([("a", float(i % 5)) for i in range(50)], "key string, y double")
    with pytest.raises(ValueError, match="not unique"):
        stratified_split(same, "y", "key", 0.25, 1)
    gap = spark.createDataFrame([("a", 1.0), ("b", None)], "key string, y double")
    with pytest.raises(ValueError, match="NULL"):
        stratified_split(gap, "y", "key", 0.25, 1)


def test_missing_keys_are_refused(spark):
    rows = [(None if i % 10 == 0 else f"k{i}", float(i)) for i in range(1000)]
    with pytest.raises(ValueError, match="NULL"):
        stratified_split(spark.createDataFrame(rows, "key string, y double"), "y", "key", 0.2, 1)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.37, 1.0])
def test_parts_are_all_rows_whatever_is_missing(spark, share):
    df = spark.createDataFrame(outcome(spark), "key string, y double")
    split = stratified_split(df, "y", "key", share, 7)
    odd = df.union(spark.createDataFrame([(None, 4.0), ("x", None), (None, None)], df.schema))
    train, rest = split.train(odd), split.holdout(odd)
    assert train.count() + rest.count() == odd.count()
    assert train.intersect(rest).count() == 0


def test_a_share_of_nothing_takes_nothing(spark):
    df = spark.createDataFrame(outcome(spark), "key string, y double")
    split = stratified_split(df, "y", "key", 0.0, 7)
    assert split.train(df).count() == 0 and split.holdout(df).count() == N
    assert all(need == 0 for need, _ in split.rows.values())
    assert sum(total for _, total in split.rows.values()) == N
    for gap in [("x", None), (None, 4.0)]:
        with pytest.raises(ValueError, match="NULL"):
            stratified_split(df.union(spark.createDataFrame([gap], df.schema)), "y", "key", 0.0, 7)


def test_repeated_splits_equal_their_single_forms(spark):
    df = spark.createDataFrame(outcome(spark), "key string, y double")
    for share in (0.25, 0.0):
        together = stratified_splits(df, "y", "key", share, [1, 7, 3], finish_rows=40)
        assert together == [stratified_split(df, "y", "key", share, s, finish_rows=40) for s in (1, 7, 3)]
    with pytest.raises(ValueError, match="twice"):
        stratified_splits(df, "y", "key", 0.25, [1, 1])
    with pytest.raises(ValueError, match="not unique"):
        same = spark.createDataFrame([("a", float(i % 5)) for i in range(50)], "key string, y double")
        stratified_splits(same, "y", "key", 0.25, [1, 2])
