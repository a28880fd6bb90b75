"""A reproducible random split, stratified on the quantiles of a numeric outcome.

Every row draws a number from its key alone, so the split does not depend on how the data
is partitioned. In each stratum exactly ceil(share * rows) rows with the smallest draws are
taken. Selecting them needs only counts per leading draw digits and a ranking of the few
rows around the cut; afterwards the split is a plain filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hedonica.operators.quantiles import BINS, FINISH_ROWS, exact_quantiles

# Leading hexadecimal digits by which draws are counted, and rows wanted per count.
DIGITS = 4
ROWS_PER_COUNT = 1000


def by_stratum(y: Column, cuts: Sequence[float], results: Sequence) -> Column:
    """The result of the stratum of y: first up to the first cut, and so on.

    Cuts belong to the stratum below; a missing y has no stratum.
    """
    bounds = [y <= cut for cut in cuts] + [y.isNotNull()]
    out = None
    for bound, result in zip(bounds, results):
        out = (F if out is None else out).when(bound, result)
    return out


def stratum_of(y: Column, cuts: Sequence[float]) -> Column:
    return by_stratum(y, cuts, range(1, len(cuts) + 2))


def draw_of(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


@dataclass(frozen=True)
class Split:
    """The rule of a fitted split: strata cuts and the last draw taken in each stratum."""

    y: str
    key: str
    seed: int
    cuts: tuple[float, ...]
    last_draw: dict[int, str]
    rows: dict[int, tuple[int, int]]

    def stratum(self) -> Column:
        return stratum_of(F.col(self.y), self.cuts)

    def taken(self) -> Column:
        draw = draw_of(F.col(self.key), self.seed)
        strata = range(1, len(self.cuts) + 2)
        taken = [draw <= self.last_draw[s] if s in self.last_draw else F.lit(False) for s in strata]
        return by_stratum(F.col(self.y), self.cuts, taken)

    def train(self, df: DataFrame) -> DataFrame:
        return df.where(self.taken())

    def holdout(self, df: DataFrame) -> DataFrame:
        """The exact complement of ``train``, whatever is NULL."""
        return df.where(~F.coalesce(self.taken(), F.lit(False)))


def stratified_split(
    df: DataFrame,
    y: str,
    key: str,
    share: float,
    seed: int,
    strata: int = 4,
    finish_rows: int = FINISH_ROWS,
    bins: int = BINS,
) -> Split:
    """Fit the split. ``key`` must be unique; neither it nor ``y`` may be NULL."""
    return stratified_splits(df, y, key, share, [seed], strata, finish_rows, bins)[0]


def stratified_splits(
    df: DataFrame,
    y: str,
    key: str,
    share: float,
    seeds: Sequence[int],
    strata: int = 4,
    finish_rows: int = FINISH_ROWS,
    bins: int = BINS,
) -> list[Split]:
    """A split for each seed, as ``stratified_split`` fits it, from the same scans.

    All draws of a row are counted together, so repeated splits cost the scans of one.
    """
    if len(set(seeds)) != len(seeds):
        raise ValueError("a seed is given twice")
    probs = [i / strata for i in range(1, strata)]
    quantiles = exact_quantiles(df, y, probs, bins=bins, finish_rows=finish_rows).first()
    if quantiles is None:
        raise ValueError(f"no values of {y} to split on")
    cuts = tuple(sorted(set(quantiles["q"])))
    draws = F.array(*[
        F.struct(F.lit(i).alias("at"), draw_of(F.col(key), seed).alias("draw"))
        for i, seed in enumerate(seeds)
    ])
    rows = df.select(stratum_of(F.col(y), cuts).alias("stratum"), F.explode(draws).alias("d")).select(
        "d.at", "stratum", "d.draw"
    )

    depth = 1
    while depth < DIGITS and quantiles["n"] > strata * ROWS_PER_COUNT * 16**depth:
        depth += 1
    counts = rows.groupBy("at", "stratum", F.substring("draw", 1, depth).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = Window.partitionBy("at", "stratum")
    upto = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    reaches = (F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("n"))
    found = (
        counts.withColumn("total", total)
        .withColumn("need", F.ceil(F.lit(share) * F.col("total")).cast("bigint"))
        .withColumn("before", F.sum("n").over(upto) - F.col("n"))
        # the first count of a stratum too: it has the sizes, whether a row is needed or not
        .where(reaches | (F.col("before") == 0) | F.col("prefix").isNull())
        .select("at", "stratum", "prefix", "n", "total", "need", "before")
        .collect()
    )
    if any(r["prefix"] is None for r in found):
        raise ValueError(f"{key} has NULL values")
    if any(r["stratum"] is None for r in found):
        raise ValueError(f"{y} has NULL or NaN values")
    sizes: list[dict] = [{} for _ in seeds]
    for r in sorted(found, key=lambda r: r["stratum"]):
        sizes[r["at"]][r["stratum"]] = (r["need"], r["total"])
    cut = {(r["at"], r["stratum"]): r for r in found if r["before"] < r["need"] <= r["before"] + r["n"]}
    if not cut:
        return [Split(y, key, seed, cuts, {}, size) for seed, size in zip(seeds, sizes)]

    def of(at: int, stratum: int) -> Column:
        return (F.col("at") == at) & (F.col("stratum") == stratum)

    def at_cut() -> Column:
        return reduce(
            lambda a, b: a | b,
            [of(*s) & F.col("draw").startswith(r["prefix"]) for s, r in cut.items()],
        )

    def still_needed() -> Column:
        out = None
        for s, r in cut.items():
            out = (F if out is None else out).when(of(*s), r["need"] - r["before"])
        return out

    while max(r["n"] for r in cut.values()) > finish_rows and depth < 32:
        depth += DIGITS
        finer = (
            rows.where(at_cut())
            .groupBy("at", "stratum", F.substring("draw", 1, depth).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.sum("n").over(upto) - F.col("n"))
            .withColumn("need", still_needed())
            .where((F.col("before") < F.col("need"))
                   & (F.col("need") <= F.col("before") + F.col("n")))
        )
        cut = {(r["at"], r["stratum"]): r for r in finer.collect()}

    if max(r["n"] for r in cut.values()) > finish_rows:
        raise ValueError(f"{key} is not unique")
    ordered = whole.orderBy("draw")
    ends = (
        rows.where(at_cut())
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("next", F.lead("draw").over(ordered))
        .where(F.col("place") == still_needed())
        .collect()
    )
    if any(r["draw"] == r["next"] for r in ends):
        raise ValueError(f"{key} is not unique")
    last: list[dict] = [{} for _ in seeds]
    for r in sorted(ends, key=lambda r: r["stratum"]):
        last[r["at"]][r["stratum"]] = r["draw"]
    return [Split(y, key, *each) for each in zip(seeds, [cuts] * len(seeds), last, sizes)]
