"""Exact quantiles of any number of groups, without gathering a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here a first pass counts the rows of each group per narrow bin (combined map-side) and
keeps only the bins that hold a wanted rank. Later passes cut those bins finer, until few
rows are left in them; then their distinct values are counted and ranked. All results are
exact, with linear interpolation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hedonica.session import lookup, settled

BINS = 1024
# Rows left in all bins that hold a wanted rank, below which they are ranked directly.
FINISH_ROWS = 100_000


def rank_places(probs: Sequence[float], n: Column) -> list[tuple[Column, Column, Column]]:
    """Per probability: the rank below, the rank above, and the way between them."""
    out = []
    for p in probs:
        at = F.lit(float(p)) * (n - 1)
        below = F.floor(at).cast("bigint")
        out.append((below, F.least(below + 1, n - 1), at - below))
    return out


def cell(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a value within [low, high]; never falls as the value grows."""
    way = F.try_divide(value - low, high - low)
    return F.coalesce(F.least(F.floor(way * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def counted(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )


def before(group: Sequence[str], order: str) -> Column:
    """Rows in the cuts before this one."""
    upto = Window.partitionBy(*group).orderBy(order)
    return F.sum("_rows").over(
        upto.rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("_rows")


def holding_ranks(cuts: DataFrame) -> DataFrame:
    """The cuts that hold a wanted rank, with those ranks only."""
    first, past = F.col("_below"), F.col("_below") + F.col("_rows")
    return cuts.withColumn(
        "_ranks", F.filter("_ranks", lambda r: (r >= first) & (r < past))
    ).where(F.size("_ranks") > 0)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    bins: int = BINS,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """One row per group: its columns, n, and ``q``, the quantiles in order of ``probs``.

    NULL values are left out; a NULL group is a group. Values must be finite.
    """
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    group = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    span = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    if span["lo"] is not None and not math.isfinite(span["hi"] - span["lo"]):
        raise ValueError(f"{value} has NaN or infinite values")
    low, high = F.lit(span["lo"]).cast("double"), F.lit(span["hi"]).cast("double")
    rows = rows.withColumn("_bin", cell(F.col("_v"), low, high, bins))
    places = rank_places(probs, F.col("n"))
    wanted = F.array_distinct(F.array(*[r for below, above, _ in places for r in (below, above)]))

    # An interval is a cut of one group that holds wanted ranks; ``_below`` of the group's
    # rows come before it.
    state = [*keys, "n", "_bin", "_lo", "_hi", "_below", "_rows", "_ranks"]
    cuts = (
        counted(rows, *keys, "_bin")
        .withColumn("n", F.sum("_rows").over(Window.partitionBy(*keys)))
        .withColumn("_below", before(keys, "_bin"))
        .withColumn("_ranks", wanted)
    )
    found = []
    while True:
        numbered = holding_ranks(cuts).select(
            *state, F.monotonically_increasing_id().alias("_id")
        )
        intervals, small = settled(numbered, "quantile-intervals")
        found.append(intervals.where("_lo = _hi").select(*keys, "n", "_lo", "_ranks"))
        left = intervals.where("_lo < _hi")
        sizes = left.select("_rows") if small else left.agg(F.sum("_rows"))
        size = sum(r[0] or 0 for r in sizes.collect())
        if size == 0:
            break
        if small:
            # Bins are numbered alike for all groups, so this reaches the scan's rows
            # before they are spread over groups; at most ``bins`` numbers are listed.
            held = left.select("_bin", "_lo", "_hi").collect()
            hit = sorted({r["_bin"] for r in held})
            rows = rows.where(F.col("_bin").isin(*hit))
            # The plain range lets the scan skip row groups.
            least, most = min(r["_lo"] for r in held), max(r["_hi"] for r in held)
            rows = rows.where(F.col("_v").between(least, most))
        named = left.withColumnsRenamed({k: f"{k}_of" for k in [*keys, "_bin"]})
        inside = (rows["_v"] >= left["_lo"]) & (rows["_v"] <= left["_hi"])
        near = lookup(
            rows,
            named.select(*[f"{k}_of" for k in [*keys, "_bin"]], "_id", "_lo", "_hi"),
            {k: f"{k}_of" for k in [*keys, "_bin"]},
            small,
            "inner",
            inside,
        )
        if size <= finish_rows:
            cut = F.col("_v")
        else:
            cut = cell(F.col("_v"), F.col("_lo"), F.col("_hi"), bins)
        finer = counted(near, "_id", cut.alias("_cut")).withColumn(
            "_before", before(["_id"], "_cut")
        )
        whole = left.select(*keys, "n", "_bin", "_below", "_ranks", F.col("_id").alias("_of"))
        cuts = lookup(finer, whole, {"_id": "_of"}, small, "inner").withColumn(
            "_below", F.col("_below") + F.col("_before")
        )

    ranked = found[0]
    for part in found[1:]:
        ranked = ranked.unionByName(part)
    # At most two ranks per probability and group are brought together.
    at_rank = (
        ranked.select(*keys, "n", "_lo", F.explode("_ranks").alias("_rank"))
        .groupBy(*keys, "n")
        .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))
    )
    q = [
        F.element_at("_at", below)
        + (F.element_at("_at", above) - F.element_at("_at", below)) * way
        for below, above, way in places
    ]
    return at_rank.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)], "n", F.array(*q).alias("q")
    )
