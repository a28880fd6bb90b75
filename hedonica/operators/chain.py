"""The chain of effects from a saved, mergeable state, without any pair on the driver.

All that the chain of effects needs of the rows are sums: for each pair of factors the rows per
pair of levels, for each factor the rows and the sum of y per level, and for all rows their
number, mean and squared deviations. These add up, so a slice of the data (a day, a load) is
scanned once, its sums are saved (``slices``), and a refit reads the sums of all slices. Sums of
y are taken from a fixed ``origin``, any number near the mean, so that little is lost by
cancellation; the deviations of slices are put together about the common mean.

The fit itself is a triangular recurrence: what is left of the sum of a level of factor k is its
own sum less, for every factor j before, the rows it shares with each level of j times that
level's effect. Here a step is a join of one effect table with the pairs of its factor and an
aggregation by level, on tables that stay distributed; only a few totals reach the driver. So
factors may have any number of levels, and the pairs any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from hedonica.functions.metrics import null_count
from hedonica.operators.effects import MAX_CELLS, Effect, EffectModel, pair_counts, sketched
from hedonica.session import settled, written
from hedonica.spread import HOT_ROWS, spread_lookup

# ``factor_j`` = ``factor_k`` has a factor's own sums; both NULL, the totals of the slice.
STATE = (
    "factor_j string, factor_k string, level_j string, level_k string, "
    "n bigint, s double, q double"
)


def moment_state(
    df: DataFrame, y: str, factors: Sequence[str], origin: float, max_cells: int = MAX_CELLS
) -> DataFrame:
    """The state of one slice; see ``STATE``. y must be finite. An empty slice has no rows.

    One scan sizes the factors and takes the totals, one counts the pairs. For factors of very
    many levels, each pair of factors is counted apart.
    """
    if len(set(factors)) != len(factors):
        raise ValueError("a factor is named twice")
    sizes = [F.hll_sketch_estimate(F.hll_sketch_agg(sketched(df, f))).alias(f"l{i}") for i, f in enumerate(factors)]
    odd = F.count_if(F.isnan(y) | (F.abs(F.col(y)) == math.inf))
    first = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("spread"),
        null_count(F.col(y)).alias("n_null"), odd.alias("n_odd"), *sizes,
    ).first()
    if first["n_null"] or first["n_odd"]:
        raise ValueError(f"{y} has {first['n_null'] + first['n_odd']} values that are missing or not finite")
    spark = df.sparkSession
    if not first["n"]:
        return spark.createDataFrame([], STATE)
    name = F.array(*[F.lit(f) for f in factors])
    levels = {f: (first[f"l{i}"] or 0) + 1 for i, f in enumerate(factors)}
    pairs = pair_counts(df, F.col(y) - F.lit(origin), factors, levels, max_cells).select(
        name[F.col("j")].alias("factor_j"), name[F.col("k")].alias("factor_k"), "level_j", "level_k",
        "n", F.when(F.col("j") == F.col("k"), F.col("s")).alias("s"), F.lit(None).cast("double").alias("q"),
    )
    n = first["n"]
    total = [(None, None, None, None, n, n * (first["mean"] - origin), n * first["spread"])]
    return pairs.union(spark.createDataFrame(total, STATE))


def merged(state: DataFrame) -> DataFrame:
    """States added up: a state again."""
    key = ["factor_j", "factor_k", "level_j", "level_k"]
    # deviations about the common mean: those about each slice's, and of the slices' means
    own_mean = F.col("s") * F.col("s") / F.col("n")
    summed = state.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("q") + own_mean).alias("q")
    )
    squares = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return summed.select(*key, "n", "s", F.when(F.col("q").isNotNull(), squares).alias("q"))


def _in_order(state: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``j, k, level_j, level_k, n, s`` with j <= k, the places of the two factors in the chain."""
    place = F.create_map(*[F.lit(x) for i, f in enumerate(factors) for x in (f, i)])
    at_j, at_k = place[F.col("factor_j")], place[F.col("factor_k")]
    turned = at_j > at_k

    def either(a: Column | str, b: Column | str) -> Column:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return F.when(turned, b).otherwise(a)

    return state.where(at_j.isNotNull() & at_k.isNotNull()).select(
        either(at_j, at_k).alias("j"), either(at_k, at_j).alias("k"),
        either("level_j", "level_k").alias("level_j"), either("level_k", "level_j").alias("level_k"),
        "n", "s",
    )


def fit_state(
    state: DataFrame, y: str, factors: Sequence[str], types: dict[str, DataType], origin: float,
    hot_rows: int = HOT_ROWS,
) -> EffectModel:
    """Fit the chain from the (saved) states of one or more slices.

    ``factors`` may be any of those in the state, in any order; ``types`` are theirs. The
    squared error after a step is the one before less the rows times the squared effects.
    """
    whole = written(merged(state), "moments")
    total = whole.where("factor_j IS NULL AND factor_k IS NULL").first()
    if total is None:
        raise ValueError("no rows to fit")
    n, mu, sse = total["n"], origin + total["s"] / total["n"], total["q"]
    naive = math.sqrt(sse / n)
    placed = _in_order(whole, factors)
    pairs = placed.where("j < k").select("j", "k", "level_j", "level_k", "n")
    left = placed.where("j = k").select(
        F.col("k").alias("of"), F.col("level_k").alias("level"), F.col("n").alias("rows"),
        (F.col("s") - F.col("n") * F.lit(mu - origin)).alias("left"),
    )
    effects = []
    for j, factor in enumerate(factors):
        left = written(left, "left")
        own = left.where(F.col("of") == j).select(
            "level", F.col("rows").alias("n"), (F.col("left") / F.col("rows")).alias("b")
        )
        found, small = settled(own, f"effect-{factor}")
        gone = found.agg(F.sum(F.col("n") * F.col("b") * F.col("b"))).first()[0]
        if gone is None:
            raise ValueError(f"the state has no factor {factor}")
        sse = max(sse - gone, 0.0)
        table = found.withColumn("level", F.col("level").cast(types[factor]))
        effects.append(Effect(factor, table, small, math.sqrt(sse / n)))
        if j + 1 == len(factors):
            break
        # what the steps after this one have to leave to it
        shared = pairs.where(F.col("j") == j).select("k", "level_j", "level_k", "n")
        known = found.select(F.col("level").alias("known"), "b")
        if small:
            on = shared["level_j"].eqNullSafe(known["known"])
            met = shared.join(F.broadcast(known), on)
        else:
            met = spread_lookup(shared, known, {"level_j": "known"}, "inner", hot_rows)
        taken = met.groupBy("k", "level_k").agg(F.sum(F.col("n") * F.col("b")).alias("taken"))
        rest = left.where(F.col("of") > j)
        on = (rest["of"] == taken["k"]) & rest["level"].eqNullSafe(taken["level_k"])
        left = rest.join(taken, on, "left").select(
            "of", "level", "rows", (F.col("left") - F.coalesce("taken", F.lit(0.0))).alias("left")
        )
    return EffectModel(y, n, mu, naive, "joined", effects)


def fit_joined(df: DataFrame, y: str, factors: Sequence[str], hot_rows: int = HOT_ROWS) -> EffectModel:
    """Fit the chain of one table, whatever the number of levels; the numbers of the other fits."""
    origin = df.agg(F.avg(y)).first()[0]
    if origin is None:
        raise ValueError(f"no values of {y} to fit")
    state = written(moment_state(df, y, factors, origin), "state")
    return fit_state(state, y, factors, {f: df.schema[f].dataType for f in factors}, origin, hot_rows)
