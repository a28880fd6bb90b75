"""A forward chain of additive category effects: fit, score, compare.

Effect k is the mean, per level of factor k, of what the mean and the effects before leave
unexplained. Order matters, nothing is refitted. NULL is a level; a level not seen in the
fit has no effect, so its prediction is NULL.

Three fits give the same numbers, the two here and the one of ``chain``, which keeps the pairs
distributed:

* ``moments``: the chain needs only, for each pair of factors, the row counts per pair of
  levels, and the sums of y per level. Both come from one scan. Factors are put in blocks,
  so that one row updates one counter per pair of blocks instead of one per pair of
  factors, and each counter table stays small enough to be combined map-side.
  The error after step k is the error before less the rows times the squared effects, so a
  fit without any error left shows rounding noise of about 1e-8 instead of zero.
* ``stepwise``: one aggregation and one lookup join per factor, for factors with more
  levels than a pair table may hold. The caller says which of the two it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate, combinations
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from hedonica.functions.metrics import null_count, rmse
from hedonica.session import literal_rows, lookup, settled, written
from hedonica.spread import spread_lookup

# Pair counting brings at most this many pair counts to the driver (of 1,448 levels in all,
# at the worst); it takes as many factors as a grouping id has bits. Beyond, it refuses.
MAX_PAIRS = 1 << 20
MAX_FACTORS = 60
# Wanted bound on the counters of one pair of blocks. Larger blocks update fewer counters per
# row, but a task shuffles up to that many counters per pair of blocks.
MAX_CELLS = 5_000


@dataclass(frozen=True)
class Effect:
    """Effects of one factor: a table (level, n, b), and whether it is proven small."""

    factor: str
    table: DataFrame
    small: bool
    rmse: float


@dataclass(frozen=True)
class EffectModel:
    y: str
    n: int
    mu: float
    naive_rmse: float
    method: str
    effects: list[Effect] = field(default_factory=list)

    def rmses(self) -> list[float]:
        """In-sample RMSE of the mean alone, then with one more factor each."""
        return [self.naive_rmse, *[e.rmse for e in self.effects]]

    def table(self, factor: str) -> DataFrame:
        return next(e.table for e in self.effects if e.factor == factor)


def fit_effect(df: DataFrame, residual: Column, factor: str) -> DataFrame:
    """(level, n, b, s2): rows, mean residual and sum of squares per level of one factor."""
    return df.groupBy(F.col(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(residual).alias("b"),
        F.sum(residual * residual).alias("s2"),
    )


def blocks_of(sizes: dict[str, int], max_cells: int = MAX_CELLS) -> list[list[str]]:
    """Fewest balanced blocks such that two blocks span at most ``max_cells`` cells."""
    largest_first = sorted(sizes, key=lambda f: -sizes[f])
    for m in range(1, len(sizes) + 1):
        blocks: list[list[str]] = [[] for _ in range(m)]
        for f in largest_first:
            min(blocks, key=lambda b: math.prod(sizes[x] for x in b)).append(f)
        cells = sorted(math.prod(sizes[x] for x in b) for b in blocks)
        if math.prod(cells[-2:]) <= max_cells:
            break
    return [b for b in blocks if b]


def pair_counts(
    df: DataFrame, value: Column, factors: Sequence[str], sizes: dict[str, int],
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(j, k, level_j, level_k, n, s) for j <= k: rows and sums of value per pair of levels.

    ``j`` and ``k`` are places in ``factors``; j = k gives the levels of one factor. Every
    pair is counted in one set of factors only.
    """
    blocks = blocks_of(sizes, max_cells)
    unions = [a + b for a, b in combinations(blocks, 2)] or [blocks[0]]
    place = {f: i for i, f in enumerate(factors)}
    pairs_of: list[list[tuple[int, int]]] = []
    done: set[tuple[int, int]] = set()
    for union in unions:
        at = sorted(place[f] for f in union)
        new = [(j, k) for j in at for k in at if j <= k and (j, k) not in done]
        done.update(new)
        pairs_of.append(new)

    rows = df.select(*[F.col(f).cast("string").alias(f) for f in factors], value.alias("_r"))
    sets = [sorted(u, key=place.__getitem__) for u in unions]
    cells = rows.groupingSets(sets, *factors).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_s")
    )

    last = len(factors) - 1
    listed = []
    for columns, pairs in zip(sets, pairs_of):
        # The grouping id has one bit per factor, set where the factor is rolled up.
        number = sum(1 << (last - place[f]) for f in factors if f not in columns)
        listed += [(number, j, k) for j, k in pairs]
    pairs = literal_rows(df.sparkSession, listed, "_of bigint, j int, k int")
    levels = F.array(*factors)
    return (
        cells.select("_set", levels.alias("_levels"), "_n", "_s")
        .join(F.broadcast(pairs), F.col("_set") == F.col("_of"))
        .select(
            "j", "k", F.col("_levels")[F.col("j")].alias("level_j"),
            F.col("_levels")[F.col("k")].alias("level_k"), "_n", "_s",
        )
        .groupBy("j", "k", "level_j", "level_k")
        .agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
    )


def _fit_moments(
    df: DataFrame, y: str, factors: Sequence[str], n: int, mu: float, sse: float,
    sizes: dict[str, int],
) -> list[Effect]:
    types: dict[str, DataType] = {f: df.schema[f].dataType for f in factors}
    own: list[dict] = [{} for _ in factors]
    shared: dict[tuple[int, int], list] = {}
    counted = pair_counts(df, F.col(y) - F.lit(mu), factors, sizes).limit(MAX_PAIRS + 1).collect()
    if len(counted) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of levels; fit with method='stepwise' or chain.fit_joined")
    for r in counted:
        if r["j"] == r["k"]:
            own[r["k"]][r["level_k"]] = (r["n"], r["s"])
        else:
            shared.setdefault((r["j"], r["k"]), []).append((r["level_j"], r["level_k"], r["n"]))

    spark = df.sparkSession
    b: list[dict] = []
    out = []
    for k, factor in enumerate(factors):
        left = {level: s for level, (_, s) in own[k].items()}
        for j in range(k):
            for level_j, level_k, rows in shared[(j, k)]:
                left[level_k] -= rows * b[j][level_j]
        b.append({level: left[level] / rows for level, (rows, _) in own[k].items()})
        sse = max(sse - sum(rows * b[k][level] ** 2 for level, (rows, _) in own[k].items()), 0.0)
        table = literal_rows(
            spark,
            [(level, rows, b[k][level]) for level, (rows, _) in own[k].items()],
            "level string, n bigint, b double",
        ).withColumn("level", F.col("level").cast(types[factor]))
        out.append(Effect(factor, table, True, math.sqrt(sse / n)))
    return out


def _fit_stepwise(
    df: DataFrame, y: str, factors: Sequence[str], n: int, mu: float, cut_every: int = 4
) -> list[Effect]:
    left = df.select(*factors, (F.col(y) - F.lit(mu)).alias("_r"))
    out = []
    since_cut = 0
    for factor in factors:
        table, small = settled(fit_effect(left, F.col("_r"), factor), f"effect-{factor}")
        gone = F.col("s2") - F.col("n") * F.col("b") * F.col("b")
        sse = max(table.agg(F.sum(gone)).first()[0], 0.0)
        out.append(Effect(factor, table.select("level", "n", "b"), small, math.sqrt(sse / n)))
        named = table.select(F.col("level").alias("_level"), F.col("b").alias("_b"))
        left = (
            lookup(left, named, {factor: "_level"}, small)
            .withColumn("_r", F.col("_r") - F.col("_b"))
            .drop("_b", factor)
        )
        since_cut += 1
        if not small or since_cut == cut_every:
            left, since_cut = written(left, "residual"), 0
    return out


def sketched(df: DataFrame, column: str) -> Column:
    """The column in a type that distinct-count sketches take."""
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind in ("int", "bigint", "string") else F.col(column).cast("string")


def fit_chain(
    df: DataFrame,
    y: str,
    factors: Sequence[str],
    method: str = "moments",
) -> EffectModel:
    """Fit the mean of ``y`` and one effect per factor, in the order given.

    ``moments`` refuses factors with too many pairs of levels; ``stepwise`` takes any.
    """
    if len(set(factors)) != len(factors):
        raise ValueError("a factor is named twice")
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        null_count(F.col(y)).alias("n_null"),
        F.count_if(F.isnan(F.col(y)) | (F.abs(F.col(y)) == math.inf)).alias("n_odd"),
        F.avg(y).alias("mu"),
        F.var_pop(y).alias("spread"),
        *[
            F.hll_sketch_estimate(F.hll_sketch_agg(sketched(df, f))).alias(f"levels_{i}")
            for i, f in enumerate(factors)
        ],
    ).first()
    if first["n"] == 0:
        raise ValueError("no rows to fit")
    if first["n_null"]:
        raise ValueError(f"{y} has {first['n_null']} NULL values")
    if first["n_odd"]:
        raise ValueError(f"{y} has {first['n_odd']} values that are not finite")
    # One more for a NULL level.
    sizes = {f: (first[f"levels_{i}"] or 0) + 1 for i, f in enumerate(factors)}
    n, mu, sse = first["n"], first["mu"], first["spread"] * first["n"]
    if method == "moments":
        if len(factors) > MAX_FACTORS:
            raise ValueError(f"more than {MAX_FACTORS} factors; fit with method='stepwise'")
        effects = _fit_moments(df, y, factors, n, mu, sse, sizes)
    elif method == "stepwise":
        effects = _fit_stepwise(df, y, factors, n, mu)
    else:
        raise ValueError("method must be 'moments' or 'stepwise'")
    return EffectModel(y, n, mu, math.sqrt(sse / n), method, effects)


def with_effects(df: DataFrame, model: EffectModel) -> tuple[DataFrame, list[Column]]:
    """Join each factor's effect; also the expressions of the effects, in order."""
    out = df
    for i, e in enumerate(model.effects):
        named = e.table.select(F.col("level").alias(f"_level{i}"), F.col("b").alias(f"_b{i}"))
        keys = {e.factor: f"_level{i}"}
        out = lookup(out, named, keys, True) if e.small else spread_lookup(out, named, keys, counted=df)
    return out, [F.col(f"_b{i}") for i in range(len(model.effects))]


def predict(df: DataFrame, model: EffectModel, name: str = "pred") -> DataFrame:
    """Add the prediction; NULL where a level was not seen in the fit."""
    joined, effects = with_effects(df, model)
    total = list(accumulate([F.lit(model.mu), *effects], add))[-1]
    return joined.select(*[df[c] for c in df.columns], total.alias(name))


def scores_by_step(
    df: DataFrame, model: EffectModel, nulls: str = "propagate"
) -> tuple[list[float], list[int]]:
    """RMSE on other rows, and rows without a prediction, of the mean alone and with one more
    factor each: one scan."""
    joined, effects = with_effects(df, model)
    partial = list(accumulate([F.lit(model.mu), *effects], add))
    errors = [rmse(F.col(model.y), p, nulls).alias(f"r{i}") for i, p in enumerate(partial)]
    missing = [null_count(p).alias(f"n{i}") for i, p in enumerate(partial)]
    row = list(joined.agg(*errors, *missing).first())
    return row[: len(partial)], row[len(partial) :]


def rmse_by_step(df: DataFrame, model: EffectModel, nulls: str = "propagate") -> list[float]:
    return scores_by_step(df, model, nulls)[0]


def comparison(
    spark: SparkSession, model: EffectModel, names: Sequence[str], holdout: DataFrame | None = None
) -> DataFrame:
    """(step, model, rmse, holdout_rmse, n_unscored): a row per model, from the mean on.

    ``n_unscored`` counts the hold-out rows with a level that the fit has not seen; their
    RMSE is NULL then.
    """
    other, unscored = [None] * len(names), [None] * len(names)
    if holdout is not None:
        other, unscored = scores_by_step(holdout, model)
    return literal_rows(
        spark,
        list(zip(range(len(names)), names, model.rmses(), other, unscored)),
        "step int, model string, rmse double, holdout_rmse double, n_unscored bigint",
    )
