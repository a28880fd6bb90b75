"""The registered queries: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedonica import fixed_values as fixed
from hedonica.functions.metrics import null_count, rmse
from hedonica.functions.scalars import bucketize, day_of, dominant, number, weekday
from hedonica.operators import boxplot, chain, clean, diagnose, effects, histogram, profile, sketches
from hedonica.operators.split import stratified_splits
from hedonica.plans.workspace import KEY, PRED, Y, Workspace, rounded, workspace
from hedonica.session import literal_rows
from hedonica.slices import save_slice, saved_slices
from hedonica.sources.sales_csv import (
    good_rows, intake, read_checked, read_exported, read_sales, rejected_rows, write_csv,
)
from hedonica.sources.surrogate import as_sales_file
from hedonica.spread import spread_lookup

Query = Callable[[Workspace], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Query):
        return lambda spark, sf_dir: f(workspace(spark, sf_dir))

    return {name: bound(f) for name, f in _queries.items()}


# --- raw table ---------------------------------------------------------------------------


@query
def raw_profile(w: Workspace) -> DataFrame:
    return profile.overview(w.raw, day_of(F.col("sale_ts")), clean.price_amount())


@query
def unit_buckets(w: Workspace) -> DataFrame:
    res, com = F.col("res_units"), F.col("com_units")
    return (
        w.raw
        .select(
            bucketize(res, fixed.RES_UNIT_BUCKETS).alias("resunits"),
            bucketize(com, fixed.COM_UNIT_BUCKETS).alias("comunits"),
            dominant(res, com, "res", "com").alias("rescom"),
        )
        .groupBy("resunits", "comunits", "rescom")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def area_buckets(w: Workspace) -> DataFrame:
    land, gross = number(F.col("land_area")), number(F.col("gross_area"))
    return (
        w.raw
        .select(
            bucketize(land, fixed.AREA_BUCKETS).alias("landareacat"),
            bucketize(gross, fixed.AREA_BUCKETS).alias("grossareacat"),
            land.alias("land"),
            gross.alias("gross"),
        )
        .groupBy("landareacat", "grossareacat")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("land").alias("sum_land"),
            F.sum("gross").alias("sum_gross"),
        )
    )


@query
def date_parts(w: Workspace) -> DataFrame:
    sold = day_of(F.col("sale_ts"))
    return (
        w.raw
        .select(sold.alias("sold"), weekday(sold).alias("day"), F.month(sold).alias("month"))
        .groupBy("day", "month")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("sold").alias("first_day"),
            F.max("sold").alias("last_day"),
        )
    )


@query
def level_codes(w: Workspace) -> DataFrame:
    return profile.level_codes(
        w.raw, ["borough", "zip", "yr_built", "hood", "land_area", "gross_area", "bldg_class_sale"]
    )


# --- first and second cleaning -------------------------------------------------------------


@query
def level_counts(w: Workspace) -> DataFrame:
    return profile.level_counts(w.clean(), ["zip", "decade", "bldg_class"]).drop("n_rows")


@query
def frequency_decade(w: Workspace) -> DataFrame:
    return profile.frequency(w.clean(), "decade")


@query
def frequency_class(w: Workspace) -> DataFrame:
    return profile.frequency(w.clean(), "bldg_class")


@query
def frequent_classes(w: Workspace) -> DataFrame:
    """Sales of the classes with more than a fixed number of sales."""
    return (
        clean.keep_frequent(w.clean(), "bldg_class", fixed.CLASS_MIN_ROWS)
        .groupBy("bldg_class")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("sum_price"))
    )


@query
def tidy(w: Workspace) -> DataFrame:
    return rounded(w.tidy, logprice=6)


@query
def csv_ingest(w: Workspace) -> DataFrame:
    """Write the sales as a raw 22-column file, read it by position, clean it."""
    path = w.path("sales-file")
    write_csv(as_sales_file(w.raw), path)
    sales = read_sales(w.spark, path).withColumnRenamed("address", KEY)
    return rounded(clean.tidy(sales, [KEY]), logprice=6)


@query
def export_roundtrip(w: Workspace) -> DataFrame:
    """The tidy table with a text of quotes, commas and line breaks, written and read."""
    path = w.path("tidy-export")
    noted = w.tidy.withColumn("note", awkward_note())
    write_csv(noted, path)
    return rounded(read_exported(w.spark, path, noted.schema, multi_line=True), logprice=6)


def awkward_note() -> F.Column:
    """Built from given columns: what a CSV must quote, and a line break."""
    quoted = F.concat(F.lit('say "'), F.col("bldg_class"), F.lit('", '), F.col("day"))
    return F.when(F.col("borough") == 1, F.concat(quoted, F.lit("\nnext"))).otherwise(quoted)


@query
def schema_profile(w: Workspace) -> DataFrame:
    return profile.schema_profile(w.tidy.drop(KEY), fixed.FACTORS)


@query
def preview(w: Workspace) -> DataFrame:
    return rounded(profile.preview(w.tidy, KEY, 20), logprice=6)


@query
def heavy_levels(w: Workspace) -> DataFrame:
    """The levels that more than a fiftieth of the sales have, of columns with many levels."""
    return sketches.heavy_levels(w.raw, ["land_area", "gross_area", "zip", "bldg_class_sale"], 0.02)


def by_half_year(w: Workspace, rows: DataFrame) -> list[tuple[str, DataFrame]]:
    """Two loads: the sales of the first six months of any year, and the rest."""
    early = F.month(day_of(F.col("sale_ts"))) <= 6
    return [("1", rows.where(early)), ("2", rows.where(~early))]


@query
def growing_codes(w: Workspace) -> DataFrame:
    """Codes of two loads in a row: those of the first stay, new levels get the next ones."""
    columns, path = ["land_area", "hood", "yr_built", "bldg_class_sale"], w.path("codes")
    schema = "factor string, level string, code bigint"
    known = literal_rows(w.spark, [], schema)
    for name, rows in by_half_year(w, w.raw):
        save_slice(profile.new_codes(rows, columns, known), path, name)
        known = saved_slices(w.spark, path, schema).drop("slice")
    return saved_slices(w.spark, path, schema)


@query
def level_sketches(w: Workspace) -> DataFrame:
    """Numbers of levels from states of two loads, held against the exact ones."""
    columns, path = ["land_area", "gross_area", "hood", "zip", "yr_built"], w.path("level-states")
    for name, rows in by_half_year(w, w.raw):
        save_slice(sketches.level_state(rows, columns), path, name)
    state = sketches.merged_levels(saved_slices(w.spark, path, sketches.LEVEL_STATE))
    found = sketches.levels_of(state).withColumnRenamed("n_levels", "estimate")
    exact = profile.level_counts(w.raw, columns).select("factor", "n_levels")
    gap = F.abs(F.col("estimate") - F.col("n_levels"))
    within = gap <= 4 * sketches.level_error() * F.col("n_levels")
    return found.join(exact, "factor").select("factor", "n_filled", "n_levels", within.alias("within"))


def awkward_lines(w: Workspace) -> DataFrame:
    """The sales file as lines, some of them damaged: cut off, too long, with an open quote."""
    sales = as_sales_file(w.raw)
    line = F.to_csv(F.struct(*sales.columns), {"escape": '"', "nullValue": "NA"})
    kind = F.concat("borough", F.lit("/"), "tax_class_sale")
    damaged = (
        F.when(kind == "1/1", F.substring_index(line, ",", 20))
        .when(kind == "2/2", F.concat(line, F.lit(",more")))
        .when(kind == "3/3", F.concat(F.substring_index(line, ",", 21), F.lit(',"'), F.col("sale_ts")))
        .when(kind == "4/4", F.concat(F.lit('"'), line))
        .otherwise(line)
    )
    return sales.select(damaged.alias("value"))


@query
def csv_rejects(w: Workspace) -> DataFrame:
    """What reading a damaged file by position keeps and rejects, by reason."""
    path = w.path("damaged-file")
    awkward_lines(w).write.text(path)
    checked = read_checked(w.spark, path, fixed.RAW_COLUMNS, header=False)
    lines = intake(checked).agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_good", "n_rejected")])
    reasons = rejected_rows(checked).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    kept = good_rows(checked).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("zip").cast("bigint")).alias("sum_zip"))
    return (
        reasons.withColumn("sum_zip", F.lit(None).cast("bigint"))
        .union(kept.select(F.lit(None).cast("string"), "n", "sum_zip"))
        .join(F.broadcast(lines))
    )


# --- plot data -----------------------------------------------------------------------------


@query
def hist_price(w: Workspace) -> DataFrame:
    return rounded(histogram.histogram(w.tidy, F.col("price"), fixed.HISTOGRAM_BINS), lower=2)


@query
def hist_logprice(w: Workspace) -> DataFrame:
    return rounded(histogram.histogram(w.tidy, F.col(Y), fixed.HISTOGRAM_BINS), lower=6)


@query
def hist_abs_error(w: Workspace) -> DataFrame:
    low, high = (math.log10(v) for v in fixed.ERROR_LIMITS)
    error = F.log10("diff")
    return rounded(
        histogram.histogram(w.pairs, error, fixed.HISTOGRAM_BINS, low, high), lower=6
    )


@query
def box_stats(w: Workspace) -> DataFrame:
    stats = boxplot.box_stats(w.boxes)
    return rounded(stats, whisker_low=6, q1=6, median=6, q3=6, whisker_high=6)


@query
def box_outliers(w: Workspace) -> DataFrame:
    return rounded(boxplot.box_outliers(w.boxes), logprice=6)


@query
def quantile_sketches(w: Workspace) -> DataFrame:
    """Ends and size of each level from sketches of two halves, and whether the exact ranks of
    their quartiles are within the bound."""
    path, probs = w.path("quantile-states"), [0.25, 0.5, 0.75]
    for name, rows in (("1", w.tidy.where("month <= 6")), ("2", w.tidy.where("month > 6"))):
        save_slice(sketches.quantile_state(rows, Y, fixed.FACTORS), path, name)
    state = sketches.merged_quantiles(saved_slices(w.spark, path, sketches.QUANTILE_STATE))
    gaps = sketches.rank_gaps(w.tidy, Y, sketches.quantiles_of(state, probs), probs)
    ends = state.select(F.col("factor").alias("_f"), F.col("level").alias("_l"), "low", "high")
    on = (gaps["factor"] == ends["_f"]) & gaps["level"].eqNullSafe(ends["_l"])
    # twice the error that holds in 99 of 100 cases, as there are hundreds of cases
    within = F.array_max("gaps") <= 2 * sketches.rank_error()
    found = gaps.join(ends, on).select("factor", "level", "n", "low", "high", within.alias("within"))
    return rounded(found, low=6, high=6)


@query
def scatter_bins(w: Workspace) -> DataFrame:
    low, high = (math.log10(v) for v in fixed.SCATTER_LIMITS)
    return histogram.grid_counts(w.pairs, F.col(PRED), F.col(Y), low, high)


# --- split and model -----------------------------------------------------------------------


@query
def split_counts(w: Workspace) -> DataFrame:
    return (
        w.tidy.select(w.split.stratum().alias("stratum"), w.split.taken().alias("is_train"))
        .groupBy("stratum", "is_train")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def split_complete(w: Workspace) -> DataFrame:
    """Every sale lies in exactly one part: sales, those of each part, and of both."""
    parts = [(w.tidy, "n_rows"), (w.train(), "n_train"), (w.holdout(), "n_holdout")]
    names = [name for _, name in parts]
    counted = [
        df.select(KEY, *[F.lit(int(n == name)).cast("bigint").alias(n) for n in names])
        for df, name in parts
    ]
    per_key = (
        counted[0].union(counted[1]).union(counted[2])
        .groupBy(KEY).agg(*[F.sum(n).alias(n) for n in names])
    )
    both = F.count_if(F.col("n_train") + F.col("n_holdout") != F.col("n_rows"))
    return per_key.agg(*[F.sum(n).alias(n) for n in names], both.alias("n_wrong"))


@query
def repeated_splits(w: Workspace) -> DataFrame:
    """Three splits fitted together: the rows of each part, the taken keys' first and last."""
    made = stratified_splits(w.tidy, Y, KEY, fixed.TRAIN_SHARE, [1, 2, 3], fixed.STRATA)
    found = F.array(*[
        F.struct(F.lit(s.seed).alias("seed"), s.stratum().alias("stratum"), s.taken().alias("is_train"))
        for s in made
    ])
    return (
        w.tidy.select(KEY, F.explode(found).alias("s"))
        .groupBy("s.seed", "s.stratum", "s.is_train")
        .agg(F.count(F.lit(1)).alias("n"), F.min(KEY).alias("first_key"), F.max(KEY).alias("last_key"))
    )


@query
def train_keys(w: Workspace) -> DataFrame:
    return w.train().select(KEY)


@query
def mean_and_naive(w: Workspace) -> DataFrame:
    """The RMSE of predicting the mean is the population deviation: one scan for both."""
    scores = w.train().agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(Y).alias("mu"),
        F.stddev_pop(Y).alias("naive_rmse"),
    )
    return rounded(scores, mu=6, naive_rmse=6)


def effect_query(factor: str) -> Query:
    def run(w: Workspace) -> DataFrame:
        table = w.model.table(factor).withColumn("level", F.col("level").cast("string"))
        return rounded(table, b=6).orderBy("level")

    run.__name__ = f"effect_{factor}"
    return run


for _factor in fixed.FACTORS:
    query(effect_query(_factor))


@query
def borough_effect_single(w: Workspace) -> DataFrame:
    """The first step alone: mean residual per borough, in one aggregation."""
    residual = F.col(Y) - F.lit(w.model.mu)
    step = effects.fit_effect(w.train(), residual, "borough").drop("s2")
    return rounded(step.withColumn("level", F.col("level").cast("string")), b=6)


def effects_of(model: effects.EffectModel, digits: int) -> DataFrame:
    """``factor, level, n, b`` of all factors."""
    tables = [
        e.table.select(F.lit(e.factor).alias("factor"), F.col("level").cast("string").alias("level"), "n", "b")
        for e in model.effects
    ]
    return rounded(reduce(DataFrame.union, tables), b=digits)


# Any number near the mean; it must stay the same for all slices of a state.
ORIGIN = 5.0


@query
def refit_state(w: Workspace) -> DataFrame:
    """The effects from saved sums of eleven months and those of the twelfth, added later."""
    path, train = w.path("moments"), w.train()
    for name, rows in (("old", train.where("month < 12")), ("new", train.where("month = 12"))):
        save_slice(chain.moment_state(rows, Y, fixed.FACTORS, ORIGIN), path, name)
    state = saved_slices(w.spark, path, chain.STATE)
    types = {f: w.tidy.schema[f].dataType for f in fixed.FACTORS}
    return effects_of(chain.fit_state(state, Y, fixed.FACTORS, types, ORIGIN), 9)


@query
def fit_wide(w: Workspace) -> DataFrame:
    """Effects of factors with thousands of levels; their pairs stay distributed."""
    return effects_of(w.wide_model, 6)


@query
def score_wide(w: Workspace) -> DataFrame:
    """Scores from lookup tables that aren't broadcast; frequent keys are dealt to salts."""
    rows, model = w.wide(), w.wide_model
    out, total = rows, F.lit(model.mu)
    for i, e in enumerate(model.effects):
        named = e.table.select(F.col("level").alias(f"_l{i}"), F.col("b").alias(f"_b{i}"))
        out = spread_lookup(out, named, {e.factor: f"_l{i}"}, hot_rows=200, counted=rows)
        total = total + F.col(f"_b{i}")
    scores = out.groupBy("hood").agg(
        F.count(F.lit(1)).alias("n"), F.avg(total).alias("mean_pred"), rmse(F.col(Y), total, "propagate").alias("rmse")
    )
    return rounded(scores, mean_pred=6, rmse=6)


@query
def model_comparison(w: Workspace) -> DataFrame:
    table = effects.comparison(w.spark, w.model, fixed.MODEL_NAMES, w.holdout())
    return rounded(table, rmse=6, holdout_rmse=6)


@query
def predict_unseen(w: Workspace) -> DataFrame:
    """Scores of all sales before the second cleaning: some levels are not in the fit."""
    scored = effects.predict(clean.with_log_price(w.clean()), w.model, PRED)
    y, pred = F.col(Y), F.col(PRED)
    return rounded(
        scored.agg(
            F.count(F.lit(1)).alias("n"),
            null_count(pred).alias("n_null_pred"),
            rmse(y, pred, "propagate").alias("rmse_all"),
            rmse(y, pred, "skip").alias("rmse_scored"),
        ),
        rmse_all=6, rmse_scored=6,
    )


@query
def predict_validation(w: Workspace) -> DataFrame:
    return rounded(w.scored().select(KEY, PRED), pred_price=6)


# --- judging the predictions ---------------------------------------------------------------


@query
def valcomp(w: Workspace) -> DataFrame:
    return rounded(w.pairs, logprice=6, pred_price=6, diff=2, price=2, pred=2)


@query
def price_se(w: Workspace) -> DataFrame:
    errors = w.judgement.select("mean_price", "sd_price", "n_price", "se1", "se2")
    return rounded(errors, mean_price=4, sd_price=4, se1=4, se2=4)


@query
def se_coverage(w: Workspace) -> DataFrame:
    return rounded(
        diagnose.coverage(w.pairs, "diff", *w.standard_errors()), within_1se=6, within_2se=6
    )


LINE_COLUMNS = [
    "n", "slope", "intercept", "r2", "adj_r2", "rse", "se_slope", "se_intercept",
    "t_slope", "t_intercept", "f_line",
]


def rounded_line(df: DataFrame, columns: list[str]) -> DataFrame:
    return rounded(df.select(*columns), **{c: 6 for c in columns if c != "n"})


@query
def regression(w: Workspace) -> DataFrame:
    summary = diagnose.line_summary(w.pairs, Y, PRED, w.judgement)
    return rounded_line(summary, LINE_COLUMNS + diagnose.FIVE_NUMBERS)


@query
def regression_plotted(w: Workspace) -> DataFrame:
    columns = ["n", "slope", "intercept", "r2"]
    plotted = w.judgement.select(*[F.col(diagnose.PLOTTED + c).alias(c) for c in columns])
    return rounded_line(plotted, columns)


@query
def slope_test(w: Workspace) -> DataFrame:
    return rounded_line(w.judgement, ["n", "slope", "f_slope_is_one"])


@query
def regression_tails(w: Workspace) -> DataFrame:
    out = diagnose.line_tails(w.judgement)
    return rounded(out, **{c: 6 for c in out.columns})
