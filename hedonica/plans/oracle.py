"""The registered queries as plain SQL over the given tables, for checking.

Written apart from the library on purpose: the chain is fitted with window averages, the
split with a row number over all draws, quantiles with ``quantile_cont``.
"""

from __future__ import annotations

from hedonica import fixed_values as fixed

RAW = """
sales_raw AS (
  SELECT concat_ws('|', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar),
                   cast(l_partkey AS varchar), cast(l_suppkey AS varchar),
                   cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar)) AS row_key,
         r_regionkey + 1 AS borough, n_name AS hood, 10000 + n_nationkey AS zip,
         CASE WHEN l_partkey % 4 = 3 THEN cast(l_quantity AS int) % 4
              ELSE cast(l_quantity AS int) + l_linenumber - 2 END AS res_units,
         l_linenumber - 1 AS com_units,
         CASE WHEN l_suppkey % 10 = 0 THEN ' -  ' WHEN l_partkey % 20 = 0 THEN '0'
              ELSE cast((l_partkey * 37) % 6000 AS varchar) END AS land_area,
         CASE WHEN l_suppkey % 10 = 1 THEN ' -  ' WHEN l_orderkey % 25 = 0 THEN '0'
              ELSE cast((l_orderkey * 53) % 6000 AS varchar) END AS gross_area,
         CASE WHEN p_size = 1 THEN 0 ELSE 1870 + 3 * p_size END AS yr_built,
         cast(l_suppkey % 4 + 1 AS int) AS tax_class_sale,
         concat(chr(cast(65 + l_partkey % 26 AS int)), cast(p_size % 10 AS varchar))
           AS bldg_class_sale,
         CASE WHEN l_discount < 0.005 THEN ' -  '
              WHEN l_tax > 0.075 AND l_linenumber = 7 THEN '2210000000'
              ELSE cast(cast(floor(l_extendedprice) AS bigint) AS varchar) END AS price,
         l_shipdate AS sale_ts
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

CLEAN = RAW + """,
sales_typed AS (
  SELECT *, try_cast(price AS double) AS amount, try_cast(land_area AS double) AS la,
         try_cast(gross_area AS double) AS ga FROM sales_raw),
sales_cat AS (
  SELECT row_key, cast(borough AS int) AS borough, cast(zip AS int) AS zip, amount AS price,
         CASE WHEN res_units = 0 THEN '0' WHEN res_units = 1 THEN '1'
              WHEN res_units = 2 THEN '2' WHEN res_units = 3 THEN '3'
              WHEN res_units BETWEEN 4 AND 10 THEN '4:10'
              WHEN res_units BETWEEN 11 AND 50 THEN '11:50'
              WHEN res_units >= 51 THEN '51+' END AS resunits,
         CASE WHEN com_units = 0 THEN '0' WHEN com_units = 1 THEN '1'
              WHEN com_units = 2 THEN '2' WHEN com_units = 3 THEN '3'
              WHEN com_units >= 4 THEN '4+' END AS comunits,
         CASE WHEN res_units >= com_units THEN 'res'
              WHEN res_units < com_units THEN 'com' END AS rescom,
         CASE WHEN la = 0 THEN '0' WHEN la > 0 AND la <= 2000 THEN '1:2000'
              WHEN la > 2000 AND la <= 4000 THEN '2001:4000'
              WHEN la > 4000 THEN '4000+' END AS landareacat,
         CASE WHEN ga = 0 THEN '0' WHEN ga > 0 AND ga <= 2000 THEN '1:2000'
              WHEN ga > 2000 AND ga <= 4000 THEN '2001:4000'
              WHEN ga > 4000 THEN '4000+' END AS grossareacat,
         cast(yr_built - yr_built % 10 AS int) AS decade,
         tax_class_sale AS tax_class, substr(bldg_class_sale, 1, 1) AS bldg_class,
         dayname(sale_ts) AS day, cast(month(sale_ts) AS int) AS month,
         la, ga, cast(sale_ts AS date) AS sold
  FROM sales_typed),
clean AS (SELECT * FROM sales_cat WHERE price >= 10000 AND price < 1000000000)"""

TIDY = CLEAN + """,
tidy AS (
  SELECT row_key, borough, price, resunits, comunits, rescom, landareacat, grossareacat,
         decade, tax_class, bldg_class, day, month, log10(price) AS logprice
  FROM clean
  WHERE decade >= 1890
    AND bldg_class IN ('A','B','C','D','E','F','G','H','K','O','R','S','V'))"""

SPLIT = TIDY + """,
cuts AS (
  SELECT quantile_cont(logprice, 0.25) AS q1, quantile_cont(logprice, 0.5) AS q2,
         quantile_cont(logprice, 0.75) AS q3 FROM tidy),
strata AS (
  SELECT tidy.*, CASE WHEN logprice <= q1 THEN 1 WHEN logprice <= q2 THEN 2
                      WHEN logprice <= q3 THEN 3 ELSE 4 END AS stratum
  FROM tidy, cuts),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('1|' || row_key))
              <= ceil(0.25 * count(*) OVER (PARTITION BY stratum)) AS is_train
  FROM strata),
train AS (SELECT * FROM drawn WHERE is_train),
holdout AS (SELECT * FROM drawn WHERE NOT is_train),
mean AS (SELECT avg(logprice) AS mu FROM train)"""


def _chain() -> str:
    """Residual after each step, by window averages over the rows themselves."""
    out = SPLIT + ",\nc0 AS (SELECT train.*, mu, logprice - mu AS r0 FROM train, mean)"
    for k, factor in enumerate(fixed.FACTORS, start=1):
        out += (
            f",\nc{k} AS (SELECT *, r{k - 1} - avg(r{k - 1}) OVER (PARTITION BY {factor}) AS r{k}"
            f" FROM c{k - 1})"
        )
    last = len(fixed.FACTORS)
    for k, factor in enumerate(fixed.FACTORS, start=1):
        out += (
            f",\ne{k} AS (SELECT {factor} AS level, count(*) AS n, avg(r{k - 1}) AS b"
            f" FROM c{last} GROUP BY {factor})"
        )
    return out


CHAIN = _chain()


def _scored() -> str:
    joins = "\n".join(
        f"  LEFT JOIN e{k} ON holdout.{f} IS NOT DISTINCT FROM e{k}.level"
        for k, f in enumerate(fixed.FACTORS, start=1)
    )
    partial = ["mu"]
    for k in range(1, len(fixed.FACTORS) + 1):
        partial.append(f"{partial[-1]} + e{k}.b")
    columns = ", ".join(f"{p} AS p{k}" for k, p in enumerate(partial))
    return CHAIN + f""",
scored AS (
  SELECT holdout.*, {columns} FROM holdout CROSS JOIN mean
{joins}),
pairs AS (
  SELECT row_key, logprice, p{len(fixed.FACTORS)} AS pred_price,
         abs(pow(10, p{len(fixed.FACTORS)}) - pow(10, logprice)) AS diff,
         pow(10, logprice) AS price, pow(10, p{len(fixed.FACTORS)}) AS pred
  FROM scored),
se AS (
  SELECT avg(price) AS mean_price, stddev_samp(price) AS sd_price, count(*) AS n_price,
         stddev_samp(price) / sqrt(count(*)) AS se1,
         2 * (stddev_samp(price) / sqrt(count(*))) AS se2
  FROM pairs)"""


SCORED = _scored()

LINE = SCORED + """,
s AS (
  SELECT cast(regr_count(logprice, pred_price) AS bigint) AS n, regr_slope(logprice, pred_price) AS slope,
         regr_intercept(logprice, pred_price) AS intercept,
         regr_r2(logprice, pred_price) AS r2, regr_sxx(logprice, pred_price) AS sxx,
         regr_syy(logprice, pred_price) AS syy, regr_sxy(logprice, pred_price) AS sxy,
         regr_avgx(logprice, pred_price) AS mx,
         corr(logprice - pred_price, pred_price) AS c
  FROM pairs),
m AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS mse FROM s),
line AS (
  SELECT *, sqrt(mse) AS rse, sqrt(mse / sxx) AS se_slope,
         sqrt(mse * (1.0 / n + mx * mx / sxx)) AS se_intercept,
         1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2
  FROM m),
t AS (
  SELECT *, slope / se_slope AS t_slope, intercept / se_intercept AS t_intercept,
         (slope / se_slope) * (slope / se_slope) AS f_line,
         ((slope - 1) / se_slope) * ((slope - 1) / se_slope) AS f_slope_is_one
  FROM line)"""


def r(expression: str, digits: int, name: str | None = None) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


TIDY_COLUMNS = (
    "row_key, borough, price, resunits, comunits, rescom, landareacat, grossareacat, "
    "decade, tax_class, bldg_class, day, month, " + r("logprice", 6)
)


def _histogram(ctes: str, source: str, value: str, digits: int, low=None, high=None) -> str:
    span = (
        f"SELECT min({value}) AS lo, max({value}) AS hi FROM {source}"
        if low is None
        else f"SELECT cast({low} AS double) AS lo, cast({high} AS double) AS hi"
    )
    return f"""WITH {ctes},
span AS ({span}),
width AS (SELECT lo, hi, (hi - lo) / {fixed.HISTOGRAM_BINS} AS w FROM span),
binned AS (
  SELECT cast(least(floor(({value} - lo) / w), {fixed.HISTOGRAM_BINS - 1}) AS int) AS bin,
         count(*) AS n
  FROM {source}, width WHERE {value} >= lo AND {value} <= hi GROUP BY 1)
SELECT cast(i AS int) AS bin, {r('lo + i * w', digits, 'lower')}, coalesce(n, 0) AS n
FROM range({fixed.HISTOGRAM_BINS}) AS g(i) CROSS JOIN width LEFT JOIN binned ON i = bin"""


def _boxes() -> str:
    """One group-by per factor, put together."""
    parts = []
    for f in fixed.FACTORS:
        listed = fixed.AXIS_LEVELS.get(f)
        where, place = "", "cast(NULL AS int)"
        if listed:
            values = ", ".join(f"'{v}'" for v in listed)
            where = f" WHERE {f} IN ({values})"
            place = f"list_position([{values}], {f})"
        parts.append(
            f"SELECT '{f}' AS factor, cast({f} AS varchar) AS level, row_key, logprice,"
            f" cast({place} AS int) AS place FROM tidy{where}"
        )
    return TIDY + ",\nlong AS (" + "\n  UNION ALL ".join(parts) + """),
quartiles AS (
  SELECT factor, level, place, count(*) AS n, quantile_cont(logprice, 0.25) AS q1,
         quantile_cont(logprice, 0.5) AS median, quantile_cont(logprice, 0.75) AS q3
  FROM long GROUP BY factor, level, place),
fenced AS (
  SELECT long.*, n, q1, median, q3, logprice >= q1 - 1.5 * (q3 - q1)
           AND logprice <= q3 + 1.5 * (q3 - q1) AS inside
  FROM long JOIN quartiles ON long.factor = quartiles.factor
    AND long.level IS NOT DISTINCT FROM quartiles.level)"""


BOXES = _boxes()


def _codes(columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS factor, cast({c} AS varchar) AS level,"
        f" dense_rank() OVER (ORDER BY {c}) AS code"
        f" FROM sales_raw WHERE {c} IS NOT NULL"
        for c in columns
    )
    return f"WITH {RAW} SELECT DISTINCT factor, level, code FROM ({parts})"


def _unseen() -> str:
    joins = "\n".join(
        f"  LEFT JOIN e{k} ON clean.{f} IS NOT DISTINCT FROM e{k}.level"
        for k, f in enumerate(fixed.FACTORS, start=1)
    )
    pred = " + ".join(["mu", *[f"e{k}.b" for k in range(1, len(fixed.FACTORS) + 1)]])
    gap = "(log10(price) - pred)"
    return f"""WITH {CHAIN},
any_sale AS (SELECT clean.price, {pred} AS pred FROM clean CROSS JOIN mean
{joins})
SELECT count(*) AS n, count(*) FILTER (pred IS NULL) AS n_null_pred,
  CASE WHEN count(pred) = count(*) THEN round(sqrt(avg({gap} * {gap})), 6) + 0.0 END AS rmse_all,
  round(sqrt(avg({gap} * {gap})), 6) + 0.0 AS rmse_scored
FROM any_sale"""


def _schema() -> str:
    """A column at a time; the sample by four sorts of the distinct texts by parts of their MD5."""
    types = {"price": "double", "logprice": "double"}
    columns = [
        "borough", "price", "resunits", "comunits", "rescom", "landareacat", "grossareacat",
        "decade", "tax_class", "bldg_class", "day", "month", "logprice",
    ]
    whole = {"borough", "decade", "tax_class", "month"}
    parts = []
    for i, c in enumerate(columns, start=1):
        kind = types.get(c, "int" if c in whole else "string")
        n_levels = f"count(DISTINCT {c})" if c in fixed.FACTORS else "cast(NULL AS bigint)"
        text = f"printf('%.6f', {c})" if kind == "double" else f"cast({c} AS varchar)"
        picks = ", ".join(f"arg_min(v, (substr(md5(v), {1 + 8 * j}, 8), v))" for j in range(4))
        sample = (
            f"(SELECT array_to_string(list_sort(list_distinct([{picks}])), ', ')"
            f" FROM (SELECT DISTINCT {text} AS v FROM tidy WHERE {c} IS NOT NULL))"
        )
        parts.append(
            f"SELECT cast({i} AS int) AS position, '{c}' AS \"column\", '{kind}' AS type,"
            f" count({c}) AS n_filled, {n_levels} AS n_levels, {sample} AS sample FROM tidy"
        )
    return f"WITH {TIDY} " + " UNION ALL ".join(parts)


WIDE = ["land_area", "gross_area", "hood", "yr_built"]


def _wide() -> str:
    out = RAW + """,
priced AS (
  SELECT land_area, gross_area, hood, yr_built, try_cast(price AS double) AS price FROM sales_raw),
w0 AS (
  SELECT *, log10(price) AS y, log10(price) - avg(log10(price)) OVER () AS r0
  FROM priced WHERE price >= 10000 AND price < 1000000000)"""
    for k, factor in enumerate(WIDE, start=1):
        out += (
            f",\nw{k} AS (SELECT *, r{k - 1} - avg(r{k - 1}) OVER (PARTITION BY {factor}) AS r{k}"
            f" FROM w{k - 1})"
        )
    return out


def _all_effects(ctes: str, source: str, factors: list[str], digits: int) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT '{f}' AS factor, cast({f} AS varchar) AS level, count(*) AS n,"
        f" {r(f'avg(r{k})', digits, 'b')} FROM {source} GROUP BY {f}"
        for k, f in enumerate(factors)
    )


def _heavy(columns: list[str], share: str) -> str:
    return f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS factor, cast({c} AS varchar) AS level, count(*) AS n FROM sales_raw"
        f" GROUP BY {c} HAVING count(*) > cast({share} AS double) * (SELECT count(*) FROM sales_raw)"
        for c in columns
    )


def _growing(columns: list[str]) -> str:
    loads = RAW + ", loads AS (SELECT *, CASE WHEN month(sale_ts) <= 6 THEN '1' ELSE '2' END AS load FROM sales_raw)"
    return f"WITH {loads} " + " UNION ALL ".join(
        f"SELECT '{c}' AS factor, cast({c} AS varchar) AS level, min(load) AS slice,"
        f" row_number() OVER (ORDER BY min(load), {c}) AS code FROM loads WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


def _splits(seeds: list[int]) -> str:
    return f"WITH {TIDY}, " + SPLIT[len(TIDY) + 2 :].partition(",\ndrawn AS")[0] + " " + " UNION ALL ".join(
        f"""SELECT cast({seed} AS int) AS seed, cast(stratum AS int) AS stratum, is_train, count(*) AS n,
          min(row_key) AS first_key, max(row_key) AS last_key
        FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}|' || row_key))
                <= ceil(0.25 * count(*) OVER (PARTITION BY stratum)) AS is_train FROM strata)
        GROUP BY stratum, is_train"""
        for seed in seeds
    )


def _comparison() -> str:
    rows = []
    for k, name in enumerate(fixed.MODEL_NAMES):
        rows.append(
            f"SELECT cast({k} AS int) AS step, '{name}' AS model,"
            f" (SELECT round(sqrt(avg(r{k} * r{k})), 6) FROM c{len(fixed.FACTORS)}) AS rmse,"
            f" (SELECT round(sqrt(avg((logprice - p{k}) * (logprice - p{k}))), 6) FROM scored)"
            f" AS holdout_rmse, (SELECT count(*) - count(p{k}) FROM scored) AS n_unscored"
        )
    return f"WITH {SCORED} " + "\nUNION ALL ".join(rows)


def _tails() -> str:
    """Tail areas by Simpson's rule on the t density; the t quantile by its expansion
    in the inverse degrees of freedom around the normal quantile."""
    steps = 40000
    z = "1.959963984540054"
    tests = [
        ("p_slope", "t_slope"), ("p_intercept", "t_intercept"),
        ("p_line", "sqrt(f_line)"), ("p_slope_is_one", "sqrt(f_slope_is_one)"),
    ]
    areas = []
    for name, statistic in tests:
        upper = f"least(abs({statistic}), 60.0)"
        density = "pow(1 + x * x / (n - 2), -(n - 1) / 2.0)"
        areas.append(f"""(
  SELECT {r(f'''1 - 2 * max(exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi() * (n - 2)))
    * sum(weight * {density}) * max(h) / 3.0''', 6, 'p')}
  FROM (SELECT n, {upper} / {steps} AS h, i * {upper} / {steps} AS x,
               CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight
        FROM t, range({steps + 1}) AS g(i))) AS {name}""")
    quantile = f"""({z} + (pow({z}, 3) + {z}) / (4.0 * (n - 2))
  + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96.0 * (n - 2) * (n - 2))
  + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z})
    / (384.0 * (n - 2) * (n - 2) * (n - 2)))"""
    limits = [
        r(f"slope - {quantile} * se_slope", 6, "slope_low"),
        r(f"slope + {quantile} * se_slope", 6, "slope_high"),
        r(f"intercept - {quantile} * se_intercept", 6, "intercept_low"),
        r(f"intercept + {quantile} * se_intercept", 6, "intercept_high"),
    ]
    return f"WITH {LINE} SELECT " + ",\n".join(areas + limits) + " FROM t"


def oracle_sql() -> dict[str, str]:
    last = len(fixed.FACTORS)
    five = ["res_min", "res_q1", "res_median", "res_q3", "res_max"]
    line_columns = [
        "slope", "intercept", "r2", "adj_r2", "rse", "se_slope", "se_intercept", "t_slope",
        "t_intercept", "f_line",
    ]
    low, high = "4.0", "log10(2200000000.0)"
    out = {
        "raw_profile": f"""WITH {CLEAN} SELECT count(*) AS n_rows, min(sold) AS first_day,
          max(sold) AS last_day, min(price) AS min_amount, max(price) AS max_amount,
          count(price) AS n_amounts FROM sales_cat""",
        "unit_buckets": f"""WITH {CLEAN} SELECT resunits, comunits, rescom, count(*) AS n
          FROM sales_cat GROUP BY ALL""",
        "area_buckets": f"""WITH {CLEAN} SELECT landareacat, grossareacat, count(*) AS n,
          sum(la) AS sum_land, sum(ga) AS sum_gross FROM sales_cat GROUP BY 1, 2""",
        "date_parts": f"""WITH {CLEAN} SELECT day, month, count(*) AS n,
          min(sold) AS first_day, max(sold) AS last_day FROM sales_cat GROUP BY 1, 2""",
        "level_codes": _codes(["borough", "zip", "yr_built", "hood", "land_area", "gross_area", "bldg_class_sale"]),
        "level_counts": f"WITH {CLEAN} " + " UNION ALL ".join(
            f"SELECT '{c}' AS factor, count(DISTINCT {c}) AS n_levels, count({c}) AS n_filled"
            " FROM clean"
            for c in ["zip", "decade", "bldg_class"]
        ),
        "frequency_decade": f"""WITH {CLEAN} SELECT decade, count(*) AS n FROM clean
          WHERE decade IS NOT NULL GROUP BY 1""",
        "frequency_class": f"""WITH {CLEAN} SELECT bldg_class, count(*) AS n FROM clean
          WHERE bldg_class IS NOT NULL GROUP BY 1""",
        "frequent_classes": f"""WITH {CLEAN} SELECT bldg_class, count(*) AS n,
          sum(price) AS sum_price FROM clean GROUP BY 1
          HAVING count(*) > 100""",
        "tidy": f"WITH {TIDY} SELECT {TIDY_COLUMNS} FROM tidy",
        "schema_profile": _schema(),
        "preview": f"WITH {TIDY} SELECT {TIDY_COLUMNS} FROM tidy ORDER BY row_key LIMIT 20",
        "hist_price": _histogram(TIDY, "tidy", "price", 2),
        "hist_logprice": _histogram(TIDY, "tidy", "logprice", 6),
        "hist_abs_error": _histogram(
            SCORED + ",\nerrors AS (SELECT log10(diff) AS error FROM pairs WHERE diff > 0)",
            "errors", "error", 6, 0.0, 9.0,
        ),
        "box_stats": f"""WITH {BOXES} SELECT factor, level, place, n,
          {r('least(q1, min(logprice) FILTER (inside))', 6, 'whisker_low')},
          {r('q1', 6)}, {r('median', 6)}, {r('q3', 6)},
          {r('greatest(q3, max(logprice) FILTER (inside))', 6, 'whisker_high')},
          count(*) FILTER (NOT inside) AS n_outliers
          FROM fenced GROUP BY factor, level, place, n, q1, median, q3""",
        "box_outliers": f"""WITH {BOXES} SELECT row_key, factor, level, {r('logprice', 6)}
          FROM fenced WHERE NOT inside""",
        "scatter_bins": f"""WITH {SCORED},
          lim AS (SELECT {low} AS lo, {high} AS hi, ({high} - {low}) / 100 AS w)
          SELECT cast(least(floor((pred_price - lo) / w), 99) AS int) AS x_bin,
                 cast(least(floor((logprice - lo) / w), 99) AS int) AS y_bin, count(*) AS n
          FROM pairs, lim WHERE pred_price BETWEEN lo AND hi AND logprice BETWEEN lo AND hi
          GROUP BY 1, 2""",
        "split_counts": f"""WITH {SPLIT} SELECT cast(stratum AS int) AS stratum, is_train,
          count(*) AS n FROM drawn GROUP BY 1, 2""",
        "split_complete": f"""WITH {SPLIT} SELECT count(*) AS n_rows,
          count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_holdout,
          cast(0 AS bigint) AS n_wrong FROM drawn""",
        "predict_unseen": _unseen(),
        "train_keys": f"WITH {SPLIT} SELECT row_key FROM train",
        "mean_and_naive": f"""WITH {SPLIT} SELECT count(*) AS n, {r('avg(logprice)', 6, 'mu')},
          {r('sqrt(avg((logprice - mu) * (logprice - mu)))', 6, 'naive_rmse')} FROM train, mean""",
        "model_comparison": _comparison(),
        "predict_validation":
            f"WITH {SCORED} SELECT row_key, {r(f'p{last}', 6, 'pred_price')} FROM scored",
        "valcomp": f"""WITH {SCORED} SELECT row_key, {r('logprice', 6)}, {r('pred_price', 6)},
          {r('diff', 2)}, {r('price', 2)}, {r('pred', 2)} FROM pairs""",
        "price_se": f"""WITH {SCORED} SELECT {r('mean_price', 4)}, {r('sd_price', 4)}, n_price,
          {r('se1', 4)}, {r('se2', 4)} FROM se""",
        "se_coverage": f"""WITH {SCORED} SELECT
          {r('avg(CASE WHEN diff <= se1 THEN 1.0 ELSE 0.0 END)', 6, 'within_1se')},
          {r('avg(CASE WHEN diff <= se2 THEN 1.0 ELSE 0.0 END)', 6, 'within_2se')},
          count(*) FILTER (diff IS NULL) AS n_null_pred FROM pairs, se""",
        "regression": f"""WITH {LINE},
          res AS (SELECT quantile_cont(logprice - (intercept + slope * pred_price),
                    [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM pairs, line)
          SELECT n, {', '.join(r(c, 6) for c in line_columns)},
          {', '.join(r(f'q[{i}]', 6, c) for i, c in enumerate(five, start=1))} FROM t, res""",
        "regression_plotted": f"""WITH {SCORED} SELECT
          cast(regr_count(logprice, pred_price) AS bigint) AS n,
          {r('regr_slope(logprice, pred_price)', 6, 'slope')},
          {r('regr_intercept(logprice, pred_price)', 6, 'intercept')},
          {r('regr_r2(logprice, pred_price)', 6, 'r2')}
          FROM pairs WHERE logprice BETWEEN {low} AND {high}
            AND pred_price BETWEEN {low} AND {high}""",
        "slope_test": f"WITH {LINE} SELECT n, {r('slope', 6)}, {r('f_slope_is_one', 6)} FROM t",
        "regression_tails": _tails(),
    }
    out["refit_state"] = _all_effects(CHAIN, f"c{last}", fixed.FACTORS, 9)
    out["fit_wide"] = _all_effects(_wide(), f"w{len(WIDE)}", WIDE, 6)
    out["score_wide"] = f"""WITH {_wide()} SELECT hood, count(*) AS n,
      {r('avg(y - r4)', 6, 'mean_pred')}, {r('sqrt(avg(r4 * r4))', 6, 'rmse')} FROM w4 GROUP BY hood"""
    out["heavy_levels"] = _heavy(["land_area", "gross_area", "zip", "bldg_class_sale"], "0.02")
    out["growing_codes"] = _growing(["land_area", "hood", "yr_built", "bldg_class_sale"])
    out["level_sketches"] = f"WITH {RAW} " + " UNION ALL ".join(
        f"SELECT '{c}' AS factor, count({c}) AS n_filled, count(DISTINCT {c}) AS n_levels, true AS within FROM sales_raw"
        for c in ["land_area", "gross_area", "hood", "zip", "yr_built"]
    )
    out["quantile_sketches"] = f"WITH {TIDY} " + " UNION ALL ".join(
        f"SELECT '{f}' AS factor, cast({f} AS varchar) AS level, count(*) AS n,"
        f" {r('min(logprice)', 6, 'low')}, {r('max(logprice)', 6, 'high')}, true AS within FROM tidy GROUP BY {f}"
        for f in fixed.FACTORS
    )
    out["repeated_splits"] = _splits([1, 2, 3])
    out["csv_rejects"] = f"""WITH {RAW}, judged AS (
      SELECT zip, CASE borough || '/' || tax_class_sale WHEN '1/1' THEN 'number of fields'
        WHEN '2/2' THEN 'number of fields' WHEN '3/3' THEN 'open quote' WHEN '4/4' THEN 'open quote' END AS reason
      FROM sales_raw)
      SELECT reason, count(*) AS n, cast(CASE WHEN reason IS NULL THEN sum(zip) END AS bigint) AS sum_zip,
        (SELECT count(*) FROM judged) AS n_lines, (SELECT count(*) FROM judged WHERE reason IS NULL) AS n_good,
        (SELECT count(reason) FROM judged) AS n_rejected
      FROM judged GROUP BY reason"""
    out["csv_ingest"] = out["tidy"]
    out["export_roundtrip"] = f"""WITH {TIDY} SELECT {TIDY_COLUMNS},
      'say "' || bldg_class || '", ' || day || CASE WHEN borough = 1 THEN chr(10) || 'next' ELSE '' END AS note
      FROM tidy"""
    for k, factor in enumerate(fixed.FACTORS, start=1):
        out[f"effect_{factor}"] = (
            f"WITH {CHAIN} SELECT cast(level AS varchar) AS level, n, {r('b', 6)} FROM e{k}"
        )
    out["borough_effect_single"] = out["effect_borough"]
    return out
