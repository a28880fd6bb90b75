import datetime

from hedonica import fixed_values as fixed
from hedonica.functions import scalars
from hedonica.operators import clean
from pyspark.sql import functions as F

RAW = (
    "row_key string, borough int, zip int, res_units double, com_units double, "
    "land_area string, gross_area string, yr_built int, tax_class_sale int, "
    "bldg_class_sale string, price string, sale_ts string"
)


def sale(key, price="20000", res=1.0, com=0.0, land="1", gross="1", year=1900, cls="A1"):
    return (key, 1, 10001, res, com, land, gross, year, 1, cls, price, "2017-07-19 00:00:00")


def test_price_is_half_open_and_sentinel_is_missing(spark):
    prices = ["10000", "9999", "1000000000", "999999999", " -  ", "0", None, " 25000 "]
    raw = spark.createDataFrame([sale(str(p), p) for p in prices], RAW)
    kept = clean.first_clean(raw, ["row_key"]).collect()
    assert {r["row_key"]: r["price"] for r in kept} == {
        "10000": 10000.0, "999999999": 999999999.0, " 25000 ": 25000.0,
    }


def test_sentinel_turns_matching_texts_only(spark):
    df = spark.createDataFrame([(" -  ",), ("x -  y",), ("5",), (None,)], "t string")
    out = [r[0] for r in df.select(scalars.missing_if_contains(F.col("t"), " -  ")).collect()]
    assert out == [None, None, "5", None]


def test_unit_buckets_and_dominant_type(spark):
    units = [(0, 0), (0, 1), (3, 4), (4, 4), (10, 0), (11, 0), (50, 0), (51, 0), (None, 1),
             (-1, 0), (3.5, 2.5)]
    df = spark.createDataFrame(
        [(float(a) if a is not None else None, float(b)) for a, b in units],
        "res double, com double",
    )
    out = df.select(
        scalars.bucketize(F.col("res"), fixed.RES_UNIT_BUCKETS),
        scalars.bucketize(F.col("com"), fixed.COM_UNIT_BUCKETS),
        scalars.dominant(F.col("res"), F.col("com"), "res", "com"),
    ).collect()
    assert [tuple(r) for r in out] == [
        ("0", "0", "res"), ("0", "1", "com"), ("3", "4+", "com"), ("4:10", "4+", "res"),
        ("4:10", "0", "res"), ("11:50", "0", "res"), ("11:50", "0", "res"), ("51+", "0", "res"),
        (None, "1", None), (None, "0", "com"), (None, None, "res"),
    ]


def test_area_buckets(spark):
    texts = ["0", "1", "2000", "2001", "4000", "4001", " -  ", "2000.5", "-3"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    bucket = scalars.bucketize(scalars.number(F.col("a")), fixed.AREA_BUCKETS)
    assert [r[0] for r in df.select(bucket).collect()] == [
        "0", "1:2000", "1:2000", "2001:4000", "2001:4000", "4000+", None, "2001:4000", None,
    ]


def test_decade_floors_and_filter_drops_early_and_unknown(spark):
    years = [0, 1889, 1890, 1899, None]
    raw = spark.createDataFrame([sale(str(y), year=y) for y in years], RAW)
    out = clean.tidy(raw, ["row_key"]).collect()
    assert {r["row_key"]: r["decade"] for r in out} == {"1890": 1890, "1899": 1890}
    negative = spark.range(1).select(scalars.decade(F.lit(-3))).first()[0]
    assert negative == -10


def test_date_parts(spark):
    df = spark.createDataFrame([("2017-07-19 00:00:00",), ("2017-07-20",), ("x",)], "t string")
    day = scalars.day_of(F.col("t"))
    out = df.select(day, scalars.weekday(day), F.month(day)).collect()
    assert tuple(out[0]) == (datetime.date(2017, 7, 19), "Wednesday", 7)
    assert tuple(out[1])[1] == "Thursday"
    assert tuple(out[2]) == (None, None, None)


def test_classes_listed_and_frequent(spark):
    raw = spark.createDataFrame(
        [sale(f"a{i}", cls="A1") for i in range(3)] + [sale("z", cls="Z9"), sale("n", cls=None)],
        RAW,
    )
    assert {r["bldg_class"] for r in clean.tidy(raw).collect()} == {"A"}
    first = clean.first_clean(raw)
    assert clean.keep_frequent(first, "bldg_class", 1).count() == 3
    assert clean.keep_frequent(first, "bldg_class", 3).count() == 0


def test_tidy_columns_and_types(spark):
    out = clean.tidy(spark.createDataFrame([sale("k", "100000")], RAW), ["row_key"])
    assert out.columns == [
        "row_key", "borough", "price", "resunits", "comunits", "rescom", "landareacat",
        "grossareacat", "decade", "tax_class", "bldg_class", "day", "month", "logprice",
    ]
    assert abs(out.first()["logprice"] - 5.0) < 1e-12


def test_indicator_of_unknown_is_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "d double")
    out = [r[0] for r in df.select(scalars.indicator(F.col("d") <= 2)).collect()]
    assert out == [1.0, 0.0, None]
