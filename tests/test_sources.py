import csv

import pytest
from hedonica import fixed_values as fixed
from hedonica.operators.clean import tidy
from hedonica.plans.workspace import TABLES, Workspace, workspace
from hedonica.session import fresh_path, shared_dir, written
from hedonica.sources.sales_csv import (
    good_rows, intake, read_checked, read_csv, read_exported, read_sales, rejected_rows,
    rename_by_position, write_csv,
)

HEADER = [f"COLUMN {i}" for i in range(22)]
ROW = [
    "4", "1", "OLD TOWN", "RENTALS", "2A", "39", "6", " ", "C2", "15 FIRST STREET", " ",
    "10009", "5", "0", "5", "1633", "6440", "1900", "2", "C2", "6625000", "2017-07-19 00:00:00",
]


def sales_file(tmp_path, rows):
    path = tmp_path / "sales.csv"
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([HEADER, *rows])
    return str(path)


def test_sales_file_is_read_by_position(spark, tmp_path):
    missing = list(ROW)
    missing[15] = missing[16] = missing[20] = " -  "
    missing[12] = "NA"
    sales = read_sales(spark, sales_file(tmp_path, [ROW, missing]))
    assert sales.columns == fixed.RAW_COLUMNS
    full, gap = sorted(sales.collect(), key=lambda r: r["price"], reverse=True)
    assert (full["borough"], full["zip"], full["res_units"]) == (1, 10009, 5.0)
    assert (gap["price"], gap["land_area"], gap["res_units"]) == (" -  ", " -  ", None)


def test_sales_file_to_tidy(spark, tmp_path):
    out = tidy(read_sales(spark, sales_file(tmp_path, [ROW]))).first().asDict()
    assert out.pop("logprice") == pytest.approx(6.821186, abs=1e-6)
    assert out == {
        "borough": 1, "price": 6625000.0, "resunits": "4:10", "comunits": "0", "rescom": "res",
        "landareacat": "1:2000", "grossareacat": "4000+", "decade": 1900, "tax_class": 2,
        "bldg_class": "C", "day": "Wednesday", "month": 7,
    }


def test_wrong_number_of_columns(spark, tmp_path):
    df = read_csv(spark, sales_file(tmp_path, [ROW]))
    with pytest.raises(ValueError, match="3 names for 22 columns"):
        rename_by_position(df, ["a", "b", "c"])


def test_export_keeps_missing_and_blanks(spark):
    rows = [("a", 1.5), (" -  ", None), (None, 0.1 + 0.2)]
    df = spark.createDataFrame(rows, "t string, x double")
    path = fresh_path(spark, "export")
    write_csv(df, path)
    back = read_exported(spark, path, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_quoted_text_before_the_price(spark, tmp_path):
    quoted = list(ROW)
    quoted[9] = 'THE "OLD" HOUSE, 15 FIRST STREET'
    sales = read_sales(spark, sales_file(tmp_path, [quoted])).first()
    assert (sales["address"], sales["price"]) == (quoted[9], "6625000")


def test_export_keeps_quotes_commas_and_line_breaks(spark):
    rows = [('say "hi", ok', 1.0), ("two\nlines", 2.0), ('"', 3.0), ("a,b", None)]
    df = spark.createDataFrame(rows, "t string, x double")
    path = fresh_path(spark, "export")
    write_csv(df, path)
    back = read_exported(spark, path, df.schema, multi_line=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_written_tables_are_deleted_with_their_workspace(spark, small_dir):
    import os

    w = Workspace(spark, small_dir)
    w.tidy
    assert len(w.owned) == 2 and all(os.listdir(p.removeprefix("file:")) for p in w.owned)
    held = list(w.owned)
    w.close()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in held)


def test_without_a_shared_folder_rows_are_kept_by_spark(spark, monkeypatch):
    monkeypatch.setattr("hedonica.session.shared_dir", lambda spark: None)
    df = written(spark.range(3), "t")
    assert df.is_cached and df.count() == 3
    df.unpersist()


def test_changed_tables_begin_a_new_workspace(spark, tmp_path):
    for t in TABLES:
        spark.range(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    first = workspace(spark, str(tmp_path))
    assert workspace(spark, str(tmp_path)) is first
    spark.range(2).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    assert workspace(spark, str(tmp_path)) is not first


def test_shared_dir_is_the_named_one(spark):
    class Conf:
        def get(self, key, default=None):
            return "/shared/place/" if key == "spark.checkpoint.dir" else default

    class Named:
        conf, sparkContext = Conf(), spark.sparkContext

    assert shared_dir(Named()).startswith("/shared/place/hedonica-")


def test_a_cluster_must_name_a_shared_dir():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "yarn", "app"

        def getCheckpointDir(self):
            return None

    class Unnamed:
        conf, sparkContext = Conf(), Context()

    Context.master = "local[4]"
    assert shared_dir(Unnamed()) is None
    Context.master = "yarn"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unnamed())


def test_damaged_lines_are_rejected_with_file_and_reason(spark, tmp_path):
    good = ['1,"a ""b"", c",NA', '2,plain,"x"', '3,,']
    bad = {'4,short': "number of fields", '5,a,b,long': "number of fields", '6,"open,b': "open quote", '7,a,"open': "open quote"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(["id,t,u", *good, "", *list(bad)[:2]]) + "\n")
    (tmp_path / "in" / "b.csv").write_text("\n".join(["id,t,u", *list(bad)[2:], good[0]]) + "\n")
    checked = read_checked(spark, str(tmp_path / "in"), ["id", "t", "reason_"])
    rows = sorted(tuple(r) for r in good_rows(checked).select("id", "t").collect())
    assert rows == [("1", 'a "b", c'), ("1", 'a "b", c'), ("2", "plain"), ("3", None)]
    found = {r["line"]: (r["file"], r["reason"]) for r in rejected_rows(checked).collect()}
    assert found == {line: ("a.csv" if i < 2 else "b.csv", reason) for i, (line, reason) in enumerate(bad.items())}
    assert {tuple(r) for r in intake(checked).collect()} == {("a.csv", 5, 3, 2), ("b.csv", 3, 1, 2)}
    # good rows read as they do without the check
    plain = read_csv(spark, str(tmp_path / "in"), ["id", "t", "u"]).where("id in ('1', '2', '3')")
    assert sorted(map(str, plain.select("id", "t").collect())) == sorted(map(str, good_rows(checked).select("id", "t").collect()))


def test_checked_reading_of_no_lines(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    checked = read_checked(spark, str(tmp_path / "empty.csv"), ["id"])
    assert checked.count() == 0 and intake(checked).count() == 0
