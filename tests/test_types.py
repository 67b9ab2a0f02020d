"""Type dictionary, typed loads and DDL text."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from quire.functions.types import STATA_TO_SQL, sql_to_spark
from quire.operators import typing


def test_dictionary_lookup(spark):
    codes = ["byte", "int", "long", "float", "double", "str20", "strL", "strl", "str5", "str99", None]
    df = spark.createDataFrame([(c,) for c in codes], "type string")
    got = [r["sql_type"] for r in typing.map_types(df).collect()]
    assert got == ["SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "VARCHAR(20)", "TEXT",
                   "TEXT", "None", "VARCHAR(99)", "None"]
    assert len(STATA_TO_SQL) == 33


def test_dictionary_as_table_and_errors(spark):
    df = spark.createDataFrame([("byte",), ("str5",)], "type string")
    book = spark.createDataFrame(list(STATA_TO_SQL.items()), "code string, sql_type string")
    got = [r["sql_type"] for r in typing.map_types(df, dictionary=book).collect()]
    assert got == ["SMALLINT", "None"]
    with pytest.raises((PySparkException, Py4JJavaError)):
        typing.map_types(df, on_unmapped="error").collect()


def test_sql_to_spark():
    assert sql_to_spark("SMALLINT") == T.ShortType()
    assert sql_to_spark("double  precision") == T.DoubleType()
    assert sql_to_spark("VARCHAR(32)") == T.StringType()
    assert sql_to_spark("TEXT") == T.StringType()
    with pytest.raises(ValueError):
        sql_to_spark("None")


def test_apply_types(spark):
    rows = [("3", "3.0", "1.5", "x", ""), ("", "7", "abc", "", "12"), ("40000", "2.5", "", "y", "1e2")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    out = typing.apply_types(df, {"a": "SMALLINT", "b": "INTEGER", "c": "DOUBLE PRECISION",
                                  "d": "VARCHAR(1)", "e": "BIGINT"})
    assert [f.dataType for f in out.schema] == [T.ShortType(), T.IntegerType(), T.DoubleType(),
                                                 T.StringType(), T.LongType()]
    assert [tuple(r) for r in out.collect()] == [
        (3, 3, 1.5, "x", None),
        (None, 7, None, None, 12),
        (None, None, None, "y", 100),   # 40000 overflows SMALLINT; 2.5 is not whole
    ]


def test_generate_ddl_order_and_split(spark):
    rows = [("t", f"v{i}", "SMALLINT" if i % 2 else "TEXT", i) for i in reversed(range(7))]
    rows += [("u", "only", "BIGINT", 0)]
    v = spark.createDataFrame(rows, "dataset string, name string, sql_type string, ordinal int")
    one = {r["table_name"]: r["ddl"] for r in typing.generate_ddl(v).collect()}
    assert one["t"] == ("CREATE TABLE IF NOT EXISTS t (v0 TEXT,v1 SMALLINT,v2 TEXT,v3 SMALLINT,"
                        "v4 TEXT,v5 SMALLINT,v6 TEXT);")
    assert one["u"] == "CREATE TABLE IF NOT EXISTS u (only BIGINT);"
    sections = spark.createDataFrame([("odd", "v1"), ("odd", "v3"), ("even", "v2")], "section string, name string")
    cut = {r["table_name"]: (r["n_columns"], r["ddl"]) for r in typing.generate_ddl(v, sections=sections, keys=["v0"]).collect()}
    assert cut == {"t_odd": (3, "CREATE TABLE IF NOT EXISTS t_odd (v0 TEXT,v1 SMALLINT,v3 SMALLINT);"),
                   "t_even": (2, "CREATE TABLE IF NOT EXISTS t_even (v0 TEXT,v2 TEXT);")}


def test_wide_dataset_is_one_statement(spark):
    v = spark.range(3816).selectExpr("'t' AS dataset", "concat('v', id) AS name", "'TEXT' AS sql_type", "id AS ordinal")
    rows = typing.generate_ddl(v).collect()
    assert len(rows) == 1 and rows[0]["n_columns"] == 3816


def test_number_spellings_rejects_and_raise(spark):
    df = spark.createDataFrame([(1, "1D", "abc"), (2, "70000", "ab"), (3, " 7 ", None), (4, "0x1p3", "")], "id int, n string, t string")
    types = {"n": "SMALLINT", "t": "VARCHAR(2)"}
    assert [r["n"] for r in typing.apply_types(df, types).orderBy("id").collect()] == [None, None, 7, None]
    got = {(r["id"], r["variable"], r["value"]) for r in typing.rejected_values(df, types, ["id"]).collect()}
    assert got == {(1, "n", "1D"), (1, "t", "abc"), (2, "n", "70000"), (4, "n", "0x1p3")}
    with pytest.raises((PySparkException, Py4JJavaError)):
        typing.apply_types(df, types, on_error="raise").collect()


def test_nan_and_infinity_round_trip(spark):
    from quire.operators import clean

    df = spark.createDataFrame([(1, float("nan"), float("inf")), (2, float("-inf"), 1.5), (3, None, 1e300)], "id int, a double, b double")
    back = typing.apply_types(clean.stringify_cells(df), {"id": "INTEGER", "a": "DOUBLE PRECISION", "b": "DOUBLE PRECISION"}, on_error="raise")
    got = [tuple(map(str, r)) for r in back.orderBy("id").collect()]
    assert got == [("1", "nan", "inf"), ("2", "-inf", "1.5"), ("3", "None", "1e+300")]
    words = spark.createDataFrame([("nan", "inf")], "a string, b string")
    assert [tuple(r) for r in typing.apply_types(words, {"a": "SMALLINT", "b": "BIGINT"}).collect()] == [(None, None)]


def test_typed_load_counts_add_up(spark, tmp_dir):
    df = spark.createDataFrame([(1, "1D", "abc"), (2, "70000", "ab"), (3, " 7 ", None), (4, "", "")], "id int, n string, t string")
    got = typing.load_typed(df, {"n": "SMALLINT", "t": "VARCHAR(2)"}, ["id"], f"{tmp_dir}/typed")
    assert (got.rows, got.given, got.typed, got.rejected) == (4, 5, 2, 3)
    assert [tuple(r) for r in got.data.orderBy("id").collect()] == [(1, None, None), (2, None, "ab"), (3, 7, None), (4, None, None)]
    assert sorted(tuple(r) for r in got.rejects.collect()) == [
        (1, "n", "1D", "SMALLINT"), (1, "t", "abc", "VARCHAR(2)"), (2, "n", "70000", "SMALLINT")]
    none = typing.load_typed(df.where("false"), {"n": "SMALLINT"}, ["id"], f"{tmp_dir}/none")
    assert (none.rows, none.given, none.rejected) == (0, 0, 0) and none.rejects.count() == 0
