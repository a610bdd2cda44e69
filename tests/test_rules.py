import datetime as dt
import hashlib
from decimal import Decimal

import pytest

from tidemark.functions import rules as R
from tidemark.functions import scalars as S


def one(spark, rule, type_, value, name="c"):
    df = spark.createDataFrame([(value,)], f"{name} {type_}").alias("src")
    return df.select(rule.column().alias("x")).first()["x"]


CASES = [
    (R.ToDate("x", "c"), "string", "2024-02-29", dt.date(2024, 2, 29)),
    (R.ToDate("x", "c"), "string", "2024-02-30", None),
    (R.ToDate("x", "c"), "string", "junk", None),
    (R.ToDate("x", "c", ("MM/dd/yyyy",)), "string", "01/05/2024", dt.date(2024, 1, 5)),
    (R.ToDate("x", "c", ("MM/dd/yyyy",)), "string", "1/5/2024", None),
    (R.ToDate("x", "c", ("dd-MMM-yyyy",)), "string", "15-JAN-2020", dt.date(2020, 1, 15)),
    (R.ToDate("x", "c", ("yyyy-MM-dd", "MM/dd/yyyy")), "string", "12/31/2023", dt.date(2023, 12, 31)),
    (R.ToDate("x", "c"), "string", None, None),
    (R.ToTimestamp("x", "c"), "string", "2024-01-05 10:11:12", dt.datetime(2024, 1, 5, 10, 11, 12)),
    (R.ToTimestamp("x", "c"), "string", "soon", None),
    (R.ToTimestamp("x", "c", "dd.MM.yyyy HH:mm"), "string", "05.01.2024 10:11",
     dt.datetime(2024, 1, 5, 10, 11)),
    (R.NumToDecimal("x", "c"), "double", 1250.755, Decimal("1250.76")),
    (R.NumToDecimal("x", "c"), "double", None, Decimal("0.00")),
    (R.NumToDecimal("x", "c", default=None), "double", None, None),
    (R.StrToDecimal("x", "c", strip=","), "string", "-1,234,567.89", Decimal("-1234567.89")),
    (R.StrToDecimal("x", "c", strip=","), "string", "n/a", None),
    (R.StrToDecimal("x", "c", strip=","), "string", "", None),
    (R.StrToDecimal("x", "c", 8, 4, strip="%"), "string", "3.50%", Decimal("3.5000")),
    (R.StrToDecimal("x", "c", 4, 0), "string", "1.5", Decimal("2")),
    (R.StrToDecimal("x", "c", 4, 0), "string", " 12 ", Decimal("12")),
    (R.EpochMs("x", "c"), "bigint", 1706094000123, dt.datetime(2024, 1, 24, 11, 0, 0, 123000)),
    (R.EpochMs("x", "c"), "bigint", -1, dt.datetime(1969, 12, 31, 23, 59, 59, 999000)),
    (R.Mask("x", "c"), "string", "A", hashlib.sha256(b"A").hexdigest()),
    (R.Mask("x", "c", 224), "string", "A", hashlib.sha224(b"A").hexdigest()),
    (R.Mask("x", "c", 512), "bigint", 7, hashlib.sha512(b"7").hexdigest()),
    (R.Mask("x", "c"), "string", None, None),
    (R.Md5("x", "c"), "string", "A", hashlib.md5(b"A").hexdigest()),
    (R.Coalesce("x", "c", 5), "int", None, 5),
    (R.Coalesce("x", "c", "X"), "string", None, "X"),
    (R.Trim("x", "c"), "string", "  a\t ", "a\t"),
    (R.Flag("x", "c", 10), "int", 11, "HIGH"),
    (R.Flag("x", "c", 10), "int", 10, "LOW"),
    (R.Flag("x", "c", 10), "int", None, "LOW"),
    (R.Decode("x", "c", (("A", "Active"),)), "string", "A", "Active"),
    (R.Decode("x", "c", (("A", "Active"),)), "string", "B", None),
    (R.Decode("x", "c", (("A", "Active"),)), "string", None, None),
    (R.Band("x", "c", ((3, "L"), (5, "M")), lower=1), "int", 0, None),
    (R.Band("x", "c", ((3, "L"), (5, "M")), lower=1), "int", 3, "L"),
    (R.Band("x", "c", ((3, "L"), (5, "M"))), "int", 6, None),
    (R.Band("x", "c", ((3, "L"), (5, "M")), else_="H"), "int", 6, "H"),
    (R.Band("x", "c", ((3, "L"), (5, "M")), else_="H"), "int", None, None),
    (R.CsvCount("x", "c"), "string", "a,b,", 3),
    (R.CsvCount("x", "c"), "string", "", 1),
    (R.CsvCount("x", "c"), "string", None, None),
    (R.CsvCount("x", "c", "|"), "string", "a|b", 2),
    (R.ToBool("x", "c"), "string", "yes", True),
    (R.ToBool("x", "c"), "string", "junk", None),
    (R.IsTrue("x", "c"), "string", "true", False),
    (R.IsTrue("x", "c"), "string", None, False),
    (R.IsTrue("x", "c"), "string", "TRUE", True),
    (R.JsonField("x", "c", "a.b", "int"), "string", '{"a":{"b":3}}', 3),
    (R.JsonField("x", "c", "A.b"), "string", '{"a":{"b":3}}', None),
    (R.JsonField("x", "c", "a"), "string", '{"a":null}', None),
    (R.JsonField("x", "c", "a"), "string", "{oops", None),
    (R.JsonField("x", "c", "a", "int"), "string", '{"a":"no"}', None),
    (R.Replace("x", "c", "-", "+"), "string", "a-b", "a+b"),
    (R.Year("x", "c"), "date", dt.date(2024, 3, 1), 2024),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(spark, i):
    rule, type_, value, want = CASES[i]
    assert one(spark, rule, type_, value) == want


def test_concat_words(spark):
    df = spark.createDataFrame([(" a ", "b "), ("a", None)], "p string, q string").alias("src")
    got = [r[0] for r in df.select(R.ConcatWords("x", "p", "q").column()).collect()]
    assert got == ["a b", None]


def test_drop_rules_are_three_valued(spark):
    df = spark.createDataFrame([("X",), ("Y",), (None,)], "c string").alias("src")
    assert [r[0] for r in df.where(R.DropEq("c", "X").keep()).collect()] == ["Y"]
    assert df.where(R.DropNull("c").keep()).count() == 2


def test_boundaries_not_whole_units(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 10:59:00' a, timestamp_ntz'2024-01-01 11:01:00' b, "
                   "timestamp_ntz'1969-12-31 23:59:59.5' c, timestamp_ntz'1970-01-01 00:00:00.5' d")
    row = df.select(
        S.boundary_diff("hour", "a", "b"), S.boundary_diff("hour", "b", "a"),
        S.boundary_diff("minute", "a", "b"), S.boundary_diff("second", "c", "d"),
        S.boundary_diff("day", "c", "d"), S.boundary_diff("hour", "a", S.ntz("2024-01-02"))).first()
    assert tuple(row) == (1, -1, 2, 1, 1, 14)


def test_names(spark):
    df = spark.createDataFrame([("my-feed: orders to clean warehouse", "a.b.c")], "n string, t string")
    row = df.select(S.slug("n"), S.task_name("n", 20), S.last_segment("t"),
                    S.pipeline_id("n", S.ntz("2024-01-02 03:04:05"))).first()
    assert tuple(row) == ("MY_FEED__ORDERS_TO_CLEAN", "TASK_MY_FEED:_ORDERS", "c",
                          "ETL_MY_FEED__ORDERS_TO_CLEAN_20240102030405")


def test_sha_does_not_depend_on_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, R.EpochMs("x", "c"), "bigint", 1710055800000) == dt.datetime(2024, 3, 10, 7, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
