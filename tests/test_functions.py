"""Semantic traps of the source SQL, one small fixture each (FIXTURES.md part C)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from riskflow.functions import (
    day_diff, floor_zero, great_circle_miles, is_blank, logistic, month_boundaries, same_text,
    not_blank_or, pad_right2, safe_ratio, year_boundaries, yyyymm,
)
from riskflow.functions.numeric import EARTH_RADIUS_MILES


def test_blank_storetype_rules(spark):
    # Trailing blanks ignored; NULL -> CORE in the cohort rule only
    df = spark.createDataFrame([(" ",), ("",), (None,), ("CORE",), ("FLS",)], "s string")
    got = df.select(is_blank("s").alias("b"), not_blank_or("s", "CORE").alias("t")).collect()
    assert [r.b for r in got] == [True, True, None, False, False]
    assert [r.t for r in got] == ["CORE", "CORE", "CORE", "CORE", "FLS"]


def test_case_insensitive_level(spark):
    # T03: 'missing' written by the binning step matches the 'Missing' weight
    df = spark.createDataFrame([("missing",), ("Missing",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(same_text("s", "Missing")).collect()] == [True, True, False,
                                                                             None]


def test_date_boundaries(spark):
    # DATEDIFF counts boundaries crossed
    rows = [(dt.date(2020, 1, 31), dt.date(2020, 2, 1)),
            (dt.date(2019, 12, 31), dt.date(2020, 1, 1)),
            (dt.date(2020, 1, 1), dt.date(2020, 1, 31))]
    df = spark.createDataFrame(rows, "a date, b date")
    got = df.select(day_diff("a", "b"), month_boundaries("a", "b"), year_boundaries("a", "b"),
                    yyyymm("a")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, "202001"), (1, 1, 1, "201912"),
                                       (30, 0, 0, "202001")]


def test_seasoned_lease_cut(spark):
    # GETDATE()-150 is a datetime, so a lease exactly 150 days old counts
    from riskflow.plans.features import SEASONED_DAYS
    as_of = dt.date(2020, 6, 1)
    days = [149, 150, 151]
    df = spark.createDataFrame([(as_of - dt.timedelta(days=d),) for d in days], "d date")
    cut = F.date_sub(F.lit(as_of), SEASONED_DAYS)
    got = [r[0] for r in df.select(F.when(F.col("d") <= cut, 1).otherwise(0)).collect()]
    assert got == [0, 1, 1]


def test_floor_zero_keeps_null(spark):
    # T18
    df = spark.createDataFrame([(-5.0,), (0.0,), (None,), (3.0,)], "x double")
    assert [r[0] for r in df.select(floor_zero("x")).collect()] == [0, 0, None, 3.0]


def test_great_circle(spark):
    # Identical points 0, antipodes pi*R, missing coordinate NULL (bin 7, not 1)
    df = spark.createDataFrame([(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0),
                                (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(great_circle_miles("a", "b", "c", "d")).collect()]
    assert math.isclose(got[0], 0.0, abs_tol=1e-3)  # acos of 1-ulp, like the source
    assert math.isclose(got[1], math.pi * EARTH_RADIUS_MILES, rel_tol=1e-12)
    assert got[2] is None


def test_ratio_and_padding(spark):
    # T22, T23, T24
    df = spark.createDataFrame([(1, 0, "9"), (3, 4, "12"), (2, None, ""), (0, 5, None)],
                               "a int, b int, s string")
    got = df.select(safe_ratio("a", "b").alias("r"),
                    F.nullif(pad_right2("s"), F.lit("0")).alias("p")).collect()
    assert [r.r for r in got] == [None, 0.75, None, 0.0]
    assert [r.p for r in got] == ["09", "12", None, None]


def test_logistic_no_overflow(spark):
    df = spark.createDataFrame([(1000.0,), (-1000.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(logistic("x")).collect()] == [1.0, 0.0, 0.5]
