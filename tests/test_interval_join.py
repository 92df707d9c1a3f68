"""The interval join against all pairs: scales, levels, keys, bounds, plans."""

import datetime as dt
import random

import pytest

from riskflow.operators.overlap import interval_join


def _pairs(left, right, closed=False, keyed=False):
    def ok(a, b):
        if None in a[1:3] or None in b[1:3]:
            return False
        if keyed and (a[3] is None or a[3] != b[3]):
            return False
        if closed:
            return a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]
        return a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]
    return sorted((a[0], b[0]) for a in left for b in right if ok(a, b))


def _run(spark, left, right, kind, **how):
    a = spark.createDataFrame(left, f"a int, a0 {kind}, a1 {kind}, ak int")
    b = spark.createDataFrame(right, f"b int, b0 {kind}, b1 {kind}, bk int")
    got = interval_join(a, b, ("a0", "a1"), ("b0", "b1"), **how)
    assert got.columns == ["a", "a0", "a1", "ak", "b", "b0", "b1", "bk"]
    return sorted((r.a, r.b) for r in got.collect())


def _rows(rng, n, far, lengths):
    out = [(i, s := rng.randint(-far, far), s + rng.choice(lengths), rng.randrange(3)) for i in range(n)]
    return out + [(n, None, 5, 0), (n + 1, 5, None, 0), (n + 2, 9, 3, 0), (n + 3, 4, 4, 1), (n + 4, -far, far, None)]


@pytest.mark.parametrize("width", [1, 10, 5000])
@pytest.mark.parametrize("closed", [False, True])
def test_integers_of_all_lengths(spark, width, closed):
    rng = random.Random(width)
    left, right = _rows(rng, 60, 3000, [1, 2, 9, 80, 700, 6000]), _rows(rng, 60, 3000, [1, 3, 40, 400, 4000])
    assert _run(spark, left, right, "long", width=width, closed=closed) == _pairs(left, right, closed)
    assert _run(spark, left, right, "long", width=width, closed=closed, on=[("ak", "bk")]) == _pairs(left, right, closed, keyed=True)


def test_one_very_long_interval_is_few_rows(spark):
    left = [(0, -10 ** 15, 10 ** 15, 0), (1, 5, 6, 0)]
    right = [(i, i * 1000, i * 1000 + 10, 0) for i in range(-50, 50)]
    assert _run(spark, left, right, "long", width=1) == _pairs(left, right)


def test_dates_and_timestamps(spark):
    rng = random.Random(8)
    day = [(i, d := dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(200)), d + dt.timedelta(days=rng.choice([0, 1, 30])), 0) for i in range(50)]
    assert _run(spark, day, day[:20], "date", width=7, closed=True) == _pairs(day, day[:20], True)
    time = [(i, t := dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(10 ** 6)), t + dt.timedelta(seconds=rng.choice([1, 3600, 90000])), 0)
            for i in range(60)]
    for kind in ("timestamp", "timestamp_ntz"):
        assert _run(spark, time, time[:30], kind, width=3_600_000_000) == _pairs(time, time[:30])


def test_no_nested_loop_and_clashing_names_raise(spark):
    a = spark.createDataFrame([(1, 2)], "a0 long, a1 long")
    b = spark.createDataFrame([(1, 2)], "b0 long, b1 long")
    plan = interval_join(a, b, ("a0", "a1"), ("b0", "b1"), width=1)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        interval_join(a, a, ("a0", "a1"), ("a0", "a1"), width=1)
    assert interval_join(a.limit(0), b, ("a0", "a1"), ("b0", "b1"), width=1).count() == 0
