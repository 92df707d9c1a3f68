"""Faults once found: each on the smallest input that shows it."""

import datetime as dt
import os
import tempfile

import pytest

from riskflow.plans import collections as col, features as fe, retry_cost as rc
from riskflow.sources.sinks import append_unseen, read_table, table_exists
from riskflow.streaming import append_unseen_batches

D = dt.date


def _torn(spark):
    """A stored table of 100 rows with a torn part file that sorts first."""
    path = os.path.join(tempfile.mkdtemp(prefix="rf-torn-"), "list")
    spark.range(100).withColumnRenamed("id", "approvalbkey").write.parquet(path)
    with open(os.path.join(path, "part-00000-0.parquet"), "wb") as f:
        f.write(b"PAR1 torn")
    return path


def _sound(path):
    return [f for f in os.listdir(path) if f.endswith(".parquet") and f != "part-00000-0.parquet"]


def test_a_torn_stored_list_is_never_replaced(spark):
    path = _torn(spark)
    before = _sound(path)
    new = spark.range(200, 210).withColumnRenamed("id", "approvalbkey")
    with pytest.raises(Exception):
        col.store_list(new, path)
    assert _sound(path) == before
    with pytest.raises(Exception):
        append_unseen_batches(path, "approvalbkey")(new, 0)
    assert _sound(path) == before


def test_first_run_creates_the_table_and_staging_goes(spark):
    base = tempfile.mkdtemp(prefix="rf-first-")
    path = os.path.join(base, "list")
    assert not table_exists(spark, path)
    rows = spark.range(5).withColumnRenamed("id", "approvalbkey")
    assert col.store_list(rows, path) == 5
    assert append_unseen(spark.range(3, 8).withColumnRenamed("id", "approvalbkey"), path, "approvalbkey") == 3
    assert read_table(spark, path).count() == 8
    assert os.listdir(base) == ["list"]


def test_lease_with_two_periods_has_its_attributes_once(spark):
    lv = spark.createDataFrame([(1, 1, 10, 5, "A", "A", 1.0, D(2020, 1, 1), None, D(2020, 1, 1), 1.0, 1.0, "14 Day", 0.0)],
                               "approvalid long, leaseid long, clientid long, storeid long, clientstatus string, leasestatus string, "
                               "monthlyincome double, clientaddeddate date, latestfrauddate date, leaseaddeddate date, "
                               "leasecost double, leaseamount double, paymentfrequency string, totalpaymentsmade double")
    period = spark.createDataFrame([(1, 5.0, 1.0), (1, 7.0, 1.0)],
                                   "approvalid long, firstrentpayment double, additionaldownpayment double")
    app = spark.createDataFrame([(1, 1)], "approvalbkey long, approvalid long")
    sums = spark.createDataFrame([(1, 5)], "approvalbkey long, storebkey long")
    store = spark.createDataFrame([(5, "FLS")], "storebkey long, storetype string")
    cohort, attrs = fe.cohort_tables(lv, period, app, sums, store, D(2021, 1, 1))
    assert (cohort.count(), attrs.count()) == (2, 1)
    bank = spark.createDataFrame([(10, "ach ", D(2020, 1, 1))], "clientid long, primarypaymentmethod string, ts date")
    assert [tuple(r) for r in fe.payment_at_origination(attrs, bank).collect()] == [(10, 1, 0)]


def test_account_without_an_approval_keeps_its_store_type(spark):
    j = spark.createDataFrame([(7, D(2024, 1, 1), D(2024, 1, 3), D(2023, 12, 1), 50.0, "active ")],
                              "approvalbkey long, currentdate date, nextdate date, dpddate date, balance double, "
                              "currentleasestatus string")
    app = spark.createDataFrame([], "approvalbkey long, approvalid long")
    sums = spark.createDataFrame([(7, 1)], "approvalbkey long, storebkey long")
    store = spark.createDataFrame([(1, "FLS")], "storebkey long, storetype string")
    lv = spark.createDataFrame([], "approvalid long, leaseaddeddate date")
    days = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 5),)], "caldate date")
    by_day = rc.balance_by_day(spark, j, app, sums, store, lv, D(2024, 1, 1), D(2024, 1, 5), D(2024, 1, 5))
    assert {(r.caldate.day, r.storetype) for r in by_day.collect()} == {(1, None), (2, "FLS"), (3, "FLS"), (4, None), (5, None)}
    own = rc.balance_by_day(spark, j, app, sums, store, lv, D(2024, 1, 1), D(2024, 1, 5), D(2024, 1, 5), days_table=days)
    assert sorted((r.caldate.day, r.storetype) for r in own.collect()) == [(2, "FLS"), (5, None)]


def test_payments_without_a_date_do_not_count(spark):
    rows = [(1, 1, "client", D(2020, 1, 2), "Payment - Settled"), (1, 1, "CLIENT ", None, "payment - settled")]
    j = spark.createDataFrame(rows, "approvalbkey long, buyoutpayment int, entity string, effectivedate date, acctdesc string")
    r = col.buyout_rollup(j, D(2020, 6, 1), D(2019, 1, 1)).first()
    assert (r.settled_buyouts, r.total_buyouts_scheduled) == (1, 1)
    assert col.buyout_cohort(j, D(2019, 1, 1)).first().sum_buyout == 2
