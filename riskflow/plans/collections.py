"""Missed-buyout collection list.

journal entries -> per-lease buyout rollup -> buyout type -> joined with the
as-of delinquency slice, the lease and today's card attempts -> filtered list;
plus the duplicate audit, full refresh / unseen-key append, and the worklist.

Scale notes: the rollup is a single hash aggregate on the lease key (map-side
partial aggregation, so a lease with a third of all journal rows is combined
before the shuffle). The cohort test (first buyout after ``min_date``) is folded
into the same aggregate instead of a second aggregate + semi join. The as-of
slice of the delinquency journal is filtered before its join, and the inner
(filtering) join runs first so the later outer joins see the reduced list.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.dates import day_diff, lit_date
from riskflow.functions.numeric import safe_ratio
from riskflow.functions.strings import same_text
from riskflow.operators.dedup import not_in_keys, rows_with_duplicate_key
from riskflow.operators.intervals import as_of_slice
from riskflow.sources.sinks import append_unseen, read_table, replace_table, table_exists

# Journal descriptions of buyout payments.
SETTLED = "Payment - Settled"
CANCELLED = "Payment - Cancelled"
RETURNED = "Payment - Returned"
PENDING = "Payment - Pending"
# Grace period in days, and the default for a missing success date.
GRACE_DAYS = 7
NO_SUCCESS_DATE = _dt.date(1990, 1, 1)

ROLLUP_COLUMNS = [
    "approvalbkey", "settled_buyouts", "elligible_buyouts", "total_buyouts_scheduled",
    "active_cancelled_buyouts", "future_cancelled_buyouts", "missed_buyouts",
    "first_buyout_scheduled", "active_pending_buyouts", "future_pending_buyouts",
    "last_buyout_scheduled", "most_recent_elligible", "most_recent_success",
]


def _client_buyouts(journal: DataFrame) -> DataFrame:
    return journal.filter((F.col("buyoutpayment") == 1) & same_text("entity", "client"))


def buyout_cohort(journal: DataFrame, min_date) -> DataFrame:
    """Leases whose client buyout payments all fall after ``min_date``."""
    return (_client_buyouts(journal)
            .groupBy("approvalbkey")
            .agg(F.sum("buyoutpayment").cast("long").alias("sum_buyout"),
                 F.min("effectivedate").alias("_first"))
            .filter((F.col("sum_buyout") > 0) & (F.col("_first") > lit_date(min_date)))
            .drop("_first"))


def buyout_rollup(journal: DataFrame, as_of, min_date) -> DataFrame:
    """Twelve conditional measures per lease of the cohort (cut = as_of - 7 days)."""
    cut = F.date_sub(lit_date(as_of), GRACE_DAYS)
    d = F.col("effectivedate")
    due = d <= cut

    def is_(status):
        return same_text("acctdesc", status)

    def count_if(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    # rows are already buyout payments of the client entity; every group that
    # passes the cohort test (first date > min_date) has all its known dates >=
    # min_date, so one aggregate does the cohort test and the rollup's date filter;
    # only rows without a date are left to drop (the minimum skips them, the filter
    # of the rollup does not keep them).
    return (_client_buyouts(journal).filter(d.isNotNull())
            .groupBy("approvalbkey")
            .agg(count_if(is_(SETTLED)).alias("settled_buyouts"),
                 count_if(due & ~is_(CANCELLED)).alias("elligible_buyouts"),
                 F.sum("buyoutpayment").cast("long").alias("total_buyouts_scheduled"),
                 count_if(is_(CANCELLED) & due).alias("active_cancelled_buyouts"),
                 count_if(is_(CANCELLED) & (d > cut)).alias("future_cancelled_buyouts"),
                 count_if(due & is_(RETURNED)).alias("missed_buyouts"),
                 F.min(d).alias("first_buyout_scheduled"),
                 count_if(is_(PENDING) & due).alias("active_pending_buyouts"),
                 count_if(is_(PENDING) & (d > cut)).alias("future_pending_buyouts"),
                 F.max(d).alias("last_buyout_scheduled"),
                 F.max(F.when(due, d)).alias("most_recent_elligible"),
                 F.max(F.when(is_(SETTLED), d)).alias("most_recent_success"),
                 F.min(d).alias("_first"))
            .filter(F.col("_first") > lit_date(min_date))
            .drop("_first"))


def buyout_type(rollup: DataFrame, as_of) -> DataFrame:
    """Classify leases with an eligible buyout (most recent eligible on or before the cut)."""
    cut = F.date_sub(lit_date(as_of), GRACE_DAYS)
    e, s = F.col("elligible_buyouts"), F.col("settled_buyouts")
    kind = (F.when((e > 0) & (e == s), "All Eligible paid")
              .when(e > s, "At least 1 Buyout Missed")
              .when(s == 0, "No Buyouts Paid")
              .otherwise("undetermined"))
    return (rollup.filter(F.col("most_recent_elligible") <= cut)
                  .withColumn("buyout_type", kind))


def collection_list(buyouts: DataFrame, dim_approval: DataFrame, lease_view: DataFrame,
                    dq_journal: DataFrame, card_attempts: DataFrame, as_of) -> DataFrame:
    """Leases with a missed buyout, delinquent for over a week, balance over 100."""
    today = lit_date(as_of)
    cut = F.date_sub(today, GRACE_DAYS)
    dq = (as_of_slice(dq_journal, as_of, closed="left")
          .filter((F.col("balance") > 100) & ~same_text("currentleasestatus", "CHARGEOFF")
                  & (day_diff("dpddate", today) > GRACE_DAYS))
          .select("approvalbkey", "totalpaid", "balance", "dpddate"))
    a = buyouts.filter((F.col("missed_buyouts") > 0)
                       & (F.coalesce(F.col("most_recent_success"), lit_date(NO_SUCCESS_DATE))
                          <= cut))
    app = dim_approval.select("approvalbkey", F.col("approvalid").alias("_app_id"))
    lv = lease_view.select(F.col("approvalid").alias("_lv_id"), "leasestatus",
                           "leaseaddeddate", "leaseamount")
    cb = (card_attempts.filter(F.to_date("ts") == today)
          .select(F.col("approvalid").alias("_cb_id")))
    j = (a.join(dq, "approvalbkey", "inner")
          .join(app, "approvalbkey", "left")
          .join(lv, F.col("_app_id") == F.col("_lv_id"), "left")
          .join(cb, F.col("_cb_id") == F.col("_lv_id"), "left"))
    return j.select(
        F.col("_lv_id").alias("approvalid"),
        "leasestatus",
        *[F.col(c) for c in ROLLUP_COLUMNS], "buyout_type",
        F.to_date("leaseaddeddate").alias("leaseaddeddate"),
        "leaseamount",
        "totalpaid",
        safe_ratio("totalpaid", "leaseamount").alias("roi"),
        F.col("balance").alias("balance_owed"),
        "dpddate",
        day_diff("first_buyout_scheduled", today).alias("daysinbuyout"),
        F.coalesce(day_diff("dpddate", today), F.lit(0)).alias("dqdays"),
        F.when(F.col("_cb_id").isNotNull(), 1).otherwise(0).alias("blitzed"),
        today.alias("added_to_list_date"),
    )


def build_list(journal, dim_approval, lease_view, dq_journal, card_attempts, as_of, min_date
               ) -> DataFrame:
    rollup = buyout_rollup(journal, as_of, min_date)
    return collection_list(buyout_type(rollup, as_of), dim_approval, lease_view, dq_journal,
                           card_attempts, as_of)


def duplicate_audit(final_list: DataFrame) -> DataFrame:
    """List rows whose approvalid appears more than once (the fan-out check)."""
    return rows_with_duplicate_key(final_list, "approvalid")


def new_entries(final_list: DataFrame, stored_list: DataFrame) -> DataFrame:
    """Rows to append: keys not yet in the stored list (SQL ``NOT IN`` semantics)."""
    return not_in_keys(final_list, "approvalbkey", stored_list)


def store_list(final_list: DataFrame, path: str, full_refresh: bool = False) -> int:
    """Keep the stored collection list current.

    full_refresh=True replaces the table with today's list; otherwise only leases
    whose key is not stored yet are appended (their added date is today). Returns
    the number of rows written.
    """
    if full_refresh or not table_exists(final_list.sparkSession, path):
        replace_table(final_list, path)
        return read_table(final_list.sparkSession, path).count()
    return append_unseen(final_list, path, "approvalbkey")


def stored_by_days(stored_list: DataFrame) -> DataFrame:
    """Every row of the stored list, the least delinquent first."""
    return stored_list.orderBy(F.col("dqdays").asc(), F.col("missed_buyouts").desc(), F.col("balance_owed").asc())


def worklist(stored_list: DataFrame, by_added_date: bool = False) -> DataFrame:
    """Prioritised calls: cheap-to-collect leases, most urgent first."""
    roi, dq = F.col("roi"), F.col("dqdays")
    keep = ((dq <= 60) & (roi <= 2)) | ((dq > 60) & (roi <= 1.5))
    cols = ["approvalid", "leasestatus", "missed_buyouts", "roi", "balance_owed", "dqdays",
            "daysinbuyout"]
    order = [F.col("missed_buyouts").desc(), F.col("balance_owed").asc()]
    if by_added_date:
        return stored_list.filter(keep).orderBy(F.col("added_to_list_date").desc(), *order)
    return stored_list.filter(keep).select(*cols).orderBy(dq.asc(), *order)
