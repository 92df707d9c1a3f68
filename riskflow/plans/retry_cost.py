"""Delinquent balance by day x card-retry ("blitz") cost, with running totals.

Stages: journal intervals -> days in the reporting window -> balance per
account-day (plus the calendar spine) ; card attempts -> cost per attempt ->
totals per account-day ; full outer join of the two ; running attempts, cost,
successes and payments per account ; totals that restart after each success.

Scale notes
* The interval range join ``day > current AND day <= next`` is replaced by a
  per-row ``sequence`` clipped to the window (no nested-loop join, no shuffle).
* Dimension lookups run on the journal rows before the day expansion.
* The calendar spine is added as "days with no rows" (an anti join of the tiny
  calendar against the distinct days present) and a union, instead of a left
  join of the calendar against all rows on ``caldate`` -- that join would
  shuffle every account-day on one of only N-days keys.
* The per-account max/min lookups are window aggregates on the same
  partitioning as the running sums: one shuffle on the account for all of them.
  An account has at most one row per day and balance variant, so a window
  partition is bounded by the reporting window, not by the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.dates import day_diff, lit_date, month_boundaries, yyyymm
from riskflow.functions.numeric import floor_zero
from riskflow.functions.strings import is_blank, same_text, text_in
from riskflow.operators.intervals import calendar, explode_days
from riskflow.operators.materialize import materialize
from riskflow.operators.running import running_window, whole_partition
from riskflow.sources.codes import DQ_STATUSES
from riskflow.sources.sinks import read_table, replace_table

# Cost per retry attempt by processing step and outcome, and the
# number of card transactions each step makes.
AUTH_COST = 0.20
STEP_COST = {  # step: (cost if failed, cost if successful)
    "Percent100": (0.40, 0.75),
    "Percent50": (0.60, 0.95),
    "Dollars25": (0.80, 1.15),
}
TRAN_COUNT = {"Authorize": 1, "Percent100": 2, "Percent50": 3, "Dollars25": 4}


def _blank_to_core(c):
    """``CASE WHEN c = ' ' THEN 'CORE' ELSE c END`` (blank test ignores trailing spaces)."""
    return F.when(is_blank(c), F.lit("CORE")).otherwise(c)


def _store_type(dim_approval: DataFrame, fact_leasesum: DataFrame, dim_store: DataFrame
                ) -> DataFrame:
    """approvalbkey -> (approvalid, raw storetype)."""
    return (dim_approval.select("approvalbkey", "approvalid")
            .join(fact_leasesum.select("approvalbkey", "storebkey"), "approvalbkey", "left")
            .join(dim_store.select("storebkey", "storetype"), "storebkey", "left")
            .drop("storebkey"))


def balance_by_day(spark: SparkSession, dq_journal: DataFrame, dim_approval: DataFrame,
                   fact_leasesum: DataFrame, dim_store: DataFrame, lease_view: DataFrame,
                   start, end, as_of, days_table: DataFrame | None = None) -> DataFrame:
    """Delinquent balance per calendar day and account, with empty days kept.

    ``days_table`` (caldate) is the calendar to report on; without one, every day counts.
    """
    j = (dq_journal
         .filter(text_in("currentleasestatus", DQ_STATUSES) & F.col("dpddate").isNotNull())
         .select("approvalbkey", "currentdate", "nextdate", "dpddate", "balance",
                 "currentleasestatus"))
    # dimension lookups before the day expansion (1 row per interval, not per day); the
    # approval and the store are both looked up by the journal's own key, so an account
    # without an approval keeps its store type
    store = (fact_leasesum.select("approvalbkey", "storebkey")
             .join(dim_store.select("storebkey", "storetype"), "storebkey", "left").drop("storebkey"))
    j = (j.join(dim_approval.select("approvalbkey", "approvalid"), "approvalbkey", "left")
          .join(store, "approvalbkey", "left"))
    days = explode_days(j, "caldate", start, end, closed="right")
    # read twice below (rows, and the days that have any): written once
    b = materialize(days.groupBy("caldate", "dpddate", "storetype", "approvalbkey", "approvalid")
                    .agg(F.sum("balance").alias("balance"),
                         F.max("currentleasestatus").alias("currentleasestatus")), "balance-by-day")
    cal = calendar(spark, start, end) if days_table is None else days_table.filter(
        F.col("caldate").between(lit_date(start), lit_date(end)))
    b = b.join(cal.select("caldate").distinct(), "caldate", "left_semi") if days_table is not None else b
    empty_days = cal.join(b.select("caldate").distinct(), "caldate", "left_anti")
    rows = (b.withColumn("dq_date", F.col("caldate"))
             .unionByName(empty_days.drop("weekdaylong"), allowMissingColumns=True))
    lv = lease_view.select(F.col("approvalid").alias("_lv_id"), "leaseaddeddate")
    rows = rows.join(lv, F.col("approvalid") == F.col("_lv_id"), "left")
    return rows.select(
        "caldate",
        F.date_format("caldate", "EEEE").alias("weekdaylong"),
        "dpddate",
        day_diff("dpddate", "caldate").alias("dq_days"),
        "dq_date",
        "leaseaddeddate",
        month_boundaries("leaseaddeddate", lit_date(as_of)).alias("mob"),
        "approvalbkey",
        "approvalid",
        "currentleasestatus",
        _blank_to_core(F.col("storetype")).alias("storetype"),
        floor_zero("balance").alias("dq_bal"),
    )


def retry_cost(card_attempts: DataFrame, dim_approval: DataFrame, fact_leasesum: DataFrame,
               dim_store: DataFrame, start, end) -> DataFrame:
    """Cost, collected amount and card transactions per retry attempt."""
    ok = F.col("paymentsuccessful")

    def step_is(step):
        return same_text("cardprocessingdescription", step)

    cost = F.when(step_is("Authorize"), F.lit(AUTH_COST))
    for step, (fail, success) in STEP_COST.items():
        cost = (cost.when(step_is(step) & (ok == 0), F.lit(fail))
                    .when(step_is(step) & (ok == 1), F.lit(success)))
    cost = cost.otherwise(F.lit(0.0))
    tran = F.when(step_is("Authorize"), 1)
    for step, n in list(TRAN_COUNT.items())[1:]:
        tran = tran.when(step_is(step), n)
    tran = tran.otherwise(0)
    day = F.to_date("ts")
    attempts = card_attempts.filter(day.between(lit_date(start), lit_date(end)))
    keys = _store_type(dim_approval, fact_leasesum, dim_store)
    return (attempts.join(keys, "approvalid", "left")
            .select("approvalid", "approvalbkey", "storetype",
                    day.alias("blitz_date"),
                    F.when(ok == 1, F.col("totalpayment")).otherwise(F.lit(0.0))
                     .alias("total_collected"),
                    cost.alias("blitz_cost"),
                    tran.alias("tran_count")))


def retry_daily(costs: DataFrame) -> DataFrame:
    """Attempt totals per store type, account and day."""
    return (costs.groupBy("storetype", "approvalbkey", "blitz_date")
            .agg(F.sum("tran_count").cast("long").alias("tran_count"),
                 F.count(F.lit(1)).alias("card_count"),
                 F.sum("total_collected").alias("total_collected"),
                 F.sum("blitz_cost").alias("blitz_cost"),
                 F.sum(F.when(F.col("total_collected") > 0, 1).otherwise(0)).cast("long")
                  .alias("success_count")))


def retry_master(by_day: DataFrame, daily: DataFrame) -> DataFrame:
    """Full outer join of balances and attempts on (account, day)."""
    dq = by_day.alias("dq")
    bc = daily.alias("bc")
    j = dq.join(bc, (F.col("bc.approvalbkey") == F.col("dq.approvalbkey"))
                & (F.col("bc.blitz_date") == F.col("dq.caldate")), "full_outer")
    st = F.coalesce(F.col("bc.storetype"), F.col("dq.storetype"))
    return j.select(
        F.col("dq.caldate").alias("caldate"),
        F.col("dq.currentleasestatus").alias("currentleasestatus"),
        F.col("dq.weekdaylong").alias("weekdaylong"),
        F.col("dq.dpddate").alias("dpddate"),
        F.col("dq.dq_days").alias("dq_days"),
        F.col("dq.leaseaddeddate").alias("leaseaddeddate"),
        F.col("dq.mob").alias("mob"),
        F.coalesce(F.col("bc.approvalbkey"), F.col("dq.approvalbkey")).alias("approvalbkey"),
        F.col("dq.approvalid").alias("approvalid"),
        _blank_to_core(st).alias("storetype"),
        F.col("dq.dq_bal").alias("dq_bal"),
        F.col("bc.blitz_date").alias("blitz_date"),
        F.col("bc.tran_count").alias("tran_count"),
        F.col("bc.total_collected").alias("blitz_payment"),
        F.col("bc.blitz_cost").alias("blitz_cost"),
        F.col("bc.success_count").alias("success_count"),
        F.col("bc.card_count").alias("card_count"),
    )


# total order inside an account: the date, then every column that can differ
# between two rows of one account-day
_TIE = ["storetype", "dpddate", "approvalid", "caldate", "blitz_date", "dq_bal", "leaseaddeddate",
        "blitz_cost", "tran_count", "blitz_payment", "success_count", "card_count"]


def _order():
    return [F.col("master_date").asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in _TIE]


def retry_running(master: DataFrame, as_of) -> DataFrame:
    """Running attempts, cost, successes and payments per account."""
    key = F.col("approvalbkey")
    m = master.withColumn("master_date", F.coalesce("caldate", "blitz_date"))
    whole = whole_partition(["approvalbkey"])
    m = m.withColumns({
        "blitz_succ_date": F.when(key.isNotNull(), F.max(
            F.when(F.col("success_count") > 0, F.col("blitz_date"))).over(whole)),
        "first_blitz_date": F.when(key.isNotNull(), F.min("blitz_date").over(whole)),
    })
    dss = day_diff("blitz_succ_date", lit_date(as_of))
    counted = (F.col("blitz_date").isNotNull() & (dss.isNull() | (dss >= 0)))
    w = running_window(["approvalbkey"], _order())
    m = m.withColumns({
        "dayssincesuccess": dss,
        "blitz_attempt": F.sum(F.when(counted, 1).otherwise(0)).over(w).cast("long"),
        "cumulative_cost": F.sum(F.when(counted, F.col("blitz_cost")).otherwise(F.lit(0.0)))
                            .over(w),
        "cum_success": F.sum(F.when(F.col("success_count") > 0, 1).otherwise(0)).over(w)
                        .cast("long"),
        "cumulative_payments": F.sum("blitz_payment").over(w),
        "blitzvintage": yyyymm("first_blitz_date"),
        "lease_yyyymm": yyyymm("leaseaddeddate"),
    })
    return m


def retry_segments(running: DataFrame, keep_from=None) -> DataFrame:
    """Cost and attempts since the last success (the success row opens a segment)."""
    w = running_window(["approvalbkey", "cum_success"], _order())
    out = running.withColumns({
        "cum_cost": F.sum("blitz_cost").over(w),
        "cum_attempt": F.sum(F.when(F.col("blitz_cost").isNotNull(), 1).otherwise(0)).over(w)
                        .cast("long"),
    })
    if keep_from is not None:
        out = out.filter(F.col("master_date") >= lit_date(keep_from))
    return out


def retry_report(spark, dq_journal, card_attempts, dim_approval, fact_leasesum, dim_store,
                 lease_view, start, end, as_of, keep_from=None, days_table=None) -> DataFrame:
    """The whole report: balance by day x retry cost with running and segment totals."""
    by_day = balance_by_day(spark, dq_journal, dim_approval, fact_leasesum, dim_store,
                            lease_view, start, end, as_of, days_table)
    daily = retry_daily(retry_cost(card_attempts, dim_approval, fact_leasesum, dim_store,
                                   start, end))
    running = retry_running(retry_master(by_day, daily), as_of)
    return retry_segments(running, keep_from)


def publish_retry_report(path: str, *tables, **options) -> DataFrame:
    """Write the report as a stored table (replacing the last one) and read it back."""
    replace_table(retry_report(*tables, **options), path)
    return read_table(tables[0], path)

