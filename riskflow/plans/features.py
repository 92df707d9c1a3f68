"""Model features: single-lease cohort, per-entity attributes, assembly, distance, bins.

Every attribute table is one aggregate or top-1 on its own key; the assembly
is a chain of left joins grouped by key (approval keys first, then client keys,
then card, zip and store keys) so Spark re-shuffles the wide row only when the
key changes. Key-membership filters (``IN (SELECT ...)``) are left-semi joins
against distinct keys; the group-size filter (``HAVING COUNT(*) = 1``) is one
aggregate that also holds the group's only row, never a window, so a hot key is
combined map-side.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.dates import lit_date, month_boundaries, year_boundaries, yyyymm
from riskflow.functions.numeric import great_circle_miles, safe_ratio
from riskflow.functions.strings import folded, is_blank, not_blank_or, pad_right2, same_text, text_in
from riskflow.operators.binning import capped_levels, range_bins
from riskflow.operators.dedup import top1_per_key
from riskflow.operators.groupstat import group_statistics, with_group_statistics
from riskflow.operators.materialize import materialize
from riskflow.sources.codes import NO_CODE, ONLINE_STORE_NUMBERS, RISK_CODES, RISK_PREFIX

# A lease counts as seasoned after this many days.
SEASONED_DAYS = 150
# Lease cost above amount by more than this sets add_flag.
ADD_ON_MARGIN = 100


def in_keys(df: DataFrame, col: str, keys: DataFrame, key_col: str) -> DataFrame:
    """``WHERE col IN (SELECT key_col FROM keys)``.

    The distinct keys of a partition are hashed, one small entry each, so that the rows,
    of which most go, are not sorted first.
    """
    k = keys.select(F.col(key_col).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    return df.join(k.hint("shuffle_hash"), df[col] == k["_k"], "left_semi")


# ------------------------------------------------------------------- P01, P02
def single_lease_cohort(lease_view: DataFrame, lease_period: DataFrame,
                        dim_approval: DataFrame, fact_leasesum: DataFrame,
                        dim_store: DataFrame, as_of) -> DataFrame:
    """Leases of clients with exactly one lease, with the fraud label and season flag."""
    # a client's only lease is the largest of its leases: one aggregate counts them and holds the row
    lv = (lease_view.groupBy("clientid")
          .agg(F.count("clientid").alias("_n"),
               *[F.max(c).alias(c) for c in ("approvalid", "totalpaymentsmade", "leaseaddeddate")])
          .filter(F.col("_n") == 1).drop("_n"))
    lp = lease_period.select("approvalid", "firstrentpayment", "additionaldownpayment")
    store = (dim_approval.select("approvalid", "approvalbkey")
             .join(fact_leasesum.select("approvalbkey", "storebkey"), "approvalbkey", "left")
             .join(dim_store.select("storebkey", "storetype"), "storebkey", "left")
             .select("approvalid", "storetype"))
    first = F.col("firstrentpayment") + F.col("additionaldownpayment")
    cut = F.date_sub(lit_date(as_of), SEASONED_DAYS)
    return (lv.join(lp, "approvalid", "left").join(store, "approvalid", "left")
            .select("approvalid", "totalpaymentsmade", "clientid",
                    first.alias("firstrentpayment"),
                    not_blank_or("storetype", "CORE").alias("storetype"),
                    F.col("leaseaddeddate").alias("origination_date"),
                    F.when(F.col("totalpaymentsmade") <= first, 1).otherwise(0).alias("fraud"),
                    F.when(F.to_date("leaseaddeddate") <= cut, 1).otherwise(0)
                     .alias("seasoned_lease")))


# Output column names.
LEASE_ATTR_COLUMNS = ["leaseid", "clientid", "approvalid", "storeid", "clientstatus",
                      "monthlyincome", "clientaddeddate", "latestfrauddate", "leaseaddeddate", "leasecost",
                      "leaseamount", "paymentfrequency"]


def lease_attributes(lease_view: DataFrame, cohort: DataFrame) -> DataFrame:
    return in_keys(lease_view.select(*LEASE_ATTR_COLUMNS), "approvalid", cohort, "approvalid")


def cohort_tables(lease_view: DataFrame, lease_period: DataFrame, dim_approval: DataFrame,
                  fact_leasesum: DataFrame, dim_store: DataFrame, as_of
                  ) -> tuple[DataFrame, DataFrame]:
    """(cohort, lease attributes), each materialised once.

    Every attribute table filters on the cohort's approval, client or store keys,
    and the assembly joins onto it; materialising keeps the lease table from being
    re-scanned and re-aggregated in each of those branches. The attributes are the lease
    rows whose key is in the cohort: a lease that the cohort holds twice (two period rows)
    has its attributes once.
    """
    cohort = materialize(single_lease_cohort(lease_view, lease_period, dim_approval, fact_leasesum,
                                             dim_store, as_of), "cohort")
    return cohort, materialize(lease_attributes(lease_view, cohort), "lease-attributes")


# ------------------------------------------------------------------- P03 - P08
def bank_top1(bank: DataFrame, lease_attrs: DataFrame) -> DataFrame:
    """One active payment record per client: latest first, then the other columns."""
    b = in_keys(bank.filter(F.col("active") == 1), "clientid", lease_attrs, "clientid")
    order = [("ts", "desc"), ("primarypaymentmethod", "asc"), ("cardnumbertoken", "asc"),
             ("expdate", "asc"), ("active", "asc"), ("accounttype", "asc"), ("debitorcredit", "asc"),
             ("routingnumber", "asc"), ("cardname", "asc")]
    return top1_per_key(b, ["clientid"], order)


def card_sharing(bank: DataFrame, lease_attrs: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Number of distinct clients per card token; with ``cutoff``, tokens shared by so many
    clients or more (placeholders) are left out."""
    b = in_keys(bank, "clientid", lease_attrs, "clientid")
    counts = b.groupBy("cardnumbertoken").agg(F.count_distinct("clientid").alias("card_appear_number"))
    if cutoff is not None:
        counts = counts.filter(F.col("card_appear_number") < cutoff)
    return (counts
             .select("card_appear_number", F.col("cardnumbertoken").alias("cardnumber")))


def store_attributes(stores: DataFrame, lease_attrs: DataFrame) -> DataFrame:
    s = in_keys(stores, "storeid", lease_attrs, "storeid")
    return s.select("storeid", "zip", F.left("zip", F.lit(1)).alias("zipgroup1"), "state",
                    "city")


def cart_diversity(cart: DataFrame) -> DataFrame:
    """Distinct and total SKUs per approval; ratio NULL for an all-NULL cart."""
    g = cart.groupBy("approvalid").agg(
        F.count_distinct("sku").alias("distinct_sku_count"),
        F.count("sku").alias("sku_count"))
    return g.select("approvalid", "distinct_sku_count", "sku_count",
                    (F.col("sku_count") - F.col("distinct_sku_count")).alias("sku_dif"),
                    safe_ratio("distinct_sku_count", "sku_count").alias("sku_ratio"))


def client_attributes(client_info: DataFrame, lease_attrs: DataFrame, cohort_only: bool = False) -> DataFrame:
    """Client fields, age at lease date, and how many clients share the licence.

    Licences are compared under the source collation (case and trailing blanks do not count), over
    all clients; a licence that many of them share is joined without an exchange.
    ``cohort_only`` gives the rows of clients with lease attributes alone.
    """
    held = folded("driverslicense")
    # read by the statistics and by the rows that get them
    clients = materialize(client_info, "clients")
    licences = group_statistics(clients, held, {"license_appear_number": F.count("clientid")})
    lv = lease_attrs.select(F.col("clientid").alias("_cid"), "leaseaddeddate")
    same = F.col("clientid") == F.col("_cid")
    if cohort_only:
        c = with_group_statistics(clients.join(lv.hint("shuffle_hash"), same), held, licences, ["license_appear_number"])
    else:
        c = with_group_statistics(clients, held, licences, ["license_appear_number"]).join(lv, same, "left")
    return c.select("clientid", "driverslicense", "driverslicensestate", "dob",
                    year_boundaries("dob", "leaseaddeddate").alias("age"),
                    "firstname", "lastname", "ipaddress", "ts", "idtype", "languagepreference",
                    "license_appear_number")


def fp_attributes(fp_results: DataFrame, cohort: DataFrame) -> DataFrame:
    """Third-party score fields per approval (string MAX is lexical, then padded)."""
    fp = in_keys(fp_results.withColumn("ts", F.to_date("ts")), "approvalid", cohort, "approvalid")

    def idx(c):
        return F.nullif(pad_right2(F.max(c)), F.lit("0"))

    return fp.groupBy("approvalid").agg(
        F.max("fraudscore").alias("fraudscore"),
        F.max("cvi").alias("cvi"),
        idx("napindex").alias("napindex"),
        idx("nasindex").alias("nasindex"),
        F.max("ts").alias("fp_timestamp"))


def approval_amount(approval: DataFrame, cohort: DataFrame) -> DataFrame:
    """Approval amount of cohort leases (one row per approval row; no MAX applied)."""
    return in_keys(approval.select("approvalid", "approvalamount"), "approvalid", cohort,
                    "approvalid")


def payment_at_origination(lease_attrs: DataFrame, bank: DataFrame) -> DataFrame:
    """ACH and card payment records dated on the lease date, per client."""
    same_day = F.to_date("leaseaddeddate") == F.col("_day")
    m = "primarypaymentmethod"
    # of a payment record, its day and what it is; the leases are hashed, few and narrow beside the records
    paid = bank.select("clientid", F.to_date("ts").alias("_day"), same_text(m, "ACH").alias("_ach"), same_text(m, "CreditCard").alias("_cc"))
    j = lease_attrs.select("clientid", "leaseaddeddate").hint("shuffle_hash").join(paid, "clientid", "left")
    return j.groupBy("clientid").agg(
        F.sum(F.when(F.col("_ach") & same_day, 1).otherwise(0)).cast("long").alias("ach_orig"),
        F.sum(F.when(F.col("_cc") & same_day, 1).otherwise(0)).cast("long").alias("cc_orig"))


def store_inception(lease_view: DataFrame) -> DataFrame:
    return lease_view.groupBy("storeid").agg(
        F.min(F.to_date("leaseaddeddate")).alias("st_inception_date"))


def customer_zip_top1(address: DataFrame) -> DataFrame:
    """One active 5-digit zip per client: latest record first, then the zip."""
    a = (address.filter(F.col("active") == 1)
         .select("clientid", F.substring("zip", 1, 5).alias("customer_zip"), "ts"))
    return top1_per_key(a, ["clientid"], [("ts", "desc"), ("customer_zip", "asc")]
                        ).drop("ts")


# ------------------------------------------------------------------------ P16
RISK_FLAG_COLUMNS = [RISK_PREFIX + c for c in RISK_CODES]
NONE_FLAG = RISK_PREFIX + NO_CODE


def online_approvals(decision_system: DataFrame) -> DataFrame:
    return (decision_system.filter(F.col("storenumber").isin(*ONLINE_STORE_NUMBERS))
            .select(F.col("approvalid").alias("_online_id")).distinct())


MASTER_COLUMNS = (
    "_mc_v2_z_sum", "origination_date", "storetype", "fraud", "seasoned_lease",
    "leaseid", "clientid", "approvalid", "storeid", "clientstatus", "monthlyincome", "clientaddeddate", "latestfrauddate",
    "leaseaddeddate", "leasecost", "leaseamount", "paymentfrequency", "primarypaymentmethod", "cardnumbertoken", "expdate",
    "accounttype", "debitorcredit", "routingnumber", "cardname", "ipaddress", "driverslicense", "firstname", "lastname",
    "distinct_sku_count", "sku_count", "sku_ratio", "sku_dif", "card_appear_number",
    "driverslicensestate", "age", "idtype", "languagepreference", "license_appear_number", "zip", "zipgroup1", "state", "city",
    "fraudscore", "cvi", "nasindex", "napindex", "fp_timestamp", "approvalamount", "ach_orig", "cc_orig", "customer_zip",
    "st_inception_date", "store_lat", "store_long", "cus_lat", "cus_long", *RISK_FLAG_COLUMNS, NONE_FLAG,
    "storeage", "seasonality", "state_flag", "online", "add_flag", "ltc", "lease_yyyymm")
# Columns of the master that the bins and the scores read.
BIN_INPUTS = ("approvalid", "storetype", "leaseaddeddate", "storeid", "fraud", "online", "monthlyincome", "add_flag",
              "paymentfrequency", "seasonality", "state_flag", "zipgroup1", "age", "ltc", "primarypaymentmethod",
              "card_appear_number", "sku_dif", "languagepreference", "idtype", "cc_orig", "nasindex", "napindex", "cvi",
              "fraudscore", "fp_timestamp", "storeage", "store_lat", "store_long", "cus_lat", "cus_long",
              "_mc_v2_z_sum", *RISK_FLAG_COLUMNS, NONE_FLAG)
# What the derived columns of the master are made from.
_MADE_FROM = {
    "storeage": ("st_inception_date", "leaseaddeddate"), "seasonality": ("origination_date",),
    "state_flag": ("driverslicensestate", "state"), "add_flag": ("leasecost", "leaseamount"),
    "ltc": ("leaseamount", "approvalamount"), "lease_yyyymm": ("origination_date",),
}


# Read by the bins but by no model: single columns, which are dropped below the joins where they are not read.
_SINGLE = ("fraud", "napindex")


def _packed(df: DataFrame, name: str, columns, keys=()) -> list[Column]:
    """``keys`` as they are and the other columns of ``df`` (those of ``columns``, if given) as one struct ``name``.

    A struct is copied as one field by every later join, sort and exchange. Single columns would
    add up to joins of so many fields that the JVM does not compile their generated code. All
    fields of a struct must be read in the end, or the optimizer takes it apart below the joins.
    """
    rest = [c for c in df.columns if c not in keys and (columns is None or c in columns)]
    inner, single = [c for c in rest if c not in _SINGLE], [c for c in rest if c in _SINGLE]
    return [*keys, *single, *([F.struct(*inner).alias(name)] if inner else [])]


def _looked_up(j: DataFrame, key: str, lookup: DataFrame, lookup_key: str, columns, keys=()) -> DataFrame:
    """``j`` left-joined with the packed ``lookup``; ``keys`` of it stay single columns."""
    right = lookup.withColumnRenamed(lookup_key, "_key")
    right = right.select(*_packed(right, f"_packed{len(j.columns)}", columns, ["_key", *keys]))
    return j.join(right, F.col(key) == F.col("_key"), "left").drop("_key")


def feature_master(cohort, lease_attrs, bank1, cart, cards, clients, stores, fp, approval,
                   pay_orig, zips, inception, risk, zip_codes, online, columns=None) -> DataFrame:
    """Join every attribute table onto the cohort (one row per cohort lease).

    ``risk`` is the packed risk-code table (``risk_codes.risk_masks``): two longs go
    through the joins, and the 71 flag columns are produced at the end. With ``columns``,
    only these columns of the master are given, and no others go through the joins.
    """
    from riskflow.plans.risk_codes import RISK_MASKS, risk_flag_exprs
    carried = None if columns is None else {*columns, *RISK_MASKS, *[c for d in columns for c in _MADE_FROM.get(d, ())]}
    ll = cohort.select("approvalid", "origination_date", "storetype", "fraud", "seasoned_lease")
    j = ll.select(*_packed(ll, "_packed", carried, ["approvalid"]))
    # approval-keyed lookups
    j = _looked_up(j, "approvalid", lease_attrs, "approvalid", carried, ["clientid", "storeid"])
    for lookup, key in ((cart, "approvalid"), (fp, "approvalid"), (approval, "approvalid"), (risk, "appid")):
        j = _looked_up(j, "approvalid", lookup, key, carried)
    j = j.join(online, F.col("approvalid") == F.col("_online_id"), "left")
    # client-keyed lookups
    j = _looked_up(j, "clientid", bank1.drop("active", "ts"), "clientid", carried, ["cardnumbertoken"])
    j = _looked_up(j, "clientid", clients.drop("dob", "ts"), "clientid", carried)
    j = _looked_up(j, "clientid", pay_orig, "clientid", carried)
    j = _looked_up(j, "clientid", zips, "clientid", carried, ["customer_zip"])
    # card, store and zip lookups
    geo_c = zip_codes.select(F.col("zip").alias("_gc_zip"), F.col("latitude").alias("cus_lat"),
                             F.col("longitude").alias("cus_long"))
    geo_s = zip_codes.select(F.col("zip").alias("_gs_zip"),
                             F.col("latitude").alias("store_lat"),
                             F.col("longitude").alias("store_long"))
    j = (j.join(cards, F.col("cardnumbertoken") == F.col("cardnumber"), "left")
         .join(stores.withColumnRenamed("storeid", "_s_id"),
               F.col("storeid") == F.col("_s_id"), "left")
         .join(inception.withColumnRenamed("storeid", "_i_id"),
               F.col("storeid") == F.col("_i_id"), "left")
         .join(geo_c, F.col("customer_zip") == F.col("_gc_zip"), "left")
         .join(geo_s, F.col("zip") == F.col("_gs_zip"), "left"))
    j = j.select(*[f"{c}.*" if c.startswith("_packed") else c for c in j.columns])
    exprs = risk_flag_exprs()
    derived = {
        "_mc_v2_z_sum": F.coalesce(F.col("_mc_v2_z_sum"), F.lit(1)),
        **{c: F.expr(exprs[c]) for c in [*RISK_FLAG_COLUMNS, NONE_FLAG]},
        "storeage": month_boundaries("st_inception_date", "leaseaddeddate"),
        "seasonality": F.month("origination_date"),
        "state_flag": F.when(folded("driverslicensestate") != folded("state"), 1).otherwise(0),
        "online": F.when(F.col("_online_id").isNotNull(), 1).otherwise(0),
        "add_flag": F.when(F.col("leasecost") - F.col("leaseamount") > ADD_ON_MARGIN, 1).otherwise(0),
        "ltc": safe_ratio("leaseamount", "approvalamount"),
        "lease_yyyymm": yyyymm("origination_date"),
    }
    return j.select(*[derived[c].alias(c) if c in derived else c for c in MASTER_COLUMNS if columns is None or c in columns])


# ------------------------------------------------------------------------ P17
def with_distance(master: DataFrame) -> DataFrame:
    """Great-circle miles between the customer's and the store's zip."""
    return master.withColumn(
        "distance", great_circle_miles("store_lat", "store_long", "cus_lat", "cus_long"))


# ------------------------------------------------------------------------ P18
# Score-quintile cut points before and from the score-version date.
QUINTILE_CUTS_BEFORE = (608, 659, 699, 741)
QUINTILE_CUTS_AFTER = (652, 706, 747, 790)
QUINTILE_CUTOVER = _dt.date(2015, 4, 1)
# Store-age (months) and distance (miles) bins on the rounded value.
STORE_AGE_BINS = ((None, 1, 1), (2, 3, 2), (4, 10, 3), (11, 20, 4), (21, None, 5))
STORE_AGE_ELSE = 6
DISTANCE_BINS = ((None, 25, 1), (26, 50, 2), (51, 75, 3), (76, 100, 4), (101, 500, 5),
                 (501, None, 6))
DISTANCE_ELSE = 7

# Names of the model inputs.
BIN_COLUMNS = [
    "_my_fraud", "_mc_online", "_m_monthlyincome_1", "_mc_add_flag", "_mc_paymentfrequency",
    "_mc_seasonality", "_mc_state_flag", "_mc_zipgroup1", "_m_age_1", "_m_ltc_1",
    "_mc_primarypaymentmethod", "_mc_card_appear_number", "_mc_storetype", "_mc_sku_dif",
    "_mc_languagepreference", "_mc_idtype", "_mc_cc_orig", "_mc_nas", "_mc_nap", "_mc_cvi",
    "_mcfp_quintile", "_mc_sage_orig", "_mc_sdistance",
]


def _quintile(score: Column, ts: Column, cutover) -> Column:
    def regime(cuts):
        lo, bins = 0, []
        for i, hi in enumerate(cuts):
            bins.append((lo, hi, i + 1))
            lo = hi + 1
        return bins, cuts[-1]

    out = None
    for cond, cuts in ((ts < lit_date(cutover), QUINTILE_CUTS_BEFORE),
                       (ts >= lit_date(cutover), QUINTILE_CUTS_AFTER)):
        bins, top = regime(cuts)
        for lo, hi, label in bins:
            c = cond & score.between(lo, hi)
            out = F.when(c, label) if out is None else out.when(c, label)
        out = out.when(cond & (score > top), 5)
    return out.otherwise(4)


def bin_features(master: DataFrame, quintile_cutover=QUINTILE_CUTOVER) -> DataFrame:
    """The 23 model inputs (labels, levels and bins)."""
    c = F.col
    lang = c("languagepreference")
    lang_bin = F.when(lang.isNull(), 4)
    for v in range(4):
        lang_bin = lang_bin.when(lang == v, v)
    return master.withColumns({
        "_my_fraud": c("fraud"),
        "_mc_online": c("online"),
        "_m_monthlyincome_1": c("monthlyincome"),
        "_mc_add_flag": c("add_flag"),
        "_mc_paymentfrequency": c("paymentfrequency"),
        "_mc_seasonality": c("seasonality"),
        "_mc_state_flag": c("state_flag"),
        "_mc_zipgroup1": c("zipgroup1"),
        "_m_age_1": c("age"),
        "_m_ltc_1": c("ltc"),
        "_mc_primarypaymentmethod": F.when(
            c("primarypaymentmethod").isNotNull() & ~is_blank("primarypaymentmethod"),
            c("primarypaymentmethod")).otherwise(F.lit("CreditCard")),
        "_mc_card_appear_number": capped_levels(c("card_appear_number"), [1, 2], 3,
                                                null_level=0, default=0),
        "_mc_storetype": F.when(text_in("storetype", ("FLS", "AUTO")), F.lit("FLSAUTO"))
                          .otherwise(c("storetype")),
        "_mc_sku_dif": F.when((c("sku_dif") == 0) | c("sku_dif").isNull(), 0)
                        .when(c("sku_dif") == 1, 1).when(c("sku_dif") >= 2, 2),
        "_mc_languagepreference": lang_bin,
        "_mc_idtype": F.when(c("idtype").isNull() | is_blank("idtype"), F.lit("missing"))
                       .otherwise(c("idtype")),
        "_mc_cc_orig": capped_levels(c("cc_orig"), [0, 1], 2),
        "_mc_nas": F.coalesce(c("nasindex"), F.lit("missing")),
        "_mc_nap": F.coalesce(c("napindex"), F.lit("missing")),
        "_mc_cvi": F.when(c("cvi").isNotNull() & ~is_blank("cvi"), c("cvi"))
                    .otherwise(F.lit("missing")),
        "_mcfp_quintile": _quintile(c("fraudscore"), c("fp_timestamp"), quintile_cutover),
        "_mc_sage_orig": range_bins(F.round(c("storeage"), 0), STORE_AGE_BINS, STORE_AGE_ELSE),
        "_mc_sdistance": range_bins(F.round(c("distance"), 0), DISTANCE_BINS, DISTANCE_ELSE),
    })

