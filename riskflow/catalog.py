"""Registered queries over the driver's testdata: key -> f(spark, sf_dir) -> DataFrame.

Each entry binds the testdata domain views (``sources.testdata``) and calls the
library pipeline with the run parameters in ``PARAMS``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskflow.functions.strings import same_text
from riskflow.operators.materialize import materialize, scratch_folder
from riskflow.operators.overlap import interval_join
from riskflow.plans import collections as col
from riskflow.plans import retry_cost as rc
from riskflow.sources.sinks import read_table, write_documents
from riskflow.sources.testdata import PARAMS, TestData

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, scale: int = 4) -> DataFrame:
    """Round double columns for engine-independent comparison (sums of money)."""
    return df.withColumns({f.name: F.round(f.name, scale) for f in df.schema.fields
                           if isinstance(f.dataType, DoubleType)})


# ---------------------------------------------------------------- collections
def _list(td: TestData, as_of) -> DataFrame:
    return col.build_list(td.journal_entry, td.dim_approval, td.lease_view,
                          td.dq_journal_lines, td.card_attempts, as_of,
                          PARAMS.collections_min_date)


@register("buyout_cohort")
def q_buyout_cohort(spark, sf_dir):
    return col.buyout_cohort(TestData(spark, sf_dir).journal_entry, PARAMS.collections_min_date)


@register("buyout_rollup")
def q_buyout_rollup(spark, sf_dir):
    return col.buyout_rollup(TestData(spark, sf_dir).journal_entry, PARAMS.collections_as_of,
                             PARAMS.collections_min_date)


@register("buyout_type")
def q_buyout_type(spark, sf_dir):
    r = q_buyout_rollup(spark, sf_dir)
    return col.buyout_type(r, PARAMS.collections_as_of)


@register("collection_list")
def q_collection_list(spark, sf_dir):
    return _list(TestData(spark, sf_dir), PARAMS.collections_as_of)


@register("collection_dupes")
def q_collection_dupes(spark, sf_dir):
    return col.duplicate_audit(q_collection_list(spark, sf_dir))


@register("collection_worklist")
def q_collection_worklist(spark, sf_dir):
    return col.worklist(q_collection_list(spark, sf_dir))


@register("collection_by_days")
def q_collection_by_days(spark, sf_dir):
    """The list stored as a table, read back by days."""
    path = scratch_folder(spark, "stored-list")
    col.store_list(q_collection_list(spark, sf_dir), path, full_refresh=True)
    return col.stored_by_days(read_table(spark, path))


@register("collection_appended")
def q_collection_appended(spark, sf_dir):
    """The list of an earlier day stored, the day's unseen leases appended, the whole table read back."""
    td, path = TestData(spark, sf_dir), scratch_folder(spark, "appended-list")
    for day, refresh in ((PARAMS.collections_prev_as_of, True), (PARAMS.collections_as_of, False)):
        col.store_list(_list(td, day), path, full_refresh=refresh)
    return read_table(spark, path)


@register("collection_new_only")
def q_collection_new_only(spark, sf_dir):
    td = TestData(spark, sf_dir)
    stored = materialize(_list(td, PARAMS.collections_prev_as_of), "stored-list")
    return col.new_entries(_list(td, PARAMS.collections_as_of), stored)


# ------------------------------------------------------ balance x retry cost
def _by_day(spark, td: TestData) -> DataFrame:
    return rc.balance_by_day(spark, td.dq_journal_events, td.dim_approval, td.fact_leasesum,
                             td.dim_store, td.lease_view, PARAMS.report_start,
                             PARAMS.report_end, PARAMS.report_end)


def _costs(td: TestData) -> DataFrame:
    return rc.retry_cost(td.card_attempts, td.dim_approval, td.fact_leasesum, td.dim_store,
                         PARAMS.report_start, PARAMS.report_end)


def _master(spark, td: TestData) -> DataFrame:
    return rc.retry_master(_by_day(spark, td), rc.retry_daily(_costs(td)))


@register("balance_by_day")
def q_balance_by_day(spark, sf_dir):
    return rounded(_by_day(spark, TestData(spark, sf_dir)))


@register("outage_overlap")
def q_outage_overlap(spark, sf_dir):
    """Shipments on the road during each outage: an interval join of two tables by timestamps."""
    td = TestData(spark, sf_dir)
    hour = 3_600_000_000
    met = interval_join(td.on_road, td.outages, ("left_at", "arrived_at"), ("from_ts", "to_ts"), width=24 * hour)
    return rounded(met.groupBy("outage").agg(
        F.count(F.lit(1)).alias("shipments"), F.count_distinct("approvalid").alias("leases"), F.sum("price").alias("price"),
        F.min("left_at").cast("date").alias("first_left"), F.max("arrived_at").cast("date").alias("last_arrived")), 2)


@register("retry_cost")
def q_retry_cost(spark, sf_dir):
    return rounded(_costs(TestData(spark, sf_dir)))


@register("retry_daily")
def q_retry_daily(spark, sf_dir):
    return rounded(rc.retry_daily(_costs(TestData(spark, sf_dir))))


@register("retry_master")
def q_retry_master(spark, sf_dir):
    return rounded(_master(spark, TestData(spark, sf_dir)))


@register("retry_running")
def q_retry_running(spark, sf_dir):
    return rounded(rc.retry_running(_master(spark, TestData(spark, sf_dir)), PARAMS.report_end))


@register("retry_segments")
def q_retry_segments(spark, sf_dir):
    run = rc.retry_running(_master(spark, TestData(spark, sf_dir)), PARAMS.report_end)
    return rounded(rc.retry_segments(run, PARAMS.report_keep_from))


# ------------------------------------------------------------------ features
from riskflow.plans import features as fe  # noqa: E402
from riskflow.plans import risk_codes as rk  # noqa: E402
from riskflow.plans import scoring as sc  # noqa: E402


class _Features:
    """The attribute tables of one run, built lazily from the testdata views."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.td = TestData(spark, sf_dir)

    @cached_property
    def _cohort(self):
        td = self.td
        return fe.cohort_tables(td.lease_view, td.lease_period, td.dim_approval, td.fact_leasesum,
                                td.dim_store, PARAMS.scoring_as_of)

    @property
    def cohort(self):
        return self._cohort[0]

    @property
    def lease_attrs(self):
        return self._cohort[1]

    def risk_codes(self):
        td = self.td
        return rk.risk_codes(td.lease_view, td.fp_applicant, td.fp_risk_indicators)

    def master(self, columns=None):
        from riskflow.plans.batch import assemble
        return assemble(self.td.table, self.cohort, self.lease_attrs, columns)

    def bins(self):
        # flags travel packed in two longs through the joins and are unpacked once in
        # the final assembly projection; inlining all 2 x 71 bit reads into the score
        # expression would exceed the 64 KB generated-method limit
        return fe.bin_features(fe.with_distance(self.master(fe.BIN_INPUTS)), PARAMS.quintile_cutover)

    def coefs(self):
        return sc.testdata_coefficients(self.spark)

    def scores(self):
        return sc.score(self.bins(), self.coefs())


@register("single_lease_cohort")
def q_single_lease_cohort(spark, sf_dir):
    return rounded(_Features(spark, sf_dir).cohort)


@register("lease_attrs")
def q_lease_attrs(spark, sf_dir):
    return rounded(_Features(spark, sf_dir).lease_attrs)


@register("bank_top1")
def q_bank_top1(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return fe.bank_top1(f.td.bank, f.lease_attrs)


@register("card_sharing")
def q_card_sharing(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return fe.card_sharing(f.td.bank, f.lease_attrs, cutoff=1000)


@register("store_attrs")
def q_store_attrs(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return fe.store_attributes(f.td.retail_stores, f.lease_attrs)


@register("cart_diversity")
def q_cart_diversity(spark, sf_dir):
    return rounded(fe.cart_diversity(TestData(spark, sf_dir).cart), 6)


@register("client_attrs")
def q_client_attrs(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return fe.client_attributes(f.td.client_info, f.lease_attrs)


@register("fp_attrs")
def q_fp_attrs(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return fe.fp_attributes(f.td.fp_results, f.cohort)


@register("approval_amount")
def q_approval_amount(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return rounded(fe.approval_amount(f.td.approval, f.cohort))


@register("payment_at_origination")
def q_payment_at_origination(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return fe.payment_at_origination(f.lease_attrs, f.td.bank)


@register("store_inception")
def q_store_inception(spark, sf_dir):
    return fe.store_inception(TestData(spark, sf_dir).lease_view)


@register("customer_zip_top1")
def q_customer_zip_top1(spark, sf_dir):
    return fe.customer_zip_top1(TestData(spark, sf_dir).address)


@register("risk_dedup")
def q_risk_dedup(spark, sf_dir):
    return _Features(spark, sf_dir).risk_codes()


@register("risk_onehot_presence")
def q_risk_onehot_presence(spark, sf_dir):
    return rk.risk_flags_presence(_Features(spark, sf_dir).risk_codes())


@register("risk_onehot_absence")
def q_risk_onehot_absence(spark, sf_dir):
    return rk.risk_flags_absence(_Features(spark, sf_dir).risk_codes())


def _new_codes(spark, sf_dir):
    td = TestData(spark, sf_dir)
    return rk.risk_codes(td.lease_view, td.fp_applicant, td.fp_risk_indicators_new)


@register("risk_discovered_presence")
def q_risk_discovered_presence(spark, sf_dir):
    """A column for every code that the data holds, on the list or not."""
    return rk.risk_flags_presence(_new_codes(spark, sf_dir), rk.DISCOVERED)


@register("risk_discovered_absence")
def q_risk_discovered_absence(spark, sf_dir):
    return rk.risk_flags_absence(_new_codes(spark, sf_dir), rk.DISCOVERED)


@register("risk_code_lists")
def q_risk_code_lists(spark, sf_dir):
    return rk.risk_code_lists(_new_codes(spark, sf_dir))


@register("risk_catalogue")
def q_risk_catalogue(spark, sf_dir):
    return rk.risk_catalogue(TestData(spark, sf_dir).fp_risk_indicators)


@register("feature_master")
def q_feature_master(spark, sf_dir):
    return rounded(_Features(spark, sf_dir).master())


@register("geo_distance")
def q_geo_distance(spark, sf_dir):
    places = ["approvalid", "customer_zip", "zip", "cus_lat", "cus_long", "store_lat", "store_long"]
    m = fe.with_distance(_Features(spark, sf_dir).master(places))
    return rounded(m.select(*places, "distance"))


@register("feature_bins")
def q_feature_bins(spark, sf_dir):
    b = _Features(spark, sf_dir).bins()
    return rounded(b.select("approvalid", *fe.BIN_COLUMNS), 6)


# ------------------------------------------------------------ score and grade
@register("score_core")
def q_score_core(spark, sf_dir):
    s = _Features(spark, sf_dir).scores()
    return rounded(s.filter(same_text("storetype", "CORE")), 6)


@register("score_noncore")
def q_score_noncore(spark, sf_dir):
    s = _Features(spark, sf_dir).scores()
    return rounded(s.filter(~same_text("storetype", "CORE")), 6)


@register("score_explain")
def q_score_explain(spark, sf_dir):
    f = _Features(spark, sf_dir)
    return rounded(sc.explain(f.bins(), f.coefs()), 6)


def _graded(spark, sf_dir):
    return sc.Grades(_Features(spark, sf_dir).scores(), PARAMS.grade_from)


@register("scores_all")
def q_scores_all(spark, sf_dir):
    return rounded(sc.combined(_Features(spark, sf_dir).scores()), 6)


@register("store_grade")
def q_store_grade(spark, sf_dir):
    return rounded(_graded(spark, sf_dir).stores, 6)


@register("person_grade")
def q_person_grade(spark, sf_dir):
    return rounded(_graded(spark, sf_dir).persons, 6)


@register("final_scores")
def q_final_scores(spark, sf_dir):
    return rounded(_graded(spark, sf_dir).final, 6)


@register("scores_from_wide")
def q_scores_from_wide(spark, sf_dir):
    """scores_all with the weights loaded from the wide coefficient table."""
    f = _Features(spark, sf_dir)
    coefs = sc.load_wide_coefficients(sc.wide_testdata_coefficients(spark))
    return rounded(sc.combined(sc.score(f.bins(), coefs)), 6)


@register("score_batch")
def q_score_batch(spark, sf_dir):
    """The whole batch through the library entry point, published and read back."""
    from riskflow.plans.batch import score_batch
    path = scratch_folder(spark, "published-scores")
    return rounded(score_batch(TestData(spark, sf_dir).table, sc.testdata_coefficients(spark), path, PARAMS.scoring_as_of,
                               quintile_cutover=PARAMS.quintile_cutover, grade_from=PARAMS.grade_from), 6)


@register("retry_report")
def q_retry_report(spark, sf_dir):
    """The retry report through the library entry point, published and read back."""
    td, path = TestData(spark, sf_dir), scratch_folder(spark, "published-report")
    return rounded(rc.publish_retry_report(
        path, spark, td.dq_journal_events, td.card_attempts, td.dim_approval, td.fact_leasesum, td.dim_store, td.lease_view,
        start=PARAMS.report_start, end=PARAMS.report_end, as_of=PARAMS.report_end, keep_from=PARAMS.report_keep_from))


# -------------------------------------------------------------------- ingest
from pyspark.sql import types as T  # noqa: E402

from riskflow.plans import ingest as ig  # noqa: E402
from riskflow.sources.delimited import malformed_lines  # noqa: E402
from riskflow.sources.testdata import REPORT_NAMESPACE  # noqa: E402
from riskflow.sources.xmldocs import profile  # noqa: E402


def _stored_reports(spark, reports):
    """A stored table of generated reports, in as many files as there are cores: equal-looking
    reports compress to files so small that one task would parse them all."""
    return materialize(reports.repartition(spark.sparkContext.defaultParallelism), "reports")


@register("xml_codes")
def q_xml_codes(spark, sf_dir):
    """Reports written as text files (one per line) to the shared scratch folder, then read back."""
    path = scratch_folder(spark, "xml-reports")
    TestData(spark, sf_dir).xml_reports.select("doc").write.text(path)
    return ig.xml_codes(spark, path, one_per_file=False, namespace=REPORT_NAMESPACE)


@register("xml_files_csv")
def q_xml_files_csv(spark, sf_dir):
    """Reports stored one to a file, shredded to a CSV, which is read back."""
    path, out = scratch_folder(spark, "xml-files"), scratch_folder(spark, "xml-csv")
    write_documents(TestData(spark, sf_dir).supplier_reports.select("doc"), path)
    ig.xml_folder_to_csv(spark, path, out, namespace=REPORT_NAMESPACE)
    return spark.read.option("header", "true").schema("CODE string, ID string").csv(out)


@register("xml_column_codes")
def q_xml_column_codes(spark, sf_dir):
    """The XML column is a stored table in the source: write the generated one once."""
    return ig.xml_column_codes(_stored_reports(spark, TestData(spark, sf_dir).xml_column), namespace=REPORT_NAMESPACE)


@register("xml_bound_codes")
def q_xml_bound_codes(spark, sf_dir):
    """First text of every code of one namespace, under one root, from reports of mixed forms."""
    table = _stored_reports(spark, TestData(spark, sf_dir).xml_mixed)
    return ig.xml_column_codes(table, namespace=REPORT_NAMESPACE, texts="first", width=32)


@register("xml_profile")
def q_xml_profile(spark, sf_dir):
    """Element paths of all stored reports: documents, occurrences, children, texts, attributes."""
    td = TestData(spark, sf_dir)
    return profile(_stored_reports(spark, td.xml_mixed.union(td.xml_column)), "testxml")


SUPPLIER_TYPES = (T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType())


@register("combine_tsv")
def q_combine_tsv(spark, sf_dir):
    """Supplier rows written as several headerless TSV parts, then combined by one scan."""
    path = scratch_folder(spark, "tsv-parts")
    sup = TestData(spark, sf_dir).supplier
    (sup.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
        .repartition(4).write.option("sep", "\t").option("header", "false").csv(path))
    return ig.combine_delimited(spark, path, SUPPLIER_TYPES)


def _uneven_parts(spark, sf_dir) -> str:
    """Supplier rows as TSV lines, of which some lack fields, have one too many or one of another type."""
    path = scratch_folder(spark, "tsv-uneven")
    k = F.col("s_suppkey")
    line = F.concat_ws("\t", k.cast("string"), "s_name", F.when(k % 7 == 3, F.lit("many")).otherwise(F.col("s_nationkey").cast("string")),
                       F.when(k % 5 != 2, F.col("s_acctbal").cast("string")), F.when(k % 11 == 4, F.lit("more")))
    TestData(spark, sf_dir).supplier.select(line.alias("line")).write.text(path)
    return path


@register("combine_tsv_sound")
def q_combine_tsv_sound(spark, sf_dir):
    """The lines of uneven files that have every field, of its type."""
    return ig.combine_delimited(spark, _uneven_parts(spark, sf_dir), SUPPLIER_TYPES, on_error="drop")


@register("tsv_malformed")
def q_tsv_malformed(spark, sf_dir):
    """Lines of uneven files that are ragged or mistyped."""
    return malformed_lines(spark, _uneven_parts(spark, sf_dir), SUPPLIER_TYPES).select("line")
