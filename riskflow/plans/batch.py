"""The scoring batch as one function: named tables in, the published score table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from riskflow.plans import features as fe, risk_codes as rk, scoring as sc
from riskflow.sources.sinks import read_table, replace_table

#: The tables that the batch reads, by the names it asks for.
TABLES = ("lease_view", "lease_period", "dim_approval", "fact_leasesum", "dim_store", "bank", "cart", "client_info",
          "retail_stores", "fp_results", "approval", "address", "zip_codes", "fp_applicant", "fp_risk_indicators",
          "decision_system")
# Cards shared by this many clients or more are placeholders.
CARD_SHARING_CUTOFF = 1000


def assemble(table: Callable[[str], DataFrame], cohort: DataFrame, attrs: DataFrame, columns=None) -> DataFrame:
    """The feature master of a cohort, or these columns of it. ``table`` gives a DataFrame by its name (see TABLES).

    Tables of all leases or clients are cut to the cohort's keys before they are aggregated.
    """
    def of_cohort(name: str, key: str, keys: DataFrame) -> DataFrame:
        return fe.in_keys(table(name), key, keys, key)

    leases = of_cohort("lease_view", "approvalid", cohort)
    codes = rk.risk_codes(leases, table("fp_applicant"), table("fp_risk_indicators"))
    return fe.feature_master(
        cohort, attrs, fe.bank_top1(table("bank"), attrs), fe.cart_diversity(of_cohort("cart", "approvalid", cohort)),
        fe.card_sharing(table("bank"), attrs, CARD_SHARING_CUTOFF), fe.client_attributes(table("client_info"), attrs, cohort_only=True),
        fe.store_attributes(table("retail_stores"), attrs), fe.fp_attributes(table("fp_results"), cohort),
        fe.approval_amount(table("approval"), cohort), fe.payment_at_origination(attrs, table("bank")),
        fe.customer_zip_top1(of_cohort("address", "clientid", attrs)), fe.store_inception(table("lease_view")),
        rk.risk_masks(codes), table("zip_codes"), fe.online_approvals(table("decision_system")),
        columns)


def score_batch(table: Callable[[str], DataFrame], coefs: DataFrame, path: str, as_of,
                quintile_cutover=fe.QUINTILE_CUTOVER, grade_from=sc.GRADE_FROM) -> DataFrame:
    """Cohort, features, both models and grades; replaces the stored score table and reads it back."""
    cohort, attrs = fe.cohort_tables(table("lease_view"), table("lease_period"), table("dim_approval"),
                                     table("fact_leasesum"), table("dim_store"), as_of)
    bins = fe.bin_features(fe.with_distance(assemble(table, cohort, attrs, fe.BIN_INPUTS)), quintile_cutover)
    final = sc.Grades(sc.score(bins, coefs), grade_from).final
    replace_table(final, path)
    return read_table(final.sparkSession, path)
