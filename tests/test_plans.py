"""Plan quality of every registered query: no nested-loop/cartesian joins, no per-row Python."""

import os
import re

import pytest

import __spark_entry__ as entry
from riskflow.catalog import QUERIES as CATALOG

SF = "/root/testdata/sf0.001"
BAD = re.compile(r"BroadcastNestedLoopJoin|CartesianProduct|BatchEvalPython|ArrowEvalPython")
# XML is parsed by an Arrow column function, once a document; no other key may use Python
PARSED = {"xml_codes", "xml_column_codes", "xml_bound_codes"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


@pytest.mark.parametrize("key", sorted(CATALOG))
def test_physical_plan(spark, key):
    df = entry.queries()[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert BAD.findall(plan) == (["ArrowEvalPython"] if key in PARSED else []), key


def test_scan_pushdown_and_pruning(spark):
    # the score keys filter the materialised cohort at its parquet scan; the store type itself is compared
    # under the source collation (case, trailing blanks), which no scan can do
    df = entry.queries()["score_core"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(storetype)]" in plan
    # the rollup reads only the journal columns it needs
    df = entry.queries()["buyout_rollup"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans
    for cols in scans:
        assert not {"l_extendedprice", "l_discount", "l_tax", "l_quantity"} & {
            c.split("#")[0] for c in cols.split(",")}


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("key", ["person_grade", "store_grade", "final_scores", "collection_list", "retry_segments",
                                 "feature_master"])
def test_physical_plan_without_broadcasts(no_broadcasts, key):
    """At scale no side is small: still no nested loop, and no exchange on the few store types."""
    df = entry.queries()[key](no_broadcasts, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not BAD.findall(plan), key
    assert not re.findall(r"hashpartitioning\((?:coalesce\()?(?:storetype|_type)#[^,]*, \d+\)", plan), key


def test_balance_reads_the_journal_once(spark):
    plan = entry.queries()["balance_by_day"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan        # the aggregated days are a written table


def test_clients_are_made_once_for_the_master(spark):
    """Licence counts and client attributes read one written table of clients, not the clients' view each."""
    plan = entry.queries()["feature_master"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "customer.parquet" not in plan


def test_cohort_takes_single_leases_in_one_aggregate(spark):
    from riskflow.plans import features as fe
    from riskflow.sources.testdata import PARAMS, TestData
    td = TestData(spark, SF)
    cohort = fe.single_lease_cohort(td.lease_view, td.lease_period, td.dim_approval, td.fact_leasesum, td.dim_store, PARAMS.scoring_as_of)
    assert "LeftSemi" not in cohort._jdf.queryExecution().executedPlan().toString()
