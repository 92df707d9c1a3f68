"""Discovered pivot columns, ordered string lists, collated keys, heavy keys, strict lines, coefficient names."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from riskflow.operators.groupstat import group_statistics, with_group_statistics
from riskflow.operators.onehot import discover_codes, onehot
from riskflow.operators.scoring import ZERO, Model, Term, coefficient_maps
from riskflow.operators.stringlist import string_list
from riskflow.plans import features as fe, risk_codes as rk, scoring as sc
from riskflow.sources.delimited import malformed_lines, read_delimited

PAIRS = [(1, "02"), (1, "new"), (2, "it's"), (2, "b`t"), (3, "back\\slash"), (3, None), (4, "02")]


def test_codes_off_the_list_get_columns_in_both_polarities(spark):
    pairs = spark.createDataFrame(PAIRS, "k int, code string")
    codes = discover_codes(pairs, "code", known=["02", "04"])
    assert codes == ["02", "04", "b`t", "back\\slash", "it's", "new"]
    present = {r["k"]: r for r in onehot(pairs, "k", "code", codes, "f_").collect()}
    absent = {r["k"]: r for r in onehot(pairs, "k", "code", codes, "f_", "absence").collect()}
    for k, row in present.items():
        held = {c for i, c in PAIRS if i == k}
        for c in codes:
            assert row["f_" + c] == (c in held) and absent[k]["f_" + c] == (c not in held)


def test_a_pivot_wider_than_its_bound_raises(spark):
    pairs = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("code"))
    assert len(discover_codes(pairs, "code", most=100)) == 100
    for how in ({"most": 99}, {"most": 100, "known": ["x"]}):
        with pytest.raises(ValueError):
            discover_codes(pairs, "code", **how)
    wide = onehot(pairs, "k", "code", discover_codes(pairs, "code"), "f_").collect()[0]       # two masks
    assert all(wide[f"f_{i}"] == 1 for i in range(100))


def test_discovered_risk_flags(spark):
    codes = spark.createDataFrame([(1, "02"), (1, "Q9"), (2, "NONE")], "approvalid long, riskcode string")
    row = {r["approvalid"]: r for r in rk.risk_flags_presence(codes, rk.DISCOVERED).collect()}
    assert (row[1]["_MC_v2_Q9"], row[2]["_MC_v2_Q9"], row[1]["_mc_v2_z_sum"]) == (1, 0, 2)
    assert {r["appid"]: r["_MC_v2_Q9"] for r in rk.risk_flags_absence(codes, rk.DISCOVERED).collect()} == {1: 0, 2: 1}
    assert "_MC_v2_Q9" not in rk.risk_flags_presence(codes).columns


def test_string_lists(spark):
    df = spark.createDataFrame(PAIRS + [(1, "02")] * 5 + [(9, None)], "k int, code string").repartition(3)
    got = {r.k: r.codes for r in string_list(df, ["k"], "code", "codes").collect()}
    assert got == {1: "02,new", 2: "b`t,it's", 3: "back\\slash", 4: "02", 9: ""}
    assert string_list(df, ["k"], "code", "codes", most=2).count() == 5
    with pytest.raises(Exception, match="more than 1 values"):
        string_list(df, ["k"], "code", "codes", most=1).collect()


def _clients(n):
    held = ["none given" if i % 3 == 0 else None if i % 50 == 1 else f"D{i % 40}" for i in range(n)]
    return [(i, (h if h is None or i % 2 else h.lower() + "  ")) for i, h in enumerate(held)]


def test_group_statistics_with_a_key_of_a_third_of_all_rows(spark):
    rows = _clients(3000)
    count = Counter(h.lower().rstrip() for _, h in rows if h is not None)
    df = spark.createDataFrame(rows, "clientid int, licence string").repartition(8)
    key = F.lower(F.rtrim("licence"))
    found = group_statistics(df, key, {"n": F.count("clientid")})
    for split in (1, 5, 1000):
        got = {r.clientid: r.n for r in with_group_statistics(df.filter("clientid % 2 = 0"), key, found, ["n"], split).collect()}
        assert got == {i: None if h is None else count[h.lower().rstrip()] for i, h in rows if i % 2 == 0}
    # what remains in an exchange by key: no group of more than the split's share
    plan = with_group_statistics(df, key, found, ["n"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" in plan
    assert with_group_statistics(df.limit(0), key, group_statistics(df.limit(0), key, {"n": F.count("clientid")}), ["n"]).count() == 0


def test_licences_are_counted_under_the_collation(spark):
    info = spark.createDataFrame([(1, "ab1"), (2, "AB1 "), (3, "ab 1"), (4, None), (5, "Ab1")], "clientid long, driverslicense string")
    for c, t in (("driverslicensestate", "string"), ("dob", "date"), ("firstname", "string"), ("lastname", "string"), ("ipaddress", "string"),
                 ("ts", "date"), ("idtype", "string"), ("languagepreference", "int")):
        info = info.withColumn(c, F.lit(None).cast(t))
    leases = spark.createDataFrame([(1,), (4,)], "clientid long").withColumn("leaseaddeddate", F.lit("2020-01-01").cast("date"))
    got = {r.clientid: r.license_appear_number for r in fe.client_attributes(info, leases).collect()}
    assert got == {1: 3, 2: 3, 3: 1, 4: None, 5: 3}
    assert {r.clientid: r.license_appear_number for r in fe.client_attributes(info, leases, cohort_only=True).collect()} == {1: 3, 4: None}


def test_grades_partition_store_types_under_the_collation(spark):
    rows = [(i, ("CORE", "core ", "Core")[i % 3], f"202{i % 3}-05-01", i / 100, i % 10) for i in range(60)]
    prep = spark.createDataFrame(rows, "approvalid long, storetype string, d string, probability double, storeid long")
    prep = prep.withColumn("leaseaddeddate", F.to_date("d")).drop("d")
    stores = sc.store_grade(prep)
    assert stores.count() == 10 and Counter(r.store_rank for r in stores.collect()) == {c: 2 for c in "ABCDF"}
    people = sc.person_grade(prep, stores).collect()
    assert len(people) == 60 and all(r.store_rank for r in people)
    assert Counter(r.person_rank for r in people) == {c: 12 for c in "ABCDF"}


RAGGED = {"a.txt": "1\tx\t2.5\n2\ty\n", "b.txt": "3\tz\t4.5\tmore\n4\tw\tno\nfive\tv\t1\n\n6\t\t\n"}


def _folder():
    d = tempfile.mkdtemp(prefix="rf-ragged-")
    for name, text in RAGGED.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    return d


TYPES = (T.LongType(), T.StringType(), T.DoubleType())


def test_ragged_and_mistyped_lines_are_listed_or_raise(spark):
    d = _folder()
    assert sorted(tuple(r) for r in read_delimited(spark, d, TYPES, on_error="drop").collect()) == [(1, "x", 2.5), (6, None, None)]
    bad = malformed_lines(spark, d, TYPES)
    assert sorted((os.path.basename(r.file), r.line) for r in bad.collect()) == [
        ("a.txt", "2\ty"), ("b.txt", "3\tz\t4.5\tmore"), ("b.txt", "4\tw\tno"), ("b.txt", "five\tv\t1")]
    assert bad.count() == 4 and read_delimited(spark, d, TYPES, on_error="drop").count() == 2
    df = read_delimited(spark, d, TYPES)
    for use in (df, df.select("V1"), df.select("V2"), df.groupBy().count()):
        with pytest.raises(Exception, match="malformed line in .*(a|b).txt"):
            use.collect()
    with pytest.raises(ValueError):
        read_delimited(spark, d, TYPES, on_error="ignore")


def test_coefficient_names_are_checked_against_the_terms(spark):
    model = Model("M", [Term("intercept", kind="intercept"), Term("online", "x", levels=((0, "0"), (1, ZERO))), Term("flag", "f", kind="flag")])
    rows = [("M", "intercept", "", 1.0), ("M", "online", "0", 2.0), ("M", "flag", "", None), ("N", "other", "", 9.0)]

    def load(rows):
        return coefficient_maps(spark.createDataFrame(rows, "model string, feature string, level string, weight double"), [model])["M"]
    assert load(rows) == {("intercept", ""): 1.0, ("online", "0"): 2.0, ("flag", ""): None}
    for wrong in (rows + [("M", "onlin", "0", 2.0)], rows[:1] + rows[2:], rows + [("M", "online", "1", 2.0)], []):
        with pytest.raises(ValueError, match="unknown|missing"):
            load(wrong)
