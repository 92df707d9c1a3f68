"""Feature traps: NONE handling, bins without ELSE, fan-out reproduction."""

from pyspark.sql import functions as F

from riskflow.plans import features as fe
from riskflow.plans import risk_codes as rk


def test_none_code_and_flag(spark):
    # Approval with no applicant, applicant without codes, applicant with codes
    lv = spark.createDataFrame([(1,), (2,), (3,), (4,)], "approvalid long")
    app = spark.createDataFrame([(2, 20), (3, 30), (4, 0)], "approvalid long, applicantid long")
    ind = spark.createDataFrame([(30, "02"), (30, "02"), (30, "NF")],
                                "applicantid long, riskcode string")
    codes = rk.risk_codes(lv, app, ind)
    got = sorted((r.approvalid, r.riskcode) for r in codes.collect())
    assert got == [(2, "NONE"), (3, "02"), (3, "NF")]   # NONE kept whole; applicant 0 dropped
    masks = rk.risk_masks(codes)
    flags = rk.risk_flag_exprs()
    out = (lv.join(masks, lv["approvalid"] == masks["appid"], "left")
             .select("approvalid", F.expr(flags["_MC_v2_NONE"]).alias("none"),
                     F.expr(flags["_MC_v2_02"]).alias("f02"),
                     F.expr(flags["_MC_v2_NF"]).alias("fNF")))
    got = {r.approvalid: (r.none, r.f02, r.fNF) for r in out.collect()}
    # no row -> all 1; only NONE -> NONE flag 1; codes -> NONE 0 and present codes 0
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (0, 0, 0), 4: (1, 1, 1)}


def test_bins_without_else_stay_null(spark):
    # Language 4 is outside 0-3 (NULL bin); sku_dif -1 has no bin
    df = spark.createDataFrame(
        [(None, 0, 1, None, None, None, 2.4, 500.4, None, "", None),
         (4, -1, 3, 5, "12", "", 25.5, 500.6, 700, "AUTO", "PASSPORT")],
        "languagepreference int, sku_dif int, card_appear_number int, cc_orig int, "
        "nasindex string, cvi string, storeage double, distance double, fraudscore int, "
        "storetype string, idtype string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in (
        "primarypaymentmethod", "napindex")}).withColumn("fp_timestamp", F.lit(None).cast("date"))
    for c in ("fraud", "online", "monthlyincome", "add_flag", "paymentfrequency", "seasonality",
              "state_flag", "zipgroup1", "age", "ltc"):
        df = df.withColumn(c, F.lit(None))
    b = {r.languagepreference: r for r in fe.bin_features(df).collect()}
    assert b[None]._mc_languagepreference == 4 and b[4]._mc_languagepreference is None
    assert b[None]._mc_sku_dif == 0 and b[4]._mc_sku_dif is None
    assert b[None]._mc_card_appear_number == 1 and b[4]._mc_card_appear_number == 3
    assert b[None]._mc_cc_orig is None and b[4]._mc_cc_orig == 2
    assert b[None]._mc_nas == "missing" and b[4]._mc_nas == "12"
    assert b[None]._mc_cvi == "missing" and b[4]._mc_cvi == "missing"
    assert b[None]._mcfp_quintile == 4 and b[4]._mcfp_quintile == 4
    assert b[None]._mc_sage_orig == 2 and b[4]._mc_sage_orig == 5     # round(2.4)=2, 26
    assert b[None]._mc_sdistance == 5 and b[4]._mc_sdistance == 6     # 500, 501 (T27)
    assert b[None]._mc_idtype == "missing" and b[4]._mc_idtype == "PASSPORT"
    assert b[4]._mc_storetype == "FLSAUTO" and b[None]._mc_primarypaymentmethod == "CreditCard"


def test_approval_fan_out_is_reproduced(spark):
    # Approval amounts are not aggregated, so duplicates fan out
    cohort = spark.createDataFrame([(1,), (2,)], "approvalid long")
    appr = spark.createDataFrame([(1, 10.0), (1, 12.0), (2, 5.0), (3, 1.0)],
                                 "approvalid long, approvalamount double")
    assert fe.approval_amount(appr, cohort).count() == 3
