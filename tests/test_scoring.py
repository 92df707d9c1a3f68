"""Scoring semantics: term rules, missing weights, explanation sums, model routing."""

import math

import pytest
from pyspark.sql import functions as F

from riskflow.operators.scoring import (
    ZERO, Model, Term, coefficient_maps, contributions, linear_sql, model_inputs, unpivot_coefficients,
)
from riskflow.plans import scoring as sc


def _model():
    return Model("M", [
        Term("intercept", kind="intercept"),
        Term("freq", "f", levels=(("14 Day", "14 Day"), ("bi-weekly", "14 Day"),
                                  ("Monthly", ZERO)), has_else=False),
        Term("idtype", "i", levels=(("Missing", "Missing"), ("Green Card", "Green Card"))),
        Term("flagA", "a", kind="flag"),
        Term("none_off", "a", kind="flag_off", coef_feature="flagA"),
        Term("age", "g", kind="slope"),
    ])


W = {("intercept", ""): 0.5, ("freq", "14 Day"): 0.25, ("idtype", "Missing"): -1.0,
     ("idtype", "Green Card"): None, ("flagA", ""): 2.0, ("age", ""): 0.01}


def _score(spark, rows):
    df = spark.createDataFrame(rows, "f string, i string, a int, g int")
    m = _model()
    df = df.select(*model_inputs([m]))
    return df.select(F.expr(linear_sql(m, W)).alias("lin"),
                     *[F.expr(v).alias(k) for k, v in contributions(m, W).items()]).collect()


def test_term_rules(spark):
    got = _score(spark, [("BI-Weekly ", "missing", 1, 30),    # case and trailing blanks ignored, flag on
                         ("Monthly", "Passport", 0, None),    # ZERO level, unlisted level
                         ("Weekly", "Missing", None, 40),     # T08: no ELSE -> NULL score
                         ("14 Day", "Green Card", 1, 20)])    # T31: NULL weight -> NULL score
    assert math.isclose(got[0].lin, 0.5 + 0.25 - 1.0 + 2.0 + 0.0 + 0.3)
    assert math.isclose(got[1].lin, 0.5 + 0 + 0 + 0 + 2.0 + 0)
    assert got[2].lin is None and got[3].lin is None


def test_contributions_sum_to_linear(spark):
    got = _score(spark, [("14 Day", "Missing", 0, 25), ("bi-weekly", "x", 1, None)])
    for r in got:
        parts = [r[k] for k in r.asDict() if k.startswith("t_")]
        assert math.isclose(sum(parts), r.lin)


def test_noncore_none_terms_are_constant(spark):
    # The NONE flag term plus the 'flag off' term add the weight whatever the flag
    got = _score(spark, [("14 Day", "Missing", v, 10) for v in (0, 1, None)])
    assert len({round(r.lin, 12) for r in got}) == 1


def test_models_cover_weights():
    rows = sc.testdata_coefficient_rows()
    feats = {(m, f) for m, f, _, _ in rows}
    for m in (sc.core_model(), sc.noncore_model()):
        for t in m.terms:
            assert (m.name, t.coef_feature or t.name) in feats
    # core has online and income; noncore has state_flag, storetype, z_sum
    core = {t.name for t in sc.core_model().terms}
    non = {t.name for t in sc.noncore_model().terms}
    assert {"online", "monthlyincome"} <= core - non
    assert {"state_flag", "storetype", "z_sum", "none_off"} <= non - core


def test_wide_coefficients(spark):
    m = Model("M", [Term("intercept", kind="intercept"), Term("idtype", "i", levels=(("Passport", "Passport"),)),
                    Term("flagA", "a", kind="flag")])
    wide = spark.createDataFrame([("M", 0.5, None, 2.0)], "model string, Intercept double, idtypePassport double, flaga double")
    got = coefficient_maps(unpivot_coefficients(wide, [m]), ["M"])["M"]
    assert got == {("intercept", ""): 0.5, ("idtype", "Passport"): None, ("flagA", ""): 2.0}
    with pytest.raises(ValueError, match="unknown"):
        unpivot_coefficients(wide.withColumn("idtypeGreen", F.lit(1.0)), [m])
    with pytest.raises(ValueError, match="several rows"):
        unpivot_coefficients(wide.union(wide), [m])
    long = unpivot_coefficients(wide, [m])
    with pytest.raises(ValueError, match="twice"):
        coefficient_maps(long.union(long), ["M"])
