"""Two logistic fraud models (core and non-core stores), explanations and grades.

One pass scores every lease: ``CASE WHEN storetype = 'CORE' THEN core ELSE
noncore`` with all weights as literals (see ``operators.scoring``). Only the
models' inputs (71 flags and 21 other columns) are kept before scoring, so the
projection stays inside whole-stage codegen. Grades use the distributed NTILE of
``operators.grading``.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.functions.numeric import logistic
from riskflow.functions.strings import folded
from riskflow.operators.grading import distributed_ntile, letter
from riskflow.operators.materialize import materialize
from riskflow.operators.scoring import (
    ZERO, Model, Term, coefficient_maps, coefficient_names, contributions, linear_sql, model_inputs, routed_sql,
    unpivot_coefficients,
)
from riskflow.sources.codes import NO_CODE, RISK_CODES, RISK_PREFIX

CORE, NONCORE = "CORE_MODEL", "NONCORE_MODEL"
IS_CORE, NOT_CORE = "lower(rtrim(storetype)) = 'core'", "lower(rtrim(storetype)) <> 'core'"
GRADE_FROM = _dt.date(2015, 1, 1)


def _levels(values, as_str=False):
    return tuple((str(v) if as_str else v, str(v)) for v in values)


def _common_head(bi_weekly_level: str) -> list[Term]:
    return [
        Term("paymentfrequency", "_mc_paymentfrequency",
             levels=(("14 Day", "14 Day"), ("28 Day", "28 Day"),
                     ("bi-weekly", bi_weekly_level), ("Monthly", ZERO)),
             has_else=False),
        Term("primarypaymentmethod", "_mc_primarypaymentmethod", levels=(("ACH", "ACH"),)),
        Term("seasonality", "_mc_seasonality", levels=_levels(range(1, 12))),
    ]


def _common_tail(idtypes) -> list[Term]:
    return [
        Term("sku_dif", "_mc_sku_dif", levels=_levels(range(2))),
        Term("languagepreference", "_mc_languagepreference", levels=_levels(range(4))),
        Term("idtype", "_mc_idtype", levels=tuple((v, v) for v in idtypes)),
        Term("quintile", "_mcfp_quintile", levels=_levels(range(1, 5))),
        Term("cc_orig", "_mc_cc_orig", levels=_levels(range(2))),
        Term("nas", "_mc_nas", levels=tuple((f"{i:02d}", f"{i:02d}") for i in range(13))),
        Term("cvi", "_mc_cvi", levels=_levels(range(0, 60, 10), as_str=True)),
        Term("sdistance", "_mc_sdistance", levels=_levels(range(1, 7))),
        Term("sage_orig", "_mc_sage_orig", levels=_levels(range(1, 5))),
    ]


def _flags() -> list[Term]:
    return ([Term(RISK_PREFIX + c, RISK_PREFIX + c, kind="flag") for c in RISK_CODES]
            + [Term(RISK_PREFIX + NO_CODE, RISK_PREFIX + NO_CODE, kind="flag")])


# Identification types with a weight in each model.
CORE_IDTYPES = ("Drivers License", "Green Card", "Military ID", "Missing", "Passport",
                "State ID")
NONCORE_IDTYPES = ("Drivers License", "Green Card", "Military ID", "MMCC", "Missing",
                   "Passport", "State ID")


def core_model() -> Model:
    terms = [Term("intercept", kind="intercept"),
             Term("online", "_mc_online", levels=((0, "0"),)),
             Term("add_flag", "_mc_add_flag", levels=((0, "0"),)),
             *_common_head("14 Day"),
             Term("zipgroup1", "_mc_zipgroup1", levels=_levels(range(9), as_str=True)),
             Term("card_appear_number", "_mc_card_appear_number", levels=_levels(range(3))),
             *_common_tail(CORE_IDTYPES),
             *_flags(),
             Term("age", "_m_age_1", kind="slope"),
             Term("monthlyincome", "_m_monthlyincome_1", kind="slope"),
             Term("ltc", "_m_ltc_1", kind="slope")]
    return Model(CORE, terms)


def noncore_model() -> Model:
    terms = [Term("intercept", kind="intercept"),
             Term("add_flag", "_mc_add_flag", levels=((0, "0"),)),
             *_common_head("bi-weekly"),
             Term("state_flag", "_mc_state_flag", levels=((0, "0"),)),
             Term("zipgroup1", "_mc_zipgroup1", levels=_levels(range(9), as_str=True)),
             Term("card_appear_number", "_mc_card_appear_number", levels=_levels(range(3))),
             Term("storetype", "_mc_storetype", levels=(("KMT", "KMT"),
                                                         ("FLSAUTO", "FLSAUTO"))),
             *_common_tail(NONCORE_IDTYPES),
             Term("z_sum", "_mc_v2_z_sum", levels=_levels(range(1, 18))),
             *_flags(),
             # the NONE weight is added a second time when the flag is 0 or missing,
             # so together with the flag term it is a constant of the model
             Term("none_off", RISK_PREFIX + NO_CODE, kind="flag_off",
                  coef_feature=RISK_PREFIX + NO_CODE),
             Term("age", "_m_age_1", kind="slope"),
             Term("ltc", "_m_ltc_1", kind="slope")]
    return Model(NONCORE, terms)


def _weight_of(model: str, feature: str, level: str) -> float:
    """Deterministic small weights for the testdata coefficient table."""
    h = 7
    for ch in f"{model}|{feature}|{level}":
        h = (h * 31 + ord(ch)) % 1000003
    return round(((h % 801) - 400) / 1000.0, 3)


def testdata_coefficient_rows() -> list[tuple[str, str, str, float | None]]:
    """Long coefficient rows ``(model, feature, level, weight)`` for both models.

    The source keeps fitted weights in a warehouse table; the testdata has
    none, so weights are generated by a fixed rule. Slopes are scaled to the
    size of their inputs. One level (core 'Green Card') is left without a weight: a
    lease with it has a NULL score.
    """
    rows = {}
    for m in (core_model(), noncore_model()):
        for t in m.terms:
            feat = t.coef_feature or t.name
            if t.kind in ("intercept", "flag", "slope"):
                w = _weight_of(m.name, feat, "")
                if t.kind == "slope":
                    w = w / {"age": 100.0, "monthlyincome": 10000.0, "ltc": 1.0}[t.name]
                rows[(m.name, feat, "")] = w
            elif t.kind == "level":
                for _, lv in t.levels:
                    if lv is ZERO:
                        continue
                    missing = (m.name, feat, lv) == (CORE, "idtype", "Green Card")
                    rows[(m.name, feat, str(lv))] = None if missing else _weight_of(
                        m.name, feat, str(lv))
    return [(a, b, c, w) for (a, b, c), w in rows.items()]


def testdata_coefficients(spark) -> DataFrame:
    return spark.createDataFrame(testdata_coefficient_rows(),
                                 "model string, feature string, level string, weight double")


def wide_testdata_coefficients(spark) -> DataFrame:
    """The same weights in the wide form, one row per model and one column per weight."""
    weights = {(m, f, lv): w for m, f, lv, w in testdata_coefficient_rows()}
    models = (core_model(), noncore_model())
    names = sorted({n for m in models for n in coefficient_names(m)})
    rows = [(m.name, *[weights.get((m.name, *coefficient_names(m)[n])) if n in coefficient_names(m) else None for n in names])
            for m in models]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"`{n}` double" for n in names))


def load_wide_coefficients(wide: DataFrame, name_col: str = "model") -> DataFrame:
    """The stored wide coefficient table of both models in the long form that scoring reads."""
    return unpivot_coefficients(wide, (core_model(), noncore_model()), name_col)


SCORE_KEYS = ["approvalid", "storetype", "leaseaddeddate", "storeid"]


def score(bins: DataFrame, coefs: DataFrame) -> DataFrame:
    """Probability per lease from the model of its store type (one pass, literals)."""
    core, non = core_model(), noncore_model()
    maps = coefficient_maps(coefs, [core, non])
    wc, wn = maps[CORE], maps[NONCORE]
    st = F.col("storetype")
    lin = F.expr(routed_sql([(IS_CORE, linear_sql(core, wc)),
                             (NOT_CORE, linear_sql(non, wn))]))
    return (bins.filter(st.isNotNull())
            .select(*SCORE_KEYS, *model_inputs((core, non)))
            .select("approvalid", "storetype", F.to_date("leaseaddeddate").alias("leaseaddeddate"),
                    "storeid", lin.alias("score_linear"))
            .withColumn("probability", logistic("score_linear")))


def explain(bins: DataFrame, coefs: DataFrame) -> DataFrame:
    """Contribution of every model term (columns ``t_<term>``); they sum to score_linear."""
    core, non = core_model(), noncore_model()
    maps = coefficient_maps(coefs, [core, non])
    wc, wn = maps[CORE], maps[NONCORE]
    cc, cn = contributions(core, wc), contributions(non, wn)
    names = list(dict.fromkeys(list(cc) + list(cn)))
    st = F.col("storetype")
    # flag terms: read the flag once and pick the model's weight (keeps the generated
    # code of this ~100-column projection under the JVM method size limit)
    tc = {"t_" + t.name: t for t in core.terms}
    tn = {"t_" + t.name: t for t in non.terms}
    cols = {}
    for n in names:
        a, b = tc.get(n), tn.get(n)
        if a is not None and b is not None and a.kind == b.kind == "flag" and a.column == b.column:
            col = f"`{a.column}`"
            wa = wc.get((a.coef_feature or a.name, ""))
            wb = wn.get((b.coef_feature or b.name, ""))
            w = (f"CASE WHEN {IS_CORE} THEN {0.0 if wa is None else float(wa)!r}D "
                 f"WHEN {NOT_CORE} THEN {0.0 if wb is None else float(wb)!r}D END")
            cols[n] = F.expr(f"coalesce(CAST({col} AS DOUBLE), 0D) * {w}")
        else:
            cols[n] = F.expr(routed_sql([(IS_CORE, cc.get(n, "0D")),
                                         (NOT_CORE, cn.get(n, "0D"))]))
    return (bins.filter(st.isNotNull()).select("approvalid", "storetype", *model_inputs((core, non)))
            .select("approvalid", "storetype", *[c.alias(n) for n, c in cols.items()]))


def combined(scores: DataFrame) -> DataFrame:
    """Core and non-core scores as one relation (the source's UNION: duplicates removed)."""
    return scores.select("approvalid", "storetype", "leaseaddeddate", "probability",
                         "storeid").distinct()


class Grades:
    """Combined scores, store grades, person grades and the final table, each made when asked for.

    The combined scores are read by all the others, so they are materialised
    once (the whole feature and scoring plan runs once).
    """

    def __init__(self, scores: DataFrame, grade_from=GRADE_FROM):
        self._scores, self._from = scores, grade_from

    @cached_property
    def prep(self) -> DataFrame:
        return materialize(combined(self._scores), "scores")

    @cached_property
    def stores(self) -> DataFrame:
        return store_grade(self.prep, self._from)

    @cached_property
    def persons(self) -> DataFrame:
        return person_grade(self.prep, self.stores, self._from)

    @cached_property
    def final(self) -> DataFrame:
        return final_scores(self.prep, self.persons)


def store_grade(prep: DataFrame, grade_from=GRADE_FROM) -> DataFrame:
    """Mean probability per store and its quintile letter within the store type.

    Store types are keys under the source collation: case and trailing blanks do not part
    them. A store whose type is written in several ways keeps the smallest.
    """
    stores = (prep.filter(F.col("leaseaddeddate") > F.lit(grade_from))
              .groupBy(folded("storetype").alias("_type"), "storeid")
              .agg(F.min("storetype").alias("storetype"), F.avg("probability").alias("store_probability"))
              .select("storetype", "storeid", "store_probability", "_type"))
    graded = distributed_ntile(stores, 5, ["_type"],
                               [F.col("store_probability").asc_nulls_first(),
                                F.col("storeid").asc_nulls_first()], out="_q")
    return graded.withColumn("store_rank", letter(F.col("_q"))).drop("_q", "_type")


def person_grade(prep: DataFrame, stores: DataFrame, grade_from=GRADE_FROM) -> DataFrame:
    """Quintile letter of each lease within its store type, plus its store's grade."""
    recent = prep.filter(F.col("leaseaddeddate") > F.lit(grade_from))
    graded = distributed_ntile(recent.withColumn("_type", folded("storetype")), 5, ["_type"],
                               [F.col("probability").asc_nulls_first(),
                                F.col("approvalid").asc_nulls_first(),
                                F.col("storeid").asc_nulls_first(),
                                F.col("leaseaddeddate").asc_nulls_first()], out="_q")
    s = stores.select(F.col("storeid").alias("_sid"), folded("storetype").alias("_st"),
                      "store_rank", "store_probability")
    return (graded.withColumn("person_rank", letter(F.col("_q"))).drop("_q")
            .join(s, (F.col("storeid") == F.col("_sid")) & (F.col("_type") == F.col("_st")),
                  "left")
            .drop("_sid", "_st", "_type"))


def final_scores(prep: DataFrame, persons: DataFrame) -> DataFrame:
    """Every score with its person and store grade (NULL grades for older leases)."""
    p = persons.select(F.col("approvalid").alias("_pid"), "person_rank", "store_rank",
                       "store_probability")
    return (prep.join(p, F.col("approvalid") == F.col("_pid"), "left").drop("_pid"))
