"""Third-party risk codes: dedup per approval, one-hot flags, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators.onehot import discover_codes, flag_sql, mask_columns, onehot, onehot_masks
from riskflow.operators.stringlist import string_list
from riskflow.sources.codes import NO_CODE, RISK_CODES, RISK_PREFIX

DISCOVERED = "discovered"
CODES_WITH_NONE = list(RISK_CODES) + [NO_CODE]


def risk_codes(lease_view: DataFrame, applicant: DataFrame, indicators: DataFrame
               ) -> DataFrame:
    """Distinct (approvalid, riskcode) for approvals with an applicant id >= 1.

    An applicant without codes gets the code NONE (kept whole: the source's
    width rule would cut it to 'NO'). ``sequence`` is always 1 after the dedup.
    The applicant filter makes the applicant join inner; the distinct is one
    shuffle with map-side dedup, so a hot approval is reduced before it moves.
    """
    a = applicant.filter(F.col("applicantid") >= 1).select("approvalid", "applicantid")
    lv = lease_view.select("approvalid")
    return (lv.join(a, "approvalid", "inner")
              .join(indicators.select("applicantid", "riskcode"), "applicantid", "left")
              .select("approvalid",
                      F.coalesce(F.col("riskcode"), F.lit(NO_CODE)).alias("riskcode"))
              .distinct()
              .withColumn("sequence", F.lit(1)))


def _columns(codes: DataFrame, code_list) -> list[str]:
    if code_list == DISCOVERED:
        return discover_codes(codes, "riskcode", known=CODES_WITH_NONE)
    return list(code_list or CODES_WITH_NONE)


def risk_flags_presence(codes: DataFrame, code_list=None) -> DataFrame:
    """Flag 1 for each code present (absent 0), plus the code count ``_mc_v2_z_sum``.

    ``code_list=DISCOVERED`` adds a column for every code of the data that is not on the list.
    """
    return onehot(codes, "approvalid", "riskcode", _columns(codes, code_list), RISK_PREFIX,
                  "presence", count_col="_mc_v2_z_sum")


def risk_flags_absence(codes: DataFrame, code_list=None) -> DataFrame:
    """Flag 0 for each code present (absent 1), keyed ``appid``, plus ``_mc_v2_z_sum``."""
    return (onehot(codes, "approvalid", "riskcode", _columns(codes, code_list), RISK_PREFIX,
                   "absence", count_col="_mc_v2_z_sum")
            .withColumnRenamed("approvalid", "appid"))


def risk_code_lists(codes: DataFrame) -> DataFrame:
    """Every approval's codes as one sorted, comma-separated text."""
    return string_list(codes, ["approvalid"], "riskcode", "codes")


RISK_MASK_PREFIX = "_risk_w"
RISK_MASKS = mask_columns(len(CODES_WITH_NONE), RISK_MASK_PREFIX)


def risk_masks(codes: DataFrame) -> DataFrame:
    """Packed form of the flags: ``appid``, the presence bitmasks and ``_mc_v2_z_sum``."""
    return (onehot_masks(codes, "approvalid", "riskcode", CODES_WITH_NONE, "_mc_v2_z_sum",
                         RISK_MASK_PREFIX)
            .withColumnRenamed("approvalid", "appid"))


def absence_flag_sql(code: str) -> str:
    """A model flag (absence polarity, 1 when the approval has no risk row) from the masks."""
    return flag_sql(CODES_WITH_NONE.index(code), "absence", RISK_MASK_PREFIX, missing=1)


def none_flag_sql() -> str:
    """The 'no risk code' flag: 1 without a risk row or with only NONE, else 0."""
    has_none = flag_sql(CODES_WITH_NONE.index(NO_CODE), "presence", RISK_MASK_PREFIX)
    return f"CASE WHEN `{RISK_MASKS[0]}` IS NULL THEN 1 WHEN {has_none} = 1 THEN 1 ELSE 0 END"


def risk_flag_exprs() -> dict[str, str]:
    """Column name -> SQL text for every model risk flag, read from the masks."""
    out = {RISK_PREFIX + c: absence_flag_sql(c) for c in RISK_CODES}
    out[RISK_PREFIX + NO_CODE] = none_flag_sql()
    return out


def risk_catalogue(indicators: DataFrame) -> DataFrame:
    """Every code seen, with its feature column and coefficient names."""
    codes = indicators.select("riskcode").distinct()
    return codes.select(
        "riskcode",
        F.concat(F.lit(RISK_PREFIX), "riskcode").alias("feature_name"),
        F.concat(F.lit(RISK_PREFIX), "riskcode", F.lit("0")).alias("coef_name"),
    )
