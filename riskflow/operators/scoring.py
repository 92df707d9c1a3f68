"""Linear (logistic) scoring from a term spec and a long coefficient table.

A model is a list of ``Term``s. Coefficients live in a long table
``(model, feature, level, weight)``; they are a fitted model's parameters (a
few hundred rows, bounded by the spec, not by the data), read once to the
driver and folded into a single column expression as literals: one pass over
the rows, no join, no per-row Python. The same spec yields per-term
contribution columns (score explanation), whose sum is the linear score.

Semantics kept from the source formulas:
* a categorical term matches its levels in order; an unlisted level adds 0,
  unless the term has no ELSE (then it is NULL and so is the score);
* a matched level whose weight is missing (NULL) makes the score NULL;
* flag terms add ``coalesce(flag, 0) * coalesce(weight, 0)``;
* slope terms add ``coalesce(value * weight, 0)``;
* string levels compare ignoring trailing blanks and case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.strings import folded

# A model has some hundred weights; a table beyond this bound is not one.
MOST_COEFFICIENTS = 10_000
ZERO = object()  # a level that adds a literal 0 instead of a weight


@dataclass(frozen=True)
class Term:
    name: str                       # term / coefficient feature name
    column: str | None = None       # input column (None for the intercept)
    kind: str = "level"             # level | flag | slope | intercept | flag_off
    levels: tuple = ()              # (match value, coefficient level | ZERO)
    has_else: bool = True           # ELSE 0 (True) or no ELSE -> NULL (False)
    coef_feature: str | None = None  # coefficient feature when it differs from name


@dataclass
class Model:
    name: str
    terms: list[Term] = field(default_factory=list)

    def columns(self) -> list[str]:
        return sorted({t.column for t in self.terms if t.column})


def coefficient_maps(coefs: DataFrame, models: Sequence[Model | str]
                     ) -> dict[str, dict[tuple[str, str], float | None]]:
    """Read the models' (feature, level) -> weight dicts in one job.

    The coefficient table is a fitted model's parameters: its size is bounded by
    the model spec (a few hundred rows), not by the data being scored. For a ``Model`` the
    names are checked against its terms: a row that no term reads raises, as does a weight
    without a row (one that is known to be missing is a row with a NULL weight).
    """
    specs = {m.name: m for m in models if isinstance(m, Model)}
    models = [m.name if isinstance(m, Model) else m for m in models]
    rows = (coefs.filter(F.col("model").isin(*models))
            .select("model", "feature", "level", "weight").limit(MOST_COEFFICIENTS + 1).collect())
    if len(rows) > MOST_COEFFICIENTS:
        raise ValueError(f"more than {MOST_COEFFICIENTS} coefficients: not a model's parameter table")
    out: dict[str, dict] = {m: {} for m in models}
    for r in rows:
        key = (r["feature"], r["level"] or "")
        if key in out[r["model"]]:
            raise ValueError(f"coefficient given twice: {r['model']} {key}")
        out[r["model"]][key] = r["weight"]
    for name, model in specs.items():
        used = set(coefficient_names(model).values())
        unknown, missing = sorted(set(out[name]) - used), sorted(used - set(out[name]))
        if unknown or missing:
            raise ValueError(f"coefficients of {name}: unknown {unknown[:5]}, missing {missing[:5]}")
    return out


def coefficient_names(model: Model) -> dict[str, tuple[str, str]]:
    """Wide-table column name -> (feature, level) of every weight that the model uses.

    The column of a level is the feature's name followed by the level (as one-hot columns are
    named), lower case; that of a flag, slope or intercept is the feature's name.
    """
    names: dict[str, tuple[str, str]] = {}
    for t in model.terms:
        feature = t.coef_feature or t.name
        levels = [str(lv) for _, lv in t.levels if lv is not ZERO] if t.kind == "level" else [""]
        for level in levels:
            names[(feature + level).lower()] = (feature, level)
    return names


def unpivot_coefficients(wide: DataFrame, models: Sequence[Model], name_col: str = "model") -> DataFrame:
    """The wide form (one row per model, one column per weight) as the long table.

    Column names are taken from the models' terms. A column that no model knows, a name that
    appears twice, or a model with several rows is an error; a weight without a column is
    missing (NULL), as it is where the column is NULL.
    """
    columns = [c for c in wide.columns if c.lower() != name_col.lower()]
    lowered = [c.lower() for c in columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError("a coefficient column appears twice")
    known = {m.name: coefficient_names(m) for m in models}
    strange = [c for c in columns if not any(c.lower() in names for names in known.values())]
    if strange:
        raise ValueError(f"unknown coefficient columns: {strange[:5]}")
    repeated = wide.groupBy(name_col).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"several rows for model {repeated[0][name_col]}")
    parts = []
    for model, names in known.items():
        given = {c.lower(): F.col(f"`{c}`").cast("double") for c in columns}
        entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(lv).alias("level"),
                                     given.get(n, F.lit(None).cast("double")).alias("weight")) for n, (f, lv) in names.items()])
        parts.append(wide.filter(F.col(name_col) == model).select(F.lit(model).alias("model"), F.explode(entries).alias("e"))
                     .select("model", "e.*"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def model_inputs(models: Sequence[Model]) -> list[Column]:
    """The columns that the models read; those compared with text are folded once, so that the
    many level tests of a term compare plain values."""
    terms = [t for m in models for t in m.terms if t.column]
    texts = {t.column for t in terms if t.kind == "level" and any(isinstance(v, str) for v, _ in t.levels)}
    return [folded(F.col(f"`{c}`").cast("string")).alias(c) if c in texts else F.col(f"`{c}`")
            for c in sorted({t.column for t in terms})]


def _lit(w) -> str:
    return "CAST(NULL AS DOUBLE)" if w is None else f"CAST({float(w)!r} AS DOUBLE)"


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_sql(term: Term, weights: dict) -> str:
    """Spark SQL text of one term's contribution.

    String inputs are expected folded (see ``model_inputs``). The whole model is handed to the JVM as expression text (one parse) rather
    than assembled from thousands of Python-side Column calls.
    """
    feat = term.coef_feature or term.name
    if term.kind == "intercept":
        return _lit(weights.get((feat, "")))
    col = f"`{term.column}`"
    if term.kind == "flag":
        return f"coalesce(CAST({col} AS DOUBLE), 0D) * coalesce({_lit(weights.get((feat, '')))}, 0D)"
    if term.kind == "flag_off":
        # weight added when the flag is 0 or missing
        return (f"CASE WHEN {col} = 0 OR {col} IS NULL THEN {_lit(weights.get((feat, '')))} "
                f"ELSE 0D END")
    if term.kind == "slope":
        return f"coalesce(CAST({col} AS DOUBLE) * {_lit(weights.get((feat, '')))}, 0D)"
    if not term.levels:
        return "0D"
    parts = []
    for value, level in term.levels:
        w = "0D" if level is ZERO else _lit(weights.get((feat, str(level))))
        if isinstance(value, str):
            cond = f"{col} = {_sql_str(value.rstrip().lower())}"
        else:
            cond = f"{col} = {value!r}"
        parts.append(f"WHEN {cond} THEN {w}")
    return "CASE " + " ".join(parts) + (" ELSE 0D END" if term.has_else else " END")


def linear_sql(model: Model, weights: dict) -> str:
    return " + ".join(f"({term_sql(t, weights)})" for t in model.terms) or "0D"


def contributions(model: Model, weights: dict, prefix: str = "t_") -> dict[str, str]:
    """Term name -> SQL text of its contribution."""
    return {prefix + t.name: term_sql(t, weights) for t in model.terms}


def routed_sql(branches: Sequence[tuple[str, str]]) -> str:
    """``CASE WHEN c1 THEN e1 WHEN c2 THEN e2 END`` as SQL text."""
    return "CASE " + " ".join(f"WHEN {c} THEN ({e})" for c, e in branches) + " END"
