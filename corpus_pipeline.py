"""The corpus pipeline: documents through five operators of ``riskflow.llm``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared checkpoint folder and rereads it as the next stage's docs. All but the last
return the columns they were given, extra ones included (working columns have names of
their own, so nothing clashes).

1. language_id: goes what is ``und`` (null text, no letter) or less likely than ``LEAST_LANGUAGE`` to be
   in any learned language; without a learned language, only ``und``.
2. toxicity: goes what scores ``TOXIC`` or more.
3. near_duplicates: one document of each group stays, the one of the smallest id. Rows of one id
   count as repeats of one document: the one of the smallest text stays. Rows with a null id link with nothing and stay.
4. personal_data: every span is replaced by its kind in brackets; n_chars, if there, follows the text.
5. packing: one row per piece of the documents that are left, with its sequence and place.

An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import common, langid, minhash, packing, pii, toxicity
from riskflow.operators.materialize import materialize

LEAST_LANGUAGE = 0.3
TOXIC = 0.5


def _own_name() -> str:
    return f"_stage_{uuid.uuid4().hex}"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network, mine = langid.train(langid.learnable(docs)), _own_name()
    if not network.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn(mine, langid.predict_column(network)(F.col("text").cast("string")))
    return found.filter((F.col(f"{mine}.lang_pred") != langid.UNKNOWN)
                        & (F.col(f"{mine}.score") >= LEAST_LANGUAGE)).drop(mine)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = toxicity.learnable(common.table(spark, sf_dir, "labels"))
    model, mine = toxicity.train(common.id_and_text(docs), labels), _own_name()
    scored = docs.withColumn(mine, toxicity.score_column(model)(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.filter(F.col(f"{mine}.score") < TOXIC).drop(mine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(common.id_and_text(docs))
    mine = _own_name()
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    stay = (docs.join(kept, docs["doc_id"].cast("long") == kept[mine], "left_semi")
            .groupBy(F.col("doc_id").alias(mine)).agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row")).select("row.*"))
    return stay.union(docs.filter("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, mine = pii.train(common.id_and_text(docs)), _own_name()
    found = pii.find(docs, model, prefix=mine)
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.concat(F.col(f"{mine}base"), F.col(f"{mine}added"))))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(common.id_and_text(docs), common.tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None       # trained models and tokenizers: no stage's rows can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
