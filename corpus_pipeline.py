"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. the co-trained quality classifier rejects poor and toxic documents,
2. near-duplicates by SimHash: one document of each group stays,
3. documents that hold benchmark windows go,
4. personal data is masked in the texts,
5. what is left is packed into sequences of 2048 tokens.

All stages but the last return the columns of ``documents``, and further ones as
they are, whatever their names.  Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varnaflow.llm import decontaminate, packing, pii, quality, similar
from varnaflow.llm.common import free_names, row_key, stored
from varnaflow.llm.encoding import tokenizer_path
from varnaflow.session import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null texts are judged as empty ones, repeated rows alike."""
    return quality.kept(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word-shingle similarity of 0.8 or more: the smallest doc_id, a null one last."""
    return similar.keep_one(docs, shingle=5, similarity=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null texts have none, and rows that repeat a doc_id are judged each by its text."""
    hits = decontaminate.decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad_id, bad_row = free_names(docs.columns, "bad_id", "bad_row")
    bad = hits.where(F.size("spans") > 0).select(F.col("doc_id").alias(bad_id), F.col("row").alias(bad_row)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (row_key() == F.col(bad_row)), "left_anti")


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked; n_chars follows the text, and what is null stays null."""
    ship(spark)
    masked = docs.withColumn("text", pii.masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a null text has only the end id."""
    ship(spark)
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", clean),
    ("PII", mask),
    ("best-fit packing", pack),
]
#: SQL can express neither the classifier nor the near-duplicate search nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
