"""The corpus pipeline: documents in, packed training sequences out, each stage by one operator of ledgerline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, ngram_join, packing, quality, secrets
from ledgerline.llm.common import fresh, read, removed, table_path
from ledgerline.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below 0.5.

    A null or empty text has the score of the constant feature.  Rows of a null doc_id are scored like all others but
    never learnt from; repeated rows have one score.  Without labels every score is 0.5 and all rows stay.
    """
    weights = quality.train(docs, read(spark, sf_dir, "labels").where(~quality.held_out()))
    name = fresh(docs, "score")
    return quality.score(docs, weights, name=name).where(F.col(name) >= 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, of equal rows any one.

    Null, empty and wordless texts are like nothing and stay; so does a row of a null doc_id unless a named one is like it.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.  Null and wordless texts and items match nothing; ties do not matter."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark of its kind; n_chars follows the new text.  No row goes, and a null text stays null."""
    columns = [F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return secrets.redact(docs).select(*columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises what is left and packs it into sequences; a null or empty text is one piece of the end id."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_removal),
    ("packing", sequence_packing),
]

#: Training, Jaccard components and packing have no SQL form; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's result is written to the shared folder and read again.

    A stage's table goes when the next one stands; the last one's stays, as the result reads it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
