"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last
one returns the mix. STAGES are run one after the other, each result written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, mixing, near_dedup, quality_classifier
from millrace.llm.common import Scope, durable, read_table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_accepted(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go; a document of which nothing is left goes whole.

    n_chars follows the cleaned text where documents have it.
    """
    cleaned = line_dedup.dedup_lines(docs)
    kept = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    added = [c for c in ("n_lines", "n_removed") if c not in docs.columns]
    return kept.drop(*added).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, the training text in its order: shard, part, order, doc_id, epoch, word_from, text."""
    return mixing.shard_pieces(docs, durable(mixing.plan_mix(docs), "mix_plan"))


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The classifier, the near-duplicates and the mix can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; of what they write only the last result stays. Other queries' tables aren't touched."""
    docs = read_table(spark, sf_dir, "documents")
    with Scope(spark) as own:
        for name, stage in STAGES:
            docs = durable(stage(spark, docs, sf_dir), "stage_" + name.replace(" ", "_"))
            own.drop(but_last=1)
    return docs
