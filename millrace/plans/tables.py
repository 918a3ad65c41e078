"""How the library's operators are bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BY, ORDER = ["event_type"], ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")


def day(ts: str = "ts"):
    return F.date_trunc("day", F.col(ts))
