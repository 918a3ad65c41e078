"""What several operators of the subpackage share: small column helpers and joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import Scope, durable, shared_folder, ship  # noqa: F401

# A word of the document contracts: a run of anything but these six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def needed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further input columns can't clash with an operator's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Most rows of (doc_id, digest) that are broadcast, 16 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id and text digest aren't in `bad` (doc_id, digest), which is written
    first. Up to BROADCAST_ROWS of these are broadcast, so that the rows of `docs` stay where they are."""
    gone = durable(needed(bad, "doc_id", "digest").distinct().toDF("bad_id", "bad_digest"), "gone")
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("row.text") == F.col("bad_digest"))
    return rows.join(F.broadcast(gone) if small else gone, same, "left_anti").select("row.*")


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`df.mapInArrow` with the package's code at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
