"""Removal of repeated passages of lines by overlapping three-line windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, durable, needed

WINDOW = 3
#: Windows with this share of all windows, of which there can only be that many, are joined by a broadcast.
FREQUENT = 10_000


def _windows(lines: Column) -> Column:
    """Array of (h1, h2, at): two independent hashes of lines at..at+2, for windows that hold a word."""

    def one(i: Column) -> Column:
        a, b, c = F.get(lines, i), F.get(lines, i + 1), F.get(lines, i + 2)
        return F.struct(
            F.xxhash64(a, b, c).alias("h1"),
            F.hash(c, b, a).alias("h2"),
            i.alias("at"),
            F.concat(a, b, c).rlike(f"[^{BLANK[1:]}").alias("worded"),
        )

    made = F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), one)
    return F.when(F.size(lines) >= WINDOW, F.filter(made, lambda w: w["worded"]))


def later_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, starts): per document the starts of windows that occurred before.

    "Before" is by doc_id (nulls last), then the text's digest, then the position. Rows with the same
    doc_id and text count as one document.
    """
    lines = needed(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("digest"), F.split("text", "\n").alias("lines")
    )
    flat = durable(
        lines.select("doc_id", "digest", F.explode(_windows(F.col("lines"))).alias("w")).select(
            "w.h1", "w.h2", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "w.at").alias("place")
        ),
        "line_windows",
    )
    repeated = durable(
        flat.groupBy("h1", "h2")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("first") != F.col("last"))
        .select("h1", "h2", "first", "n"),
        "line_repeated",
    )
    often = F.col("n") > flat.count() / FREQUENT
    hot = F.broadcast(repeated.where(often))  # fewer than FREQUENT rows
    found = flat.join(hot, ["h1", "h2"]).unionByName(
        flat.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(repeated.where(~often), ["h1", "h2"]))
    return (
        found.where(F.col("place") != F.col("first"))
        .groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.digest").alias("digest"))
        .agg(F.collect_set("place.at").alias("starts"))
    )


def _kept(lines: Column, starts: Column) -> Column:
    """Indexes of the lines that no removed window covers, in order."""
    covered = F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` with cleaned text, plus n_lines and n_removed.

    Every three consecutive lines with at least one word are a window. Where a window occurs more than
    once over all documents, its first occurrence stays and the lines that any later occurrence covers
    go, so overlapping windows remove a passage as one stretch. Texts of fewer than three lines are
    left as they are. Windows are equal if two hashes with 96 bits together are.

    Null text stays null with no lines; empty text is one line. Rows that repeat a doc_id with its text
    are treated alike. If `docs` already has columns n_lines or n_removed, these replace them.
    An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    found = later_occurrences(docs).select(
        F.struct("doc_id", "digest").alias("hit"), F.coalesce("doc_id", F.lit(0)).alias("hit_id"),
        F.col("doc_id").isNull().alias("hit_null"), F.col("digest").alias("hit_digest"), "starts",
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
    ).select("row", F.coalesce("row.doc_id", F.lit(0)).alias("hit_id"), F.col("row.doc_id").isNull().alias("hit_null"),
             F.xxhash64("row.text").alias("hit_digest"))
    joined = rows.join(found, ["hit_id", "hit_null", "hit_digest"], "left").select(
        "row", "starts", F.split("row.text", "\n").alias("lines")
    )
    kept = F.when(F.col("starts").isNotNull(), _kept(F.col("lines"), F.col("starts")))
    # The row's own columns come out in a select of their own, where none of them can hide a column used here.
    cleaned = joined.select("row", "lines", kept.alias("kept")).select(
        "row",
        F.when(F.col("kept").isNull(), F.col("row.text"))
        .otherwise(F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n"))
        .alias("cleaned"),
        F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("lines_before"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("lines_gone"),
    )
    return cleaned.select(
        *[F.col("cleaned").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in keep],
        F.col("lines_before").alias("n_lines"),
        F.col("lines_gone").alias("n_removed"),
    )
