"""Cleaning of tables with loosely typed cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.typed import as_num, is_blank, is_num
from millrace.operators.series import quantile_of


def dedup_rows(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The first row, by `order`, of rows whose cells are the same as text."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__rn = 1").drop("__rn")


def numeric_columns(df: DataFrame, columns: Sequence[str], order: str) -> list[str]:
    """Columns whose first non-blank cell is a number."""
    firsts = df.agg(*[F.min_by(F.col(c).cast("string"), F.when(~is_blank(F.col(c)), F.col(order))).alias(c) for c in columns])
    known = firsts.select(*[is_num(F.col(c)).alias(c) for c in columns]).first()
    return [c for c in columns if known[c]]


def fill_drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only rows without a blank cell."""
    blank = F.lit(False)
    for c in columns:
        blank = blank | is_blank(F.col(c))
    return df.where(~blank)


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(is_blank(F.col(c)), "0").otherwise(F.col(c).cast("string")) for c in columns})


def fill_mean(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Blank cells of numeric columns get the mean, rounded to 3, of the column's numbers before filling."""
    means = df.agg(*[F.round(F.avg(as_num(F.col(c))), 3).cast("string").alias(f"__{c}") for c in numeric])
    joined = df.crossJoin(F.broadcast(means))  # one row of means
    filled = {c: F.when(is_blank(F.col(c)) & F.col(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c).cast("string")) for c in numeric}
    return joined.withColumns(filled).drop(*means.columns)


def outlier_iqr(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Without rows that lie outside any column's fences; all fences come from the same input, in one aggregate."""
    if not numeric:
        return df
    stats = []
    for c in numeric:
        v = as_num(F.col(c))
        stats += [quantile_of(v, 0.25).alias(f"__{c}_1"), quantile_of(v, 0.75).alias(f"__{c}_3"), F.count(v).alias(f"__{c}_n")]
    fences = df.agg(*stats)
    out = F.lit(False)
    for c in numeric:
        q1, q3 = F.col(f"__{c}_1"), F.col(f"__{c}_3")
        bad = ~as_num(F.col(c)).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        out = out | F.coalesce((F.col(f"__{c}_n") >= 4) & (q3 != q1) & bad, F.lit(False))
    return df.crossJoin(F.broadcast(fences)).where(~out).drop(*fences.columns)  # one row of fences


def outlier_zscore(df: DataFrame, numeric: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Column after column, rows beyond three standard deviations go; each column sees what the one before left.

    Three numbers a column come to the driver, so the plan is one scan with a filter for each column."""
    for c in numeric:
        v = as_num(F.col(c))
        mean, std, n = df.agg(F.avg(v), F.stddev_pop(v), F.count(v)).first()
        if n >= 3:
            df = df.where(~F.coalesce(F.abs(v - mean) > limit * (std or 1.0), F.lit(False)))
    return df


def clean(df: DataFrame, columns: Sequence[str], order: str, numeric: Sequence[str] | None = None, missing: str = "drop", outliers: str | None = "iqr") -> DataFrame:
    """Deduplicate, treat blanks (drop, zero, mean or keep), drop outliers (iqr, zscore or none)."""
    numeric = numeric_columns(df, columns, order) if numeric is None else numeric
    df = dedup_rows(df, columns, order)
    df = {"drop": lambda: fill_drop(df, columns), "zero": lambda: fill_zero(df, columns), "mean": lambda: fill_mean(df, numeric), "keep": lambda: df}[missing]()
    return {"iqr": lambda: outlier_iqr(df, numeric), "zscore": lambda: outlier_zscore(df, numeric), None: lambda: df}[outliers]()


def clean_report(df: DataFrame, columns: Sequence[str], order: str, numeric: Sequence[str], missing: str = "drop", outliers: str = "iqr") -> DataFrame:
    """One row: rows in, dropped as duplicates, for blanks and as outliers, rows out."""
    unique = dedup_rows(df, columns, order)
    whole = {"drop": fill_drop(unique, columns), "zero": fill_zero(unique, columns), "mean": fill_mean(unique, numeric)}[missing]
    kept = outlier_iqr(whole, numeric) if outliers == "iqr" else outlier_zscore(whole, numeric)
    steps = [x.agg(F.count(F.lit(1)).alias(n)) for n, x in (("rows_in", df), ("unique", unique), ("whole", whole), ("rows_out", kept))]
    one = steps[0]
    for x in steps[1:]:
        one = one.crossJoin(F.broadcast(x))  # single rows
    return one.select("rows_in", (F.col("rows_in") - F.col("unique")).alias("dropped_dup"), (F.col("unique") - F.col("whole")).alias("dropped_missing"),
                      (F.col("whole") - F.col("rows_out")).alias("dropped_outlier"), "rows_out")
