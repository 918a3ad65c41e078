"""Profiling and quality audit of tables with loosely typed cells, all columns in one pass over one unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.typed import as_num, field_cn, guess_type, is_num, strip
from millrace.operators.selection import KEEP, select_quantiles
from millrace.operators.series import quantile_of
from millrace.session import durable

#: Column words and their units, in the order of the checks. Fixed values.
MEASURES = (
    ("temp", "温度(℃)"), ("vibration", "振动(mm/s)"), ("power", "功率(kW)"), ("pressure", "压力(bar)"), ("humidity", "湿度(%)"),
    ("speed", "转速(rpm)"), ("rpm", "转速(rpm)"), ("voltage", "电压(V)"), ("current", "电流(A)"), ("flow", "流量"), ("time", "时间"), ("date", "日期"),
)
TYPE_MEASURES = {"integer": "数量(个)", "float": "数值", "date": "日期", "text": "文本", "empty": "", "missing": ""}


def long_cells(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(row, column, raw, cell): every cell once, raw as string and stripped; row is the `order` column."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("place"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("raw")) for i, c in enumerate(columns)]
    flat = df.select(F.col(order).alias("row"), F.explode(F.array(*parts)).alias("x"))
    return flat.select("row", F.col("x.column").alias("column"), F.col("x.place").alias("place"), F.col("x.raw").alias("raw"), strip(F.col("x.raw")).alias("cell"))


def profile_schema(df: DataFrame, columns: Sequence[str], order: str, samples: int = 5) -> DataFrame:
    """Per column: type of the first non-blank cell, counts, distinct cells (blank counts as one) and first samples."""
    cells = long_cells(df, columns, order)
    counts = cells.groupBy("column", "place").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("cell") != "").alias("non_empty"), F.count_if(F.col("cell") == "").alias("missing"),
        F.min_by("cell", F.when(F.col("cell") != "", F.col("row"))).alias("first"))
    unique = cells.groupBy("column").agg(F.count_distinct("cell").alias("unique"))
    first = Window.partitionBy("column").orderBy("row")
    heads = cells.where("cell != ''").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= samples).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "cell"))), lambda x: x["cell"]).alias("sample"))
    typed = F.when(F.col("non_empty") == 0, "empty").otherwise(guess_type(F.col("first")))
    return counts.join(unique, "column").join(heads, "column", "left").select(
        "column", typed.alias("type"), "non_empty", "missing", "unique", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def field_measure(column: Column, type_: Column) -> Column:
    out = F.lit("文本")
    for t, m in TYPE_MEASURES.items():
        out = F.when(type_ == t, F.lit(m)).otherwise(out)
    for word, m in reversed(MEASURES):
        out = F.when(F.lower(column).contains(word), F.lit(m)).otherwise(out)
    return out


def profile_dictionary(df: DataFrame, columns: Sequence[str], order: str, most: int = 20) -> DataFrame:
    """Per column: Chinese name, measure, type and its values where there are 1 to 20 and fewer than rows."""
    schema = profile_schema(df, columns, order, 1).drop("sample").withColumn("total", F.col("non_empty") + F.col("missing"))
    distinct = long_cells(df, columns, order).select("column", "cell").distinct()
    few = schema.where((F.col("unique") <= most) & (F.col("unique") < F.col("total"))).select("column")
    enums = distinct.join(few, "column").groupBy("column").agg(F.array_sort(F.collect_list("cell")).alias("enum"))
    return schema.join(enums, "column", "left").select(
        "column", field_cn(F.col("column")).alias("cn"), field_measure(F.col("column"), F.col("type")).alias("measure"), "type",
        "non_empty", "unique", F.coalesce("enum", F.array().cast("array<string>")).alias("enum"))


def type_drift(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(column, type, count): cells of another type in columns whose first cell is an integer or a float."""
    cells = long_cells(df, columns, order).where("cell != ''").withColumn("type", guess_type(F.col("cell")))
    by_type = cells.groupBy("column", "type").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    lead = by_type.groupBy("column").agg(F.min_by("type", "first").alias("type0"))
    return by_type.join(lead, "column").where("type != type0 and type0 in ('integer', 'float')").groupBy("column", F.col("type0").alias("type")).agg(F.sum("n").alias("count"))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    return df.select(*keys).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """(column, count) of numbers outside the fences, for columns with four numbers or more."""
    nums = long_cells(df, columns, order).where(is_num(F.col("raw"))).select("column", as_num(F.col("raw")).alias("v"))
    values = nums.groupBy("column", "v").agg(F.count(F.lit(1)).alias("times"))
    return _outside(values).select("column", "count")


def _outside(values: DataFrame, giant: DataFrame | None = None, keep: int = KEEP) -> DataFrame:
    """(column, count) of numbers (column, v, times) outside their column's fences: all numbers of a column, each once, so
    the fences meet as many rows as there are distinct numbers. With `giant`, the numbers themselves (column, v), the fences
    are selected in rounds, for columns with more distinct numbers than a task can hold."""
    fences = select_quantiles(giant, ["column"], [0.25, 0.75], keep).select(
        "column", *[F.round(F.round(f"q{i}", 9), 3).alias(f"q{3 if i else 1}") for i in (0, 1)], "n").where("n >= 4") if giant is not None else values.groupBy("column").agg(quantile_of("v", 0.25, times=F.col("times")).alias("q1"), quantile_of("v", 0.75, times=F.col("times")).alias("q3"), F.sum("times").alias("n")).where("n >= 4")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    out = values.join(fences, "column").where(~F.col("v").between(F.col("q1") - reach, F.col("q3") + reach))
    return out.groupBy("column").agg(F.sum("times").alias("count"))


def profile_quality(df: DataFrame, columns: Sequence[str], order: str, giant: bool = False, keep: int = KEEP) -> DataFrame:
    """Issues as rows (issue, column, count, rate): missing, duplicate, type_drift, outlier.

    Two scans: one of the rows for repeats, one of the cells, which are counted once by column, kind and number; all
    other issues come from these counts, which are written first. giant: as in `series.quantile`."""
    cells = long_cells(df, columns, order)
    number = F.when(is_num(F.col("raw")), as_num(F.col("raw")))
    counts = durable(cells.groupBy("column", F.when(F.col("cell") != "", guess_type(F.col("cell"))).alias("type"), number.alias("v")).agg(
        F.count(F.lit(1)).alias("times"), F.min("row").alias("first")), "profile_counts")
    none = F.lit(None).cast("double")
    missing = counts.groupBy("column").agg(F.sum(F.when(F.col("type").isNull(), F.col("times")).otherwise(0)).alias("count"), F.sum("times").alias("rows")).where("count > 0")
    lead = counts.where("type is not null").groupBy("column").agg(F.min_by("type", "first").alias("type0"))
    drift = counts.where("type is not null").join(lead, "column").where("type != type0 and type0 in ('integer', 'float')").groupBy("column").agg(F.sum("times").alias("count"))
    outliers = _outside(counts.where("v is not null").groupBy("column", "v").agg(F.sum("times").alias("times")), cells.select("column", number.alias("v")).where("v is not null") if giant else None, keep).agg(F.sum("count").alias("count")).where("count > 0")
    dups = duplicate_rows(df, columns).where("duplicates > 0")
    no_column = F.lit(None).cast("string").alias("column")
    return (
        missing.select(F.lit("missing").alias("issue"), "column", "count", F.round(F.col("count") / F.col("rows"), 3).alias("rate"))
        .unionByName(dups.select(F.lit("duplicate").alias("issue"), no_column, F.col("duplicates").alias("count"), F.round(F.col("duplicates") / F.col("rows"), 3).alias("rate")))
        .unionByName(drift.select(F.lit("type_drift").alias("issue"), "column", "count", none.alias("rate")))
        .unionByName(outliers.select(F.lit("outlier").alias("issue"), no_column, "count", none.alias("rate"))))


def profile_col_stats(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """describe for every column with numbers."""
    nums = long_cells(df, columns, order).where(is_num(F.col("raw"))).select("column", as_num(F.col("raw")).alias("v"))
    from millrace.operators.series import describe

    return describe(nums, ["column"], "v")


def quality_score(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """One row: score between 0 and 1 from completeness, repeats and outliers, and its grade. Empty tables score 0."""
    issues = profile_quality(df, columns, order)
    sums = issues.agg(*[F.coalesce(F.sum(F.when(F.col("issue") == i, F.col("count"))), F.lit(0)).alias(i) for i in ("missing", "duplicate", "outlier")])
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    both = rows.crossJoin(F.broadcast(sums))  # two single rows
    score = (
        0.5 * (1 - F.col("missing") / (F.col("rows") * len(columns))) + 0.3 * (1 - F.col("duplicate") / F.col("rows"))
        + 0.2 * (1 - F.least("outlier", "rows") / F.col("rows")))
    scored = both.select("rows", F.when(F.col("rows") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).alias("score"))
    return scored.withColumn("grade", quality_level(F.col("score")))


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.9, "优").when(score >= 0.75, "良").when(score >= 0.6, "中").otherwise("差")


def detect_numeric_col(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The column of the first number in row order, id-like names last."""
    cells = long_cells(df, columns, order).where(is_num(F.col("raw")))
    low = F.lower("column")
    id_like = (low == "id") | low.endswith("_id") | low.endswith("id")
    return cells.agg(F.min_by("column", F.struct(id_like.alias("id"), "row", "place")).alias("column"))


def profile_report(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Schema, dictionary, issues and number statistics of each column in one row."""
    schema, words = profile_schema(df, columns, order), profile_dictionary(df, columns, order).select("column", "cn", "measure", "enum")
    issues = profile_quality(df, columns, order).where("column is not null").groupBy("column").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    stats = profile_col_stats(df, columns, order)
    return schema.join(words, "column").join(issues, "column", "left").join(stats, "column", "left").withColumn(
        "issues", F.coalesce("issues", F.array().cast("array<string>")))


def profile_preview(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """The first rows, which a report shows beside the statistics."""
    return df.orderBy(order).limit(rows)
