"""Requirements, acceptance items and project estimates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.typed import strip
from millrace.operators.profile import quality_level
from millrace.operators.series import numbered

CATEGORIES = ("生产", "质量", "设备", "数据", "集成", "运维", "其他")
PRIORITIES = ("P0", "P1", "P2", "P3")
CLAUSE = r"([一-鿿]{2,8}(?:率|量|度|数|额))|(提升|降低|减少|增加|支持|实现|提供)[一-鿿]{0,10}"
PASSED, FAILED, PENDING = "通过", "未通过", "待验收"


def structure_requirement(stories: DataFrame) -> DataFrame:
    """(id, title, story, category, priority, acceptance, valid) from (id, story, category, priority, acceptance, title).

    Unknown categories or priorities and blank stories make a row invalid; a missing acceptance is read from the
    story's first clause, a missing title is its first 24 characters.
    """
    story = strip(F.col("story"))
    clause = F.regexp_extract(story, CLAUSE, 0)
    auto = F.array(F.when(clause != "", F.concat(F.lit("验证"), clause, F.lit("可按预期观测"))).otherwise("验证需求在主流程中可完整走通"))
    category, priority = strip(F.coalesce("category", F.lit("生产"))), F.upper(strip(F.coalesce("priority", F.lit("P2"))))
    return stories.select(
        "id", strip(F.coalesce("title", F.substring(story, 1, 24))).alias("title"), story.alias("story"), category.alias("category"), priority.alias("priority"),
        F.when(F.coalesce(F.size("acceptance"), F.lit(0)) > 0, F.col("acceptance")).otherwise(auto).alias("acceptance"),
        (category.isin(*CATEGORIES) & priority.isin(*PRIORITIES) & (story != "")).alias("valid"))


def build_acceptance(requirements: DataFrame, order: str = "id") -> DataFrame:
    """One item A-001, A-002, ... for each clause, in the order of the requirements."""
    flat = requirements.select(F.col(order).alias("__o"), F.col("id").alias("rid"), "title", F.posexplode("acceptance").alias("at", "clause"))
    return numbered(flat, ["__o", "at"]).select(F.format_string("A-%03d", "number").alias("aid"), "rid", "title", "clause", F.lit(PENDING).alias("result"))


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right) of each key of either table: one aggregate over both, which neither sorts nor holds a table."""
    side = lambda df, is_right: df.select(key, F.lit(is_right).alias("side")).dropna()
    return side(left, 0).unionByName(side(right, 1)).groupBy(key).agg((F.min("side") == 0).alias("in_left"), (F.max("side") == 1).alias("in_right"))


def set_missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks."""
    return _sides(left, right, key).where(~F.col("in_right")).select(F.col(key).cast(left.schema[key].dataType).alias(key))


def reconcile(requirements: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, rid): requirements (id) without an item are missing, items (rid) without a requirement are orphans."""
    known = _sides(requirements.select(F.col("id").alias("rid")), items, "rid").where(~(F.col("in_left") & F.col("in_right")))
    return known.select(F.when(F.col("in_left"), "missing").otherwise("orphan").alias("kind"), "rid")


def reconcile_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("result") == PASSED).alias("passed"),
                     F.count_if(F.col("result") == FAILED).alias("failed"), F.count_if(F.col("result") == PENDING).alias("pending"))


def acceptance_status(items: DataFrame, by: list[str]) -> DataFrame:
    """accept: there are items and all passed."""
    return items.groupBy(*by).agg(F.coalesce(F.bool_and(F.col("result") == PASSED), F.lit(False)).alias("accept"), F.count_if(F.col("result") == PASSED).alias("passed_n"), F.count(F.lit(1)).alias("total"))


def transfer_checklist(requirements: DataFrame) -> DataFrame:
    return requirements.select(F.col("id").alias("rid"), "title", F.lit(False).alias("trained"), F.lit(False).alias("handed_over"), F.lit("").alias("owner"))


def hit_rate(asked: DataFrame, by: list[str]) -> DataFrame:
    """Hits among questions in percent."""
    return asked.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count(F.lit(1)) * 100, 1).alias("rate"))


#: Days of a project, price of a day, tax. Fixed values.
EFFORT: Mapping[str, float] = {"base": 2.0, "per_1000_rows": 0.5, "per_requirement": 0.8, "quality_penalty": 1.2}
COMPLEXITY: Mapping[str, float] = {"basic": 1.0, "medium": 1.6, "advanced": 2.4}
UNIT_PRICE, TAX = 3000.0, 0.06


def estimate_effort(projects: DataFrame) -> DataFrame:
    """Days for (project, rows, requirements, complexity, quality); an unknown complexity gives null days."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv]), F.col("complexity"))
    scale = F.col("rows") / 1000 * EFFORT["per_1000_rows"]
    penalty = EFFORT["base"] * (1 - F.col("quality")) * EFFORT["quality_penalty"]
    req = F.col("requirements") * EFFORT["per_requirement"]
    total = (EFFORT["base"] + scale + penalty + req) * factor
    return projects.select(
        "project", "rows", "requirements", "complexity", F.round("quality", 3).alias("quality"), quality_level(F.col("quality")).alias("quality_level"),
        F.lit(EFFORT["base"]).alias("base_days"), F.round(scale, 2).alias("scale_days"), F.round(penalty, 2).alias("quality_days"), F.round(req, 2).alias("requirement_days"), F.round(total, 1).alias("total_days"))


def build_quote(efforts: DataFrame, unit_price: float = UNIT_PRICE, tax: float = TAX) -> DataFrame:
    """One row for each priced line and project: item, days, amount, and the project's subtotal, tax and total."""
    line = lambda name, c: F.struct(F.lit(name).alias("item"), F.col(c).alias("days"), F.round(F.col(c) * unit_price, 2).alias("amount"))
    lines = F.filter(F.array(line("base", "base_days"), line("data", "scale_days"), line("quality", "quality_days"), line("requirements", "requirement_days")), lambda x: (x["days"] > 0) | (x["item"] == "base"))
    priced = efforts.withColumn("lines", lines).withColumn("subtotal", F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["amount"]), 2))
    return priced.select("project", F.explode("lines").alias("x"), "subtotal", F.round(F.col("subtotal") * tax, 2).alias("tax"), F.round(F.col("subtotal") + F.round(F.col("subtotal") * tax, 2), 2).alias("total")).select(
        "project", "x.item", "x.days", "x.amount", "subtotal", "tax", "total")
