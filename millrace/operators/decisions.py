"""Declarative decision rules over inventory, sales, customers, equipment, products and suppliers.

Each rule takes DataFrames and returns (entity, action, level) with the numbers behind it; entity is a string.
Thresholds are a dict such as {"safety_stock": 14}; DEFAULTS holds those of each module.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds by module, the rules of each module with metric, id, name, and the default actions. Fixed values.
DEFAULTS = {
    "inventory": {"safety_stock": 14, "lead_time_days": 7, "slow_turnover": 1.0},
    "sales": {"aging_warn": 60, "aging_critical": 90, "forecast_drop": 0.3},
    "equipment": {"warranty_warn_days": 60},
    "procurement": {"supplier_score": 70},
}
RULES = (
    ("inventory", "D1", "补货", "reorder"),
    ("inventory", "D2", "缺货", "shortage"),
    ("inventory", "D3", "呆滞", "slow_turnover"),
    ("sales", "D4", "信用", "aging"),
    ("sales", "D6", "预测", "forecast"),
    ("procurement", "D7", "比价", "price_compare"),
    ("procurement", "D8", "供应商", "supplier_score"),
    ("equipment", "D5", "维护", "warranty"),
)
REPAIR_STATES = ("待修", "待维护")


def _number(c: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(float(default)))


def _key(c: str) -> Column:
    return F.col(c).cast("string").alias("entity")


def _sold(sales: DataFrame) -> DataFrame:
    """Per product: quantity and number of different dates, of sales with a quantity other than 0."""
    qty = F.col("qty").try_cast("double")
    return sales.where(qty.isNotNull() & (qty != 0)).groupBy("product_id").agg(F.sum(qty).alias("sold"), F.count_distinct("date").alias("days"))


def _safety(inventory: DataFrame, thr: Mapping[str, float]) -> Column:
    """A blank safety stock is 0; without the column the default holds."""
    return _number("safety_stock") if "safety_stock" in inventory.columns else F.lit(float(thr["safety_stock"]))


def reorder(inventory: DataFrame, sales: DataFrame, thr: Mapping[str, float] = DEFAULTS["inventory"]) -> DataFrame:
    """Stock below mean daily sales times lead time plus safety stock."""
    lead = _number("lead_time_days") if "lead_time_days" in inventory.columns else F.lit(float(thr["lead_time_days"]))
    rows = inventory.where("product_id is not null").select("product_id", _number("stock").alias("stock"), _safety(inventory, thr).alias("safety"), lead.alias("lead"))
    daily = F.coalesce(F.col("sold") / F.col("days"), F.lit(0.0))
    level = daily * F.col("lead") + F.col("safety")
    return rows.join(_sold(sales), "product_id", "left").withColumn("reorder_level", level).where("stock < reorder_level").select(
        _key("product_id"), F.lit("补货").alias("action"), F.lit("建议").alias("level"), "stock", F.round("reorder_level", 3).alias("reorder_level"))


def shortage(inventory: DataFrame, thr: Mapping[str, float] = DEFAULTS["inventory"]) -> DataFrame:
    rows = inventory.where("product_id is not null").select("product_id", _number("stock").alias("stock"), _safety(inventory, thr).alias("safety_stock"))
    return rows.where("stock < safety_stock").select(_key("product_id"), F.lit("缺货预警").alias("action"), F.lit("预警").alias("level"), "stock", "safety_stock")


def slow_turnover(inventory: DataFrame, sales: DataFrame, thr: Mapping[str, float] = DEFAULTS["inventory"]) -> DataFrame:
    rows = inventory.select("product_id", _number("stock").alias("stock")).where("stock > 0")
    turnover = F.coalesce(F.col("sold"), F.lit(0.0)) / F.col("stock")
    return rows.join(_sold(sales), "product_id", "left").withColumn("turnover", turnover).where(F.col("turnover") < thr["slow_turnover"]).select(
        _key("product_id"), F.lit("呆滞处理").alias("action"), F.lit("预警").alias("level"), "stock", F.round("turnover", 6).alias("turnover"))


def aging(customers: DataFrame, thr: Mapping[str, float] = DEFAULTS["sales"]) -> DataFrame:
    """Old debt first, then an amount above the credit limit."""
    rows = customers.select("id", _number("aging_days").alias("aging_days"), _number("credit_limit").alias("credit"), _number("order_amount").alias("amount"))
    action = (
        F.when(F.col("aging_days") >= thr["aging_critical"], "催收告急").when(F.col("aging_days") >= thr["aging_warn"], "催收预警")
        .when(F.col("amount") > F.col("credit"), "超信用额度"))
    return rows.withColumn("action", action).where("action is not null").select(
        _key("id"), "action", F.when(F.col("action") == "催收告急", "告急").otherwise("预警").alias("level"), "aging_days", F.round("amount", 2).alias("amount"), F.round("credit", 2).alias("credit"))


def warranty(equipment: DataFrame, as_of: str, thr: Mapping[str, float] = DEFAULTS["equipment"]) -> DataFrame:
    """Machines under repair, else by the end of warranty (30 days a month) seen from `as_of`; unreadable dates are left out."""
    today = F.to_date(F.lit(as_of))
    end = F.date_add(F.try_to_date(F.substring("install_date", 1, 10), "yyyy-MM-dd"), (30 * F.coalesce(F.col("warranty_months").try_cast("int"), F.lit(0))).cast("int"))
    rows = equipment.select("id", F.coalesce("status", F.lit("")).alias("status"), F.datediff(end, today).alias("days_left"))
    action = (
        F.when(F.col("status").isin(*REPAIR_STATES), "维护告急").when(F.col("days_left") < 0, "保修过期")
        .when(F.col("days_left") <= thr["warranty_warn_days"], "保修临期"))
    level = F.when(F.col("action") == "维护告急", "告急").when(F.col("action") == "保修过期", "预警").otherwise("建议")
    return rows.withColumn("action", action).where("action is not null").select(
        _key("id"), "action", level.alias("level"), F.when(F.col("action") != "维护告急", F.col("days_left")).alias("days_left"))


def sales_forecast(sales: DataFrame, order: Sequence[str], thr: Mapping[str, float] = DEFAULTS["sales"]) -> DataFrame:
    """Products whose later half of sales fell by more than the threshold against the earlier half.

    `order` sorts a product's sales without ties. With an odd number the middle one counts in neither half.
    """
    per = Window.partitionBy("product_id")
    rows = sales.select("product_id", *order, _number("qty").alias("qty")).select(
        "product_id", "qty", F.row_number().over(per.orderBy(*order)).alias("rn"), F.count(F.lit(1)).over(per).alias("n")).where("n >= 2")
    half = F.floor(F.col("n") / 2)
    sums = rows.groupBy("product_id").agg(
        F.sum(F.when(F.col("rn") <= half, F.col("qty")).otherwise(0)).alias("earlier"), F.sum(F.when(F.col("rn") > F.col("n") - half, F.col("qty")).otherwise(0)).alias("recent"))
    drop = (F.col("earlier") - F.col("recent")) / F.col("earlier")
    return sums.where(F.col("earlier") > 0).withColumn("drop", drop).where(F.col("drop") > thr["forecast_drop"]).select(
        _key("product_id"), F.lit("销售下滑预警").alias("action"), F.lit("预警").alias("level"), "earlier", "recent", F.round("drop", 6).alias("drop"))


def price_compare(products: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A hint for each product with a known supplier."""
    known = suppliers.select(F.col("id").alias("supplier"), "name", "price_rank").dropDuplicates(["supplier"])
    return products.join(known, "supplier").select(_key("id"), F.lit("比价提示").alias("action"), F.lit("建议").alias("level"), F.col("name").alias("supplier_name"), "price_rank")


def supplier_score(suppliers: DataFrame, thr: Mapping[str, float] = DEFAULTS["procurement"]) -> DataFrame:
    score = 0.5 * _number("on_time_pct", 100) + 0.5 * _number("quality_pct", 100)
    return suppliers.withColumn("score", score).where(F.col("score") < thr["supplier_score"]).select(
        _key("id"), F.lit("供应商绩效预警").alias("action"), F.lit("预警").alias("level"), F.round("score", 5).alias("score"))


#: metric -> (tables, thresholds, options) -> DataFrame; a table that is missing leaves the metric out.
METRICS = {
    "reorder": (("inventory", "sales"), lambda t, thr, o: reorder(t["inventory"], t["sales"], thr)),
    "shortage": (("inventory",), lambda t, thr, o: shortage(t["inventory"], thr)),
    "slow_turnover": (("inventory", "sales"), lambda t, thr, o: slow_turnover(t["inventory"], t["sales"], thr)),
    "aging": (("customers",), lambda t, thr, o: aging(t["customers"], thr)),
    "forecast": (("sales",), lambda t, thr, o: sales_forecast(t["sales"], o["sales_order"], thr)),
    "price_compare": (("products", "suppliers"), lambda t, thr, o: price_compare(t["products"], t["suppliers"])),
    "supplier_score": (("suppliers",), lambda t, thr, o: supplier_score(t["suppliers"], thr)),
    "warranty": (("equipment",), lambda t, thr, o: warranty(t["equipment"], o["as_of"], thr)),
}


def run_decisions(tables: Mapping[str, DataFrame], options: Mapping, rules=RULES, thresholds: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """All rules whose tables are there: (module, id, name, entity, action, level)."""
    out = None
    for module, rule_id, name, metric in rules:
        wants, run = METRICS[metric]
        if any(w not in tables for w in wants):
            continue
        thr = {**DEFAULTS.get(module, {}), **(thresholds or {}).get(module, {})}
        got = run(tables, thr, options).select(
            F.lit(module).alias("module"), F.lit(rule_id).alias("id"), F.lit(name).alias("name"), "entity", "action", "level")
        out = got if out is None else out.unionByName(got)
    return out


def merge_thresholds(base: DataFrame, override: DataFrame) -> DataFrame:
    """(module, key, value) of both; the override's value beats the base's."""
    a, b = base.alias("a"), override.alias("b")
    return a.join(b, ["module", "key"], "full").select("module", "key", F.coalesce("b.value", "a.value").alias("value"))


def apply_industry(base: DataFrame, industries: DataFrame, industry: str) -> DataFrame:
    """The base thresholds with those of an industry over them; an unknown industry changes nothing."""
    return merge_thresholds(base, industries.where(F.col("industry") == industry).select("module", "key", "value"))


def feedback_tune(feedback: DataFrame) -> DataFrame:
    """Rows (target, kind, value, strength): k grows by a tenth of the strength and stays at 1.5 or more, a rule's
    threshold shrinks by a twentieth. loop_closed: the value changed."""
    new = F.when(F.col("kind") == "k", F.greatest(F.lit(1.5), F.col("value") * (1 + 0.1 * F.col("strength")))).otherwise(F.col("value") * (1 - 0.05 * F.col("strength")))
    return feedback.withColumn("new_value", F.round(new, 6)).withColumn("loop_closed", F.col("new_value") != F.col("value"))


def evolution_recent(loops: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last n loops by `order`, the latest last."""
    return loops.orderBy(F.desc(order)).limit(n).orderBy(order)


def evolution_counts(loops: DataFrame) -> DataFrame:
    return loops.agg(F.count(F.lit(1)).alias("loops"), F.count_if("loop_closed").alias("closed"))
