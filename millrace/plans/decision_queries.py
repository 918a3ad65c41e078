"""Decision rules over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import decisions as d
from millrace.plans.tables import read

QUERIES, ORACLES = {}, {}
AS_OF = "1998-08-02"
SALES_ORDER = ["date", "l_orderkey", "l_linenumber"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def inventory(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 10).alias("stock"), F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise("140").alias("safety_stock"))


def sales(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("qty"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber")


def customers(spark, sf):
    orders = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.datediff(F.to_date(F.lit(AS_OF)), F.to_date(F.max("o_orderdate"))).alias("aging_days"), F.round(F.sum("o_totalprice"), 2).alias("order_amount"))
    return orders.join(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 200).alias("credit_limit")), "id")


def equipment(spark, sf):
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "待修").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("install_date"), F.lit(12).alias("warranty_months"))


def suppliers(spark, sf):
    share = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.round(100 * F.avg((F.col("l_linestatus") == "F").cast("double")), 4).alias("on_time_pct"), F.round(100 * F.avg((F.col("l_returnflag") != "R").cast("double")), 4).alias("quality_pct"))
    return share.join(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("price_rank")), "id")


def products(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("supplier"))


INV = "inv AS (SELECT p_partkey AS product_id, (p_size * 10)::DOUBLE AS stock, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 140.0 END AS safety FROM part)"
SOLD = "sold AS (SELECT l_partkey AS product_id, sum(l_quantity) AS sold, count(DISTINCT l_shipdate::DATE) AS days FROM lineitem WHERE l_quantity <> 0 GROUP BY 1)"
CUST = f"""cu AS (SELECT o_custkey AS id, date_diff('day', max(o_orderdate)::DATE, DATE '{AS_OF}') AS aging, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1),
 cus AS (SELECT id, aging, amount, c_acctbal * 200 AS credit FROM cu JOIN customer ON c_custkey = id)"""
SUP = """sh AS (SELECT l_suppkey AS id, round(100 * avg((l_linestatus = 'F')::INT::DOUBLE), 4) AS on_time, round(100 * avg((l_returnflag <> 'R')::INT::DOUBLE), 4) AS quality FROM lineitem GROUP BY 1),
 su AS (SELECT id, on_time, quality, s_name AS name, s_nationkey AS price_rank FROM sh JOIN supplier ON s_suppkey = id)"""
REORDER = "SELECT product_id::VARCHAR AS entity, '补货' AS action, '建议' AS level, stock, round(coalesce(sold / days, 0) * 7 + safety, 3) AS reorder_level FROM inv LEFT JOIN sold USING (product_id) WHERE stock < coalesce(sold / days, 0) * 7 + safety"
SHORT = "SELECT product_id::VARCHAR AS entity, '缺货预警' AS action, '预警' AS level, stock, safety AS safety_stock FROM inv WHERE stock < safety"
SLOW = "SELECT product_id::VARCHAR AS entity, '呆滞处理' AS action, '预警' AS level, stock, round(coalesce(sold, 0) / stock, 6) AS turnover FROM inv LEFT JOIN sold USING (product_id) WHERE stock > 0 AND coalesce(sold, 0) / stock < {t}"
AGING = """SELECT id::VARCHAR AS entity, CASE WHEN aging >= 90 THEN '催收告急' WHEN aging >= 60 THEN '催收预警' ELSE '超信用额度' END AS action, CASE WHEN aging >= 90 THEN '告急' ELSE '预警' END AS level,
 aging::DOUBLE AS aging_days, amount, round(credit, 2) AS credit FROM cus WHERE aging >= 60 OR amount > credit"""
WARR = f"""SELECT o_orderkey::VARCHAR AS entity, CASE WHEN o_orderstatus = 'P' THEN '维护告急' WHEN d < 0 THEN '保修过期' ELSE '保修临期' END AS action, CASE WHEN o_orderstatus = 'P' THEN '告急' WHEN d < 0 THEN '预警' ELSE '建议' END AS level,
 CASE WHEN o_orderstatus <> 'P' THEN d END AS days_left FROM (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN date_diff('day', DATE '{AS_OF}', o_orderdate::DATE + 360) END AS d FROM orders) WHERE o_orderstatus = 'P' OR d <= 60"""
FORE = """SELECT product_id::VARCHAR AS entity, '销售下滑预警' AS action, '预警' AS level, earlier, recent, round((earlier - recent) / earlier, 6) AS "drop" FROM (
 SELECT l_partkey AS product_id, sum(CASE WHEN rn <= n // 2 THEN l_quantity ELSE 0 END) AS earlier, sum(CASE WHEN rn > n - n // 2 THEN l_quantity ELSE 0 END) AS recent FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate::DATE, l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) WHERE n >= 2 GROUP BY 1)
 WHERE earlier > 0 AND (earlier - recent) / earlier > 0.3"""
PRICE = "SELECT p.id::VARCHAR AS entity, '比价提示' AS action, '建议' AS level, name AS supplier_name, price_rank FROM (SELECT l_partkey AS id, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1) p JOIN su ON su.id = supplier"
SCORE = "SELECT id::VARCHAR AS entity, '供应商绩效预警' AS action, '预警' AS level, round(0.5 * on_time + 0.5 * quality, 5) AS score FROM su WHERE 0.5 * on_time + 0.5 * quality < {t}"


@query("decide_reorder", f"WITH {INV}, {SOLD} {REORDER}")
def _(spark, sf):
    return d.reorder(inventory(spark, sf), sales(spark, sf))


@query("decide_shortage", f"WITH {INV} {SHORT}")
def _(spark, sf):
    return d.shortage(inventory(spark, sf))


@query("decide_slow_turnover", f"WITH {INV}, {SOLD} {SLOW.format(t=4.0)}")
def _(spark, sf):
    return d.slow_turnover(inventory(spark, sf), sales(spark, sf), {"slow_turnover": 4.0})


@query("decide_aging", f"WITH {CUST} {AGING}")
def _(spark, sf):
    return d.aging(customers(spark, sf))


@query("decide_warranty", WARR)
def _(spark, sf):
    return d.warranty(equipment(spark, sf), AS_OF)


@query("decide_forecast", FORE)
def _(spark, sf):
    return d.sales_forecast(sales(spark, sf), SALES_ORDER)


@query("decide_price_compare", f"WITH {SUP} {PRICE}")
def _(spark, sf):
    return d.price_compare(products(spark, sf), suppliers(spark, sf))


@query("decide_supplier_score", f"WITH {SUP} {SCORE.format(t=75)}")
def _(spark, sf):
    return d.supplier_score(suppliers(spark, sf), {"supplier_score": 75})


def _rule(module, rule_id, name, sql):
    return f"SELECT '{module}' AS module, '{rule_id}' AS id, '{name}' AS name, entity, action, level FROM ({sql})"


@query("run_decisions", f"WITH {INV}, {SOLD}, {CUST}, {SUP} " + " UNION ALL ".join(
    _rule(m, i, n, {"reorder": REORDER, "shortage": SHORT, "slow_turnover": SLOW.format(t=1.0), "aging": AGING, "forecast": FORE, "price_compare": PRICE, "supplier_score": SCORE.format(t=75), "warranty": WARR}[k])
    for m, i, n, k in d.RULES))
def _(spark, sf):
    tables = {"inventory": inventory(spark, sf), "sales": sales(spark, sf), "customers": customers(spark, sf), "suppliers": suppliers(spark, sf), "products": products(spark, sf), "equipment": equipment(spark, sf)}
    return d.run_decisions(tables, {"as_of": AS_OF, "sales_order": SALES_ORDER}, thresholds={"procurement": {"supplier_score": 75}})


# Thresholds per market segment (module) and priority (key): the mean order price, overridden by that of late orders.
BASE = "SELECT c_mktsegment AS module, o_orderpriority AS key, round(avg(o_totalprice), 4) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
OVER = BASE.replace("GROUP BY", "WHERE o_orderstatus = 'F' AND c_nationkey < 3 GROUP BY")


def _prices(spark, sf, where="true"):
    joined = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(where)
    return joined.groupBy(F.col("c_mktsegment").alias("module"), F.col("o_orderpriority").alias("key")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


@query("merge_thresholds", f"WITH a AS ({BASE}), b AS ({OVER}) SELECT module, key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (module, key)")
def _(spark, sf):
    return d.merge_thresholds(_prices(spark, sf), _prices(spark, sf, "o_orderstatus = 'F' and c_nationkey < 3"))


@query("feedback_tune", """SELECT target, kind, value, strength, round(CASE WHEN kind = 'k' THEN greatest(1.5, value * (1 + 0.1 * strength)) ELSE value * (1 - 0.05 * strength) END, 6) AS new_value,
 round(CASE WHEN kind = 'k' THEN greatest(1.5, value * (1 + 0.1 * strength)) ELSE value * (1 - 0.05 * strength) END, 6) <> value AS loop_closed
 FROM (SELECT o_orderkey AS target, CASE WHEN o_orderstatus = 'F' THEN 'k' ELSE 'rule' END AS kind, (o_orderkey % 7)::DOUBLE AS value, (o_custkey % 4)::DOUBLE AS strength FROM orders)""")
def _(spark, sf):
    rows = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("target"), F.when(F.col("o_orderstatus") == "F", "k").otherwise("rule").alias("kind"), (F.col("o_orderkey") % 7).cast("double").alias("value"), (F.col("o_custkey") % 4).cast("double").alias("strength"))
    return d.feedback_tune(rows)
