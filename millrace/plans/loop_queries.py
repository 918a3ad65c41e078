"""Sources over the given tables, and the closed loop from points to tickets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import series as s
from millrace.operators import tickets as t
from millrace.plans import monitor_queries, series_queries
from millrace.plans.monitor_queries import episodes, old_tickets, points
from millrace.plans.tables import read
from millrace.session import shared_folder
from millrace.sources import files
from millrace.streaming import pipelines
from millrace.streaming.sinks import run_available

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query("paginate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def _(spark, sf):
    return files.paginate(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100, 50)


@query("paginate_far", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 50 OFFSET (SELECT count(*) // 2 FROM lineitem)")
def _(spark, sf):
    """A page in the middle of a table in many ranges; only its ranges are read."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    pages = files.Pages(rows, ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], range_rows=2000)
    return pages.rows(50, rows.count() // 2).drop("l_partkey")


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
SKEWED = "o_orderkey * o_orderkey"


def _database(spark, sf) -> str:
    """The orders in an embedded database, with a key that crowds at its low end. It lives in the driver's process: a local session."""
    url = f"jdbc:derby:memory:millrace{uuid.uuid4().hex[:12]};create=true"
    rows = read(spark, sf, "orders").select(F.expr(SKEWED).cast("long").alias("K"), F.col("o_orderpriority").alias("PRIORITY"), F.col("o_totalprice").alias("PRICE"))
    rows.coalesce(4).write.format("jdbc").options(url=url, dbtable="ORDERS", createTableColumnTypes="PRIORITY VARCHAR(40)", **DERBY).save()
    return url


@query("read_jdbc_table", f"SELECT {SKEWED} AS k, o_orderpriority AS priority, o_totalprice AS price FROM orders")
def _(spark, sf):
    return files.read_jdbc_balanced(spark, _database(spark, sf), "ORDERS", "K", 8, **DERBY).toDF("k", "priority", "price")


@query("read_jdbc_query", f"SELECT o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE {SKEWED} > 1000 GROUP BY 1")
def _(spark, sf):
    sql = "SELECT PRIORITY, COUNT(*) AS N, MAX(PRICE) AS MOST FROM ORDERS WHERE K > 1000 GROUP BY PRIORITY"
    return files.read_jdbc_query(spark, _database(spark, sf), sql, **DERBY).toDF("priority", "n", "most").withColumn("n", F.col("n").cast("long"))


@query("union_files", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    a = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return files.union_files([a, b])


@query("parse_points_json", "SELECT event_type AS device, 'k' AS metric, (props ->> '$.k') AS value, NULL::VARCHAR AS ts FROM events")
def _(spark, sf):
    lines = read(spark, sf, "events").select(F.concat(F.lit('{"'), "event_type", F.lit('": '), "props", F.lit("}")).alias("value"))
    return files.parse_points_json(lines)


@query("parse_points_kv", "SELECT user_id::VARCHAR AS device, event_type AS metric, event_id::VARCHAR AS value, NULL::VARCHAR AS ts FROM events")
def _(spark, sf):
    c = lambda x: F.col(x).cast("string")
    return files.parse_points_kv(read(spark, sf, "events").select(F.concat(F.lit("device="), c("user_id"), F.lit(" metric="), c("event_type"), F.lit("  value="), c("event_id")).alias("value")))


@query("validate_points", "SELECT user_id::VARCHAR AS device, event_type AS metric, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE event_id::VARCHAR END AS value, CASE WHEN event_id % 10 <> 0 THEN event_id::DOUBLE END AS number, event_id % 10 <> 0 AS valid FROM events")
def _(spark, sf):
    value = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("event_id").cast("string"))
    return files.validate_points(read(spark, sf, "events").select(F.col("user_id").cast("string").alias("device"), F.col("event_type").alias("metric"), value.alias("value")))


def closed_loop(placed: DataFrame, by: list[str], known: DataFrame) -> DataFrame:
    """Series to tickets: control chart, risk and forecast of each series; a ticket where the risk is high or critical,
    with the advice of a known problem of that series; accepted when the chart is in control."""
    chart = s.control_chart(placed, by).select(*by, "judge", "n_outside")
    risk = s.risk_level(placed, by).select(*by, "risk")
    ahead = s.forecast_next(placed, by).select(*by, "next")
    rows = chart.join(risk, by).join(ahead, by, "left").join(known, by, "left")
    wants = F.col("risk").isin("high", "critical")
    return rows.select(*by, "judge", "n_outside", "risk", "next", F.when(wants, "open").alias("ticket"), F.when(wants, F.coalesce("advice", F.lit("停机检查并联系维护"))).alias("advice"), (F.col("judge") == "受控").alias("accepted"))


@query("closed_loop", f"""WITH a AS ({series_queries.ORACLES['control_chart']}), b AS ({series_queries.ORACLES['risk_level']}), c AS ({series_queries.ORACLES['forecast_next']}), d AS ({monitor_queries.ORACLES['alerts_to_tickets']}),
 k AS (SELECT metric, 'devices: ' || count(DISTINCT device) AS advice FROM d GROUP BY 1)
 SELECT event_type AS metric, judge, n_outside, risk, next, CASE WHEN risk IN ('high', 'critical') THEN 'open' END AS ticket, CASE WHEN risk IN ('high', 'critical') THEN coalesce(advice, '停机检查并联系维护') END AS advice, judge = '受控' AS accepted
 FROM a JOIN b USING (event_type) LEFT JOIN c USING (event_type) LEFT JOIN k ON k.metric = event_type""")
def _(spark, sf):
    placed = s.position(points(spark, sf), ["metric"], ["ts", "seq"], "value", F.date_trunc("day", "ts"))
    known = t.alerts_to_tickets(episodes(spark, sf), old_tickets(spark, sf)).groupBy("metric").agg(F.concat(F.lit("devices: "), F.count_distinct("device").cast("string")).alias("advice"))
    return closed_loop(placed, ["metric"], known)


def _place(spark, name: str) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


SUPPLIERS = "SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier"


def _suppliers(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))


@query("write_csv", SUPPLIERS)
def _(spark, sf):
    folder = _place(spark, "csv")
    files.write_csv(_suppliers(spark, sf), folder)
    return files.read_csv(spark, folder)


@query("read_csv", """SELECT o_orderkey::VARCHAR AS id, '"' || o_orderpriority || '", quoted' AS note, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders""")
def _(spark, sf):
    """Cells with quotes and commas, and empty cells."""
    folder = _place(spark, "csv")
    rows = read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit('"'), "o_orderpriority", F.lit('", quoted')).alias("note"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    files.write_csv(rows, folder)
    return files.read_csv(spark, folder)


@query("read_csv_stream", SUPPLIERS)
def _(spark, sf):
    folder = _place(spark, "csv")
    files.write_csv(_suppliers(spark, sf), folder)
    return run_available(files.read_csv_stream(spark, folder, ["id", "name", "nation"]))


@query("load_tables", """SELECT 'tbl_nation' AS "table", 'Nation' AS entity, 'n_nationkey' AS key, n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT 'factory_line_items', 'LineItems', 'id', l_orderkey || '-' || l_linenumber FROM lineitem""")
def _(spark, sf):
    rows = {
        "tbl_nation": read(spark, sf, "nation").select("n_nationkey", "n_name"),
        "factory_line_items": read(spark, sf, "lineitem").select("l_quantity", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))}
    folders = {name: _place(spark, name) for name in rows}
    for name, df in rows.items():
        files.write_csv(df, folders[name])
    tables, catalogue = files.load_tables(spark, folders)
    keys = {r["table"]: r["key"] for r in catalogue.collect()}  # a row for each table
    ids = files.union_files([df.select(F.lit(name).alias("table"), F.col(keys[name]).alias("id")) for name, df in tables.items()])
    return ids.join(F.broadcast(catalogue), "table").select("table", "entity", "key", "id")


@query("save_load_model", "SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1")
def _(spark, sf):
    folder = _place(spark, "model")
    files.save_model(read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")), folder)
    return files.load_model(spark, folder)


@query("write_markdown_facts", "SELECT '- ' || p_name || ' → ' || p_type AS value FROM part")
def _(spark, sf):
    folder = _place(spark, "facts")
    files.write_markdown_facts(read(spark, sf, "part").select(F.concat("p_name", F.lit(" → "), "p_type").alias("text")), folder)
    return spark.read.text(folder)


@query("read_markdown_lines", r"""WITH l AS (SELECT DISTINCT regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
 SELECT substr(sha256(text), 1, 16) AS h, text FROM l WHERE length(text) BETWEEN 8 AND 280""")
def _(spark, sf):
    folder = _place(spark, "notes")
    files.write_lines(read(spark, sf, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("value")), folder)
    return files.read_markdown_lines(spark, folder, "*.txt")


@query("list_tables", " UNION ALL ".join(f"SELECT 'millrace_{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "nation", "orders")))
def _(spark, sf):
    for t in ("orders", "nation", "customer"):
        read(spark, sf, t).createOrReplaceTempView(f"millrace_{t}")
    found = [t for t in files.list_tables(spark) if t.startswith("millrace_")]
    return files.union_files([spark.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in found])


@query("stream_ingest", """WITH p AS (SELECT user_id::VARCHAR AS device, event_type AS metric, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE event_id::VARCHAR END AS value, event_id % 10 <> 0 AS valid, value > 90 AS hot, ts FROM events)
 SELECT CASE WHEN valid THEN 'good' ELSE 'quarantine' END AS "table", device, metric, value FROM p UNION ALL SELECT 'fired', device, metric, value FROM p WHERE valid AND value::DOUBLE > 500""")
def _(spark, sf):
    """Lines of key=value go through validation into two tables; the valid points are evaluated by a rule on the way."""
    c = lambda x: F.col(x).cast("string")
    value = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(c("event_id"))
    lines, good, bad, fired, state = (_place(spark, n) for n in ("lines", "good", "quarantine", "fired", "state"))
    files.write_lines(read(spark, sf, "events").select(F.concat(F.lit("device="), c("user_id"), F.lit(" metric="), c("event_type"), F.lit(" value="), value).alias("value")), lines)

    def evaluate(points: DataFrame, number: int) -> None:
        points.where("number > 500").write.mode("overwrite").parquet(f"{fired}/batch={number}")

    pipelines.stream_ingest(spark.readStream.text(lines), files.parse_points_kv, good, bad, state, evaluate).awaitTermination()
    read_back = lambda folder, name: spark.read.parquet(folder).select(F.lit(name).alias("table"), "device", "metric", "value")
    return files.union_files([read_back(good, "good"), read_back(bad, "quarantine"), read_back(fired, "fired")])
