"""The streaming operators over events as a stream of files, and the graph of several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ontology as o
from millrace.plans.monitor_queries import EVENTS, MINUTES, PT, rules
from millrace.plans.tables import read
from millrace.streaming import pipelines
from millrace.streaming.sinks import run_available, run_into_folder

QUERIES, ORACLES = {}, {}
#: How long a ticket may be open before it is reported as such.
LONGEST = "4 days"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def stream_points(spark, sf):
    path = f"{sf}/event[s].parquet"  # a pattern, as the source takes a single file only by one
    events = spark.readStream.schema(read(spark, sf, "events").schema).parquet(path)
    return events.select(F.col("user_id").cast("string").alias("device"), F.col("event_type").alias("metric"), "value", "ts", F.col("event_id").alias("seq"))


@query("stream_rollup", f"""WITH {PT}, w AS (SELECT device, metric, time_bucket(INTERVAL '30 minutes', ts) AS bucket, round(avg(value) + 1e-9, 2) AS avg, min(value) AS min, max(value) AS max, count(value) AS count FROM pt GROUP BY 1, 2, 3)
 SELECT * FROM w WHERE bucket + INTERVAL '30 minutes' <= (SELECT max(ts) FROM pt) - INTERVAL '10 minutes'""")
def _(spark, sf):
    return run_available(pipelines.stream_rollup(stream_points(spark, sf), "30 minutes"))


@query("stream_alerts", f"WITH {EVENTS} SELECT * FROM ev WHERE ts < (SELECT max(ts) FROM pt) - INTERVAL '10 minutes'")
def _(spark, sf):
    """All points that the watermark passes: those up to ten minutes before the last."""
    found = run_available(pipelines.stream_alerts(stream_points(spark, sf), rules(spark, sf), minutes=MINUTES))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "raised_at")})


@query("stream_tickets", f"""WITH {EVENTS}, lg AS (SELECT * FROM ev WHERE ts < (SELECT max(ts) FROM pt) - INTERVAL '10 minutes'),
 wm AS (SELECT least(max(ts) FILTER (event = 'raised'), max(ts) FILTER (event = 'recovered')) - INTERVAL '10 minutes' AS passed FROM lg),
 tk AS (SELECT a.device, a.metric, a.ts AS opened_at, a.level, b.ts AS done_at FROM lg a LEFT JOIN lg b ON b.event = 'recovered' AND a.device = b.device AND a.metric = b.metric AND a.ts = b.raised_at AND b.ts <= a.ts + INTERVAL '{LONGEST}' WHERE a.event = 'raised')
 SELECT device, metric, opened_at, level, CASE WHEN done_at IS NULL THEN 'open' ELSE 'done' END AS state, done_at FROM tk, wm WHERE done_at IS NOT NULL OR opened_at + INTERVAL '{LONGEST}' < passed""")
def _(spark, sf):
    """The points' stream writes its alert events, which are the stream that tickets are made of: all that are done, and those
    that the watermark has passed."""
    alerts = pipelines.stream_alerts(stream_points(spark, sf), rules(spark, sf), minutes=MINUTES)
    log = spark.readStream.schema(alerts.schema).parquet(run_into_folder(alerts))
    return run_available(pipelines.stream_tickets(log, LONGEST)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened_at", "done_at")})


@query("graph_nodes_edges_multi", """SELECT DISTINCT 'Order:' || o_orderkey AS "from", 'Customer:' || o_custkey AS "to", 'customer_id' AS rel FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT DISTINCT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'nation_id' FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT DISTINCT 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'region_id' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    tables = {
        "Order": read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id")),
        "Customer": read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id")),
        "Nation": read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region_id")),
        "Region": read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), "r_name"),
    }
    return o.link_tables(tables, dict.fromkeys(tables, "id"))[1]
