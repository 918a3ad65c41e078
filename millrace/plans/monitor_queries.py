"""Monitoring and tickets over events: device = user_id, metric = event_type."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import monitor as m
from millrace.operators import tickets as t
from millrace.plans.tables import read

QUERIES, ORACLES = {}, {}
MINUTES = 2880


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def points(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").cast("string").alias("device"), F.col("event_type").alias("metric"), "value", "ts", F.col("event_id").alias("seq"))


def rules(spark, sf):
    """A rule for two of three devices and each of their metrics: one- and two-sided, some disabled, some that look at changes."""
    keys = read(spark, sf, "events").select("user_id", "event_type").distinct().where("user_id % 3 < 2")
    u = F.col("user_id")
    op = F.when(u % 7 == 0, "between").when(u % 11 == 0, "outside").when(u % 3 == 0, ">").otherwise("<=")
    return keys.select(
        u.cast("string").alias("device"), F.col("event_type").alias("metric"), op.alias("op"), (30.0 + u % 5 * 10).alias("threshold"),
        F.when(u % 77 != 0, "and").alias("op2"), (55.0 + u % 5 * 10).alias("threshold2"), F.when(u % 13 != 12, u % 13 != 0).alias("enabled"),
        F.when(u % 4 == 1, 60.0).alias("mutate_pct"), F.when(u % 2 == 0, "warn").otherwise("critical").alias("level"))


PT = "pt AS (SELECT user_id::VARCHAR AS device, event_type AS metric, value, ts, event_id AS seq, user_id FROM events)"
RU = """ru AS (SELECT device, metric, op, threshold, op2, threshold2, enabled, mutate_pct, level FROM (SELECT DISTINCT user_id::VARCHAR AS device, event_type AS metric,
  CASE WHEN user_id % 7 = 0 THEN 'between' WHEN user_id % 11 = 0 THEN 'outside' WHEN user_id % 3 = 0 THEN '>' ELSE '<=' END AS op, 30.0::DOUBLE + user_id % 5 * 10 AS threshold,
  CASE WHEN user_id % 77 <> 0 THEN 'and' END AS op2, 55.0::DOUBLE + user_id % 5 * 10 AS threshold2, CASE WHEN user_id % 13 <> 12 THEN user_id % 13 <> 0 END AS enabled,
  CASE WHEN user_id % 4 = 1 THEN 60.0::DOUBLE END AS mutate_pct, CASE WHEN user_id % 2 = 0 THEN 'warn' ELSE 'critical' END AS level FROM events WHERE user_id % 3 < 2) WHERE coalesce(enabled, true))"""
MATCH = """CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold
  WHEN 'between' THEN op2 IS NOT NULL AND value BETWEEN threshold AND threshold2 WHEN 'outside' THEN op2 IS NOT NULL AND NOT value BETWEEN threshold AND threshold2 ELSE false END"""
JU = f"{PT}, {RU}, ju AS (SELECT pt.*, op, threshold, op2, threshold2, enabled, mutate_pct, level, coalesce({MATCH}, false) AS fired FROM pt JOIN ru USING (device, metric))"
# With what is far from the median of the last minutes.
JM = f"""{JU}, jw AS (SELECT *, quantile_cont(value, 0.5) OVER f AS base, count(value) OVER f AS seen FROM ju WINDOW f AS (PARTITION BY device, metric ORDER BY ts RANGE BETWEEN INTERVAL {MINUTES} MINUTES PRECEDING AND CURRENT ROW)),
 jm AS (SELECT * REPLACE (type IS NOT NULL AS fired) FROM (SELECT * EXCLUDE (base, seen), CASE WHEN fired THEN 'threshold' WHEN seen >= 2 AND base <> 0 AND abs((value - base) / base) * 100 > mutate_pct THEN 'mutate' END AS type FROM jw))"""
EP = f"""{JM}, e1 AS (SELECT *, coalesce(lag(fired) OVER w, false) AS before, CASE WHEN NOT lead(fired) OVER w THEN lead(ts) OVER w END AS next_ok FROM jm WINDOW w AS (PARTITION BY device, metric ORDER BY ts, seq)),
 e2 AS (SELECT *, sum((fired AND NOT before)::INT) OVER (PARTITION BY device, metric ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS episode FROM e1),
 ep AS (SELECT device, metric, episode::BIGINT AS episode, min(ts) AS raised_at, max_by(value, (ts, seq)) AS value, count(*) AS n_points, max(next_ok) AS recovered_at, max(level) AS level, min_by(type, (ts, seq)) AS type,
  CASE WHEN max(next_ok) IS NULL THEN 'firing' ELSE 'recovered' END AS state FROM e2 WHERE fired GROUP BY device, metric, episode)"""
EVENTS = f"""{EP}, ev AS (SELECT device, metric, ts, seq, value, CASE WHEN NOT fired THEN 'recovered' WHEN before THEN 'updated' ELSE 'raised' END AS event, type, level,
  last_value(CASE WHEN fired AND NOT before THEN ts END IGNORE NULLS) OVER (PARTITION BY device, metric ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS raised_at FROM e2 QUALIFY fired OR before)"""
LA = f"{PT}, la AS (SELECT device, metric, max_by(value, (ts, seq)) AS value, max(ts) AS ts, max_by(seq, (ts, seq)) AS seq FROM pt GROUP BY 1, 2)"


def judged(spark, sf):
    return m.rules_x_points(points(spark, sf), rules(spark, sf))


def moved(spark, sf):
    return m.judge(points(spark, sf), rules(spark, sf), MINUTES)


def episodes(spark, sf):
    return m.alert_episodes(moved(spark, sf))


def old_tickets(spark, sf):
    """A ticket for every fourth device's metrics, half of them done."""
    return points(spark, sf).where("cast(device as long) % 4 = 0").groupBy("device", "metric").agg(F.min("ts").alias("opened_at")).withColumn(
        "state", F.when(F.col("device").cast("long") % 8 == 0, "done").otherwise("open"))


TK = "tk AS (SELECT device, metric, min(ts) AS opened_at, CASE WHEN device::BIGINT % 8 = 0 THEN 'done' ELSE 'open' END AS state FROM pt WHERE device::BIGINT % 4 = 0 GROUP BY 1, 2)"


@query("rules_x_points", f"WITH {JU} SELECT device, metric, value, ts, seq, op, threshold, op2, threshold2, enabled, mutate_pct, level, fired FROM ju")
def _(spark, sf):
    return judged(spark, sf)


@query("match_condition", """SELECT event_id, CASE event_type WHEN 'click' THEN value > 40 WHEN 'view' THEN value >= 40 WHEN 'error' THEN value BETWEEN 20 AND 60 WHEN 'signup' THEN NOT value BETWEEN 20 AND 60 ELSE false END AS hit FROM events""")
def _(spark, sf):
    op = F.when(F.col("event_type") == "click", ">").when(F.col("event_type") == "view", ">=").when(F.col("event_type") == "error", "between").when(F.col("event_type") == "signup", "outside").otherwise("?")
    ranged = F.col("event_type").isin("error", "signup")
    hit = m.match_condition(F.col("value"), op, F.when(ranged, 20.0).otherwise(40.0), F.when(ranged, "and"), F.lit(60.0))
    return read(spark, sf, "events").select("event_id", hit.alias("hit"))


@query("combine_conditions", f"""WITH {LA} SELECT device, coalesce(max(value) FILTER (metric = 'click') > 30, false) AND coalesce(max(value) FILTER (metric = 'view') <= 80, false)
 AND coalesce(max(value) FILTER (metric = 'click') BETWEEN 35 AND 95, false) AND coalesce(NOT max(value) FILTER (metric = 'view') BETWEEN 10 AND 30, false) AS hit FROM la GROUP BY 1""")
def _(spark, sf):
    current = m.latest(points(spark, sf)).groupBy("device").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("now"))
    asked = (("click", None, 30.0, None, None), ("view", "<=", 80.0, None, None), ("click", "between", 35.0, "and", 95.0), ("view", "outside", 10.0, "and", 30.0))
    names = ("metric", "op", "threshold", "op2", "threshold2")
    combos = F.array(*[F.struct(*[F.lit(x).cast("double" if "threshold" in n else "string").alias(n) for n, x in zip(names, c)]) for c in asked])
    return current.select("device", m.combine_conditions(combos, F.col("now")).alias("hit"))


@query("minute_rollup", f"WITH {PT} SELECT device, metric, time_bucket(INTERVAL '30 minutes', ts) AS bucket, round(avg(value) + 1e-9, 2) AS avg, min(value) AS min, max(value) AS max, count(value) AS count FROM pt GROUP BY 1, 2, 3")
def _(spark, sf):
    return m.minute_rollup(points(spark, sf), "30 minutes")


@query("devices", "SELECT DISTINCT user_id::VARCHAR AS device FROM events")
def _(spark, sf):
    return m.devices(points(spark, sf))


@query("latest", f"WITH {LA} SELECT * FROM la")
def _(spark, sf):
    return m.latest(points(spark, sf))


@query("series", f"WITH {PT} SELECT device, metric, value, ts, seq FROM pt WHERE device = '7' AND metric = 'click'")
def _(spark, sf):
    return m.series(points(spark, sf), "7", "click")


@query("series_arrays", f"WITH {PT} SELECT device, metric, list(value ORDER BY seq) FILTER (value IS NOT NULL) AS \"values\" FROM pt GROUP BY 1, 2")
def _(spark, sf):
    return m.series_arrays(points(spark, sf))


@query("recent_window", f"WITH {PT} SELECT device, metric, value, ts, seq FROM pt WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL {MINUTES} MINUTES AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, sf):
    return m.recent_window(points(spark, sf), "2024-01-15 00:00:00", MINUTES)


@query("mutation_detect", f"""WITH {PT}, w AS (SELECT *, quantile_cont(value, 0.5) OVER f AS base, count(value) OVER f AS seen FROM pt WINDOW f AS (PARTITION BY device, metric ORDER BY ts RANGE BETWEEN INTERVAL {MINUTES} MINUTES PRECEDING AND CURRENT ROW))
 SELECT device, metric, ts, seq, value, round(base + 1e-9, 2) AS base, CASE WHEN base <> 0 THEN round(abs((value - base) / base) * 100 + 1e-9, 1) END AS change, coalesce(base <> 0 AND abs((value - base) / base) * 100 > 20, false) AS mutated FROM w WHERE seen >= 2""")
def _(spark, sf):
    return m.mutation_detect(points(spark, sf), 20.0, MINUTES)


@query("alert_episodes", f"WITH {EP} SELECT * FROM ep")
def _(spark, sf):
    return episodes(spark, sf)


@query("alert_events", f"WITH {EVENTS} SELECT * FROM ev")
def _(spark, sf):
    return m.alert_events(moved(spark, sf))


@query("evaluate_latest", f"WITH {LA}, {RU} SELECT device, metric, value, ts, seq, op, threshold, op2, threshold2, enabled, mutate_pct, level, true AS fired FROM la JOIN ru USING (device, metric) WHERE {MATCH}")
def _(spark, sf):
    return m.evaluate_latest(points(spark, sf), rules(spark, sf))


CHAIN = (("R1", None, "click", ">", 50.0, (("view", ">", 30.0, None), ("error", "<", 60.0, None)), "alert", None), ("R2", None, "view", "<", 40.0, (("click", ">", 90.0, None), ("error", ">", 20.0, "OR")), "ticket", True), ("R3", "7", "error", ">=", 10.0, (), "notify", True), ("R4", None, "click", ">", 0.0, (), "notify", False))


@query("rule_chain", f"""WITH {PT}, l AS (SELECT *, last_value(CASE WHEN metric = 'click' THEN value END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN metric = 'view' THEN value END IGNORE NULLS) OVER w AS v,
  last_value(CASE WHEN metric = 'error' THEN value END IGNORE NULLS) OVER w AS e FROM pt WINDOW w AS (PARTITION BY device ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT 'R1' AS rule_id, 'alert' AS action, * FROM l WHERE metric = 'click' AND value > 50 AND coalesce(v > 30, false) AND coalesce(e < 60, false)
  UNION ALL SELECT 'R2', 'ticket', * FROM l WHERE metric = 'view' AND value < 40 AND (coalesce(c > 90, false) OR coalesce(e > 20, false)) UNION ALL SELECT 'R3', 'notify', * FROM l WHERE metric = 'error' AND device = '7' AND value >= 10)
 SELECT rule_id, device, metric, ts, seq, value, action FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, device ORDER BY ts, seq) AS rn FROM f) WHERE action <> 'alert' OR rn = 1""")
def _(spark, sf):
    chain = spark.createDataFrame(CHAIN, "id string, device string, metric string, op string, threshold double, combos array<struct<metric:string,op2:string,threshold:double,op:string>>, action string, enabled boolean")
    return m.rule_chain(points(spark, sf), chain, ["click", "view", "error"])


@query("worst_level", f"WITH {JU} SELECT device, CASE WHEN count(*) FILTER (fired) = 0 THEN 'ok' WHEN count(*) FILTER (fired) = count(*) FILTER (fired AND level = 'warn') THEN 'warn' ELSE 'critical' END AS level FROM ju GROUP BY 1")
def _(spark, sf):
    return m.worst_level(judged(spark, sf), ["device"])


@query("ticket_severity", f"WITH {EP} SELECT device, CASE WHEN bool_or(level = 'critical') THEN 'critical' WHEN bool_or(level IN ('warn', 'high')) THEN 'high' ELSE 'medium' END AS severity FROM ep GROUP BY 1")
def _(spark, sf):
    return t.ticket_severity(episodes(spark, sf), ["device"])


@query("monitor_snapshot", f"""WITH {EP}, {TK}, l AS (SELECT DISTINCT device, metric FROM pt) SELECT (SELECT count(*) FROM l) AS series, (SELECT count(DISTINCT device) FROM l) AS devices,
 (SELECT count(*) FROM ep WHERE state = 'firing') AS firing, (SELECT count(*) FROM ep WHERE state = 'recovered') AS recovered, (SELECT count(*) FROM tk WHERE state <> 'done') AS open_tickets, (SELECT count(*) FROM tk WHERE state = 'done') AS done_tickets""")
def _(spark, sf):
    return m.monitor_snapshot(points(spark, sf), episodes(spark, sf), old_tickets(spark, sf))


@query("hottest_device", f"WITH {LA} SELECT device, value FROM la WHERE metric = 'click' ORDER BY value DESC, seq LIMIT 1")
def _(spark, sf):
    return m.hottest_device(points(spark, sf), "click")


@query("latest_by_device", f"WITH {LA} SELECT device, value, ts FROM la WHERE metric = 'error'")
def _(spark, sf):
    return m.latest_by_device(points(spark, sf), "error")


@query("devices_over_limit", f"WITH {EP} SELECT DISTINCT device FROM ep WHERE state = 'firing' AND metric = 'click'")
def _(spark, sf):
    return m.devices_over_limit(episodes(spark, sf), "click")


@query("list_alerts", f"WITH {EP} SELECT * FROM ep WHERE state = 'recovered' ORDER BY raised_at DESC, device, metric LIMIT 50")
def _(spark, sf):
    return m.list_alerts(episodes(spark, sf), "recovered", 50)


@query("union_alarms", """WITH s AS (SELECT user_id::VARCHAR AS device, bool_or(event_type <> 'error') AS ok, round(max(value) FILTER (event_type = 'click'), 2) AS cpu, round(max(value) FILTER (event_type = 'view'), 2) AS mem FROM events GROUP BY 1)
 SELECT device, 'connection' AS type, NULL::DOUBLE AS value, 'high' AS severity FROM s WHERE NOT ok UNION ALL SELECT device, 'cpu', cpu, 'medium' FROM s WHERE ok AND cpu > 85 UNION ALL SELECT device, 'mem', mem, 'medium' FROM s WHERE ok AND mem > 90""")
def _(spark, sf):
    e = F.col("event_type")
    status = read(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("device")).agg(
        F.bool_or(e != "error").alias("ok"), F.round(F.max(F.when(e == "click", F.col("value"))), 2).alias("cpu"), F.round(F.max(F.when(e == "view", F.col("value"))), 2).alias("mem"))
    return m.union_alarms(status)


@query("alerts_to_tickets", f"WITH {EP}, {TK} SELECT device, metric, min(raised_at) AS opened_at, max(level) AS level, 'open' AS state FROM ep WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.device = ep.device AND tk.metric = ep.metric AND tk.state <> 'done') GROUP BY 1, 2")
def _(spark, sf):
    return t.alerts_to_tickets(episodes(spark, sf), old_tickets(spark, sf))


@query("ticket_autoclose", f"""WITH {EP}, {TK}, c AS (SELECT device, metric, max(recovered_at) AS done_at, count(*) FILTER (state = 'firing') AS firing FROM ep GROUP BY 1, 2)
 SELECT device, metric, opened_at, CASE WHEN state <> 'done' AND done_at IS NOT NULL AND firing = 0 THEN 'done' ELSE state END AS state, CASE WHEN state <> 'done' AND done_at IS NOT NULL AND firing = 0 THEN done_at END AS done_at FROM tk LEFT JOIN c USING (device, metric)""")
def _(spark, sf):
    return t.ticket_autoclose(old_tickets(spark, sf), episodes(spark, sf))


@query("list_tickets", f"WITH {PT}, {TK} SELECT device, metric, opened_at, state, CASE state WHEN 'open' THEN '待处理' ELSE '已解决' END AS state_name FROM tk")
def _(spark, sf):
    return t.list_tickets(old_tickets(spark, sf))


WANT = {"view": "diagnosed", "click": "resolved", "purchase": "verified", "signup": "closed", "error": "reopened"}


def ticket_log(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in WANT.items() for x in kv])
    return read(spark, sf, "events").select("user_id", "ts", "event_id", F.element_at(names, F.col("event_type")).alias("target"))


MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in t.STORE.items() for b in bs)
FSM = f"""mv(a, b) AS (VALUES {MOVES}), lg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
 CASE event_type WHEN 'view' THEN 'diagnosed' WHEN 'click' THEN 'resolved' WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'closed' ELSE 'reopened' END AS target FROM events),
 fs AS (SELECT DISTINCT user_id, 0::BIGINT AS step, 'open' AS state, 'open' AS prev, false AS moved FROM events UNION ALL
 SELECT lg.user_id, lg.step, CASE WHEN mv.b IS NOT NULL THEN lg.target ELSE fs.state END, fs.state, mv.b IS NOT NULL FROM fs JOIN lg ON lg.user_id = fs.user_id AND lg.step = fs.step + 1 LEFT JOIN mv ON mv.a = fs.state AND mv.b = lg.target)"""


@query("ticket_fsm", f"WITH RECURSIVE {FSM} SELECT user_id, max_by(state, step) AS state, count(*) FILTER (moved) AS accepted, count(*) FILTER (step > 0 AND NOT moved) AS rejected FROM fs GROUP BY 1")
def _(spark, sf):
    return t.ticket_fsm(ticket_log(spark, sf), ["user_id"], ["ts", "event_id"], "target")


@query("ticket_audit", f"WITH RECURSIVE {FSM} SELECT user_id, step, prev AS from_state, state AS to_state FROM fs WHERE moved")
def _(spark, sf):
    return t.ticket_audit(ticket_log(spark, sf), ["user_id"], ["ts", "event_id"], "target")


@query("triage_issue", """SELECT page_id, CASE WHEN regexp_matches(lower(html), 'deploy|部署|install|启动') THEN '部署类' WHEN regexp_matches(lower(html), 'data|数据|import|清洗') THEN '数据类'
 WHEN regexp_matches(lower(html), 'perf|性能|慢|latency') THEN '性能类' WHEN regexp_matches(lower(html), 'crash|崩溃|error|报错') THEN '故障类' ELSE '待分类' END AS triage FROM pages""")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", t.triage_issue(F.col("html")).alias("triage"))
