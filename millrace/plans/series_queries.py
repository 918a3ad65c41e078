"""Series statistics and process control over the event series (series = event_type, order = ts, event_id)."""

from __future__ import annotations

from millrace.operators import series as s
from millrace.plans.tables import BY, ORDER, day, events

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return put


def placed(spark, sf_dir):
    return s.position(events(spark, sf_dir), BY, ORDER, "value", day())


E = "e AS (SELECT event_type, value::DOUBLE AS v, ts, event_id FROM events WHERE value IS NOT NULL AND isfinite(value))"
P = f"{E}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM e)"
MAD = f"""{E}, c0 AS (SELECT event_type, quantile_disc(v, 0.5 ORDER BY v DESC) AS center, quantile_cont(v, 0.5) AS median, avg(v) AS mean, count(*) AS n FROM e GROUP BY 1),
 m AS (SELECT event_type, center, median, mean, n, quantile_disc(abs(v - center), 0.5 ORDER BY abs(v - center) DESC) AS mad FROM e JOIN c0 USING (event_type) GROUP BY ALL)"""
MAD = MAD.replace("quantile_disc(v, 0.5 ORDER BY v DESC)", "percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)").replace(
    "quantile_disc(abs(v - center), 0.5 ORDER BY abs(v - center) DESC)", "percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(v - center) DESC)")
REG = f"""{P}, g AS (SELECT event_type, count(*) AS n, coalesce(regr_slope(v, pos), 0) AS s, coalesce(regr_intercept(v, pos), avg(v)) AS i, corr(v, pos) AS c, stddev_pop(v) AS sd, max_by(v, pos) AS last FROM p GROUP BY 1),
 reg AS (SELECT event_type, n, last, CASE WHEN n < 2 THEN 0 ELSE round(s, 4) END AS slope, CASE WHEN n < 2 THEN 0 ELSE round(i, 4) END AS intercept,
   CASE WHEN n < 2 OR sd = 0 OR c IS NULL OR isnan(c) THEN 0 ELSE round(c, 4) END AS r, CASE WHEN n < 2 THEN 'insufficient' WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' ELSE 'flat' END AS direction FROM g)"""


@query("quantile", f"WITH {E} SELECT event_type, round(round(quantile_cont(v, 0.9), 9), 3) AS quantile FROM e GROUP BY 1")
def _(spark, sf):
    return s.quantile(events(spark, sf), BY, "value", 0.9)


#: Rows of a series up to which selection sorts them as they are: few, so that the given tables take several rounds.
KEEP = 500


@query("quantile_giant", f"WITH {E} SELECT event_type, round(round(quantile_cont(v, 0.9), 9), 3) AS quantile FROM e GROUP BY 1")
def _(spark, sf):
    return s.quantile(events(spark, sf), BY, "value", 0.9, giant=True, keep=KEEP)


DESCRIBE = """count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 3) AS mean, round(round(quantile_cont(v, 0.5), 9), 3) AS median,
 round(stddev_pop(v), 3) AS std, round(round(quantile_cont(v, 0.25), 9), 3) AS p25, round(round(quantile_cont(v, 0.75), 9), 3) AS p75"""


@query("describe", f"WITH {E} SELECT event_type, {DESCRIBE} FROM e GROUP BY 1")
def _(spark, sf):
    return s.describe(events(spark, sf), BY, "value")


@query("series_stats", f"WITH {MAD} SELECT event_type, {DESCRIBE}, round(any_value(m.mad), 3) AS mad FROM e JOIN m USING (event_type) GROUP BY 1")
def _(spark, sf):
    return s.series_stats(events(spark, sf), BY, "value")


@query("series_stats_giant", ORACLES["series_stats"])
def _(spark, sf):
    return s.series_stats(events(spark, sf), BY, "value", giant=True, keep=KEEP)


@query("mad", f"WITH {MAD} SELECT event_type, round(center, 6) AS center, round(mad, 6) AS mad FROM m")
def _(spark, sf):
    from pyspark.sql import functions as F
    return s.mad(events(spark, sf), BY, "value").select("event_type", F.round("center", 6).alias("center"), F.round("mad", 6).alias("mad"))


@query("cpk", f"""WITH {E}, g AS (SELECT event_type, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1e-9 ELSE stddev_pop(v) END AS sd FROM e GROUP BY 1 HAVING count(*) >= 4),
 k AS (SELECT event_type, round(400.0 / (6 * sd), 3) AS cp, round((300 - m) / (3 * sd), 3) AS cpu, round((m + 100) / (3 * sd), 3) AS cpl, round(sd, 3) AS sigma, round(m, 3) AS mean FROM g)
 SELECT event_type, cp, least(cpu, cpl) AS cpk, cpu, cpl, sigma, mean, CASE WHEN least(cpu, cpl) < 1 THEN '能力不足' WHEN least(cpu, cpl) < 1.33 THEN '能力尚可' ELSE '能力充分' END AS judge FROM k""")
def _(spark, sf):
    return s.cpk(events(spark, sf), BY, "value", 300.0, -100.0)


@query("trend", f"""WITH {P}, g AS (SELECT event_type, count(*) AS n, coalesce(regr_slope(v, pos), 0) AS s, avg(v) AS mean FROM p GROUP BY 1)
 SELECT event_type, CASE WHEN n < 2 THEN 0 ELSE round(s, 4) END AS slope, CASE WHEN n < 2 THEN 'insufficient' WHEN s > 0.01 * (CASE WHEN mean = 0 THEN 1 ELSE mean END) THEN 'rising'
 WHEN s < -0.01 * (CASE WHEN mean = 0 THEN 1 ELSE mean END) THEN 'falling' ELSE 'flat' END AS direction FROM g""")
def _(spark, sf):
    return s.trend(placed(spark, sf), BY)


@query("linear_regression", f"WITH {REG} SELECT event_type, slope, intercept, r, direction FROM reg")
def _(spark, sf):
    return s.linear_regression(placed(spark, sf), BY).drop("n", "last")


@query("moving_average", f"""WITH {P}, a AS (SELECT *, avg(v) OVER (PARTITION BY event_type ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY event_type) AS n FROM p)
 SELECT event_type, pos, v, CASE WHEN n < 5 THEN v ELSE round(a, 3) END AS smooth FROM a""")
def _(spark, sf):
    return s.moving_average(placed(spark, sf), BY, 5)


@query("forecast_next", f"""WITH {REG}, f AS (SELECT event_type, reg.n, slope, intercept, r, direction, sqrt(avg((v - (slope * pos + intercept)) ** 2)) AS rmse FROM p JOIN reg USING (event_type) WHERE n >= 2 GROUP BY ALL)
 SELECT event_type, slope, intercept, r, direction, round(slope * n + intercept, 3) AS next, round(slope * n + intercept + 2 * rmse, 3) AS upper, round(slope * n + intercept - 2 * rmse, 3) AS lower FROM f""")
def _(spark, sf):
    return s.forecast_next(placed(spark, sf), BY)


HEALTH = "round(greatest(0, least(1, 1 - abs(last) / 500)), 3)"


@query("rul", f"""WITH {REG} SELECT event_type, slope, last, CASE WHEN abs(slope) >= 1e-9 AND (slope > 0) = (500 > last) THEN round(greatest(0, (500 - last) / slope), 1) END AS rul, {HEALTH} AS health FROM reg WHERE n >= 2""")
def _(spark, sf):
    return s.rul(placed(spark, sf), BY, 500.0)


@query("health_index", f"WITH {REG} SELECT event_type, last, {HEALTH} AS health FROM reg")
def _(spark, sf):
    from pyspark.sql import functions as F
    return s.linear_regression(placed(spark, sf), BY).select("event_type", "last", s.health_index(F.col("last"), F.lit(500.0)).alias("health"))


@query("risk_level", f"""WITH {MAD}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM e),
 l AS (SELECT event_type, max(v) FILTER (back = 1) AS v1, max(v) FILTER (back = 2) AS v2, max(v) FILTER (back = 3) AS v3 FROM p GROUP BY 1),
 d AS (SELECT event_type, n, v1 > v2 AND v2 > v3 AS rising, v1 > center AS above, CASE WHEN mad < 1e-9 THEN greatest(abs(mean) * 0.05, 1e-9) ELSE mad END AS scale, abs(v1 - center) AS off, mean FROM m JOIN l USING (event_type)),
 k AS (SELECT *, off / scale AS dev, scale / (abs(mean) + 1e-9) AS vol FROM d)
 SELECT event_type, round(dev, 3) AS deviation, round(vol, 3) AS volatility, CASE WHEN n < 2 THEN 'low' WHEN dev > 3 AND coalesce(rising, false) AND above THEN 'critical'
  WHEN dev > 2.5 OR (coalesce(rising, false) AND above AND dev > 1.5) OR vol > 0.5 THEN 'high' WHEN dev > 1.5 OR vol > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM k""")
def _(spark, sf):
    return s.risk_level(placed(spark, sf), BY)


@query("adaptive_threshold", f"""WITH {MAD}, w AS (SELECT *, CASE WHEN mad = 0 THEN CASE WHEN median = 0 THEN 1 ELSE median * 0.1 END ELSE mad END AS width FROM m WHERE n >= 3)
 SELECT event_type, round(median, 3) AS center, round(median + 3 * width, 3) AS upper, round(median - 3 * width, 3) AS lower, round(width, 3) AS mad FROM w""")
def _(spark, sf):
    return s.adaptive_threshold(events(spark, sf), BY, "value")


@query("anomaly_zscore", f"""WITH {P}, g AS (SELECT event_type, avg(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd FROM e GROUP BY 1 HAVING count(*) >= 4)
 SELECT event_type, pos, round(v, 3) AS value, round((v - mean) / sd, 2) AS zscore FROM p JOIN g USING (event_type) WHERE abs(v - mean) > 3 * sd""")
def _(spark, sf):
    return s.anomaly_zscore(placed(spark, sf), BY)


@query("anomaly_iqr", f"""WITH {P}, g AS (SELECT event_type, round(round(quantile_cont(v, 0.25), 9), 3) AS q1, round(round(quantile_cont(v, 0.75), 9), 3) AS q3 FROM e GROUP BY 1 HAVING count(*) >= 4)
 SELECT event_type, pos, round(v, 3) AS value FROM p JOIN g USING (event_type) WHERE NOT (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""")
def _(spark, sf):
    return s.anomaly_iqr(placed(spark, sf), BY)


@query("anomaly_mad", f"""WITH {MAD}, p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM e), w AS (SELECT *, CASE WHEN mad = 0 THEN 1 ELSE mad END AS width FROM m WHERE n >= 4)
 SELECT event_type, pos, round(v, 3) AS value, round((v - median) / width, 2) AS zscore FROM p JOIN w USING (event_type) WHERE abs(v - median) > 3 * width""")
def _(spark, sf):
    return s.anomaly_mad(placed(spark, sf), BY)


RUN = """sg AS (SELECT event_type, pos, sign(v - avg(v) OVER (PARTITION BY event_type)) AS sg FROM p),
 rn AS (SELECT event_type, pos, min(sg) OVER w AS lo, max(sg) OVER w AS hi, count(*) OVER w AS n FROM sg WINDOW w AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
 run AS (SELECT event_type, min(pos) AS run_start, min_by(CASE WHEN lo > 0 THEN 'above' ELSE 'below' END, pos) AS side FROM rn WHERE n = 7 AND lo = hi AND lo <> 0 GROUP BY 1)"""
TREND = """st AS (SELECT event_type, pos, sign(lead(v) OVER (PARTITION BY event_type ORDER BY pos) - v) AS st FROM p),
 tn AS (SELECT event_type, pos, min(st) OVER w AS lo, max(st) OVER w AS hi, count(st) OVER w AS n FROM st WINDOW w AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
 tr AS (SELECT event_type, min(pos) AS trend_start, min_by(CASE WHEN lo > 0 THEN 'rising' ELSE 'falling' END, pos) AS trend_direction FROM tn WHERE n = 5 AND lo = hi AND lo <> 0 GROUP BY 1)"""


@query("spc_run_rule", f"WITH {P}, {RUN} SELECT * FROM run")
def _(spark, sf):
    return s.spc_run_rule(placed(spark, sf), BY)


@query("spc_trend_rule", f"WITH {P}, {TREND} SELECT * FROM tr")
def _(spark, sf):
    return s.spc_trend_rule(placed(spark, sf), BY)


@query("control_chart", f"""WITH {P}, {RUN}, {TREND}, g AS (SELECT event_type, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM e GROUP BY 1 HAVING count(*) >= 2),
 o AS (SELECT event_type, g.n, m, sd, count(*) FILTER (v > m + 3 * sd OR v < m - 3 * sd) AS n_outside FROM p JOIN g USING (event_type) GROUP BY ALL)
 SELECT event_type, n, round(m, 3) AS mean, round(sd, 3) AS std, round(m + 3 * sd, 3) AS ucl, round(m - 3 * sd, 3) AS lcl, n_outside, run_start, side, trend_start, trend_direction,
  CASE WHEN n_outside > 0 OR run_start IS NOT NULL OR trend_start IS NOT NULL THEN '失控' ELSE '受控' END AS judge FROM o LEFT JOIN run USING (event_type) LEFT JOIN tr USING (event_type)""")
def _(spark, sf):
    return s.control_chart(placed(spark, sf), BY)
