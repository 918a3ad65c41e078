"""Monitoring of many devices: points, alert rules, episodes and rule chains.

A point is (device, metric, value, ts, seq); seq breaks ties of ts. Rules are DataFrames keyed by (device, metric).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from millrace.session import durable, ship

KEYS = ["device", "metric"]
#: Added before rounding, so that halves that binary numbers can't hold exactly round up.
TIE = 1e-9


def _per(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def match_condition(value: Column, op: Column, threshold: Column, op2: Column | None = None, threshold2: Column | None = None) -> Column:
    """One-sided comparison, or between/outside (inclusive) where op2 is given; an unknown op is false."""
    ranged = F.lit(False) if op2 is None else op2.isNotNull()
    high = F.lit(None).cast("double") if threshold2 is None else threshold2
    inside = (value >= threshold) & (value <= high)
    return F.coalesce(
        F.when(op == ">", value > threshold).when(op == ">=", value >= threshold).when(op == "<", value < threshold)
        .when(op == "<=", value <= threshold).when(op == "==", value == threshold)
        .when((op == "between") & ranged, inside).when((op == "outside") & ranged, ~inside), F.lit(False))


def combine_conditions(combos: Column, current: Column) -> Column:
    """All of combos (metric, op, threshold, op2, threshold2) hold for the map of current values; a missing metric fails,
    none pass. A combo without op asks for more than its threshold, one without threshold for 0."""
    def holds(c: Column) -> Column:
        return match_condition(F.try_element_at(current, c["metric"]), F.coalesce(c["op"], F.lit(">")), F.coalesce(c["threshold"], F.lit(0.0)), c["op2"], c["threshold2"])

    return F.coalesce(F.forall(combos, holds), F.lit(True))


def last_rules(rules: DataFrame, order: str) -> DataFrame:
    """One rule for each device and metric: the last by `order`."""
    per = Window.partitionBy(*KEYS).orderBy(F.desc(order))
    return rules.withColumn("__rn", F.row_number().over(per)).where("__rn = 1").drop("__rn")


def active(rules: DataFrame) -> DataFrame:
    """The rules that are enabled, as all are without such a column."""
    return rules.where(F.coalesce("enabled", F.lit(True))) if "enabled" in rules.columns else rules


def holds(rules: DataFrame) -> Column:
    """Whether a point's value meets its rule's condition, for points joined with `rules`; op2 and threshold2 may be absent."""
    return match_condition(F.col("value"), F.col("op"), F.col("threshold"), *[F.col(c) for c in ("op2", "threshold2") if {"op2", "threshold2"} <= set(rules.columns)])


def rules_x_points(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Each point of an enabled rule's device and metric with `fired`. Spark broadcasts the rules where they are small.

    Rules are (device, metric, op, threshold), with op2 and threshold2 for between and outside, enabled, level, mutate_pct."""
    return points.join(active(rules), KEYS).withColumn("fired", holds(rules))


def judge(points: DataFrame, rules: DataFrame, minutes: int = 10) -> DataFrame:
    """`rules_x_points` with mutations: a point that meets no condition fires too if it is more than the rule's mutate_pct
    percent away from the median of the last minutes. type: threshold or mutate, null where nothing fires."""
    met = rules_x_points(points, rules).withColumn("type", F.when(F.col("fired"), "threshold"))
    if "mutate_pct" not in rules.columns:
        return met
    moved = F.coalesce((F.col("seen") >= 2) & (_change() > F.col("mutate_pct")), F.lit(False)) & ~F.col("fired")
    watched = with_medians(met.where("mutate_pct is not null"), minutes)
    watched = watched.withColumn("type", F.when(moved, "mutate").otherwise(F.col("type"))).withColumn("fired", F.col("type").isNotNull())
    return met.where("mutate_pct is null").unionByName(watched.drop("base", "seen"))


def minute_rollup(points: DataFrame, width: str = "1 minute") -> DataFrame:
    return points.groupBy(*KEYS, F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(
        F.round(F.avg("value") + TIE, 2).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count")
    ).select(*KEYS, F.col("w.start").alias("bucket"), "avg", "min", "max", "count")


def devices(points: DataFrame) -> DataFrame:
    return points.select("device").distinct()


def latest(points: DataFrame) -> DataFrame:
    """The last point of each device and metric, as one aggregate."""
    return points.groupBy(*KEYS).agg(F.max_by(F.struct("value", "ts", "seq"), F.struct("ts", "seq")).alias("x")).select(*KEYS, "x.value", "x.ts", "x.seq")


def series(points: DataFrame, device: str, metric: str) -> DataFrame:
    return points.where((F.col("device") == device) & (F.col("metric") == metric)).orderBy("ts", "seq")


def series_arrays(points: DataFrame) -> DataFrame:
    """The values of each device and metric in order of arrival."""
    rows = points.where(F.col("value").isNotNull()).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("x"))
    return rows.select(*KEYS, F.transform("x", lambda p: p["value"]).alias("values"))


def recent_window(points: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Points of the last minutes of event time up to `as_of`."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return points.where((F.col("ts") >= end - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col("ts") <= end))


#: Windows of up to this many values are sorted side by side; medians of larger ones slide over a sorted list.
SIDE_BY_SIDE = 64


def window_medians(key: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(median, number) of the values whose keys lie in each [low, high]; keys, lows and highs ascend."""
    first, last = np.searchsorted(key, low), np.searchsorted(key, high, "right")
    size = last - first
    out = np.full(len(low), np.nan)
    for n in np.unique(size[(size > 0) & (size <= SIDE_BY_SIDE)]):
        at = np.flatnonzero(size == n)
        out[at] = np.median(value[first[at][:, None] + np.arange(n)], axis=1)
    held: list[float] = []
    a = b = 0
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        if first[i] >= b:
            held, a, b = [], first[i], first[i]
        for x in value[b : last[i]].tolist():
            insort(held, x)
        for x in value[a : first[i]].tolist():
            del held[bisect_left(held, x)]
        a, b = first[i], last[i]
        half = len(held) // 2
        out[i] = held[half] if len(held) % 2 else (held[half - 1] + held[half]) / 2
    return out, size


def _sliding(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows in order of device, metric, piece and ts: those that are a piece's own, with base and seen."""
    def done(rows: pa.Table) -> pa.RecordBatch:
        columns = [pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in KEYS]
        piece, at = (rows[c].to_numpy() for c in ("piece", "at"))
        new = np.ones(len(rows), bool)
        new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (piece[1:] != piece[:-1])
        key = np.cumsum(new) * (3 * span) + (at - (piece - 1) * span)
        known = ~rows["number"].is_null().to_numpy()
        own = rows["own"].to_numpy()
        base, seen = window_medians(key[known], rows["number"].to_numpy()[known], key[own] - span, key[own])
        kept = rows.drop_columns(["piece", "at", "own", "number"]).filter(pa.array(own))
        kept = kept.append_column("base", pa.array(base, from_pandas=True)).append_column("seen", pa.array(seen.astype(np.int64)))
        return kept.combine_chunks().to_batches()[0] if len(kept) else pa.RecordBatch.from_pylist([], schema=kept.schema)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            same = np.ones(len(batch), bool)
            for c in (*KEYS, "piece"):
                column = batch.column(c)
                same &= pc.fill_null(pc.equal(column, column[-1]), False).to_numpy(zero_copy_only=False) if column[-1].is_valid else column.is_null().to_numpy(zero_copy_only=False)
            begin = len(batch) - int(same.sum())  # the last piece may go on in the next batch
            if begin == 0 and held and all(held[-1].column(c)[-1] == batch.column(c)[-1] for c in (*KEYS, "piece")):
                held.append(batch)
                continue
            whole = [*held, batch.slice(0, begin)]
            if sum(map(len, whole)):
                yield done(pa.Table.from_batches(whole))
            held = [batch.slice(begin)]
        if held:
            yield done(pa.Table.from_batches(held))

    return slide


def with_medians(points: DataFrame, minutes: int) -> DataFrame:
    """The points, all columns, with base (the median of the values of the last minutes, points of the same moment
    included) and seen (how many values that are; nulls don't count).

    A series is cut in pieces of the window's length, each with a copy of the piece before it, so that a task holds
    two windows of a series at most; the median slides over these. Dense windows cost the logarithm of their size a point."""
    ship(points.sparkSession)
    span = minutes * 60_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    piece = F.floor(at / F.lit(span)).cast("long")
    cut = points.select("*", at.alias("at"), F.col("value").cast("double").alias("number"), F.explode(F.array(F.struct(piece.alias("piece"), F.lit(True).alias("own")), F.struct((piece + 1).alias("piece"), F.lit(False).alias("own")))).alias("x"))
    cut = cut.select(*points.columns, "at", "number", "x.piece", "x.own")
    placed = cut.repartition(*KEYS, "piece").sortWithinPartitions(*KEYS, "piece", "at")
    schema = StructType([*points.schema.fields, StructField("base", DoubleType()), StructField("seen", LongType())])
    return placed.mapInArrow(_sliding(span), schema)


def _change() -> Column:
    """How far a value is from its base in percent; null for a base of 0."""
    return F.when(F.col("base") != 0, F.abs((F.col("value") - F.col("base")) / F.col("base")) * 100)


def mutation_detect(points: DataFrame, percent: float, minutes: int = 10) -> DataFrame:
    """Change against the median of the last minutes, the point included: base, change (percent), mutated.

    Windows of one point say nothing and are left out; a base of 0 never counts as mutated."""
    known = with_medians(points.select(*KEYS, "ts", "seq", "value"), minutes).where("seen >= 2")
    return known.select(*KEYS, "ts", "seq", "value", F.round(F.col("base") + TIE, 2).alias("base"), F.round(_change() + TIE, 1).alias("change"), F.coalesce(_change() > percent, F.lit(False)).alias("mutated"))


#: The stretch in which a long history is looked at; what it needs of the stretches before is carried over. Points of one
#: series and stretch meet in one task: a million at one a second.
STRETCH = "week"


def _day() -> Column:
    return F.date_trunc(STRETCH, F.col("ts"))


def alert_episodes(judged: DataFrame) -> DataFrame:
    """Alerts of points with `fired` and level, and type where they have it: from the first firing point to the first that
    doesn't fire.

    raised_at, value (the last while firing), n_points, recovered_at, type (of the first point) and state (recovered or
    firing). A history is looked at week by week: points become stretches that begin with a firing point, one aggregate
    on top of one window, and only what is known of whole weeks is looked at along a series."""
    if "type" not in judged.columns:
        judged = judged.withColumn("type", F.when(F.col("fired"), "threshold"))
    at, day = F.struct("ts", "seq"), [*KEYS, "day"]
    per = Window.partitionBy(*day).orderBy("ts", "seq")
    rows = judged.select(*KEYS, "ts", "seq", "value", "fired", "level", "type", _day().alias("day"))
    rows = rows.withColumn("start", (F.col("fired") & ~F.coalesce(F.lag("fired").over(per), F.lit(False))).cast("long"))
    rows = rows.withColumn("number", F.sum("start").over(per))
    own = lambda x: F.when(F.col("fired"), x)
    # Written, as both the days and the episodes are made of them.
    stretches = durable(rows.groupBy(*day, "number").agg(
        F.min(own(F.col("ts"))).alias("raised_at"), F.max(own(F.struct("ts", "seq", "value"))).alias("last"), F.count_if("fired").alias("n_points"),
        F.min_by(F.struct("type"), own(at)).alias("kind"), F.max(own(F.col("level"))).alias("level"), F.min(F.when(~F.col("fired"), F.col("ts"))).alias("calm_at"), F.min("ts").alias("begin")), "alert_stretches")
    # Of each day: whether it begins and ends firing, when it is first calm before any start, and how many stretches start.
    days = stretches.groupBy(*day).agg(
        F.min("number").alias("least"), F.max("number").alias("starts"), F.max_by(F.col("calm_at").isNull(), "number").alias("last"), F.min_by("begin", "number").alias("begin"))
    along = Window.partitionBy(*KEYS).orderBy("day")
    goes_on = F.coalesce(F.lag("last").over(along), F.lit(False)) & (F.col("least") == 1)
    days = days.select(*day, goes_on.cast("long").alias("goes_on"), (F.col("starts") - goes_on.cast("long")).alias("new"),
                       F.lead(F.struct((F.col("least") == 0).alias("calm"), "begin")).over(along).alias("ahead"))
    days = days.select(*day, "goes_on", "ahead", (F.sum("new").over(along) - F.col("new")).alias("earlier"))
    known = stretches.where("number > 0").join(days, day)
    calm = F.coalesce("calm_at", F.when(F.col("ahead.calm"), F.col("ahead.begin")))
    known = known.withColumns({"episode": F.col("earlier") + F.col("number") - F.col("goes_on"), "calm_at": calm})
    return known.groupBy(*KEYS, "episode").agg(
        F.min("raised_at").alias("raised_at"), F.max("last").alias("last"), F.sum("n_points").alias("n_points"), F.max("calm_at").alias("recovered_at"), F.max("level").alias("level"), F.min_by("kind", "raised_at").alias("kind"),
    ).select(*KEYS, "episode", "raised_at", "last.value", "n_points", "recovered_at", "level", F.col("kind.type").alias("type"), F.when(F.col("recovered_at").isNull(), "firing").otherwise("recovered").alias("state"))


def alert_events(judged: DataFrame) -> DataFrame:
    """The log of all alerts of points with `fired`, type and level: a row for each point that raises an alert (`raised`), finds
    it firing (`updated`) or ends it (`recovered`): device, metric, ts, seq, value, event, type, level, raised_at.

    As in `alert_episodes` a history is looked at week by week; what a week needs of those before is two small joins."""
    day = [*KEYS, "day"]
    per = Window.partitionBy(*day).orderBy("ts", "seq")
    along = Window.partitionBy(*KEYS).orderBy("day")
    rows = judged.withColumn("day", _day())
    ends = rows.groupBy(*day).agg(F.max_by("fired", F.struct("ts", "seq")).alias("last"))
    rows = rows.join(ends.select(*day, F.coalesce(F.lag("last").over(along), F.lit(False)).alias("carried")), day)
    rows = rows.withColumn("before", F.coalesce(F.lag("fired").over(per), F.col("carried"))).where(F.col("fired") | F.col("before"))
    event = F.when(~F.col("fired"), "recovered").when(F.col("before"), "updated").otherwise("raised")
    rows = rows.withColumn("event", event).withColumn("raised", F.when(F.col("event") == "raised", F.col("ts")))
    starts = rows.groupBy(*day).agg(F.max("raised").alias("raised"))
    starts = starts.select(*day, F.last("raised", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    raised_at = F.coalesce(F.last("raised", True).over(per), F.col("earlier"))
    return rows.join(starts, day).select(*KEYS, "ts", "seq", "value", "event", "type", "level", raised_at.alias("raised_at"))


def evaluate_latest(points: DataFrame, rules: DataFrame) -> DataFrame:
    return rules_x_points(latest(points), rules).where("fired")


def rule_chain(points: DataFrame, rules: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Fired actions of chained rules: (rule_id, device, metric, ts, seq, value, action).

    A rule has id, device (null: any), metric, op, threshold, combos (array of metric, op2, threshold, op),
    action and, if wanted, enabled. Combos are read left to right on the latest values at the point, joined by AND, or by OR where a
    condition's `op` says so. An `alert` fires once for each rule and device, other actions each time.
    `metrics` are the metrics that combos name. A device's history is looked at day by day, with the latest values of
    the days before carried over.
    """
    days = points.withColumn("day", _day())
    own = lambda m: F.when(F.col("metric") == m, F.col("value"))
    ends = days.groupBy("device", "day").agg(*[F.max_by(own(m), F.when(own(m).isNotNull(), F.struct("ts", "seq"))).alias(f"x{i}") for i, m in enumerate(metrics)])
    earlier = Window.partitionBy("device").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("device", "day", *[F.last(f"x{i}", True).over(earlier).alias(f"x{i}") for i in range(len(metrics))])
    per = Window.partitionBy("device", "day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    known = days.join(carried, ["device", "day"]).withColumn("latest", F.create_map(*[
        x for i, m in enumerate(metrics) for x in (F.lit(m), F.coalesce(F.last(own(m), True).over(per), F.col(f"x{i}")))]))
    wanted = active(rules).select(F.col("id").alias("rule_id"), F.col("device").alias("rule_device"), "metric", "op", "threshold", "combos", "action")
    met = known.join(wanted, "metric").where(F.col("rule_device").isNull() | (F.col("rule_device") == F.col("device")))

    def step(acc: Column, c: Column) -> Column:
        holds = match_condition(F.try_element_at(F.col("latest"), c["metric"]), F.coalesce(c["op2"], F.lit(">")), c["threshold"])
        return F.struct((F.when(acc["first"], holds).when(c["op"].eqNullSafe(F.lit("OR")), acc["ok"] | holds).otherwise(acc["ok"] & holds)).alias("ok"), F.lit(False).alias("first"))

    combined = F.aggregate("combos", F.struct(F.lit(True).alias("ok"), F.lit(True).alias("first")), step)["ok"]
    fired = met.where(match_condition(F.col("value"), F.coalesce("op", F.lit(">")), F.col("threshold")) & (F.coalesce(F.size("combos"), F.lit(0)).isin(0, -1) | combined))
    fired = fired.select("rule_id", "device", "metric", "ts", "seq", "value", "action")
    first = fired.where("action = 'alert'").groupBy("rule_id", "device", "action").agg(F.min_by(F.struct("metric", "ts", "seq", "value"), F.struct("ts", "seq")).alias("x"))
    return fired.where("action != 'alert'").unionByName(first.select("rule_id", "device", "x.*", "action"))


def worst_level(fired: DataFrame, by: Sequence[str]) -> DataFrame:
    """ok without fired rules, warn if all fired are warn, else critical."""
    n = F.count_if("fired")
    return fired.groupBy(*by).agg(F.when(n == 0, "ok").when(n == F.count_if(F.col("fired") & (F.col("level") == "warn")), "warn").otherwise("critical").alias("level"))


def monitor_snapshot(points: DataFrame, alerts: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row: series, devices, alerts by state, tickets by state."""
    parts = [
        latest(points).agg(F.count(F.lit(1)).alias("series"), F.count_distinct("device").alias("devices")),
        alerts.agg(F.count_if(F.col("state") == "firing").alias("firing"), F.count_if(F.col("state") == "recovered").alias("recovered")),
        tickets.agg(F.count_if(F.col("state") != "done").alias("open_tickets"), F.count_if(F.col("state") == "done").alias("done_tickets")),
    ]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # single rows


def hottest_device(points: DataFrame, metric: str) -> DataFrame:
    """The device with the highest latest value; of equal ones the one seen first in order of seq."""
    return latest(points.where(F.col("metric") == metric)).agg(F.max_by(F.struct("device", "value"), F.struct("value", -F.col("seq"))).alias("x")).select("x.device", "x.value")


def latest_by_device(points: DataFrame, metric: str) -> DataFrame:
    return latest(points.where(F.col("metric") == metric)).select("device", "value", "ts")


def devices_over_limit(alerts: DataFrame, metric: str | None = None) -> DataFrame:
    rows = alerts.where("state = 'firing'")
    return (rows if metric is None else rows.where(F.col("metric") == metric)).select("device").distinct()


def list_alerts(alerts: DataFrame, state: str | None, limit: int) -> DataFrame:
    rows = alerts if state is None else alerts.where(F.col("state") == state)
    return rows.orderBy(F.desc("raised_at"), "device", "metric").limit(limit)


def union_alarms(status: DataFrame, cpu: float = 85.0, mem: float = 90.0) -> DataFrame:
    """Connection alarms of devices that aren't ok, else cpu and memory alarms beyond their limits."""
    alarm = lambda kind, v, severity: F.struct(F.lit(kind).alias("type"), v.cast("double").alias("value"), F.lit(severity).alias("severity"))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    found = F.array(
        F.when(~ok, alarm("connection", F.lit(None), "high")), F.when(ok & (F.col("cpu") > cpu), alarm("cpu", F.col("cpu"), "medium")),
        F.when(ok & (F.col("mem") > mem), alarm("mem", F.col("mem"), "medium")))
    return status.select("device", F.explode(F.filter(found, lambda a: a.isNotNull())).alias("a")).select("device", "a.*")
