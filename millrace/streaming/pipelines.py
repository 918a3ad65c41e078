"""Structured Streaming forms of the monitoring operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from millrace.operators.monitor import KEYS, TIE, active, holds, window_medians
from millrace.session import ship
from millrace.sources.files import validate_points

ALERT = "device string, metric string, ts timestamp, seq long, value double, event string, type string, level string, raised_at timestamp"


def stream_rollup(points: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Averages of tumbling windows of event time; points later than the watermark are dropped."""
    timed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(*KEYS, F.window("ts", width).alias("w")).agg(
        F.round(F.avg("value") + TIE, 2).alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count")
    ).select(*KEYS, F.col("w.start").alias("bucket"), "avg", "min", "max", "count")


#: Keyed state with lists and timers needs this store of states.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Let streams started from here on keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


SERIES = [("device", pa.string()), ("metric", pa.string())]
POINTS = pa.schema([*SERIES, ("ts", pa.int64()), ("seq", pa.int64()), ("value", pa.float64()), ("fired", pa.bool_()), ("mutate_pct", pa.float64()), ("level", pa.string())])
WINDOW = pa.schema([*SERIES, ("ts", pa.int64()), ("value", pa.float64())])
#: Of each series: till when it is kept without points (milliseconds), whether it fires and since when (microseconds).
KNOWN = pa.schema([*SERIES, ("until", pa.int64()), ("firing", pa.bool_()), ("since", pa.int64())])
#: Rows of an element of a list state at most.
CHUNK = 10_000


def _pack(frame: pd.DataFrame, schema: pa.Schema) -> list[tuple[bytes]]:
    """Rows as elements of a list state, many in each: a state takes and gives its elements one by one."""
    out = []
    for batch in pa.Table.from_pandas(frame[schema.names], schema=schema, preserve_index=False).to_batches(max_chunksize=CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpack(state, schema: pa.Schema) -> pd.DataFrame:
    parts = [pa.ipc.open_stream(bytes(x[0])).read_all() for x in state.get()] if state.exists() else []
    return pa.concat_tables([schema.empty_table(), *parts]).to_pandas()


def _put(state, frame: pd.DataFrame, schema: pa.Schema) -> None:
    state.put(_pack(frame, schema)) if len(frame) else state.clear()


class AlertLifecycle(StatefulProcessor):
    """The alerts of a group of series (device, metric); rows that name none belong to the one that is the group's key.

    State: points that the watermark hasn't passed, since an earlier one may still come; (ts, value) of the last `span`
    microseconds of passed ones, for the median; of each series since when its alert is firing; the one timer set. Points are
    settled in order of (ts, seq) when the watermark passes them, so late, repeated and equal-time points give what the batch
    gives. Many series share a group, as each call for a group costs many times what the rows of a series do.
    """

    def __init__(self, span: int, expiry_ms: int):
        self.span, self.expiry_ms = span, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.window = handle.getListState("window", "rows binary")
        self.known = handle.getListState("known", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        stamps = new["ts"].astype("datetime64[us]").astype("int64")
        named = {} if "device" in new else {"device": key[0], "metric": key[1]}
        self.waiting.appendList(_pack(new.assign(ts=stamps, fired=new["fired"].eq(True), **named), POINTS))
        # The timer lies behind the least moment that waits, or far off if none does.
        at = int(stamps.min()) // 1000 + 1
        if not self.timer.exists() or at < self.timer.get()[0]:
            self._set(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now_ms = timerValues.getCurrentWatermarkInMs()
        now = now_ms * 1000
        self.timer.clear()
        rows, window = _unpack(self.waiting, POINTS), _unpack(self.window, WINDOW)
        known = {(d, m): (until, since if firing else None) for d, m, until, firing, since in _unpack(self.known, KNOWN).itertuples(index=False)}
        past, rest = rows[rows["ts"] < now].sort_values([*KEYS, "ts", "seq"], kind="stable"), rows[rows["ts"] >= now]
        if len(past):
            _put(self.waiting, rest, POINTS)
            found = self._settle(past, window, known, now_ms)
            if len(found):
                yield found
        alive = set(zip(rows["device"], rows["metric"]))
        gone = {k for k, (until, _) in known.items() if until <= now_ms and k not in alive}  # nothing came for long
        known = {k: x for k, x in known.items() if k not in gone}
        window = pd.concat([window, past[WINDOW.names]]) if len(past) else window
        window = window[window["value"].notna() & (window["ts"] >= now - self.span)]
        if gone:
            window = window[[k not in gone for k in zip(window["device"], window["metric"])]]
        _put(self.window, window, WINDOW)
        _put(self.known, pd.DataFrame([(*k, until, since is not None, since or 0) for k, (until, since) in known.items()], columns=KNOWN.names), KNOWN)
        next_ = [until for until, _ in known.values() if until > now_ms] + ([int(rest["ts"].min()) // 1000 + 1] if len(rest) else [])
        if next_:
            self._set(min(next_))

    def close(self) -> None:
        pass

    def _set(self, at: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _settle(self, past: pd.DataFrame, window: pd.DataFrame, known: dict, now_ms: int) -> pd.DataFrame:
        """Events of the points that the watermark has passed, in order of series, ts and seq; renews what is known of their series."""
        before = window.groupby(KEYS, sort=False).indices
        series = list(zip(past["device"], past["metric"]))
        starts = [i for i, k in enumerate(series) if i == 0 or k != series[i - 1]]
        ts, value, percent, met = (past[c].to_numpy(kind) for c, kind in (("ts", np.int64), ("value", float), ("mutate_pct", float), ("fired", bool)))
        old_ts, old_value = window["ts"].to_numpy(np.int64), window["value"].to_numpy(float)
        event, type_, raised, told = np.empty(len(past), object), np.empty(len(past), object), np.empty(len(past), np.int64), np.empty(len(past), bool)
        for a, b in zip(starts, [*starts[1:], len(past)]):
            at = before.get(series[a], np.empty(0, np.int64))
            since = known.get(series[a], (0, None))[1]
            event[a:b], type_[a:b], raised[a:b], told[a:b], since = self._judge(old_ts[at], old_value[at], ts[a:b], value[a:b], met[a:b], percent[a:b], since)
            known[series[a]] = (now_ms + self.expiry_ms, since)
        out = past.assign(ts=ts.astype("datetime64[us]"), event=event, type=type_, raised_at=raised.astype("datetime64[us]"))
        return out.loc[told, EVENT_COLUMNS]

    def _judge(self, old_ts: np.ndarray, old_value: np.ndarray, at: np.ndarray, own: np.ndarray, met: np.ndarray, percent: np.ndarray, since: int | None) -> tuple:
        """(event, type, raised_at, whether it is told) of the points of one series, and since when it fires at their end."""
        moved = np.zeros(len(at), bool)
        if not np.isnan(percent).all():
            ts, value = np.concatenate([old_ts, at]), np.concatenate([old_value, own])
            given = ~np.isnan(value)
            base, seen = window_medians(ts[given], value[given], at - self.span, at)
            with np.errstate(divide="ignore", invalid="ignore"):
                moved = (seen >= 2) & (base != 0) & (np.abs((own - base) / base) * 100 > percent)
        fired = met | moved
        was = np.append(since is not None, fired[:-1])
        event = np.where(~fired, "recovered", np.where(was, "updated", "raised"))
        # Alerts of one key follow each other, so the last one raised is the latest.
        raised = np.maximum.accumulate(np.where(fired & ~was, at, -1 if since is None else since))
        return event, np.where(met, "threshold", np.where(moved, "mutate", None)), raised, fired | was, int(raised[-1]) if fired[-1] else None


EVENT_COLUMNS = [c.split()[0] for c in ALERT.split(", ")]


def stream_alerts(points: DataFrame, rules: DataFrame, lateness: str = "10 minutes", expiry_hours: int = 168, minutes: int = 10, groups: int = 1024) -> DataFrame:
    """The event log of alerts as `alert_events` gives it, of a stream of points (device, metric, value, ts, seq).

    Points are joined with the static rules. A point is judged when the watermark has passed it: by its rule's condition
    or, with mutate_pct, by its distance from the median of the last minutes of event time. The state of a (device, metric)
    holds the points of the lateness and of these minutes and whether it fires; it is forgotten after `expiry_hours` of
    event time without points. Points later than the watermark are dropped. States are kept in RocksDB, by `groups` groups of
    devices and metrics, each with one timer: a checkpoint keeps their number.
    """
    ship(points.sparkSession)
    keep_state_in_rocksdb(points.sparkSession)
    timed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    percent = F.col("mutate_pct") if "mutate_pct" in rules.columns else F.lit(None)
    level = F.col("level") if "level" in rules.columns else F.lit(None)
    judged = timed.join(active(rules), KEYS).select(*KEYS, "value", "ts", F.col("seq").cast("long").alias("seq"), holds(rules).alias("fired"), percent.cast("double").alias("mutate_pct"), level.cast("string").alias("level"))
    return judged.withColumn("part", F.pmod(F.hash(*KEYS), F.lit(groups))).groupBy("part").transformWithStateInPandas(AlertLifecycle(minutes * 60_000_000, expiry_hours * 3_600_000), ALERT, "Append", "EventTime")


def stream_tickets(events: DataFrame, longest: str = "30 days", lateness: str = "10 minutes") -> DataFrame:
    """Tickets of a stream of alert events (as `stream_alerts` writes them): device, metric, opened_at, level, state, done_at.

    The stream of raised alerts meets that of recoveries in an outer join with event-time bounds: a ticket is `done` at the
    recovery, as soon as both are there, or `open` if the watermark passes `longest` after its opening without one. Both
    sides' state is bounded by `longest`. An alert has to recover before it can be raised again, so there is one ticket
    for each, and never two open ones for a device and metric."""
    timed = lambda event: events.where(F.col("event") == event).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    raised = timed("raised").select(*[F.col(c).alias(f"a_{c}") for c in KEYS], F.col("ts").alias("opened_at"), "level")
    closed = timed("recovered").select(*[F.col(c).alias(f"b_{c}") for c in KEYS], F.col("ts").alias("closed_at"), F.col("raised_at").cast("timestamp").alias("of"))
    # As numbers: rows whose key is itself an event time would be dropped when the watermark passes that, not the bound.
    same = (F.col("a_device") == F.col("b_device")) & (F.col("a_metric") == F.col("b_metric")) & (F.unix_micros("opened_at") == F.unix_micros("of"))
    bound = (F.col("closed_at") >= F.col("opened_at")) & (F.col("closed_at") <= F.col("opened_at") + F.expr(f"INTERVAL {longest}"))
    joined = raised.join(closed, same & bound, "left_outer")
    return joined.select(F.col("a_device").alias("device"), F.col("a_metric").alias("metric"), "opened_at", "level",
                         F.when(F.col("closed_at").isNull(), "open").otherwise("done").alias("state"), F.col("closed_at").alias("done_at"))


def stream_ingest(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], good: str, quarantine: str, checkpoint: str,
                  evaluate: Callable[[DataFrame, int], None] | None = None):
    """Parse and validate a stream of lines; valid points and the others are appended to two tables. Each batch is
    written under its number, so that a repeated batch replaces itself. `evaluate` gets the valid points of a batch and its
    number, for rules and tickets."""

    def write(batch: DataFrame, number: int) -> None:
        points = validate_points(parse(batch)).persist()
        valid = points.where("valid").drop("valid")
        valid.write.mode("overwrite").parquet(f"{good}/batch={number}")
        points.where("not valid").drop("valid").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        if evaluate is not None:
            evaluate(valid, number)
        points.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
