"""Streams give what the batch operators give."""

import datetime as dt
import os
from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import monitor
from millrace.sources import files
from millrace.streaming import pipelines

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(query_df, spark, name, mode, folder):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def points(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("user_id").cast("string").alias("device"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def test_rollup_equals_batch(spark, tmp_path):
    rows = points(spark)
    end = rows.agg(F.max("ts")).first()[0]
    late = spark.createDataFrame([("zz", "click", 1.0, -1)], "device string, metric string, value double, seq long").select("device", "metric", "value", F.lit(end).cast("timestamp").alias("ts") + F.expr("interval 9 days"), "seq")
    late = late.toDF("device", "metric", "value", "ts", "seq")
    got = run(pipelines.stream_rollup(stream_of(spark, rows.union(late).coalesce(1), tmp_path / "in"), "1 hour"), spark, "rollup", "append", tmp_path / "ck")
    want = monitor.minute_rollup(rows, "1 hour")
    assert {tuple(r) for r in got.where("device != 'zz'").collect()} == {tuple(r) for r in want.collect()}


SCHEMA = "device string, metric string, value double, ts timestamp, seq long"


def at(minute, second=0):
    return dt.datetime(2024, 3, 1) + dt.timedelta(minutes=minute, seconds=second)


def write_in_turn(spark, folder, files, schema=SCHEMA):
    """A file for each batch, in the order in which a stream takes them."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def tuples(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


EVENT = ("device", "metric", "ts", "seq", "value", "event", "type", "level", "raised_at")
#: Files of points: out of order within the lateness, repeated rows, points of one moment, nulls, and one that is too late.
FILES = [
    [("a", "t", 50.0, at(0), 1), ("a", "t", 51.0, at(2), 2), ("b", "t", 95.0, at(1), 3), ("c", "t", 1.0, at(0), 4)],
    [("a", "t", 99.0, at(6), 5), ("a", "t", 49.0, at(4), 6), ("a", "t", 49.0, at(4), 6), ("b", "t", None, at(3), 7), ("b", "t", 96.0, at(3), 8)],
    [("a", "t", 85.0, at(5), 9), ("a", "t", 20.0, at(6), 10), ("a", "t", 21.0, at(6), 11), ("b", "t", 10.0, at(9), 12),
     ("e", "t", 50.0, at(4), 21), ("e", "t", 50.0, at(5), 22), ("e", "t", 10.0, at(8), 23), ("e", "t", 50.0, at(9), 24)],
    [("a", "t", 50.0, at(20), 13), ("a", "t", 90.0, at(40), 14), ("d", "t", 500.0, at(41), 15)],
    [("a", "t", 99.0, at(33), 16), ("a", "t", 51.0, at(45), 17)],
    [("a", "t", 99.0, at(25), 20), ("a", "t", 200.0, at(46), 18), ("zz", "t", 1.0, at(600), 19)],  # the first is behind the watermark
]
RULES = [("e", "t", ">", 80.0, None, None, True, 50.0, "info"), ("a", "t", ">", 80.0, None, None, True, 50.0, "warn"), ("b", "t", "between", 90.0, "and", 99.0, None, None, "critical"), ("d", "t", ">", 1.0, None, None, False, 1.0, "warn")]
RULE = "device string, metric string, op string, threshold double, op2 string, threshold2 double, enabled boolean, mutate_pct double, level string"


def test_alert_stream_equals_batch_with_late_repeated_and_equal_points(spark, tmp_path):
    rules = spark.createDataFrame(RULES, RULE)
    stream = write_in_turn(spark, tmp_path / "in", FILES)
    got = run(pipelines.stream_alerts(stream, rules), spark, "alerts", "append", tmp_path / "ck")
    rows = spark.createDataFrame([r for f in FILES for r in f if r[4] != 20], SCHEMA)
    wanted = monitor.alert_events(monitor.judge(rows, rules))
    assert tuples(got, *EVENT) == tuples(wanted, *EVENT)
    kinds = {(r["event"], r["type"]) for r in wanted.collect()}
    assert kinds == {("raised", "threshold"), ("raised", "mutate"), ("updated", "threshold"), ("updated", "mutate"), ("recovered", None)}
    assert {r["device"] for r in wanted.collect()} == {"a", "b", "e"}


def test_alert_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rules = spark.createDataFrame(RULES, RULE)
    schema, out = SCHEMA, str(tmp_path / "out")
    for i in range(len(FILES)):
        stream = write_in_turn(spark, tmp_path / f"new{i}", [FILES[i]])
        os.makedirs(tmp_path / "in", exist_ok=True)
        for f in (tmp_path / f"new{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = pipelines.stream_alerts(stream, rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = spark.createDataFrame([r for f in FILES for r in f if r[4] != 20], SCHEMA)
    assert tuples(spark.read.parquet(out), *EVENT) == tuples(monitor.alert_events(monitor.judge(rows, rules)), *EVENT)


def test_alert_state_holds_the_window_only():
    """Thousands of points pass; the state keeps those of the lateness and the window, and nothing after the expiry."""
    lists, values, timers = {}, {}, []

    class Value:
        def __init__(self, name): self.name = name
        def exists(self): return self.name in values
        def get(self): return values[self.name]
        def update(self, x): values[self.name] = x
        def clear(self): values.pop(self.name, None)

    class Rows(Value):
        def exists(self): return bool(lists.get(self.name))
        def get(self): return iter(lists.get(self.name, []))
        def put(self, x): lists[self.name] = list(x)
        def appendList(self, x): lists.setdefault(self.name, []).extend(x)  # noqa: N802
        def clear(self): lists.pop(self.name, None)

    handle = SimpleNamespace(getListState=lambda n, _: Rows(n), getValueState=lambda n, _: Value(n), registerTimer=timers.append, deleteTimer=timers.remove)
    alert = pipelines.AlertLifecycle(600 * 10**6, 3_600_000)
    alert.init(handle)
    most, events = 0, 0
    for minute in range(3000):
        rows = pd.DataFrame({"ts": [at(minute)], "seq": [minute], "value": [float(minute % 100)], "fired": [minute % 50 > 40], "mutate_pct": [None], "level": ["warn"]})
        list(alert.handleInputRows(("d", "m"), iter([rows]), None))
        now = int((at(minute - 10) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        if timers and timers[0] <= now:
            timers.pop()
            events += sum(map(len, alert.handleExpiredTimer(("d", "m"), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None)))
        most = max(most, len(lists.get("waiting", [])) + len(lists.get("window", [])))
    assert most <= 25 and events > 500 and len(timers) == 1
    for _ in range(2):  # all points are settled, then the key is forgotten
        now = timers.pop() + 600_000
        list(alert.handleExpiredTimer(("d", "m"), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None))
    assert not timers and not any(lists.values()) and not values


def test_a_group_of_series_takes_few_state_calls_and_keeps_them_apart():
    """500 series in one group: each has its own alert, all together take a few calls of the state, and one is forgotten alone."""
    held, timers, calls = {}, [], []

    class State:
        def __init__(self, name): self.name = name
        def exists(self): calls.append(1); return bool(held.get(self.name))
        def get(self): calls.append(1); return held[self.name] if self.name == "timer" else iter(held[self.name])
        def put(self, x): calls.append(1); held[self.name] = list(x)
        update = put
        def appendList(self, x): calls.append(1); held.setdefault(self.name, []).extend(x)  # noqa: N802
        def clear(self): calls.append(1); held.pop(self.name, None)

    handle = SimpleNamespace(getListState=lambda n, _: State(n), getValueState=lambda n, _: State(n), registerTimer=timers.append, deleteTimer=timers.remove)
    alert = pipelines.AlertLifecycle(600 * 10**6, 3_600_000)
    alert.init(handle)

    def points(minute, devices, fired):
        return pd.DataFrame([(f"d{i}", "m", at(minute), i, float(i), fired(i), None, "warn") for i in devices], columns=["device", "metric", "ts", "seq", "value", "fired", "mutate_pct", "level"])

    def pass_by(minute):
        now = int((at(minute) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
        timers.pop()
        return pd.concat([pd.DataFrame(columns=["device", "event"]), *alert.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None)])

    list(alert.handleInputRows((0,), iter([points(0, range(500), lambda i: i % 2 == 0)]), None))
    first = pass_by(1)
    assert Counter(first["event"]) == {"raised": 250} and len(calls) < 40
    list(alert.handleInputRows((0,), iter([points(30, range(499), lambda i: False)]), None))
    second = pass_by(31)
    assert Counter(second["event"]) == {"recovered": 250} and set(second["device"]) == set(first["device"])
    assert len(timers) == 1 and len(pass_by(62)) == 0  # the last series is forgotten an hour after it was settled
    assert len(pipelines._unpack(alert.known, pipelines.KNOWN)) == 499 and len(timers) == 1


def test_ticket_stream_equals_batch_over_a_restart(spark, tmp_path):
    """Tickets close at the recovery, or are reported open after the longest time; the second run goes on where the first ended."""
    schema = "device string, metric string, ts timestamp, event string, level string, raised_at timestamp"
    row = lambda d, m, event, of: (d, "t", at(m), event, "warn" if event == "raised" else None, at(of))
    files = [
        [row("a", 0, "raised", 0), row("a", 1, "updated", 0), row("b", 3, "raised", 3), row("a", 5, "recovered", 0)],
        [row("a", 30, "raised", 30), row("b", 200, "recovered", 3), row("c", 40, "recovered", 39), row("c", 39, "raised", 39)],
        [row("d", 100, "raised", 100), row("a", 300, "recovered", 299), row("a", 299, "raised", 299), row("zz", 900, "raised", 900), row("zz", 901, "recovered", 900)],
    ]
    got = Counter()
    for i in range(2):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for j in range(2 * i, min(2 * i + 2, 3)):
            write_in_turn(spark, tmp_path / f"f{j}", [files[j]], schema)
            for f in (tmp_path / f"f{j}").glob("*.parquet"):
                f.rename(folder / f"{j}-{f.name}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = pipelines.stream_tickets(stream, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = tuples(spark.read.parquet(str(tmp_path / "out")), "device", "opened_at", "level", "state", "done_at")
    # b recovers too late to count, a's second alert and d never do.
    assert got == Counter({("a", at(0), "warn", "done", at(5)): 1, ("b", at(3), "warn", "open", None): 1, ("a", at(30), "warn", "open", None): 1, ("c", at(39), "warn", "done", at(40)): 1,
                           ("d", at(100), "warn", "open", None): 1, ("a", at(299), "warn", "done", at(300)): 1, ("zz", at(900), "warn", "done", at(901)): 1})


def test_ingest_splits_and_repeats_safely(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("device=a metric=m value=1\ndevice=a metric=m value=x\ndevice=b metric=m value=2\n")
    lines = spark.readStream.text(str(tmp_path / "in"))
    q = pipelines.stream_ingest(lines, files.parse_points_kv, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,x\n2,y\n")
    got = run(files.read_csv_stream(spark, str(tmp_path / "in"), ["id", "v"]), spark, "csvs", "append", tmp_path / "ck")
    assert got.count() == 2
