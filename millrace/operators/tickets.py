"""Tickets: triage, severity, state machines over event logs, and their link to alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The three state machines: allowed moves from each state. Fixed values.
SIMPLE = {"open": ("in_progress", "done"), "in_progress": ("done",), "done": ()}
ISSUE = {
    "open": ("in_progress", "diagnosed", "closed", "cancelled"),
    "in_progress": ("diagnosed", "resolved", "closed", "cancelled"),
    "diagnosed": ("in_progress", "resolved", "closed", "cancelled"),
    "resolved": ("closed",),
    "closed": (),
    "cancelled": (),
}
STORE = {
    "open": ("diagnosed", "resolved", "cancelled"),
    "diagnosed": ("resolved", "cancelled"),
    "resolved": ("verified", "closed", "reopened"),
    "verified": ("closed",),
    "reopened": ("diagnosed",),
}
#: Keywords of each triage class, the first match wins. Fixed values.
TRIAGE = (
    ("部署类", ("deploy", "部署", "install", "启动")),
    ("数据类", ("data", "数据", "import", "清洗")),
    ("性能类", ("perf", "性能", "慢", "latency")),
    ("故障类", ("crash", "崩溃", "error", "报错")),
)


def triage_issue(problem: Column) -> Column:
    low, out = F.lower(F.coalesce(problem, F.lit(""))), F.lit("待分类")
    for name, words in reversed(TRIAGE):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def ticket_severity(alerts: DataFrame, by: Sequence[str]) -> DataFrame:
    """critical beats warn or high (high), all else is medium."""
    rank = F.max(F.when(F.col("level") == "critical", 2).when(F.col("level").isin("warn", "high"), 1).otherwise(0))
    return alerts.groupBy(*by).agg(F.when(rank == 2, "critical").when(rank == 1, "high").otherwise("medium").alias("severity"))


def _allowed(state: Column, target: Column, machine: Mapping[str, Sequence[str]]) -> Column:
    ok = F.lit(False)
    for at, to in machine.items():
        if to:
            ok = ok | ((state == at) & target.isin(*to))
    return F.coalesce(ok, F.lit(False))


def _fold(log: DataFrame, by: Sequence[str], order: Sequence[str], target: str, machine: Mapping[str, Sequence[str]], start: str) -> DataFrame:
    steps = log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(target).alias("target")))).alias("steps"))
    trail = "array<struct<step:int,from:string,to:string>>"
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).alias("step"), F.lit(0).alias("rejected"), F.array().cast(trail).alias("audit"))

    def move(acc: Column, s: Column) -> Column:
        ok = _allowed(acc["state"], s["target"], machine)
        entry = F.array(F.struct((acc["step"] + 1).alias("step"), acc["state"].alias("from"), s["target"].alias("to")))
        return F.struct(
            F.when(ok, s["target"]).otherwise(acc["state"]).alias("state"), (acc["step"] + 1).alias("step"),
            (acc["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"), F.when(ok, F.concat(acc["audit"], entry)).otherwise(acc["audit"]).alias("audit"))

    return steps.select(*by, F.aggregate("steps", zero, move).alias("x"))


def ticket_fsm(log: DataFrame, by: Sequence[str], order: Sequence[str], target: str, machine: Mapping[str, Sequence[str]] = STORE, start: str = "open") -> DataFrame:
    """The state of each ticket after its ordered log of wanted states; moves that aren't allowed are rejected."""
    x = _fold(log, by, order, target, machine, start)
    return x.select(*by, F.col("x.state").alias("state"), F.size("x.audit").cast("long").alias("accepted"), F.col("x.rejected").cast("long").alias("rejected"))


def ticket_audit(log: DataFrame, by: Sequence[str], order: Sequence[str], target: str, machine: Mapping[str, Sequence[str]] = STORE, start: str = "open") -> DataFrame:
    """The accepted moves in order: step (place in the log), from_state, to_state."""
    x = _fold(log, by, order, target, machine, start).select(*by, F.explode("x.audit").alias("a"))
    return x.select(*by, F.col("a.step").cast("long").alias("step"), F.col("a.from").alias("from_state"), F.col("a.to").alias("to_state"))


def alerts_to_tickets(alerts: DataFrame, tickets: DataFrame) -> DataFrame:
    """New tickets: one for each device and metric with an alert and no ticket that isn't done."""
    open_ = tickets.where("state != 'done'").select("device", "metric")
    new = alerts.join(open_, ["device", "metric"], "left_anti")
    return new.groupBy("device", "metric").agg(F.min("raised_at").alias("opened_at"), F.max("level").alias("level")).withColumn("state", F.lit("open"))


def ticket_autoclose(tickets: DataFrame, episodes: DataFrame) -> DataFrame:
    """Open tickets whose device and metric recovered become done at the last recovery; the others stay."""
    closed = episodes.groupBy("device", "metric").agg(F.max("recovered_at").alias("done_at"), F.count_if(F.col("state") == "firing").alias("firing"))
    joined = tickets.join(closed, ["device", "metric"], "left")
    done = (F.col("state") != "done") & F.col("done_at").isNotNull() & (F.col("firing") == 0)
    return joined.select("device", "metric", "opened_at", F.when(done, "done").otherwise(F.col("state")).alias("state"), F.when(done, F.col("done_at")).alias("done_at"))


def list_tickets(tickets: DataFrame, state: str | None = None) -> DataFrame:
    """Newest first, with the display name of the state."""
    names = {"open": "待处理", "in_progress": "处理中", "diagnosed": "处理中", "resolved": "已解决", "closed": "已关闭", "cancelled": "已取消", "done": "已解决"}
    rows = tickets if state is None else tickets.where(F.col("state") == state)
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn("state_name", F.coalesce(F.try_element_at(mapping, F.col("state")), F.col("state"))).orderBy(F.desc("opened_at"), "device", "metric")
