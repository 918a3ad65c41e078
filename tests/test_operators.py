"""Operators on small hand-made tables."""

import datetime as dt
import math
import random
import statistics
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import typed
from millrace.operators import clean, decisions, drafts, monitor, ontology, profile, retrieval, selection, series, survey, textqa, tickets
from millrace.plans import text_queries
from millrace.sources import files
from tests.oracle import connect, differences


def one_series(spark, values, name="a"):
    df = spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "s string, t long, value double")
    return df, series.position(df, ["s"], ["t"], "value")


def upper(xs):
    return sorted(xs)[len(xs) // 2]


SERIES = [[45.2, 45.5, 45.1, 45.3, 45.4, 45.2, 58.9, 45.3], [5.0, 5.1, 5.0, 5.2, 5.1, 8.6], [5.0] * 6, list(range(5, 17)), [-3, -1, -2, -8, 0, 4], [1, 2], [7]]


@pytest.mark.parametrize("values", SERIES)
def test_series_against_plain_formulas(spark, values):
    df, placed = one_series(spark, values)
    n, mean = len(values), sum(values) / len(values)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
    got = series.mad(df, ["s"], "value").first()
    assert got["mad"] == pytest.approx(upper([abs(v - upper(values)) for v in values]))
    d = series.describe(df, ["s"], "value").first()
    assert d["std"] == pytest.approx(sd, abs=6e-4) and d["count"] == n
    line = series.linear_regression(placed, ["s"]).first()
    if n >= 2:
        xm = (n - 1) / 2
        slope = sum((i - xm) * (v - mean) for i, v in enumerate(values)) / sum((i - xm) ** 2 for i in range(n))
        assert line["slope"] == pytest.approx(slope, abs=6e-5)
    else:
        assert line["direction"] == "insufficient"
    z = {r["pos"] for r in series.anomaly_zscore(placed, ["s"], 2.0).collect()}
    assert z == ({i for i, v in enumerate(values) if abs(v - mean) > 2 * (sd or 1)} if n >= 4 else set())


def test_known_series(spark):
    _, hot = one_series(spark, SERIES[0])
    assert [r["value"] for r in series.anomaly_iqr(hot, ["s"]).collect()] == [58.9]
    chart = series.control_chart(hot, ["s"]).first()
    assert chart["ucl"] > chart["lcl"] and chart["n"] == 8
    _, jump = one_series(spark, SERIES[1])
    assert series.anomaly_mad(jump, ["s"]).count() > 0
    _, flat = one_series(spark, SERIES[2])
    assert series.anomaly_mad(flat, ["s"]).count() == 0
    _, up = one_series(spark, SERIES[3])
    assert series.rul(up, ["s"], 20.0).first()["rul"] == 4.0
    assert series.rul(up, ["s"], None).first()["rul"] is None
    assert series.rul(up, ["s"], 1.0).first()["rul"] is None
    assert series.risk_level(up, ["s"]).first()["risk"] in ("low", "medium", "high", "critical")
    assert series.forecast_next(up, ["s"], 3).first()["next"] == 19.0
    band = series.adaptive_threshold(one_series(spark, SERIES[1])[0], ["s"], "value").first()
    assert band["upper"] > band["lower"]


@pytest.mark.parametrize("chunk", [4, 7, 1000])
def test_rules_across_chunks(spark, chunk, monkeypatch):
    rng = random.Random(chunk)
    monkeypatch.setattr(series.chunked, "__defaults__", (chunk,))
    for _ in range(3):
        values = [rng.randint(0, 6) for _ in range(40)] + list(range(6)) + [9] * 9
        rng.shuffle(values[:30])
        _, placed = one_series(spark, values)
        mean = sum(values) / len(values)
        runs = [i for i in range(len(values) - 6) if len({(v > mean) - (v < mean) for v in values[i : i + 7]} | {0}) == 2 and all(v != mean for v in values[i : i + 7])]
        got = series.spc_run_rule(placed, ["s"]).first()
        assert (got["run_start"] if got else None) == (runs[0] if runs else None)
        trends = [i for i in range(len(values) - 5) if all(a < b for a, b in zip(values[i : i + 5], values[i + 1 : i + 6])) or all(a > b for a, b in zip(values[i : i + 5], values[i + 1 : i + 6]))]
        got = series.spc_trend_rule(placed, ["s"]).first()
        assert (got["trend_start"] if got else None) == (trends[0] if trends else None)


def test_two_level_position_equals_plain(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("s"), (F.col("id") * 7 % 500).alias("t"), F.col("id").cast("double").alias("value"))
    a = series.position(df, ["s"], ["t"], "value").collect()
    b = series.position(df, ["s"], ["t"], "value", F.floor(F.col("t") / 50)).collect()
    assert {(r["s"], r["t"], r["pos"]) for r in a} == {(r["s"], r["t"], r["pos"]) for r in b}


def test_clean_fixture(spark):
    rows = [(1, "a", "20.1", "ok"), (2, "b", "20.5", "ok"), (3, "b", "20.5", "ok"), (4, "c", " ", "ok"), (5, "d", "80.0", "ok"), (6, "e", "20.3", "ok"), (7, "f", "20.2", "ok")]
    df = spark.createDataFrame(rows, "n int, id string, temp string, status string")
    got = clean.clean_report(df, ["id", "temp", "status"], "n", ["temp"]).first()
    assert (got["dropped_dup"], got["dropped_missing"], got["dropped_outlier"], got["rows_out"]) == (1, 1, 1, 4)
    assert clean.numeric_columns(df, ["id", "temp", "status"], "n") == ["temp"]
    filled = {r["n"]: r["temp"] for r in clean.fill_zero(df, ["temp"]).collect()}
    assert filled[4] == "0"
    assert clean.clean(df, ["id", "temp", "status"], "n", missing="mean", outliers="zscore").count() == 6


def test_types_and_profile(spark):
    cells = ["1", "-2", "1.5", "2024-01-02", " ", None, "1e5", "1d", "nan", "x", "１"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = df.orderBy("i").select(typed.guess_type(F.col("c")).alias("t"), typed.is_num(F.col("c")).alias("n")).collect()
    assert [r["t"] for r in got] == ["integer", "integer", "float", "date", "missing", "missing", "text", "text", "text", "text", "text"]
    assert [r["n"] for r in got] == [True, True, True, False, False, False, True, False, False, False, False]
    assert df.select(typed.field_cn(F.lit("deviceTemp_value"))).first()[0] == "设备温度数值"
    assert df.select(typed.local_name(F.lit("a_b c"))).first()[0] == "c"
    schema = {r["column"]: r for r in profile.profile_schema(df, ["c"], "i").collect()}
    assert schema["c"]["type"] == "integer" and schema["c"]["missing"] == 2 and schema["c"]["sample"][:2] == ["1", "-2"]
    assert profile.quality_score(df.limit(0), ["c"], "i").first()["score"] == 0.0


def points(spark, values, metric="temperature", device="d1"):
    rows = [(device, metric, float(v), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "device string, metric string, value double, seq long")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq * 10)"))


def rule(spark, op=">", threshold=80.0):
    return spark.createDataFrame([("d1", "temperature", op, threshold, "warn")], "device string, metric string, op string, threshold double, level string")


def test_monitor_fixtures(spark):
    roll = monitor.minute_rollup(points(spark, [45, 46, 47])).collect()
    assert [(r["avg"], r["count"]) for r in roll] == [(46.0, 3)]
    fired = [r["fired"] for r in monitor.rules_x_points(points(spark, [90, 70]), rule(spark)).orderBy("seq").collect()]
    assert fired == [True, False]
    changed = monitor.mutation_detect(points(spark, [40, 41, 39, 42, 40, 41, 90]), 20.0).orderBy("seq").collect()
    assert changed[-1]["mutated"] and not any(r["mutated"] for r in changed[:-1])
    eps = monitor.alert_episodes(monitor.rules_x_points(points(spark, [90, 95, 70, 99]), rule(spark))).orderBy("episode").collect()
    assert [(r["state"], r["value"], r["n_points"]) for r in eps] == [("recovered", 95.0, 2), ("firing", 99.0, 1)]


def test_two_sided_and_disabled_rules(spark):
    schema = "device string, metric string, op string, threshold double, op2 string, threshold2 double, enabled boolean, level string"
    for op, op2, enabled, wanted in (("between", "and", None, [False, True, True, False]), ("outside", "and", True, [True, False, False, True]), ("between", None, True, [False] * 4), (">", None, False, [])):
        rules = spark.createDataFrame([("d1", "temperature", op, 10.0, op2, 20.0, enabled, "warn")], schema)
        for rows in (monitor.rules_x_points(points(spark, [9, 10, 20, 21]), rules), monitor.judge(points(spark, [9, 10, 20, 21]), rules)):
            assert [r["fired"] for r in rows.orderBy("seq").collect()] == wanted
        assert monitor.evaluate_latest(points(spark, [9, 15]), rules).count() == int(wanted[1:2] == [True])
    combo = "metric string, op string, threshold double, op2 string, threshold2 double"
    for combos, wanted in (([], True), ([("t", None, None, None, None)], True), ([("t", "between", 1.0, "and", 5.0)], True), ([("t", "outside", 1.0, "and", 5.0)], False),
                           ([("t", "between", 1.0, None, 5.0)], False), ([("t", ">", 1.0, None, None), ("gone", ">", 1.0, None, None)], False)):
        df = spark.createDataFrame([(combos, {"t": 3.0})], f"combos array<struct<{combo.replace(' ', ':').replace(',:', ',')}>>, now map<string,double>")
        assert df.select(monitor.combine_conditions(F.col("combos"), F.col("now")).alias("x")).first()["x"] is wanted


@pytest.mark.parametrize("stretch", ["hour", "day", "week"])
def test_episodes_and_events_with_mutations_across_stretches(spark, monkeypatch, stretch):
    """Against a plain loop over the points in order."""
    monkeypatch.setattr(monitor, "STRETCH", stretch)
    rng = random.Random(8)
    rows = [("d%d" % rng.randint(0, 2), "t", float(rng.choice([1, 5, 50, 52, 55, 90])), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 6000)), i) for i in range(400)]
    rows += [(d, m, v, ts, 1000 + s) for d, m, v, ts, s in rows[:20]] + [("d0", "t", None, dt.datetime(2024, 1, 2, 12), 5000)]
    rules = [("d0", "t", ">", 80.0, None, "warn"), ("d1", "t", ">", 80.0, 50.0, "critical"), ("d2", "t", "<=", 5.0, 20.0, "warn")]
    wanted, episodes = Counter(), Counter()
    for d, _, op, threshold, percent, level in rules:
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[3], r[4]))
        open_ = None
        for _, _, v, ts, seq in own:
            window = sorted(x[2] for x in own if x[2] is not None and ts - dt.timedelta(minutes=600) <= x[3] <= ts)
            base = statistics.median(window) if window else 0
            kind = "threshold" if v is not None and (v > threshold if op == ">" else v <= threshold) else None
            if kind is None and v is not None and percent and len(window) > 1 and base and abs(v - base) / base * 100 > percent:
                kind = "mutate"
            if kind and open_ is None:
                open_ = [ts, v, 0, kind]
                wanted[d, ts, seq, v, "raised", kind, level, ts] += 1
            elif kind:
                wanted[d, ts, seq, v, "updated", kind, level, open_[0]] += 1
            elif open_:
                wanted[d, ts, seq, v, "recovered", None, level, open_[0]] += 1
                episodes[d, open_[0], open_[1], open_[2], open_[3], ts] += 1
                open_ = None
            if open_:
                open_[1:3] = v, open_[2] + 1
        if open_:
            episodes[d, open_[0], open_[1], open_[2], open_[3], None] += 1
    df = spark.createDataFrame(rows, "device string, metric string, value double, ts timestamp_ntz, seq long").repartition(3)
    judged = monitor.judge(df, spark.createDataFrame(rules, "device string, metric string, op string, threshold double, mutate_pct double, level string"), 600)
    listed = lambda x, *c: Counter(tuple(r[k] for k in c) for r in x.collect())
    assert listed(monitor.alert_events(judged), "device", "ts", "seq", "value", "event", "type", "level", "raised_at") == wanted
    assert listed(monitor.alert_episodes(judged), "device", "raised_at", "value", "n_points", "type", "recovered_at") == episodes


def test_window_medians_of_small_and_dense_windows():
    rng = np.random.default_rng(0)
    key = np.sort(rng.integers(0, 5000, 3000))
    value = rng.integers(0, 50, 3000).astype(float)
    low = np.sort(rng.integers(-50, 5000, 400))
    for width in (3, 80, 2500):
        median, seen = monitor.window_medians(key, value, low, low + width)
        for i in range(len(low)):
            some = value[(key >= low[i]) & (key <= low[i] + width)]
            assert seen[i] == len(some) and (np.isnan(median[i]) if not len(some) else median[i] == np.median(some))


def test_rule_chain_and_or_once(spark):
    chain = "id string, device string, metric string, op string, threshold double, combos array<struct<metric:string,op2:string,threshold:double,op:string>>, action string"
    rules = spark.createDataFrame([("A", None, "temperature", ">", 80.0, [("power", ">", 40.0, None)], "alert"), ("B", None, "temperature", ">", 80.0, [("power", ">", 99.0, None), ("temperature", ">", 85.0, "OR")], "ticket"), ("C", "other", "temperature", ">", 1.0, [], "notify")], chain)
    both = points(spark, [50], "power").union(points(spark, [70, 90, 95]).withColumn("seq", F.col("seq") + 10).withColumn("ts", F.expr("ts + interval 1 hour")))
    got = sorted((r["rule_id"], r["value"]) for r in monitor.rule_chain(both, rules, ["power", "temperature"]).collect())
    assert got == [("A", 90.0), ("B", 90.0), ("B", 95.0)]


def test_ticket_machine(spark):
    log = spark.createDataFrame([(1, 1, "in_progress"), (1, 2, "done"), (1, 3, "open"), (2, 1, "done"), (2, 2, "in_progress")], "id int, at int, target string")
    got = {r["id"]: (r["state"], r["accepted"], r["rejected"]) for r in tickets.ticket_fsm(log, ["id"], ["at"], "target", tickets.SIMPLE).collect()}
    assert got == {1: ("done", 2, 1), 2: ("done", 1, 1)}
    issue = spark.createDataFrame([(1, 1, "closed"), (1, 2, "in_progress")], "id int, at int, target string")
    assert tickets.ticket_fsm(issue, ["id"], ["at"], "target", tickets.ISSUE).first()["state"] == "closed"
    trail = tickets.ticket_audit(log, ["id"], ["at"], "target", tickets.SIMPLE).where("id = 1").orderBy("step").collect()
    assert [(r["from_state"], r["to_state"]) for r in trail] == [("open", "in_progress"), ("in_progress", "done")]


def test_decisions(spark):
    inventory = spark.createDataFrame([("P001", "5", "14", "7"), ("P002", "500", "", None), (None, "1", "1", "1")], "product_id string, stock string, safety_stock string, lead_time_days string")
    sales = spark.createDataFrame([("P001", "3", "2024-01-01", 1), ("P001", "3", "2024-01-02", 2), ("P002", "9", "2024-01-01", 3), ("P002", "1", "2024-01-05", 4)], "product_id string, qty string, date string, n int")
    assert [r["entity"] for r in decisions.shortage(inventory).collect()] == ["P001"]
    assert decisions.reorder(inventory, sales).first()["reorder_level"] == 35.0
    assert [(r["entity"], round(r["drop"], 3)) for r in decisions.sales_forecast(sales, ["date", "n"]).collect()] == [("P002", 0.889)]
    machines = spark.createDataFrame([("E1", "待修", None, None), ("E2", "ok", "2024-01-01", 12), ("E3", "ok", "bad", 12), ("E4", "ok", "2023-01-01", 12), ("E5", None, "2030-01-01", 12)], "id string, status string, install_date string, warranty_months int")
    got = {r["entity"]: (r["action"], r["days_left"]) for r in decisions.warranty(machines, "2024-12-01").collect()}
    assert got == {"E1": ("维护告急", None), "E2": ("保修临期", 25), "E4": ("保修过期", -340)}
    every = decisions.run_decisions({"inventory": inventory, "sales": sales}, {"sales_order": ["date", "n"]})
    assert {r["id"] for r in every.select("id").distinct().collect()} <= {"D1", "D2", "D3", "D6"}


def test_graph_and_questions(spark):
    product = spark.createDataFrame([("P1", "x"), ("P1", "y")], "id string, name string")
    sale = spark.createDataFrame([("1", "P1"), ("2", "P9")], "id string, product_id string")
    nodes, edges = ontology.build_graph({"sales": sale, "product": product}, {"sales": "id", "product": "id"}, [("sales", "product_id", "product", "of")])
    assert [(r["from"], r["to"]) for r in edges.collect()] == [("sales:1", "product:P1")] and nodes.count() == 3
    linked = ontology.link_entities(sale, product.withColumn("n", F.when(F.col("name") == "y", 2).otherwise(1)).withColumnRenamed("id", "pid"), "product_id", "pid", "n")
    assert {(r["id"], r["name"], r["match"]) for r in linked.collect()} == {("1", "y", True), ("2", None, False)}
    things = spark.createDataFrame([(1, "车床", "80"), (2, "铣床", "50"), (3, "铣床", "65")], "id int, device_type string, power_kw string")
    asked = spark.createDataFrame([(1, "有多少台设备"), (2, "功率最大的设备"), (3, "功率最小的设备"), (4, "设备类型有哪些"), (5, "今天天气")], "qid int, text string")
    got = sorted((r["qid"], r["answer"]) for r in ontology.answer_batch(asked, things, {"功率": "power_kw", "设备类型": "device_type"}, "id").collect())
    assert got == [(1, "3"), (2, "80.0"), (3, "50.0"), (4, "车床"), (4, "铣床")]
    assert ontology.agg_extreme(things, "power_kw", "id", largest=False).first()["id"] == 2
    assert [r["value"] for r in ontology.agg_list(things.drop("device_type")).collect()] == ["1", "2", "3"]
    columns = spark.createDataFrame([("log", "Log", "device_id"), ("log", "Log", "log_id"), ("log", "Log", "name")], "table string, entity string, column string")
    entities = spark.createDataFrame([("Equipment", 1), ("Log", 2)], "entity string, rank int")
    assert [(r["column"], r["target"]) for r in ontology.infer_fk(columns, entities, columns.limit(0).select("table", "column")).collect()] == [("device_id", "Equipment")]
    lines = ontology.ntriples(ontology.rows_to_triples(things, "Device", "id", ["device_type"])).collect()
    assert len(lines) == 6 and all(r["value"].endswith(" .") for r in lines)
    assert spark.range(1).select(ontology.prop_role(F.lit("x_code"), F.lit("string"))).first()[0] == "reference"
    assert not ontology.semantic_name_check(spark.createDataFrame([("温度类型",)], "field string")).first()["ok"]
    assert drafts.draft_questions(profile.profile_dictionary(things, ["device_type", "power_kw"], "id"), "设备").count() >= 3


def test_answers(spark):
    rows = spark.createDataFrame([("P1", "D1", "运行中", 80.0, 1), ("P2", "D2", "运行中", 90.0, 2), ("P3", "D2", "停机", 90.0, 3)], "id string, device_name string, status string, temp double, seq long")
    asked = ["有多少台设备", "温度最高的设备", "温度最低的设备", "状态有哪些", "有哪些设备", "状态为运行中的设备", "检修的状态", "今天天气"]
    questions = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    got = {}
    for r in ontology.answer_batch(questions, rows, {"温度": "temp", "状态": "status"}, "seq").collect():
        got.setdefault(r["qid"], []).append((r["kind"], r["answer"], r["instance"]))
    assert got[0] == [("count", "3", None)] and got[5] == [("filter", "2", None)] and got[6] == [("filter", "0", None)] and 7 not in got
    assert got[1][0][:2] == ("max", "90.0") and '"id":"P2"' in got[1][0][2] and '"id":"P1"' in got[2][0][2]
    assert sorted(a for _, a, _ in got[3]) == ["停机", "运行中"] and sorted(a for _, a, _ in got[4]) == ["D1", "D2"]


def test_enumerations_are_whole(spark):
    rows = spark.range(200).select(F.col("id").alias("seq"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("status"))
    found = ontology.answer_batch(spark.createDataFrame([(1, "状态有哪些")], "qid long, text string"), rows, {"状态": "status"}, "seq")
    assert found.count() == 200


def test_triggers_topics_and_facts(spark):
    texts = spark.createDataFrame([(1, "please DEPLOY now"), (2, "nothing")], "doc long, text string")
    assert [tuple(r) for r in retrieval.trigger_match(texts, spark.createDataFrame([("s", "deploy"), ("s", "Now")], "skill string, trigger string")).collect()] == [(1, "s", 2)]
    said = [(1, "部署前检查，数据清洗流程完成", ["auto"]), (2, "数据清洗流程完成，部署前检查，再说一次", ["经验"]), (3, "数据清洗流程完成，没有标签的不算", ["x"]), (4, "短，短", ["auto"])]
    topics = retrieval.phrase_mine(spark.createDataFrame(said, "doc long, text string, tags array<string>")).collect()
    assert [(r["topic"], r["n"], r["docs"], r["steps"]) for r in topics] == [("部署前检查", 2, 2, [1, 2]), ("数据清洗流程完成", 2, 2, [1, 2])]
    assert len(topics[0]["triggers"]) == 5 and topics[0]["triggers"][0] == "部署前检查"
    base = spark.createDataFrame([("a", "old", ["x"], []), ("b", "kept", [], [str(i) for i in range(20)])], "h string, text string, tags array<string>, history array<string>")
    changes = spark.createDataFrame([("a", "new", ["y"], "update"), ("b", "newer", [], "update")], "h string, text string, tags array<string>, op string")
    got = {r["h"]: r for r in retrieval.facts_upsert(base, changes).collect()}
    assert got["a"]["history"] == ["old"] and got["a"]["tags"] == ["x", "y"] and len(got["b"]["history"]) == 20 and got["b"]["text"] == "newer"


def test_terms_are_found_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "做为一个人，做为事，既使必需"), (2, "aXaXa"), (3, None)], "doc long, text string")
    got = {(r["doc"], r["term"]): (r["count"], r["suggestion"]) for r in textqa.scan_terms(docs, (*textqa.LEXICON, ("D9", "k", "warn", ("aXa", "Xa", "aX")))).collect()}
    assert got[1, "做为"] == (2, "作为") and got[1, "做为一个"] == (1, "作为一个") and got[1, "必需"] == (1, "必须")
    assert {k: v[0] for k, v in got.items() if k[0] == 2} == {(2, "aXa"): 1, (2, "Xa"): 2, (2, "aX"): 2}


def test_zscore_plan_is_linear(spark):
    rows = spark.range(50).select("id", *[((F.col("id") * k) % 17).cast("double").alias(f"c{k}") for k in range(1, 9)])
    plan = clean.outlier_zscore(rows, [f"c{k}" for k in range(1, 9)])._jdf.queryExecution().logical().toString()
    assert plan.count("Range (") == 1


def test_lexicon_and_review(spark):
    draft = spark.createDataFrame([("device_status", "状态", "text", ["停机", "运行"]), ("power_kw", "功率", "float", None), ("line_zone", "区域", "text", ["甲", "乙"])], "column string, cn string, type string, enum array<string>")
    draft = draft.withColumn("suggest", F.lit("")).unionByName(spark.createDataFrame([("id", "编号", "identifier", None, "")], "column string, cn string, type string, enum array<string>, suggest string"))
    got = {(r["section"], r["key"]): r["value"] for r in drafts.factory_lexicon(draft, "line", "产线").collect()}
    assert got["status_cn2en", "停机"] == "停机" and got["value_en_suggest", "停机"] == "stopped" and got["zone_cn2en", "甲"] == "甲"
    assert got["attr_cn2en", "功率"] == "kw" and got["numeric_fields", "功率"] == "kw" and got["entity_cn2en", "产线"] == "line" and ("attr_cn2en", "编号") not in got
    items = {tuple(r) for r in drafts.review_items(draft).collect()}
    assert items == {("type_enum", "停机", "状态"), ("type_enum", "运行", "状态"), ("attr_mapping", "功率", "kw"), ("type_enum", "甲", "区域"), ("type_enum", "乙", "区域")}


def test_jdbc_reads_from_an_embedded_database(spark):
    url = "jdbc:derby:memory:millrace;create=true"
    spark.range(20).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V")).write.format("jdbc").options(url=url, dbtable="T1", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    more = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table = files.read_jdbc_table(spark, url, "T1", ("K", 0, 20, 4), **more)
    assert table.rdd.getNumPartitions() == 4 and table.agg(F.sum("V")).first()[0] == 380
    assert files.read_jdbc_query(spark, url, "SELECT K FROM T1 WHERE V > 30", **more).count() == 4


def test_retrieval(spark):
    texts = ["电机温度过高需要检查冷却", "鼓风机皮带老化打滑出现异响", "更换润滑油和滤芯", "传感器信号丢失"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    ask = spark.createDataFrame([(1, "鼓风机皮带老化打滑出现异响"), (2, "皮带打滑异响")], "qid long, text string")
    for by in ("vector", "hybrid", "lexical"):
        best = {r["qid"]: (r["doc"], r["score"]) for r in retrieval.ranked(ask, docs, 1, by).collect()}
        assert best[1][0] == 1 and best[2][0] == 1 and best[2][1] > 0.3
    assert retrieval.ranked(ask, docs, 1).where("qid = 1").first()["score"] == 1.0
    facts = docs
    new = spark.createDataFrame([(1, texts[1]), (2, "完全不同的一句话"), (3, texts[1][:9])], "qid long, text string")
    assert {r["qid"]: r["action"] for r in retrieval.write_decision(new, facts).collect()} == {1: "SKIP", 2: "ADD", 3: "UPDATE"}
    assert spark.range(1).select(retrieval.overlap(F.lit("abc"), F.lit("a")), retrieval.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first() == (0.0, 0.0)
    missed = retrieval.kb_search(spark.createDataFrame([(9, "zzzz")], "qid long, text string"), docs).first()
    assert missed["doc"] is None
    grams = spark.range(1).select(retrieval.char_ngrams(F.lit("A b"), 3), retrieval.char_ngrams(F.lit(""), 2)).first()
    assert list(grams) == [["ab"], [""]]
    kept = retrieval.auto_sediment(spark.createDataFrame([(1, "hi", ["t"]), (2, "这是一条有价值的经验", ["auto"])], "qid long, text string, tags array<string>"), docs, "qa")
    assert [r["tags"] for r in kept.collect()] == [["auto", "qa"]]


def test_masking_round_trip(spark):
    text = "客户A 的 IP 10.0.0.1 和 10.0.0.2，电话 13812345678，邮箱 a.b@example.com，￥1,200 元，域名 www.example.com，序列 12345678901，身份 11010119900101123X"
    r = spark.createDataFrame([(text,)], "t string").withColumn("x", textqa.mask_pii(F.col("t"), ["客户A"])).select("x.masked", "x.mapping", textqa.unmask(F.col("x.masked"), F.col("x.mapping")).alias("back")).first()
    assert r["back"] == text
    for mark in ("{{WORD_1}}", "{{IP_1}}", "{{IP_2}}", "{{PHONE_1}}", "{{EMAIL_1}}", "{{AMOUNT_1}}", "{{DOMAIN_1}}", "{{SERIAL_1}}", "{{ID_1}}"):
        assert mark in r["masked"]
    assert r["mapping"]["{{IP_2}}"] == "10.0.0.2"


ODD_TEXTS = (
    "a.com -b.org", "a.com--b.org", "1.2.3.4a5.6.7.8.9", "1.2.3.4 5.6.7.8 9.9.9.9", "a@b.c-d@e.f", "a@b.c.-d@e.f", "²a.com", "½x@y.zz", "Ⓐa.com", "𝐀a.com", "𝐀-b.org", "a.com²",
    "￥\x0b5 万元", "010-12345678 0101234567890", "12345678901234567X12345678901234567x", "\x03!\x01a.com\x02#\x011.2.3.4\x03", "", None)


def test_masks_equal_their_sql_at_bounds(spark):
    """Matches that follow each other, signs of words beyond the letters, and signs that the SQL itself uses."""
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    got = {r[0]: r[1] for r in docs.select("doc_id", textqa.mask_typed(F.col("text"))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(ODD_TEXTS)))
    assert got == dict(con.execute(text_queries.ORACLES["mask_typed"]).fetchall())
    assert [got[i] for i in (0, 2, 4, 9, 10)] == ["{{DOMAIN}} {{DOMAIN}}", "{{IP}}a{{IP}}.9", "{{EMAIL}}-{{EMAIL}}", "𝐀a.com", "𝐀-{{DOMAIN}}"]


def test_masking_leaves_a_texts_own_placeholders(spark):
    """Placeholders and braces that a text has by itself are neither counted nor replaced when it is restored."""
    texts = ["{{IP_1}} 1.2.3.4 {{IP_3}} 5.6.7.8 {{FOO_1}}", "{{{a.com}}} {{ x }}", "{{DOMAIN_1}} {{IP_2}}", "a.com b.org", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.withColumn("x", textqa.mask_pii(F.col("text"))).select("text", "x.masked", textqa.unmask(F.col("x.masked"), F.col("x.mapping")).alias("back")).collect()
    assert [r["back"] for r in rows] == [r["text"] or "" for r in rows]
    assert rows[0]["masked"] == "{{IP_1}} {{IP_2}} {{IP_3}} {{IP_4}} {{FOO_1}}"


def test_unmask_takes_what_stands_for_a_placeholder_as_it_is(spark):
    """A custom word that looks like a placeholder is restored as it was; other placeholders than those of `mask_pii` are, too."""
    text = "{{IP_1}} is 1.2.3.4"
    r = spark.createDataFrame([(text,)], "t string").withColumn("x", textqa.mask_pii(F.col("t"), ["{{IP_1}}"])).select("x.masked", textqa.unmask(F.col("x.masked"), F.col("x.mapping"))).first()
    assert tuple(r) == ("{{WORD_1}} is {{IP_1}}", text)
    own = F.create_map(F.lit("<a>"), F.lit("1"), F.lit("<a>b"), F.lit("2"))
    assert spark.range(1).select(textqa.unmask(F.lit("<a> <a>b"), own), textqa.unmask(F.lit(None).cast("string"), own)).first() == ("1 2", None)


def test_mask_pii_equals_its_sql_with_own_placeholders(spark, tmp_path):
    texts = ["{{IP_1}} 1.2.3.4 {{IP_3}} 5.6.7.8 {{FOO_1}}", "{{{a.com}}} {{ x }}", "{1.2.3.4", *ODD_TEXTS]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = connect(str(tmp_path))
    for name in ("mask_pii", "unmask"):
        assert not differences(text_queries.QUERIES[name](spark, str(tmp_path)), con, text_queries.ORACLES[name])


def test_text_checks(spark):
    docs = spark.createDataFrame([(1, "我们通过努力使业绩提升。目的是为了赋能——2024/1/2,好"), (2, "plain"), (3, None)], "doc long, text string")
    kinds = {(r["doc"], r["kind"]) for r in textqa.scan_patterns(docs).collect()}
    assert {(1, "missing_subject"), (1, "purpose_for"), (1, "dash"), (1, "date_format")} <= kinds and not any(d != 1 for d, _ in kinds)
    layers = {r["layer"]: r["passed"] for r in textqa.text_scan(docs).where("doc = 1").collect()}
    assert layers["D3"] is False and layers["D5"] is False


def test_fact_check(spark):
    rows = spark.createDataFrame([(1, "90", "30"), (2, "95", "25")], "n int, temperature string, power string")
    said = spark.createDataFrame([(1, "设备温度达到 92，功率为 30"), (2, "设备功率为 100"), (3, "没有数字")], "doc long, text string")
    claims = textqa.ledger(said)
    checked = textqa.fact_check(claims, rows, ["temperature", "power"], "n")
    status = {}
    for r in checked.collect():
        status.setdefault(r["doc"], []).append(r["status"])
    assert "supported" in status[1] and "contradicted" not in status[1]
    assert "contradicted" in status[2] and 3 not in status
    none = textqa.fact_check(claims, rows.limit(0), ["temperature", "power"], "n").select("status").distinct().collect()
    assert [r["status"] for r in none] == ["unsupported"]
    assert {r["doc"]: r["pass"] for r in textqa.fact_check_summary(checked).collect()}[2] is False


def test_survey(spark):
    req = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"])], "id int, title string, acceptance array<string>")
    items = survey.build_acceptance(req)
    assert [r["aid"] for r in items.orderBy("aid").collect()] == ["A-001", "A-002", "A-003"]
    assert survey.reconcile(req, items).count() == 0
    assert {(r["kind"], r["rid"]) for r in survey.reconcile(req, items.withColumn("rid", F.col("rid") + 1)).collect()} == {("missing", 1), ("orphan", 3)}
    assert not survey.acceptance_status(items, ["rid"]).first()["accept"]
    stories = spark.createDataFrame([(1, "提升设备合格率", "质量", "p1", None, None), (2, " ", "质量", "P1", None, None), (3, "x", "别的", "P1", ["c"], "t")], "id int, story string, category string, priority string, acceptance array<string>, title string")
    assert {r["id"]: r["valid"] for r in survey.structure_requirement(stories).collect()} == {1: True, 2: False, 3: False}
    effort = survey.estimate_effort(spark.createDataFrame([("p", 2000, 5, "medium", 0.9)], "project string, rows long, requirements long, complexity string, quality double"))
    assert effort.first()["total_days"] == 11.6
    assert survey.build_quote(effort).agg(F.sum("amount")).first()[0] == pytest.approx(survey.build_quote(effort).first()["subtotal"])


def test_drafts(spark):
    got = spark.createDataFrame([("运行",), ("未知",), ("on",)], "v string").select(drafts.enum_en_suggest(F.col("v")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("running", False), ("", True), ("on", False)]
    cost = spark.createDataFrame([("主轴轴承磨损",), ("",), ("其他",)], "m string").select(drafts.fault_advice(F.col("m"))["estimated_cost"]).collect()
    assert [r[0] for r in cost] == [1200, 1200, 0]


def test_sources(spark, tmp_path):
    (tmp_path / "factory_a.csv").write_bytes("﻿id,temp\n1,20\n2,\n".encode())
    (tmp_path / "b.csv").write_text("id,other\n9,z\n")
    tables, catalogue = files.load_tables(spark, {"factory_a": str(tmp_path / "factory_a.csv"), "b": str(tmp_path / "b.csv")})
    assert tables["factory_a"].columns == ["id", "temp"] and tables["factory_a"].dtypes[0][1] == "string"
    assert {(r["table"], r["entity"], r["key"]) for r in catalogue.collect()} == {("factory_a", "A", "id"), ("b", "B", "id")}
    assert files.union_files(list(tables.values())).columns == ["id", "temp", "other"]
    for bad in ("a b", "x;drop", ""):
        with pytest.raises(ValueError):
            files.check_name(bad)
    for bad in ("delete from x", "select 1; select 2", "select * from x where a = 'b'", "select 1 -- x"):
        with pytest.raises(ValueError):
            files.check_select(bad)
    assert files.jdbc_options("u", table="t", partition=("id", 0, 9, 3))["numPartitions"] == "3"
    assert files.jdbc_options("u", query="select a from t")["query"] == "select a from t"
    assert files.list_tables(spark, "nowhere") == []
    lines = spark.createDataFrame([('{"device":"d","metric":"m","value":1.5,"ts":"t"}',), ('[{"device":"e","metric":"m","value":2}]',), ('{"f":{"m":3,"n":4}}',), ("junk",)], "value string")
    assert sorted((r["device"], r["value"]) for r in files.parse_points_json(lines).collect()) == [("d", "1.5"), ("e", "2"), ("f", "3"), ("f", "4")]
    assert files.parse_points_kv(spark.createDataFrame([("device=d  metric=m value=x",)], "value string")).first()[:3] == ("d", "m", "x")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n.md").write_text("short\na line that is long enough\na line that is long enough\n")
    facts = files.read_markdown_lines(spark, str(tmp_path))
    assert [r["text"] for r in facts.collect()] == ["a line that is long enough"]
    files.write_markdown_facts(facts, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "- a line that is long enough"
    files.write_csv(facts, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 1
    files.save_model(facts, str(tmp_path / "model"))
    assert files.load_model(spark, str(tmp_path / "model")).count() == 1


def test_selection_equals_sorting(spark):
    """Ties, infinities of range, constant and short series, null keys; ranks at the ends and inside."""
    rng = random.Random(12)
    made = {
        "spread": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(3000)], "ties": [float(rng.choice([0, 0, 0, 1, 2])) for _ in range(3000)],
        "constant": [7.5] * 900, "short": [3.0, 1.0], "one": [4.0], None: [rng.gauss(0, 1) for _ in range(2500)], "half": [0.0] * 1500 + [rng.random() for _ in range(1500)],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in made.items() for v in vs], "k string, v double").repartition(5)
    wanted, asked = {}, []
    for k, vs in made.items():
        ranks = sorted({0, len(vs) // 3, len(vs) // 2, len(vs) - 1})
        for slot, r in enumerate(ranks):
            asked.append((k, slot, r))
            wanted[k, slot] = sorted(vs)[r]
    for keep in (100_000, 40):
        got = selection.select_ranks(rows, ["k"], spark.createDataFrame(asked, "k string, slot int, rank long"), keep)
        assert {(r["k"], r["slot"]): r["v"] for r in got.collect()} == wanted
    assert selection.select_ranks(rows.limit(0), ["k"], spark.createDataFrame([], "k string, slot int, rank long")).count() == 0


def test_giant_and_plain_statistics_agree(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([None, float("nan"), rng.gauss(5, 2), float(rng.randint(0, 9))])) for k in ("a", "b", None) for _ in range(700)] + [("few", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    listed = lambda x: Counter(map(str, x.collect()))
    for by, f in ((["k"], series.series_stats), ([], series.describe), (["k"], series.mad)):
        assert listed(f(df, by, "x", giant=True, keep=100)) == listed(f(df, by, "x"))
    for by, q in ((["k"], 0.1), ([], 1.0)):
        assert listed(series.quantile(df, by, "x", q, giant=True, keep=100)) == listed(series.quantile(df, by, "x", q))


def test_one_series_of_ten_million_distinct_values(spark):
    """The largest group that any task holds is `keep` rows; the plain result is known, as the values are 0 to n - 1 in disorder."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("s").alias("k"), ((F.col("id") * 7919 + 13) % n).cast("double").alias("v"))
    got = series.quantile(rows, ["k"], "v", 0.25, giant=True, keep=20_000).first()
    assert got["quantile"] == pytest.approx((n - 1) * 0.25, abs=1e-3)
    assert series.mad(rows, ["k"], "v", giant=True, keep=20_000).first()["mad"] == n / 4


def test_jdbc_pieces_are_of_like_size(spark):
    """A key that crowds at one end, with gaps, nulls and negative numbers; one key with a third of the rows stays whole."""
    url, more = "jdbc:derby:memory:pieces;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    keys = spark.range(3000).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.pow(F.col("id") - 200, F.lit(3))).cast("long").alias("K"))
    keys.write.format("jdbc").options(url=url, dbtable="SKEWED", **more).save()
    df = files.read_jdbc_balanced(spark, url, "SKEWED", "K", 6, **more)
    sizes = df.groupBy(F.spark_partition_id()).count().select("count").collect()
    sizes = [r["count"] for r in sizes]
    assert sum(sizes) == 3000 and 5 <= len(sizes) <= 8 and max(sizes) <= 2 * min(sizes) and Counter(r["K"] for r in df.collect()) == Counter(r["K"] for r in keys.collect())
    spark.range(900).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id")).cast("long").alias("K")).write.format("jdbc").options(url=url, dbtable="HOT", **more).save()
    hot = files.read_jdbc_balanced(spark, url, "HOT", "K", 6, **more).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in hot) == 900 and max(r["count"] for r in hot) <= 450
    keys.limit(0).write.format("jdbc").options(url=url, dbtable="EMPTY", **more).save()
    assert files.read_jdbc_balanced(spark, url, "EMPTY", "K", 6, **more).count() == 0


def test_pages(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 2.0, rng.random()])) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, v double")
    wanted = [r["i"] for r in df.orderBy(F.desc("v"), "i").collect()]
    pages = files.Pages(df, [F.desc("v"), "i"], range_rows=60)
    for limit, offset in ((10, 0), (10, 995), (300, 400), (5, 1000), (1, 999), (2000, 0)):
        assert [r["i"] for r in pages.rows(limit, offset).collect()] == wanted[offset : offset + limit]
    read = pages.rows(10, 500).select("i")
    folders = {f.split("__range=")[1].split("/")[0] for f in read.inputFiles()}
    scanned = next(line for line in read._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert len(folders) > 10 and "__range" in scanned.split("PartitionFilters")[1].split("]")[0]
    assert files.paginate(df, ["i"], None, 5).count() == 1000 and [r["i"] for r in files.paginate(df, ["i"], 3, 5).collect()] == [5, 6, 7]
    assert files.paginate(df.limit(0), ["i"], 3).count() == 0
