"""What showed only on larger tables: ties of rounding, questions times answers, copies, ranges of pages."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from millrace.operators import ontology, retrieval, survey, textqa
from millrace.plans import text_queries
from millrace.sources import files


def write(rows, folder, name):
    rows.write.parquet(f"{folder}/{name}.parquet")


def test_means_of_claims_round_half_up_whatever_the_order_of_sums(spark, tmp_path):
    """Means that lie exactly between two tenths, as sums of binary fractions don't hold them."""
    rng, rows, want = random.Random(3), [], {}
    for user in range(200):
        cents = [rng.randint(100, 9999) for _ in range(20)]
        cents[-1] += (100 - sum(cents)) % 200  # 20 values whose mean is a whole number of tenths and a half
        want[user] = str((Decimal(sum(cents)) / 2000).quantize(Decimal("0.1"), ROUND_HALF_UP))
        rows += [(user, c / 100, dt.datetime(2024, 1, 1)) for c in cents]
    assert all((Decimal(w) * 10 - Decimal("0.5")) % 1 == Decimal("0.5") for w in want.values())
    write(spark.createDataFrame(rows, "user_id long, value double, ts timestamp_ntz"), tmp_path, "events")
    got = text_queries.reports(spark, str(tmp_path)).select("doc", F.regexp_extract("text", "达到 ([0-9.]+)", 1).alias("mean")).collect()
    assert {r["doc"]: r["mean"] for r in got} == want


def test_label_answers_are_found_once_for_all_questions(spark):
    triples = spark.createDataFrame([(f"Pump:{i}", "at", f"Hall:{i % 3}") for i in range(300)] + [("Pump:7", "at", "Hall:0"), ("Fan:1", "at", "Hall:9")], "s string, p string, o string")
    asked = spark.createDataFrame([(i, "where is the place of it" if i % 2 else "weather") for i in range(40)], "qid long, text string")
    relations = spark.createDataFrame([("Pump", "at", "place")], "entity string, p string, label string")
    found = ontology.relation_nav(triples, asked, relations, 4)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # no ranking of questions times instances
    want = [(s, "Hall:0" if s == "Pump:7" else f"Hall:{int(s[5:]) % 3}") for s in sorted(f"Pump:{i}" for i in range(300))[:4]]
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], []).append((r["s"], r["value"]))
    assert set(got) == set(range(1, 40, 2)) and all(sorted(x) == want for x in got.values())


def test_many_questions_for_many_answers_are_dealt_to_many_tasks(spark):
    things = spark.range(3500).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"))
    asked = spark.range(40).coalesce(1).select(F.col("id").alias("qid"), F.lit("有哪些东西").alias("text"))
    found = ontology.answer_batch(asked, things, {"编号": "id"}, "id")
    assert found.count() == found.select("qid", "answer").distinct().count() == 40 * 3500
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) >= 8 and max(shares) < 0.3 * 40 * 3500


def test_tasks_of_answers_grow_with_the_pairs_of_questions_and_answers(spark):
    """1.6 billion rows, of which none is made here; 16 tasks would make 100 million each."""
    things = spark.range(40_000).select(F.col("id"), F.concat(F.lit("n"), "id").alias("name"))
    asked = spark.range(40_000).select(F.col("id").alias("qid"), F.lit("有哪些东西").alias("text"))
    assert ontology.answer_batch(asked, things, {"编号": "id"}, "id").rdd.getNumPartitions() >= 80


def test_copies_of_a_text_are_ranked_once(spark, monkeypatch):
    """Ids of copies come in their order, as without grouping, and the scan sees each text once."""
    rng = random.Random(8)
    words = ["pump", "valve", "belt", "seal", "fan"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, texts[(i * 7) % 22]) for i in range(400)], "doc long, text string")
    asked = spark.createDataFrame([(i, texts[i % 22]) for i in range(60)], "qid long, text string")
    sizes, plain = [], retrieval.scans

    def counted(queries, rows, *more):
        sizes.append((queries.count(), rows.count()))
        return plain(queries, rows, *more)

    monkeypatch.setattr(retrieval, "scans", counted)
    distinct = len({t or "" for t in texts})
    for by in ("lexical", "held"):
        got = sorted(tuple(r) for r in retrieval.ranked(asked, docs, 5, by).collect())
        assert got == sorted(tuple(r) for r in retrieval.topk_rank(plain(asked, docs, 5, by, 4), 5).collect())
    assert sizes == [(distinct, distinct)] * 2


def test_both_sides_are_reconciled_in_one_aggregate(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "rid long")
    found = survey.reconcile(left, right)
    assert sorted(tuple(r) for r in found.collect()) == [("missing", 1), ("orphan", 3)]
    gone = survey.set_missing(left.withColumnRenamed("id", "rid"), right, "rid")
    assert [tuple(r) for r in gone.collect()] == [(1,)] and gone.dtypes == [("rid", "int")]
    for df in (found, gone):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_table_has_no_more_ranges_than_the_most(spark, monkeypatch):
    monkeypatch.setattr(files, "MOST_RANGES", 6)
    pages = files.Pages(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")), ["k"], range_rows=10)
    assert pages.sizes.count() <= 6
    assert [r["k"] for r in pages.rows(7, 496).collect()] == list(range(496, 503))


def test_patterns_are_taken_out_only_where_they_are(spark):
    docs = spark.createDataFrame([(1, "1~2 and 3~4"), (2, "none"), (3, None)], "doc long, text string")
    found = textqa.scan_patterns(docs, [("D4", "range", "warn", "[0-9]~[0-9]"), ("D4", "nine", "warn", "9")])
    assert "CASE WHEN RLIKE" in found._jdf.queryExecution().analyzed().toString() or "CASE WHEN rlike" in found._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "D4", "range", "warn", "1~2", 2)]
