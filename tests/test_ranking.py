"""Rankings, writes in turn and many-term search against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import automaton, ranking, retrieval
from millrace.plans import text_queries


def pairs_of(t):
    return {t[i : i + 2] for i in range(len(t) - 1)}


def tokens_of(t):
    return set(re.findall(r"[a-zA-Z0-9_]+|[一-龥]", t.lower()))


def vector_of(t):
    s = re.sub(r"\s+", "", t.lower())
    terms = {g: 1.0 for n in (1, 2, 3) for g in ([s[i : i + n] for i in range(len(s) - n + 1)] if len(s) >= n else [s])}
    terms |= {"w:" + w: 1.5 for w in tokens_of(t)}
    out = [0.0] * 512
    for term, weight in terms.items():
        place = int(hashlib.sha256(f"0:{term}".encode()).hexdigest()[12:16], 16) % 512
        out[place] += weight if int(hashlib.sha256(f"7:{term}".encode()).hexdigest()[15], 16) % 2 == 0 else -weight
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else 0.0 for x in out]


def half_up(x, digits):
    return math.floor(x * 10**digits + 0.5 + 1e-7) / 10**digits


def score_of(by, q, d):
    a, b = pairs_of(q), pairs_of(d)
    x, y = tokens_of(q), tokens_of(d)
    both = len(a & b)
    if by == "asked":
        return (both / len(a), both > 0) if a else (0, False)
    if by == "held":
        return (both / len(b), both > 0) if b else (0, False)
    lexical = 0.7 * (both / len(b) if b else 0) + 0.3 * (len(x & y) / len(x | y) if y else 0), bool(both or x & y)
    if by == "lexical":
        return lexical
    u, v = vector_of(q), vector_of(d)
    vector = sum(p * r for p, r in zip(u, v)), any(p and r for p, r in zip(u, v))
    return vector if by == "vector" else (0.7 * half_up(vector[0], 4) + 0.3 * half_up(lexical[0], 4), vector[1] or lexical[1])


WORDS = ["pump", "valve", "belt", "Motor", "bearing", "leak", "noise", "hot", "泵", "阀", "轴承", "E42", "seal", "drive", "fan"]


def some_texts(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 7))) for _ in range(n)] + ["", " ", "x", None, "pump", "pump", "😀😀 pump", "ß" * 40]


@pytest.mark.parametrize("by", ranking.MODES)
def test_ranked_equals_brute_force(spark, monkeypatch, by):
    monkeypatch.setattr(ranking, "GROUP", 8)
    rng = random.Random(5)
    docs, asked = list(enumerate(some_texts(rng, 300))), [(1000 + i, t) for i, t in enumerate(some_texts(rng, 12))]
    wanted = {}
    for qid, q in asked:
        scored = [(score_of(by, q or "", d or ""), doc) for doc, d in docs]
        wanted[qid] = {doc: s for (s, meets), doc in scored if meets}
    df, qs = spark.createDataFrame(docs, "doc long, text string").repartition(3), spark.createDataFrame(asked, "qid long, text string")
    for queries in (4096, 5):  # in one scan, and in several
        monkeypatch.setattr(ranking, "QUERIES", queries)
        got = {}
        for r in retrieval.ranked(qs, df, 4, by).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = (r["doc"], r["score"])
        assert set(got) == {q for q, d in wanted.items() if d}
        for qid, ranks in got.items():
            assert sorted(ranks) == list(range(1, min(4, len(wanted[qid])) + 1))
            best = sorted(wanted[qid].values(), reverse=True)
            for rank, (doc, score) in ranks.items():
                assert abs(score - wanted[qid][doc]) <= 1.01e-4 and abs(score - best[rank - 1]) <= 1.01e-4
            assert len({d for d, _ in ranks.values()}) == len(ranks)
            order = [ranks[i] for i in sorted(ranks)]
            assert order == sorted(order, key=lambda x: (-x[1], x[0]))


def test_most_pairs_are_not_scored(spark):
    """On the parts of sf0.1 the shares of scored pairs are well under 1, with results as without any bounds."""
    docs, asked = text_queries.parts(spark, "/root/testdata/sf0.1"), text_queries.asked(spark, "/root/testdata/sf0.1")
    shares = {by: ranking.scored_share(asked, docs, 5, by).first() for by in ("vector", "lexical", "hybrid", "asked", "held")}
    for by, row in shares.items():
        assert row["pairs"] == asked.count() * docs.count() and 0 < row["share"] < 0.6, (by, row)


def test_hash_vectors_against_sha256(spark):
    texts = [(i, t) for i, t in enumerate(["pump valve", "Ab 12", "", None, "a", "泵泵", "x  y\tz"])]
    got = {}
    for r in retrieval.hash_embed(spark.createDataFrame(texts, "id int, t string"), "id", "t").collect():
        got.setdefault(r["key"], {})[r["idx"]] = r["w"]
    for i, t in texts:
        want = {j: pytest.approx(x) for j, x in enumerate(vector_of(t or "")) if x}
        assert got.get(i, {}) == want


def test_another_embedding_can_be_put_in(spark):
    def by_length(rows, key, text):
        return rows.select(F.col(key).alias("key"), F.lit(0).alias("idx"), F.lit(1.0).alias("w"))

    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc long, text string")
    got = retrieval.ranked(docs.withColumnRenamed("doc", "qid"), docs, 1, "vector", embed=by_length).collect()
    assert {(r["qid"], r["doc"], r["score"]) for r in got} == {(1, 1, 1.0), (2, 1, 1.0)}


def written_in_turn(candidates, facts, threshold=0.6):
    """The sequential run: (action, best, fact, new) of each candidate."""
    known, out = [(d, t, False) for d, t in sorted(facts)], {}
    for qid, text in sorted(candidates):
        t = text or ""
        a = pairs_of(t)
        scored = [(round(len(a & pairs_of(f)) / len(pairs_of(f)), 6) if pairs_of(f) else 0.0, i) for i, (_, f, _) in enumerate(known)]
        scored = [s for s in scored if s[0] >= 0.3]
        best, at = max(scored, key=lambda s: (s[0], -s[1])) if scored else (None, None)
        fact = known[at][::2] if scored else (None, None)
        if (best or 0) >= 0.9:
            action = "SKIP"
        elif (best or 0) >= threshold:
            action = "UPDATE"
        else:
            action = "SKIP" if not t.strip() or t in {f for _, f, _ in known} else "ADD"
            if action == "ADD":
                known.append((qid, t, True))
        out[qid] = (action, best, *fact)
    return out


def chained(n):
    """Texts of which each is like its neighbours only: a window that moves along one long row of letters."""
    letters = "".join(random.Random(3).sample([chr(c) for c in range(0x4E00, 0x9000)], n * 3 + 40))
    return [(i, letters[i * 3 : i * 3 + 14]) for i in range(n)]


def found_in_turn(spark, candidates, facts):
    got = retrieval.write_decision(spark.createDataFrame(candidates, "qid long, text string"), spark.createDataFrame(facts, "doc long, text string"))
    return {r["qid"]: (r["action"], r["best"], r["fact"], r["fact_new"]) for r in got.collect()}


def test_500_chained_candidates_are_written_as_in_turn(spark):
    candidates = chained(500)
    random.Random(1).shuffle(candidates)
    facts = [(7, candidates[0][1]), (9, "nothing like it")]
    wanted = written_in_turn(candidates, facts)
    assert found_in_turn(spark, candidates, facts) == wanted
    assert {x[0] for x in wanted.values()} == {"ADD", "UPDATE", "SKIP"} and sum(bool(x[3]) for x in wanted.values()) > 200


def test_rounds_give_the_same_as_one_task(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LOCAL_ROWS", 6)
    rng = random.Random(2)
    candidates = [*chained(14), *[(20 + i, t) for i, t in enumerate(some_texts(rng, 40))]]
    candidates += [(100 + i, t) for i, (_, t) in enumerate(candidates[:10])]
    facts = [(1, "pump valve belt"), (2, "y"), (3, "")]
    assert found_in_turn(spark, candidates, facts) == written_in_turn(candidates, facts)


def test_no_candidates_or_facts(spark):
    empty, one = spark.createDataFrame([], "qid long, text string"), spark.createDataFrame([(1, "some text")], "qid long, text string")
    facts = empty.withColumnRenamed("qid", "doc")
    assert retrieval.write_decision(empty, facts).count() == 0
    assert [r["action"] for r in retrieval.write_decision(one, facts).collect()] == ["ADD"]


def test_changes_of_one_batch_apply_in_order(spark):
    """Against a plain loop: updates, deletes, new facts, tags without a text, full histories."""
    rng = random.Random(11)
    base = [(h, f"{h}0", ["x"], [str(i) for i in range(n)]) for h, n in (("a", 0), ("b", 19), ("c", 20), ("d", 3))]
    changes = [(rng.choice("abcdef"), rng.choice([None, "t1", "t2", "t3"]), rng.choice([[], ["y"], ["z", "x"]]), rng.choice(["update"] * 12 + ["delete"]), i) for i in range(150)]
    facts = {h: [t, set(g), list(p)] for h, t, g, p in base}
    for h, text, tags, op, _ in changes:
        if op == "delete":
            facts.pop(h, None)
            continue
        fact = facts.setdefault(h, [text, set(), []])
        if text is not None:
            if fact[0] is not None and fact[0] != text and len(fact[2]) < 20:
                fact[2].append(fact[0])
            fact[0] = text
        fact[1] |= set(tags)
    wanted = {h: (t, sorted(g), p) for h, (t, g, p) in facts.items() if t is not None}
    order = rng.sample(changes, len(changes))
    got = retrieval.facts_upsert_batch(spark.createDataFrame(base, "h string, text string, tags array<string>, history array<string>"),
                                       spark.createDataFrame(order, "h string, text string, tags array<string>, op string, seq long"), "seq")
    assert {r["h"]: (r["text"], r["tags"], r["history"]) for r in got.collect()} == wanted


# --- many terms


def test_terms_are_found_and_counted_as_by_replacing(spark, monkeypatch):
    rng = random.Random(6)
    terms = ["a", "aa", "aba", "ba", "泵", "", "zz", "ab\n"]
    texts = ["".join(rng.choices(["a", "b", "泵", "\n", " "], k=rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    wanted = Counter({(i, t): (t_.count(t) if t else 1) for i, t_ in enumerate(texts) if t_ is not None for t in terms if t in t_})
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    for chars in (1 << 20, 4):
        monkeypatch.setattr(automaton, "TERM_CHARS", chars)
        got = automaton.find_terms(df, spark.createDataFrame([(t,) for t in [*terms, "a", None]], "term string"), "doc")
        assert Counter({(r["doc"], r["term"]): r["count"] for r in got.collect()}) == wanted
    assert automaton.find_terms(df, spark.createDataFrame([], "term string"), "doc").count() == 0


def test_triggers_equal_the_join(spark):
    rng = random.Random(7)
    texts = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=8))) for i in range(50)] + [(0, "PUMP again"), (99, None)], "doc long, text string")
    triggers = spark.createDataFrame([("s1", "PUMP"), ("s1", "pump v"), ("s2", "泵"), ("s2", "泵"), ("s3", ""), ("s4", None)], "skill string, trigger string")
    joined = texts.join(triggers, F.lower("text").contains(F.lower("trigger"))).groupBy("doc", "skill").agg(F.count(F.lit(1)).alias("hits"))
    assert Counter(map(tuple, retrieval.trigger_match(texts, triggers).collect())) == Counter(map(tuple, joined.collect()))


def test_ten_thousand_triggers_cost_little_more_than_ten(spark):
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    rng = random.Random(1)
    made = [("s", "".join(rng.choices("abcdefghij", k=8))) for _ in range(10_000)]
    took = []
    for n in (10, 10_000):
        triggers = spark.createDataFrame(made[:n], "skill string, trigger string")
        began = time.perf_counter()
        retrieval.trigger_match(texts, triggers).count()
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 5
