"""Edge cases and brute-force comparisons of the training-data operators on small fixtures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    chat, common, decontaminate, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, toxicity, url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, 1.0, "x"), (1, "one two three four five six seven", "en", "a", 33, 1.0, "x"),
        (1, "another text under the same id", "en", None, 30, 1.0, "x"), (2, None, None, None, None, None, None), (3, "", "", "", 0, 0.0, ""),
        (None, "no id here", "en", "a", 10, 2.0, "y"), (None, None, None, "b", None, None, None), (4, long, "en", "b", len(long), 0.0, "z"),
        (5, " \n\t\n ", "en", "b", 5, 0.0, "z"), (6, "ÄÖ ß\x00\x0bé", "de", "b", 8, 0.0, "z"), (7, "a\nb\nc\na\nb\nc", "de", "c", 11, 0.0, "z"),
    ]
    return table(spark, rows, DOCS + ", size double, kept string").withColumns(
        {c: F.lit(1) for c in ("digest", "target", "taken", "host", "node", "band", "key", "comp", "row", "words", "lines", "score", "n_words")})


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


LABELS = "doc_id long, quality int, toxic int"


# --- 1 quality classifier


def test_ordinal_model_has_ordered_thresholds_and_separates_grades():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(600, 8))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.digitize(x[:, 0] - x[:, 1], [-0.3, 0.0, 0.3]).astype(float) + 1
    model = quality_classifier.fit_ordinal(x, y, steps=600)
    assert (np.diff(model.thresholds) > 0).all()
    assert np.corrcoef(model.expected(x), y)[0, 1] > 0.9
    assert ((model.tail(x, 3.0) > 0.5) == (y >= 3)).mean() > 0.9
    assert (model.tail(x, 1.0) == 1).all() and (model.tail(x, 9.0) == 0).all()


def likelihood(flat, x, y, dims):
    """Mean negative log likelihood of the cumulative-link model with the ridge, written down directly."""
    w, theta = flat[:dims], np.cumsum(np.concatenate([flat[dims : dims + 1], np.exp(flat[dims + 1 :])]))
    total = 0.0
    for row, k in zip(x, y):
        above = [1.0, *(1 / (1 + np.exp(-(row @ w * quality_classifier.SCALE - t))) for t in theta), 0.0]
        total -= np.log(above[k] - above[k + 1])
    return total / len(y) + quality_classifier.L2 / 2 * (w @ w)


def test_ordinal_fit_against_brute_force():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 2)).astype(np.float32) / 10
    y = np.digitize(x @ [1.0, -2.0] + rng.normal(size=120) / 8, [-0.2, 0.0, 0.15])
    model = quality_classifier.fit_ordinal(x, y.astype(float), steps=4000)
    free = np.concatenate([model.weights, model.thresholds[:1], np.log(np.diff(model.thresholds))]).astype(float)
    best, step = free.copy(), 1.0
    while step > 1e-4:  # search by coordinates, from the fit and from zero
        moved = False
        for i in range(len(best)):
            for d in (-step, step):
                other = best.copy()
                other[i] += d
                if likelihood(other, x, y, 2) < likelihood(best, x, y, 2) - 1e-9:
                    best, moved = other, True
        step = step if moved else step / 2
    assert likelihood(free, x, y, 2) <= likelihood(best, x, y, 2) + 1e-3
    assert likelihood(free, x, y, 2) < likelihood(np.array([0.0, 0.0, -1.0, 0.0, 0.0]), x, y, 2) - 0.05


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    got = quality_classifier.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    assert sum(r["accepted"] == (r["quality"] == 1) for r in got) / len(got) > 0.93


def test_quality_edges(spark, odd, empty):
    labels = table(spark, [(1, 0, 0), (1, 1, 0), (4, 1, 0), (5, None, None), (None, 1, 1)], LABELS)
    assert quality_classifier.classify(odd, labels).count() == odd.count()
    none = table(spark, [], LABELS)
    assert [tuple(r) for r in quality_classifier.classify(odd, none).select("expected_grade", "accepted").distinct().collect()] == [(None, True)]
    one = quality_classifier.classify(odd, table(spark, [(4, 1, 0)], LABELS)).select("expected_grade", "accepted").distinct().collect()
    assert [tuple(r) for r in one] == [(1.0, True)]
    assert quality_classifier.classify(empty, labels).count() == 0
    kept = quality_classifier.keep_accepted(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# --- 2 mixing


def fill(sizes, weights, share):
    """Brute force: raise a common level in rounds, resharing what stopped sources leave."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        extra = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += extra[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_targets_quotas_and_pieces(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 200)), "en", rng.choice(["a", "b", "b", "b", "c", "d", None]), 0) for i in range(400)]
    docs = table(spark, rows)
    plan = mixing.plan_mix(docs, shards=8)
    got = {r["doc_id"]: r for r in plan.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, _, source, _ in rows:
        assert got[i]["size"] == len(text.split()) and got[i]["taken"] <= 2 * got[i]["size"]
        sizes[source] += got[i]["size"]
        taken[source] += got[i]["taken"]
    want = fill(sizes, mixing.WEIGHTS, mixing.SHARE)
    for i, _, _, source, _ in rows:
        assert got[i]["source_size"] == sizes[source]
        assert got[i]["target"] == pytest.approx(want[source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * (1 + sizes[s] / 1024)
    for r in got.values():
        for epoch in (0, 1):
            spans = sorted((p["word_from"], p["word_to"]) for p in r["pieces"] if p["epoch"] == epoch)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {r["doc_id"]: r["taken"] for r in mixing.plan_mix(docs.orderBy(F.desc("doc_id")), shards=8).collect()} == {k: r["taken"] for k, r in got.items()}
    pieces = mixing.shard_pieces(docs, plan).collect()
    assert sum(len(p["text"].split()) for p in pieces) == sum(r["taken"] for r in got.values())
    assert {p["shard"] for p in pieces} == set(range(8))


def test_quota_tree_is_exact_and_even(spark):
    sources = spark.createDataFrame([(0, 5000), (1, 0), (2, 37), (3, 1200)], "rank int, quota long")
    got = {r["rank"]: r["ends"] for r in mixing.split_quotas(sources, 16).collect()}
    assert {k: v[-1] for k, v in got.items()} == {0: 5000, 1: 0, 2: 37, 3: 1200}
    per = np.diff(np.array([[0, *got[k]] for k in range(4)]), axis=1)
    assert (per >= 0).all() and set(per.sum(axis=0)) <= {389, 390}
    assert per[0].std() > 0 and abs(per[0].mean() - 312.5) < 1


def test_hypergeometric_frequencies(spark):
    drawn = spark.range(20000).select(mixing._hypergeometric(F.lit(20.0), F.lit(8.0), F.lit(10.0), mixing.unit(F.col("id"))).alias("k"))
    got = {int(r["k"]): r["count"] / 20000 for r in drawn.groupBy("k").count().collect()}
    from math import comb
    for k in range(2, 7):
        assert got[k] == pytest.approx(comb(8, k) * comb(12, 10 - k) / comb(20, 10), abs=0.015)


def test_block_permutation_is_a_bijection_without_order(spark):
    for n in (1, 2, 3, 5, 63, 1000, 5000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 7, F.lit(1)).alias("p")).collect()]
        assert sorted(got) == list(range(n)), n
    steps = Counter((b - a) % n for a, b in zip(got, got[1:]))
    assert steps.most_common(1)[0][1] < 15  # no arithmetic progression
    other = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 7, F.lit(2)).alias("p")).collect()]
    assert sum(a == b for a, b in zip(got, other)) < 20


def test_mix_edges(spark, odd, empty):
    plan = {(r["doc_id"], r["size"]): r for r in mixing.plan_mix(odd).collect()}
    assert len(plan) == odd.count() - 1  # one repeated row
    assert plan[1, 7]["source_size"] == 7 + 7 + 3 and plan[4, 30000]["source_size"] == 30000 + 3
    assert plan[1, 6]["source_size"] == 6 and plan[3, 0]["target"] == 0 and plan[2, 0]["pieces"] == []
    pieces = mixing.shard_pieces(odd, mixing.plan_mix(odd))
    assert sum(len(r["text"].split()) for r in pieces.collect()) == sum(r["taken"] for r in mixing.plan_mix(odd).collect())
    assert mixing.plan_mix(empty).count() == 0 and mixing.shard_pieces(empty, mixing.plan_mix(empty)).count() == 0


def test_shard_is_cut_in_ordered_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 200)
    rng = random.Random(14)
    docs = table(spark, [(i, words(rng, 60), "en", "a", 0) for i in range(300)])
    rows = mixing.shard_pieces(docs, mixing.plan_mix(docs, shards=16)).select("*", F.spark_partition_id().alias("task")).collect()
    assert max(r["part"] for r in rows) > 3
    ordered = sorted(rows, key=lambda r: (r["shard"], r["order"]))
    assert [r["part"] for r in ordered] == [r["part"] for r in sorted(ordered, key=lambda r: (r["shard"], r["part"]))]
    assert all(len({r["task"] for r in rows if (r["shard"], r["part"]) == key}) == 1 for key in {(r["shard"], r["part"]) for r in rows})


# --- 3 URLs


def test_url_rules_and_list(spark, empty):
    urls = [
        "https://WWW.Example.ORG/es/1?x=1", "http://example.org/en/12", "http://example.org/en/2", "http://sub.example.org/es/x#y", "http://notexample.org/es/",
        "http://a.com/fr/1", "http://a.com/de/1", "http://a.com", "nohost", None, "http://x.net/p?b=2&a=1&utm_source=q", "https://m.x.net/p/?a=1&b=2#top", "http://x.net/p?a=1",
        "http://org/", "a://b://c/d", "",
    ]
    pages = table(spark, [(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    listed = table(spark, [("http://x.net/p?a=1&b=2",), (None,), ("junk",), ("http://a.com/fr/1",)], "url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert len(got) == len(urls)
    told = [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))]
    assert told == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("example.org/es/", "block"), ("org/", "allow"),
        ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"),
        ("org/", "allow"), (None, "allow"), (None, "allow")]
    assert (got[0]["host"], got[0]["path"]) == ("www.example.org", "/es/1") and (got[8]["host"], got[8]["path"]) == ("", "")
    assert (got[14]["host"], got[14]["path"]) == ("b:", "//c/d")
    assert got[5]["listed"] and got[5]["verdict"] == "allow"
    none = table(spark, [], "url string")
    assert not any(r["listed"] for r in url_filter.filter_urls(pages, none).collect())
    assert url_filter.filter_urls(table(spark, [], "page_id long, url string"), listed).count() == 0


def test_equal_rules_and_long_urls(spark):
    long = "http://x.org/" + "a" * 200_000
    pages = table(spark, [(1, "http://x.org/a/b"), (2, long), (3, long + "?b=1&a=2"), (4, long + "?a=2&b=1#c"), (5, long + "b")], "page_id long, url string")
    rules = [("allow", "org/a/"), ("block", "x.org/"), ("allow", "x.org/"), ("allow", "org/")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, table(spark, [(long + "?a=2&b=1",)], "url string"), rules).collect()}
    # of rules of one length, block wins
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (1, 2)] == [("x.org/", "block")] * 2
    free = {r["page_id"]: r for r in url_filter.filter_urls(pages, table(spark, [(long + "?a=2&b=1",)], "url string"), []).collect()}
    assert [free[i]["verdict"] for i in range(1, 6)] == ["allow", "allow", "block", "block", "allow"]
    assert len(free[2]["path"]) == 200_001


def test_bloom_filter_has_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 4)  # far too small: all of the list's URLs still pass
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.net/p", "id").alias("url"))
    rows = url_filter.filter_urls(pages, pages.where("page_id % 2 = 0").select("url")).collect()
    assert all(r["listed"] == (r["page_id"] % 2 == 0) for r in rows)
    assert all(r["maybe_listed"] for r in rows if r["listed"])


# --- 4 language


def test_language_profiles_match_direct_vectors():
    import pyarrow as pa
    column = pa.array(["Abc ab", None, "12", "é"])
    grams, own = language_id.gram_codes(column)
    want = Counter()
    for at, text in ((0, " abc ab "), (3, " é ")):
        for i in range(len(text) - 2):
            if text[i + 1] != " ":
                want[at, sum(ord(c) << (21 * j) for j, c in enumerate(text[i : i + 3]))] += 1
    assert Counter(zip(own.tolist(), grams.tolist(), strict=True)) == want
    v = language_id.Grams().vector(grams[0].item())
    letters = [language_id.letter_vector(ord(c)) for c in " ab"]
    assert (v == letters[0] * np.roll(letters[1], 1) * np.roll(letters[2], 2)).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def direct_vector(text):
    """The bundle of a text's letter trigrams, one at a time."""
    out = np.zeros(language_id.DIMENSIONS)
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        for i in range(len(padded) - 2):
            a, b, c = (language_id.letter_vector(ord(x)) for x in padded[i : i + 3])
            out += a * np.roll(b, 1) * np.roll(c, 2)
    return out


def test_language_prediction_against_brute_force(spark):
    rng = random.Random(16)
    vocabulary = {"de": ["über", "schön", "und", "straße", "nicht"], "en": ["the", "quick", "other", "and", "with"], "es": ["año", "llave", "que", "los", "niño"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(1, 6))), lang, "s", 0) for i in range(90) for lang in [rng.choice("de en es".split())]]
    rows += [(100, "123 ...", "en", "s", 0), (101, None, "de", "s", 0), (102, "und the", None, "s", 0)]
    got = {r["doc_id"]: r for r in language_id.identify_held_out(table(spark, rows)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    names = sorted(vocabulary)
    known = np.array([sum(direct_vector(t) for i, t, lang, *_ in rows if lang == name and not held[i]) for name in names])
    for i, text, *_ in rows:
        v = direct_vector(text)
        assert got[i]["held_out"] == held[i]
        if not v.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        cosine = known @ v / np.linalg.norm(known, axis=1) / np.linalg.norm(v)
        assert got[i]["lang_pred"] == names[int(cosine.argmax())] and got[i]["score"] == pytest.approx(max(0, cosine.max()), abs=1e-4)


def test_language_ties_go_to_the_first_name(spark):
    docs = table(spark, [(1, "same words", None, "s", 0)])
    same = direct_vector("other text")
    assert language_id.identify(docs, ["aa", "bb"], np.array([same, same])).first()["lang_pred"] == "aa"


def test_language_edges(odd, empty):
    got = language_id.identify_held_out(odd).collect()
    assert len(got) == odd.count()
    assert sum(r["lang_pred"] == "und" for r in got) == 4  # two nulls, one empty, one blank
    assert {r["lang_pred"] for r in language_id.identify(odd, [], np.zeros((0, language_id.DIMENSIONS))).collect()} == {"und"}
    assert language_id.identify_held_out(empty).count() == 0


# --- 5 near duplicates


def plain_classes(rows, threshold):
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) if len(t.split()) >= 5 else {tuple(t.lower().split())} for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def edit(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "changed" + str(rng.random())[2:8]
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for group in range(30):
        base = words(rng, 200)
        for copy in range(rng.choice([1, 1, 2, 5])):
            rows.append((i, base if copy == 0 else edit(rng, base, rng.choice([0, 1, 2]))))
            i += 1
        rows.append((i, edit(rng, base, 40)))
        i += 1
    docs = table(spark, [(k, t, "en", "s", 0) for k, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == plain_classes(rows, 0.8)
    kept = [r["doc_id"] for r in near_dedup.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(4)
    base = words(rng, 150)
    rows = [(k, edit(rng, base, 1), "en", "s", 0) for k in range(700)] + [(1000 + k, words(rng, 100), "en", "s", 0) for k in range(50)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert all(got[k] == (0, 700) for k in range(700))
    assert all(got[1000 + k] == (1000 + k, 1) for k in range(50))


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    sampler, agree, want = near_dedup.Sampler(), 0, 0.0
    for _ in range(60):
        keys = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
        a, b = rng.random(300) < 0.9, rng.random(300) < 0.9
        levels_a, levels_b = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
        va, vb = (keys[a], np.exp(levels_a[a] * near_dedup.STEP)), (keys[b], np.exp(levels_b[b] * near_dedup.STEP))
        want += near_dedup.weighted_jaccard(va, vb)
        agree += (sampler.bands(keys[a], levels_a[a]) == sampler.bands(keys[b], levels_b[b])).mean()
    # a band agrees with about the fourth power of the similarity
    assert agree / 60 == pytest.approx((want / 60) ** 4, abs=0.06)


def test_near_duplicate_edges(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    sizes = Counter((r["doc_id"], r["class_size"]) for r in got)
    assert sizes[1, 2] == 2 and sizes[3, 1] == 1 and sizes[2, 1] == 1
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(41)} | {100 + n: 100 for n in range(60)}


def brute_classes(spark, rows):
    """Class by doc_id of all pairs at the threshold, and the pairs, by the operator's own weights."""
    weigher = near_dedup.weigh(near_dedup.distinct_texts(table(spark, [(i, t, "en", "s", 0) for i, t in rows])))
    vectors = {}
    for i, text in rows:
        (_, shingles, tf), = near_dedup._by_text(pa.array([text]))
        vectors[i] = (shingles, np.exp(weigher.levels(shingles, tf) * near_dedup.STEP))
    parent = {i: i for i in vectors}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, j) for i, j in combinations(sorted(vectors), 2) if near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= near_dedup.THRESHOLD - 1e-9]
    for i, j in pairs:
        x, y = sorted((root(i), root(j)))
        parent[y] = x
    return {i: root(i) for i in vectors}, pairs


def test_weights_are_tf_idf(spark):
    rng = random.Random(31)
    shared = words(rng, 5)
    rows = [(i, f"{words(rng, 60)} {shared} {words(rng, 60)}", "en", "s", 0) for i in range(200)]
    weigher = near_dedup.weigh(near_dedup.distinct_texts(table(spark, rows)))

    def weight(text):
        (_, shingles, tf), = near_dedup._by_text(pa.array([text]))
        return np.exp(weigher.levels(shingles, tf) * near_dedup.STEP)[0]

    rare, common = weight(" ".join(rows[0][1].split()[:5])), weight(shared)
    # smooth inverse frequencies: 1 + ln(201 / 2) and 1 + ln(201 / 201), on a grid of 10 % steps
    assert rare == pytest.approx(1 + np.log(201 / 2), rel=0.06) and common == pytest.approx(1, rel=0.06)


def test_group_of_near_copies_counts_as_one_text(spark):
    rng = random.Random(32)
    base = words(rng, 150)
    copies = [(i, edit(rng, base, 2), "en", "s", 0) for i in range(400)]
    others = [(1000 + i, words(rng, 100), "en", "s", 0) for i in range(100)]
    weigher = near_dedup.weigh(near_dedup.distinct_texts(table(spark, copies + others)))
    (_, shingles, tf), = near_dedup._by_text(pa.array([base]))
    (_, single, tf_single), = near_dedup._by_text(pa.array([others[0][1]]))
    assert np.exp((weigher.levels(single, tf_single).mean() - weigher.levels(shingles, tf).mean()) * near_dedup.STEP) < 1.6


def test_frequencies_with_more_shingles_than_counters(spark):
    rng = np.random.default_rng(5)
    rare, often = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (4_000_000, 200))
    counts = np.zeros(near_dedup.SKETCH_ROWS << near_dedup.SKETCH_BITS, np.float32)
    np.add.at(counts, near_dedup._slots(rare).reshape(-1), np.float32(1))
    np.add.at(counts, near_dedup._slots(often).reshape(-1), np.repeat(np.linspace(500, 20_000, 200).astype(np.float32), 1).tolist() * near_dedup.SKETCH_ROWS)
    weigher = near_dedup.Weigher(spark.sparkContext, counts, 40_000, 4_000_000 + 200 * 10_250)
    ones = np.ones(200, np.int64)
    got = np.exp(weigher.levels(often, ones) * near_dedup.STEP)
    want = 1 + np.log(40_001 / (1 + np.linspace(500, 20_000, 200)))
    assert np.allclose(got, want, rtol=0.07)
    top = weigher.levels(rare, np.ones(len(rare), np.int64))
    assert (top == top.max()).mean() > 0.99 and np.exp(top.max() * near_dedup.STEP) > got.max()


def test_recall_on_the_documents(spark):
    """All links at the operator's own weights, by an inverted index of all shingles, lie in one class."""
    rows = near_dedup.distinct_texts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    weigher, got = near_dedup.weigh(rows), {r["node"]: r["comp"] for r in near_dedup.link_documents(rows).collect()}
    table_ = rows.toArrow()
    nodes = table_["node"].to_pylist()
    vectors = [(i, s, np.exp(weigher.levels(s, tf) * near_dedup.STEP)) for i, s, tf in near_dedup._by_text(table_["text"].combine_chunks())]
    total = np.zeros(len(nodes))
    for i, _, w in vectors:
        total[i] = w.sum()
    shingle, owner, weight = (np.concatenate(x) for x in zip(*((s, np.full(len(s), i), w) for i, s, w in vectors)))
    order = np.argsort(shingle, kind="stable")
    shingle, owner, weight = shingle[order], owner[order], weight[order]
    links = []
    for i, s, w in vectors:
        low, n = np.searchsorted(shingle, s, "left"), np.searchsorted(shingle, s, "right") - np.searchsorted(shingle, s, "left")
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, n)), len(nodes))
        found = np.flatnonzero((both >= near_dedup.THRESHOLD * (total + total[i] - both) - 1e-9) & (total > 0))
        links += [(nodes[i], nodes[j]) for j in found.tolist() if j > i]
    held = sum(got.get(a, a) == got.get(b, b) for a, b in links)
    assert len(links) > 30 and held / len(links) >= 0.98


def test_corpus_from_one_template(spark):
    rng = random.Random(33)
    shared, rows = words(rng, 150), []
    for kind in range(300):
        own = words(rng, 27)
        rows += [(2 * kind, f"{shared} {own}"), (2 * kind + 1, f"{shared} {own} {words(rng, 12)}")]
    want, pairs = brute_classes(spark, rows)
    assert len(pairs) >= 300
    assert wrong_classes(spark, rows, want) == []


def test_few_pairs_of_one_template_are_looked_at(spark, monkeypatch):
    """Texts that differ in six words, and a twin of each that differs from it in one more: of all pairs few are verified,
    and every twin is found."""
    rng = random.Random(34)
    shared, rows = words(rng, 400).split(), []
    for kind in range(150):
        own = list(shared)
        for at in rng.sample(range(400), 6):
            own[at] = words(rng, 1) + str(kind)
        twin = list(own)
        twin[rng.randrange(400)] = f"twin{kind}"
        rows += [(2 * kind, " ".join(own)), (2 * kind + 1, " ".join(twin))]
    seen = []
    bound = near_dedup._may_share

    def counted(pairs, sketches, threshold):
        kept = bound(pairs, sketches, threshold)
        seen.append((pairs.count(), kept.count()))
        return kept

    monkeypatch.setattr(near_dedup, "_may_share", counted)
    docs = table(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(150))
    assert sum(kept for _, kept in seen) < 0.1 * 300 * 299 / 2, seen


def test_bound_of_what_texts_share_is_one(spark):
    """It rules out no pair that reaches the threshold."""
    rng = random.Random(35)
    base = words(rng, 80)
    rows = [(i, edit(rng, base, rng.randint(0, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "node long, text string")
    weigher = near_dedup.weigh(df)
    vectors = {i: (s, np.exp(weigher.levels(s, tf) * near_dedup.STEP)) for i, s, tf in near_dedup._by_text(pa.array([t for _, t in rows]))}
    pairs = [(i, j) for i in range(60) for j in range(i)]
    sketches = common.map_arrow(df, near_dedup._binning(weigher), "node long, sketch binary")
    kept = {tuple(r) for r in near_dedup._may_share(spark.createDataFrame(pairs, "a long, b long"), sketches, 0.8).collect()}
    alike = {(i, j) for i, j in pairs if near_dedup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8}
    assert alike <= kept and 0 < len(alike) and len(kept) < len(pairs)


def by_first_word(weigher):
    """In place of the sampled bands one bucket for each first word."""

    def bands(batches):
        for batch in batches:
            found = list(near_dedup._by_text(batch.column("text")))
            node = batch.column("node").take(pa.array([row for row, _, _ in found], pa.int64()))
            key = [zlib.crc32(batch.column("text")[row].as_py().split()[0].encode()) for row, _, _ in found]
            weight = [float(np.exp(weigher.levels(s, tf) * near_dedup.STEP).sum()) for _, s, tf in found]
            yield pa.RecordBatch.from_arrays(
                [node, pa.array([0] * len(found), pa.int32()), pa.array(key, pa.int64()), pa.array(weight, pa.float64())], names=["node", "band", "key", "weight"])

    return bands


def wrong_classes(spark, rows, want):
    docs = table(spark, [(i, t, "en", "s", 0) for i, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    return [i for i in want if got[i] != want[i]]


def test_bucket_with_many_classes_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_banding", by_first_word)
    rng = random.Random(21)
    shared, rows = words(rng, 150), []
    for kind in range(150):
        own = words(rng, 34)
        rows += [(2 * kind, f"{shared} {own}"), (2 * kind + 1, f"{shared} {edit(rng, own, 2)} " + words(rng, rng.randint(0, 6)))]
    want, pairs = brute_classes(spark, rows)
    assert len(pairs) > 120 and len(set(want.values())) > 120
    assert wrong_classes(spark, rows, want) == []


def test_bucket_holds_a_chain_of_drifting_edits(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_banding", by_first_word)
    rng = random.Random(22)
    rows, text = [], words(rng, 200)
    for i in range(120):
        rows.append((i, "first " + text))
        text = edit(rng, text, rng.choice([2, 3]))
    want, _ = brute_classes(spark, rows)
    assert len(set(want.values())) < 60
    assert wrong_classes(spark, rows, want) == []


def test_bucket_of_three_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_banding", by_first_word)
    rng = random.Random(23)
    rows = []
    for i in range(0, 120, 3):
        one = f"key{i} " + words(rng, 120)
        # the first and the last are near copies, the second lies between them in weight
        rows += [(i, one), (i + 1, f"key{i} " + words(rng, 121)), (i + 2, one + " " + words(rng, 3))]
    want, pairs = brute_classes(spark, rows)
    assert len(pairs) == 40
    assert wrong_classes(spark, rows, want) == []


def test_rows_are_dropped_by_broadcast_and_by_shuffle_alike(spark, odd, monkeypatch):
    bad = odd.where("doc_id = 1 or doc_id is null").select("doc_id", F.xxhash64("text").alias("digest"))
    want = sorted(map(str, odd.where("doc_id is not null and doc_id != 1").collect()))
    for limit in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        got = common.without(odd, bad)
        assert got.columns == odd.columns and sorted(map(str, got.collect())) == want


# --- 6 line dedup


def brute_lines(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if not "".join(w).strip(" \t\n\x0b\x0c\r"):
                continue
            if w in first:
                gone |= {at, at + 1, at + 2}
            else:
                first[w] = (i, at)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 12)))) for i in range(300)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(table(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert got == brute_lines(rows)


def test_frequent_windows_are_joined_by_a_broadcast(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(i, "a\nb\nc\n" + "\n".join(rng.choice("defghijklmn") for _ in range(rng.randint(1, 12)))) for i in range(200)]
    docs = table(spark, [(i, t, "en", "s", 0) for i, t in rows])
    for frequent in (1, 20, 1_000_000):
        monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
        assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()} == brute_lines(rows)


def test_line_dedup_edges(odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and got.count() == odd.count()
    rows = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_removed"]) for r in got.collect()}
    assert rows[7, "a\nb\nc"] == (6, 3) and rows[2, None] == (0, 0) and rows[3, ""] == (1, 0)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- 7 quality rules


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_against_brute_force(spark, odd, empty):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab# \n\t é") for _ in range(rng.randint(0, 200))), "en", "s", 0) for i in range(200)]
    docs = table(spark, rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in quality_rules.apply_host_rules(docs).collect()}
    assert got == {i: brute_counts(t) for i, t, *_ in rows}
    assert quality_rules.apply_host_rules(odd).count() == odd.count()
    assert quality_rules.apply_host_rules(empty).count() == 0


def test_bad_host_is_dropped_and_small_host_is_shrunk(spark):
    rng = random.Random(2)
    good = [(i, words(rng, 80), "en", "good", 0) for i in range(60)]
    bad = [(100 + i, words(rng, 80) if i % 10 == 0 else "short", "en", "bad", 0) for i in range(60)]
    small = [(200, "short", "en", None, 0), (201, words(rng, 80), "en", None, 0)]
    got = {r["doc_id"]: r for r in quality_rules.apply_host_rules(table(spark, good + bad + small)).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[100 + i]["kept"] for i in range(60))
    assert got[100]["base_failed"] is False and got[201]["shrunk_rate"] != 0.5


def test_hosts_of_one_document_are_drawn_to_the_mean(spark):
    rows = [(f"h{i}", i % 10 < 3) for i in range(400)]
    got = {r["host"]: r["shrunk_rate"] for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert all(abs(x - 0.3) < 0.001 for x in got.values())


def test_prior_of_simulated_hosts_is_found(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{i}", bool(x)) for i, p in enumerate(rng.beta(2, 6, 1500)) for x in rng.random(rng.integers(1, 12)) < p]
    got = quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()
    # the posterior mean is (failures + mean * strength) / (n + strength); the true strength is 8
    mean = sum(f for _, f in rows) / len(rows)
    strengths = [(r["failures"] - r["shrunk_rate"] * r["n"]) / (r["shrunk_rate"] - mean) for r in got if abs(r["shrunk_rate"] - mean) > 0.02]
    assert max(strengths) - min(strengths) < 1e-6 and 6 < strengths[0] < 10.5


# --- 8 chat


def test_chat_round_trip_and_machine(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\n\\s \\p <\\p|  "
    rows = [(1, 2, "assistant", nasty), (1, 1, "user", nasty), (1, 0, "system", None), (2, 0, "user", "x"), (3, 0, "assistant", "x"), (3, None, "a\nb<|", "late"),
            (None, 300, "assistant", "z"), (None, -5, "user", ""), (4, 0, None, None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    chats = chat.format_chats(turns)
    got = {r["conv_id"]: r for r in chats.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("system", ""), ("user", nasty), ("assistant", nasty)]
    assert [tuple(t) for t in got[3]["turns"]] == [("assistant", "x"), ("a\nb<|", "late")]
    assert [tuple(t) for t in got[None]["turns"]] == [("user", ""), ("assistant", "z")]
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert got[1]["loss"] == nasty and got[2]["loss"] == "" and got[3]["loss"] == "x"
    digest = {r["conv_id"]: r for r in chat.digest_chats(chats).collect()}
    told = f"system\n\nuser\n{nasty}\nassistant\n{nasty}\n"
    assert digest[1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert digest[1]["loss_chars"] == len(nasty) and digest[1]["formatted_chars"] == len(got[1]["formatted"])
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_conversation_keeps_order(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.format_chats(turns.withColumnRenamed("id", "turn").orderBy(F.rand(1))).select(chat.read_back(F.col("formatted")).alias("t"), "valid").first()
    assert [x["text"] for x in r["t"]] == [str(i) for i in range(3000)] and r["valid"]


# --- 9 decontamination


def test_contamination_against_brute_force(spark):
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(12)] + ["É"]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(20)] + [(20, None)]
    docs = []
    for i in range(80):
        body = draw(rng.randint(0, 60))
        if i % 3 == 0:
            body[5:5] = items[i % 20][1].upper().replace("É", "É").split()
        docs.append((i, ", ".join(body), "en", "s", 0))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text, *_ in docs:
        w = split(text)
        hit, ids = set(), set()
        for item, body in items:
            q = split(body)
            for at in range(max(1, len(q) - 9) if q else 0):
                win = q[at : at + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], list(got[i]["item_ids"])) == (len(w), len(hit), len(ids), sorted(ids))


def test_one_word_item_in_every_text_is_linear(spark, monkeypatch):
    docs = table(spark, [(i, "the cat and the dog " * 40, "en", "s", 0) for i in range(50)] + [(50, "nothing here", "en", "s", 0), (51, None, None, None, None)])
    bench = spark.createDataFrame([(1, "THE"), (2, "and the"), (3, "cat and the dog"), (4, "the")], "item_id long, text string")

    def found():
        return {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(docs, bench).collect()}

    want = {i: (200, ["1", "2", "3", "4"]) for i in range(50)} | {50: (0, []), 51: (0, [])}
    assert found() == want
    monkeypatch.setattr(decontaminate, "SHORT_WINDOWS", 1)  # then they are joined
    assert found() == want


def test_contamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Two three FOUR"), (None, "no id here"), (2, None)], "item_id long, text string")
    got = decontaminate.find_contamination(odd, bench).collect()
    assert len(got) == odd.count()
    assert sorted((r["n_hit"], r["item_ids"]) for r in got if r["n_hit"]) == [(3, [""]), (3, ["1"]), (3, ["1"])]
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.find_contamination(empty, bench).count() == 0


# --- 10 toxicity


PLAIN = ["what a stupid idiot you are", "the moron is a loser", "hello there good people of the town", "well known disgusting trash and scum", "an ass of a fox", "see the reed and it s on a page"]


@pytest.fixture(scope="module")
def reader(spark):
    rng = random.Random(1)
    docs = table(spark, [(i, t + " " + words(rng, 5), "en", "s", 0) for i, t in enumerate(PLAIN * 30)])
    return toxicity.Reader(toxicity.character_model(docs))


HIDDEN = {
    "1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "m0r0n": "moron", "$cum": "scum", "id*ot": "idiot",
    "l00ser": "loser", "tra$$h": "trash", "1.d.1.0.t": "idiot", "s.t.u.p.1.d": "stupid", "s t u p 1 d": "stupid", "stu-pid": "stupid",
    "st.up.id": "stupid", "st u pid": "stupid", "i  d  i  o  t": "idiot", "ssttuuppiidd": "stupid", "i$": "is", "@ss": "ass", "a$$": "ass", "f*x": "fox"}


def test_decoding_restores_hidden_words(reader):
    got = {hidden: reader.restored(f"people {hidden} there") for hidden in HIDDEN}
    assert {h: t for h, t in got.items() if t != f"people {HIDDEN[h]} there"} == {}


def test_words_as_written_stay(reader):
    same = "Good people, of the town! 3 of them... reed*** a|b it's well-known $5 (see page 12) and/or"
    assert reader.restored(same) == same
    assert toxicity.decode_words("a|b", reader.model) is None and toxicity.decode_words("well-known", reader.model) is None


def test_words_in_parts_and_what_holds_no_marked_word(reader):
    """Plain parts of up to three letters are put together; with marked words all other readings stay as written."""
    for hidden, word in (("stu pid", "stupid"), ("id iot", "idiot"), ("mor on", "moron")):
        assert reader.restored(f"people {hidden} there") == f"people {word} there"
    marked = np.sort(np.array(toxicity.hash_words(["idiot", "stupid"]), np.uint64))
    same = "back in the 1990s the 3rd 4th 5g ST0P p@ssword C++ x1 of m0r0n"
    assert reader.restored(same, marked) == same
    assert reader.restored("you 1d10t in the 1990s, stu pid they say 3rd", marked) == "you idiot in the 1990s, stupid they say 3rd"
    rows = list(reader.read(pa.array(["in the 1990s", "an 1d10t 3rd", None]), marked=marked))
    assert [bool(np.isin(own, marked).any()) for _, own, _ in rows] == [False, True, False]


def test_a_long_token_of_signs_is_read_in_time_that_grows_with_it(reader):
    took = []
    for n in (5_000, 50_000):
        began = time.perf_counter()
        reader.restored("x*y*" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 1 and took[1] < 15


def test_only_restored_words_count(reader):
    (_, own, added), = reader.read(pa.array(["people 1d10t there"]))
    data = np.frombuffer(b"people idiot there", np.uint8)
    named = toxicity.named_features(data, np.array([0, len(data)]))
    assert set(own.tolist()) == set(named) and set(toxicity.hash_words(["people", "idiot", "there"])) <= set(named)
    assert set(added.values()) == {"idiot", "idio*", "idiot*"} and {"peop*", "peopl*"} < set(named.values())


def test_search_for_marked_words_misses_none(reader):
    rng = random.Random(12)
    marked = ["idiot", "ass", "fool", "été", "loser", "dass*"]
    data = np.frombuffer("idiot ass fool été loser dasso".encode(), np.uint8)
    hashes = {h for h, name in toxicity.named_features(data, np.array([0, len(data)])).items() if name in marked}
    assert len(hashes) == len(marked)
    pattern = toxicity.reaching(marked)
    made = [" ".join(rng.choice(["a", "s", "i", "d", "o", "t", "f", "l", "é", "1", "0", "$", "5", "*", "**", ".", "-", " ", "!", "ss", "lo", "ser", "idi", "ot", "|"]) for _ in range(rng.randint(1, 9))).replace(" ", rng.choice(["", "", " "])) for _ in range(8000)]
    column = pa.array([*made, *(f"you {h} there" for h in HIDDEN), "ÉÉtété é", "étéé!", None, ""])
    whole = {row: hashes & set(own.tolist()) for row, own, _ in reader.read(column)}
    fast = {row: hashes & set(own.tolist()) for row, own, _ in reader.read(column, pattern)}
    assert fast == whole and sum(map(bool, whole.values())) > 60


def test_search_is_quick_on_signs(reader):
    pattern = toxicity.reaching(["illness", "illicit*", "idiot", "stool*", "toilets"])
    column = pa.array(["a" + "1|" * 4000 + "x", "| 1 " * 4000 + "a", "a!1|i" * 3000, "".join(f"{c}1|1|1|1|1|" for c in "illiilliil" * 60)])
    began = time.perf_counter()
    assert len(list(reader.read(column, pattern))) == 4
    assert time.perf_counter() - began < 20


def test_toxic_scores_against_brute_force(spark):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        w = words(rng, 12).split() + (["idiot" if i % 2 else "1d10t", "stupid"][: rng.randint(1, 2)] if bad else ["people"])
        rows.append((i, " ".join(rng.sample(w, len(w))), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in toxicity.score_held_out(docs, table(spark, labels, LABELS)).collect()}
    model = toxicity.character_model(docs)
    sets = {}
    for i, text, *_ in rows:
        out = set()
        for token in text.split():
            odd = re.search(r"[^a-z]|(.)\1", token)
            for word in (toxicity.decode_words(token, model) if odd else None) or re.findall("[a-z]+", token):
                out |= {word} | {word[:k] + "*" for k in toxicity.PREFIXES if len(word) >= k}
        sets[i] = out
    known = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    n1, n0 = sum(known.values()), len(known) - sum(known.values())
    weights = {}
    for word in set().union(*sets.values()):
        a, b = (sum(word in sets[i] for i, t in known.items() if t == side) for side in (1, 0))
        share = (a + b) / (n1 + n0)
        cells = [(a, n1 * share), (b, n0 * share), (n1 - a, n1 * (1 - share)), (n0 - b, n0 * (1 - share))]
        llr = 2 * sum(o * np.log(o / e) for o, e in cells if o)
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        if llr >= toxicity.MIN_LLR and odds >= toxicity.MIN_LOG_ODDS:
            weights[word] = odds
    assert {"idiot", "stupid"} <= set(weights)
    total = {i: sum(weights.get(w, 0.0) for w in sets[i]) for i in sets}
    beta = np.zeros(2)
    x = np.array([[round(total[i], 1), 1.0] for i in known])
    y = np.array([known[i] for i in known], float)
    for _ in range(20_000):  # plain gradient steps on the same penalised likelihood
        beta += 0.02 * (x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - np.array([1.0, 0.1]) * beta) / len(y) * 10
    for i, r in got.items():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(beta[0] * total[i] + beta[1]))), abs=2e-3)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.ones(toxicity.STATES), (toxicity.STATES, toxicity.STATES)))

    def total(letters, cost):
        a = b = 0
        s = -cost
        for c in [*(ord(x) - 96 for x in letters), 0]:
            s += model[a, b, c]
            a, b = b, c
        return s

    for token in ("a1b0", "ss$$4", "1|1", "x*z"):
        paths = [("", 0.0)]
        for ways in toxicity._lattice(token):
            paths = [(w + x, c + d) for w, c in paths for x, d in ways]
        assert toxicity.decode(token, model) == max(paths, key=lambda p: total(*p))[0]


def test_toxic_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_held_out(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hits, all_, false = (sum(f(r) for r in got) for f in (lambda r: r["toxic"] and r["predicted"], lambda r: r["toxic"], lambda r: not r["toxic"] and r["predicted"]))
    assert hits / all_ > 0.85 and false / len(got) < 0.01


def test_toxic_edges(spark, odd, empty):
    labels = table(spark, [(1, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1)], LABELS)
    got = toxicity.score_held_out(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_held_out(odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_held_out(empty, labels).count() == 0
