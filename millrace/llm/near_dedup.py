"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, mix, slices, texts
from .common import Scope, durable, map_arrow, needed, without

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 4
#: Weights lie on a grid of 10 % steps, so that the samples of a weight can be looked up.
STEP = np.log(1.1)
#: Random rows (r, c, beta) of the sampling; a shingle takes the row of its hash.
TABLE = 4096
SEED = 20240229
#: The document-frequency sketch: rows of 2^SKETCH_BITS counters, 4 MiB, however large the corpus is.
SKETCH_ROWS = 2
SKETCH_BITS = 19
SEGMENT = 1 << 14
#: The segment that holds the sums: texts and shingles.
SUMS = -1
SKETCH_SALTS = 32
#: Frequencies below the FLOOR-th part of all shingles count as that much: a few times the mean load of a counter.
FLOOR = 1 << 17
#: A text's least shingle hashes, by which groups of near copies are known, and the counters of these.
LEAST = 8
LEAST_BITS = 20
SALT_ROWS = 512
#: Sums of a text's weights by shingle hash, which bound what two texts share: 1 KiB a text.
BINS = 512
#: Slack of the bounds that rule pairs out, for sums of doubles in different order.
SLACK = 1e-6


def _by_text(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted shingles, term frequencies) of every text with words."""
    for a, b in slices(column):
        words = Words(*texts(column.slice(a, b - a)))
        hashes, at = words.shingles(SHINGLE)
        ends = np.searchsorted(at, words.first)
        for i in range(b - a):
            if ends[i] < ends[i + 1]:
                yield a + i, *np.unique(hashes[ends[i] : ends[i + 1]], return_counts=True)


def _slots(shingles: np.ndarray) -> np.ndarray:
    """The counters of each shingle, one in each row of the sketch."""
    bits, mask = np.uint64(SKETCH_BITS), np.uint64((1 << SKETCH_BITS) - 1)
    return np.stack([((shingles >> (bits * np.uint64(i))) & mask).astype(np.int64) + (i << SKETCH_BITS) for i in range(SKETCH_ROWS)])


def _least_slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles[:LEAST] & np.uint64((1 << LEAST_BITS) - 1)).astype(np.int64)


def _least_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, np.int64), *(_least_slots(s) for _, s, _ in _by_text(batch.column("text")))]
        slots, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n)], names=["slot", "n"])


def group_sizes(rows: DataFrame) -> np.ndarray:
    """By counter of a least shingle: how many texts have it among their least, less what other shingles add."""
    got = map_arrow(needed(rows, "text"), _least_rows, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.zeros(1 << LEAST_BITS, np.float32)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return np.maximum(1, counts - counts.mean())


def _counting(sizes: Broadcast | None) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH_ROWS << SKETCH_BITS, np.float32)
        sums = np.zeros(SEGMENT, np.float32)
        for batch in batches:
            for _, shingles, _ in _by_text(batch.column("text")):
                share = 1 / sizes.value[_least_slots(shingles)].max() if sizes else 1.0
                slots = _slots(shingles)
                np.add.at(counts, slots.reshape(-1), np.float32(share))
                sums[:2] += share, share * len(shingles)
        parts = counts.reshape(-1, SEGMENT)
        used = np.flatnonzero(parts.any(axis=1))
        blobs = [parts[i].tobytes() for i in used] + [sums.tobytes()]
        salt = np.full(len(blobs), TaskContext.get().partitionId() % SKETCH_SALTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), SUMS], pa.int32()), pa.array(salt), pa.array(blobs, pa.binary())], names=["segment", "salt", "counts"])

    return count


def _sum_segment(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SEGMENT)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["segment", "counts"])


def count_shingles(rows: DataFrame, sizes: Broadcast | None = None) -> tuple[np.ndarray, float, float]:
    """(sketch, texts, shingles): in how many texts each shingle occurs, by counters in SKETCH_ROWS rows.

    All texts are counted; with `sizes` the texts of a group of near copies count together about as one. A task
    sends its counters in segments, which are summed in two steps; the sum of all has a fixed size.
    """
    made = map_arrow(needed(rows, "text"), _counting(sizes), "segment int, salt int, counts binary")
    part = made.groupBy("segment", "salt").applyInArrow(_sum_segment, "segment int, counts binary")
    summed = part.groupBy("segment").applyInArrow(_sum_segment, "segment int, counts binary").toArrow()
    found = {segment: np.frombuffer(blob, np.float32) for segment, blob in zip(summed["segment"].to_pylist(), summed["counts"].to_pylist(), strict=True)}
    sums = found.pop(SUMS, np.zeros(SEGMENT, np.float32))
    counts = np.zeros((SKETCH_ROWS << SKETCH_BITS) // SEGMENT * SEGMENT, np.float32).reshape(-1, SEGMENT)
    for segment, own in found.items():
        counts[segment] = own
    return counts.reshape(-1), float(sums[0]), float(sums[1])


class Weigher:
    """TF-IDF weights on a grid: (1 + ln tf) * (1 + ln((1 + n) / (1 + df))).

    df is the least of a shingle's counters less their mean load, and `floor` at least."""

    def __init__(self, context: SparkContext, counts: np.ndarray, number: float, shingles: float):
        load = shingles / (1 << SKETCH_BITS)
        floor = max(1.0, shingles / FLOOR)
        df = np.maximum(counts - (load if floor > 1 else 0), floor)
        # 4 MiB, sent to the executors once and not with every function that weighs.
        self.shared = context.broadcast(np.log(np.maximum(1, 1 + np.log((1 + number) / (1 + df)))).astype(np.float32))

    def levels(self, shingles: np.ndarray, tf: np.ndarray) -> np.ndarray:
        log_idf = self.shared.value[_slots(shingles)].max(axis=0)
        return np.rint((log_idf + np.log1p(np.log(tf))) / STEP).astype(np.int64)


def weigh(rows: DataFrame) -> Weigher:
    """The weights of the distinct texts `rows` (text)."""
    context = rows.sparkSession.sparkContext
    return Weigher(context, *count_shingles(rows, context.broadcast(group_sizes(rows))))


class Sampler:
    """Improved consistent weighted sampling with its random numbers in a table."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        shape = (BANDS * ROWS, TABLE)
        self.r, self.log_c = rng.gamma(2.0, 1.0, shape), np.log(rng.gamma(2.0, 1.0, shape))
        self.beta = rng.random(shape)
        self.made: list[np.ndarray] = []
        self.joined = np.zeros((BANDS * ROWS, 0), np.float32)

    def _t(self, level: int | np.ndarray, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return np.floor(level * STEP / r + beta)

    def _reach(self, level: int) -> None:
        while len(self.made) <= level:
            t = self._t(len(self.made), self.r, self.beta)
            self.made.append((self.log_c - self.r * (t - self.beta) - self.r).astype(np.float32))
            self.joined = np.concatenate([self.joined, self.made[-1]], axis=1)

    def bands(self, shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """A key for each band of a document; shingles are sorted, so ties fall to the least hash."""
        self._reach(int(levels.max()))
        k = np.arange(BANDS * ROWS)
        best = np.full(BANDS * ROWS, np.inf, np.float32)
        pick = np.zeros(BANDS * ROWS, np.int64)
        rows = (shingles & np.uint64(TABLE - 1)).astype(np.int64)
        for at in range(0, len(shingles), 1 << 15):
            values = np.take(self.joined, levels[at : at + (1 << 15)] * TABLE + rows[at : at + (1 << 15)], axis=1)
            least = values.argmin(axis=1)
            better = values[k, least] < best
            best = np.where(better, values[k, least], best)
            pick = np.where(better, at + least, pick)
        row = rows[pick]
        t = self._t(levels[pick], self.r[k, row], self.beta[k, row]).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            sample = mix(shingles[pick] + mix(t + np.uint64(1)))
            factor = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
            return mix((sample.reshape(BANDS, ROWS) * factor).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


_SAMPLER: list[Sampler] = []


def _banding(weigher: Weigher) -> Callable:
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SAMPLER:
            _SAMPLER.append(Sampler())
        for batch in batches:
            rows, keys, weights = [], [], []
            for row, shingles, tf in _by_text(batch.column("text")):
                levels = weigher.levels(shingles, tf)
                rows.append(row)
                keys.append(_SAMPLER[0].bands(shingles, levels))
                weights.append(float(np.exp(levels * STEP).sum()))
            node = batch.column("node").take(pa.array(np.repeat(np.array(rows, np.int64), BANDS)))
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(rows))
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            weight = pa.array(np.repeat(np.array(weights, np.float64), BANDS))
            yield pa.RecordBatch.from_arrays([node, pa.array(band), pa.array(key.view(np.int64)), weight], names=["node", "band", "key", "weight"])

    return bands


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sparse vectors (sorted keys, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def _vectors(column: pa.Array, weigher: Weigher) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {row: (s, np.exp(weigher.levels(s, tf) * STEP)) for row, s, tf in _by_text(column)}


def _verifier(weigher: Weigher) -> Callable:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                sides = []
                for node, text in (("a", "text_a"), ("b", "text_b")):
                    _, first, which = np.unique(part.column(node).to_numpy(), return_index=True, return_inverse=True)
                    vectors = _vectors(part.column(text).take(pa.array(first)), weigher)
                    sides.append([vectors.get(i) for i in which.tolist()])
                sim = [weighted_jaccard(x, y) if x and y else 0.0 for x, y in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    return verify


def _prefixes(weigher: Weigher, order: Broadcast, threshold: float) -> Callable:
    """(node, token, weight, rest): the rarest shingles of a text, as far as a text can share none of them and
    still reach the threshold; rest is the weight of a shingle and all after it."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        node, weight = (np.repeat(np.array([r[i] for r in rows], t), [len(r[1]) for r in rows]) for i, t in ((0, np.int64), (3, np.float64)))
        token, rest = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(token.view(np.int64)), pa.array(weight), pa.array(rest)], names=["node", "token", "weight", "rest"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for row, shingles, tf in _by_text(batch.column("text")):
                place = np.lexsort((shingles, order.value[_slots(shingles)].min(axis=0)))
                rest = np.cumsum(np.exp(weigher.levels(shingles, tf) * STEP)[place][::-1])[::-1]
                kept = int(np.count_nonzero(rest >= (threshold - SLACK) * rest[0]))
                rows.append((nodes[row], shingles[place[:kept]], rest[:kept], rest[0]))
                size += kept
                if size > 1 << 17:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return prefixes


def _binning(weigher: Weigher) -> Callable:
    """(node, sketch): the weight of a text and, rounded up, its part in each of BINS groups of shingles."""
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sketches = [], []
            for row, shingles, tf in _by_text(batch.column("text")):
                weights = np.exp(weigher.levels(shingles, tf) * STEP)
                bins = np.bincount((mix(shingles) % np.uint64(BINS)).astype(np.int64), weights, BINS)
                unit = bins.max() / 65535
                rows.append(row)
                sketches.append(np.array([weights.sum(), unit]).tobytes() + np.ceil(bins / unit - SLACK).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.array(rows, np.int64))), pa.array(sketches, pa.binary())], names=["node", "sketch"])

    return binned


def _bounding(threshold: float) -> Callable:
    def sums(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 16 + 2 * BINS)
        head = raw[:, :16].copy().view(np.float64)
        return head[:, 0], raw[:, 16:].copy().view(np.uint16) * head[:, 1:]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                (total_a, bins_a), (total_b, bins_b) = sums(part.column("sketch_a")), sums(part.column("sketch_b"))
                both = np.minimum(bins_a, bins_b).sum(axis=1)
                kept = pa.array(both * (1 + threshold) >= (threshold - SLACK) * (total_a + total_b))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(kept) for c in ("a", "b")], names=["a", "b"])

    return bound


def _may_share(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts may reach the threshold: in each group of shingles two texts share at most the lesser of
    their weights. Texts of one template, which share most shingles, mostly differ by enough in these sums, so that
    their pairs needn't be looked at with whole texts."""
    side = lambda c: sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b"), _bounding(threshold), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of `links` (a, b): comp is the least node of the connected component.

    Rounds of taking the least label among neighbours and then the label of that label, each written to the
    shared folder, until none changes. Stars and chains of length n end in about log n rounds.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "dedup_links")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "dedup_labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        labels = durable(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "dedup_labels")
        if labels.where("old != comp").limit(1).count() == 0:
            return labels.select("node", "comp")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes `labels` (node, comp) after further links (a, b) of nodes, with or without a class.

    Only the classes that the links join are looked at, so the rounds of `components` run over these few."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    joined = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.coalesce("comp_a", "a").alias("ca"), F.coalesce("comp_b", "b").alias("cb"))
    joined = durable(joined, "dedup_merges")
    merged = components(joined.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("comp", "least")
    new = joined.select(F.col("a").alias("node"), F.col("ca").alias("comp")).union(joined.select("b", "cb"))
    every = labels.union(new).distinct().join(merged, "comp", "left")
    return durable(every.select("node", F.coalesce("least", "comp").alias("comp")), "dedup_labels")


def _may_link(weight: Column, other: Column, threshold: float) -> Column:
    """Texts whose total weights differ by more than the threshold allows can't reach it."""
    return F.least(weight, other) >= (threshold - SLACK) * F.greatest(weight, other)


def _stars(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b): every member of a bucket with the bucket's hub, the member with most band mates.

    A bucket of n members is dealt in ceil(n / SALT_ROWS) parts, each with a copy of the hub."""
    parts = F.ceil(F.col("n") / SALT_ROWS)
    hubs = members.groupBy("bucket", "n").agg(F.max(F.struct("degree", "node", "weight")).alias("hub"))
    hubs = hubs.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("hub.node").alias("other"), F.col("hub.weight").alias("other_weight"))
    dealt = members.select("node", "weight", "bucket", F.pmod(F.xxhash64("node", "bucket"), parts).alias("part"))
    linkable = dealt.join(hubs, ["bucket", "part"]).where((F.col("node") != F.col("other")) & _may_link(F.col("weight"), F.col("other_weight"), threshold))
    return linkable.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of buckets with members of several classes."""
    known = members.select("node", "bucket").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    return known.join(durable(split.select("bucket"), "dedup_split"), "bucket").select("node").distinct()


def _contested(tokens: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The rows of tokens that several classes hold.

    major: the row's class has most of the token's rows. index: the token lies so early in the text that it may be
    the first common one with a text of no less weight; what comes later is only looked up."""
    index = F.col("rest") * (1 + threshold) >= (2 * threshold - SLACK) * F.col("weight")
    known = tokens.join(labels, "node", "left").withColumns({"comp": F.coalesce("comp", "node"), "index": index})
    classes = known.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if("index").alias("first"))
    lists = classes.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("first").alias("first"))
    lists = durable(lists.where("classes > 1 and first > 0").select("token", F.col("top.comp").alias("top"), "n"), "dedup_lists")
    return known.join(lists, "token").select("token", "node", "comp", "weight", "rest", "index", (F.col("comp") == F.col("top")).alias("major"), "n")


def _token_pairs(contested: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different classes that share a token and can reach the threshold, each once.

    What two texts share lies at their first common token or after it, so it weighs at most the lesser rest there.
    The lighter text's token has to be an index row. Rows of a token's largest class only meet rows of its others.
    The rows looked up are dealt in parts of about SALT_ROWS, and an index row has a copy for each part."""
    parts = F.ceil(F.col("n") / SALT_ROWS)
    rows = F.struct("rest", "node", "comp", "weight")
    left = contested.where("index").select("token", "major", rows.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    right = contested.select("token", "major", rows.alias("y"), F.pmod(F.xxhash64("node", "token"), parts).alias("part"))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        lighter = (F.col("x.weight") < F.col("y.weight")) | ((F.col("x.weight") == F.col("y.weight")) & (F.col("x.node") < F.col("y.node")))
        enough = F.least("x.rest", "y.rest") * (1 + threshold) >= (threshold - SLACK) * (F.col("x.weight") + F.col("y.weight"))
        return x.drop("major").join(y.drop("major"), ["token", "part"]).where(
            lighter & (F.col("x.comp") != F.col("y.comp")) & _may_link(F.col("x.weight"), F.col("y.weight"), threshold) & enough)

    pairs = joined(left.where("not major"), right).union(joined(left.where("major"), right.where("not major")))
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def link_documents(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, comp): the near-duplicate class of every text of `rows` (node, text), all different, that is linked to another."""
    weigher = weigh(rows)
    bands = durable(map_arrow(rows, _banding(weigher), "node long, band int, key long, weight double"), "dedup_bands")
    # Written first, as are other aggregates that are joined back: Spark splits hot keys only of joins whose sides are plain.
    buckets = durable(bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dedup_buckets")
    entries = durable(bands.join(buckets, ["band", "key"]).select("node", F.xxhash64("band", "key").alias("bucket"), "weight", "n"), "dedup_entries")
    degree = durable(entries.groupBy("node").agg(F.sum("n").alias("degree")), "dedup_degree")
    members = durable(entries.join(degree, "node"), "dedup_members")
    sources = durable(rows.join(degree.select("node"), "node", "left_semi"), "dedup_sources")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sources.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = sources.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        with_texts = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return durable(map_arrow(with_texts, _verifier(weigher), "a long, b long, sim double").where(F.col("sim") >= threshold - 1e-9), "dedup_verified")

    tried = durable(_stars(members, threshold), "dedup_pairs")
    labels = components(verified(tried))
    # Buckets of two are now settled. In the others any two members of different classes may still be a pair.
    open_ = durable(sources.join(_unsettled(members.where("n > 2"), labels), "node", "left_semi"), "dedup_open")
    if not open_.limit(1).count():
        return labels
    order = open_.sparkSession.sparkContext.broadcast(count_shingles(open_)[0])
    tokens = durable(map_arrow(open_, _prefixes(weigher, order, threshold), "node long, token long, weight double, rest double"), "dedup_tokens")
    contested = durable(_contested(tokens, labels, threshold), "dedup_contested")
    met = durable(_token_pairs(contested, threshold).join(tried, ["a", "b"], "left_anti"), "dedup_met")
    sketches = durable(map_arrow(open_, _binning(weigher), "node long, sketch binary"), "dedup_sketches")
    pairs = durable(_may_share(met, sketches, threshold), "dedup_pairs")
    return merge(labels, verified(pairs))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, text): every text once; node is xxhash64 of it."""
    rows = needed(docs, "text").where("text is not null").select(F.xxhash64("text").alias("node"), "text")
    return durable(rows.dropDuplicates(["node"]), "dedup_texts")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, digest, class_id, class_size.

    Texts are sets of five-word shingles (words are runs of other than blanks, A-Z made small; a text of
    fewer words is one shingle), weighted by TF-IDF over the distinct texts of the whole corpus. Texts of a group
    of near copies, which share one of their least shingle hashes, count together about as one, so that what
    thousands of copies share isn't taken for common. 48 consistent weighted samples in 12 bands of 4 make the
    candidates: a pair at similarity 0.8 shares a band with probability 0.998. Every member of a bucket is
    compared with its hub. The members of buckets that then still hold several classes are joined exactly: any two
    of different classes that share one of their rarest shingles, without which no pair reaches the threshold, are
    compared unless their weights rule the pair out. Pairs with a weighted Jaccard similarity of `threshold` or
    more are linked, and linked documents, with byte-identical ones, form a class. class_id is its least doc_id.

    A null text, or one without words, is a class of its own. Repeated rows are documents of one class.
    A null doc_id never is a class_id unless its whole class has none. An empty table gives an empty
    result. Other columns are not read.
    """
    labels = link_documents(distinct_texts(docs), threshold)
    rows = needed(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("digest"), F.coalesce(F.col("text").rlike(r"[^\x00\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    known = durable(
        rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left")
        .select("doc_id", "digest", "worded", F.coalesce("comp", "digest").alias("comp")), "dedup_rows")
    worded = known.where("worded")
    classes = worded.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = worded.join(durable(classes, "dedup_sizes"), "comp", "left").select(
        "doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("n", F.lit(1).cast("long")).alias("class_size"))
    single = known.where("not worded").select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return joined.union(single)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each class: the one with the least doc_id.

    Rows that repeat the kept one's doc_id and text are dropped too.
    """
    with Scope(docs.sparkSession) as own:
        classes = durable(near_duplicates(docs, threshold), "dedup_classes")
        own.drop(but_last=1)  # texts and candidates, which nothing reads from here on
    kept = without(docs, classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))))
    # Only rows that are there twice go through a shuffle of whole rows.
    twice = classes.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")
    once = without(kept, twice)
    rows = kept.select(F.struct("*").alias("row")).withColumn("digest", F.xxhash64("row.text")).withColumn("id", F.col("row.doc_id"))
    again = twice.select(F.col("doc_id").alias("twice_id"), F.col("digest").alias("twice_digest"))
    same = F.col("id").eqNullSafe(F.col("twice_id")) & (F.col("digest") == F.col("twice_digest"))
    return once.union(rows.join(again, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*"))
