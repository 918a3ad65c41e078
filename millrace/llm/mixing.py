"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Every source's documents are laid end to end in a hashed order; the source's words are cut into blocks of
   equal length. A prefix sum in two levels (hash buckets, then inside a bucket) gives each document its place,
   so no task sees a whole source.
2. Targets become exact block quotas per source.
3. The quotas of the root are split in halves among output shards, level by level: at each node a
   multivariate-hypergeometric draw says how many blocks of each source go left, the rest goes right.
   Sums stay exact. A shard so holds the sources in the proportions that a full shuffle would give it.
4. Each shard draws its quota as a run of slots of the source's block permutation, a keyed bijection; runs of
   different shards are disjoint. A second epoch of a source uses another permutation.
5. Inside a shard, pieces are put in a hashed order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let, needed, words_of

SHARE = 1.5
MAX_EPOCHS = 2
WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS = 4096
MIN_BLOCKS = 1024
#: Words that a shard should hold, and the least and most shards; beyond these shards grow, and are written in parts.
SHARD_WORDS = 1 << 24
SHARDS = (16, 1024)
#: Words in a part of a shard, which is one task's work.
PART_WORDS = 1 << 22
ROWS_PER_BUCKET = 4096
ROWS_PER_TASK = 1 << 14
#: Sources carry a weight each and stand in one row of the quota tree; more of them raise an error.
MAX_SOURCES = 100_000
#: Rounds of the block permutation, and steps that bring a block back into range: by then none is left outside.
ROUNDS = 3
WALKS = 64


def unit(*cols: Column) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Add `target` to one row per source (src, src_null, source_size).

    Sources in code-point order, null last, take the weights in turn. The targets sum to `share` times all
    words; a target stops at twice its source's size and the excess goes to the others by weight. With the
    sources sorted by cap over weight, the stopped ones are a prefix: the first where the level that the
    rest then needs stays under the next ratio. The table has one row per source, so its windows are small.
    """
    order = Window.orderBy("src_null", F.col("src"))
    cycle = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, len(weights)))
    rows = sources.withColumn("weight", cycle).withColumn("cap", F.lit(float(MAX_EPOCHS)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "src_null", "src")
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("wanted"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    rows = rows.withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("weight_from"))
    below = rows.withColumn("level", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")))
    return below.withColumn("open_level", F.max("level").over(everything)).select(
        "src", "src_null", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("open_level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """One draw by inversion: the number of good among `draws` of `total`, from u in (0, 1).

    Probabilities relative to the lower end of a span of 8 standard deviations around the mean follow from
    their ratios; what lies outside is below the precision of a double.
    """
    mean = draws * good / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(
        F.greatest(mean * (1 - good / F.greatest(total, F.lit(1.0))) * (total - draws) / F.greatest(total - 1, F.lit(1.0)), F.lit(0.0))
    )
    low = F.greatest(F.lit(0.0), draws + good - total, F.floor(mean - 8 * spread - 2).cast("double"))
    high = F.greatest(low, F.least(draws, good, F.ceil(mean + 8 * spread + 2).cast("double")))

    def bind(v: Column) -> Column:
        lo, steps = v["low"], F.sequence(F.lit(1), (v["high"] - v["low"]).cast("int") + 1)

        def after(k: Column, p: Column) -> Column:
            at = lo + k - 1
            return p * (v["good"] - at) * (v["draws"] - at) / ((at + 1) * (v["total"] - v["good"] - v["draws"] + at + 1))

        sums = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
            lambda a, k: F.struct(after(k, a["p"]).alias("p"), (a["sum"] + a["p"]).alias("sum")),
        )["sum"]
        return F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), (v["u"] * sums).alias("left"), lo.alias("at")),
            lambda a, k: F.struct(
                after(k, a["p"]).alias("p"), (a["left"] - a["p"]).alias("left"),
                F.when((a["left"] > a["p"]) & (a["at"] < v["high"]), a["at"] + 1).otherwise(a["at"]).alias("at"),
            ),
            lambda a: a["at"],
        )

    given = F.struct(
        total.alias("total"), good.alias("good"), draws.alias("draws"), u.alias("u"), low.alias("low"), high.alias("high")
    )
    return let(given, bind)


def _draw_at(seed: int, level: int):
    """One step of a node's multivariate draw: a source's part of the left half, given what is drawn already."""

    def step(acc: Column, item: Column) -> Column:
        drawn = _hypergeometric(acc["total"], item["quota"], acc["draws"], unit(F.lit(seed), F.lit(level), item["node"], item["at"]))
        return let(drawn, lambda k: F.struct(
            F.concat(acc["taken"], F.array(k)).alias("taken"),
            (acc["total"] - item["quota"]).alias("total"), (acc["draws"] - k).alias("draws")))

    return step


def split_quotas(sources: DataFrame, shards: int = SHARDS[0], seed: int = 0) -> DataFrame:
    """(rank, ends): for the source of each rank the running totals of its shards' block quotas.

    The tree needs one row per node with the sources' quotas in an array: sources are the few components
    that carry a weight, not documents. `shards` is a power of two.
    """
    node = sources.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(
        F.lit(0).alias("node"), F.transform("q", lambda x: x["quota"].cast("double")).alias("quotas")
    )
    level = 1
    while level < shards:
        whole = F.aggregate("quotas", F.lit(0.0), lambda a, x: a + x)
        start = F.struct(
            F.array().cast("array<double>").alias("taken"), whole.alias("total"), F.floor(whole / 2).cast("double").alias("draws")
        )

        items = F.transform("quotas", lambda x, i: F.struct(x.alias("quota"), i.alias("at"), F.col("node").alias("node")))
        node = node.select("node", "quotas", F.aggregate(items, start, _draw_at(seed, level), lambda a: a["taken"]).alias("left"))
        node = node.select(
            "node",
            F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("quotas")), F.struct(
                F.lit(1).alias("side"), F.zip_with("quotas", "left", lambda q, h: q - h).alias("quotas")))).alias("half"),
        ).select((2 * F.col("node") + F.col("half.side")).alias("node"), F.col("half.quotas").alias("quotas"))
        level *= 2
    leaves = node.select("node", F.posexplode("quotas").alias("rank", "blocks"))
    return (
        leaves.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("node", "blocks"))).alias("leaves"))
        .select("rank", F.slice(F.aggregate(
            "leaves", F.array(F.lit(0).cast("long")),
            lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["blocks"].cast("long")))), 2, shards).alias("ends"))
    )


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, shards: int | None = None,
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, digest, size, source_size, target, taken, pieces.

    pieces: array of (shard, epoch, word_from, word_to, order), the stretches of the document's words
    (0-based, end exclusive) that the mix takes, with the output shard and the place in that shard's local
    order. taken is the sum of their lengths. A source's taken words differ from its target by less than
    two blocks; a source has at least 1,024 blocks (or one a word), so that small ones come near too.
    No document is taken more than twice. The same input gives the same mix. Without `shards`, a power of two, it is
    such that a shard has about SHARD_WORDS, between the bounds of SHARDS. Over MAX_SOURCES sources raise an error.

    Size counts maximal runs of other than the six ASCII blanks. Null and empty texts have size 0 and no
    pieces. A null source is a source of its own, last in order. Rows that repeat a doc_id are separate
    documents. An empty table gives an empty result. Other columns are not read.
    """
    sized = needed(docs, "doc_id", "text", "source").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("src_null"),
        F.xxhash64("text").alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("place"),
    )
    sized = durable(sized, "mix_sizes")
    rows = sized.count()
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    bucket = F.floor((F.shiftrightunsigned("place", 11).cast("double") / F.lit(float(1 << 53))) * buckets).cast("long")
    # The hashed order as unsigned number; buckets cut it in that order, so their number doesn't change the result.
    sized = sized.withColumn("bucket", bucket).withColumn("order", F.shiftrightunsigned("place", 1))
    sums = durable(sized.groupBy("src", "src_null", "bucket").agg(F.sum("size").alias("words")), "mix_buckets")
    sources = source_targets(
        sums.groupBy("src", "src_null").agg(F.sum("words").alias("source_size")), weights, share)
    blocks = F.greatest(F.lit(1), F.least(
        F.col("source_size"), F.greatest(F.lit(MIN_BLOCKS), F.ceil(F.col("source_size") / block_words)))).cast("long")
    sources = sources.withColumn("blocks", blocks).select(
        "*",
        F.when(F.col("source_size") > 0, F.least(
            MAX_EPOCHS * F.col("blocks"),
            F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0).cast("long").alias("quota"),
        (F.row_number().over(Window.orderBy("src_null", "src")) - 1).alias("rank"),
    )
    sources = durable(sources, "mix_sources")
    known = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target"), F.lit(0.0)).alias("words")).first()
    if known["n"] > MAX_SOURCES:
        raise ValueError(f"{known['n']} sources; at most {MAX_SOURCES} can carry weights")
    if shards is None:
        shards = SHARDS[0]
        while shards < SHARDS[1] and shards * SHARD_WORDS < known["words"]:
            shards *= 2
    sources = sources.join(split_quotas(sources, shards, seed), "rank", "left")
    offsets = sums.join(sources, ["src", "src_null"]).select(
        "src", "src_null", "bucket", "source_size", "target", "blocks", "ends", "rank",
        (F.sum("words").over(Window.partitionBy("src", "src_null").orderBy("bucket")) - F.col("words")).alias("before"),
    )
    inside = Window.partitionBy("src", "src_null", "bucket").orderBy("order", "place", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # A fixed number of tasks: few bytes a row, but work for each of them.
    dealt = sized.repartition(max(1, -(-rows // ROWS_PER_TASK)), "src", "src_null", "bucket")
    placed = dealt.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["src", "src_null", "bucket"])
    begin = F.col("before") + F.col("upto") - F.col("size")
    placed = placed.withColumn("begin", begin).withColumn("end", begin + F.col("size"))
    pieces = _pieces(seed)
    drawn = placed.select("doc_id", "digest", "size", "source_size", "target", pieces.alias("pieces"))
    return drawn.select(
        "doc_id", "digest", "size", "source_size", "target",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["word_to"] - p["word_from"]).alias("taken"), "pieces",
    )


def permuted(x: Column, n: Column, *key: Column | int) -> Column:
    """A keyed bijection of 0..n-1: Feistel rounds over the least rectangle that holds n cells, walked on while outside."""
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    high = F.ceil(n / wide).cast("long")
    fixed = [F.lit(k) if isinstance(k, int) else k for k in key]

    def once(at: Column) -> Column:
        def turn(acc: Column, j: Column) -> Column:
            left = F.pmod(acc["left"] + F.pmod(F.xxhash64(*fixed, j, F.lit(0), acc["right"]), wide), wide)
            return let(left, lambda a: F.struct(a.alias("left"), F.pmod(acc["right"] + F.pmod(F.xxhash64(*fixed, j, F.lit(1), a), high), high).alias("right")))

        start = F.struct(F.pmod(at, wide).alias("left"), F.floor(at / wide).cast("long").alias("right"))
        return F.aggregate(F.array(*[F.lit(j) for j in range(ROUNDS)]), start, turn, lambda a: a["right"] * wide + a["left"])

    walk = lambda at: F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), at, lambda a, _: F.when(a < n, a).otherwise(once(a)))
    return let(once(x), lambda at: F.when(at < n, at).otherwise(walk(at)))


def _pieces(seed: int) -> Column:
    """The drawn stretches of a document at words begin..end of its source."""
    blocks, total = F.col("blocks"), F.col("source_size")
    cut = lambda b: F.floor(b.cast("decimal(38,0)") * total / blocks).cast("long")
    guess = lambda w: F.floor(w.cast("decimal(38,0)") * blocks / total).cast("long")
    touched = F.when(
        F.col("size") > 0,
        F.sequence(F.greatest(F.lit(0).cast("long"), guess(F.col("begin"))), F.least(blocks - 1, guess(F.col("end") - 1) + 1)),
    ).otherwise(F.array().cast("array<bigint>"))

    def in_epoch(b: Column, epoch: int) -> Column:
        slot = permuted(b, blocks, seed, F.col("rank"), epoch) + epoch * blocks
        shard = let(slot, lambda at: F.size(F.filter("ends", lambda e: e <= at)))
        return F.struct(
            shard.alias("shard"), F.lit(epoch).alias("epoch"),
            (F.greatest(cut(b), F.col("begin")) - F.col("begin")).alias("word_from"),
            (F.least(cut(b + 1), F.col("end")) - F.col("begin")).alias("word_to"),
            F.xxhash64(F.lit(seed), F.col("rank"), b, F.lit(epoch)).alias("order"),
        )

    every = F.flatten(F.transform(touched, lambda b: F.array(*[in_epoch(b, e) for e in range(MAX_EPOCHS)])))
    return F.filter(every, lambda p: (p["word_from"] < p["word_to"]) & (p["shard"] < F.size("ends")))


def shard_pieces(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: (shard, part, order, doc_id, epoch, word_from, text), each shard in its local order.

    `plan` comes from plan_mix over the same `docs`, and is read twice, so write it first. Words of a piece are joined
    by single blanks. A shard's order is cut in parts of about PART_WORDS words, so that no task holds a whole shard:
    rows of a part are together and sorted, and parts follow each other. An empty plan gives no rows.
    """
    key = ["id", "no_id", "digest"]
    keyed = lambda df: df.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    texts = keyed(needed(docs, "doc_id", "text").withColumn("digest", F.xxhash64("text"))).drop("doc_id").dropDuplicates(key)
    flat = keyed(plan.select("doc_id", "digest", F.explode("pieces").alias("p")).select("doc_id", "digest", "p.*"))
    words = plan.agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("n")).first()["n"]
    shards = flat.agg(F.coalesce(F.max("shard"), F.lit(0)).alias("n")).first()["n"] + 1
    parts = max(1, -(-words // (shards * PART_WORDS)))
    piece = F.array_join(F.slice(words_of(F.col("text")), F.col("word_from").cast("int") + 1, (F.col("word_to") - F.col("word_from")).cast("int")), " ")
    # `order` is a hash, so equal ranges of it hold about equally many pieces.
    part = F.least(F.floor((F.col("order").cast("double") / F.lit(2.0**64) + 0.5) * parts), F.lit(parts - 1)).cast("int")
    made = flat.join(texts, key).select("shard", part.alias("part"), "order", "doc_id", "epoch", "word_from", piece.alias("text"))
    return made.repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "order", "doc_id", "word_from")
