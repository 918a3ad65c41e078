"""Exact best matches of a stated set of queries among all texts, in scans that leave out what can't be among the best.

A block of queries of bounded size is sent to every task; the texts stay where they are. A task puts its texts in order
and in groups of GROUP, whose terms and vectors have maxima (a small index of the task). A group's greatest possible
score with a query follows from these; where it is below the query's k-th best score so far, none of the group's texts
is scored with the query. A task returns the k best texts of each query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import durable, ship

TOKEN = r"([a-zA-Z0-9_]+|[一-龥])"
DIMENSIONS = 512
#: Texts of a group, and terms in a slice of a matrix product.
GROUP = 32
TERMS = 4096
#: Queries, and characters of their texts, that are asked in one scan.
QUERIES = 4096
QUERY_CHARS = 8 << 20
MODES = ("vector", "lexical", "hybrid", "asked", "held")


def tokenize(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)


def squeeze(text: Column) -> Column:
    """Lower-cased, without white space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")


class Places(dict):
    """The place and sign of each term in the hash vector, from SHA-256: 2 * place + (1 if negative)."""

    def __missing__(self, term: str) -> int:
        place = int(hashlib.sha256(f"0:{term}".encode()).hexdigest()[12:16], 16) % DIMENSIONS
        odd = int(hashlib.sha256(f"7:{term}".encode()).hexdigest()[15], 16) % 2
        if len(self) > 1 << 20:
            self.clear()
        self[term] = 2 * place + odd
        return self[term]


PLACES = Places()


def hash_vector(squeezed: str, words: list[str]) -> np.ndarray:
    """The signed sums of a text's distinct 1- to 3-grams, which weigh 1, and distinct tokens, which weigh 1.5; of length 1."""
    n = len(squeezed)
    grams = {squeezed[i : i + size] for size in (1, 2, 3) for i in range(max(1, n - size + 1))}
    codes = np.array([*map(PLACES.__getitem__, grams), *(PLACES["w:" + w] for w in words)], np.int64)
    weights = np.repeat([1.0, 1.5], [len(grams), len(words)])
    sums = np.bincount(codes >> 1, np.where(codes & 1, -weights, weights), DIMENSIONS)
    norm = np.sqrt(sums @ sums)
    return sums / norm if norm else sums


def vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, idx, w) of (key, squeezed, tokens): the entries of each hash vector that aren't 0."""
    for batch in batches:
        rows, places, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        words = batch.column("tokens").to_pylist()
        for i, squeezed in enumerate(batch.column("squeezed").to_pylist()):
            vector = hash_vector(squeezed, words[i])
            used = np.flatnonzero(vector)
            rows.append(np.full(len(used), i))
            places.append(used)
            weights.append(vector[used])
        key = batch.column("key").take(pa.array(np.concatenate(rows)))
        yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(weights))], names=["key", "idx", "w"])


def with_terms(rows: DataFrame, key: str, embed: Callable | None = None) -> DataFrame:
    """(key, text, tokens, squeezed, idx, w): what `Texts` reads. With `embed` its sparse rows (key, idx, w) take the place
    of the hash vector."""
    text = F.col("text")
    out = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.array_distinct(tokenize(text)).alias("tokens"), squeeze(text).alias("squeezed"))
    if embed is None:
        return out.withColumns({"idx": F.lit(None).cast("array<int>"), "w": F.lit(None).cast("array<double>")})
    sparse = embed(rows, key, "text").groupBy(F.col("key").cast("long").alias("key")).agg(F.collect_list(F.struct("idx", "w")).alias("v"))
    return out.join(sparse, "key", "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<idx:int,w:double>>"))).select(
        *out.columns, F.transform("v", lambda x: x["idx"].cast("int")).alias("idx"), F.transform("v", lambda x: x["w"].cast("double")).alias("w"))


class Texts:
    """Keys, distinct character pairs and tokens (as lists of rows and terms) and, if wanted, vectors of some texts."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, vectors: bool):
        table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        table = table.combine_chunks()
        texts = table["text"].to_pylist()
        order = sorted(range(len(texts)), key=texts.__getitem__)  # alike texts come together
        table = table.take(pa.array(order, pa.int64())).combine_chunks()
        texts = [texts[i] for i in order]
        self.n = len(texts)
        self.keys = table["key"].to_numpy()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(t) for t in texts], np.int64)
        row = np.repeat(np.arange(self.n), sizes)
        pairs = np.flatnonzero(row[:-1] == row[1:]) if len(row) else np.zeros(0, np.int64)
        found = np.unique(np.stack([row[pairs].astype(np.uint64), points[pairs] << np.uint64(32) | points[pairs + 1]]), axis=1) if len(pairs) else np.zeros((2, 0), np.uint64)
        self.gram_row, self.gram = found[0].astype(np.int64), found[1]
        lists = table["tokens"].combine_chunks()
        self.token_row = np.repeat(np.arange(self.n), lists.value_lengths().fill_null(0).to_numpy())
        self.token = lists.flatten()
        self.n_grams, self.n_tokens = np.bincount(self.gram_row, minlength=self.n), np.bincount(self.token_row, minlength=self.n)
        self.vector = np.zeros((self.n, DIMENSIONS if vectors else 0))
        if vectors and table["idx"].null_count == self.n:
            words = table["tokens"].to_pylist()
            for i, squeezed in enumerate(table["squeezed"].to_pylist()):
                self.vector[i] = hash_vector(squeezed, words[i])
        elif vectors:
            idx, w = table["idx"].combine_chunks(), table["w"].combine_chunks()
            self.vector[np.repeat(np.arange(self.n), idx.value_lengths().fill_null(0).to_numpy()), idx.flatten().to_numpy()] = w.flatten().to_numpy()


class Side:
    """Texts as rows of 0 and 1 over the terms that the queries have."""

    def __init__(self, texts: Texts, grams: np.ndarray, words: pa.Array):
        self.texts = texts
        near = np.minimum(np.searchsorted(grams, texts.gram), max(0, len(grams) - 1))
        known = grams[near] == texts.gram if len(grams) else np.zeros(len(near), bool)
        self.grams = texts.gram_row[known], near[known]
        at = pc.fill_null(pc.index_in(texts.token, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.full(len(texts.token), -1)
        self.tokens = texts.token_row[at >= 0], at[at >= 0]

    @staticmethod
    def _rows(entries: tuple[np.ndarray, np.ndarray], rows: np.ndarray, low: int, high: int, n: int) -> np.ndarray:
        """The given rows, in terms low to high; rows of one number are united."""
        place = rows[entries[0]]
        ok = (place >= 0) & (entries[1] >= low) & (entries[1] < high)
        out = np.zeros((n, high - low), np.float32)
        out[place[ok], entries[1][ok] - low] = 1
        return out


def shared(a: Side, b: Side, kind: str, n_terms: int, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    """How many terms the rows of a share with those of b; rows_*: the row that each text goes to, -1 for none."""
    sides = [(getattr(x, kind), rows, int(rows.max(initial=-1)) + 1) for x, rows in ((a, rows_a), (b, rows_b))]
    out = np.zeros((sides[0][2], sides[1][2]), np.float32)
    for low in range(0, n_terms, TERMS):
        high = min(low + TERMS, n_terms)
        x, y = (Side._rows(entries, rows, low, high, n) for entries, rows, n in sides)
        out += x @ y.T
    return out.astype(np.float64)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class Block:
    """Queries of one scan with the terms they have."""

    def __init__(self, texts: Texts, by: str, k: int, digits: int, earlier: bool):
        self.texts, self.by, self.k, self.digits, self.earlier = texts, by, k, digits, earlier
        self.vectors, self.words = by in ("vector", "hybrid"), by in ("lexical", "hybrid")
        self.grams = np.unique(texts.gram)
        self.tokens = pc.unique(texts.token)
        self.side = Side(texts, self.grams, self.tokens)

    def scores(self, docs: Side, queries: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Scores, as rounded, of the chosen queries with the chosen texts; -inf for pairs that share nothing."""
        q, d = self.texts, docs.texts
        rows_q, rows_d = np.full(q.n, -1), np.full(d.n, -1)
        rows_q[queries], rows_d[some] = np.arange(len(queries)), np.arange(len(some))
        count = lambda kind, n: shared(self.side, docs, kind, n, rows_q, rows_d)
        meet = np.zeros((len(queries), len(some)), bool)
        score = np.zeros(meet.shape)
        if self.vectors:
            a, b = q.vector[queries], d.vector[some]
            score, meet = a @ b.T, (a != 0).astype(np.float32) @ (b != 0).astype(np.float32).T > 0
        if self.by != "vector":
            pairs = count("grams", len(self.grams))
            nq, nd = q.n_grams[queries][:, None], d.n_grams[some][None, :]
            meet |= pairs > 0
            if not self.words:
                score = pairs / np.maximum(nq if self.by == "asked" else nd, 1)
            else:
                words = count("tokens", len(self.tokens))
                meet |= words > 0
                tq, td = q.n_tokens[queries][:, None], d.n_tokens[some][None, :]
                lexical = 0.7 * pairs / np.maximum(nd, 1) + 0.3 * np.where(td > 0, words / np.maximum(tq + td - words, 1), 0)
                score = 0.7 * rounded(score + 1e-11, 4) + 0.3 * rounded(lexical + 1e-11, 4) + 1e-9 if self.vectors else lexical
        if self.earlier:
            meet &= d.keys[some][None, :] < q.keys[queries][:, None]
        return np.where(meet, rounded(score, self.digits), -np.inf)

    def bounds(self, docs: Side, groups: np.ndarray) -> np.ndarray:
        """The greatest score that each query can have with any text of each group of texts."""
        q, d = self.texts, docs.texts
        starts = np.flatnonzero(np.diff(groups, prepend=-1))
        every = np.arange(q.n)
        vector = lexical = 0.0
        if self.vectors:
            high, low = np.maximum.reduceat(d.vector, starts), np.minimum.reduceat(d.vector, starts)
            vector = np.minimum(np.maximum(q.vector, 0) @ high.T + np.minimum(q.vector, 0) @ low.T, 1.0)
        if self.by == "vector":
            return vector
        pairs = shared(self.side, docs, "grams", len(self.grams), every, groups)
        nd = np.minimum.reduceat(d.n_grams, starts)[None, :]
        if self.by == "asked":
            return pairs / np.maximum(q.n_grams[:, None], 1)
        lexical = np.minimum(pairs / np.maximum(nd, 1), 1.0)
        if self.by == "held":
            return lexical
        words = shared(self.side, docs, "tokens", len(self.tokens), every, groups)
        tq, td = q.n_tokens[:, None], np.minimum.reduceat(d.n_tokens, starts)[None, :]
        words = np.minimum(words, tq)
        lexical = 0.7 * lexical + 0.3 * words / np.maximum(np.maximum(tq + td - words, tq), 1)
        return 0.7 * vector + 0.3 * lexical if self.vectors else lexical


class Best:
    """The k best texts of each query so far, by descending score and then ascending key."""

    def __init__(self, n: int, k: int):
        self.score, self.key = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        worth = (score > -np.inf) & (score >= self.score[queries, -1:])
        rows = np.flatnonzero(worth.any(axis=1))
        if not len(rows):
            return
        at, k = queries[rows], self.score.shape[1]
        both = np.concatenate([self.score[at], np.where(worth[rows], score[rows], -np.inf)], axis=1)
        names = np.concatenate([self.key[at], np.broadcast_to(keys, (len(rows), len(keys)))], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        self.score[at], self.key[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def _scan(shared_block: Broadcast, report: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared_block.value
        best = Best(block.texts.n, block.k)
        scored = pairs = 0
        for batch in batches:
            if not len(batch):
                continue
            docs = Side(Texts(batch, block.vectors), block.grams, block.tokens)
            groups = np.arange(docs.texts.n) // GROUP
            bounds = block.bounds(docs, groups)
            todo = np.ones(bounds.shape, bool)
            first = bounds.argmax(axis=1)
            slack = 0.51 * 10.0 ** -block.digits + (1e-4 if block.by == "hybrid" else 0) + 1e-9
            # Each query meets its most promising group first, which gives it a score to beat.
            for most_promising in (True, False):
                for g in range(bounds.shape[1]):
                    asked = first == g if most_promising else todo[:, g] & (bounds[:, g] >= best.score[:, -1] - slack)
                    queries, some = np.flatnonzero(asked), np.flatnonzero(groups == g)
                    if len(queries):
                        best.add(queries, block.scores(docs, queries, some), docs.texts.keys[some])
                        todo[queries, g] = False
                        scored += len(queries) * len(some)
            pairs += block.texts.n * docs.texts.n
        if report:
            yield pa.RecordBatch.from_arrays([pa.array([scored], pa.int64()), pa.array([pairs], pa.int64())], names=["scored", "pairs"])
            return
        q, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(block.texts.keys[q], pa.int64()), pa.array(best.key[q, place]), pa.array(best.score[q, place])], names=["qid", "doc", "score"])

    return scan


def _blocks(queries: DataFrame, by: str, k: int, digits: int, embed: Callable | None, earlier: bool) -> Iterator[Block]:
    """The queries in blocks of about QUERIES rows and QUERY_CHARS characters."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    number = max(-(-size["n"] // QUERIES), -(-size["chars"] // QUERY_CHARS))
    rows = with_terms(queries, "qid", embed if by in ("vector", "hybrid") else None)
    if number > 1:
        rows = durable(rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(number))), "rank_queries")
    for i in range(number):
        some = rows.where(F.col("block") == i).drop("block") if number > 1 else rows
        yield Block(Texts(some.toArrow(), by in ("vector", "hybrid")), by, k, digits, earlier)


def scans(queries: DataFrame, docs: DataFrame, k: int, by: str, digits: int, embed: Callable | None = None, earlier: bool = False, report: bool = False) -> DataFrame:
    """(qid, doc, score): the k best of each task's docs (doc, text) for each of queries (qid, text), one scan for each block
    of queries. earlier: only docs of a lesser number than the query's. report: (scored, pairs) instead."""
    if by not in MODES:
        raise ValueError(f"by must be one of {MODES}")
    spark = queries.sparkSession
    ship(spark)
    texts = with_terms(docs, "doc", embed if by in ("vector", "hybrid") else None)
    schema = "scored long, pairs long" if report else "qid long, doc long, score double"
    out = None
    for block in _blocks(queries, by, k, digits, embed, earlier):
        part = texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), report), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def scored_share(queries: DataFrame, docs: DataFrame, k: int, by: str, digits: int = 4) -> DataFrame:
    """One row: how many pairs of a query and a text were scored, how many there are, and the share."""
    sums = scans(queries, docs, k, by, digits, report=True).agg(F.sum("scored").alias("scored"), F.sum("pairs").alias("pairs"))
    return sums.withColumn("share", F.col("scored") / F.col("pairs"))


#: Texts, and their characters, that one task takes up one after the other.
LOCAL_ROWS = 2048
LOCAL_CHARS = 8 << 20


def _in_turn(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def choose(rows: pa.Table) -> pa.Table:
        texts = Texts(rows, False)
        side = Side(texts, np.unique(texts.gram), pc.unique(texts.token))
        every = np.arange(texts.n)
        like = rounded(shared(side, side, "grams", len(np.unique(texts.gram)), every, every) / np.maximum(texts.n_grams[None, :], 1), 6) >= threshold
        chosen = np.zeros(texts.n, bool)
        for i in np.argsort(texts.keys):
            chosen[i] = not (like[i] & chosen).any()
        return pa.table({"qid": pa.array(texts.keys[chosen], pa.int64())})

    return choose


def first_of_alike(rows: DataFrame, threshold: float) -> DataFrame:
    """(qid) of the texts (qid, text) that are taken up when all are looked at in order of qid and one is left out if a text
    taken up before is like it: has `threshold` of its character pairs in it.

    In rounds: a text that no undecided earlier one is like is taken up, and then all later ones that are like it are left
    out. When few are undecided one task takes these in turn, so long chains don't need a round for each link."""
    spark = rows.sparkSession
    taken = spark.createDataFrame([], "qid long")
    texts = durable(rows.groupBy("text").agg(F.min("qid").cast("long").alias("qid")), "alike_texts")  # the same text is like itself
    while True:
        size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        if size["n"] <= LOCAL_ROWS and size["chars"] <= LOCAL_CHARS:
            ship(spark)
            last = with_terms(texts, "qid").withColumn("all", F.lit(0))
            return taken.union(last.groupBy("all").applyInArrow(_in_turn(threshold), "qid long")) if size["n"] else taken
        best = lambda some, others: scans(some, others.withColumnRenamed("qid", "doc"), 1, "held", 6, earlier=True).where(F.col("score") >= threshold).select("qid").distinct()
        free = durable(texts.join(durable(best(texts, texts), "alike_held"), "qid", "left_anti"), "alike_free")
        rest = durable(texts.join(free.select("qid"), "qid", "left_anti"), "alike_rest")
        texts = durable(rest.join(durable(best(rest, free), "alike_out"), "qid", "left_anti"), "alike_texts")
        taken = taken.union(free.select("qid"))
