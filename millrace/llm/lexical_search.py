"""Ranked lexical search: documents grouped by the mask of matched terms, masks evaluated by descending greatest score."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrowtext import ALNUM, Words, offsets_of, slices, texts
from .common import durable, map_arrow, needed

TOP = 10
#: Bytes of items that are asked in one scan of the documents; more are asked in further scans.
BLOCK_BYTES = 8 << 20
#: Cells (terms of an item x documents) that are looked at together.
CELLS = 1 << 21
#: Documents that are evaluated first, before masks are held against the score to beat.
FIRST = 32
SALTS = 64


class Terms:
    """The distinct terms of a block of items, found in texts by hash and then by their bytes."""

    def __init__(self, names: list[bytes]):
        data = np.frombuffer(b"".join(names), np.uint8)
        ends = np.cumsum([len(t) for t in names], dtype=np.int64) if names else np.zeros(0, np.int64)
        hashes = Words(data, np.concatenate([[0], ends]), ALNUM).hash if names else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hash = hashes[self.by_hash]
        self.data, self.end = data, ends
        self.start = np.concatenate([[0], ends[:-1]]) if names else ends
        if len(np.unique(hashes)) < len(names):
            raise ValueError("two terms of the items have one hash")

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words, term) of the words that are terms."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        at = np.flatnonzero(self.hash[near] == words.hash)
        term = self.by_hash[near[at]]
        size = words.end[at] - words.start[at]
        same = size == self.end[term] - self.start[term]
        at, term, size = at[same], term[same], size[same]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = words.data[np.repeat(words.start[at], size) + step] != self.data[np.repeat(self.start[term], size) + step]
        bad = np.unique(np.repeat(np.arange(len(at)), size)[differs])
        return np.delete(at, bad), np.delete(term, bad)


def terms_of(text: str | None) -> list[bytes]:
    words = Words(*texts(pa.array([text or ""])), ALNUM)
    data = words.data.tobytes()
    return [data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]


class Block:
    """Items of one scan: item_id (as Arrow), distinct terms with their repeats, and the terms of all of them."""

    def __init__(self, rows: pa.Table):
        texts_of: dict = {}
        for place, (key, text) in enumerate(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)):
            texts_of.setdefault(key, (place, []))[1].extend(terms_of(text))
        self.ids = rows["item_id"].combine_chunks().take(pa.array([place for place, _ in texts_of.values()], pa.int64()))
        names = sorted({t for _, found in texts_of.values() for t in found})
        number = {t: i for i, t in enumerate(names)}
        self.terms = Terms(names)
        self.items = []
        for _, found in texts_of.values():
            repeats = Counter(number[t] for t in found)
            self.items.append((np.array(list(repeats), np.int64), np.array(list(repeats.values()), np.int64)))
        self.n_terms = len(names)


def _postings(column: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text with repeats; row, term, times of what texts and items share), ordered by term and row."""
    sizes = np.zeros(len(column), np.int64)
    keys = [np.zeros(0, np.int64)]
    for a, b in slices(column):
        words = Words(*texts(column.slice(a, b - a)), ALNUM)
        sizes[a:b] = np.diff(words.first)
        at, term = terms.find(words)
        row = np.repeat(np.arange(a, b), sizes[a:b])[at]
        keys.append(term * len(column) + row)
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    return sizes, key % max(1, len(column)), key // max(1, len(column)), times


#: Numbers of the rows that hold sums beside those of terms.
DOCUMENTS, LENGTH = -1, -2


def _counting(block: Broadcast) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(block.value.n_terms, np.int64)
        worded = length = 0
        for batch in batches:
            sizes, _, term, _ = _postings(batch.column("text"), block.value.terms)
            held += np.bincount(term, minlength=len(held))
            worded, length = worded + int(np.count_nonzero(sizes)), length + int(sizes.sum())
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS, LENGTH, *used.tolist()], pa.int64()), pa.array([worded, length, *held[used].tolist()], pa.int64())], names=["term", "n"])

    return count


class Statistics:
    """N, L and the weight of every term of a block."""

    def __init__(self, counts: dict[int, int], n_terms: int):
        self.n, self.length = counts.get(DOCUMENTS, 0), counts.get(LENGTH, 0)
        self.weight = np.array([math.floor(1000 * math.log((2 * self.n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(n_terms)], np.int64)

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        """8 m of texts of the given sizes."""
        return 8 * (25 + (75 * sizes * self.n) // max(1, self.length))


class Best:
    """The TOP documents found so far for one item, by descending score and then ascending doc_id, nulls last."""

    def __init__(self) -> None:
        self.rows: pa.Table | None = None
        self.beat = 1

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        new = pa.table({"doc_id": ids, "score": pa.array(scores)})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        order = pc.sort_indices(rows, [("score", "descending"), ("doc_id", "ascending")])
        self.rows = rows.take(order[:TOP]).combine_chunks()
        if len(self.rows) == TOP:
            self.beat = self.rows["score"][TOP - 1].as_py()


def evaluate(share: np.ndarray, weights: np.ndarray, beat: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of every document whose score is at least `beat` and among the TOP greatest, ties included.

    share: for each term of the item and each document what the term adds per weight, 0 if it isn't there. The
    bitmaps of the terms make a mask for each document; documents of one mask can at most score what its terms add
    at their greatest. Masks are evaluated by descending such bound, until none left reaches the score to beat.
    """
    bits = share > 0
    packed = np.packbits(bits, axis=0)
    width = -(-len(packed) // 8) * 8
    words = np.zeros((share.shape[1], width), np.uint8)
    words[:, : len(packed)] = packed.T
    flat = words.view(np.uint64)[:, 0] if width == 8 else words.view(np.dtype((np.void, width)))[:, 0]
    _, first, mask = np.unique(flat, return_index=True, return_inverse=True)
    bound = (weights * share.max(axis=1)) @ bits[:, first].astype(np.int64)
    by_bound = np.argsort(-bound, kind="stable")
    place = np.empty_like(by_bound)
    place[by_bound] = np.arange(len(by_bound))
    order = np.argsort(place[mask], kind="stable")  # documents by descending bound of their mask
    bounds = bound[mask[order]]
    documents, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done, size = 0, FIRST
    best = np.zeros(0, np.int64)
    while done < len(order) and bounds[done] >= beat:
        end = min(done + size, int(np.searchsorted(-bounds, -beat, "right")))
        part = order[done:end]
        score = weights @ share[:, part]
        documents.append(part[score >= beat])
        scores.append(score[score >= beat])
        best = np.concatenate([best, score])
        best = np.partition(best, len(best) - TOP)[-TOP:] if len(best) > TOP else best
        if len(best) == TOP:
            beat = max(beat, int(best.min()))
        done, size = end, size * 2
    document, score = np.concatenate(documents), np.concatenate(scores)
    return document[score >= beat], score[score >= beat]


def _ranking(block: Broadcast, statistics: Broadcast) -> Callable:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stats = block.value, statistics.value
        best = [Best() for _ in known.items]
        for batch in batches:
            sizes, row, term, times = _postings(batch.column("text"), known.terms)
            added = (1_000_000_000 * times) // (1000 * times + stats.norms(sizes)[row])
            start = np.searchsorted(term, np.arange(known.n_terms + 1))
            for found, (terms, repeats) in zip(best, known.items, strict=True):
                here = start[terms] < start[terms + 1]
                terms, weights = terms[here], (repeats * stats.weight[terms])[here]
                if not len(terms):
                    continue
                width = max(1, CELLS // len(terms))
                for low in range(0, len(batch), width):
                    high = min(low + width, len(batch))
                    share = np.zeros((len(terms), high - low), np.int64)
                    for i, t in enumerate(terms.tolist()):
                        a, b = start[t], start[t + 1]
                        if low or high < len(batch):
                            a, b = a + np.searchsorted(row[a:b], [low, high])
                        share[i, row[a:b] - low] = added[a:b]
                    document, score = evaluate(share, weights, found.beat)
                    if len(document):
                        found.add(batch.column("doc_id").take(pa.array(document + low)), score)
        for i, found in enumerate(best):
            if found.rows is not None:
                ids = known.ids.take(pa.array(np.full(len(found.rows), i)))
                yield pa.RecordBatch.from_arrays([ids, *[found.rows[c].combine_chunks() for c in ("doc_id", "score")]], names=["item_id", "doc_id", "score"])

    return rank


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES of text, one after the other; rows of one item_id are one item."""
    rows = needed(items, "item_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    number = -(-total // BLOCK_BYTES)
    if number > 1:
        rows = durable(rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(number))), "search_items")
    for i in range(number):
        yield Block((rows.where(F.col("block") == i) if number > 1 else rows).select("item_id", "text").toArrow())


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the TOP documents that score highest, equal scores by ascending doc_id.

    Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z made small. With N documents that
    have a term, L terms of them all, n terms of a document, df documents that hold a term and tf of its occurrences
    in one: m = 25 + (75 n N) div L, w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document scores the sum of
    w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms with repeats, if that is above 0.

    The documents are scanned twice for each block of items: to count, and to rank. A task keeps the TOP documents of
    each item; it groups documents by the mask of the item's terms they hold and leaves out masks that can't reach the
    score to beat. Nothing but these few rows is shuffled.

    Null texts have no terms, items without terms no rows. Rows of one item_id are one item with the terms of all; a
    null item_id is one too. Repeated documents rank one beside the other; null doc_ids come last among equal scores.
    Empty tables give no rows. Other columns aren't read.
    """
    spark, texts_of = docs.sparkSession, needed(docs, "doc_id", "text")
    schema = StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", LongType())])
    ranked = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)
        counts = map_arrow(needed(docs, "text"), _counting(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        statistics = Statistics(dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True)), block.n_terms)
        ranked = ranked.union(map_arrow(texts_of, _ranking(shared, spark.sparkContext.broadcast(statistics)), schema))
    # In two steps, as a task of the first scan may send TOP rows an item.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    few = ranked.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= TOP).drop("place")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
