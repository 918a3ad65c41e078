"""Benchmark decontamination by a prefix-filtered set join with exact verification of item windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, slices, texts
from .common import durable, map_arrow, needed, without

WINDOW = 10
SHINGLE = 3
#: Bits of the bitmap that holds shingle hashes; 4 MiB, however long the benchmark is.
FILTER_BITS = 25
#: Most windows of under SHINGLE words, and most items that have them, that are looked up inside the scan; if there are
#: more they are joined like longer windows.
SHORT_WINDOWS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contract_words(text: Column) -> Column:
    """Runs of digits, small letters (A-Z made small) and non-ASCII characters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), NOT_WORD), lambda w: w != "")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(window, m, items): the distinct item windows, their number of words and the items that have them."""
    items = needed(benchmark, "item_id", "text").select("item_id", contract_words(F.col("text")).alias("words"))
    starts = F.when(F.size("words") > WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).when(F.size("words") > 0, F.array(F.lit(0)))
    flat = items.withColumn("at", F.explode(starts)).select(
        "item_id", F.slice("words", F.col("at") + 1, WINDOW).alias("part")
    ).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.array_join("part", " ").alias("window"), F.size("part").alias("m"))
    return flat.groupBy("window", "m").agg(F.collect_set("item_id").alias("items"))


def _window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("window")):
            part = batch.slice(a, b - a)
            words = Words(*texts(part.column("window")), ALNUM)
            hashes, at = words.shingles(SHINGLE)
            row = np.searchsorted(words.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("window").take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array((at - words.first[row]).astype(np.int32))],
                names=["window", "hash", "shift"],
            )


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The hashes' leading bits as a bitmap: at most 2^FILTER_BITS bits come to the driver."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = hashes.select(
        F.shiftright(place, 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bitmap


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - FILTER_BITS)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _document_shingles(words: Words, sizes: tuple[int, ...], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, size) of the document shingles that the bitmap passes."""
    found = []
    for size in sizes:
        hashes, at = words.shingles(size, short=False)
        ok = _passes(bitmap, hashes)
        found.append((hashes[ok], at[ok], np.full(int(ok.sum()), size)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counter(sizes: tuple[int, ...], bitmap: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, np.uint64)]
            for a, b in slices(batch.column("text")):
                words = Words(*texts(batch.column("text").slice(a, b - a)), ALNUM)
                seen.append(_document_shingles(words, sizes, bitmap)[0])
            hashes, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return count


class ShortWindows:
    """Windows of one or two words: by number of words the sorted hashes, and by its words the items that have it."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.items = {window.encode(): items for window, _, items in rows}
        self.hashes = {}
        for m in sorted({m for _, m, _ in rows}):
            words = Words(*texts(pa.array([w for w, k, _ in rows if k == m], pa.string())), ALNUM)
            self.hashes[m] = np.unique(words.shingles(m)[0])

    def find(self, words: Words, n: int) -> tuple[list[list[dict]], list[list[str]]]:
        """(spans, items) of each of the n texts of `words`, by their positions only; linear in the hits."""
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        data = words.data.tobytes() if self.hashes else b""
        for m, known in self.hashes.items():
            hashes, at = words.shingles(m, short=False)
            at = at[known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes]
            row = np.searchsorted(words.first, at, "right") - 1
            for i, r, first in zip(at.tolist(), row.tolist(), words.first[row].tolist(), strict=True):
                found = self.items.get(b" ".join(data[words.start[k] : words.end[k]] for k in range(i, i + m)))
                if found is not None:
                    spans[r].append({"start": i - first, "m": m})
                    items[r].update(found)
        return spans, [sorted(x) for x in items]


def _short_windows(windows: DataFrame) -> ShortWindows | None:
    """The windows of under SHINGLE words, or None if there are too many of them for a scan."""
    short = windows.where(F.col("m") < SHINGLE)
    n = short.agg(F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n")).first()["n"]
    return ShortWindows([(r["window"], r["m"], r["items"]) for r in short.collect()]) if n <= SHORT_WINDOWS else None


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("m", pa.int32())]))
_FOUND = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]))


def _finder(sizes: tuple[int, ...], bitmap: np.ndarray, short: ShortWindows) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = Words(*texts(part.column("text")), ALNUM)
                hashes, at, size = _document_shingles(words, sizes, bitmap)
                row = np.searchsorted(words.first, at, "right") - 1
                data = words.data.tobytes()
                found: list[list[dict]] = [[] for _ in range(len(part))]
                for h, i, k, r in zip(hashes.view(np.int64).tolist(), at.tolist(), size.tolist(), row.tolist(), strict=True):
                    low, high = max(int(words.first[r]), i - WINDOW + 1), min(int(words.first[r + 1]), i + k + WINDOW - 1)
                    around = b" ".join(data[s:e] for s, e in zip(words.start[low:high].tolist(), words.end[low:high].tolist(), strict=True))
                    found[r].append({"hash": h, "at": i - int(words.first[r]), "lead": i - low, "around": around.decode("utf-8", "replace")})
                counts = np.diff(words.first).astype(np.int64)
                spans, items = short.find(words, len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(counts), pa.array(found, _FOUND), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "digest", "n_words", "found", "short_spans", "short_items"],
                )

    return find


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest, n_words, n_hit, n_items, item_ids, spans.

    1. Every ten consecutive words of an item (all of a shorter one) are a window, taken as a set of
       three-word shingles.
    2. All documents are counted for how often the benchmark's shingles occur, which orders them by rarity.
    3. A window that is contained whole shares every shingle, so its prefix needs one token: its rarest.
       Documents are joined with the windows by that token only. A bitmap of bounded size keeps shingles
       of no window from entering the join.
    4. Length and position bounds: the token's places in window and document give the start, which must
       leave room for the window.
    5. The document's words there must equal the window.
    Windows of one or two words, which have no shingle and may be as frequent as "the", are looked up while the
    documents are scanned, up to SHORT_WINDOWS of them; they don't enter the join.
    A document word inside a confirmed window is hit; item_ids are the items, sorted as strings.

    Null and empty texts have no words and hits. Items without words match nothing; a null item_id counts
    as an empty string. Rows that repeat a doc_id with its text get equal results. Empty documents or an
    empty benchmark give no hits. Other columns are not read.
    """
    windows = durable(item_windows(benchmark), "bench_windows")
    short = _short_windows(windows)
    joined = windows.where(F.col("m") >= SHINGLE) if short else windows
    shingles = durable(
        map_arrow(joined.select("window"), _window_shingles, "window string, hash long, shift int"), "bench_shingles")
    lengths = [r["m"] for r in joined.select(F.least("m", F.lit(SHINGLE)).alias("m")).distinct().collect()]  # 1, 2 or 3
    sizes = tuple(sorted(lengths)) or (SHINGLE,)
    counts = (
        map_arrow(needed(docs, "text"), _counter(sizes, _bitmap(shingles)), "hash long, n long")
        .groupBy("hash").agg(F.sum("n").alias("n"))
    )
    rarest = (
        shingles.join(counts, "hash", "left").groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "shift")).alias("least"))
        .where("least.n > 0")  # a window whose rarest shingle is in no document is in none
        .select("window", "least.hash", "least.shift")
    )
    prefixes = durable(rarest.join(joined, "window"), "bench_prefixes")
    rows = needed(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    looked = durable(map_arrow(rows, 
        _finder(sizes, _bitmap(prefixes), short or ShortWindows([])),
        "doc_id long, digest long, n_words long, found array<struct<hash:long,at:int,lead:int,around:string>>,"
        "short_spans array<struct<start:int,m:int>>, short_items array<string>"), "bench_found")
    start = F.col("f.at") - F.col("shift")
    hits = (
        looked.where(F.size("found") > 0).select("doc_id", "digest", "n_words", F.explode("found").alias("f"))
        .withColumn("hash", F.col("f.hash")).join(prefixes, "hash")
        .where((start >= 0) & (start + F.col("m") <= F.col("n_words")) & (F.col("f.lead") >= F.col("shift")))
        .where(F.array_join(F.slice(F.split("f.around", " "), F.col("f.lead") - F.col("shift") + 1, F.col("m")), " ") == F.col("window"))
        .groupBy("doc_id", "digest")
        .agg(F.collect_set(F.struct(start.alias("start"), F.col("m").alias("m"))).alias("spans"), F.collect_list("items").alias("items"))
        .select(
            F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "digest",
            "spans", F.array_distinct(F.flatten("items")).alias("items"),
        )
    )
    every = looked.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "digest", "n_words", "short_spans", "short_items")
    both = every.join(hits, ["id", "no_id", "digest"], "left").select(
        "doc_id", "digest", "n_words",
        F.array_sort(F.array_union(F.coalesce("items", F.array().cast("array<string>")), "short_items")).alias("item_ids"),
        F.array_sort(F.array_union(F.coalesce("spans", F.array().cast("array<struct<start:int,m:int>>")), "short_spans")).alias("spans"))
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1))))
    return both.select("doc_id", "digest", "n_words", F.size(hit).cast("long").alias("n_hit"), "item_ids", "spans", F.size("item_ids").cast("long").alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark window."""
    return without(docs, find_contamination(docs, benchmark).where("n_hit > 0"))
