"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .common import map_arrow, needed

DIMENSIONS = 1024
NGRAM = 3
SEED = 7
DOCS_AT_ONCE = 64
#: Bound on the n-gram vectors that a task keeps between texts.
KEPT_VECTORS = 1 << 15
MAX_LANGUAGES = 4096


def letter_vector(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, the same in every task."""
    bits = np.random.Generator(np.random.Philox(key=(SEED << 32) | code)).integers(0, 2, DIMENSIONS, np.int8)
    return bits * 2 - 1


class Grams:
    """N-gram vectors: the letters' vectors, each permuted (rotated) by its place, multiplied together."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.matrix = np.zeros((0, DIMENSIONS), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = letter_vector(code)
        return self.letters[code]

    def vector(self, gram: int) -> np.ndarray:
        codes = [(gram >> (21 * j)) & 0x1FFFFF for j in range(NGRAM)]
        out = np.ones(DIMENSIONS, np.int8)
        for j, code in enumerate(codes):
            out = out * np.roll(self._letter(code), j)
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct n-grams as a matrix."""
        if len(self.place) + len(grams) > KEPT_VECTORS:
            self.place, self.matrix = {}, np.zeros((0, DIMENSIONS), np.float32)
        new = [g for g in grams.tolist() if g not in self.place]
        if new:
            start = len(self.place)
            need = start + len(new)
            if need > len(self.matrix):
                grown = np.zeros((max(need, 2 * len(self.matrix), 1024), DIMENSIONS), np.float32)
                grown[: len(self.matrix)] = self.matrix
                self.matrix = grown
            for i, g in enumerate(new):
                self.matrix[start + i] = self.vector(g)
                self.place[g] = start + i
        return self.matrix[[self.place[g] for g in grams.tolist()]]


def gram_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes, text of each) of lower-cased letters with single blanks for all else, inside each text."""
    lowered = [(x or "").lower() for x in column.to_pylist()]
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(x) for x in lowered], np.int64)
    own = np.repeat(np.arange(len(lowered)), lengths + 1)
    own = np.concatenate([own, own[-1:]]) if len(lowered) else own
    present, back = np.unique(points, return_inverse=True)
    is_letter = np.array([chr(p).isalpha() for p in present.tolist()], bool)
    # Texts are joined by a blank, so no n-gram holds letters of two texts.
    letters = np.where(is_letter, present, 32)[back]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    letters, own = letters[keep].astype(np.int64), own[keep]
    if len(letters) < NGRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(len(letters) - NGRAM + 1, np.int64)
    for j in range(NGRAM):
        grams |= letters[j : len(letters) - NGRAM + 1 + j] << (21 * j)
    middle = letters[1 : len(letters) - NGRAM + 2] != 32  # an n-gram around a blank may span two texts
    return grams[middle], own[1 : len(letters) - NGRAM + 2][middle]


def _count_matrix(grams: np.ndarray, own: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    present, back = np.unique(grams, return_inverse=True)
    counts = np.bincount(own * len(present) + back, minlength=texts * len(present)) if len(present) else np.zeros(0)
    return present, counts.reshape(texts, len(present)).astype(np.float32)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language the sum of the n-gram vectors of its texts."""
    table, sums = Grams(), {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b in slices(batch.column("text")):
            grams, own = gram_codes(batch.column("text").slice(a, b - a))
            names = sorted(set(langs[a:b]))
            code = np.array([names.index(x) for x in langs[a:b]])
            present, counts = _count_matrix(grams, code[own], len(names))
            for at in range(0, len(present), 4096):
                made = counts[:, at : at + 4096].astype(np.float64) @ table.rows(present[at : at + 4096])
                for name, row in zip(names, made, strict=True):
                    sums[name] = sums.get(name, 0) + row
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([np.rint(v).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])


def learn_profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes): the bundled vectors of all texts of each language; sums of whole numbers,
    so that the order of tasks doesn't matter. One row per language comes to the driver."""
    known = needed(docs, "lang", "text").where("lang is not null and text is not null")
    summed = (
        map_arrow(known, _bundles, "lang string, bundle array<bigint>")
        .select("lang", F.posexplode("bundle").alias("at", "value"))
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("bundle"))
        .select("lang", F.transform("bundle", lambda x: x["value"]).alias("bundle"))
    )
    rows = sorted(summed.limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [r["lang"] for r in rows], np.array([r["bundle"] for r in rows], float).reshape(len(rows), DIMENSIONS)


def _predictor(languages: list[str], prototypes: np.ndarray) -> Callable:
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Grams()
        names = np.array([*languages, "und"], object)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                for at in range(a, b, DOCS_AT_ONCE):
                    part = batch.slice(at, min(DOCS_AT_ONCE, b - at))
                    grams, own = gram_codes(part.column("text"))
                    present, counts = _count_matrix(grams, own, len(part))
                    bundle = np.zeros((len(part), DIMENSIONS), np.float32)
                    for k in range(0, len(present), 4096):
                        bundle += counts[:, k : k + 4096] @ table.rows(present[k : k + 4096])
                    size = np.linalg.norm(bundle, axis=1)
                    cosine = bundle @ unit.T / np.maximum(size, 1e-12)[:, None] if len(languages) else np.zeros((len(part), 0))
                    lettered = np.bincount(own, minlength=len(part)) > 0
                    best = np.where(lettered, cosine.argmax(axis=1), len(languages)) if len(languages) else np.full(len(part), 0)
                    score = np.where(lettered, cosine.max(axis=1), 0.0) if len(languages) else np.zeros(len(part))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1).astype(float))],
                        names=["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    A document's vector bundles the vectors of its letter trigrams (words with a blank on each side, lower
    case; an n-gram vector binds the letters' random vectors, rotated by place). The nearest prototype by
    cosine wins, the first by name on a tie; score is the cosine, held between 0 and 1.

    A null text, or one without letters, is `und` with score 0; so is every text where nothing was learned.
    Repeated rows are predicted alike. An empty table gives an empty result. Other columns are not read.
    """
    return map_arrow(needed(docs, "doc_id", "text"), _predictor(languages, prototypes), "doc_id long, lang_pred string, score double")


def identify_held_out(docs: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the documents whose crc32(doc_id) mod folds isn't `fold`."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    languages, prototypes = learn_profiles(needed(docs, "doc_id", "text", "lang").where(~held))
    return identify(docs, languages, prototypes).select("doc_id", held.alias("held_out"), "lang_pred", "score")
