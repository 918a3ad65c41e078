"""Toxicity: noisy-channel deobfuscation of words, then a score of the restored text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import PLAIN, Words, mix, slices, texts
from .common import durable, map_arrow, needed

#: Bound on the labelled rows that word weights are learned from.
MAX_TRAINING_ROWS = 20_000
#: Parts in which the sample is written.
SAMPLE_PARTS = 32
#: What a written character may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c",
}
ANY = "*"
#: Signs that often end a word, though they may be a letter.
ENDING = "!|+("
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Channel costs in nats: a letter as written, a substitution, a hidden letter, a dropped sign, a dropped repeat,
#: one or two dropped signs or digits that may be letters, one such that ends a word, and ENDING ones that do.
COST = {"same": 0.0, "leet": 0.7, "any": 3.3, "drop": 0.3, "odd": 6.0, "repeat": 0.4, "sign": 4.5, "ending": 1.0}
STATES = len(ALPHABET) + 2  # 0 is the word's edge, 27 any other letter
#: How much likelier than the words as written another reading of a stretch must be, in nats.
MARGIN = 1.0
#: Characters of a token that may be a part of a word written with blanks.
SHORT = 3
#: In a stretch of more runs of equal characters than LONG, which is no word, only the BEAM likeliest readings go on.
LONG, BEAM = 64, 4
#: Words of a shingle, and least shingle hashes of a text, by which near copies among the labelled texts are known.
SHINGLE, LEAST = 5, 8
#: Letters at the start of a word that count as a feature too, so that inflected forms of a word are known.
PREFIXES = (4, 5)
MIN_LLR = 20.0
MIN_LOG_ODDS = 1.5

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
LETTERS = np.where(_LETTER, np.arange(256), 0).astype(np.uint8)
LETTERS[65:91] = np.arange(97, 123)
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in [*LEET, ANY]]] = True
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27


def _trigram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(STATES**3, np.int64)
    for batch in batches:
        for a, b in slices(batch.column("text")):
            data, offsets = texts(batch.column("text").slice(a, b - a))
            codes = np.insert(_CODE[data], offsets[1:], 0) if len(data) else np.zeros(0, np.int64)
            codes = np.concatenate([[0, 0], codes, [0]])
            trigram = (codes[:-2] * STATES + codes[1:-1]) * STATES + codes[2:]
            counts += np.bincount(trigram, minlength=STATES**3)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over letters and the word edge from all documents: [a, b, c]; interpolated with bigrams.

    Only the 28^3 summed counts come to the driver."""
    rows = map_arrow(needed(docs, "text"), _trigram_rows, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(STATES**3)
    counts[rows["trigram"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(STATES, STATES, STATES)
    single = (counts.sum((0, 1)) + 1) / (counts.sum() + STATES)
    pair = (counts.sum(0) + 20 * single) / (counts.sum((0, 2))[:, None] + 20)
    return np.log((counts + 20 * pair[None]) / (counts.sum(2, keepdims=True) + 20))


def _runs(stretch: str) -> list[str]:
    return [g[0] for g in re.findall(r"((.)\2*)", stretch, re.S)]


@lru_cache(1 << 14)
def _ways(c: str, n: int) -> tuple[tuple[str, float], ...]:
    """The ways to read a run of n equal characters inside a word, with channel costs."""
    lost = COST["odd"] if n == 1 or (n == 2 and c not in ENDING and c != ANY) else COST["drop"]
    if c.isalpha():
        ways = [(c * n, COST["same"])] if n <= 2 else [(c * 2, COST["repeat"] * 2)]
        if n > 1:
            ways.append((c, COST["repeat"]))
    elif c in LEET:
        ways = [(x * k, COST["leet"] * k + COST["repeat"] * (n > k)) for x in LEET[c] for k in range(1, min(n, 2) + 1)]
        ways.append(("", lost))
    elif c == ANY:
        ways = [(x, COST["any"]) for x in ALPHABET] if n == 1 else []
        ways.append(("", lost))
    else:
        ways = [("", COST["drop"])]
    return tuple(ways)


def _lattice(stretch: str) -> list[tuple[tuple[str, float], ...]]:
    return [_ways(run[0], len(run)) for run in _runs(stretch)]


_FLAT: list[tuple[np.ndarray, list[float]]] = []


def _flat(model: np.ndarray) -> list[float]:
    """The model as a list, which single look-ups are quicker in; the last one asked for is kept."""
    if not _FLAT or _FLAT[0][0] is not model:
        _FLAT[:] = [(model, model.ravel().tolist())]
    return _FLAT[0][1]


class _Codes(dict):
    def __missing__(self, c: str) -> int:
        return 27


_CODES = _Codes({" ": 0} | {c: i for i, c in enumerate(ALPHABET, 1)})


def _best(lattice: list, model: np.ndarray) -> tuple[float, str]:
    """The likeliest path by Viterbi, states are the last two letters; a blank among the letters ends a word."""
    flat, codes, last = _flat(model), _CODES, (float("-inf"), None)
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by STATES * last but one + last
    for ways in lattice:
        ahead: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for letters, cost in ways:
                now, total = state, score - cost
                for c in letters:
                    if c != " " or now % STATES:
                        k = codes[c]
                        total += flat[now * STATES + k]
                        now = now % STATES * STATES + k
                if total > ahead.get(now, last)[0]:
                    ahead[now] = (total, (path, letters) if letters else path)
        best = ahead
        if len(lattice) > LONG and len(best) > BEAM:
            best = dict(sorted(best.items(), key=lambda x: -x[1][0])[:BEAM])
    score, path = max(((score + (flat[state * STATES] if state % STATES or state < STATES else 0.0), path) for state, (score, path) in best.items()), key=lambda x: x[0])
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return float(score), "".join(reversed(parts))


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest single word behind a token."""
    return _best(_lattice(token), model)[1]


def _end(c: str, n: int) -> tuple[str, float]:
    return " ", COST["ending"] if c in ENDING else COST["sign"] * min(n, 2) if c in LEET or (c == ANY and n == 1) else COST["same"]


def _as_written(c: str, run: str) -> tuple[tuple[str, float], ...]:
    return ((run, COST["same"]) if c.isalpha() else _end(c, len(run)),)


@lru_cache(1 << 14)
def _free(c: str, n: int) -> tuple[tuple[str, float], ...]:
    """The ways to read a run where it may also end a word."""
    return _ways(c, n) if c.isalpha() else (*_ways(c, n), _end(c, n))


def decode_words(stretch: str, model: np.ndarray) -> list[str] | None:
    """The likeliest words behind a stretch in which every sign and blank may also end a word; None for the words
    as written, which are one reading, and which another has to beat by MARGIN."""
    runs = _runs(stretch)
    written, free = [_as_written(run[0], run) for run in runs], [_free(run[0], len(run)) for run in runs]
    plain, best = _best(written, model), _best(free, model)
    return best[1].split() if best[0] > plain[0] + MARGIN and best[1].split() != plain[1].split() else None


def _characters(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    counts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return counts[e] - counts[s]


def stretches(data: np.ndarray, offsets: np.ndarray, wide: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the stretches that may hide words; no two overlap, and all else is read as it stands.

    A stretch is a token with letters and a sign, a digit or a letter twice running, or a run of two or more tokens of
    up to SHORT characters, whatever blanks part them; unless `wide`, one of these has to be a single character or hold a
    sign or digit. Signs at a token's ends that can't be letters only end the word and don't count.
    """
    words = Words(data, offsets, PLAIN)
    if not len(words.start):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    low, s, e = words.data, words.start, words.end
    letter = _LETTER[low]
    next_same = np.append(low[:-1] == low[1:], False)
    star = (low == ord(ANY)) & (next_same | np.append(False, next_same[:-1]))
    firm = np.flatnonzero((letter | _LEET[low]) & ~star)
    a, b = np.searchsorted(firm, s), np.searchsorted(firm, e)
    has = b > a
    firm = np.append(firm, len(low))
    s = np.where(has, firm[np.minimum(a, len(firm) - 1)], s)
    e = np.where(has, firm[np.maximum(b - 1, 0)] + 1, e)
    letters, others, twice = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, ~letter & (low != 0), letter & next_same & (low < 128)))
    own, sign = letters[e] > letters[s], has & (others[e] > others[s])
    text = np.searchsorted(words.first, np.arange(len(s)), "right") - 1
    size = _characters(data, s, e)
    short = size <= SHORT
    follows = np.append(False, short[1:] & short[:-1] & (text[1:] == text[:-1]))
    group = np.cumsum(~follows) - 1
    parts = np.bincount(group, weights=has)
    runs = (parts > 1) & (wide | (np.bincount(group, weights=has & (sign | (size == 1))) > 0)) & (np.bincount(group, weights=own) > 0)
    kept = np.flatnonzero(runs[group] & has)
    heads = kept[np.append(True, group[kept][1:] != group[kept][:-1])] if len(kept) else kept
    tails = kept[np.append(group[kept][1:] != group[kept][:-1], True)] if len(kept) else kept
    token = own & (sign | (twice[e] > twice[s])) & ~runs[group]
    return np.concatenate([s[token], s[heads]]), np.concatenate([e[token], e[tails]]), np.concatenate([text[token], text[heads]])


def features(words: Words, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, end, letters): every word, and its starts of so many letters; `letters` is 0 for whole words."""
    n = len(words.start)
    found = [(words.hash, np.arange(n), words.end, np.zeros(n, np.int64))]
    characters = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))
    first = np.searchsorted(characters, words.start)
    for k in prefixes:
        end = characters[np.minimum(first + k, len(characters) - 1)]
        long = np.flatnonzero((first + k < len(characters)) & (end <= words.end))
        found.append((mix(words.ranges(words.start[long], end[long]) ^ np.uint64(k)), long, end[long], np.full(len(long), k)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _names(words: Words, hashes: np.ndarray, word: np.ndarray, end: np.ndarray, letters: np.ndarray) -> dict[int, str]:
    hashes, at = np.unique(hashes, return_index=True)
    raw = words.data.tobytes()
    rows = zip(hashes.tolist(), words.start[word[at]].tolist(), end[at].tolist(), letters[at].tolist(), strict=True)
    return {h: raw[x:y].decode("utf-8", "replace") + STEM * (k > 0) for h, x, y, k in rows}


def named_features(data: np.ndarray, offsets: np.ndarray) -> dict[int, str]:
    """The features of texts as text, by hash; starts of words end in STEM."""
    words = Words(data, offsets, LETTERS)
    return _names(words, *features(words))


def hash_words(found: list[str]) -> list[int]:
    """The hashes of single words, as the words of texts have them."""
    data = [np.frombuffer(w.encode(), np.uint8) for w in found]
    return [int(Words(d, np.array([0, len(d)]), LETTERS).hash[0]) for d in data]


STEM = "*"
#: Stretches with more signs than this in a row, equal ones counted once, are decoded without a search: it would be slow.
SIGNS = 12
_NOT_LETTER = rb"[^a-z\x80-\xff\n]{0,%d}" % SIGNS


def reaching(words: list[str]) -> re.Pattern:
    """Matches wherever a stretch, with runs of equal bytes made one, may be read as one of the words, or as a word that
    starts with one that ends in STEM: a necessary condition.

    Words are laid in a tree of what may be written for each of their letters."""
    tree: dict = {}
    for word in words:
        at, word, end = tree, word.removesuffix(STEM), b"" if word.endswith(STEM) else rb"(?![a-z\x80-\xff])"
        for run in _runs(word):
            letter = run[0].encode()
            if run[0] in ALPHABET:
                signs = [c for c, x in LEET.items() if run[0] in x]
                letter = b"[" + re.escape("".join([run[0], *signs, ANY])).encode() + b"]"
            else:
                letter = b"(?:" + re.escape(re.sub(rb"(.)\1+", rb"\1", letter, flags=re.S)) + b")+"
            at = at.setdefault(letter + b"(?:" + _NOT_LETTER + letter + b")?" if len(run) > 1 else letter, {})
        at[end] = None

    def written(at: dict, first: bool) -> bytes:
        ways = [unit if below is None else (b"" if first else _NOT_LETTER) + unit + written(below, False) for unit, below in sorted(at.items(), reverse=True)]
        return b"(?:" + b"|".join(ways) + b")"

    return re.compile(rb"(?<![a-z\x80-\xff])" + written(tree, True)) if tree else re.compile(rb"(?!)")


def _may_reach(data: np.ndarray, s: np.ndarray, e: np.ndarray, pattern: re.Pattern) -> np.ndarray:
    """Which stretches the pattern finds something in, all searched in one go, or hold more than SIGNS signs in a row."""
    size = e - s + 1
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, bool)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(s, size)
    line = np.where(PLAIN[data] == 0, ord(" "), PLAIN[data])[np.minimum(place, len(data) - 1)]
    line[ends - 1] = ord("\n")
    same = np.append(False, line[1:] == line[:-1])
    star = (line == ord(ANY)) & (same | np.append(same[1:], False))
    line = np.where(star, ord("-"), line).astype(np.uint8)
    kept = np.append(True, line[1:] != line[:-1]) | (line == ord("\n"))
    after = np.cumsum(kept)[ends - 1]  # where each stretch ends in the shortened line
    line = line[kept]
    out = np.zeros(len(ends), bool)
    firm = np.append(-1, np.flatnonzero(_LETTER[line] | (line == ord("\n"))))
    out[np.searchsorted(after, firm[1:][np.diff(firm) > SIGNS + 1], "right")] = True
    line = np.where(np.repeat(out, np.diff(np.append(0, after))), ord("\n"), line).astype(np.uint8)
    found = np.array([m.start() for m in pattern.finditer(line.tobytes())], np.int64)
    out[np.searchsorted(after, found, "right")] = True
    return out


class Reader:
    """Reads texts as sets of restored words, given by their hashes."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.cached = lru_cache(1 << 18)(self._read)

    def _read(self, stretch: bytes) -> str | None:
        found = decode_words(stretch.decode("utf-8", "replace"), self.model)
        return None if found is None else " ".join(found)

    def _differing(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, marked: np.ndarray | None) -> tuple[np.ndarray, pa.Array]:
        """(place, words) of the stretches that are read otherwise than written and, with `marked`, as something marked."""
        raw = data.tobytes().lower()
        got = [self.cached(raw[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
        place = np.flatnonzero([g is not None for g in got])
        found = pa.array([got[i] for i in place], pa.string())
        if marked is not None and len(place):
            words = Words(*texts(found), LETTERS)
            hashes, word, _, _ = features(words)
            hit = np.unique(np.searchsorted(words.first, word[np.isin(hashes, marked)], "right") - 1)
            place, found = place[hit], found.take(pa.array(hit))
        return place, found

    def read(self, column: pa.Array, pattern: re.Pattern | None = None, prefixes: tuple[int, ...] = PREFIXES, marked: np.ndarray | None = None,
             wide: bool = True) -> Iterator[tuple[int, np.ndarray, dict[int, str]]]:
        """(row, sorted distinct hashes of the features of its restored words, new features by hash) of each text.

        With a pattern only stretches are decoded that may be read as one of the pattern's words. With `marked`, sorted
        hashes of features, stretches stay as written unless their reading holds one of these. All new features of
        several texts come with the first of them."""
        for a, b in slices(column):
            data, offsets = texts(column.slice(a, b - a))
            words = Words(data, offsets, LETTERS)
            s, e, text = stretches(data, offsets, wide)
            if pattern is not None:
                wanted = _may_reach(data, s, e, pattern)
                s, e, text = s[wanted], e[wanted], text[wanted]
            place, found = self._differing(data, s, e, marked)
            replaced = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(replaced, np.searchsorted(words.start, s[place]), 1)
            np.add.at(replaced, np.searchsorted(words.start, e[place]), -1)
            as_written = np.cumsum(replaced)[:-1] == 0
            hashes, word, _, _ = features(words, prefixes)
            own = as_written[word]
            owner = np.searchsorted(words.first, word[own], "right") - 1
            restored = Words(*texts(found), LETTERS)
            added, at, end, letters = features(restored)
            to = text[place][np.searchsorted(restored.first, at, "right") - 1] if len(place) else np.zeros(0, np.int64)
            owner, hashes = np.concatenate([owner, to]), np.concatenate([hashes[own], added])
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))[: len(owner)]
            owner, hashes = owner[new], hashes[new]
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            names = _names(restored, added, at, end, letters)
            for i in range(b - a):
                yield a + i, hashes[ends[i] : ends[i + 1]], names if i == 0 else {}

    def restored(self, text: str, marked: np.ndarray | None = None) -> str:
        """The text with every stretch that is read differently replaced by its decoded words; with `marked` as in `read`."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        out, at = [], 0
        s, e, _ = stretches(data, np.array([0, len(data)]))
        place, found = self._differing(data, s, e, marked)
        for i, words in sorted(zip(place.tolist(), found.to_pylist(), strict=True), key=lambda x: s[x[0]]):
            out += [raw[at : s[i]], words.encode()]
            at = e[i]
        return b"".join([*out, raw[at:]]).decode()


@dataclass(frozen=True)
class ToxicWords:
    """Words and stems, their hashes (sorted) and weights, and the logistic line from a text's sum to its score."""

    words: list[str] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    bias: float = -2.0

    def total(self, own: np.ndarray) -> float:
        if not len(self.hashes):
            return 0.0
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return float(self.weights[at][self.hashes[at] == own].sum())


def _word_counter(model: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            toxic, share = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "share"))
            column = batch.column("text")
            names: dict[int, str] = {}
            for a, b in slices(column):
                names |= named_features(*texts(column.slice(a, b - a)))
            seen, weight, label = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for row, own, added in reader.read(column, wide=False):
                names |= added
                seen.append(own)
                weight.append(np.full(len(own), share[row]))
                label.append(np.full(len(own), toxic[row]))
            weights, labels = np.concatenate(weight), np.concatenate(label)
            hashes, at = np.unique(np.concatenate(seen), return_inverse=True)
            sides = [np.bincount(at, weights * (labels == side), len(hashes)) for side in (1, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array([names[h] for h in hashes.tolist()], pa.string()), *map(pa.array, sides)], names=["hash", "word", "toxic", "clean"])

    return count


def _totals(model: np.ndarray, words: ToxicWords) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, pattern = Reader(model), reaching(words.words)
        used = tuple(k for k in PREFIXES if any(w.endswith(STEM) and len(w) == k + len(STEM) for w in words.words))
        for batch in batches:
            total = np.zeros(len(batch))
            for row, own, _ in reader.read(batch.column("text"), pattern, used, words.hashes):
                total[row] = words.total(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total)], names=["doc_id", "total"])

    return score


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The LEAST least shingle hashes of each text; texts of a group of near copies share some."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            words = Words(*texts(batch.column("text").slice(a, b - a)))
            hashes, at = words.shingles(SHINGLE)
            ends = np.searchsorted(at, words.first)
            least = [np.sort(hashes[ends[i] : ends[i + 1]])[:LEAST].view(np.int64).tolist() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "least"])


def copy_shares(sample: DataFrame) -> DataFrame:
    """(doc_id, share): one over the size of a document's group of near copies, those that share a least shingle, so
    that a text counts once however often it is copied. `sample` has a bounded number of rows."""
    signs = durable(map_arrow(needed(sample, "doc_id", "text"), _signs, "doc_id long, least array<long>"), "toxic_signs")
    flat = signs.select("doc_id", F.explode(F.array_distinct("least")).alias("sign"))
    sizes = flat.groupBy("sign").agg(F.count(F.lit(1)).alias("n"))
    return flat.join(sizes, "sign").groupBy("doc_id").agg((1 / F.max("n")).alias("share"))


def _fit_line(total: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic regression on one number, by Newton steps with a small ridge."""
    beta = np.array([0.0, -1.0])
    x = np.stack([total, np.ones_like(total)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (toxic - n * p) - np.array([1.0, 0.1]) * beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 0.1])
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(beta[0]), float(beta[1])


def learn_toxic_words(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_rows: int = MAX_TRAINING_ROWS) -> ToxicWords:
    """Weights of the words that mark toxic documents, from labelled rows (at most about `max_rows`).

    Words, and starts of words of PREFIXES letters, weigh their log odds between toxic and clean documents whose restored
    text holds them. They enter with a log likelihood ratio of at least 20 and log odds of at least 1.5; this keeps chance
    and mere language out. Near copies count together as one document. A logistic line then maps a text's sum to a
    probability.
    """
    rated = needed(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = rated.count()
    if n > max_rows:
        part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
        rated = rated.where(part < max_rows / n)
    sample = needed(docs, "doc_id", "text").where("text is not null").join(F.broadcast(rated), "doc_id")
    sample = durable(sample.repartition(SAMPLE_PARTS, "doc_id", F.xxhash64("text")), "toxic_sample")  # one scan of all documents
    sample = sample.join(F.broadcast(durable(copy_shares(sample), "toxic_shares")), "doc_id", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    sides = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.sum("share").alias("n")).collect()}
    n1, n0 = float(sides.get(1, 0)), float(sides.get(0, 0))
    if not n1 or not n0:
        return ToxicWords(bias=-2.0 if n0 or not n1 else 2.0)
    counted = map_arrow(sample.select("text", "toxic", "share"), _word_counter(model), "hash long, word string, toxic double, clean double")
    counted = counted.groupBy("hash").agg(F.min("word").alias("word"), F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share, rest = (a + b) / (n1 + n0), 1 - (a + b) / (n1 + n0)
    llr = 2 * (term(a, share * n1) + term(b, share * n0) + term(n1 - a, rest * n1) + term(n0 - b, rest * n0))
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    # Every word of the bounded sample that passes; a likelihood ratio of 20 takes several documents each.
    rows = counted.select("hash", "word", llr.alias("llr"), odds.alias("odds")).where((F.col("llr") >= MIN_LLR) & (F.col("odds") >= MIN_LOG_ODDS)).toArrow()
    hashes = rows["hash"].to_numpy().view(np.uint64) if len(rows) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    words = ToxicWords(rows["word"].take(pa.array(order)).to_pylist(), hashes[order], rows["odds"].to_numpy()[order] if len(rows) else np.zeros(0))
    totals = map_arrow(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), _totals(model, words), "doc_id long, total double")
    steps = totals.groupBy(F.round("total", 1).alias("total")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("toxic")).toArrow()
    slope, bias = _fit_line(*(steps[c].to_numpy().astype(float) for c in ("total", "n", "toxic")))
    return ToxicWords(words.words, words.hashes, words.weights, slope, bias)


def score_toxicity(docs: DataFrame, model: np.ndarray, words: ToxicWords) -> DataFrame:
    """One row per document: doc_id, score, predicted.

    Every text is read word by word; stretches that may hide a word (letters written as signs or digits,
    parted by blanks or signs, or repeated) are decoded by Viterbi over the lattice of what their
    characters may stand for, under a trigram model of the letters of all documents. The score is the
    logistic of the summed weights of the distinct words of the restored text, in which a stretch takes its decoded reading
    if that holds a marked word and else stays as written (`1990s`, `3rd`). Only stretches that can be read as a
    marked word have to be decoded for that. predicted: score >= 0.5.

    Null and empty texts have the score of a text without marked words. Without labels of both kinds no
    word is marked. Repeated rows are scored alike. An empty table gives an empty result. Other columns
    are not read.
    """
    totals = map_arrow(needed(docs, "doc_id", "text"), _totals(model, words), "doc_id long, total double")
    score = 1 / (1 + F.exp(-(F.lit(words.slope) * F.col("total") + F.lit(words.bias))))
    return totals.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, with labels of documents whose crc32(doc_id) mod folds isn't `fold`."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    model = character_model(docs)
    words = learn_toxic_words(docs, needed(labels, "doc_id", "toxic").where(~held), model)
    return score_toxicity(docs, model, words).select("doc_id", held.alias("held_out"), "score", "predicted")
