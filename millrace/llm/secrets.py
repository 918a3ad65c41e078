"""Secret scans: base patterns, and runs that character Markov models hold for random rather than for ordinary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Words, slices, texts
from .common import map_arrow, needed

#: Fixed patterns of the base: kind, pattern, the group that has a least length, and that length.
BASE = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
MODEL = "model"
KINDS = (*(b[0] for b in BASE), MODEL)
#: Runs of this many code points with a letter and a digit are judged by the models.
SHORTEST = 16
#: Runs of this many or more that can't be judged are samples of ordinary identifiers.
ORDINARY_LENGTH = 6
#: Nats by which the likeliest model of random strings must exceed that of ordinary ones.
MARGIN = 10.0
#: Labelled samples of random strings, drawn for each alphabet: their number, length and seed.
RANDOM_SAMPLES, RANDOM_LENGTH, SEED = 400, 40, 20240611
ALPHABETS = {
    "hex": "0123456789abcdef", "upper hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "upper base36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Characters of runs, as codes from 1; code 0 stands for the place before a run.
RUN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
N = len(RUN) + 1
CODE = np.zeros(256, np.uint8)
CODE[[ord(c) for c in RUN]] = np.arange(1, N)
#: By code: a letter's small form, whether it is a letter, a capital, a digit.
SMALL = np.arange(N)
SMALL[27:53] = np.arange(1, 27)
LETTER = (np.arange(N) >= 1) & (np.arange(N) <= 52)
CAPITAL = (np.arange(N) >= 27) & (np.arange(N) <= 52)
DIGIT = (np.arange(N) >= 53) & (np.arange(N) <= 62)
#: Share of the estimate that looks at no character before, in the model of ordinary identifiers.
ALONE = 0.05
#: Least probability of a letter's case after the case before.
LEAST_CASE = 0.1
#: Weight of the shorter context's estimate in a longer one's.
BACKING = 8.0


#: Without one of these a text has no match of the kind; assign's are looked for in small letters.
NEEDED = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",)}
HEX = np.zeros(256, bool)
HEX[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str, may_hold_hex: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches in code points, leftmost and apart within a kind, by start and kind."""
    small = text.lower()
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        if may_hold_hex if kind == "hex" else any(n in (small if kind == "assign" else text) for n in NEEDED[kind]):
            found += [(m.start(), m.end(), order, kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(start, end, kind) for start, end, _, kind in sorted(found)]


def with_long_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By text: whether any run of hexadecimal digits, which may reach into the next text, is as long as a match."""
    n = BASE[2][3]
    sums = np.concatenate([[0], np.cumsum(HEX[data])])
    starts = np.flatnonzero(sums[n:] - sums[:-n] == n) if len(data) >= n else np.zeros(0, np.int64)
    held = np.zeros(len(offsets) - 1, bool)
    held[np.searchsorted(offsets, starts, "right") - 1] = True
    return held


class Runs:
    """The runs of some texts: codes, byte range, code point range, text and whether they touch a base match."""

    def __init__(self, column: pa.Array, strings: list[str]):
        data, offsets = texts(column)
        words = Words(data, offsets, CODE)
        self.codes, self.start, self.end = words.data, words.start, words.end
        self.row = np.searchsorted(words.first, np.arange(len(words.start)), "right") - 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        zero = points[offsets[self.row]]
        self.begin, self.until = points[self.start] - zero, points[self.end] - zero
        self.base = [base_spans(t, h) for t, h in zip(strings, with_long_hex(data, offsets).tolist(), strict=True)]
        taken = np.zeros(int(points[-1]) + 1, np.int64)
        for row, spans in enumerate(self.base):
            for a, b, _ in spans:
                taken[points[offsets[row]] + a] += 1
                taken[points[offsets[row]] + b] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)])
        self.touched = covered[self.until + zero] > covered[self.begin + zero]
        letters, digits = (np.concatenate([[0], np.cumsum(table[self.codes])]) for table in (LETTER, DIGIT))
        mixed = (letters[self.end] > letters[self.start]) & (digits[self.end] > digits[self.start])
        self.judged = mixed & (self.end - self.start >= SHORTEST) & ~self.touched
        self.ordinary = (self.end - self.start >= ORDINARY_LENGTH) & ~self.touched & ~self.judged

    def steps(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(two before, one before, code, run) of every character of the chosen runs; places before a run are 0."""
        size = (self.end - self.start)[chosen]
        run = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(self.start[chosen], size) + inside
        code = self.codes[at].astype(np.int64)
        one = np.where(inside > 0, self.codes[at - 1], 0).astype(np.int64)
        two = np.where(inside > 1, self.codes[at - 2], 0).astype(np.int64)
        return two, one, code, run


def words_within(two: np.ndarray, one: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters before, as far as they belong to a letter's word: a word inside a run begins after a sign or digit
    and with a capital after a small letter."""
    starts = lambda before, now: LETTER[now] & ~(LETTER[before] & (CAPITAL[before] | ~CAPITAL[now]))
    first = starts(one, code)
    second = LETTER[code] & starts(two, one)
    return np.where(first | second, 0, two), np.where(first, 0, one)


def transitions(two: np.ndarray, one: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The slot of each step: small letters after small letters of the word, then, for letters, the case after the case before."""
    far, near = words_within(two, one, code)
    letters = (SMALL[far] * N + SMALL[near]) * N + SMALL[code]
    cased = LETTER[code]
    before = np.where(LETTER[one], 1 + CAPITAL[one], 0)[cased]
    return np.concatenate([letters, N**3 + 2 * before + CAPITAL[code][cased]])


SLOTS = N**3 + 6


class Ordinary:
    """A Markov chain of order two over small letters, and one of order one over the case of letters."""

    def __init__(self, counts: np.ndarray):
        kinds = len(np.unique(SMALL)) - 1
        three = counts[: N**3].reshape(N, N, N)
        even = np.zeros(N)
        even[np.unique(SMALL)[1:]] = 1 / kinds
        last = (three.sum(axis=(0, 1)) + BACKING * even) / (three.sum() + BACKING)
        two = three.sum(axis=0)
        pair = (two + BACKING * last) / (two.sum(axis=1, keepdims=True) + BACKING)
        whole = (three + BACKING * pair[None]) / (three.sum(axis=2, keepdims=True) + BACKING)
        whole = (1 - ALONE) * whole + ALONE * last  # words may be joined in ways that the corpus hasn't
        case = counts[N**3 :].reshape(3, 2) + np.array([[2.0, 1.0], [8.0, 1.0], [1.0, 8.0]])
        case /= case.sum(axis=1, keepdims=True)
        case = np.maximum(case, LEAST_CASE)  # names like these are ordinary even where a corpus has few of them
        with np.errstate(divide="ignore"):
            self.letters = np.log(whole)
        self.case = np.log(case / case.sum(axis=1, keepdims=True))

    def steps(self, two: np.ndarray, one: np.ndarray, code: np.ndarray) -> np.ndarray:
        before = np.where(LETTER[one], 1 + CAPITAL[one], 0)
        far, near = words_within(two, one, code)
        return self.letters[SMALL[far], SMALL[near], SMALL[code]] + np.where(LETTER[code], self.case[before, CAPITAL[code].astype(np.int64)], 0.0)


class Random:
    """Markov chains of order one, each trained on strings drawn from one alphabet; a run's likelihood is the greatest."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        tables = []
        for alphabet in ALPHABETS.values():
            known = CODE[[ord(c) for c in alphabet]].astype(np.int64)
            drawn = known[rng.integers(0, len(known), (RANDOM_SAMPLES, RANDOM_LENGTH))]
            counts = np.zeros((N, N))
            np.add.at(counts, (np.concatenate([np.zeros((RANDOM_SAMPLES, 1), np.int64), drawn[:, :-1]], axis=1), drawn), 1)
            even = np.full(N, 1e-4)
            even[known] = 1
            # '=' closes what is padded.
            even[CODE[ord("=")]] = max(even[CODE[ord("=")]], 0.02)
            even[0] = 0
            even /= even.sum()
            strength = 20.0 * len(known)  # drawn letters don't depend on each other
            with np.errstate(divide="ignore"):
                tables.append(np.log((counts + strength * even) / (counts.sum(axis=1, keepdims=True) + strength)))
        self.tables = np.stack(tables)

    def runs(self, one: np.ndarray, code: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
        return np.max([np.bincount(run, table[one, code], n) for table in self.tables], axis=0)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        column = batch.column("text")
        for a, b in slices(column):
            part = column.slice(a, b - a)
            runs = Runs(part, [t or "" for t in part.to_pylist()])
            two, one, code, _ = runs.steps(np.flatnonzero(runs.ordinary))
            counts += np.bincount(transitions(two, one, code), minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])


def learn(docs: DataFrame) -> Ordinary:
    """The model of ordinary identifiers: counts of steps over all documents, at most SLOTS sums.

    Its samples are the runs of ORDINARY_LENGTH and more that touch no base match and aren't themselves to be judged."""
    got = map_arrow(needed(docs, "text"), _counting, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return Ordinary(counts)


def ratios(runs: Runs, chosen: np.ndarray, ordinary: Ordinary, random: Random) -> np.ndarray:
    """The log-likelihood ratio of the chosen runs: random against ordinary."""
    two, one, code, run = runs.steps(chosen)
    return random.runs(one, code, run, len(chosen)) - np.bincount(run, ordinary.steps(two, one, code), len(chosen))


def _scanning(ordinary: Broadcast, margin: float) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = Random()
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            found: list[list[dict]] = []
            column = batch.column("text")
            for a, b in slices(column):
                part = column.slice(a, b - a)
                runs = Runs(part, [t or "" for t in part.to_pylist()])
                spans = [[(start, KINDS.index(kind), end, None) for start, end, kind in base] for base in runs.base]
                chosen = np.flatnonzero(runs.judged)
                for i, score in zip(chosen.tolist(), ratios(runs, chosen, ordinary.value, random).tolist(), strict=True):
                    if score >= margin:
                        spans[runs.row[i]].append((int(runs.begin[i]), KINDS.index(MODEL), int(runs.until[i]), score))
                found += [[{"kind": KINDS[k], "start": start, "end": end, "score": score} for start, k, end, score in sorted(s, key=lambda x: x[:2])] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(kind_of))], names=["doc_id", "spans"])

    return scan


def find_secrets(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, score), by start and then kind as in KINDS.

    Base matches are spans as they stand, without a score. Beside them a run of letters, digits and `+/_-=` of SHORTEST
    code points or more that has a letter and a digit and touches no base match is a span of kind `model` if its
    likelihood under the models of random strings exceeds that under the model of ordinary identifiers by `margin` nats.
    The former are trained on strings drawn for each alphabet, the latter on all other runs of the whole corpus.

    Offsets are code points, ends are exclusive. A null text is empty and has no spans. Repeated rows are documents of
    their own; a null doc_id stays null; an empty table gives no rows; other columns aren't read.
    """
    ordinary = docs.sparkSession.sparkContext.broadcast(learn(docs))  # about 5 MB at every size
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(needed(docs, "doc_id", "text"), _scanning(ordinary, margin), f"doc_id {kind}, spans array<struct<kind string, start long, end long, score double>>")


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
