"""Cross-tokenizer alignment: groups of tokens between common ends, and links between tokens that overlap."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from operator import itemgetter
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow, needed, ship

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A chunk of documents ends after so many characters or rows; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 21
CHUNK_ROWS = 4096


#: How byte-level vocabularies of this kind split a text before they merge: a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Side(NamedTuple):
    """A tokenizer: how it encodes a text after a space, and the bytes of each of its tokens."""

    encode: Callable[[str], np.ndarray]
    tokens: list[bytes]


def _numbers(ids: list[int]) -> np.ndarray:
    return np.frombuffer(array("i", ids), np.int32).astype(np.int64)


def byte_level(definition: str) -> Side:
    """A byte-level BPE tokenizer, its file's contents given; strings of special tokens are plain text.

    tiktoken does the merges, with the file's entries in their order; texts on which its splitting gives up, such as a
    million blanks, are encoded by the slower library that the file is made for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["id"] for t in json.loads(definition)["added_tokens"]}
    tokens = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        tokens[i] = entry.encode() if i in special else bytes(byte_of[c] for c in entry)
    fast = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in special}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return _numbers(fast.encode_ordinary(" " + text))
        except BaseException as fault:  # a panic of the library isn't an Exception
            if "StackOverflow" not in str(fault):
                raise
            return _numbers(tokenizer.encode(" " + text, add_special_tokens=False).ids)

    return Side(encode, tokens)


def pieces(model: bytes) -> Side:
    """A sentencepiece tokenizer with byte fallback, which adds the leading space itself."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    tokens = [bytes([int(n[3:5], 16)]) if processor.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    return Side(lambda text: _numbers(processor.encode(text)), tokens)


class Aligned(NamedTuple):
    """A text's tokens in groups, and its links: distinct pairs of ids (a << 32 | b) and how often each occurs."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    links: np.ndarray
    times: np.ndarray


NOTHING = Aligned(0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
#: What follows an id in the written groups: another id of its side, the other side, the next group.
COMMA, BAR, SEMICOLON = (ord(c) for c in ",|;")


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in side.tokens], np.int64) for side in (a, b)]
        names = [str(i).encode() for i in range(max(len(a.tokens), len(b.tokens)))]
        self.digits = np.array([len(n) for n in names])
        self.names = np.array(names, f"S{self.digits.max() + 1}").view(np.uint8).reshape(len(names), -1)

    def align(self, text: str) -> Aligned:
        """The alignment of a text; nothing if the tokens' bytes aren't those of space and text."""
        whole = b" " + text.encode()
        a, b = self.a.encode(text), self.b.encode(text)
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        if not len(a) or not len(b) or ends_a[-1] != len(whole) or ends_b[-1] != len(whole):
            return NOTHING
        # Byte-level tokens are stretches of the text's bytes, so they spell it if none is left out.
        if b"".join(map(self.b.tokens.__getitem__, b.tolist())) != whole:
            return NOTHING
        at_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1), strict=True))
        at_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(at_a.keys() & at_b.keys())
        cuts_a, cuts_b = (_numbers(itemgetter(common[0], *common)(at)[1:]) for at in (at_a, at_b))
        return Aligned(len(a), len(b), len(common), self._written(a, b, cuts_a, cuts_b), *self._links(a, b, ends_a, ends_b, cuts_b))

    def _written(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: in every group its ids of one side and then those of the other."""
        n = len(a) + len(b)
        ids, after = np.empty(n, np.int64), np.full(n, COMMA, np.uint8)
        place_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], cuts_b[:-1]]), np.diff(cuts_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(cuts_a, np.diff(cuts_b, prepend=0))
        ids[place_a], ids[place_b] = a, b
        after[place_a[cuts_a - 1]], after[place_b[cuts_b - 1]] = BAR, SEMICOLON
        letters, digits = self.names[ids], self.digits[ids]
        letters[np.arange(n), digits] = after
        return letters[np.arange(letters.shape[1]) <= digits[:, None]].tobytes()[:-1]

    @staticmethod
    def _links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In a group of m and n tokens no two inner ends agree, so between two ends that follow each other, of either
        side, lies the overlap of just one pair: m + n - 1 pairs. All groups are expanded at once."""
        inner = np.ones(len(b), bool)
        inner[cuts_b - 1] = False
        ends = np.sort(np.concatenate([ends_a, ends_b[inner]]), kind="stable")
        pairs = (a[np.searchsorted(ends_a, ends)] << 32) | b[np.searchsorted(ends_b, ends)]
        return np.unique(pairs, return_counts=True)


_ALIGNERS: dict[int, Aligner] = {}


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.utf8_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(sizes)
        start = 0
        while start < len(batch):
            before = total[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(total, before + CHUNK_CHARS, "right"))), start + CHUNK_ROWS, len(batch))
            yield batch.slice(start, end - start)
            start = end


def _aligning(files: Broadcast) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if files.value[0] not in _ALIGNERS:
            _ALIGNERS[files.value[0]] = Aligner(byte_level(files.value[1]), pieces(files.value[2]))
        aligner = _ALIGNERS[files.value[0]]
        first = TaskContext.get().partitionId() << 32
        for number, part in enumerate(_chunked(batches)):
            found = [aligner.align(t) if t else NOTHING for t in part.column("text").to_pylist()]
            distinct, holding = np.unique(np.concatenate([x.links for x in found]), return_counts=True)
            none = [np.zeros(0, np.int64)] * (len(found) - 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array([getattr(x, c) for x in found], pa.int64()) for c in ("n_a", "n_b", "n_groups")],
                 pa.array([x.groups for x in found], pa.binary()).cast(pa.string()), _lists([x.links for x in found], pa.int64()), _lists([x.times for x in found], pa.int32()),
                 pa.array(np.full(len(found), first + number)), _lists([distinct, *none], pa.int64()), _lists([holding, *none], pa.int32())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times", "chunk", "chunk_links", "chunk_docs"])

    return rows


def align(docs: DataFrame, folder: str = TOKENIZERS, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups, links and times, and what `count_links` needs.

    Each text, after one space, is encoded by both tokenizers without special tokens; the byte offsets where tokens of
    both end cut the ids into groups, written `a1,a2|b1;a3|b2,b3`. links are the pairs of ids (a << 32 | b) of tokens
    whose bytes overlap, each once, and times how often each occurs in the document.
    A text that is null, empty or not what its tokens' bytes spell has no tokens and no links. The vocabulary files lie
    where the driver runs (a few megabytes) and are sent to the executors. Documents are worked on in chunks of
    CHUNK_CHARS characters; the first row of a chunk also holds the chunk's distinct links and how many of its documents
    have each. Repeated rows are documents of their own, a null doc_id stays null, other columns aren't read, an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    contents = (Path(folder) / byte_bpe).read_text(encoding="utf-8"), (Path(folder) / piece_bpe).read_bytes()
    files = spark.sparkContext.broadcast((hash(contents), *contents))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(needed(docs, "doc_id", "text"), _aligning(files), (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links array<long>, times array<int>, "
        "chunk long, chunk_links array<long>, chunk_docs array<int>"))


def count_links(aligned: DataFrame) -> DataFrame:
    """(part, link, n, best): for each chunk's links how many documents corpus-wide have them, and whether no other link of
    the same id of the first tokenizer is in more. Counted by chunk first, so that a link costs a row a chunk, not one
    a document."""
    held = aligned.where(F.size("chunk_links") > 0).select("chunk", F.explode(F.arrays_zip("chunk_links", "chunk_docs")).alias("x"))
    held = held.select("chunk", F.col("x.chunk_links").alias("link"), F.col("x.chunk_docs").alias("docs"))
    counts = durable(held.groupBy("link").agg(F.sum("docs").alias("n")).withColumn("id_a", F.shiftright("link", 32)), "alignment_counts")
    highest = counts.groupBy("id_a").agg(F.max("n").alias("highest"))
    judged = durable(counts.join(highest, "id_a").select("link", "n", (F.col("n") == F.col("highest")).alias("best")), "alignment_links")
    return held.select(F.col("chunk").alias("part"), "link").join(judged, "link").select("part", "link", "n", "best")


def score_links(aligned: DataFrame) -> DataFrame:
    """The rows of `aligned` (as from `align`; more columns are kept, `groups` may be left out) with n_links, n_best and count_sum.

    n_links counts the overlapping pairs of token occurrences, n_best those whose pair of ids is in as many documents
    as any of its first id, ties included, and count_sum adds up in how many documents each occurrence's pair is.
    The rows are written first; a chunk's documents then meet its counts in one group of bounded size.
    """
    rows = durable(aligned, "alignment_rows")
    ship(rows.sparkSession)
    docs = rows.drop("chunk_links", "chunk_docs")
    kept = [c for c in docs.columns if c not in ("links", "times", "chunk")]

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by("link").combine_chunks()
        sizes = pc.list_value_length(left["links"]).to_numpy().astype(np.int64)
        flat, times = (pc.list_flatten(left[c]).to_numpy() for c in ("links", "times"))
        at = np.searchsorted(right["link"].to_numpy(), flat)
        n, best = right["n"].to_numpy()[at], right["best"].to_numpy(zero_copy_only=False).astype(bool)[at]
        row = np.repeat(np.arange(len(sizes)), sizes)
        out = left.select(kept)
        for name, value in (("n_links", times), ("n_best", times * best), ("count_sum", times * n)):
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, row, value.astype(np.int64))
            out = out.append_column(name, pa.array(total))
        return out

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", n_links long, n_best long, count_sum long"
    return docs.groupBy("chunk").cogroup(count_links(rows).groupBy("part")).applyInArrow(scored, schema)
