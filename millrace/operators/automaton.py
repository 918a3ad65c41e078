"""Many terms in many texts: an Aho-Corasick automaton, built once a task, reads each text once whatever the number of terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable, ship

#: Characters of terms in one automaton; more terms are searched in further scans.
TERM_CHARS = 4 << 20


def _finding(terms: Broadcast, columns: list[str], borders: str | None) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = terms.value
        sizes = [len(t) for t in names]
        automaton = ahocorasick.Automaton()
        for i, t in enumerate(names):
            if t:
                automaton.add_word(t, i)
        everywhere = [i for i, t in enumerate(names) if not t]
        ready = len(automaton) > 0
        border = set(borders or "")
        if ready:
            automaton.make_automaton()
        for batch in batches:
            rows, found, counts, alone = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if text is None:
                    continue
                # Occurrences of one term that overlap count once, as a search from the left finds them.
                last: dict[int, int] = {}
                n: dict[int, int] = dict.fromkeys(everywhere, 1)
                stands: dict[int, int] = {}
                for end, i in automaton.iter(text) if ready else ():
                    if border and (end + 1 == len(text) or text[end + 1] in border) and (end + 1 == sizes[i] or text[end - sizes[i]] in border):
                        stands[i] = stands.get(i, 0) + 1
                    if last.get(i, -1) <= end - sizes[i]:
                        n[i], last[i] = n.get(i, 0) + 1, end
                rows += [row] * len(n)
                found += n
                counts += n.values()
                alone += [stands.get(i, 0) for i in n]
            at = pa.array(np.array(rows, np.int64))
            more = {"standing": pa.array(alone, pa.int64())} if borders is not None else {}
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in columns], pa.array([names[i] for i in found], pa.string()), pa.array(counts, pa.int64()), *more.values()],
                names=[*columns, "term", "count", *more])

    return find


def find_terms(texts: DataFrame, terms: DataFrame, *columns: str, borders: str | None = None) -> DataFrame:
    """(columns, term, count): the terms (term) that each text (text, and the columns) holds, and how often, apart. With
    `borders`, a set of characters, also `standing`: how often the term stands between two of them or an end of the text.

    The work grows with the texts and with what is found, not with the number of terms. Terms are sent to all tasks in
    blocks of TERM_CHARS characters, a scan for each. An empty term is in every text, once; a null text holds none."""
    spark = texts.sparkSession
    ship(spark)
    known = terms.select("term").where("term is not null").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("term") + 1), F.lit(0)).alias("n")).first()["n"]
    number = -(-size // TERM_CHARS)
    if number > 1:
        known = durable(known.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(number))), "terms")
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in columns), "term string", "count long", *(["standing long"] if borders is not None else [])])
    out = spark.createDataFrame([], schema)
    for i in range(number):
        some = (known.where(F.col("block") == i) if number > 1 else known).select("term").toArrow()["term"].to_pylist()
        out = out.union(texts.select(*columns, "text").mapInArrow(_finding(spark.sparkContext.broadcast(sorted(some)), list(columns), borders), schema))
    return out
