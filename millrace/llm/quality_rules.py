"""Quality rules judged per document and, with shrinkage, per host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, durable, let, needed, words_of

WINDOW = 3
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"


def repeated_positions(words: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more.

    Windows are compared by a 64-bit hash within one text only. Sorting (hash, position) pairs brings
    equal windows together, so the work is n log n for a text of n words.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(
                                s,
                                lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"])
                                | F.get(s, j + 1)["h"].eqNullSafe(x["h"]),
                            ),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, host and the counts that the rules use; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = needed(docs, "doc_id", "text", host).select(
        "doc_id", F.col(f"`{host}`").alias("host"), text.alias("text"), words_of(text).alias("words")
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{BLANK[1:]}"))
    return base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda k: F.size(k) - F.size(F.array_distinct(k))).cast("long").alias("n_dup_lines"),
        repeated_positions(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(judged: DataFrame, reject_above: float = 0.5) -> DataFrame:
    """One row per host: n, failures, shrunk rate and whether the host is kept.

    The prior is a beta distribution fitted by moments to the hosts' failure rates (weighted by documents), of whose
    variance the part that sampling makes is taken off: with shares w = n/N of the documents,
    1 / (strength + 1) = (sum w (p - m)^2 - m (1 - m) s) / (m (1 - m) (sum w (1 - w) - s)), s = sum w (1 - w) / n.
    The strength is held between 2 and 10,000. A host's rate is its posterior mean, so a host with few documents is
    drawn to the mean of all. Where hosts differ by chance only, have one document each, or there is one host, the
    strength is the upper bound.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    rate, n = F.col("failures") / F.col("n"), F.col("n").cast("double")
    first = hosts.agg(
        F.sum("n").alias("n"), F.sum("failures").alias("f"), F.sum(n * rate * rate).alias("squares"),
        F.sum(n * n).alias("sizes"), F.count(F.lit(1)).alias("hosts")
    ).first()
    total = first["n"] or 0
    mean = first["f"] / total if total else 0.5
    spread = mean * (1 - mean)
    chance = (first["hosts"] - 1) / total if total else 0.0
    room = spread * (1 - first["sizes"] / (total * total) - chance) if total else 0.0
    excess = first["squares"] / total - mean * mean - spread * chance if total else 0.0
    strength = min(10_000.0, max(2.0, room / excess - 1)) if room > 1e-12 and excess > 1e-12 else 10_000.0
    shrunk = (F.col("failures") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "failures", shrunk.alias("shrunk_rate"), (shrunk <= reject_above).alias("host_kept"))


def apply_host_rules(docs: DataFrame, host: str = "source", reject_above: float = 0.5) -> DataFrame:
    """Judge every document by its own counts and by its host.

    Returns doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    rules_failed, shrunk_rate, kept; one row per input row, repeated rows included.
    base_failed: under 50 words, or over half of the words in repeated windows. A document also counts
    against its host if over a tenth of its word characters are symbols. kept: not base_failed and the
    host's shrunk failure rate is at most `reject_above`.

    A null or empty text has no words and fails. Documents without a host form one group of their own.
    An empty table gives an empty result. Other input columns are not read.
    """
    counted = durable(document_counts(docs, host), "quality_counts")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.select(
        "*",
        base_failed.alias("base_failed"),
        (base_failed | (10 * F.col("n_symbols") > F.col("word_chars"))).alias("failed"),
    ).withColumns({"host_key": F.coalesce("host", F.lit("")), "host_null": F.col("host").isNull()})
    verdicts = host_verdicts(judged, reject_above).select(
        F.coalesce("host", F.lit("")).alias("host_key"), F.col("host").isNull().alias("host_null"), "shrunk_rate", "host_kept"
    )
    joined = judged.join(verdicts, ["host_key", "host_null"], "left")
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("failed").alias("rules_failed"), "shrunk_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )
