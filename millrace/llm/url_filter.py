"""URL filters: path rules per host, and a list of URLs behind a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, needed

#: (verdict, rule): a rule is a host, then the start of a path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_RULES = 1000
#: Query parameters that don't change what a page says.
TRACKING = ("fbclid", "gclid", "ref", "sessionid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
#: Host labels whose pages make the list that the query filters by.
LISTED_LABELS = ("spam-farm",)

WORDS = 8  # longs in a block: 512 bits, one cache line
BITS_PER_KEY = 12
MAX_BLOCKS = 1 << 18  # 16 MiB of filter: the broadcast's size bound, whatever the list's length
PROBES = 6

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(url: Column) -> Column:
    """host without `www.`/`m.`, path without a final `/`, `/index.html` or `.html`, other than tracking
    parameters sorted; no scheme, no fragment. Null where the url has no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?\.html?$|/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~F.substring_index(q, "=", 1).isin(*TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as (length, rule, verdict), or null. Of equal rules, block wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into an expression")
    fits = []
    for verdict, rule in rules:
        at, slash, rest = rule.partition("/")
        fit = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def _block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each long of its block."""
    h = F.xxhash64(F.lit(2), key)
    bits = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for b in bits:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftright(b, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def bloom_filter(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of a list: (block, w0..w7), one row per block in use, and the number of blocks.

    12 bits a key up to MAX_BLOCKS blocks. A longer list only makes more false hits, which the exact join
    removes; the filter itself never outgrows the bound, so it may be broadcast.
    """
    keys = listed.count()
    blocks = 1
    while blocks * WORDS * 64 < keys * BITS_PER_KEY and blocks < MAX_BLOCKS:
        blocks *= 2
    made = listed.select(_block_of(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return made.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, canonical, maybe_listed, listed.

    `listed` has a column `url`; both sides are made canonical. A page whose canonical URL may be in the
    list by the Bloom filter goes on to a hash join with the distinct list, which removes false positives;
    the others never move. A rule for the page's host decides before the list; without one the verdict is
    block for listed pages and else allow.

    A null url, or one without `://`, has empty host and path, fits no rule and is never listed: allow.
    Repeated rows give repeated results; an empty table or list gives no block by the list. Other columns
    are not read.
    """
    wanted = durable(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical is not null").distinct(), "url_list")
    bloom, blocks = bloom_filter(wanted, "canonical")
    rows = needed(pages, "page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    probe = rows.withColumn("block", _block_of(F.col("canonical"), blocks)).join(F.broadcast(bloom), "block", "left")
    hit = F.col("canonical").isNotNull() & F.col("w0").isNotNull()
    for i, mask in enumerate(_masks(F.col("canonical"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    probe = probe.select("page_id", "host", "path", "canonical", F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
    passed = probe.where("maybe_listed").join(wanted.withColumn("exact", F.lit(True)), "canonical", "left")
    judged = probe.where("not maybe_listed").withColumn("listed", F.lit(False)).unionByName(
        passed.withColumn("listed", F.coalesce("exact", F.lit(False))).drop("exact"))
    best = best_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical", "maybe_listed", "listed",
    )


def listed_by_label(pages: DataFrame, labels: Sequence[str] = LISTED_LABELS) -> DataFrame:
    """A list made from the pages: the urls on hosts that have one of the labels."""
    parts = F.split(host_of(F.col("url")), r"\.")
    return needed(pages, "url").where(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in labels])))
