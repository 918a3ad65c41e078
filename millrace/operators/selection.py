"""Values at exact ranks of many series at once, with bounded memory in every task however long a series is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable

#: Rows of a series of which the wanted one is picked inside one group.
KEEP = 100_000
#: Parts in which a sketch of a series' rows is cut.
GRID = 256


def null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys, where nulls match; the keys of `a` stay."""
    renamed = b.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in b.columns if c not in keys])
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(renamed, cond).drop(*[f"__{c}" for c in keys])


def select_ranks(rows: DataFrame, by: Sequence[str], wanted: DataFrame, keep: int = KEEP) -> DataFrame:
    """(by, slot, v): the value at each wanted rank (by, slot, rank from 0) in the ascending order of a series' v.

    rows: (by, v) without nulls. In rounds, all series at once: a sketch of fixed size cuts a slot's rows in GRID parts, the
    parts around the rank give a range, and what lies below, at the ends of and inside that range is counted exactly.
    Only rows of the part that holds the rank are kept, about a hundredth, written for the next round; a rank that falls
    on an end is found. Once `keep` rows or fewer are left they are sorted in one group. Sketches only choose the ranges,
    so the result is exact, and a round's aggregates are combined before they are shuffled.
    """
    by, keys = list(by), [*by, "slot"]
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    open_ = durable(wanted.select(*keys, F.col("rank").cast("long").alias("rank")), "select_wanted")
    rows = rows.select(*by, "v")
    found = None
    while True:
        shared = [c for c in keys if c in rows.columns]  # in the first round the rows are those of all slots
        sketch = rows.groupBy(*shared).agg(F.count(F.lit(1)).alias("m"), F.percentile_approx("v", grid, F.lit(10_000)).alias("cuts"))
        known = null_safe(open_, durable(sketch, "select_sketch"), shared)
        small = known.where(F.col("m") <= keep).select(*keys, "rank")
        picked = null_safe(rows, small, shared).groupBy(*keys, "rank").agg(F.sort_array(F.collect_list("v")).alias("all"))
        part = picked.select(*keys, F.get("all", F.col("rank").cast("int")).alias("v"))
        found = part if found is None else found.unionByName(part)
        at = F.floor(F.col("rank") / F.greatest(F.col("m") - 1, F.lit(1)) * GRID).cast("int")
        ranges = known.where(F.col("m") > keep).select(*keys, "rank", F.get("cuts", F.greatest(at - 1, F.lit(0))).alias("low"), F.get("cuts", F.least(at + 2, F.lit(GRID))).alias("high"))
        ranges = durable(ranges, "select_ranges")
        if not ranges.limit(1).count():
            return durable(found, "select_found")
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        met = null_safe(rows, ranges, shared)
        counts = met.groupBy(*keys, "rank", "low", "high").agg(
            F.count_if(v < low).alias("below"), F.count_if(v == low).alias("at_low"), F.count_if((v > low) & (v < high)).alias("inside"), F.count_if((v == high) & (high > low)).alias("at_high"))
        ends = [F.col("below")]
        for c in ("at_low", "inside", "at_high"):
            ends.append(ends[-1] + F.col(c))
        zone = F.when(F.col("rank") < ends[0], 0).when(F.col("rank") < ends[1], 1).when(F.col("rank") < ends[2], 2).when(F.col("rank") < ends[3], 3).otherwise(4)
        start = F.when(zone == 2, ends[1]).when(zone == 4, ends[3]).otherwise(0)
        judged = durable(counts.select(*keys, "low", "high", zone.alias("zone"), (F.col("rank") - start).alias("rank")), "select_judged")
        found = durable(found.unionByName(judged.where("zone in (1, 3)").select(*keys, F.when(F.col("zone") == 1, low).otherwise(high).alias("v"))), "select_found")
        open_ = judged.where("zone in (0, 2, 4)").select(*keys, "rank")
        inside = F.when(F.col("zone") == 0, v < low).when(F.col("zone") == 2, (v > low) & (v < high)).when(F.col("zone") == 4, v > high)
        rows = durable(null_safe(rows, judged.drop("rank"), shared).where(inside).select(*keys, "v"), "select_rows")


def select_quantiles(rows: DataFrame, by: Sequence[str], fractions: Sequence[float], keep: int = KEEP) -> DataFrame:
    """(by, n, q0, q1, ...): quantiles of each series' v by linear interpolation at (n - 1) q, exact, by `select_ranks`."""
    by = list(by)
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    # The product may miss a whole number by the last bit.
    whole = lambda q: F.floor(F.round(place(q), 9)).cast("long")
    sizes = durable(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "select_sizes")
    slots = [F.struct(F.lit(2 * i + up).alias("slot"), F.least(whole(q) + up, F.col("n") - 1).alias("rank")) for i, q in enumerate(fractions) for up in (0, 1)]
    wanted = sizes.select(*by, F.explode(F.array(*slots)).alias("x")).select(*by, "x.slot", "x.rank")
    at = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("v")))
    values = select_ranks(rows, by, wanted, keep).groupBy(*by).agg(*[at(s).alias(f"s{s}") for s in range(2 * len(fractions))])
    share = lambda q: place(q) - whole(q)
    named = [(F.col(f"s{2 * i}") + (F.col(f"s{2 * i + 1}") - F.col(f"s{2 * i}")) * F.greatest(share(q), F.lit(0.0))).alias(f"q{i}") for i, q in enumerate(fractions)]
    return null_safe(sizes, values, by).select(*by, "n", *named)
