"""Statistics of many ordered series at once.

A series is the rows that share the `by` columns, in the order of the `order` columns. Every function takes a
DataFrame of all series and computes all of them in one job. Values that are null or not finite are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.selection import KEEP, select_quantiles, select_ranks
from millrace.session import durable

By = Sequence[str]
CHUNK = 65536


def values_of(df: DataFrame, by: By, value: str, *also: str) -> DataFrame:
    """The series' columns with the number as `v`."""
    rows = df.select(*by, *also, F.col(value).cast("double").alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))


def position(df: DataFrame, by: By, order: By, value: str, stretch: Column | None = None) -> DataFrame:
    """Add `pos`, the 0-based place in the series.

    `stretch` is a column that grows with the first order column, such as its day. With it a long series is
    numbered in two levels: rows inside a stretch, and the stretches' offsets, of which there are few. No task
    then holds a whole series.
    """
    rows = values_of(df, by, value, *order)
    if stretch is None:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    rows = rows.withColumn("stretch", stretch)
    sizes = rows.groupBy(*by, "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(*by, "stretch", (F.sum("n").over(Window.partitionBy(*by).orderBy("stretch")) - F.col("n")).alias("before"))
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy(*by, "stretch").orderBy(*order)) - 1)
    return inside.join(before, [*by, "stretch"]).withColumn("pos", (F.col("before") + F.col("inside")).cast("long")).drop("before", "inside", "stretch")


def chunked(placed: DataFrame, by: By, reach: int, chunk: int = CHUNK) -> DataFrame:
    """Cut positioned series in chunks for window rules that look `reach` rows ahead.

    Adds `chunk` and `own`; the first `reach` rows of a chunk are repeated, not own, in the chunk before, so that
    each own row sees all it needs inside its chunk.
    """
    chunk = max(chunk, reach)
    at = F.floor(F.col("pos") / chunk)
    repeated = (F.pmod(F.col("pos"), F.lit(chunk)) < reach) & (at > 0)
    both = F.when(repeated, F.array(F.struct(at.alias("c"), F.lit(True).alias("o")), F.struct((at - 1).alias("c"), F.lit(False).alias("o")))).otherwise(
        F.array(F.struct(at.alias("c"), F.lit(True).alias("o"))))
    return placed.withColumn("x", F.explode(both)).withColumns({"chunk": F.col("x.c"), "own": F.col("x.o")}).drop("x")


def quantile_of(v: Column | str, q: float, approx: bool = False, times: Column | str | int = 1) -> Column:
    """Linear interpolation at (n-1)q, rounded to 3, of numbers that occur `times` times; with approx a sketch of bounded size
    instead.

    Rounding to 9 places first takes the error of the interpolation out of ties."""
    return F.round(F.round(F.percentile_approx(v, F.lit(q), F.lit(10000)) if approx else F.percentile(v, F.lit(q), times), 9), 3)


def _settled(x: Column) -> Column:
    """As `quantile_of` rounds."""
    return F.round(F.round(x, 9), 3)


def quantile(df: DataFrame, by: By, value: str, q: float, approx: bool = False, giant: bool = False, keep: int = KEEP) -> DataFrame:
    """giant: by selection in rounds (`selection`), exact with bounded memory where a series has more distinct values than a
    task can hold; groups of up to `keep` rows are then sorted as they are. The same goes for the functions below."""
    rows = values_of(df, by, value)
    if giant:
        return select_quantiles(rows, by, [q], keep).select(*by, _settled(F.col("q0")).alias("quantile"))
    return rows.groupBy(*by).agg(quantile_of("v", q, approx).alias("quantile"))


def describe(df: DataFrame, by: By, value: str, approx: bool = False, giant: bool = False, keep: int = KEEP) -> DataFrame:
    rows = values_of(df, by, value)
    plain = [F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 3).alias("mean")]
    std = F.round(F.stddev_pop("v"), 3).alias("std")
    quarters = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    if giant:
        ranks = select_quantiles(rows, by, list(quarters.values()), keep).select(*by, *[_settled(F.col(f"q{i}")).alias(c) for i, c in enumerate(quarters)])
        return _join(rows.groupBy(*by).agg(*plain, std), ranks, by).select(*by, "count", "min", "max", "mean", "median", "std", "p25", "p75")
    found = {c: quantile_of("v", q, approx).alias(c) for c, q in quarters.items()}
    return rows.groupBy(*by).agg(*plain, found["median"], std, found["p25"], found["p75"])


def numbered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Add `number`, the 1-based place of each row in the whole order: ranges of the order are numbered one by one, and the
    ranges' offsets, a row for each of them, are added."""
    ranged = durable(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = ranged.withColumn("number", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return inside.join(F.broadcast(before), "range").withColumn("number", (F.col("number") + F.col("before")).cast("long")).drop("range", "before")


def upper_median(v: str, approx: bool = False) -> Column:
    """The element at n//2 of the sorted values; with approx from a sketch of bounded size."""
    if approx:
        return -F.percentile_approx(-F.col(v), F.lit(0.5), F.lit(10000))
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC)")


def _join(a: DataFrame, b: DataFrame, by: By) -> DataFrame:
    """Inner join on the series keys, where null keys match."""
    renamed = b.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in b.columns if c not in by])
    if not by:
        return a.crossJoin(F.broadcast(renamed))  # one row of totals
    cond = F.lit(True)
    for c in by:
        cond = cond & a[c].eqNullSafe(renamed[f"__{c}"])
    return a.join(renamed, cond).drop(*[f"__{c}" for c in by])


def mad(df: DataFrame, by: By, value: str, approx: bool = False, giant: bool = False, keep: int = KEEP) -> DataFrame:
    """center, mad, median, mean, n: the upper median, the upper median of the absolute deviations from it, the
    true median, the mean and the count. Exact medians keep a count for each distinct value of a series in one task; for
    series too large for that, `giant` selects them in rounds, and with `approx` sketches of bounded size take their place."""
    rows = values_of(df, by, value)
    if giant:
        middle = lambda x: select_ranks(x, by, x.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / 2).alias("rank")).withColumn("slot", F.lit(0)), keep).drop("slot")
        center = _join(middle(rows).withColumnRenamed("v", "center"), select_quantiles(rows, by, [0.5], keep).withColumnRenamed("q0", "median"), by)
        center = _join(center, rows.groupBy(*by).agg(F.avg("v").alias("mean")), by)
        off = _join(rows, center, by).select(*by, F.abs(F.col("v") - F.col("center")).alias("v"))
        return _join(center, middle(off).withColumnRenamed("v", "mad"), by).select(*by, "center", "median", "mean", "n", "mad")
    median = F.percentile_approx("v", F.lit(0.5), F.lit(10000)) if approx else F.percentile("v", F.lit(0.5))
    center = rows.groupBy(*by).agg(
        upper_median("v", approx).alias("center"), median.alias("median"), F.avg("v").alias("mean"), F.count("v").alias("n"))
    off = _join(rows, center, by).withColumn("off", F.abs(F.col("v") - F.col("center")))
    return off.groupBy(*by, "center", "median", "mean", "n").agg(upper_median("off", approx).alias("mad"))


def series_stats(df: DataFrame, by: By, value: str, approx: bool = False, giant: bool = False, keep: int = KEEP) -> DataFrame:
    spread = mad(df, by, value, approx, giant, keep).select(*by, F.round("mad", 3).alias("mad"))
    return _join(describe(df, by, value, approx, giant, keep), spread, by)


def trend(placed: DataFrame, by: By) -> DataFrame:
    """slope and direction of positioned series: rising or falling beyond 1 % of the mean a step."""
    stats = placed.groupBy(*by).agg(
        F.count("v").alias("n"), F.coalesce(F.regr_slope("v", "pos"), F.lit(0.0)).alias("_s"), F.avg("v").alias("mean"))
    base = F.when(F.col("mean") == 0, F.lit(1.0)).otherwise(F.col("mean")) * 0.01
    return stats.select(
        *by, F.when(F.col("n") < 2, 0.0).otherwise(F.round("_s", 4)).alias("slope"),
        F.when(F.col("n") < 2, "insufficient").when(F.col("_s") > base, "rising").when(F.col("_s") < -base, "falling").otherwise("flat").alias("direction"))


def linear_regression(placed: DataFrame, by: By) -> DataFrame:
    stats = placed.groupBy(*by).agg(
        F.count("v").alias("n"), F.coalesce(F.regr_slope("v", "pos"), F.lit(0.0)).alias("_s"),
        F.regr_intercept("v", "pos").alias("_i"), F.avg("v").alias("mean"), F.stddev_pop("pos").alias("_c"),
        F.stddev_pop("v").alias("sd"), F.max_by("v", "pos").alias("last"))
    few = F.col("n") < 2
    return stats.select(
        *by, "n", "last",
        F.when(few, 0.0).otherwise(F.round("_s", 4)).alias("slope"),
        F.when(few, 0.0).otherwise(F.round(F.coalesce("_i", "mean"), 4)).alias("intercept"),
        F.when(few | (F.col("sd") == 0), 0.0).otherwise(F.round(F.col("_s") * F.try_divide("_c", "sd"), 4)).alias("r"),
        F.when(few, "insufficient").when(F.col("_s") > 0, "rising").when(F.col("_s") < 0, "falling").otherwise("flat").alias("direction"))


def moving_average(placed: DataFrame, by: By, window: int = 3) -> DataFrame:
    """Mean of the last `window` values, of fewer at the head; a series shorter than the window keeps its values."""
    # As in chunked(), but the frame looks back: the last rows of a chunk are repeated in the next one.
    size = max(CHUNK, window)
    at = F.floor(F.col("pos") / size)
    tail = F.pmod(F.col("pos"), F.lit(size)) >= size - window + 1
    rows = placed.withColumn("x", F.explode(F.when(tail, F.array(
        F.struct(at.alias("c"), F.lit(True).alias("o")), F.struct((at + 1).alias("c"), F.lit(False).alias("o")))).otherwise(
        F.array(F.struct(at.alias("c"), F.lit(True).alias("o"))))))
    frame = Window.partitionBy(*by, "x.c").orderBy("pos").rowsBetween(-(window - 1), 0)
    smooth = rows.withColumn("a", F.avg("v").over(frame)).where("x.o")
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return _join(smooth, sizes, by).select(*by, "pos", "v", F.when(F.col("n") < window, F.col("v")).otherwise(F.round("a", 3)).alias("smooth"))


def forecast_next(placed: DataFrame, by: By, horizon: int = 1) -> DataFrame:
    """The value `horizon` steps after the last by the line with rounded coefficients, with bounds of two RMSE."""
    line = linear_regression(placed, by).where("n >= 2")
    off = F.col("v") - (F.col("slope") * F.col("pos") + F.col("intercept"))
    fit = _join(placed, line.select(*by, "n", "slope", "intercept", "r", "direction"), by).groupBy(*by, "n", "slope", "intercept", "r", "direction").agg(
        F.sqrt(F.avg(off * off)).alias("rmse"))
    ahead = F.col("slope") * (F.col("n") + horizon - 1) + F.col("intercept")
    return fit.select(*by, "slope", "intercept", "r", "direction", F.round(ahead, 3).alias("next"),
                      F.round(ahead + 2 * F.col("rmse"), 3).alias("upper"), F.round(ahead - 2 * F.col("rmse"), 3).alias("lower"))


def health_index(current: Column, threshold: Column) -> Column:
    return F.when(F.coalesce(threshold, F.lit(0.0)) == 0, 1.0).otherwise(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(current) / F.abs(threshold))), 3))


def rul(placed: DataFrame, by: By, threshold: float | None) -> DataFrame:
    """Steps until the line from the last value reaches the threshold; null if it moves away from it or there is none."""
    line = linear_regression(placed, by).where("n >= 2")
    limit = F.lit(threshold).cast("double")
    moving = (F.abs("slope") >= 1e-9) & ((F.col("slope") > 0) == (limit > F.col("last")))
    return line.select(
        *by, "slope", "last", F.when(moving, F.round(F.greatest(F.lit(0.0), (limit - F.col("last")) / F.col("slope")), 1)).alias("rul"),
        health_index(F.col("last"), limit).alias("health"))


def risk_level(placed: DataFrame, by: By, approx: bool = False) -> DataFrame:
    """low, medium, high or critical by the last value's deviation, the volatility and a rise of the last three."""
    spread = mad(placed.withColumnRenamed("v", "value"), by, "value", approx)
    count = placed.groupBy(*by).agg(F.max("pos").alias("end"))
    last = _join(placed, count, by).where("pos > end - 3").groupBy(*by).agg(
        F.max(F.when(F.col("pos") == F.col("end"), F.col("v"))).alias("v1"), F.max(F.when(F.col("pos") == F.col("end") - 1, F.col("v"))).alias("v2"),
        F.max(F.when(F.col("pos") == F.col("end") - 2, F.col("v"))).alias("v3"))
    rows = _join(spread, last, by)
    scale = F.when(F.col("mad") < 1e-9, F.greatest(F.abs("mean") * 0.05, F.lit(1e-9))).otherwise(F.col("mad"))
    dev = F.abs(F.col("v1") - F.col("center")) / scale
    volatility = scale / (F.abs("mean") + 1e-9)
    rising = F.coalesce((F.col("v1") > F.col("v2")) & (F.col("v2") > F.col("v3")), F.lit(False))
    above = F.col("v1") > F.col("center")
    level = (
        F.when(F.col("n") < 2, "low").when((dev > 3) & rising & above, "critical")
        .when((dev > 2.5) | (rising & above & (dev > 1.5)) | (volatility > 0.5), "high").when((dev > 1.5) | (volatility > 0.3), "medium").otherwise("low"))
    return rows.select(*by, F.round(dev, 3).alias("deviation"), F.round(volatility, 3).alias("volatility"), level.alias("risk"))


def adaptive_threshold(df: DataFrame, by: By, value: str, k: float = 3.0, true_median: bool = True, approx: bool = False) -> DataFrame:
    """Bounds at k MADs around the true or the upper median, for series of three values or more. A zero MAD is
    replaced by a tenth of the true median (1 if that is 0), or of the mean with the upper median."""
    rows = mad(df, by, value, approx).where("n >= 3")
    center = F.col("median") if true_median else F.col("center")
    spare = F.when(center == 0, 1.0).otherwise(center * 0.1) if true_median else F.col("mean") * 0.1
    width = F.when(F.col("mad") == 0, spare).otherwise(F.col("mad"))
    return rows.select(*by, F.round(center, 3).alias("center"), F.round(center + k * width, 3).alias("upper"),
                       F.round(center - k * width, 3).alias("lower"), F.round(width, 3).alias("mad"))


def anomaly_zscore(placed: DataFrame, by: By, threshold: float = 3.0) -> DataFrame:
    stats = placed.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n")).where("n >= 4")
    std = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return _join(placed, stats, by).where(F.abs(F.col("v") - F.col("mean")) > threshold * std).select(
        *by, "pos", F.round("v", 3).alias("value"), F.round((F.col("v") - F.col("mean")) / std, 2).alias("zscore"))


def anomaly_iqr(placed: DataFrame, by: By, approx: bool = False) -> DataFrame:
    """Values outside the fences of 1.5 interquartile ranges; the quartiles are rounded to 3 first."""
    q = placed.groupBy(*by).agg(quantile_of("v", 0.25, approx).alias("q1"), quantile_of("v", 0.75, approx).alias("q3"), F.count("v").alias("n")).where("n >= 4")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return _join(placed, q, by).where(~F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)).select(*by, "pos", F.round("v", 3).alias("value"))


def anomaly_mad(placed: DataFrame, by: By, k: float = 3.0, approx: bool = False) -> DataFrame:
    spread = mad(placed.withColumnRenamed("v", "value"), by, "value", approx).where("n >= 4")
    width = F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))
    off = F.col("v") - F.col("median")
    return _join(placed, spread, by).where(F.abs(off) > k * width).select(*by, "pos", F.round("v", 3).alias("value"), F.round(off / width, 2).alias("zscore"))


def cpk(df: DataFrame, by: By, value: str, usl: float | None = None, lsl: float | None = None) -> DataFrame:
    """Process capability for series of four values or more."""
    stats = values_of(df, by, value).groupBy(*by).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n")).where("n >= 4")
    std = F.when(F.col("sd") == 0, 1e-9).otherwise(F.col("sd"))
    up, low = F.lit(usl).cast("double"), F.lit(lsl).cast("double")
    cpu, cpl = F.round((up - F.col("_m")) / (3 * std), 3), F.round((F.col("_m") - low) / (3 * std), 3)
    worst = F.least(cpu, cpl)
    return stats.select(
        *by, F.when(up - low > 0, F.round((up - low) / (6 * std), 3)).alias("cp"), worst.alias("cpk"), cpu.alias("cpu"), cpl.alias("cpl"),
        F.round(std, 3).alias("sigma"), F.round("_m", 3).alias("mean"),
        F.when(worst < 1.0, "能力不足").when(worst < 1.33, "能力尚可").when(worst.isNotNull(), "能力充分").alias("judge"))


def spc_run_rule(placed: DataFrame, by: By, length: int = 7) -> DataFrame:
    """The first start of `length` values in a row strictly on one side of the mean: run_start, side."""
    mean = placed.groupBy(*by).agg(F.avg("v").alias("mean"))
    signed = _join(placed, mean, by).withColumn("sign", F.signum(F.col("v") - F.col("mean")))
    ahead = Window.partitionBy(*by, "chunk").orderBy("pos").rowsBetween(0, length - 1)
    runs = chunked(signed, by, length - 1).select(
        *by, "pos", "own", F.min("sign").over(ahead).alias("low"), F.max("sign").over(ahead).alias("high"), F.count("sign").over(ahead).alias("n"))
    hit = runs.where(F.col("own") & (F.col("n") == length) & (F.col("low") == F.col("high")) & (F.col("low") != 0))
    return hit.groupBy(*by).agg(F.min("pos").alias("run_start"), F.min_by(F.when(F.col("low") > 0, "above").otherwise("below"), "pos").alias("side"))


def spc_trend_rule(placed: DataFrame, by: By, length: int = 6) -> DataFrame:
    """The first start of `length` values that strictly rise or fall: trend_start, trend_direction."""
    per = Window.partitionBy(*by, "chunk").orderBy("pos")
    steps = chunked(placed, by, length).withColumn("step", F.signum(F.lead("v").over(per) - F.col("v")))
    ahead = per.rowsBetween(0, length - 2)
    runs = steps.select(*by, "pos", "own", F.min("step").over(ahead).alias("low"), F.max("step").over(ahead).alias("high"), F.count("step").over(ahead).alias("n"))
    hit = runs.where(F.col("own") & (F.col("n") == length - 1) & (F.col("low") == F.col("high")) & (F.col("low") != 0))
    return hit.groupBy(*by).agg(F.min("pos").alias("trend_start"), F.min_by(F.when(F.col("low") > 0, "rising").otherwise("falling"), "pos").alias("trend_direction"))


def control_chart(placed: DataFrame, by: By) -> DataFrame:
    """Center line, three-sigma limits, points outside, run and trend rule, and the verdict of each series."""
    stats = placed.groupBy(*by).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"), F.count("v").alias("n")).where("n >= 2")
    outside = (F.col("v") > F.col("_m") + 3 * F.col("_s")) | (F.col("v") < F.col("_m") - 3 * F.col("_s"))
    limits = _join(placed, stats, by).groupBy(*by, "_m", "_s", "n").agg(F.count_if(outside).alias("n_outside"))

    def left(a: DataFrame, b: DataFrame) -> DataFrame:
        renamed = b.select(*[F.col(c).alias(f"__{c}") for c in by], *[c for c in b.columns if c not in by])
        cond = F.lit(True)
        for c in by:
            cond = cond & a[c].eqNullSafe(renamed[f"__{c}"])
        return a.join(renamed, cond, "left").drop(*[f"__{c}" for c in by])

    full = left(left(limits, spc_run_rule(placed, by)), spc_trend_rule(placed, by))
    bad = (F.col("n_outside") > 0) | F.col("run_start").isNotNull() | F.col("trend_start").isNotNull()
    return full.select(
        *by, "n", F.round("_m", 3).alias("mean"), F.round("_s", 3).alias("std"), F.round(F.col("_m") + 3 * F.col("_s"), 3).alias("ucl"),
        F.round(F.col("_m") - 3 * F.col("_s"), 3).alias("lcl"), "n_outside", "run_start", "side", "trend_start", "trend_direction",
        F.when(bad, "失控").otherwise("受控").alias("judge"))
