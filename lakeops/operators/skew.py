"""Exact order statistics and ranks that never put one group into one task.

A hot key may own a third of all rows, so nothing here sorts or collects a
whole group. Rows are first cut into buckets that follow the order (a minute, a
narrow band of values); bucket counts give every bucket its offset inside the
group, and only rows inside one bucket are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.session import cut_lineage

MICROS = 1_000_000


def units(value: Column, scale: int = 6) -> Column:
    """A number as a whole count of ``10**-scale``."""
    return F.rint(value * F.lit(float(10 ** scale))).cast("bigint")


def wide_sum(whole: Column) -> Column:
    """Sum of bigints as decimal, past the range of bigint.

    High and low bits are added apart, so the aggregation stays on longs.
    """
    high, low = F.sum(F.shiftright(whole, 20)), F.sum(whole.bitwiseAND(F.lit((1 << 20) - 1)))
    return high.cast("decimal(25,0)") * F.lit(1 << 20).cast("decimal(7,0)") + low.cast("decimal(20,0)")


def exact_sum(value: Column, scale: int = 6) -> Column:
    """Sum to ``scale`` digits, returned as double: the same whatever the row order or retry.

    Values too large for a bigint of units are added as decimals. NaN or an infinite value makes the sum NaN, values
    of 10**31 and more make it infinite.
    """
    value = value.cast("double")
    size, bound = F.abs(value), float((1 << 62) // 10 ** scale)
    odd = F.isnan(value) | (size == float("inf"))
    small = wide_sum(units(F.when(size < bound, value), scale))
    large = F.sum(F.when((size >= bound) & (size < 1e31) & ~odd, value).cast(f"decimal(38,{scale})"))
    # what kinds of values there are: 1 NaN or infinite, 2 too large to add, 4 others
    kinds = F.bit_or(F.when(value.isNull(), 0).when(odd, 1).when(size >= 1e31, 2).otherwise(4))
    total = F.coalesce(small.cast("double") / F.lit(float(10 ** scale)), F.when(kinds > 0, F.lit(0.0)))
    total = F.when(large.isNotNull(), total + large.cast("double")).otherwise(total)
    return F.when(kinds.bitwiseAND(F.lit(1)) > 0, F.lit(float("nan"))).when(kinds.bitwiseAND(F.lit(2)) > 0, F.lit(float("inf"))).otherwise(total)


def exact_avg(value: Column, scale: int = 6) -> Column:
    """Mean over non-NULL values built on :func:`exact_sum`."""
    return F.try_divide(exact_sum(value, scale), F.count(value).cast("double"))


def bucket_offsets(counts: DataFrame, keys: Sequence[str], bucket: str, n: str = "n") -> DataFrame:
    """Add ``before`` (rows in earlier buckets) and ``total`` to one row per (keys, bucket)."""
    ordered = Window.partitionBy(*keys).orderBy(bucket)
    return counts.withColumns({
        "before": F.coalesce(F.sum(n).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum(n).over(Window.partitionBy(*keys)),
    })


def value_band(value: Column) -> Column:
    """Monotone band of a number, 4096 to each doubling.

    Values of microsecond resolution up to a day and a half (2**17 s) have at
    most 2**17 * 10**6 / 4096, some 32 million, distinct values in one band.
    """
    band = F.floor(F.log2(F.abs(value) + F.lit(1.0)) * F.lit(4096))
    return F.when(value < 0, -band).otherwise(band).cast("bigint")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key group, exact and skew-safe.

    Groups with a NULL key have none. ``probs`` maps output column to probability. Values are reduced to distinct
    (key, value) counts map-side; the bands holding the wanted ranks are found
    from band counts, and only those bands are ordered.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", value_band(F.col("_v")))
        .repartition(*keys, "_band")  # shared by both branches below: planned once, reused
    )
    # the largest value is asked for so that both branches read all columns of one shuffle
    bands = bucket_offsets(counts.groupBy(*keys, "_band").agg(F.sum("_n").alias("n"), F.max("_v").alias("_top")), keys, "_band")

    def rank(p: float, up: bool) -> Column:
        pos = F.lit(p) * (F.col("total") - 1)
        return (F.ceil(pos) if up else F.floor(pos)).cast("bigint")

    def inside(r: Column, start: Column, size: Column) -> Column:
        return (r >= start) & (r < start + size)

    wanted = F.lit(False)
    for p in probs.values():
        for up in (False, True):
            wanted = wanted | inside(rank(p, up), F.col("before"), F.col("n"))
    picked = counts.join(bands.where(wanted & F.col("_top").isNotNull()).drop("_top"), [*keys, "_band"])
    run = Window.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = picked.withColumn("_start", F.col("before") + F.sum("_n").over(run) - F.col("_n"))
    aggs = []
    for name, p in probs.items():
        for tag, up in (("lo", False), ("hi", True)):
            hit = inside(rank(p, up), F.col("_start"), F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{tag}"))
    agg = placed.groupBy(*keys).agg(F.max("total").alias("_total"), *aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        frac = pos - F.floor(pos)
        out.append((F.col(f"_{name}_lo") * (F.lit(1.0) - frac) + F.col(f"_{name}_hi") * frac).alias(name))
    return agg.select(*keys, *out)


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, smallest value on a tie."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def ranked_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Row number inside each key group, with groups of any size spread over tasks.

    Rows are range-partitioned by key and order and written, which fixes the
    partition of every row; counts per partition give the offset of each part.
    ``order`` must be unique inside a group.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "ranged")
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = bucket_offsets(sizes, keys, "_part", "_n").select(*keys, "_part", F.col("before").alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return ranged.join(offsets, [*keys, "_part"]).withColumn(
        out, F.col("_offset") + F.row_number().over(inside)).drop("_part", "_offset")


def half_means(df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str) -> DataFrame:
    """Means of the first ⌊n/2⌋ rows in time order and of the rest, per group.

    Minute totals settle every minute that lies wholly in one half. The one
    minute per group that straddles the middle is written out as a table with a
    row per group, so the second look at the rows keeps only those minutes,
    without a shuffle of the others where that table is small enough to broadcast.
    Inside that minute the same is done by instant, second by second, so no task orders more than the 60 seconds of a
    minute or the million instants of a second. Only rows of the instant that straddles the middle are ordered, by
    ranges, so many rows of one group and one instant are spread over tasks as well.
    """
    keys = list(keys)
    rows = df.select(
        *keys, time, tie, units(F.col(value)).alias("_v"),
        F.floor(F.unix_micros(time) / F.lit(60 * MICROS)).alias("_minute"),
    )
    minutes = rows.groupBy(*keys, "_minute").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"))
    placed = bucket_offsets(minutes, keys, "_minute").withColumn("mid", F.floor(F.col("total") / 2))
    first, second = F.col("before") + F.col("n") <= F.col("mid"), F.col("before") >= F.col("mid")
    split = ~(first | second)
    groups = cut_lineage(placed.groupBy(*keys).agg(
        F.max("total").alias("total"), F.max("mid").alias("mid"),
        wide_sum(F.when(first, F.col("s"))).alias("s1"), wide_sum(F.when(second, F.col("s"))).alias("s2"),
        F.max(F.when(split, F.col("_minute"))).alias("_minute"), F.max(F.when(split, F.col("before"))).alias("before"),
    ), "halves")
    # one minute of each group, read again below: written, so that the rows are scanned twice in all
    straddling = cut_lineage(rows.join(groups.select(*keys, "_minute", F.col("before").alias("_base"), "mid"), [*keys, "_minute"]), "straddling")
    instants = straddling.groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s"), F.max("_base").alias("_base"), F.max("mid").alias("mid")).withColumn(
        "_second", F.floor(F.unix_micros(time) / F.lit(MICROS)))
    seconds = bucket_offsets(instants.groupBy(*keys, "_second").agg(F.sum("n").alias("n")), keys, "_second").select(
        *keys, "_second", F.col("before").alias("_sooner"))
    inside = Window.partitionBy(*keys, "_second").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    placed = instants.join(seconds, [*keys, "_second"]).withColumn(
        "_start", F.col("_base") + F.col("_sooner") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    first, second = F.col("_start") + F.col("n") <= F.col("mid"), F.col("_start") >= F.col("mid")
    whole = placed.where(first | second).select(*keys, F.when(first, F.col("s")).alias("c1"), F.when(second, F.col("s")).alias("c2"))
    one = placed.where(~(first | second)).select(*keys, time, "_start")
    in_first = F.col("_start") + F.col("_rank") <= F.col("mid")
    parted = ranked_by_range(straddling.join(one, [*keys, time]), [*keys, time], [tie, "_v"], "_rank").select(
        *keys, F.when(in_first, F.col("_v")).alias("c1"), F.when(~in_first, F.col("_v")).alias("c2"))
    cut = whole.unionByName(parted).groupBy(*keys).agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))

    def mean(whole: str, part: str, n: Column) -> Column:
        zero = F.lit(0).cast("decimal(34,0)")
        both = (F.coalesce(whole, zero) + F.coalesce(part, zero)).cast("double") / F.lit(1e6)
        return F.try_divide(both, n.cast("double"))

    return groups.join(cut, keys, "left").select(
        *keys, F.col("total").alias("half_rows"),
        mean("s1", "c1", F.col("mid")).alias("first_half_mean"),
        mean("s2", "c2", F.col("total") - F.col("mid")).alias("second_half_mean"))


def trailing_counts(df: DataFrame, key: str, time: str, seconds: int, out: str) -> DataFrame:
    """Rows of the same key in ``[t - seconds, t]`` for every row, both ends included.

    Rows first shrink to instants (microseconds). Each instant asks two running counts, one at its own time and one
    just before the window opens. Both add up over buckets of falling width: minutes before inside the key, seconds
    before inside the minute (at most 60), instants before inside the second (at most a million, each with one window
    opening). So no task orders more than one key's minutes or one second's instants, whatever share of all rows a key
    or a minute holds. Rows without a key or a time have no count.
    """
    stamped = df.withColumn("_at", F.unix_micros(time))
    instants = stamped.groupBy(key, "_at").agg(F.count(F.lit(1)).alias("_n"))
    points = instants.select(
        key, "_at",
        F.explode(F.array(
            F.struct(F.lit(1).alias("call"), F.col("_at").alias("at"), F.col("_n").alias("n")),
            F.struct(F.lit(0).alias("call"), (F.col("_at") - F.lit(seconds * MICROS)).alias("at"), F.lit(0).cast("bigint").alias("n")),
        )).alias("p"),
    ).select(key, "_at", "p.call", "p.at", F.col("p.n").alias("_n"), F.floor(F.col("p.at") / F.lit(MICROS)).alias("_second"))
    sizes = points.groupBy(key, "_second").agg(F.sum("_n").alias("n")).withColumn("_minute", F.floor(F.col("_second") / 60))
    def before(counts: DataFrame, within: Sequence[str], bucket: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    minutes = before(sizes.groupBy(key, "_minute").agg(F.sum("n").alias("n")), [key], "_minute", "_base").drop("n")
    offsets = before(sizes, [key, "_minute"], "_second", "before").join(minutes, [key, "_minute"]).select(
        key, "_second", (F.col("_base") + F.col("before")).alias("before"))
    # a window opening sorts before calls of the same instant, so it does not count them
    upto = Window.partitionBy(key, "_second").orderBy("at", "call").rowsBetween(Window.unboundedPreceding, 0)
    placed = points.join(offsets, [key, "_second"]).withColumn("_seen", F.col("before") + F.sum("_n").over(upto))
    signed = placed.select(key, "_at", F.when(F.col("call") == 1, F.col("_seen")).otherwise(-F.col("_seen")).alias("_seen"))
    counted = signed.groupBy(key, "_at").agg(F.sum("_seen").alias(out))
    return stamped.join(counted, [key, "_at"], "left").select(*[F.col(c) for c in df.columns], out)
