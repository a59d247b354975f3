"""Percentiles per group by radix selection over order-preserving integers.

A double is mapped to a signed 64-bit integer of the same order: its IEEE
bits, with all bits but the sign flipped below 0. The bits are then read in
digits, highest first. Per group and digit the rows are counted (a histogram,
summed on the map side), and only the digit that holds a wanted rank is
followed into the next level. After all 64 bits the value at the rank is
exact; no column is sorted and no group is collected anywhere. A window only
runs over the histogram of a group, at most 2 ** digit rows.

Stopping early bounds the error: a histogram of the highest ``bits`` bits (the
*summary*) knows each value up to a relative error of ``2 ** (11 - bits)``, and
is a plain table of counts, so the summaries of separate partitions, days or
slices are combined by adding counts and give the same table as one summary of
all rows.

Null and NaN values are missing and are left out, as are rows with a null
group; -0.0 counts as 0.0; infinities are the ends of the order. A group
without a value is not in the result; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut

DIGITS = (20, 22, 22)
MANTISSA = 52
LOWEST = -1022  # exponent of the smallest normal double; below it lie the subnormal ones
STEEP = 537  # 2 ** -1074 is the smallest double; its inverse overflows, so it is taken in two steps


def order_key(x: Column) -> Column:
    """The order-preserving signed 64-bit integer of a double that is neither null
    nor NaN: its IEEE bits, worked out by exact arithmetic in generated code."""
    size = F.abs(x)
    guess = F.greatest(F.lit(LOWEST), F.least(F.lit(1023), F.floor(F.log2(size)).cast("int")))
    # the logarithm may be off by one next to a power of two
    power = F.when(size < F.pow(F.lit(2.0), guess), guess - 1).when(size / F.pow(F.lit(2.0), guess) >= 2, guess + 1).otherwise(guess)
    inside = (size / F.pow(F.lit(2.0), power) - 1) * float(1 << MANTISSA)
    normal = (power + 1023).cast("long") * (1 << MANTISSA) + inside.cast("long")
    tiny = (size * float(2**STEEP) * float(2**STEEP)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << MANTISSA)).when(size < 2.0**LOWEST, tiny).otherwise(normal)
    return F.when(x < 0, -bits - 1).otherwise(bits)


def key_value(key: Column) -> Column:
    """The double of an :func:`order_key`."""
    bits = F.when(key >= 0, key).otherwise(-key - 1)
    power = F.shiftright(bits, MANTISSA).cast("int")
    inside = bits.bitwiseAND(F.lit((1 << MANTISSA) - 1)).cast("double")
    normal = (inside / float(1 << MANTISSA) + 1) * F.pow(F.lit(2.0), power - 1023)
    tiny = inside / float(2**STEEP) / float(2**STEEP)
    size = F.when(power == 2047, F.lit(float("inf"))).when(power == 0, tiny).otherwise(normal)
    return F.when(key >= 0, size).otherwise(-size)


def with_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """The rows with a value, and its :func:`order_key` as column ``key``: worked out
    once where rows are multiplied afterwards."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(key, order_key(F.col(value).cast("double")))


def _keyed(df: DataFrame, groups: Sequence[str], value: str | None, key: str | None = None) -> DataFrame:
    rows = df if key else with_key(df, value, "_key")
    keep = F.col(key or "_key").isNotNull()
    for g in groups:
        keep = keep & F.col(g).isNotNull()
    return rows.where(keep).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(key or "_key").alias("_key"))


def _wanted(n: Column, quantiles: Sequence[float]) -> Column:
    """The 0-based ranks around each quantile, for linear interpolation."""
    at = [F.lit(float(q)) * (n - 1) for q in quantiles]
    return F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))


def radix_quantiles(df: DataFrame, groups: Sequence[str], value: str | None, quantiles: Sequence[float], digits: Sequence[int] = DIGITS, key: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks:
    the group columns, ``n`` and ``q``, an array in the order of ``quantiles``.
    ``key`` names a column of :func:`with_key` to take instead of ``value``.

    A level is one scan, one join with the digits followed so far and one
    aggregation; these digits, at most two a quantile and group, are written
    down between levels, so a level's plan doesn't hold the earlier ones.
    """
    if sum(digits) != 64 or not quantiles or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("digits must add to 64 and quantiles lie in 0..1")
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = _keyed(df, groups, value, key)
    carried = ["_p", "_n", "_start", "_ranks"]
    within = Window.partitionBy(*keys, "_p").orderBy("_d")
    done = 0
    followed: DataFrame | None = None
    for digit in digits:
        before, done = 64 - done, done + digit
        prefix = F.shiftright("_key", 64 - done) if done < 64 else F.col("_key")
        if followed is None:
            counted = rows.groupBy(*keys, F.lit(0).cast("long").alias("_p"), prefix.alias("_d")).agg(F.count("*").alias("_c"))
            counted = counted.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys, "_p"))).withColumn("_start", F.lit(0).cast("long")).withColumn("_ranks", _wanted(F.col("_n"), quantiles))
        else:
            inside = rows.withColumn("_p", F.shiftright("_key", before)).join(followed, [*keys, "_p"])
            counted = inside.groupBy(*keys, *carried, prefix.alias("_d")).agg(F.count("*").alias("_c"))
        first = F.col("_start") + F.sum("_c").over(within) - F.col("_c")
        held = F.expr("filter(_ranks, r -> r >= _first and r < _first + _c)")
        step = counted.withColumn("_first", first).withColumn("_ranks", held).where(F.size("_ranks") > 0)
        step = step.select(*keys, F.col("_d").alias("_p"), "_n", F.col("_first").alias("_start"), "_ranks")
        followed = step if done == 64 else cut(step)
    found = followed.select(*keys, "_n", key_value(F.col("_p")).alias("_x"), F.explode("_ranks").alias("_r"))
    at = found.groupBy(*keys).agg(F.first("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))

    def interpolated(q: float) -> Column:
        pos = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        a, b = F.element_at("_m", low), F.element_at("_m", high)
        return F.when(low == high, a).otherwise(a + (b - a) * (pos - low))

    return at.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], "n", F.array(*[interpolated(q) for q in quantiles]).alias("q"))


def summarize(df: DataFrame, groups: Sequence[str], value: str | None, bits: int = 23, key: str | None = None) -> DataFrame:
    """The mergeable form: the group columns, ``prefix`` (highest ``bits`` bits
    of the key) and ``c``, the number of values with it. At most
    ``2 ** bits`` rows a group, in practice one per distinct rounded value."""
    if not 13 <= bits <= 63:
        raise ValueError("bits must be in 13..63")
    keys = [f"_g{i}" for i in range(len(groups))]
    counted = _keyed(df, groups, value, key).groupBy(*keys, F.shiftright("_key", 64 - bits).alias("prefix")).agg(F.count("*").alias("c"))
    return counted.select(*[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], "prefix", "c")


def combine(summaries: Sequence[DataFrame]) -> DataFrame:
    """The summary of all rows from the summaries of their slices."""
    every = reduce(DataFrame.unionByName, summaries)
    groups = [c for c in every.columns if c not in ("prefix", "c")]
    return every.groupBy(*groups, "prefix").agg(F.sum("c").alias("c"))


def summary_quantiles(summary: DataFrame, quantiles: Sequence[float], bits: int = 23) -> DataFrame:
    """Nearest-rank quantiles (rank ceil(q * n), at least 1) of a summary: the
    group columns, ``n`` and ``q``. Each is the middle of the bin that holds
    the rank, so it is within ``2 ** (11 - bits)`` of the value at that rank."""
    groups = [c for c in summary.columns if c not in ("prefix", "c")]
    over = Window.partitionBy(*groups)
    n = F.sum("c").over(over)
    last = F.sum("c").over(over.orderBy("prefix"))
    shift = 64 - bits
    middle = key_value(F.shiftleft("prefix", shift).bitwiseOR(F.lit(1 << (shift - 1))))
    ranked = summary.withColumn("n", n).withColumn("_last", last)
    picks = [F.min(F.when(F.col("_last") >= F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))), F.struct("_last", "_x"))).getField("_x") for q in quantiles]
    return ranked.withColumn("_x", middle).groupBy(*groups, "n").agg(F.array(*picks).alias("q"))
