"""Association statistics over long tables (basket, item), never a matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.maths import chi2_critical, chi2_tail
from loomwork.session import cut


def vocabulary(mentions: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """``(item, n_item)`` of items in at least ``least`` different baskets."""
    return mentions.where(F.col(item).isNotNull() & F.col(basket).isNotNull()).groupBy(item).agg(F.count_distinct(basket).alias("n_item")).where(F.col("n_item") >= least)


def group_counts(mentions: DataFrame, basket: str, item: str, groups: DataFrame, group: str) -> DataFrame:
    """``(group, item, n)`` with grouping sets: both, each alone (the other null)
    and the total. Only baskets whose group is known count; ``groups`` has (basket, group), one row a basket."""
    known = groups.where(F.col(group).isNotNull()).select(basket, group)
    pairs = known.join(mentions.select(basket, item).distinct(), basket)
    cells = pairs.groupingSets([[group, item], [item]], group, item).agg(F.count_distinct(basket).alias("n"), F.grouping(group).alias("_all"))
    sizes = known.groupingSets([[group], []], group).agg(F.count_distinct(basket).alias("n"), F.grouping(group).alias("_all"))
    return cells.select(F.when(F.col("_all") == 0, F.col(group)).alias(group), item, "n").unionByName(sizes.select(group, F.lit(None).cast("string").alias(item), "n"))


def chi2_grid(mentions: DataFrame, basket: str, item: str, groups: DataFrame, group: str, least: int = 1, alpha: float = 0.05, p_values: bool = False) -> DataFrame:
    """Chi-squared (2 x 2, no correction) of every group with every item of the
    vocabulary, cells without a common basket too.

    ``(group, item, n_ab, n_group, n_item, n, rate_in, rate_out, chi2, positive,
    significant)``, significant at ``alpha`` over all tests of the grid
    (Bonferroni). The vocabulary is counted over all baskets, the cells over
    baskets of a known group. The grid is small by nature: groups x vocabulary.
    """
    words = vocabulary(mentions, basket, item, least).select(item)
    known = groups.where(F.col(group).isNotNull()).select(basket, group)
    rows = mentions.select(basket, item).distinct().join(words, item).join(known, basket)
    cells = rows.groupBy(group, item).agg(F.count("*").alias("n_ab"))
    sizes = known.groupBy(group).agg(F.count("*").alias("n_group"))
    margins = words.join(cells.groupBy(item).agg(F.sum("n_ab").alias("n_item")), item, "left")
    total = sizes.agg(F.sum("n_group").alias("n"), F.count("*").alias("_g")).crossJoin(words.agg(F.count("*").alias("_w")))
    tests = total.collect()[0]  # one row
    grid = sizes.crossJoin(margins).join(cells, [group, item], "left")
    a, g, s, n = F.coalesce(F.col("n_ab"), F.lit(0)), F.col("n_group"), F.coalesce(F.col("n_item"), F.lit(0)), F.lit(tests["n"] or 0)
    below = g.cast("double") * (n - g) * s * (n - s)
    chi2 = F.when(below > 0, n * F.pow((a * (n - g - s + a) - (g - a) * (s - a)).cast("double"), 2) / F.nullif(below, F.lit(0.0))).otherwise(0.0)
    limit = chi2_critical(alpha, (tests["_g"] or 0) * (tests["_w"] or 0))
    rate_in, rate_out = a / g, F.coalesce((s - a) / F.nullif(n - g, F.lit(0)), F.lit(0.0))
    out = grid.select(group, item, a.alias("n_ab"), "n_group", s.alias("n_item"), n.alias("n"), rate_in.alias("rate_in"), rate_out.alias("rate_out"), chi2.alias("chi2"), (rate_in > rate_out).alias("positive"), (chi2 > limit).alias("significant"))
    return out.withColumn("p_value", chi2_tail("chi2")) if p_values else out


GATHERED = 1 << 20  # pairs a task holds before it counts them
PART = 2000


def _pairs_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts pairs within the task, so that counts are shuffled and not pairs. A
    unit is a sorted list of item codes; with ``_right`` each pairs with each of
    that list instead of with its own later ones."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs >> 32, pa.int64()), pa.array(pairs & 0xFFFFFFFF, pa.int64()), pa.array(n, pa.int64())], ["_x", "_y", "k"])

    for batch in batches:
        for left, right in zip(batch.column("_left"), batch.column("_right"), strict=True):
            a = left.values.to_numpy()
            if right.is_valid:
                b = right.values.to_numpy()
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            else:
                i, j = np.triu_indices(len(a), 1)
                x, y = a[i], a[j]
            held.append(np.minimum(x, y).astype(np.int64) << 32 | np.maximum(x, y))
            size += len(x)
            if size > GATHERED:
                yield out()
                size = 0
    if held:
        yield out()


def pmi_pairs(mentions: DataFrame, basket: str, item: str, n_baskets: int | None = None, least: int = 5, words: DataFrame | None = None, part: int = PART) -> DataFrame:
    """``(item_a, item_b, n_ab, pmi, npmi)``, item_a < item_b, over distinct
    mentions; ``n_baskets`` counts baskets without any item too (default: those
    with one). Items in fewer than ``least`` baskets are left out beforehand, so
    a basket's list is bounded by the vocabulary; one of more than ``part`` items
    is cut into parts, and each two parts are paired in a task of their own."""
    base = mentions.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(basket, item).distinct()
    base = base.join(words.select(item), item, "left_semi") if words is not None else base
    counts = base.groupBy(item).agg(F.count("*").alias("c"))
    busy = base.join(counts.where(F.col("c") >= least), item, "left_semi")
    # codes in the order of the names, so that a smaller code is a smaller name
    coded = cut(counts.where(F.col("c") >= least).select(item).withColumn("_code", F.row_number().over(Window.orderBy(item)).cast("long")))  # the vocabulary
    lists = busy.join(coded, item).groupBy(basket).agg(F.array_sort(F.collect_list("_code")).alias("_all")).where(F.size("_all") > 1)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / part)), lambda i: F.slice("_all", (i * part + 1).cast("int"), part))
    none = F.lit(None).cast("array<bigint>")
    units = F.flatten(F.transform("_parts", lambda p, i: F.transform(F.slice("_parts", i + 1, F.size("_parts")), lambda q: F.struct(p.alias("_left"), F.when(F.array_min(p) != F.array_min(q), q).otherwise(none).alias("_right")))))
    large = lists.where(F.size("_all") > part).withColumn("_parts", parts).select(F.explode(units).alias("u")).select("u.*").repartition(F.xxhash64("_left", "_right"))
    unit = lists.where(F.size("_all") <= part).select(F.col("_all").alias("_left"), none.alias("_right")).unionByName(large)
    counted = unit.mapInArrow(_pairs_of_units, "_x long, _y long, k long").groupBy("_x", "_y").agg(F.sum("k").alias("n_ab")).where(F.col("n_ab") >= least)
    pairs = counted.join(coded.select(F.col("_code").alias("_x"), F.col(item).alias("item_a")), "_x").join(coded.select(F.col("_code").alias("_y"), F.col(item).alias("item_b")), "_y").select("item_a", "item_b", "n_ab")
    pairs = pairs.join(counts.select(F.col(item).alias("item_a"), F.col("c").alias("_ca")), "item_a").join(counts.select(F.col(item).alias("item_b"), F.col("c").alias("_cb")), "item_b")
    total = base.agg(F.count_distinct(basket).alias("_n")) if n_baskets is None else base.sparkSession.range(1).select(F.lit(n_baskets).alias("_n"))
    pmi = F.ln(F.col("n_ab").cast("double") * F.col("_n") / (F.col("_ca") * F.col("_cb")))
    rarity = -F.ln(F.col("n_ab").cast("double") / F.col("_n"))
    return pairs.crossJoin(F.broadcast(total)).select("item_a", "item_b", "n_ab", pmi.alias("pmi"), F.coalesce(pmi / F.nullif(rarity, F.lit(0.0)), F.lit(1.0)).alias("npmi"))


def group_rates(mentions: DataFrame, basket: str, item: str, groups: DataFrame, group: str, least: int = 3, words: DataFrame | None = None) -> DataFrame:
    """``(group, item, n_with, n_group, rate)`` where at least ``least`` baskets of the group have the item."""
    known = groups.where(F.col(group).isNotNull()).select(basket, group)
    sizes = known.groupBy(group).agg(F.count("*").alias("n_group"))
    base = mentions.where(F.col(item).isNotNull()).select(basket, item).distinct()
    base = base.join(words.select(item), item, "left_semi") if words is not None else base
    return known.join(base, basket).groupBy(group, item).agg(F.count("*").alias("n_with")).where(F.col("n_with") >= least).join(sizes, group).withColumn("rate", F.col("n_with") / F.col("n_group"))


def top_partner(pairs: DataFrame) -> DataFrame:
    """Of ``(item_a, item_b, n_ab)``: each item's most frequent partner (ties to
    the smaller name) and whether it is the only one so frequent."""
    both = pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("partner"), "n_ab").unionByName(pairs.select(F.col("item_b").alias("item"), F.col("item_a").alias("partner"), "n_ab"))
    order = Window.partitionBy("item").orderBy(F.desc("n_ab"), "partner")
    ranked = both.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("n_ab").over(order))
    return ranked.where(F.col("_r") == 1).select("item", "partner", "n_ab", (F.col("_next").isNull() | (F.col("_next") < F.col("n_ab"))).alias("unique_top"))
