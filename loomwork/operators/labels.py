"""Sheets of pairs to label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.evaluation import alternate, draw_order


def spelling_pairs(raw_map: DataFrame, n: int, seed: int) -> DataFrame:
    """``(a, b, stratum, cosine)``: for each canonical name one drawn pair of its
    spellings that differ by more than case and hold one value each; ``n`` at most."""
    single = raw_map.where(~F.col("raw").rlike(r"[,;:()|/\n]")).select("canonical", "raw", F.lower("raw").alias("_l"))
    forms = single.groupBy("canonical", "_l").agg(F.min("raw").alias("raw")).withColumn("_h", draw_order("raw", seed))
    two = forms.withColumn("_r", F.row_number().over(Window.partitionBy("canonical").orderBy("_h", "raw"))).where(F.col("_r") <= 2)
    pairs = two.groupBy("canonical").agg(F.min("raw").alias("a"), F.max("raw").alias("b"), F.count("*").alias("k")).where(F.col("k") == 2)
    return pairs.orderBy(draw_order("canonical", seed), "canonical").limit(n).select("a", "b", F.lit("rule").alias("stratum"), F.lit(None).cast("double").alias("cosine"))


def candidate_floor(pairs: DataFrame, counts: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of which the commoner name occurs ``most`` times or more."""
    a = counts.select(F.col("skill").alias("a"), F.col("count").alias("na"))
    b = counts.select(F.col("skill").alias("b"), F.col("count").alias("nb"))
    return pairs.join(a, "a").join(b, "b").where(F.greatest("na", "nb") >= most).drop("na", "nb")


def label_sheet(*parts_and_seed) -> DataFrame:
    """``(pair_id, a, b, stratum, cosine, split, label)``: each unordered pair
    once, numbered within its stratum, dev and test in turn, labels empty."""
    *parts, seed = parts_and_seed
    every = reduce(DataFrame.unionByName, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "stratum", "cosine")
    once = every.groupBy("a", "b").agg(F.min_by(F.struct("stratum", "cosine"), "stratum").alias("_s")).select("a", "b", "_s.*").withColumn("_key", F.concat_ws("|", "a", "b"))
    return alternate(once, "stratum", "_key", seed).select("pair_id", "a", "b", "stratum", "cosine", "split", F.lit("").alias("label"))
