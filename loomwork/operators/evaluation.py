"""Metrics of rankings, labels and answers, and samples to label."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.resolve import with_scores

RELEVANT = 2


def precision_recall(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """``(by..., n, tp, fp, fn, precision, recall, f1)``."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    return with_scores(df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")))


def ranking_metrics(rankings: DataFrame, grades: DataFrame, query: str, item: str, k: int = 10) -> DataFrame:
    """``(query, system, recall, mrr, ndcg)`` at ``k``. ``rankings`` has (query,
    system, item, rank), ``grades`` (query, item, grade), one row a pair. Recall
    is null without a relevant item (grade >= 2), nDCG where the ideal is 0;
    ungraded items gain nothing."""
    order = Window.partitionBy(query).orderBy(F.desc("grade"), item)
    best = grades.withColumn("_i", F.row_number().over(order))
    ideal = best.groupBy(query).agg(F.sum(F.when(F.col("_i") <= k, F.col("grade") / F.log2(F.col("_i") + 1))).alias("_ideal"), F.count_if(F.col("grade") >= RELEVANT).alias("_relevant"))
    top = rankings.where(F.col("rank") <= k).join(grades, [query, item], "left")
    hit = F.coalesce(F.col("grade") >= RELEVANT, F.lit(False))
    got = top.groupBy(query, "system").agg(F.count_if(hit).alias("_hits"), F.min(F.when(hit, F.col("rank"))).alias("_first"), F.sum(F.coalesce("grade", F.lit(0)) / F.log2(F.col("rank") + 1)).alias("_dcg"))
    out = got.join(ideal, query, "left")
    return out.select(query, "system", (F.col("_hits") / F.nullif(F.col("_relevant"), F.lit(0))).alias("recall"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), (F.col("_dcg") / F.nullif(F.col("_ideal"), F.lit(0.0))).alias("ndcg"))


def system_scores(metrics: DataFrame) -> DataFrame:
    """Means over queries of each system; a missing value doesn't count."""
    return metrics.groupBy("system").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("recall", "mrr", "ndcg")])


def pooled(rankings: DataFrame, query: str, item: str, k: int = 10) -> DataFrame:
    """Every item that some system has in its first ``k``."""
    return rankings.where(F.col("rank") <= k).select(query, item).distinct()


def labelled_precision(rankings: DataFrame, grades: DataFrame, query: str, item: str, k: int = 10) -> DataFrame:
    """``(system, n, mean_grade, share_2, share_1)`` over the graded pairs in the first ``k``."""
    top = rankings.where(F.col("rank") <= k).join(grades, [query, item])
    return top.groupBy("system").agg(F.count("*").alias("n"), F.avg("grade").alias("mean_grade"), F.avg((F.col("grade") >= 2).cast("int")).alias("share_2"), F.avg((F.col("grade") >= 1).cast("int")).alias("share_1"))


def paired(metrics: DataFrame, query: str, a: str, b: str, value: str = "ndcg") -> DataFrame:
    """``(query, a, b)``: both systems' values where both have one."""
    one = metrics.where(F.col("system") == a).select(query, F.col(value).alias("a"))
    other = metrics.where(F.col("system") == b).select(query, F.col(value).alias("b"))
    return one.join(other, query).dropna(subset=["a", "b"])


def kappa(df: DataFrame, a: str, b: str, linear: bool = False) -> DataFrame:
    """``(n, agreement, kappa)`` of two raters; with ``linear`` weights labels are
    numbers. Null where chance agreement is certain. What chance gives comes from
    each rater's counts of a label, or of the labels up to one, never from pairs
    of labels."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = (F.col(a).cast("double"), F.col(b).cast("double")) if linear else (F.col(a), F.col(b))
    cells = rows.groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("c"))
    off = F.abs(F.col("x") - F.col("y")) if linear else (F.col("x") != F.col("y")).cast("double")
    seen = cells.agg(F.sum("c").alias("n"), F.sum(F.col("c") * off).alias("o"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    sides = F.explode(F.array(F.struct(F.col("x").alias("l"), F.col("c").alias("r"), F.lit(0).alias("s")), F.struct(F.col("y").alias("l"), F.lit(0).alias("r"), F.col("c").alias("s"))))
    labels = cells.select(sides.alias("v")).groupBy("v.l").agg(F.sum("v.r").cast("double").alias("r"), F.sum("v.s").cast("double").alias("s"))
    if linear:  # the distance of two labels is the sum of the gaps between them
        order = Window.orderBy("l")  # one row a label
        upto = labels.select((F.lead("l").over(order) - F.col("l")).alias("gap"), F.sum("r").over(order).alias("r"), F.sum("s").over(order).alias("s"), F.sum("r").over(Window.partitionBy()).alias("n"))
        chance = upto.agg(F.sum(F.col("gap") * (F.col("r") * (F.col("n") - F.col("s")) + F.col("s") * (F.col("n") - F.col("r")))).alias("e"))
    else:
        chance = labels.agg((F.sum("r") * F.sum("s") - F.sum(F.col("r") * F.col("s"))).alias("e"))
    return seen.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), (1 - F.col("o") * F.col("n") / F.nullif(F.col("e"), F.lit(0.0))).alias("kappa"))  # one row each


def field_agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``(field, n, agreement, kappa)`` of two raters for each named pair of columns,
    unweighted; a field of which chance agreement is certain has no kappa."""
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for name, (a, b) in pairs.items()]))
    cells = df.select(long.alias("f")).select("f.*").dropna(subset=["x", "y"]).groupBy("field", "x", "y").agg(F.count("*").alias("c"))
    sides = F.explode(F.array(F.struct(F.col("x").alias("l"), F.col("c").alias("r"), F.lit(0).alias("s")), F.struct(F.col("y").alias("l"), F.lit(0).alias("r"), F.col("c").alias("s"))))
    labels = cells.select("field", sides.alias("v")).groupBy("field", "v.l").agg(F.sum("v.r").cast("double").alias("r"), F.sum("v.s").cast("double").alias("s"))
    chance = labels.groupBy("field").agg((F.sum("r") * F.sum("s")).alias("_all"), F.sum(F.col("r") * F.col("s")).alias("_same"))
    seen = cells.groupBy("field").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("_o"))
    off = (F.col("n") - F.col("_o")) * F.col("n") / F.nullif(F.col("_all") - F.col("_same"), F.lit(0.0))
    return seen.join(chance, "field").select("field", "n", (F.col("_o") / F.col("n")).alias("agreement"), (1 - off).alias("kappa"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """``(n, accuracy, macro_f1)`` over a fixed list of labels; a label never seen or said has F1 0."""
    f1 = []
    for label in labels:
        t, p = F.col(truth) == label, F.col(predicted) == label
        f1.append(F.coalesce(2 * F.count_if(t & p) / F.nullif(F.count_if(t) + F.count_if(p), F.lit(0)), F.lit(0.0)))
    return df.agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"), (sum(f1[1:], f1[0]) / len(labels)).alias("macro_f1"))


POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def bootstrap(pairs: DataFrame, query: str, n_boot: int = 10_000, seed: int = 42) -> DataFrame:
    """``(n, diff, low, high, p)`` of the mean difference a - b over paired values,
    resampled ``n_boot`` times; p is two-sided. Fewer than two pairs or a missing
    value is an error. A value is drawn into each resample as often as a Poisson
    variable of mean 1 says, told by a hash of query and resample, so resamples
    are sums that tasks add up on their own; nothing is broadcast or numbered."""
    check = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull() | F.isnan("a") | F.isnan("b")).alias("bad")).collect()[0]
    if check["n"] < 2 or check["bad"]:
        raise ValueError("bootstrap needs two or more pairs without missing values")
    values = pairs.select((F.col("a") - F.col("b")).alias("d"), F.xxhash64(query, F.lit(seed)).alias("_h"))
    u = F.pmod(F.xxhash64("_h", "boot"), F.lit(1 << 40)) / float(1 << 40)
    times = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        times = F.when(F.col("_u") < POISSON[k], k).otherwise(times)
    drawn = values.select("d", "_h", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot")).select("d", "boot", u.alias("_u")).select("d", "boot", times.alias("_w"))
    means = drawn.groupBy("boot").agg(F.sum(F.col("d") * F.col("_w")).alias("_s"), F.sum("_w").alias("_n")).where(F.col("_n") > 0).select((F.col("_s") / F.col("_n")).alias("m"))
    low = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    below, above = F.avg((F.col("m") <= 0).cast("int")), F.avg((F.col("m") >= 0).cast("int"))
    return means.agg(low.alias("_q"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p")).crossJoin(values.agg(F.count("*").alias("n"), F.avg("d").alias("diff"))).select("n", "diff", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "p")


def error_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, n, wrong, rate)`` of verdict columns holding correct, wrong or unclear."""
    long = df.unpivot([], fields, "field", "verdict").where(F.col("verdict").isin("correct", "wrong"))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "wrong").alias("wrong")).withColumn("rate", F.col("wrong") / F.col("n"))


def answer_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: n, accuracy, mean citation precision and groundedness of those that have one, false refusals."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("citation_precision").alias("citation_precision"), F.avg(F.col("grounded").cast("int")).alias("grounded"), F.avg(F.col("false_refusal").cast("int")).alias("false_refusal"))


def answered(said: Column, expected: Column, kind: str) -> Column:
    """Whether a text states the expected value: pay within 0.1 or 1 %, a count
    exactly, a rate (in percent) within 0.2 points, a name by containment."""
    if kind == "name":
        return F.contains(T.tone_new_style(F.lower(said)), T.tone_new_style(F.lower(expected)))
    width = {"salary": F.greatest(F.lit(0.1), 0.01 * F.abs(expected)), "count": F.lit(0.0), "rate": F.lit(0.2)}[kind]
    return F.exists(T.numbers(said), lambda x: F.abs(x - expected) <= width)


def citation_precision(cited: Column, valid: Column) -> Column:
    """The share of cited ids that are valid; null if none is cited."""
    return F.size(F.array_intersect(cited, valid)) / F.nullif(F.size(F.array_distinct(cited)), F.lit(0))


def mentioned_share(names: Column, text: Column) -> Column:
    """The share of names that a text contains; null without names."""
    return F.size(F.filter(names, lambda n: F.contains(F.lower(text), F.lower(n)))) / F.nullif(F.size(names), F.lit(0))


# Samples: order by a hash that SQL engines share, so a sample can be repeated anywhere.


def draw_order(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(T.col(key).cast("string"), F.lit(f"-{seed}")))


def sample_ids(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.select(key).orderBy(draw_order(key, seed), key).limit(n)


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """``(key, split)``: of each stratum the first ``train`` share in drawing order,
    then the ``validation`` share, the rest test; independent of the rows' order.
    The rank within a stratum comes from counts of hash ranges, so that a stratum
    of most rows is not sorted in one task."""
    rows = df.select(key, F.col(stratum).alias("_s"), draw_order(key, seed).alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    counts = rows.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    by = Window.partitionBy("_s")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_c").over(by)).drop("_c")
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key))
    ranked = rows.withColumn("_i", inside).join(counts, rows["_s"].eqNullSafe(counts["_s"]) & (rows["_b"] == counts["_b"])).select(rows[key], (F.col("_before") + F.col("_i")).alias("_r"), "_n")
    first = F.bround(train * F.col("_n"))
    second = first + F.bround(validation * F.col("_n"))
    return ranked.select(key, F.when(F.col("_r") <= first, "train").when(F.col("_r") <= second, "val").otherwise("test").alias("split"))


def sample_by_grade(df: DataFrame, key: list[str], grade: str, n: int, seed: int) -> DataFrame:
    """``n`` pairs, a third of each grade 0..2 as far as there are, the rest filled from the others."""
    rows = df.where(F.col(grade).isin(0, 1, 2)).withColumn("_h", draw_order(F.concat_ws("|", *key), seed))
    order = Window.partitionBy(grade).orderBy("_h", *key)
    quota = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n // 3).drop("_r")
    rest = rows.join(quota.select(*key), key, "left_anti").orderBy("_h", *key).limit(n)
    return quota.withColumn("_p", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1))).orderBy("_p", "_h", *key).limit(n).select(*key, grade)


def sample_bins(pairs: DataFrame, score: str, edges: list[float], each: int, seed: int, key: list[str]) -> DataFrame:
    """At most ``each`` pairs of every half-open score bin [low, high)."""
    bin_ = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        bin_ = F.when((F.col(score) >= low) & (F.col(score) < high), i).otherwise(bin_)
    rows = pairs.withColumn("bin", bin_).where(F.col("bin").isNotNull()).withColumn("_h", draw_order(F.concat_ws("|", *key), seed))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("bin").orderBy("_h", *key))).where(F.col("_r") <= each).drop("_h", "_r")


def alternate(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """Adds ``pair_id`` (stratum and number) and ``split``, dev and test in turn within each stratum."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw_order(key, seed), key)) - 1
    return df.withColumn("_p", place).withColumn("pair_id", F.concat_ws("-", F.col(stratum), F.lpad(F.col("_p").cast("string"), 3, "0"))).withColumn("split", F.when(F.col("_p") % 2 == 0, "dev").otherwise("test")).drop("_p")
