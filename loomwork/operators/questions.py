"""A workload of templated analytical questions with answers computed from the
tables alone, to check other ways of answering against.

Each type is a small query that lists its possible questions with their
answers; a fixed number is drawn by hash order, and dev and test take turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.maths import present
from loomwork.operators import association, graph
from loomwork.operators.evaluation import draw_order

SHAPE = ("type", "group", "text", "number", "name", "ids")


def _shaped(df: DataFrame, kind: str, group: str, text: Column, number: Column | None = None, name: Column | None = None, ids: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"),
        F.lit(group).alias("group"),
        text.alias("text"),
        (number if number is not None else F.lit(None)).cast("double").alias("number"),
        (name if name is not None else F.lit(None)).cast("string").alias("name"),
        (ids if ids is not None else F.array()).cast("array<bigint>").alias("ids"),
    )


def _medians(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Group medians and the ids nearest to them as sources."""
    paid = graph.pay_summary(rows, by).where(F.col("n") >= least).select(*by, "n", "median")
    near = graph.nearest_to_median(rows, by).groupBy(*by).agg(F.array_sort(F.collect_list("posting_id")).alias("ids"))
    return paid.join(near, by)


def candidates(postings: DataFrame, mentions: DataFrame, least: int = 5) -> DataFrame:
    """Every possible question of every type, with its answer."""
    base = postings.withColumn("salary_mid", present("salary_mid"))
    titled = base.where(F.col("job_title_node").isNotNull())
    placed = base.withColumn("province", F.explode(F.array_distinct("provinces"))).where(F.col("province").isNotNull() & ~F.col("province").isin(*graph.NO_PLACE))
    title, place, category = F.col("job_title_node"), F.initcap("province"), T.pretty("category")
    q = F.concat
    parts = [
        _shaped(_medians(titled, ["job_title_node"], least), "salary_title", "one_hop", q(F.lit("Lương trung vị của "), title, F.lit(" là bao nhiêu?")), F.col("median"), ids=F.col("ids")),
        _shaped(_medians(placed.where(F.col("category").isNotNull()), ["category", "province"], least), "salary_category_province", "one_hop", q(F.lit("Ngành "), category, F.lit(" ở "), place, F.lit(" có lương trung vị bao nhiêu?")), F.col("median"), ids=F.col("ids")),
        _shaped(
            _medians(placed.where(title.isNotNull() & F.col("experience_level").isNotNull()), ["job_title_node", "province", "experience_level"], least),
            "salary_3way",
            "multi_hop",
            q(F.lit("Lương trung vị của "), title, F.lit(" ở "), place, F.lit(", mức "), T.pretty("experience_level"), F.lit("?")),
            F.col("median"),
            ids=F.col("ids"),
        ),
    ]
    counts = placed.where(title.isNotNull()).groupBy("job_title_node", "province").agg(F.count("*").alias("n"), _min_ids().alias("ids"))
    ask = q(F.lit("Có bao nhiêu tin tuyển "), title, F.lit(" ở "), place, F.lit("?"))
    parts.append(_shaped(counts.where(F.col("n") >= least), "count_title_province", "one_hop", ask, F.col("n"), ids=F.col("ids")))
    parts.append(_shaped(counts.where(F.col("n") < least), "too_few_postings", "out_of_scope", q(F.lit("Lương trung vị của "), title, F.lit(" ở "), place, F.lit("?"))))
    rates = association.group_rates(mentions, "posting_id", "skill", titled, "job_title_node", 3)
    parts.append(_shaped(rates.where(F.col("n_group") >= least), "skill_rate", "one_hop", q(F.lit("Bao nhiêu phần trăm tin tuyển "), title, F.lit(" cần "), F.col("skill"), F.lit("?")), F.col("rate") * 100))
    partner = association.top_partner(association.pmi_pairs(mentions, "posting_id", "skill", least=least)).where("unique_top")
    parts.append(_shaped(partner, "cooccur", "one_hop", q(F.lit("Kỹ năng nào hay đi cùng "), F.col("item"), F.lit(" nhất?")), F.col("n_ab"), F.col("partner")))
    top = graph.top_skills(rates, "job_title_node", 1)
    gaps = graph.missing_skills(rates, "job_title_node", top.select("skill"), 3).groupBy("job_title_node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "skill"))), lambda r: r["skill"]), "; ").alias("names"), F.count("*").alias("n"))
    gaps = gaps.where(F.col("n") == 3).join(graph.pay_summary(titled, ["job_title_node"]).where(F.col("n") >= least).select("job_title_node", "median"), "job_title_node")
    parts.append(_shaped(gaps, "gap_and_salary", "multi_hop", q(F.lit("Muốn làm "), title, F.lit(" còn thiếu kỹ năng gì, lương bao nhiêu?")), F.col("median"), F.col("names")))
    best = graph.pay_summary(titled.where(F.col("category").isNotNull()), ["category", "job_title_node"]).where(F.col("n") >= least)
    first = best.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("median"), "job_title_node"))).where(F.col("_r") == 1)
    parts.append(_shaped(first, "best_paid_title", "multi_hop", q(F.lit("Chức danh nào của ngành "), category, F.lit(" lương cao nhất?")), F.col("median"), title))
    spark = postings.sparkSession
    named = spark.createDataFrame([("phi hành gia",), ("thuần dưỡng voi",), ("lính cứu hỏa rừng",)], "t string").join(titled.select(title.alias("t")).distinct(), "t", "left_anti")
    parts.append(_shaped(named, "unknown_title", "out_of_scope", q(F.lit("Lương trung vị của "), F.col("t"), F.lit(" là bao nhiêu?"))))
    abroad = spark.createDataFrame([("Nhật Bản",), ("Singapore",)], "t string")
    parts.append(_shaped(abroad, "foreign", "out_of_scope", q(F.lit("Lương kế toán ở "), F.col("t"), F.lit(" là bao nhiêu?"))))
    past = spark.createDataFrame([("2019",), ("2030",)], "t string")
    parts.append(_shaped(past, "out_of_time", "out_of_scope", q(F.lit("Lương kế toán năm "), F.col("t"), F.lit(" là bao nhiêu?"))))
    return reduce(DataFrame.unionByName, parts)


def _min_ids() -> Column:
    """A few smallest ids in bounded space: the smallest of each of 8 hash classes."""
    classes = [F.min(F.when(F.pmod(F.xxhash64("posting_id"), F.lit(8)) == i, F.col("posting_id"))) for i in range(8)]
    return F.array_sort(F.array_compact(F.array(*classes)))


# How many questions of each type.
QUOTA = {"salary_title": 6, "salary_category_province": 5, "skill_rate": 5, "count_title_province": 5, "cooccur": 4, "gap_and_salary": 6, "salary_3way": 5, "best_paid_title": 4, "unknown_title": 3, "foreign": 2, "out_of_time": 2, "too_few_postings": 3}


def question_set(postings: DataFrame, mentions: DataFrame, seed: int = 42, least: int = 5) -> DataFrame:
    """``(id, split, type, group, text, number, name, ids)``: the drawn questions."""
    every = candidates(postings, mentions, least).withColumn("_h", draw_order("text", seed))
    quota = F.create_map(*[F.lit(x) for pair in QUOTA.items() for x in pair])
    drawn = every.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy("_h", "text"))).where(F.col("_r") <= F.try_element_at(quota, F.col("type")))
    number = F.row_number().over(Window.orderBy("type", "_r"))  # a few dozen rows
    return drawn.withColumn("_n", number).select(F.concat(F.lit("q"), F.lpad(F.col("_n").cast("string"), 2, "0")).alias("id"), F.when(F.col("_r") % 2 == 1, "dev").otherwise("test").alias("split"), *SHAPE)
