"""Facts that answer linked questions, answers made from them, and their scores.

A question is a row of linked entities (:func:`linking.link_entities`). All
questions are answered at once: their scopes are joined to the postings on the
group they name, and every kind of fact is one query over that join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.maths import present
from loomwork.operators import graph, linking

TOP, MISSING, BEST, RELATED, RATES = 8, 5, 5, 5, 3
SHAPE = ("kind", "text", "values", "sources")


def group_of(linked: DataFrame) -> DataFrame:
    """Adds ``group_kind`` and ``group``: the first title, else the first category, else null."""
    title, category = F.get("titles", F.lit(0)), F.get("categories", F.lit(0))
    return linked.withColumns({"group_kind": F.when(title.isNotNull(), "title").when(category.isNotNull(), "category"), "group": F.coalesce(title, category)})


def scope_text() -> Column:
    """The scope of a question in words."""
    place = F.initcap(F.get("provinces", F.lit(0)))
    return F.concat_ws(", ", T.pretty("group"), place, T.pretty("experience"))


def filed(postings: DataFrame) -> DataFrame:
    """Postings once under their title and once under their category: (group_kind, group, ...)."""
    kinds = F.array(F.struct(F.lit("title").alias("group_kind"), F.col("job_title_node").alias("group")), F.struct(F.lit("category").alias("group_kind"), F.col("category").alias("group")))
    return postings.select("posting_id", "job_title_node", "provinces", "experience_level", present("salary_mid").alias("salary_mid"), F.explode(kinds).alias("_g")).select("*", "_g.*").drop("_g").where(F.col("group").isNotNull())


def in_scope(questions: DataFrame, key: str, postings: DataFrame) -> DataFrame:
    """``(key, posting_id, job_title_node, salary_mid)``: postings of each question's group, first province and level."""
    asked = questions.where(F.col("group").isNotNull()).select(key, "group_kind", "group", F.get("provinces", F.lit(0)).alias("_place"), F.col("experience").alias("_level"))
    rows = filed(postings).join(asked, ["group_kind", "group"])
    fits = (F.col("_place").isNull() | F.array_contains("provinces", F.col("_place"))) & (F.col("_level").isNull() | (F.col("_level") == F.col("experience_level")))
    return rows.where(fits).select(key, "posting_id", "job_title_node", "salary_mid")


def _five(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., sources)``: the five smallest ids of each group."""
    order = Window.partitionBy(*by).orderBy("posting_id")
    few = rows.select(*by, "posting_id").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 5)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list("posting_id")).alias("sources"))


def _fact(key: str, kind: Column | str, text: Column, values: Column, sources: Column) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [F.col(key), kind.alias("kind"), text.alias("text"), values.cast("array<double>").alias("values"), sources.cast("array<bigint>").alias("sources")]


def _listed(rows: DataFrame, by: str, name: str, number: str, percent: bool) -> DataFrame:
    """``(by, names, numbers)`` of ranked rows, in their order."""
    one = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("n"), F.col(number).cast("double").alias("v")))).alias("_l"))
    said = F.array_join(F.transform("_l", lambda r: F.concat(r["n"], F.lit(" "), T.number_text(r["v"], percent=percent))), "; ")
    return one.select(by, said.alias("names"), F.transform("_l", lambda r: F.round(r["v"] * 100, 1) if percent else r["v"]).alias("numbers"))


def question_facts(linked: DataFrame, key: str, postings: DataFrame, mentions: DataFrame, pairs: DataFrame, plan: bool = False, least: int = linking.FEW) -> DataFrame:
    """``(key, kind, text, values, sources)``. Kinds: out_of_scope alone, or of a
    group salary or insufficient, count, top_skills, and with skills named
    skill_rate and missing_skills; of a category best_paid_titles; of skills
    without a group related_skills. With ``plan`` also what is related to the
    first three missing skills. ``mentions`` has (posting_id, skill), ``pairs``
    (item_a, item_b, n_ab, npmi)."""
    every = group_of(linked)
    none = F.array()
    outside = every.where(linking.out_of_scope(every)).select(*_fact(key, "out_of_scope", F.lit("Ngoài phạm vi: dữ liệu chỉ có tin tuyển dụng trong nước năm 2025."), none, none))
    inside = every.where(~linking.out_of_scope(every)).withColumn("_scope", scope_text())
    words = inside.select(key, "_scope")
    scope = in_scope(inside, key, postings)
    q = graph.quantiles_of(scope, [key], "salary_mid", (0.25, 0.5, 0.75)).select(key, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    paid = inside.where(F.col("group").isNotNull()).select(key, "_scope").join(q, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    order = Window.partitionBy(key).orderBy(F.abs(F.col("salary_mid") - F.col("median")), "posting_id")
    near = scope.where(F.col("salary_mid").isNotNull()).join(q.select(key, "median"), key).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 5)
    near = near.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "posting_id"))), lambda r: r["posting_id"]).alias("sources"))
    enough = F.col("n") >= least
    said = F.concat("_scope", F.lit(": lương trung vị "), T.number_text("median"), F.lit(" triệu, từ "), T.number_text("q1"), F.lit(" đến "), T.number_text("q3"), F.lit(", theo "), F.col("n").cast("string"), F.lit(" tin."))
    few = F.concat("_scope", F.lit(": chỉ có "), F.col("n").cast("string"), F.lit(" tin có lương, chưa đủ để kết luận."))
    parts = [outside, paid.join(near, key, "left").select(*_fact(key, F.when(enough, "salary").otherwise("insufficient"), F.when(enough, said).otherwise(few), F.when(enough, F.array("median", "q1", "q3", F.col("n").cast("double"))).otherwise(F.array(F.col("n").cast("double"))), F.coalesce("sources", none.cast("array<bigint>"))))]
    counted = scope.groupBy(key).agg(F.count_distinct("posting_id").alias("n")).join(_five(scope, [key]), key).join(words, key)
    parts.append(counted.select(*_fact(key, "count", F.concat("_scope", F.lit(": "), F.col("n").cast("string"), F.lit(" tin tuyển dụng.")), F.array("n"), F.col("sources"))))

    has = mentions.select("posting_id", "skill").distinct()
    sizes = scope.groupBy(key).agg(F.count_distinct("posting_id").alias("_all"))
    rates = scope.select(key, "posting_id").join(has, "posting_id").groupBy(key, "skill").agg(F.count("*").alias("n_with")).join(sizes, key).withColumn("rate", F.col("n_with") / F.col("_all"))
    best = Window.partitionBy(key).orderBy(F.desc("rate"), "skill")
    owned = inside.select(key, F.explode("skills").alias("skill"))

    def ranked(rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def holders(top: DataFrame) -> DataFrame:
        return _five(scope.select(key, "posting_id").join(has, "posting_id").join(top.select(key, "skill"), [key, "skill"], "left_semi"), [key])

    def skill_list(kind: str, top: DataFrame, lead: str) -> DataFrame:
        rows = _listed(top, key, "skill", "rate", True).join(holders(top), key).join(words, key)
        return rows.select(*_fact(key, kind, F.concat("_scope", F.lit(lead), F.col("names"), F.lit(".")), F.col("numbers"), F.col("sources")))

    parts.append(skill_list("top_skills", ranked(rates, TOP), ": kỹ năng hay gặp "))
    missing = ranked(rates.join(owned.select(key).distinct(), key, "left_semi").join(owned, [key, "skill"], "left_anti"), MISSING)
    parts.append(skill_list("missing_skills", missing, ": còn thiếu "))
    first = inside.select(key, F.posexplode(F.slice("skills", 1, RATES)).alias("_p", "skill")).drop("_p").join(sizes, key).join(rates.select(key, "skill", "n_with"), [key, "skill"], "left").withColumn("rate", F.coalesce("n_with", F.lit(0)) / F.col("_all"))
    each = first.join(_five(scope.select(key, "posting_id").join(has, "posting_id").join(first.select(key, "skill"), [key, "skill"], "left_semi"), [key, "skill"]), [key, "skill"], "left").join(words, key)
    parts.append(each.select(*_fact(key, "skill_rate", F.concat("_scope", F.lit(": "), T.number_text("rate", percent=True), F.lit(" tin cần "), F.col("skill"), F.lit(".")), F.array(F.round(F.col("rate") * 100, 1)), F.coalesce("sources", none.cast("array<bigint>")))))

    titles = scope.join(inside.where(F.col("group_kind") == "category").select(key), key, "left_semi").where(F.col("job_title_node").isNotNull())
    pay = graph.quantiles_of(titles, [key, "job_title_node"], "salary_mid", (0.5,)).where(F.col("n") >= least).select(key, "job_title_node", F.col("q")[0].alias("median"))
    paying = pay.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("median"), "job_title_node"))).where(F.col("rank") <= BEST)
    proof = _five(titles.where(F.col("salary_mid").isNotNull()).join(paying.select(key, "job_title_node"), [key, "job_title_node"], "left_semi"), [key])
    parts.append(_listed(paying, key, "job_title_node", "median", False).join(proof, key).join(words, key).select(*_fact(key, "best_paid_titles", F.concat("_scope", F.lit(": chức danh lương cao "), F.col("names"), F.lit(" (triệu).")), F.col("numbers"), F.col("sources"))))

    wanted = inside.where(F.col("group").isNull()).select(key, F.explode("skills").alias("skill"))
    if plan:
        wanted = wanted.unionByName(missing.where(F.col("rank") <= 3).select(key, "skill"))
    near_skills = graph.related_skills(pairs, RELATED).join(wanted.select("skill").distinct(), "skill", "left_semi")
    lists = near_skills.groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("related").alias("n"), F.col("n_ab").cast("double").alias("v")))).alias("_l"))
    both = has.join(near_skills.select("skill"), "skill", "left_semi")
    shown = F.array_join(F.transform("_l", lambda r: F.concat(r["n"], F.lit(" "), T.number_text(r["v"]))), "; ")
    related = wanted.join(lists, "skill").join(_five(both, ["skill"]), "skill")
    parts.append(related.select(*_fact(key, "related_skills", F.concat(F.col("skill"), F.lit(" hay đi cùng "), shown, F.lit(".")), F.transform("_l", lambda r: r["v"]), F.col("sources"))))
    return reduce(DataFrame.unionByName, parts)


def context(facts: DataFrame, key: str) -> DataFrame:
    """``(key, facts, block, allowed)``: each question's usable facts, their text as
    lines with sources, and the ids that may be cited. Without a usable fact there is no row."""
    usable = facts.where(~F.col("kind").isin("out_of_scope", "insufficient"))
    one = usable.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*SHAPE))).alias("facts"))
    lines = F.transform("facts", lambda f: F.concat(F.lit("- "), f["text"], F.lit(" [nguồn: "), F.array_join(F.transform(f["sources"], lambda s: F.concat(F.lit("#"), s.cast("string"))), ", "), F.lit("]")))
    return one.select(key, "facts", F.array_join(lines, "\n").alias("block"), F.array_distinct(F.flatten(F.col("facts.sources"))).alias("allowed"))


def fallback_answers(facts: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """``(key, text, refuse, citations)``: what is said when no worded answer holds:
    the facts themselves with their sources, or a refusal where there is none."""
    made = questions.select(key).join(context(facts, key), key, "left")
    said = F.array_join(F.col("facts.text"), " ")
    return made.select(key, F.coalesce(said, F.lit("Dữ liệu không đủ để trả lời.")).alias("text"), F.col("facts").isNull().alias("refuse"), F.coalesce("allowed", F.array().cast("array<bigint>")).alias("citations"))


def answer_from_facts(facts: DataFrame, questions: DataFrame, key: str, answered: DataFrame) -> DataFrame:
    """Worded answers ``(key, text, citations)`` checked against the facts: one that
    says an unknown figure or cites a foreign source is replaced by the facts
    themselves; a question without a usable fact is refused whatever was answered."""
    plain = fallback_answers(facts, questions.select(key), key)
    asked = answered.join(questions.select(key, F.col("text").alias("_asked")), key).join(context(facts, key).select(key, "facts"), key)
    good = linking.verify(asked, "text", "citations", "_asked", "facts").where("ok").select(key, F.col("text").alias("_text"), F.col("citations").alias("_cited"))
    both = plain.join(good, key, "left")
    return both.select(key, F.coalesce("_text", "text").alias("text"), "refuse", F.coalesce("_cited", "citations").alias("citations"), F.col("_text").isNotNull().alias("worded"))


# The width within which a figure counts as the one expected, by type of question.
WIDTHS = {"salary": (0.1, 0.01), "count": (0.0, 0.0), "rate": (0.2, 0.0)}


def score_answers(answers: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """``(key, type, group, correct, false_refusal, citation_precision, grounded)``.
    A question outside the data is answered right by refusing it; of others a
    refusal is false, pay counts within 0.1 or 1 %, a rate within 0.2 points, a
    count exactly, and of names their share in the text must be all."""
    both = questions.select(key, "type", "group", "number", "name", "ids").join(answers.select(key, "text", "refuse", "citations", *[c for c in ("ok",) if c in answers.columns]), key, "left")
    outside = F.col("group") == "out_of_scope"
    refused = F.coalesce("refuse", F.lit(True))
    kind = F.when(F.col("type").contains("rate"), "rate").when(F.col("type").startswith("count") | (F.col("type") == "cooccur"), "count").otherwise("salary")
    width = F.lit(0.0)
    for name, (least, share) in WIDTHS.items():
        width = F.when(kind == name, F.greatest(F.lit(least), share * F.abs("number"))).otherwise(width)
    figure = F.col("number").isNull() | F.exists(T.numbers("text"), lambda x: F.abs(x - F.col("number")) <= width + 1e-9)
    names = F.filter(F.split(F.coalesce("name", F.lit("")), "; "), lambda n: n != "")
    low = T.tone_new_style(F.lower("text"))
    named = F.forall(names, lambda n: F.contains(low, T.tone_new_style(F.lower(n))))
    right = F.when(outside, refused).otherwise(~refused & figure & named)
    cited, valid = F.coalesce("citations", F.array().cast("array<bigint>")), F.coalesce("ids", F.array().cast("array<bigint>"))
    precision = F.when((F.size(cited) > 0) & (F.size(valid) > 0), F.size(F.array_intersect(cited, valid)) / F.size(F.array_distinct(cited)))
    grounded = F.when(~refused, F.col("ok")) if "ok" in answers.columns else F.lit(None).cast("boolean")
    return both.select(key, "type", "group", F.coalesce(right, F.lit(False)).alias("correct"), (refused & ~outside).alias("false_refusal"), precision.alias("citation_precision"), grounded.alias("grounded"))
