"""The property graph as two tables, nodes (id, type, name, ...) and edges
(src, dst, rel, ...), and its queries. No query goes deeper than two hops, so
all of them are joins, filters and ranked windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.maths import present
from loomwork.operators import association

# Node type, prefix of its ids, column of the postings, edge to it.
STRUCTURE = (
    ("JobTitle", "title", "job_title_node", "HAS_TITLE"),
    ("Category", "category", "category", "IN_CATEGORY"),
    ("SalaryBand", "salary", "salary_band", "PAYS"),
    ("ExperienceLevel", "exp", "experience_level", "REQUIRES_EXPERIENCE"),
    ("Qualification", "edu", "education_level", "REQUIRES_EDUCATION"),
)
NO_PLACE = ("unknown", "foreign")


def node_id(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), name.cast("string"))


def _named(postings: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & (c != "unspecified") if column == "education_level" else c.isNotNull()


def skill_kinds(mentions: DataFrame, least: int) -> DataFrame:
    """``(skill, n_postings, kind)`` of skills in ``least`` postings or more."""
    rows = mentions.where(F.col("skill").isNotNull() & F.col("posting_id").isNotNull())
    return rows.groupBy("skill").agg(
        F.count_distinct("posting_id").alias("n_postings"), F.when(F.count_if(F.col("source") == "soft") >= F.count_if(F.col("source") != "soft"), "soft").otherwise("technical").alias("kind")
    ).where(F.col("n_postings") >= least)


def nodes(postings: DataFrame, mentions: DataFrame, aliases: DataFrame | None = None, least_skill: int = 5) -> DataFrame:
    """``(id, type, name)``; ``aliases`` has (skill, canonical) and gives a node where the canonical one is a node."""
    parts = [postings.select(node_id("posting", F.col("posting_id")).alias("id"), F.lit("JobPosting").alias("type"), F.col("posting_id").cast("string").alias("name"))]
    for kind, prefix, column, _ in STRUCTURE:
        parts.append(postings.where(_named(postings, column)).select(node_id(prefix, F.col(column)).alias("id"), F.lit(kind).alias("type"), F.col(column).alias("name")).distinct())
    places = postings.select(F.explode("provinces").alias("name")).where(F.col("name").isNotNull() & ~F.col("name").isin(*NO_PLACE)).distinct()
    parts.append(places.select(node_id("province", F.col("name")).alias("id"), F.lit("Province").alias("type"), "name"))
    skills = skill_kinds(mentions, least_skill).select("skill")
    names = skills
    if aliases is not None:
        names = skills.unionByName(aliases.join(skills.withColumnRenamed("skill", "canonical"), "canonical", "left_semi").select("skill")).distinct()
    parts.append(names.select(node_id("skill", F.col("skill")).alias("id"), F.lit("Skill").alias("type"), F.col("skill").alias("name")))
    return reduce(DataFrame.unionByName, parts)


def posting_edges(postings: DataFrame) -> DataFrame:
    """``(src, dst, rel)`` from postings to what they are filed under."""
    src = node_id("posting", F.col("posting_id")).alias("src")
    filed = [F.when(_named(postings, column), F.struct(node_id(prefix, F.col(column)).alias("dst"), F.lit(rel).alias("rel"))) for _, prefix, column, rel in STRUCTURE]
    places = F.coalesce(F.transform(F.filter(F.array_distinct("provinces"), lambda p: p.isNotNull() & ~p.isin(*NO_PLACE)), lambda p: F.struct(node_id("province", p).alias("dst"), F.lit("LOCATED_IN").alias("rel"))), F.array())
    return postings.select(src, F.explode(F.concat(F.array_compact(F.array(*filed)), places)).alias("e")).select("src", "e.dst", "e.rel")


def edges(postings: DataFrame, mentions: DataFrame, aliases: DataFrame | None = None, least_skill: int = 5, least_pair: int = 5, least_rate: int = 3, least_tested: int = 30, alpha: float = 0.05) -> DataFrame:
    """``(src, dst, rel, n, rate, chi2, npmi)``, all relations of the graph."""
    words = skill_kinds(mentions, least_skill)
    known = mentions.where(F.col("posting_id").isNotNull()).join(words.select("skill"), "skill", "left_semi").select("posting_id", "skill").distinct()
    parts = [posting_edges(postings), known.select(node_id("posting", F.col("posting_id")).alias("src"), node_id("skill", F.col("skill")).alias("dst"), F.lit("REQUIRES").alias("rel"))]
    if aliases is not None:
        sure = aliases.join(words.select(F.col("skill").alias("canonical")), "canonical", "left_semi")
        parts.append(sure.select(node_id("skill", F.col("skill")).alias("src"), node_id("skill", F.col("canonical")).alias("dst"), F.lit("ALIAS_OF").alias("rel")))
    pairs = association.pmi_pairs(known, "posting_id", "skill", least=least_pair)
    parts.append(pairs.select(node_id("skill", F.col("item_a")).alias("src"), node_id("skill", F.col("item_b")).alias("dst"), F.lit("CO_OCCURS_WITH").alias("rel"), F.col("n_ab").alias("n"), "npmi"))
    for prefix, column in (("category", "category"), ("exp", "experience_level"), ("salary", "salary_band")):
        grid = association.chi2_grid(known, "posting_id", "skill", postings, column, least_tested, alpha).where("positive and significant")
        parts.append(grid.select(node_id(prefix, F.col(column)).alias("src"), node_id("skill", F.col("skill")).alias("dst"), F.lit("ASSOCIATED_WITH").alias("rel"), F.col("n_ab").alias("n"), "chi2"))
    for prefix, column in (("category", "category"), ("title", "job_title_node")):
        rates = association.group_rates(known, "posting_id", "skill", postings, column, least_rate)
        parts.append(rates.select(node_id(prefix, F.col(column)).alias("src"), node_id("skill", F.col("skill")).alias("dst"), F.lit("TYPICALLY_REQUIRES").alias("rel"), F.col("n_with").alias("n"), "rate"))
    columns = {"n": "long", "rate": "double", "chi2": "double", "npmi": "double"}
    full = [p.select("src", "dst", "rel", *[F.col(c).cast(t).alias(c) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]) for p in parts]
    return reduce(DataFrame.unionByName, full)


def type_counts(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def postings_of(edges_: DataFrame, node: str) -> DataFrame:
    return edges_.where((F.col("dst") == node) & F.col("src").startswith("posting:")).select(F.substring_index("src", ":", -1).cast("long").alias("posting_id"))


def matching(edges_: DataFrame, *wanted: str) -> DataFrame:
    """Postings linked to all wanted nodes."""
    hits = edges_.where(F.col("dst").isin(*wanted) & F.col("src").startswith("posting:"))
    return hits.groupBy(F.substring_index("src", ":", -1).cast("long").alias("posting_id")).agg(F.count_distinct("dst").alias("_n")).where(F.col("_n") == len(set(wanted))).select("posting_id")


def quantiles_of(rows: DataFrame, by: list[str], value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """``(by..., n, q)``: exact quantiles with linear interpolation. Equal values
    are counted before the shuffle, and the ranks wanted are picked from running
    counts, a sort that can spill; no group is held in memory."""
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(*by)
    at = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    step = counted.withColumns({"n": F.sum("_c").over(over), "_last": F.sum("_c").over(over.orderBy("_x"))})
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    held = step.withColumn("_ranks", ranks).withColumn("_ranks", F.expr("filter(_ranks, r -> r >= _last - _c and r < _last)")).where(F.size("_ranks") > 0)
    found = held.select(*by, "n", "_x", F.explode("_ranks").alias("_r")).groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_m"))

    def between(a: Column) -> Column:
        low, high = F.element_at("_m", F.floor(a).cast("long")), F.element_at("_m", F.ceil(a).cast("long"))
        return low + (high - low) * (a - F.floor(a))

    return found.select(*by, "n", F.array(*[between(a) for a in at]).alias("q"))


def pay_summary(postings: DataFrame, by: list[str], pay: str = "salary_mid") -> DataFrame:
    """``(by..., n, q1, median, q3)`` with linear interpolation; missing pay doesn't count."""
    q = quantiles_of(postings, by, pay, (0.25, 0.5, 0.75))
    return q.select(*by, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def nearest_to_median(postings: DataFrame, by: list[str], pay: str = "salary_mid", k: int = 5) -> DataFrame:
    """Evidence: the ``k`` postings nearest to their group's median, ties to the smaller id."""
    rows = postings.withColumn("_x", present(pay)).where(F.col("_x").isNotNull())
    middle = pay_summary(postings, by, pay).select(*by, "median")
    order = Window.partitionBy(*by).orderBy(F.abs(F.col("_x") - F.col("median")), "posting_id")
    return rows.join(middle, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "posting_id", "rank")


def top_skills(rates: DataFrame, group: str, k: int, grid: DataFrame | None = None) -> DataFrame:
    """The ``k`` most frequent skills of every group, ties by name; with ``grid``
    (:func:`association.chi2_grid`) the chi-squared of positive significant cells."""
    order = Window.partitionBy(group).orderBy(F.desc("rate"), "skill")
    top = rates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if grid is None:
        return top
    return top.join(grid.where("positive and significant").select(group, "skill", "chi2"), [group, "skill"], "left")


def skills_table(rates: DataFrame, group: str, k: int, grid: DataFrame | None, broader: DataFrame, broad_grid: DataFrame, broad: str) -> DataFrame:
    """:func:`top_skills` with ``chi2``: that of the group itself where ``grid`` has
    one, else that of its commonest ``broad`` group. ``broader`` has (group, broad)."""
    top = top_skills(rates, group, k, grid)
    wide = broad_grid.where("positive and significant").select(broad, "skill", F.col("chi2").alias("_wide"))
    both = top.join(broader.select(group, broad), group, "left").join(wide, [broad, "skill"], "left")
    own = F.col("chi2") if grid is not None else F.lit(None).cast("double")
    return both.withColumn("chi2", F.coalesce(own, "_wide")).drop("_wide")


def raw_to_skill(mentions: DataFrame, order: str) -> DataFrame:
    """``(raw, canonical)``: the name that the last row with a typed value gave it."""
    named = mentions.where(F.col("raw").isNotNull() & F.col("skill").isNotNull())
    return named.groupBy("raw").agg(F.max_by("skill", order).alias("canonical"))


def missing_skills(rates: DataFrame, group: str, owned: DataFrame, k: int) -> DataFrame:
    """The most frequent skills of every group that ``owned`` (skill) lacks."""
    return top_skills(rates.join(owned.select("skill").distinct(), "skill", "left_anti"), group, k)


def related_skills(pairs: DataFrame, k: int) -> DataFrame:
    """Each skill's ``k`` nearest by co-occurrence: count, then npmi, then name."""
    columns = ["n_ab", "npmi"]
    both = pairs.select(F.col("item_a").alias("skill"), F.col("item_b").alias("related"), *columns).unionByName(pairs.select(F.col("item_b").alias("skill"), F.col("item_a").alias("related"), *columns))
    order = Window.partitionBy("skill").orderBy(F.desc("n_ab"), F.desc("npmi"), "related")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def induced(edges_: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among ``kept`` (id)."""
    ids = kept.select("id").distinct()
    return edges_.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def resolve_names(names: DataFrame, raw_map: DataFrame, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(name, skill)``: the node a typed name means - by the raw map (raw,
    canonical), else itself - followed over one alias; null if that is no node."""
    first = names.join(raw_map.select(F.col("raw").alias("name"), "canonical"), "name", "left").withColumn("_s", F.coalesce("canonical", "name"))
    second = first.join(aliases.select(F.col("skill").alias("_s"), F.col("canonical").alias("_to")), "_s", "left").withColumn("_t", F.coalesce("_to", "_s"))
    return second.join(skills.select(F.col("skill").alias("_t"), F.lit(True).alias("_is")), "_t", "left").select("name", F.when(F.col("_is"), F.col("_t")).alias("skill"))


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, n)``: the commonest value of every group, ties to the smaller one."""
    counts = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")
