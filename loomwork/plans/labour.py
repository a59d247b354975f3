"""Queries of the labour-market operators over the whole domain tables, with
the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions.maths import present
from loomwork.operators import association, cleaning, evaluation, facts, graph, labels, learning, linking, questions, resolve, retrieval
from loomwork.operators.units import small_rows
from loomwork.session import cut, table
from loomwork.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}
EVERY = 100  # searches ask with every row whose id this divides


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings")


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posting_skills").where(F.col("skill").isNotNull() & F.col("posting_id").isNotNull()).select("posting_id", "skill", "source", "mention_id")


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """A posting per province it names, each once."""
    rows = postings(spark, sf).select("*", F.explode(F.array_distinct("provinces")).alias("province"))
    return rows.where(F.col("province").isNotNull() & ~F.col("province").isin(*graph.NO_PLACE))


_PAID = "p AS (SELECT *, CASE WHEN isnan(salary_mid) THEN NULL ELSE salary_mid END AS x FROM postings)"
_PLACED = _PAID + ", q AS (SELECT * FROM (SELECT p.*, unnest(list_distinct(provinces)) AS province FROM p) WHERE province NOT IN ('unknown', 'foreign'))"
_M = "m AS (SELECT DISTINCT posting_id, skill FROM posting_skills WHERE skill IS NOT NULL AND posting_id IS NOT NULL)"
_QUARTILES = "count(*) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3"


# pay


@query(f"WITH {_PLACED} SELECT category, province, {_QUARTILES} FROM q WHERE x IS NOT NULL AND category IS NOT NULL GROUP BY category, province")
def salary_summary(spark, sf):
    rows = placed(spark, sf).where(F.col("category").isNotNull())
    return rounded(graph.pay_summary(rows, ["category", "province"]), "q1", "median", "q3")


@query(
    f"WITH {_PLACED} SELECT job_title_node, province, experience_level, {_QUARTILES} FROM q WHERE x IS NOT NULL AND job_title_node IS NOT NULL AND experience_level IS NOT NULL GROUP BY job_title_node, province, experience_level HAVING count(*) >= 5"
)
def salary_summary_3way(spark, sf):
    by = ["job_title_node", "province", "experience_level"]
    return rounded(graph.pay_summary(placed(spark, sf).dropna(subset=by), by).where(F.col("n") >= linking.FEW), "q1", "median", "q3")


@query(
    f"""WITH {_PAID}, g AS (SELECT job_title_node, posting_id, x, quantile_cont(x, 0.5) OVER (PARTITION BY job_title_node) AS med FROM p WHERE x IS NOT NULL AND job_title_node IS NOT NULL),
r AS (SELECT job_title_node, posting_id, CAST(row_number() OVER (PARTITION BY job_title_node ORDER BY abs(x - med), posting_id) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 5"""
)
def salary_evidence(spark, sf):
    return graph.nearest_to_median(postings(spark, sf).where(F.col("job_title_node").isNotNull()), ["job_title_node"])


@query(f"WITH {_PAID} SELECT job_title_node, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median FROM p WHERE x IS NOT NULL AND job_title_node IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY median DESC, job_title_node LIMIT 10")
def best_paid_titles(spark, sf):
    rows = graph.pay_summary(postings(spark, sf).where(F.col("job_title_node").isNotNull()), ["job_title_node"]).where(F.col("n") >= linking.FEW)
    return rounded(rows.select("job_title_node", "n", "median").orderBy(F.desc("median"), "job_title_node").limit(10), "median")


@query(f"WITH {_PLACED} SELECT job_title_node, province, count(*) AS n FROM q WHERE job_title_node IS NOT NULL GROUP BY 1, 2 HAVING count(*) < 5")
def too_few_postings(spark, sf):
    return placed(spark, sf).where(F.col("job_title_node").isNotNull()).groupBy("job_title_node", "province").agg(F.count("*").alias("n")).where(F.col("n") < linking.FEW)


@query(f"WITH {_PLACED} SELECT job_title_node, province, count(*) AS n FROM q WHERE job_title_node IS NOT NULL GROUP BY 1, 2")
def count_title_province(spark, sf):
    return placed(spark, sf).where(F.col("job_title_node").isNotNull()).groupBy("job_title_node", "province").agg(F.count("*").alias("n"))


@query(
    """SELECT count(*) AS n, count(DISTINCT job_title) AS titles, count(*) FILTER (WHERE salary_mid IS NULL OR isnan(salary_mid)) AS unpaid,
count(*) FILTER (WHERE len(provinces) > 1) AS several_places, count(*) FILTER (WHERE job_title_node IS NULL) AS rare_titles FROM postings"""
)
def coverage(spark, sf):
    p = postings(spark, sf)
    return p.agg(F.count("*").alias("n"), F.count_distinct("job_title").alias("titles"), F.count_if(present("salary_mid").isNull()).alias("unpaid"), F.count_if(F.size("provinces") > 1).alias("several_places"), F.count_if(F.col("job_title_node").isNull()).alias("rare_titles"))


# skills and association


@query(f"WITH {_M} SELECT skill, count(*) AS n_item FROM m GROUP BY skill HAVING count(*) >= 5")
def skill_vocabulary(spark, sf):
    return association.vocabulary(mentions(spark, sf), "posting_id", "skill", 5).withColumnRenamed("item", "skill")


@query(
    f"""WITH {_M}, k AS (SELECT posting_id, category FROM postings WHERE category IS NOT NULL), j AS (SELECT k.posting_id, category, skill FROM k JOIN m USING (posting_id))
SELECT category, skill, count(DISTINCT posting_id) AS n FROM j GROUP BY GROUPING SETS ((category, skill), (skill))
UNION ALL SELECT category, NULL, count(DISTINCT posting_id) FROM k GROUP BY GROUPING SETS ((category), ())"""
)
def group_counts(spark, sf):
    return association.group_counts(mentions(spark, sf), "posting_id", "skill", postings(spark, sf), "category")


def _chi2_sql(least: int, alpha: float, group: str = "category") -> str:
    """Cells with their chi-squared and whether it is significant over all cells.
    SQL has no normal tail, so for each cell the upper tail is summed from its
    continued fraction, which converges for the large values that matter."""
    fraction = "x"
    for k in range(40, 0, -1):
        fraction = f"(x + {k}.0 / {fraction})"
    return f"""WITH {_M}, k AS (SELECT posting_id, {group} FROM postings WHERE {group} IS NOT NULL),
w AS (SELECT skill FROM m GROUP BY skill HAVING count(*) >= {least}), g AS (SELECT {group}, count(*) AS n_group FROM k GROUP BY 1),
c AS (SELECT {group}, skill, count(*) AS ab FROM k JOIN m USING (posting_id) JOIN w USING (skill) GROUP BY 1, 2),
s AS (SELECT w.skill, coalesce(sum(ab), 0) AS n_item FROM w LEFT JOIN c USING (skill) GROUP BY 1), t AS (SELECT count(*) AS n FROM k),
f AS (SELECT g.{group}, s.skill, coalesce(ab, 0) AS n_ab, n_group, n_item, n FROM g CROSS JOIN s CROSS JOIN t LEFT JOIN c ON c.{group} = g.{group} AND c.skill = s.skill),
v AS (SELECT *, coalesce((n_item - n_ab) / nullif(CAST(n - n_group AS DOUBLE), 0), 0) AS r_out, CAST(n_ab AS DOUBLE) / n_group AS r_in,
CASE WHEN CAST(n_group AS DOUBLE) * (n - n_group) * n_item * (n - n_item) > 0 THEN n * pow(CAST(n_ab AS DOUBLE) * (n - n_group - n_item + n_ab) - CAST(n_group - n_ab AS DOUBLE) * (n_item - n_ab), 2)
/ (CAST(n_group AS DOUBLE) * (n - n_group) * n_item * (n - n_item)) ELSE 0 END AS chi FROM f), u AS (SELECT *, sqrt(chi) AS x, count(*) OVER () AS tests FROM v)
SELECT {group}, skill, CAST(n_ab AS BIGINT) AS n_ab, n_group, CAST(n_item AS BIGINT) AS n_item, round(r_in, 6) AS rate_in, round(r_out, 6) AS rate_out, round(chi, 4) AS chi2, r_in > r_out AS positive,
x > 1.5 AND 2 * exp(-chi / 2) / sqrt(2 * pi()) / {fraction} < {alpha} / tests AS significant FROM u"""


@query(_chi2_sql(30, 0.05))
def chi2_association(spark, sf):
    grid = association.chi2_grid(mentions(spark, sf), "posting_id", "skill", postings(spark, sf), "category", 30)
    return rounded(grid.select("category", "skill", "n_ab", "n_group", "n_item", "rate_in", "rate_out", F.round("chi2", 4).alias("chi2"), "positive", "significant"), "rate_in", "rate_out")


@query(f"SELECT category, skill, chi2, positive FROM ({_chi2_sql(30, 0.05)}) WHERE significant AND positive")
def chi2_significant(spark, sf):
    grid = association.chi2_grid(mentions(spark, sf), "posting_id", "skill", postings(spark, sf), "category", 30)
    return grid.where("positive and significant").select("category", "skill", F.round("chi2", 4).alias("chi2"), "positive")


@query()
def chi2_p_values(spark, sf):
    """The p-value of every cell, which SQL has no function for."""
    grid = association.chi2_grid(mentions(spark, sf), "posting_id", "skill", postings(spark, sf), "category", 30, p_values=True)
    return grid.select("category", "skill", F.round("chi2", 4).alias("chi2"), "p_value", "significant")


_PMI = f"""WITH {_M}, c AS (SELECT skill, count(*) AS c FROM m GROUP BY 1), t AS (SELECT count(*) AS n FROM postings),
pr AS (SELECT a.skill AS item_a, b.skill AS item_b, count(*) AS n_ab FROM m a JOIN m b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY 1, 2 HAVING count(*) >= 5),
l AS (SELECT item_a, item_b, n_ab, ln(CAST(n_ab AS DOUBLE) * n / (x.c * y.c)) AS pmi, -ln(CAST(n_ab AS DOUBLE) / n) AS d FROM pr JOIN c x ON x.skill = item_a JOIN c y ON y.skill = item_b CROSS JOIN t)"""


def _pairs(spark, sf, n: int | None = None) -> DataFrame:
    return association.pmi_pairs(mentions(spark, sf), "posting_id", "skill", n)


@query(_PMI + "SELECT item_a, item_b, n_ab, round(pmi, 6) AS pmi, round(pmi / d, 6) AS npmi FROM l")
def cooccurrence_pmi(spark, sf):
    return rounded(_pairs(spark, sf, postings(spark, sf).count()), "pmi", "npmi")


_BOTH = ", u AS (SELECT item_a AS item, item_b AS partner, n_ab, pmi / d AS npmi FROM l UNION ALL SELECT item_b, item_a, n_ab, pmi / d FROM l)"


@query(_PMI + _BOTH + ", r AS (SELECT *, row_number() OVER w AS k, lead(n_ab) OVER w AS nx FROM u WINDOW w AS (PARTITION BY item ORDER BY n_ab DESC, partner)) SELECT item, partner, n_ab, (nx IS NULL OR nx < n_ab) AS unique_top FROM r WHERE k = 1")
def top_cooccurring(spark, sf):
    return association.top_partner(_pairs(spark, sf))


@query(_PMI + _BOTH + ", r AS (SELECT item AS skill, partner AS related, n_ab, CAST(row_number() OVER (PARTITION BY item ORDER BY n_ab DESC, round(npmi, 9) DESC, partner) AS INTEGER) AS rank FROM u) SELECT * FROM r WHERE rank <= 10")
def related_skills(spark, sf):
    pairs = _pairs(spark, sf, postings(spark, sf).count()).withColumn("npmi", F.round("npmi", 9))
    return graph.related_skills(pairs, 10).select("skill", "related", "n_ab", "rank")


_RATES = f"""WITH {_M}, k AS (SELECT posting_id, {{0}} FROM postings WHERE {{0}} IS NOT NULL), g AS (SELECT {{0}}, count(*) AS n_group FROM k GROUP BY 1),
r AS (SELECT {{0}}, skill, count(*) AS n_with, any_value(n_group) AS n_group FROM k JOIN m USING (posting_id) JOIN g USING ({{0}}) GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _rates(spark, sf, group: str) -> DataFrame:
    return association.group_rates(mentions(spark, sf), "posting_id", "skill", postings(spark, sf), group, 3)


@query(_RATES.format("category") + " SELECT *, round(CAST(n_with AS DOUBLE) / n_group, 6) AS rate FROM r")
def group_skill_rates(spark, sf):
    return rounded(_rates(spark, sf, "category"), "rate")


@query(_RATES.format("job_title_node") + " SELECT *, round(CAST(n_with AS DOUBLE) / n_group, 6) AS rate FROM r")
def title_skill_rates(spark, sf):
    return rounded(_rates(spark, sf, "job_title_node"), "rate")


_TOP = ", o AS (SELECT {0}, skill, n_with, CAST(row_number() OVER (PARTITION BY {0} ORDER BY CAST(n_with AS DOUBLE) / n_group DESC, skill) AS INTEGER) AS rank FROM r {1}) SELECT * FROM o WHERE rank <= {2}"


@query(_RATES.format("job_title_node") + _TOP.format("job_title_node", "", 8))
def top_skills(spark, sf):
    return graph.top_skills(_rates(spark, sf, "job_title_node"), "job_title_node", 8).select("job_title_node", "skill", "n_with", "rank")


@query(
    f"""WITH tops AS ({_RATES.format("job_title_node") + _TOP.format("job_title_node", "", 8)}), x AS ({_chi2_sql(30, 0.05)}), cc AS (SELECT job_title_node, category, count(*) AS n FROM postings WHERE job_title_node IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
dc AS (SELECT job_title_node, category FROM (SELECT *, row_number() OVER (PARTITION BY job_title_node ORDER BY n DESC, category) AS k FROM cc) WHERE k = 1)
SELECT tops.job_title_node, tops.skill, tops.rank, dc.category, x.chi2 FROM tops LEFT JOIN dc USING (job_title_node) LEFT JOIN x ON x.category = dc.category AND x.skill = tops.skill AND x.positive AND x.significant"""
)
def title_skill_table(spark, sf):
    """Each title's most frequent skills and how typical they are of its commonest category."""
    p = postings(spark, sf)
    grid = association.chi2_grid(mentions(spark, sf), "posting_id", "skill", p, "category", 30)
    shown = graph.skills_table(_rates(spark, sf, "job_title_node"), "job_title_node", 8, None, graph.dominant(p, "job_title_node", "category"), grid, "category")
    return shown.select("job_title_node", "skill", "rank", "category", F.round("chi2", 4).alias("chi2"))


@query("SELECT raw, arg_max(skill, mention_id) AS canonical FROM posting_skills WHERE raw IS NOT NULL AND skill IS NOT NULL GROUP BY raw")
def raw_to_skill(spark, sf):
    return graph.raw_to_skill(table(spark, sf, "posting_skills"), "mention_id")


@query(
    """SELECT skill, count(DISTINCT posting_id) AS n_postings, CASE WHEN count(*) FILTER (WHERE source = 'soft') >= count(*) FILTER (WHERE source <> 'soft') THEN 'soft' ELSE 'technical' END AS kind
FROM posting_skills WHERE skill IS NOT NULL AND posting_id IS NOT NULL GROUP BY skill HAVING count(DISTINCT posting_id) >= 5"""
)
def skill_attributes(spark, sf):
    """What a skill's node carries: how many postings name it and its kind."""
    return graph.skill_kinds(mentions(spark, sf), 5)


@query(f"WITH {_M}, r AS (SELECT arg_max(skill, mention_id) AS canonical, raw FROM posting_skills WHERE raw IS NOT NULL AND skill IS NOT NULL GROUP BY raw), al AS (SELECT unnest(also_called) AS alias, skill FROM skill_ref), s AS (SELECT skill FROM m GROUP BY 1 HAVING count(*) >= 5), q AS (SELECT DISTINCT raw AS name FROM posting_skills WHERE raw IS NOT NULL), c AS (SELECT name, coalesce(canonical, name) AS c FROM q LEFT JOIN r ON r.raw = name), t AS (SELECT name, coalesce(al.skill, c) AS t FROM c LEFT JOIN al ON al.alias = c) SELECT name, s.skill FROM t LEFT JOIN s ON s.skill = t")
def resolved_names(spark, sf):
    """Each typed value's node of the graph, over the raw map and one alias; null where it has none."""
    p = table(spark, sf, "posting_skills")
    aliases = table(spark, sf, "skill_ref").select(F.explode("also_called").alias("skill"), F.col("skill").alias("canonical"))
    names = p.where(F.col("raw").isNotNull()).select(F.col("raw").alias("name")).distinct()
    return graph.resolve_names(names, graph.raw_to_skill(p, "mention_id"), graph.skill_kinds(mentions(spark, sf), 5).select("skill"), aliases)


_OWNED = ("giao tiếp", "excel", "làm việc nhóm")


@query(_RATES.format("job_title_node") + _TOP.format("job_title_node", "WHERE skill NOT IN ('giao tiếp', 'excel', 'làm việc nhóm')", 5))
def gap_skills(spark, sf):
    owned = spark.createDataFrame([(s,) for s in _OWNED], "skill string")
    return graph.missing_skills(_rates(spark, sf, "job_title_node"), "job_title_node", owned, 5).select("job_title_node", "skill", "n_with", "rank")


@query(
    """SELECT skill, count(*) FILTER (WHERE source = 'soft') AS n_soft, count(*) FILTER (WHERE source IS DISTINCT FROM 'soft') AS n_technical,
CASE WHEN count(*) FILTER (WHERE source = 'soft') >= count(*) FILTER (WHERE source IS DISTINCT FROM 'soft') THEN 'soft' ELSE 'technical' END AS kind FROM posting_skills WHERE skill IS NOT NULL AND posting_id IS NOT NULL GROUP BY skill"""
)
def classify_kinds(spark, sf):
    return cleaning.kinds(mentions(spark, sf).withColumn("source", F.coalesce("source", F.lit(""))))


@query(
    """WITH r AS (SELECT posting_id, skill, source, mention_id, row_number() OVER (PARTITION BY posting_id, skill ORDER BY CASE WHEN source = 'technical' THEN 0 ELSE 1 END, mention_id) AS k
FROM posting_skills WHERE skill IS NOT NULL AND posting_id IS NOT NULL) SELECT posting_id, skill, source, mention_id FROM r WHERE k = 1"""
)
def mentions_dedup(spark, sf):
    ordered = mentions(spark, sf).select("*", F.when(F.col("source") == "technical", 0).otherwise(1).alias("source_ord"), F.col("mention_id").alias("item_pos"), F.lit(0).alias("part_pos"))
    return cleaning.first_mentions(ordered, "posting_id").select("posting_id", "skill", "source", "mention_id")


@query("SELECT source, count(*) FILTER (WHERE skill IS NULL) AS unnamed, count(*) FILTER (WHERE skill IS NOT NULL) AS named FROM posting_skills GROUP BY source")
def kind_crosstab(spark, sf):
    named = table(spark, sf, "posting_skills").select("source", F.when(F.col("skill").isNull(), "unnamed").otherwise("named").alias("k"))
    return named.groupBy("source").pivot("k", ["unnamed", "named"]).count().na.fill(0, ["unnamed", "named"])


@query(
    """WITH a AS (SELECT unnest(also_called) AS alias, skill FROM skill_ref), r AS (SELECT p.posting_id, coalesce(a.skill, p.skill) AS skill FROM posting_skills p LEFT JOIN a ON a.alias = p.skill WHERE p.skill IS NOT NULL AND p.posting_id IS NOT NULL)
SELECT DISTINCT posting_id, skill FROM r"""
)
def resolved_mentions(spark, sf):
    merges = table(spark, sf, "skill_ref").select(F.explode("also_called").alias("skill"), F.col("skill").alias("canonical"))
    return resolve.apply_merges(mentions(spark, sf), merges)


# titles and fields


@query(
    """WITH c AS (SELECT job_title_norm, job_title, count(*) AS n FROM postings WHERE job_title_norm IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY job_title_norm) AS total, row_number() OVER (PARTITION BY job_title_norm ORDER BY n DESC, job_title) AS k FROM c)
SELECT job_title_norm, job_title AS job_title_display, CASE WHEN total >= 20 THEN job_title_norm END AS job_title_node FROM r WHERE k = 1"""
)
def title_display(spark, sf):
    rows = postings(spark, sf).select("job_title_norm", "job_title").where(F.col("job_title_norm").isNotNull() & F.col("job_title").isNotNull())
    return cleaning.title_columns(rows, "job_title", "job_title_norm", 20).select("job_title_norm", "job_title_display", "job_title_node").distinct()


@query(
    r"""WITH v AS (SELECT row_id, salary, coalesce(salary_max, 0) <> 0 AS ok FROM vietjobs), e AS (SELECT row_id, ok, nullif(regexp_extract(salary, '([\d.]+)\s*-\s*[\d.]+\s*triệu', 1), '') AS a, nullif(regexp_extract(salary, '[\d.]+\s*-\s*([\d.]+)\s*triệu', 1), '') AS b,
nullif(regexp_extract(salary, '([\d.]+)\s*triệu', 1), '') AS c FROM v), x AS (SELECT row_id, CASE WHEN ok THEN try_cast(coalesce(a, c) AS DOUBLE) END AS salary_min, CASE WHEN ok THEN try_cast(coalesce(b, c) AS DOUBLE) END AS salary_max FROM e),
y AS (SELECT *, (salary_min + salary_max) / 2 AS m FROM x) SELECT row_id, round(salary_min, 6) AS salary_min, round(salary_max, 6) AS salary_max, round(m, 6) AS salary_mid,
CASE WHEN m < 7 THEN 'under_7m' WHEN m < 10 THEN '7_10m' WHEN m < 15 THEN '10_15m' WHEN m < 20 THEN '15_20m' WHEN m < 30 THEN '20_30m' WHEN m < 50 THEN '30_50m' WHEN m IS NOT NULL THEN '50m_plus' END AS salary_band FROM y"""
)
def parsed_pay(spark, sf):
    v = table(spark, sf, "vietjobs").select("row_id", cleaning.pay_range("salary", "salary_max").alias("p"))
    mid = (F.col("p.low") + F.col("p.high")) / 2
    return rounded(v.select("row_id", F.col("p.low").alias("salary_min"), F.col("p.high").alias("salary_max"), mid.alias("salary_mid"), cleaning.pay_band(mid).alias("salary_band")), "salary_min", "salary_max", "salary_mid")


@query(
    r"""WITH v AS (SELECT row_id, lower(experience_required) AS t FROM vietjobs), e AS (SELECT row_id, CASE WHEN contains(t, 'không yêu cầu') THEN 0.0 ELSE CAST(nullif(regexp_extract(t, '(\d+)\s*(năm|tháng)', 1), '') AS DOUBLE) * CASE WHEN regexp_extract(t, '(\d+)\s*(năm|tháng)', 2) = 'năm' THEN 12 ELSE 1 END END AS months FROM v)
SELECT row_id, CAST(months AS DOUBLE) AS experience_months, CASE WHEN months <= 0 THEN 'none' WHEN months <= 11 THEN 'under_1y' WHEN months <= 24 THEN '1_2y' WHEN months <= 48 THEN '3_4y' WHEN months IS NOT NULL THEN '5y_plus' END AS experience_level FROM e"""
)
def parsed_experience(spark, sf):
    months = cleaning.experience_months("experience_required")
    return table(spark, sf, "vietjobs").select("row_id", months.alias("experience_months"), cleaning.experience_level(months).alias("experience_level"))


@query(r"""SELECT row_id, list_filter(list_transform(string_split(coalesce(nfc_normalize(languages_required), ''), ','), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '' AND x <> 'unk') AS languages FROM vietjobs""")
def parsed_languages(spark, sf):
    return table(spark, sf, "vietjobs").select("row_id", cleaning.languages(T.nfc("languages_required")).alias("languages"))


@query()
def cleaned_postings(spark, sf):
    return cleaning.clean_postings(table(spark, sf, "vietjobs"), "row_id").drop("description", "requirements_text", "benefits")


@query()
def skill_tables(spark, sf):
    """Skills of the list-literal cells, each once per notice."""
    parts = cleaning.skill_parts(table(spark, sf, "vietjobs"), "row_id", {"technical": "technical_skills", "soft": "soft_skills"})
    return cleaning.first_mentions(parts, "row_id").select("row_id", "source", "raw", "skill")


@query("WITH c AS (SELECT job_title_node, category, count(*) AS n FROM postings WHERE job_title_node IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY job_title_node ORDER BY n DESC, category) AS k FROM c) SELECT job_title_node, category, n FROM r WHERE k = 1")
def dominant_category(spark, sf):
    return graph.dominant(postings(spark, sf), "job_title_node", "category")


@query(
    f"""WITH {_M}, t AS (SELECT posting_id, job_title_node FROM postings WHERE job_title_node IS NOT NULL), h AS (SELECT DISTINCT posting_id FROM m WHERE skill = 'giao tiếp')
SELECT job_title_node, count(*) AS n, count(h.posting_id) AS n_with, round(count(h.posting_id) / CAST(count(*) AS DOUBLE), 6) AS rate FROM t LEFT JOIN h USING (posting_id) GROUP BY 1"""
)
def skill_rate(spark, sf):
    """How often each title asks for one skill, titles that never do too."""
    holders = mentions(spark, sf).where(F.col("skill") == "giao tiếp").select("posting_id").distinct().withColumn("_has", F.lit(1))
    titled = postings(spark, sf).where(F.col("job_title_node").isNotNull()).join(holders, "posting_id", "left")
    return rounded(titled.groupBy("job_title_node").agg(F.count("*").alias("n"), F.count("_has").alias("n_with")).withColumn("rate", F.col("n_with") / F.col("n")), "rate")


@query("SELECT skill, count(*) AS n FROM posting_skills p WHERE skill IS NOT NULL AND NOT EXISTS (SELECT 1 FROM skill_ref r WHERE r.skill = p.skill) GROUP BY 1")
def unlisted_skills(spark, sf):
    """Names the reference list doesn't have, and how many rows use them."""
    rows = table(spark, sf, "posting_skills").where(F.col("skill").isNotNull())
    return rows.join(table(spark, sf, "skill_ref").select("skill"), "skill", "left_anti").groupBy("skill").agg(F.count("*").alias("n"))


@query()
def rule_resolution(spark, sf):
    """How far the naming rules alone get from the typed cell to the stored skill, by source."""
    rows = table(spark, sf, "posting_skills").where(F.col("skill").isNotNull() & F.col("raw").isNotNull()).select("source", "skill", "raw")
    names = rows.select("raw").distinct().withColumn("said", cleaning.canonical_skill("raw"))  # each cell is worked out once
    return rounded(evaluation.precision_recall(rows.join(names, "raw"), F.lit(True), F.col("said") == F.col("skill"), ["source"]), "precision", "recall", "f1")


# the graph

_NODES = f"""SELECT 'posting:' || posting_id AS id, 'JobPosting' AS type, CAST(posting_id AS VARCHAR) AS name FROM postings
UNION ALL SELECT DISTINCT 'title:' || job_title_node, 'JobTitle', job_title_node FROM postings WHERE job_title_node IS NOT NULL
UNION ALL SELECT DISTINCT 'category:' || category, 'Category', category FROM postings WHERE category IS NOT NULL
UNION ALL SELECT DISTINCT 'salary:' || salary_band, 'SalaryBand', salary_band FROM postings WHERE salary_band IS NOT NULL
UNION ALL SELECT DISTINCT 'exp:' || experience_level, 'ExperienceLevel', experience_level FROM postings WHERE experience_level IS NOT NULL
UNION ALL SELECT DISTINCT 'edu:' || education_level, 'Qualification', education_level FROM postings WHERE education_level IS NOT NULL AND education_level <> 'unspecified'
UNION ALL SELECT DISTINCT 'province:' || province, 'Province', province FROM q
UNION ALL SELECT 'skill:' || skill, 'Skill', skill FROM (SELECT skill FROM m GROUP BY 1 HAVING count(*) >= 5)"""


@query(f"WITH {_PLACED}, {_M} {_NODES}")
def graph_nodes(spark, sf):
    return graph.nodes(postings(spark, sf), mentions(spark, sf))


_EDGES = """SELECT 'posting:' || posting_id AS src, 'title:' || job_title_node AS dst, 'HAS_TITLE' AS rel FROM postings WHERE job_title_node IS NOT NULL
UNION ALL SELECT 'posting:' || posting_id, 'category:' || category, 'IN_CATEGORY' FROM postings WHERE category IS NOT NULL
UNION ALL SELECT 'posting:' || posting_id, 'salary:' || salary_band, 'PAYS' FROM postings WHERE salary_band IS NOT NULL
UNION ALL SELECT 'posting:' || posting_id, 'exp:' || experience_level, 'REQUIRES_EXPERIENCE' FROM postings WHERE experience_level IS NOT NULL
UNION ALL SELECT 'posting:' || posting_id, 'edu:' || education_level, 'REQUIRES_EDUCATION' FROM postings WHERE education_level IS NOT NULL AND education_level <> 'unspecified'
UNION ALL SELECT 'posting:' || posting_id, 'province:' || province, 'LOCATED_IN' FROM q"""


@query(f"WITH {_PLACED} {_EDGES}")
def posting_edges(spark, sf):
    return graph.posting_edges(postings(spark, sf))


def _edges_sql() -> str:
    """All relations: filed under, required, named alike, seen together, associated, typical."""
    none = "CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS chi2, CAST(NULL AS DOUBLE) AS npmi"
    parts = [f"SELECT src, dst, rel, {none} FROM (WITH {_PLACED} {_EDGES})"]
    known = f"WITH {_M}, w AS (SELECT skill FROM m GROUP BY 1 HAVING count(*) >= 5), kn AS (SELECT posting_id, skill FROM m JOIN w USING (skill))"
    parts.append(f"SELECT src, dst, rel, {none} FROM ({known} SELECT 'posting:' || posting_id AS src, 'skill:' || skill AS dst, 'REQUIRES' AS rel FROM kn)")
    parts.append(f"SELECT src, dst, rel, {none} FROM ({known} SELECT 'skill:' || al AS src, 'skill:' || skill AS dst, 'ALIAS_OF' AS rel FROM (SELECT unnest(also_called) AS al, skill FROM skill_ref) JOIN w USING (skill))")
    parts.append(
        f"""SELECT * FROM ({known}, c AS (SELECT skill, count(*) AS c FROM kn GROUP BY 1), t AS (SELECT count(DISTINCT posting_id) AS n FROM kn), pr AS (SELECT a.skill AS a, b.skill AS b, count(*) AS k FROM kn a JOIN kn b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT 'skill:' || a AS src, 'skill:' || b AS dst, 'CO_OCCURS_WITH' AS rel, k AS n, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS chi2, round(coalesce(ln(CAST(k AS DOUBLE) * t.n / (x.c * y.c)) / nullif(-ln(CAST(k AS DOUBLE) / t.n), 0), 1), 6) AS npmi FROM pr JOIN c x ON x.skill = a JOIN c y ON y.skill = b CROSS JOIN t)"""
    )
    for prefix, column in (("category", "category"), ("exp", "experience_level"), ("salary", "salary_band")):
        parts.append(f"SELECT '{prefix}:' || {column}, 'skill:' || skill, 'ASSOCIATED_WITH', n_ab, CAST(NULL AS DOUBLE), chi2, CAST(NULL AS DOUBLE) FROM ({_chi2_sql(30, 0.05, column)}) WHERE positive AND significant")
    for prefix, column in (("category", "category"), ("title", "job_title_node")):
        parts.append(f"SELECT '{prefix}:' || {column}, 'skill:' || skill, 'TYPICALLY_REQUIRES', n_with, round(CAST(n_with AS DOUBLE) / n_group, 6), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM ({_RATES.format(column)} SELECT * FROM r JOIN (SELECT skill FROM m GROUP BY 1 HAVING count(*) >= 5) USING (skill))")
    return " UNION ALL ".join(parts)


@query(_edges_sql())
def graph_edges(spark, sf):
    aliases = table(spark, sf, "skill_ref").select(F.explode("also_called").alias("skill"), F.col("skill").alias("canonical"))
    edges = graph.edges(postings(spark, sf), mentions(spark, sf), aliases)
    return rounded(edges, "rate", "npmi").withColumn("chi2", F.round("chi2", 4))


@query(f"WITH {_PLACED}, {_M} SELECT type, count(*) AS n FROM ({_NODES}) GROUP BY type")
def graph_type_counts(spark, sf):
    return graph.type_counts(graph.nodes(postings(spark, sf), mentions(spark, sf)), "type")


_SCOPE = ("category:bán_hàng_dịch_vụ_khách", "province:hà nội")


@query(f"WITH {_PLACED} SELECT posting_id FROM q WHERE category = 'bán_hàng_dịch_vụ_khách' AND province = 'hà nội'")
def matching_postings(spark, sf):
    return graph.matching(graph.posting_edges(postings(spark, sf)), *_SCOPE)


@query(f"WITH {_PLACED}, e AS ({_EDGES}), s AS (SELECT DISTINCT src AS id FROM e WHERE dst = 'province:hà nội'), k AS (SELECT id FROM s UNION SELECT DISTINCT dst FROM e WHERE rel IN ('IN_CATEGORY', 'PAYS')) SELECT e.* FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def induced_subgraph(spark, sf):
    e = graph.posting_edges(postings(spark, sf))
    kept = e.where(F.col("dst") == "province:hà nội").select(F.col("src").alias("id")).unionByName(e.where(F.col("rel").isin("IN_CATEGORY", "PAYS")).select(F.col("dst").alias("id")))
    return graph.induced(e, kept)


# retrieval: CVs ask, postings answer


def _docs(spark, sf) -> DataFrame:
    """Each posting's title, skills, requirements and description; texts are those of its latest notice."""
    raw = table(spark, sf, "vietjobs")
    latest = raw.groupBy("posting_id").agg(F.max(F.struct("crawled_at", "row_id")).alias("_m")).select(F.col("_m.row_id").alias("row_id"))
    texts = raw.join(latest, "row_id", "left_semi").select("posting_id", "requirements_text", "description")
    return retrieval.documents(postings(spark, sf).select("posting_id", "job_title").join(texts, "posting_id", "left"), mentions(spark, sf))


def _asking(spark, sf) -> DataFrame:
    return table(spark, sf, "cvs").where(F.substring("cv_id", 3, 20).try_cast("bigint") % EVERY == 0).select("cv_id", "text")


def _cvs(spark, sf) -> DataFrame:
    return table(spark, sf, "cvs").select("cv_id", "text")


_TERMS = rf"""WITH {_M}, sk AS (SELECT posting_id, string_agg(skill, ', ' ORDER BY skill) AS s FROM m GROUP BY 1),
tx AS (SELECT posting_id, requirements_text, description FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY crawled_at DESC NULLS LAST, row_id DESC) AS k FROM vietjobs) WHERE k = 1),
d AS (SELECT posting_id, concat_ws('. ', CASE WHEN trim(job_title) <> '' THEN job_title END, CASE WHEN trim(s) <> '' THEN s END, CASE WHEN trim(requirements_text) <> '' THEN requirements_text END, CASE WHEN trim(description) <> '' THEN description END) AS doc FROM postings LEFT JOIN sk USING (posting_id) LEFT JOIN tx USING (posting_id)),
dw AS (SELECT posting_id, regexp_extract_all(lower(doc), '[\p{{L}}\p{{N}}_]+') AS w FROM d), dt AS (SELECT posting_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS term FROM dw),
tf AS (SELECT posting_id, term, count(*) AS tf FROM dt GROUP BY 1, 2), qw AS (SELECT cv_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM cvs WHERE CAST(substr(cv_id, 3) AS BIGINT) % {EVERY} = 0),
qt AS (SELECT cv_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS term FROM qw), qf AS (SELECT cv_id, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
nn AS (SELECT count(*) AS n FROM postings), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
_TFIDF = """, idf AS (SELECT term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS i FROM df CROSS JOIN nn), w AS (SELECT posting_id, term, (1 + ln(tf)) * i AS w FROM tf JOIN idf USING (term)), nr AS (SELECT posting_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1),
qq AS (SELECT cv_id, term, (1 + ln(qtf)) * i AS qw FROM qf JOIN idf USING (term)), qn AS (SELECT cv_id, sqrt(sum(qw * qw)) AS qn FROM qq GROUP BY 1),
sc AS (SELECT cv_id, posting_id, round(sum(w * qw) / (any_value(nrm) * any_value(qn)), 9) AS score FROM w JOIN qq USING (term) JOIN nr USING (posting_id) JOIN qn USING (cv_id) GROUP BY 1, 2)"""
_BM25 = """, ln_ AS (SELECT posting_id, sum(tf) AS len FROM tf GROUP BY 1), ri AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df CROSS JOIN nn), mi AS (SELECT avg(i) AS mean FROM ri), av AS (SELECT sum(len) / (SELECT n FROM nn) AS avgdl FROM ln_),
idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * mean ELSE i END AS i FROM ri CROSS JOIN mi),
sc AS (SELECT cv_id, posting_id, round(sum(qtf * i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM tf JOIN qf USING (term) JOIN idf USING (term) JOIN ln_ USING (posting_id) CROSS JOIN av GROUP BY 1, 2)"""
_RANK = ", rk AS (SELECT cv_id, posting_id, score, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, posting_id) AS INTEGER) AS rank FROM sc WHERE score > 0) SELECT cv_id, posting_id, round(score, 5) AS score, rank FROM rk WHERE rank <= 10"


@query(_TERMS.replace(f" WHERE CAST(substr(cv_id, 3) AS BIGINT) % {EVERY} = 0", "") + _TFIDF + _RANK)
def tfidf_topk(spark, sf):
    """What TF-IDF finds for every CV."""
    return rounded(retrieval.tfidf_search(_docs(spark, sf), "posting_id", "doc", _cvs(spark, sf), "cv_id", "text"), "score", to=5)


@query(_TERMS + _BM25 + _RANK)
def bm25_topk(spark, sf):
    return rounded(retrieval.bm25_search(_docs(spark, sf), "posting_id", "doc", _asking(spark, sf), "cv_id", "text"), "score", to=5)


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % {EVERY} = 0), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.e), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 9) AS score FROM embeddings v CROSS JOIN q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s WHERE score > 0) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""
)
def dense_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    asked = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return rounded(retrieval.dense_search(v, "vec_id", "embedding", asked, "query_id", "query_vector"), "score")


def _cv_skills(spark, sf, cvs: DataFrame) -> DataFrame:
    ref = table(spark, sf, "skill_ref")
    names = ref.select(F.col("skill").alias("phrase"), "skill").unionByName(ref.select(F.explode("also_called").alias("phrase"), "skill"))
    return retrieval.named_skills(cvs, "cv_id", "text", names.select(F.concat_ws(" ", T.syllables(T.nfc("phrase"))).alias("phrase"), "skill"))


def _cv_skill_sql(which: str) -> str:
    """Skills named in CVs: runs of up to eight words without a joining word, but for fragments of longer ones."""
    return rf"""nm AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(nfc_normalize(phrase)), '[\p{{L}}\p{{N}}_]+'), ' ') AS phrase, skill FROM (SELECT skill AS phrase, skill FROM skill_ref UNION ALL SELECT unnest(also_called), skill FROM skill_ref)),
cw AS (SELECT cv_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{{L}}\p{{N}}_]+') AS w FROM cvs WHERE {which}), ci AS (SELECT cv_id, w, unnest(range(1, len(w) + 1)) AS i FROM cw), cl AS (SELECT *, unnest(range(1, 9)) AS l FROM ci),
sp AS (SELECT cv_id, i AS s, i + l AS e, array_to_string(w[i:i + l - 1], ' ') AS phrase FROM cl WHERE i + l - 1 <= len(w) AND NOT list_has_any(w[i:i + l - 1], ['và', 'hoặc', 'hay'])),
hs AS (SELECT cv_id, s, e, phrase, skill FROM sp JOIN nm USING (phrase) WHERE length(phrase) >= 3),
cs AS (SELECT DISTINCT cv_id, skill FROM hs h WHERE NOT EXISTS (SELECT 1 FROM hs o WHERE o.cv_id = h.cv_id AND o.s <= h.s AND h.e <= o.e AND o.e - o.s > h.e - h.s AND contains(o.skill, h.phrase)))"""


_ASKING = f"CAST(substr(cv_id, 3) AS BIGINT) % {EVERY} = 0"


@query(f"WITH {_cv_skill_sql('true')} SELECT cv_id, skill FROM cs")
def cv_skills(spark, sf):
    """Skills that each CV names."""
    return _cv_skills(spark, sf, table(spark, sf, "cvs").select("cv_id", "text"))


_SKILL_SEARCH = f"""{_M}, {_cv_skill_sql(_ASKING)}, dn AS (SELECT skill, count(*) AS df FROM m GROUP BY 1), id AS (SELECT skill, ln((SELECT count(*) FROM postings) / CAST(df AS DOUBLE)) AS i FROM dn),
sg AS (SELECT cv_id, posting_id, round(sum(i), 9) AS score FROM cs JOIN id USING (skill) JOIN m USING (skill) WHERE i > 0 GROUP BY 1, 2)"""


@query(f"WITH {_SKILL_SEARCH}, rk AS (SELECT cv_id, posting_id, score, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, posting_id) AS INTEGER) AS rank FROM sg WHERE score > 0) SELECT cv_id, posting_id, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def skill_search(spark, sf):
    asked = _cv_skills(spark, sf, _asking(spark, sf))
    return rounded(retrieval.skill_search(asked, "cv_id", mentions(spark, sf), "posting_id", postings(spark, sf).count()), "score")


SYSTEMS = ("tfidf", "bm25", "dense", "graph", "hybrid")


def _searches(spark, sf, asked: DataFrame, k: int = 10, deep: int = 100) -> dict[str, DataFrame]:
    """The five systems' rankings of postings for the CVs that ask: words twice,
    hashed vectors, shared skills, and all four fused by rank."""
    docs = _docs(spark, sf)
    terms = retrieval.Terms(docs, "posting_id", "doc")
    lists = {
        "tfidf": retrieval.tfidf_search(docs, "posting_id", "doc", asked, "cv_id", "text", deep, terms=terms),
        "bm25": retrieval.bm25_search(docs, "posting_id", "doc", asked, "cv_id", "text", deep, terms=terms),
        "dense": retrieval.hashed_search(terms.words, "posting_id", asked, "cv_id", "text", deep),
        "graph": retrieval.skill_search(_cv_skills(spark, sf, asked), "cv_id", mentions(spark, sf), "posting_id", postings(spark, sf).count(), deep),
    }
    return {name: ranking.where(F.col("rank") <= k) for name, ranking in lists.items()} | {"hybrid": retrieval.fuse(list(lists.values()), "cv_id", "posting_id", k)}


@query()
def hybrid_search(spark, sf):
    """TF-IDF, BM25, vectors and shared skills fused by rank."""
    return rounded(_searches(spark, sf, _cvs(spark, sf))["hybrid"], "score", to=9)


@query()
def five_systems(spark, sf):
    """What each of the five systems finds for every CV."""
    found = _searches(spark, sf, _cvs(spark, sf))
    return reduce(DataFrame.unionByName, [found[name].select("cv_id", F.lit(name).alias("system"), "posting_id", "rank") for name in SYSTEMS])


@query()
def search_metrics(spark, sf):
    """The five systems against the grades there are, as means over CVs."""
    grades = _grades(spark, sf)
    found = cut(five_systems(spark, sf))
    return rounded(evaluation.system_scores(evaluation.ranking_metrics(found, grades, "cv_id", "posting_id")), "recall", "mrr", "ndcg")


_SYSTEMS = """v AS (SELECT cv_id, posting_id, arg_max(grade, (coalesce(graded_at, TIMESTAMP '1900-01-01'), grade)) AS grade FROM relevance_llm WHERE cv_id IS NOT NULL AND grade BETWEEN 0 AND 2 AND posting_id IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT cv_id, posting_id, grade, row_number() OVER (PARTITION BY cv_id ORDER BY md5(posting_id || '-1'), posting_id) AS ra, row_number() OVER (PARTITION BY cv_id ORDER BY posting_id) AS rb FROM v),
sy AS (SELECT cv_id, posting_id, grade, 'hashed' AS system, ra AS rank FROM rk WHERE ra <= 10 UNION ALL SELECT cv_id, posting_id, grade, 'by_id', rb FROM rk WHERE rb <= 10),
id AS (SELECT cv_id, sum(CASE WHEN i <= 10 THEN grade / log2(i + 1) END) AS ideal, count(*) FILTER (WHERE grade >= 2) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY grade DESC, posting_id) AS i FROM v) GROUP BY 1),
me AS (SELECT cv_id, system, count(*) FILTER (WHERE grade >= 2) / nullif(CAST(any_value(rel) AS DOUBLE), 0) AS recall, coalesce(1.0 / min(CASE WHEN grade >= 2 THEN rank END), 0) AS mrr, sum(grade / log2(rank + 1)) / nullif(any_value(ideal), 0) AS ndcg FROM sy JOIN id USING (cv_id) GROUP BY 1, 2)"""


def _grades(spark, sf) -> DataFrame:
    rows = table(spark, sf, "relevance_llm").where(F.col("cv_id").isNotNull() & F.col("posting_id").isNotNull() & F.col("grade").between(0, 2))
    return rows.groupBy("cv_id", "posting_id").agg(F.max(F.struct("graded_at", "grade")).alias("_m")).select("cv_id", "posting_id", F.col("_m.grade").alias("grade"))


def _rankings(spark, sf, grades: DataFrame) -> DataFrame:
    """Two plain orders of each CV's graded postings, as systems to measure."""
    from pyspark.sql import Window

    a = F.row_number().over(Window.partitionBy("cv_id").orderBy(evaluation.draw_order("posting_id", 1), "posting_id"))
    b = F.row_number().over(Window.partitionBy("cv_id").orderBy("posting_id"))
    one = grades.withColumn("rank", a).where(F.col("rank") <= 10).select("cv_id", F.lit("hashed").alias("system"), "posting_id", "rank")
    return one.unionByName(grades.withColumn("rank", b).where(F.col("rank") <= 10).select("cv_id", F.lit("by_id").alias("system"), "posting_id", "rank"))


def _metrics(spark, sf) -> DataFrame:
    grades = _grades(spark, sf)
    return evaluation.ranking_metrics(_rankings(spark, sf, grades), grades, "cv_id", "posting_id")


@query(f"WITH {_SYSTEMS} SELECT cv_id, system, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM me")
def ranking_metrics(spark, sf):
    return rounded(_metrics(spark, sf), "recall", "mrr", "ndcg")


@query(f"WITH {_SYSTEMS} SELECT system, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM me GROUP BY 1")
def system_scores(spark, sf):
    return rounded(evaluation.system_scores(_metrics(spark, sf)), "recall", "mrr", "ndcg")


@query(f"WITH {_SYSTEMS} SELECT system, count(*) AS n, round(avg(grade), 6) AS mean_grade, round(avg(CAST(grade >= 2 AS INTEGER)), 6) AS share_2, round(avg(CAST(grade >= 1 AS INTEGER)), 6) AS share_1 FROM sy GROUP BY 1")
def labelled_precision(spark, sf):
    grades = _grades(spark, sf)
    return rounded(evaluation.labelled_precision(_rankings(spark, sf, grades), grades, "cv_id", "posting_id"), "mean_grade", "share_2", "share_1")


@query(f"WITH {_SYSTEMS} SELECT a.cv_id, round(a.ndcg, 6) AS a, round(b.ndcg, 6) AS b FROM me a JOIN me b USING (cv_id) WHERE a.system = 'hashed' AND b.system = 'by_id' AND a.ndcg IS NOT NULL AND b.ndcg IS NOT NULL")
def paired_ndcg(spark, sf):
    return rounded(evaluation.paired(_metrics(spark, sf), "cv_id", "hashed", "by_id"), "a", "b")


@query(f"WITH {_SYSTEMS} SELECT DISTINCT cv_id, posting_id FROM sy")
def pooled_items(spark, sf):
    return evaluation.pooled(_rankings(spark, sf, _grades(spark, sf)), "cv_id", "posting_id")


@query()
def bootstrap_ci(spark, sf):
    return evaluation.bootstrap(evaluation.paired(_metrics(spark, sf), "cv_id", "hashed", "by_id"), "cv_id")


# agreement, errors, samples

_RATERS = "SELECT a.label AS a, b.label AS b FROM doc_labels a JOIN doc_labels b ON a.doc_id = b.doc_id AND a.rater < b.rater WHERE a.label IS NOT NULL AND b.label IS NOT NULL"


def _two_raters(spark, sf) -> DataFrame:
    rows = table(spark, sf, "doc_labels").where(F.col("label").isNotNull() & F.col("rater").isNotNull())
    a, b = rows.select("doc_id", F.col("label").alias("a"), F.col("rater").alias("ra")), rows.select("doc_id", F.col("label").alias("b"), F.col("rater").alias("rb"))
    return a.join(b, "doc_id").where(F.col("ra") < F.col("rb")).select("doc_id", "a", "b")


@query(
    f"""WITH r AS ({_RATERS}), c AS (SELECT a, b, count(*) AS c FROM r GROUP BY 1, 2), x AS (SELECT a, sum(c) AS s FROM c GROUP BY 1), y AS (SELECT b, sum(c) AS s FROM c GROUP BY 1), t AS (SELECT sum(c) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS o FROM c),
e AS (SELECT sum(CASE WHEN a <> b THEN x.s * y.s ELSE 0 END) AS e FROM x CROSS JOIN y) SELECT CAST(n AS BIGINT) AS n, round(CAST(o AS DOUBLE) / n, 6) AS agreement, round(1 - CAST(n - o AS DOUBLE) * n / nullif(CAST(e AS DOUBLE), 0), 6) AS kappa FROM t CROSS JOIN e"""
)
def rater_kappa(spark, sf):
    return rounded(evaluation.kappa(_two_raters(spark, sf), "a", "b"), "agreement", "kappa")


@query(f"SELECT a, b, count(*) AS n FROM ({_RATERS}) GROUP BY 1, 2")
def rater_confusion(spark, sf):
    return evaluation.confusion(_two_raters(spark, sf), "a", "b")


_SEVERITY = ("none", "abusive", "hateful", "sexual")
_NUMBERED = f"SELECT list_position({list(_SEVERITY)!r}, a) AS a, list_position({list(_SEVERITY)!r}, b) AS b FROM ({_RATERS})"


@query(
    f"""WITH r AS ({_NUMBERED}), x AS (SELECT a, count(*) AS s FROM r GROUP BY 1), y AS (SELECT b, count(*) AS s FROM r GROUP BY 1), t AS (SELECT count(*) AS n, sum(abs(a - b)) AS o, count(*) FILTER (WHERE a = b) AS same FROM r),
e AS (SELECT sum(abs(a - b) * x.s * y.s) AS e FROM x CROSS JOIN y) SELECT CAST(n AS BIGINT) AS n, round(CAST(same AS DOUBLE) / n, 6) AS agreement, round(1 - CAST(o AS DOUBLE) * n / nullif(CAST(e AS DOUBLE), 0), 6) AS kappa FROM t CROSS JOIN e"""
)
def rater_kappa_linear(spark, sf):
    """Labels as steps of a scale, a near miss counting less than a far one."""
    step = {c: F.array_position(F.array(*map(F.lit, _SEVERITY)), F.col(c)) for c in ("a", "b")}
    return rounded(evaluation.kappa(_two_raters(spark, sf).withColumns(step), "a", "b", linear=True), "agreement", "kappa")


@query(
    f"""WITH r AS ({_RATERS}), f AS (SELECT l, coalesce(2.0 * count(*) FILTER (WHERE a = l AND b = l) / nullif(count(*) FILTER (WHERE a = l) + count(*) FILTER (WHERE b = l), 0), 0) AS f1 FROM r CROSS JOIN (SELECT unnest({list(_SEVERITY)!r}) AS l) GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg(CAST(a = b AS INTEGER)) FROM r), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f"""
)
def label_report(spark, sf):
    """The second rater's labels as predictions of the first's."""
    return rounded(evaluation.classification_report(_two_raters(spark, sf), "a", "b", list(_SEVERITY)), "accuracy", "macro_f1")


_PR = "SELECT count(*) AS n, count(*) FILTER (WHERE a <> 'none' AND b <> 'none') AS tp, count(*) FILTER (WHERE a = 'none' AND b <> 'none') AS fp, count(*) FILTER (WHERE a <> 'none' AND b = 'none') AS fn FROM r"


@query(f"WITH r AS ({_RATERS}), c AS ({_PR}) SELECT *, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM c")
def precision_recall(spark, sf):
    return rounded(evaluation.precision_recall(_two_raters(spark, sf), F.col("a") != "none", F.col("b") != "none"), "precision", "recall", "f1")


@query(
    f"""WITH r AS ({_RATERS}), l AS (SELECT 'label' AS field, a AS x, b AS y FROM r UNION ALL SELECT 'marked', CASE WHEN a <> 'none' THEN 'yes' ELSE 'no' END, CASE WHEN b <> 'none' THEN 'yes' ELSE 'no' END FROM r),
o AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE x = y) AS same FROM l GROUP BY 1), e AS (SELECT a.field, sum(CASE WHEN a.x <> b.y THEN a.c * b.c ELSE 0 END) AS e FROM (SELECT field, x, count(*) AS c FROM l GROUP BY 1, 2) a JOIN (SELECT field, y, count(*) AS c FROM l GROUP BY 1, 2) b ON a.field = b.field GROUP BY 1)
SELECT field, n, round(CAST(same AS DOUBLE) / n, 6) AS agreement, round(1 - CAST(n - same AS DOUBLE) * n / nullif(CAST(e AS DOUBLE), 0), 6) AS kappa FROM o JOIN e USING (field)"""
)
def field_agreement(spark, sf):
    """Agreement on the label itself and on whether there is one."""
    both = _two_raters(spark, sf).select("a", "b", *[F.when(F.col(c) != "none", "yes").otherwise("no").alias(f"{c}_marked") for c in ("a", "b")])
    return rounded(evaluation.field_agreement(both, {"label": ("a", "b"), "marked": ("a_marked", "b_marked")}), "agreement", "kappa")


@query(
    """WITH m AS (SELECT doc_id, label, rater, avg(CASE WHEN label = 'none' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS bad FROM doc_labels WHERE label IS NOT NULL AND rater IS NOT NULL)
SELECT rater AS field, count(*) AS n, count(*) FILTER (WHERE (label <> 'none') <> (bad > 0.5)) AS wrong, round(count(*) FILTER (WHERE (label <> 'none') <> (bad > 0.5)) / CAST(count(*) AS DOUBLE), 6) AS rate FROM m WHERE bad <> 0.5 GROUP BY 1"""
)
def rater_error_rates(spark, sf):
    """Raters against the majority; documents without one don't count."""
    rows = table(spark, sf, "doc_labels").where(F.col("label").isNotNull() & F.col("rater").isNotNull())
    most = rows.groupBy("doc_id").agg(F.avg(F.when(F.col("label") == "none", 0).otherwise(1)).alias("bad"))
    judged = rows.join(most, "doc_id").select("doc_id", "rater", F.when(F.col("bad") == 0.5, "unclear").when((F.col("label") != "none") != (F.col("bad") > 0.5), "wrong").otherwise("correct").alias("verdict"))
    raters = sorted(r["rater"] for r in small_rows(rows.select("rater").distinct(), "raters"))
    wide = judged.select(*[F.when(F.col("rater") == r, F.col("verdict")).alias(r) for r in raters])
    return rounded(evaluation.error_rates(wide, raters), "rate")


@query(
    """WITH h AS (SELECT posting_id, category, md5(posting_id || '-42') AS h FROM postings), r AS (SELECT posting_id, row_number() OVER (PARTITION BY category ORDER BY h, posting_id) AS r, count(*) OVER (PARTITION BY category) AS n FROM h),
f AS (SELECT posting_id, r, round_even(0.8 * n, 0) AS f1, round_even(0.8 * n, 0) + round_even(0.1 * n, 0) AS f2 FROM r) SELECT posting_id, CASE WHEN r <= f1 THEN 'train' WHEN r <= f2 THEN 'val' ELSE 'test' END AS split FROM f"""
)
def stratified_split(spark, sf):
    return evaluation.stratified_split(postings(spark, sf), "posting_id", "category")


@query("SELECT posting_id FROM postings ORDER BY md5(posting_id || '-7'), posting_id LIMIT 200")
def sampled_ids(spark, sf):
    return evaluation.sample_ids(postings(spark, sf), "posting_id", 200, 7)


@query(
    """WITH v AS (SELECT cv_id, posting_id, arg_max(grade, (coalesce(graded_at, TIMESTAMP '1900-01-01'), grade)) AS grade FROM relevance_llm WHERE cv_id IS NOT NULL AND grade BETWEEN 0 AND 2 AND posting_id IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, md5(cv_id || '|' || posting_id || '-7') AS h FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY h, cv_id, posting_id) AS r FROM h),
p AS (SELECT *, CASE WHEN r <= 33 THEN 0 ELSE 1 END AS p FROM r) SELECT cv_id, posting_id, grade FROM p ORDER BY p, h, cv_id, posting_id LIMIT 99"""
)
def sampled_by_grade(spark, sf):
    return evaluation.sample_by_grade(_grades(spark, sf), ["cv_id", "posting_id"], "grade", 99, 7)


@query()
def question_set(spark, sf):
    """Templated questions with answers from the tables alone."""
    return rounded(questions.question_set(postings(spark, sf), mentions(spark, sf)), "number")


@query(
    r"""WITH s AS (SELECT skill AS canonical, lower(raw) AS l, min(raw) AS raw FROM posting_skills WHERE skill IS NOT NULL AND raw IS NOT NULL AND NOT regexp_matches(raw, '[,;:()|/\n]') GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY md5(raw || '-7'), raw) AS r FROM s), t AS (SELECT canonical, min(raw) AS a, max(raw) AS b, count(*) AS k FROM f WHERE r <= 2 GROUP BY 1),
d AS (SELECT a, b FROM t WHERE k = 2 ORDER BY md5(canonical || '-7'), canonical LIMIT 60), o AS (SELECT DISTINCT a, b FROM d), n AS (SELECT *, row_number() OVER (ORDER BY md5(a || '|' || b || '-7'), a || '|' || b) - 1 AS p FROM o)
SELECT 'rule-' || lpad(CAST(p AS VARCHAR), 3, '0') AS pair_id, a, b, 'rule' AS stratum, CAST(NULL AS DOUBLE) AS cosine, CASE WHEN p % 2 = 0 THEN 'dev' ELSE 'test' END AS split, '' AS label FROM n"""
)
def label_sheet(spark, sf):
    """Pairs of spellings of one skill to be labelled, dev and test in turn."""
    rows = table(spark, sf, "posting_skills").where(F.col("skill").isNotNull() & F.col("raw").isNotNull()).select("raw", F.col("skill").alias("canonical"))
    return labels.label_sheet(labels.spelling_pairs(rows, 60, 7), 7)


@query()
def shown_matches(spark, sf):
    """What a search shows: each hit's title, pay, and the skills it shares with the CV."""
    hits = retrieval.bm25_search(_docs(spark, sf), "posting_id", "doc", _cvs(spark, sf), "cv_id", "text")
    return retrieval.match_table(hits, "cv_id", "posting_id", _cv_skills(spark, sf, _cvs(spark, sf)), postings(spark, sf), mentions(spark, sf))


# vectors: near pairs, clusters, thresholds

NEAR = 0.35
_NEAR = f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), n AS (SELECT * FROM p WHERE score >= {NEAR})"""


def _near(spark, sf) -> DataFrame:
    return resolve.near_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", NEAR)


@query(_NEAR + " SELECT a, b, round(score, 6) AS score FROM n")
def near_vectors(spark, sf):
    return rounded(_near(spark, sf), "score")


@query(_NEAR.replace("WITH p", "WITH RECURSIVE p") + ", e AS (SELECT a AS u, b AS v FROM n UNION SELECT b, a FROM n), c AS (SELECT u AS id, u AS root FROM e UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id) SELECT id, min(root) AS component FROM c GROUP BY id")
def vector_components(spark, sf):
    return resolve.components(_near(spark, sf))


@query()
def vector_clusters(spark, sf):
    """Greedy clusters of vectors, none far from its representative."""
    v = table(spark, sf, "embeddings")
    names = v.select(F.col("vec_id").cast("string").alias("skill"), F.lit(1).cast("long").alias("count"), F.lit("vector").alias("kind"), F.col("embedding").alias("vector"))
    pairs = _near(spark, sf).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "score")
    # ids are no names: figures must not keep them apart
    return resolve.merge_clusters(pairs.select(F.translate("a", "0123456789", "abcdefghij").alias("a"), F.translate("b", "0123456789", "abcdefghij").alias("b"), "score"), names.withColumn("skill", F.translate("skill", "0123456789", "abcdefghij")), floor=0.3)


@query(_NEAR + " SELECT a, b, round(score, 6) AS score FROM n WHERE la = lb")
def near_vectors_of_a_kind(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("kind", F.col("label").cast("string"))
    return rounded(resolve.near_pairs(v, "vec_id", "embedding", NEAR, "kind"), "score")


_EDGES_OF_BINS = (0.35, 0.4, 0.45, 0.5, 0.6)


@query(
    _NEAR
    + f""", b AS (SELECT a, b, score, CASE {' '.join(f"WHEN score >= {x} AND score < {y} THEN {i}" for i, (x, y) in enumerate(zip(_EDGES_OF_BINS, _EDGES_OF_BINS[1:])))} END AS bin FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(a || '|' || b || '-7'), a, b) AS r FROM b WHERE bin IS NOT NULL) SELECT a, b, bin FROM r WHERE r <= 20"""
)
def sampled_by_score(spark, sf):
    """Pairs to label, a few of every bin of similarity."""
    return evaluation.sample_bins(_near(spark, sf), "score", list(_EDGES_OF_BINS), 20, 7, ["a", "b"]).select("a", "b", "bin")


@query(_NEAR + ", t AS (SELECT unnest([0.35, 0.4, 0.45, 0.5]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE la = lb AND score >= threshold) AS tp, count(*) FILTER (WHERE score >= threshold) AS said FROM n CROSS JOIN t GROUP BY 1) SELECT CAST(min(threshold) FILTER (WHERE tp >= 0.5 * said AND said > 0) AS DOUBLE) AS threshold FROM c")
def chosen_threshold(spark, sf):
    return resolve.choose_threshold(threshold_sweep(spark, sf), 0.5)


@query()
def resolution_tiers(spark, sf):
    """Vectors merged in tiers: sure pairs by themselves, pairs in the band by whether their labels agree."""
    v = table(spark, sf, "embeddings")
    names = v.select(F.concat(F.lit("v"), F.translate(F.col("vec_id").cast("string"), "0123456789", "abcdefghij")).alias("skill"), (F.pmod("vec_id", F.lit(50)) + 5).alias("count"), F.lit("vector").alias("kind"), F.col("embedding").alias("vector"))
    return resolve.resolve_tiers(names, auto=0.45, low=0.4, judge=lambda pairs: pairs["score"] >= 0.42, floor=0.3)


_STEPS = (0.35, 0.4, 0.45, 0.5)


@query(
    _NEAR
    + f""", t AS (SELECT unnest([{', '.join(map(str, _STEPS))}]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE la = lb AND score >= threshold) AS tp, count(*) FILTER (WHERE la <> lb AND score >= threshold) AS fp, count(*) FILTER (WHERE la = lb AND score < threshold) AS fn FROM n CROSS JOIN t GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1 FROM c"""
)
def threshold_sweep(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    pairs = _near(spark, sf).join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")
    return rounded(resolve.threshold_sweep(pairs, F.col("la") == F.col("lb"), F.col("score"), list(_STEPS)), "precision", "recall", "f1")


# texts

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(f"WITH w AS (SELECT {_WORDS} AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS term FROM w) SELECT term, count(*) AS n FROM t GROUP BY 1")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT {_WORDS.replace('text', 'nfc_normalize(text)')} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY 1 HAVING count(*) >= 2) SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS id FROM c ORDER BY n DESC, word LIMIT 50000")
def word_vocabulary(spark, sf):
    return learning.vocabulary(table(spark, sf, "documents"), "text")


@query(f"SELECT CAST(ceil(quantile_cont(CAST(len(coalesce({_WORDS}, [])) AS DOUBLE), 0.95)) AS BIGINT) AS length FROM documents")
def cut_length(spark, sf):
    return learning.cut_length(table(spark, sf, "documents"), "text")


@query()
def numbers_in_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.numbers("text").alias("numbers"))


# each year in turn is looked for as a word: DuckDB's patterns have no look-around
@query(
    r"""SELECT doc_id, list_filter(range(1900, 2100), lambda y: y <> 2025 AND regexp_matches(text, '(^|[^\p{L}\p{N}_])' || y || '($|[^\p{L}\p{N}_])')) AS years FROM documents WHERE text IS NOT NULL"""
)
def other_years(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.transform(T.other_years("text"), lambda y: y.cast("bigint")).alias("years"))


@query()
def linked_entities(spark, sf):
    """What every CV names: categories, titles, places, skills, experience."""
    return linking.link_entities(table(spark, sf, "cvs").select("cv_id", "text"), "cv_id", "text", _lexicon(spark, sf))


def _lexicon(spark, sf) -> linking.Names:
    p = postings(spark, sf)
    titles = {r["t"]: r["t"] for r in small_rows(p.select(F.col("job_title_node").alias("t")).where(F.col("t").isNotNull()).distinct(), "titles")}
    categories = [r["c"] for r in small_rows(p.select(F.col("category").alias("c")).where(F.col("c").isNotNull()).distinct(), "categories")]
    skills = {r["skill"]: r["skill"] for r in small_rows(table(spark, sf, "skill_ref").select("skill"), "skill_ref")}
    return linking.Names(categories, titles, skills)


def _questions(spark, sf) -> DataFrame:
    return cut(questions.question_set(postings(spark, sf), mentions(spark, sf)))


def _question_facts(spark, sf, asked: DataFrame) -> DataFrame:
    linked = cut(linking.link_entities(asked, "id", "text", _lexicon(spark, sf)))
    return facts.question_facts(linked, "id", postings(spark, sf), mentions(spark, sf), _pairs(spark, sf), plan=True)


@query()
def question_facts(spark, sf):
    """Facts of every kind for the questions of the workload."""
    return _question_facts(spark, sf, _questions(spark, sf))


def _scored_answers(spark, sf) -> DataFrame:
    asked = _questions(spark, sf)
    found = cut(_question_facts(spark, sf, asked))
    said = facts.fallback_answers(found, asked, "id")
    checked = linking.verify(said.join(facts.context(found, "id").select("id", "facts"), "id", "left").join(asked.select("id", F.col("text").alias("asked")), "id"), "text", "citations", "asked", "facts")
    return facts.score_answers(checked.select("id", "text", "refuse", "citations", "ok"), asked, "id")


@query()
def scored_answers(spark, sf):
    """Answers made of facts alone, scored against the tables' own answers."""
    return rounded(_scored_answers(spark, sf), "citation_precision")


@query()
def answer_scores(spark, sf):
    return rounded(evaluation.answer_summary(_scored_answers(spark, sf), ["group"]), "accuracy", "citation_precision", "grounded", "false_refusal")


@query()
def fact_table(spark, sf):
    """Facts of every category: its pay and its most frequent skills, with sources."""
    p = postings(spark, sf).where(F.col("category").isNotNull())
    return linking.all_facts(linking.pay_facts(p, ["category"]), linking.skill_facts(_rates(spark, sf, "category"), "category", mentions(spark, sf), p))


@query()
def verified_facts(spark, sf):
    """Every fact's own text must pass; the same with a figure beyond all of them,
    and with a source no fact has, must not."""
    found = cut(fact_table(spark, sf))
    given = F.array(F.struct("text", "values", "sources"))
    told = F.concat(F.col("text"), F.lit(" Thêm "), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x) + 13.7, 1).cast("string"), F.lit("."))
    shapes = [("as said", F.col("text"), F.slice("sources", 1, 2)), ("other figure", told, F.slice("sources", 1, 2)), ("foreign source", F.col("text"), F.array(F.lit(-1).cast("bigint")))]
    every = reduce(DataFrame.unionByName, [found.select("kind", F.lit(name).alias("shape"), said.alias("said"), cited.alias("cited"), given.alias("facts"), F.lit("").alias("asked")) for name, said, cited in shapes])
    return linking.verify(every, "said", "cited", "asked", "facts").select("kind", "shape", "said", "bad_numbers", "bad_citations", "ok")


# learning


@query("WITH c AS (SELECT category, count(*) AS n FROM cvs WHERE split = 'dev' AND category IS NOT NULL GROUP BY 1), b AS (SELECT category FROM c ORDER BY n DESC, category LIMIT 1) SELECT count(*) AS n, round(avg(CAST(c.category = b.category AS INTEGER)), 6) AS accuracy FROM cvs c CROSS JOIN b WHERE split = 'test' AND c.category IS NOT NULL")
def majority_baseline(spark, sf):
    cvs = table(spark, sf, "cvs").where(F.col("category").isNotNull())
    guess = learning.majority(cvs.where(F.col("split") == "dev"), "category")
    return rounded(cvs.where(F.col("split") == "test").agg(F.count("*").alias("n"), F.avg((F.col("category") == guess).cast("int")).alias("accuracy")), "accuracy")


@query()
def text_classifier(spark, sf):
    """Categories of CVs predicted from their texts."""
    cvs = table(spark, sf, "cvs").select("cv_id", "category", "text", "split")
    dev = cvs.where(F.col("split") == "dev")
    part = F.pmod(F.xxhash64("cv_id"), F.lit(5)) == 0
    model, _ = learning.logistic(dev.where(~part), dev.where(part), "text", "category")
    return learning.predict(model, cvs.where(F.col("split") == "test"), "cv_id", "text", "category")


# events


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(avg(CAST(value <= 20 AS INTEGER)), 6) AS within FROM events GROUP BY 1")
def latency_stats(spark, sf):
    e = table(spark, sf, "events")
    plain = e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.avg((F.col("value") <= 20).cast("int")).alias("within"))
    median = graph.quantiles_of(e, ["event_type"], "value", (0.5,)).select("event_type", F.col("q")[0].alias("median"))
    return rounded(plain.join(median, "event_type", "left"), "median", "mean", "within")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def event_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint").getField("k")).alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, sf):
    return rounded(windows.tumbling(table(spark, sf, "events"), "ts", "event_type"), "total", to=4)


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g"""
)
def event_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "user_id")
