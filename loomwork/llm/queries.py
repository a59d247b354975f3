"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import canonical, cooccurrence, mixing, packing, quantiles, tokens, topn, toxicity
from loomwork.session import cut, table

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
SUMMARY_BITS = 23
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1: freely typed values to entries


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, list]:
    """The rows whose skill is no entry's name as stored, and the entries."""
    ref = table(spark, sf, "skill_ref")
    entries = canonical.load(ref, "skill_id", "skill", "also_called")
    rows = table(spark, sf, "posting_skills").select("mention_id", "skill", "raw").where(F.col("skill").isNotNull())
    return rows.join(F.broadcast(ref.select("skill")), "skill", "left_anti"), entries  # load() has bounded the list


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    rows, entries = _typed(spark, sf)
    return canonical.map_values(rows, "mention_id", "skill", "raw", entries).withColumnRenamed("id", "skill_id")


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("mention_id", "skill_id")


@query
def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The typed values that no entry means, and how many rows have each."""
    return _mapped(spark, sf).where(F.col("skill_id") == 0).groupBy("skill").agg(F.count("*").alias("n"))


@query
def p1_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All entries near each typed value, not only the one it is taken for."""
    rows, entries = _typed(spark, sf)
    return canonical.near_entries(rows, "skill", entries).withColumnRenamed("id", "skill_id")


# 2: the best of every group


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return topn.latest_scores(table(spark, sf, "relevance_llm"), "cv_id", "posting_id", "grade", "graded_at", between=(0, 2))


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_graded(spark, sf), 10).select(F.col("_g").alias("cv_id"), F.col("_i").alias("posting_id"))


@query
def p2_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(_graded(spark, sf), 10).select(F.col("_g").alias("cv_id"), F.col("_i").alias("posting_id"), F.col("_s").alias("grade"), "rank")


_RANKED = """
WITH good AS (SELECT cv_id, posting_id, grade, graded_at FROM relevance_llm
  WHERE cv_id IS NOT NULL AND posting_id IS NOT NULL AND grade BETWEEN 0 AND 2),
latest AS (SELECT *, row_number() OVER (PARTITION BY cv_id, posting_id ORDER BY graded_at DESC NULLS LAST, grade DESC) AS k FROM good),
ranked AS (SELECT cv_id, posting_id, grade, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY grade DESC, posting_id) AS INTEGER) AS rank
  FROM latest WHERE k = 1)
"""
SQL["p2_found"] = _RANKED + "SELECT cv_id, posting_id FROM ranked WHERE rank <= 10"
SQL["p2_ranked"] = _RANKED + "SELECT cv_id, posting_id, grade, rank FROM ranked WHERE rank <= 10"


# 5: items that appear together


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.associated_pairs(table(spark, sf, "posting_skills"), "posting_id", "skill", min_pair=5, min_lift=4)


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("skill_a", "skill_b")


@query
def p5_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair that occurs in five postings or more, whatever its lift."""
    every = cooccurrence.associated_pairs(table(spark, sf, "posting_skills"), "posting_id", "skill", min_pair=5, min_lift=0)
    return every.select("skill_a", "skill_b", "n_ab", F.round("lift", 6).alias("lift"))


_PAIRS = """
WITH base AS (SELECT DISTINCT posting_id, skill FROM posting_skills WHERE posting_id IS NOT NULL AND skill IS NOT NULL),
total AS (SELECT count(DISTINCT posting_id) AS n FROM base),
each AS (SELECT skill, count(*) AS c FROM base GROUP BY skill),
pairs AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS n_ab FROM base a JOIN base b ON a.posting_id = b.posting_id AND a.skill < b.skill
  GROUP BY 1, 2 HAVING count(*) >= 5),
lifted AS (SELECT skill_a, skill_b, n_ab, x.c AS n_a, y.c AS n_b, n FROM pairs JOIN each x ON x.skill = skill_a JOIN each y ON y.skill = skill_b CROSS JOIN total)
"""
SQL["p5_found"] = _PAIRS + "SELECT skill_a, skill_b FROM lifted WHERE n_ab * n >= 4 * n_a * n_b"
SQL["p5_lift"] = _PAIRS + "SELECT skill_a, skill_b, n_ab, round(CAST(n_ab * n AS DOUBLE) / (n_a * n_b), 6) AS lift FROM lifted"


# 6: percentiles


def _pay_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per paid posting and group it belongs to: title, category, and each
    different province name; 'unknown' and 'foreign' are no names."""
    p = quantiles.with_key(table(spark, sf, "postings").select("posting_id", "job_title_node", "category", "provinces", "salary_mid"), "salary_mid", "pay_key")
    names = F.filter(F.array_distinct("provinces"), lambda x: x.isNotNull() & ~x.isin("unknown", "foreign"))
    title = F.when(F.col("job_title_node").isNotNull(), F.struct(F.lit("title").alias("dim"), F.col("job_title_node").alias("grp")))
    category = F.when(F.col("category").isNotNull(), F.struct(F.lit("category").alias("dim"), F.col("category").alias("grp")))
    places = F.coalesce(F.transform(names, lambda x: F.struct(F.lit("province").alias("dim"), x.alias("grp"))), F.array())
    return p.select("posting_id", "pay_key", F.explode(F.concat(F.array_compact(F.array(title, category)), places)).alias("g")).select("posting_id", "g.dim", "g.grp", "pay_key")


@query
def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and keys are written once: each level of the selection reads them again."""
    q = quantiles.radix_quantiles(cut(_pay_groups(spark, sf)), ["dim", "grp"], None, QUANTILES, key="pay_key")
    return q.select("dim", "grp", "n", *[F.round(F.col("q")[i], 6).alias(f"p{round(x * 100)}") for i, x in enumerate(QUANTILES)])


@query
def p6_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from summaries of eight slices of the rows, made apart and then combined."""
    rows = _pay_groups(spark, sf).withColumn("slice", F.coalesce(F.pmod("posting_id", F.lit(8)), F.lit(0)))
    slices = quantiles.summarize(rows, ["slice", "dim", "grp"], None, SUMMARY_BITS, key="pay_key")
    q = quantiles.summary_quantiles(quantiles.combine([slices.drop("slice")]), QUANTILES, SUMMARY_BITS)
    return q.select("dim", "grp", "n", *[F.round(F.col("q")[i], 6).alias(f"p{round(x * 100)}") for i, x in enumerate(QUANTILES)])


_PAY = """
WITH places AS (SELECT salary_mid AS x, unnest(list_distinct(provinces)) AS grp FROM postings),
pay AS (SELECT 'title' AS dim, job_title_node AS grp, salary_mid AS x FROM postings
  UNION ALL SELECT 'category', category, salary_mid FROM postings
  UNION ALL SELECT 'province', grp, x FROM places WHERE grp NOT IN ('unknown', 'foreign')),
good AS (SELECT * FROM pay WHERE grp IS NOT NULL AND x IS NOT NULL AND NOT isnan(x))
"""
SQL["p6_percentiles"] = _PAY + "SELECT dim, grp, count(*) AS n, " + ", ".join(f"round(quantile_cont(x, {q}), 6) AS p{round(q * 100)}" for q in QUANTILES) + " FROM good GROUP BY dim, grp"
# the bin of a positive double with 11 mantissa bits, and its middle
SQL["p6_combined"] = (
    _PAY
    + """, mid AS (SELECT dim, grp, x, pow(2, floor(log2(x))) AS e FROM good),
bins AS (SELECT dim, grp, (floor(x / e * 2048) + 0.5) / 2048 * e AS v, row_number() OVER (PARTITION BY dim, grp ORDER BY x) AS r,
  count(*) OVER (PARTITION BY dim, grp) AS n FROM mid)
SELECT dim, grp, n, """
    + ", ".join(f"round(max(v) FILTER (WHERE r = greatest(1, ceil(CAST({q} AS DOUBLE) * n))), 6) AS p{round(q * 100)}" for q in QUANTILES)
    + " FROM bins GROUP BY dim, grp, n"
)


# 7: containers of 2,048 tokens

CAPACITY = 2048


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that were split: those with a second piece."""
    return _packed(spark, sf).where(F.col("piece") == 2).select("doc_id")


@query
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.container_fill(_packed(spark, sf)).withColumn("unused", F.lit(CAPACITY) - F.col("tokens"))


# 8: sources mixed to target weights


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).chosen


@query
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


# 9: abusive, hateful or sexual content


_MODELS: dict[tuple, tuple] = {}


def _model(spark: SparkSession, sf: str, anew: bool = False) -> tuple:
    """The trained model; kept in the session for the same marks and texts, told by their hashes."""
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "doc_labels")
    marked = labels.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "label").cast("decimal(38,0)"))).collect()[0]
    texts = documents.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).collect()[0]
    key = (spark.sparkContext.applicationId, *marked, *texts)
    if anew or key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = toxicity.train(documents, labels, "doc_id", "text", "label")
    return _MODELS[key]


def _scored(spark: SparkSession, sf: str, anew: bool = False) -> tuple[DataFrame, float]:
    model = _model(spark, sf, anew)
    return toxicity.score(table(spark, sf, "documents"), "doc_id", "text", model, keep=("source",)), model[0].threshold


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Trains anew; the other two queries of a session take its model over."""
    scored, threshold = _scored(spark, sf, anew=True)
    return scored.where(F.col("score") >= threshold).select("doc_id")


@query
def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)[0].select("doc_id", "score")


@query
def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and cases of each source; documents of no source are a group of their own."""
    scored, threshold = _scored(spark, sf)
    hit = F.count_if(F.col("score") >= threshold)
    return scored.groupBy("source").agg(F.count("*").alias("documents"), hit.alias("cases"), F.round(hit / F.count("*"), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
