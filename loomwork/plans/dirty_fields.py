"""Queries over freely typed fields: amounts in mixed units, packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import packed, units
from loomwork.session import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def amounts(spark: SparkSession, sf: str) -> DataFrame:
    return units.convert_amounts(
        table(spark, sf, "vietjobs"), "row_id", "feed", {"salary": units.MONEY, "experience_required": units.EXPERIENCE}, ("description", "requirements_text"), table(spark, sf, "unit_rates"), table(spark, sf, "feed_units")
    )


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return amounts(spark, sf)


def skill_names(spark: SparkSession, sf: str) -> list[str]:
    return [r["skill"] for r in units.small_rows(table(spark, sf, "skill_ref").select("skill").where(F.col("skill").isNotNull()), "skill_ref")]


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.split_values(table(spark, sf, "posting_skills"), "mention_id", "source", "raw", skill_names(spark, sf))


@query
def p4_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    """What each source separates with, and the counts behind it."""
    scored = packed.judged(packed.score_delimiters(table(spark, sf, "posting_skills"), "source", "raw", skill_names(spark, sf)))
    return scored.withColumns({c: F.round(c, 6) for c in ("regular", "score")})
