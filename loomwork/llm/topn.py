"""Top N items of every group by two-stage salted ranking.

Each group is hashed into ``salts`` subgroups by item; every subgroup is
ranked on its own and keeps N, then the at most ``salts * N`` survivors of a
group are ranked again. A group of any size is spread over ``salts`` tasks and
the second stage never sees more than ``salts * N`` rows of it. Both ranks
compile to a ``WindowGroupLimit``, which also cuts each map partition down to
N rows per subgroup before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType


def _micros(at: str, kind: DataType) -> Column:
    """Microseconds since 1970; times without a zone are not moved by the session's."""
    if not isinstance(kind, TimestampNTZType):
        return F.unix_micros(F.col(at).cast("timestamp"))
    day = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = (day * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.expr(f"extract(SECOND FROM {at})") * 1_000_000).cast("long")


def latest_scores(df: DataFrame, group: str, item: str, score: str, at: str, valid: Column | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """One row ``(_g, _i, _s)`` per (group, item): the score of the latest row.

    Rows with a null group, item or score, or failing ``valid``, are left out
    first. Of rows equally late, the higher score holds; a null time counts as
    the earliest. Aggregates on the map side, so a pair repeated without end
    is no hot key. With ``between``, the lowest and highest of whole scores, all
    other scores are left out too, and time and score are packed into one number,
    which hash aggregation can keep; else they are compared as a pair, which it can't.
    """
    keep = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull()
    if valid is not None:
        keep = keep & valid
    rows = df.where(keep).select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s"), F.col(at).alias("_t"))
    if between is not None:
        low, high = between
        width = high - low + 1
        early = F.lit(-(1 << 62) // width)
        time = F.coalesce(_micros("_t", df.schema[at].dataType), early)
        packed = rows.where(F.col("_s").between(low, high)).select("_g", "_i", (time * width + (F.col("_s") - low)).alias("_p"))
        best = packed.groupBy("_g", "_i").agg(F.max("_p").alias("_p"))
        return best.select("_g", "_i", (F.pmod("_p", F.lit(width)) + low).cast(df.schema[score].dataType).alias("_s"))
    return rows.groupBy("_g", "_i").agg(F.max(F.struct("_t", "_s")).alias("_m")).select("_g", "_i", F.col("_m._s").alias("_s"))


def top_n(scored: DataFrame, n: int = 10, salts: int = 32) -> DataFrame:
    """``(_g, _i, _s, rank)``: the N best ``_i`` of each ``_g`` by ``_s``
    downwards, ties to the smaller ``_i``. Groups with fewer items give all.

    An empty input gives an empty result; repeated (group, item) rows count as
    often as they are given, so deduplicate first (:func:`latest_scores`).
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be positive")
    best = [F.col("_s").desc(), F.col("_i").asc()]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts)).cast("int"))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*best))).where(F.col("_r") <= n).drop("_r", "_salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("_g").orderBy(*best))).where(F.col("rank") <= n)
