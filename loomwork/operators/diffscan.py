"""Scanning unified diffs line by line: which lines were added and removed
where, rules over added lines, assertions lost, and table rows loosened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T


def numbered(lines: DataFrame, text: str, order: str, by: list[str]) -> DataFrame:
    """``(by..., n, text)`` of a table of lines; a diff's lines are ordered within it."""
    return lines.select(*by, F.col(order).alias("n"), F.col(text).alias("text"))


def parse(lines: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., n, file, sign, text)`` of added and removed lines. File names only
    stand before a file's first hunk; within one, '---' is a removed line."""
    over = Window.partitionBy(*by).orderBy("n")
    mark = F.when(F.col("text").startswith("diff "), 0).when(F.col("text").startswith("@@"), 1)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(over), F.lit(0)) == 1
    rows = lines.withColumn("_in", inside)

    def named(sign: str, side: str) -> Column:
        path = T.unquoted(F.regexp_replace(F.substring("text", 5, 1 << 30), r"\t+$", ""))
        name = F.regexp_replace(path, f"^{side}/", "")
        return F.last(F.when(~F.col("_in") & F.col("text").startswith(sign + " "), name), ignorenulls=True).over(over)

    rows = rows.withColumns({"_new": named("+++", "b"), "_old": named("---", "a")})
    sign = F.substring("text", 1, 1)
    changed = rows.where(F.col("_in") & sign.isin("+", "-"))
    return changed.select(*by, "n", F.when(sign == "+", F.col("_new")).otherwise(F.col("_old")).alias("file"), sign.alias("sign"), F.substring("text", 2, 1 << 30).alias("text"))


def masked(x: Column) -> Column:
    """A line without what may be a secret: quoted values and long tokens keep two characters."""
    quoted = F.regexp_replace(x, r"""(['"])([^'"]{0,2})[^'"]*\1""", "$1$2***$1")
    return F.regexp_replace(quoted, r"([A-Za-z0-9+/_-]{2})[A-Za-z0-9+/_=-]{18,}", "$1***")


def rule_hits(changed: DataFrame, rules: list[tuple[str, str, str]], by: list[str], exempt: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., n, rule, file, text)`` of added lines; a rule is (name, file pattern,
    line pattern). What stands behind a sign of assignment, in quotes or as a long
    run of letters and digits is masked, so that no secret is shown again."""
    added = changed.where((F.col("sign") == "+") & ~F.col("file").isin(*exempt))
    hit = F.array_compact(F.array(*[F.when(F.col("file").rlike(f) & F.col("text").rlike(p), F.lit(name)) for name, f, p in rules]))
    return added.select(*by, "n", F.explode(hit).alias("rule"), "file", F.substring(masked(F.trim("text")), 1, 120).alias("text"))


def empty_handlers(changed: DataFrame, by: list[str]) -> DataFrame:
    """Added lines that catch everything and are followed, in the same file, by one that does nothing."""
    over = Window.partitionBy(*by).orderBy("n")
    added = changed.where(F.col("sign") == "+").withColumns({"_next": F.lead("text").over(over), "_file": F.lead("file").over(over)})
    bare = F.col("text").rlike(r"^\s*except\s*(?:Exception)?\s*:\s*$") & F.col("_next").rlike(r"^\s*(?:pass|\.\.\.)\s*$") & (F.col("file") == F.col("_file"))
    return added.where(bare).select(*by, "n", F.lit("empty-handler").alias("rule"), "file", "text")


def lost_assertions(changed: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., file, lost)``: test files with more assertions removed than added."""
    tests = changed.where(F.col("file").rlike(r"^tests/|(?:^|/)test_[^/]*$") & F.col("text").rlike(r"^\s*(?:assert\b|with pytest\.raises|self\.assert)"))
    counts = tests.groupBy(*by, "file").agg(F.count_if(F.col("sign") == "-").alias("_minus"), F.count_if(F.col("sign") == "+").alias("_plus"))
    return counts.where(F.col("_minus") > F.col("_plus")).select(*by, "file", (F.col("_minus") - F.col("_plus")).alias("lost"))


def _cells(x: Column) -> Column:
    return F.transform(F.split(F.btrim(F.trim(x), F.lit("|")), r"\|"), lambda c: F.trim(c))


def _figures(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda f: F.replace(f, F.lit(","), F.lit(".")).cast("double"))


def changed_rows(changed: DataFrame, by: list[str], file: str, least: str, most: str) -> DataFrame:
    """``(by..., key, rule, old, new)`` of table rows in ``file``, keyed by their
    first cell: removed, added, or loosened against the direction in the old
    row's last cell (containing ``least``: figures must not fall; ``most``: not rise)."""
    rows = changed.where((F.col("file") == file) & F.col("text").startswith("|")).withColumn("key", _cells(F.col("text"))[0])
    old = rows.where(F.col("sign") == "-").groupBy(*by, "key").agg(F.max_by("text", "n").alias("old"))
    new = rows.where(F.col("sign") == "+").groupBy(*by, "key").agg(F.max_by("text", "n").alias("new"))
    both = old.join(new, [*by, "key"], "full_outer")
    pairs = F.filter(F.arrays_zip(_figures(F.col("new")).alias("n"), _figures(F.col("old")).alias("o")), lambda p: p["n"].isNotNull() & p["o"].isNotNull())
    way = F.element_at(_cells(F.col("old")), -1)
    looser = (F.contains(way, F.lit(least)) & F.exists(pairs, lambda p: p["n"] < p["o"])) | (F.contains(way, F.lit(most)) & F.exists(pairs, lambda p: p["n"] > p["o"]))
    rule = F.when(F.col("new").isNull(), "row-removed").when(F.col("old").isNull(), "row-added").when(looser, "row-loosened")
    return both.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*by, "key", "rule", "old", "new")
