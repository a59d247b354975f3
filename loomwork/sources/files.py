"""Reading and writing the formats the engine works with."""

from __future__ import annotations

import hashlib
import os
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSTING_COLUMNS = (
    "job_title", "location", "country", "qualifications", "experience_required", "salary", "salary_max", "languages_required", "contract_type",
    "category", "description", "requirements_text", "benefits", "technical_skills", "soft_skills",
)


def digest(path: str | Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of files, one task per file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def fetch(url: str, target: str | Path, sha256: str, chunk: int = 1 << 20) -> Path:
    """A verified copy of a file: nothing is done if it is there; a wrong digest
    leaves no file behind; the name appears only when the copy is whole."""
    target = Path(target)
    if target.exists() and digest(target) == sha256:
        return target
    part = target.with_name(target.name + ".part")
    target.parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:  # noqa: S310
        while block := source.read(chunk):
            out.write(block)
    if digest(part) != sha256:
        part.unlink()
        raise ValueError(f"{url}: another digest than expected")
    os.replace(part, target)
    return target


def read_postings_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = POSTING_COLUMNS) -> DataFrame:
    """Notices of a CSV with line breaks in cells; ``posting_id`` is the row's place in the file."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = header.select(*[F.col(c).cast("int").alias(c) if c == "salary_max" else F.col(c) for c in columns if c in header.columns])
    # the id Spark gives has the partition above 33 bits and the row within it below
    given = named.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).alias("_part")
    counts = given.groupBy(part).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))  # one row a partition
    placed = given.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before.select("_part", "_before")), "_part")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(place.alias("posting_id"), *named.columns)


def read_sheet(spark: SparkSession, path: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """A label sheet: all text, empty cells stay empty; ``numbers`` become doubles, unreadable ones null."""
    sheet = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    full = sheet.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in sheet.columns])
    return full.withColumns({c: F.col(c).try_cast("double") for c in numbers}) if numbers else full


def write_sheet(df: DataFrame, path: str) -> None:
    """One CSV file; the committer makes it appear whole."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def set_label(sheet: DataFrame, key: str, value: str, label: str, allowed: tuple[str, ...], column: str = "label") -> DataFrame:
    if label not in allowed:
        raise ValueError(f"{label!r} is no label")
    return sheet.withColumn(column, F.when(F.col(key) == value, F.lit(label)).otherwise(F.col(column)))


def next_unlabelled(sheet: DataFrame, order: str, column: str = "label") -> DataFrame:
    return sheet.where(F.col(column) == "").agg(F.min(order).alias(order))


def fully_labelled(fields: list[str]) -> Column:
    return F.forall(F.array(*fields), lambda x: x != "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("allowNonNumericNumbers", True).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row, missing values written as null; read back by :func:`read_jsonl`."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def with_meta(result: DataFrame, **told: object) -> DataFrame:
    """A result with what is to be known about its run, date, revision, model and
    the like, as columns of their own before the others; a clashing name is an error."""
    if clash := set(told) & set(result.columns):
        raise ValueError(f"the result has columns named {sorted(clash)}")
    return result.select(*[F.lit(value).alias(name) for name, value in told.items()], "*")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN in any double column becomes null."""
    kinds = ("double", "float")
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of KEY=VALUE lines; blank lines and comments are skipped, quotes
    taken off. Spark's own readers pass over files whose names begin with a dot."""
    told = spark.createDataFrame([(x,) for x in Path(path).read_text(encoding="utf-8").splitlines()], "value string")
    lines = told.select(F.trim("value").alias("l")).where((F.col("l") != "") & ~F.col("l").startswith("#") & F.col("l").contains("="))
    parts = F.split("l", "=", 2)
    return lines.select(F.trim(parts[0]).alias("key"), F.btrim(F.trim(parts[1]), F.lit("\"'")).alias("value"))


def overlaid(base: DataFrame, over: DataFrame) -> DataFrame:
    """Settings of ``base`` with those of ``over`` before them."""
    return base.alias("b").join(over.alias("o"), "key", "full_outer").select("key", F.coalesce("o.value", "b.value").alias("value"))


def cache_key(*parts: Column | str) -> Column:
    """The content key of a cached answer: a digest of its question's parts as JSON."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])), 256)


def read_cached(spark: SparkSession, path: str, asked: DataFrame, key: str = "key") -> DataFrame:
    """``asked`` with ``answer``, null where there is none yet; only the shards asked for are read."""
    shards = [r["s"] for r in asked.select(F.substring(key, 1, 2).alias("s")).distinct().collect()]  # two hexadecimal digits: at most 256
    stored = spark.read.schema("key string, answer string, shard string").parquet(path).where(F.col("shard").isin(shards))  # shards are no numbers.select(F.col("key").alias(key), "answer")
    return asked.join(stored, key, "left")


def write_cached(answers: DataFrame, path: str) -> None:
    """Appends ``(key, answer)`` in shards by the key's first two digits."""
    answers.select("key", "answer", F.substring("key", 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(path)


def missing_chunks(wanted: DataFrame, store: str, fingerprint: str, size: int = 2048, row: str = "row") -> DataFrame:
    """The rows whose chunk of ``size`` is not in the store yet. A store made from
    other rows, told by its fingerprint, is refused."""
    spark = wanted.sparkSession
    chunked = wanted.withColumn("chunk", F.floor(F.col(row) / size))
    if not _exists(spark, store):
        return chunked
    done = spark.read.parquet(store)
    if done.where(F.col("fingerprint") != fingerprint).limit(1).count():
        raise ValueError(f"{store} was made from other rows")
    return chunked.join(done.select("chunk").distinct(), "chunk", "left_anti")


def append_chunks(rows: DataFrame, store: str, fingerprint: str) -> None:
    rows.withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").partitionBy("chunk").parquet(store)


def fingerprint_of(rows: DataFrame, row: str, text: str, size: int = 2048) -> str:
    """A digest of all rows that doesn't depend on their order: the sum of row digests."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(row).cast("string"), F.col(text)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("s"), F.count("*").alias("n")).collect()[0]
    return hashlib.sha256(f"{total['s']}|{total['n']}|{size}".encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def markdown_table(rows: DataFrame, formats: dict[str, str] | None = None) -> str:
    """A small result as a Markdown table, all its rows; missing values are a dash."""
    formats = formats or {}
    got = rows.toLocalIterator()

    def cell(name: str, value: object) -> str:
        if value is None or value != value:
            return "–"
        return format(value, formats[name]) if name in formats else str(value)

    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(c, r[c]) for c in rows.columns) + " |" for r in got]) + "\n"
