"""Reading the loosely formed JSON that models answer with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import col


def without_thinking(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?s)<think>.*?</think>", ""))


def json_part(x: Column | str) -> Column:
    """From the first opening to the last closing bracket; the text itself if there is none."""
    found = F.regexp_extract(col(x), r"(?s)[\[{].*[\]}]", 0)
    return F.when(found != "", found).otherwise(col(x))


_ANSWERS = "array<struct<id:int,same:boolean,grade:int>>"


def _answers(x: Column | str) -> Column:
    """The list of answers, given bare or under "answers"; null if unreadable."""
    text = json_part(without_thinking(x))
    return F.coalesce(F.from_json(text, f"struct<answers:{_ANSWERS}>").getField("answers"), F.from_json(text, _ANSWERS))


def judgements(x: Column | str, n: int) -> Column:
    """``struct(same array<boolean>, complete)`` of n numbered judgements: a missing one is false."""
    got = _answers(x)
    valid = F.filter(F.coalesce(got, F.array().cast(_ANSWERS)), lambda a: a["id"].between(1, n) & a["same"].isNotNull())
    same = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.exists(valid, lambda a: (a["id"] == i) & a["same"]))
    return F.struct(same.alias("same"), (F.size(F.array_distinct(F.transform(valid, lambda a: a["id"]))) == n).alias("complete"))


def grades(x: Column | str, n: int) -> Column:
    """Array of n grades 0..2; a missing or other one is null."""
    valid = F.filter(F.coalesce(_answers(x), F.array().cast(_ANSWERS)), lambda a: a["id"].between(1, n) & a["grade"].isin(0, 1, 2))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.try_element_at(F.filter(valid, lambda a: a["id"] == i), F.lit(-1)).getField("grade"))


def answer(x: Column | str) -> Column:
    """``struct(text, refuse, citations)``; unreadable JSON gives the raw text and the ids it names as #n."""
    raw = without_thinking(x)
    got = F.from_json(json_part(raw), "struct<answer:string,refuse:boolean,citations:array<bigint>>")
    named = F.transform(F.regexp_extract_all(raw, F.lit(r"#\s*(\d+)"), F.lit(1)), lambda i: i.try_cast("bigint"))
    readable = got.isNotNull() & got["answer"].isNotNull()
    return F.struct(
        F.when(readable, got["answer"]).otherwise(raw).alias("text"),
        F.coalesce(F.when(readable, got["refuse"]), F.lit(False)).alias("refuse"),
        F.when(readable, F.coalesce(got["citations"], F.array().cast("array<bigint>"))).otherwise(F.coalesce(named, F.array().cast("array<bigint>"))).alias("citations"),
    )


def verdict(x: Column | str, field: str, words: dict[str, str]) -> Column:
    """A field's verdict translated by ``words``; unknown or unreadable is null."""
    said = F.lower(F.trim(F.get_json_object(json_part(without_thinking(x)), f"$.{field}")))
    table = F.create_map(*[F.lit(v) for pair in words.items() for v in pair])
    return F.try_element_at(table, said)
