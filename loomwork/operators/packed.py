"""Splitting fields that hold several values, typed with no fixed delimiter.

1. *Infer*: for every source, each candidate delimiter is scored over all cells
   on two things: how steady the number of pieces is (few empty pieces, counts
   of 2 to 12), and how regular the pieces are (share that is a known name).
   Equal cells of a source are scored once, with their number. A weak prior
   speaks for signs and words that usually separate, so a sign seen a few times
   only keeps its usual role. What a source uses is one number per source, a
   bit per candidate, joined to its cells; nothing reaches the driver.
2. *Split*: one scan of each cell with the delimiters its source was found to
   use, and with no others. Nothing separates within quotes, round brackets or
   a known name.

Defined cases: a null or blank cell and a cell of one value give no row; empty
pieces don't count and take no position; a cell of any length is scanned once;
an unclosed quote or bracket is an ordinary sign; equal rows are split alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut

# The candidate delimiters, as patterns over lower-case text.
CANDIDATES = {
    ",": r",",
    ";": r";",
    "fullwidth ;": r"；",
    "ideographic ,": r"、",
    "|": r"\|+",
    "/": r"/",
    "line": r"[\r\n]+",
    "tab": r"\t+",
    "bullet": r"(?<!\S)[•·▪●](?=\s)",
    "dash": r"(?<=\s)[-–—](?=\s)",
    "plus": r"(?<=\s)\+(?=\s)",
    "ampersand": r"(?<=\s)&(?=\s)",
    "và": r"(?<!\w)và(?!\w)",
    "hoặc": r"(?<!\w)hoặc(?!\w)",
    "hay": r"(?<!\w)hay(?!\w)",
    "and": r"(?<!\w)and(?!\w)",
    "or": r"(?<!\w)or(?!\w)",
    "colon": r":",
    "dot": r"\.(?=\w)",
    "underscore": r"_",
    "bare dash": r"(?<=\w)-(?=\w)",
}
# Cells assumed before any is seen: regular ones, and all.
USUAL, UNUSUAL = (6.0, 10.0), (0.0, 10.0)
SELDOM = {"hay": (1.0, 3.0), "and": (1.0, 3.0), "or": (1.0, 3.0)}
NEVER_USUAL = {"colon", "dot", "underscore", "bare dash"}
LEAST_SCORE = 0.25

_NUMBERED = re.compile(r"(?:\(\d{1,3}\)\s*|\d{1,3}[.)/]\s+)")
_LEAD = re.compile(r"\s*(?:(?:\(\d{1,3}\)\s*|\d{1,3}[.)/]\s+|[-–—+*•·▪●►✓]\s+)\s*)?")
_NOTE = re.compile(r"\s*\([^()]*\)\s*$")
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}]|{q}{q})*{q}") for q in "\"'"}
_ANY = re.compile("|".join(f"(?:{p})" for p in CANDIDATES.values()))


def compose(text: str) -> tuple[str, list[int] | None]:
    """NFC text, and for each of its characters the place in ``text`` where it
    begins (one more for the end); None where the two are the same."""
    if unicodedata.is_normalized("NFC", text):
        return text, None
    out, places, i = [], [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        piece = unicodedata.normalize("NFC", text[i:j])
        out.append(piece)
        places += [i] * len(piece)
        i = j
    return "".join(out), [*places, len(text)]


def lowered(text: str) -> str:
    """Lower case of the same length: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Splitter:
    """Splits cells; ``names`` are known names, ``use`` the delimiters in use."""

    def __init__(self, names: Iterable[str], use: Iterable[str] = tuple(CANDIDATES)) -> None:
        self.names = {lowered(unicodedata.normalize("NFC", n)) for n in names if n}
        every = self.names | {re.sub(r"\s*&\s*", " and ", n) for n in self.names if "&" in n}
        guarded = sorted((n for n in every if _ANY.search(n)), key=len, reverse=True)
        use = list(use)
        groups = "|".join(f"(?P<d{list(CANDIDATES).index(k)}>{CANDIDATES[k]})" for k in use)
        guard = "|".join(rf"(?:{'(?<!\\w)' if n[0].isalnum() else ''}{re.escape(n)}{'(?!\\w)' if n[-1].isalnum() else ''})" for n in guarded)
        number = r"(?P<num>(?<=\s)\(?(?P<n>\d{1,2})[.)/](?=\s))"
        self._next = re.compile(f"(?P<guard>{guard or '(?!)'})|(?P<bracket>\\([^()]*\\))|{number}|{groups or '(?!)'}")
        self._keys = {f"d{i}": k for i, k in enumerate(CANDIDATES)}
        self._some = re.compile("|".join(f"(?:{CANDIDATES[k]})" for k in use) + ("|" if use else "") + r"(?<=\s)\(?\d{1,2}[.)/]\s")

    def may_hold_several(self, cell: str) -> bool:
        """False only if none of the delimiters in use and no numbering stands in the cell."""
        return self._some.search(lowered(unicodedata.normalize("NFC", cell))) is not None

    def pieces(self, cell: str) -> tuple[list[tuple[int, int]], list[str], str]:
        """Raw spans between separators over the NFC text, the separators' names, the NFC text."""
        text, _ = compose(cell)
        low = lowered(text)
        a, b = 0, len(text)
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b - a > 1 and text[a] == "[" and text[b - 1] == "]":
            a, b = a + 1, b - 1
        first = _NUMBERED.match(low, a, b)
        counting = int(re.sub(r"\D", "", first.group())) if first else -1
        spans, used, start, i, fresh = [], [], a, a, True
        while i < b:
            if fresh:
                i = _LEAD.match(low, i, b).end()
                start = i
                fresh = False
                if i < b and text[i] in _QUOTED:
                    q = _QUOTED[text[i]].match(text, i, b)
                    if q and self._closes(low, q.end(), b):
                        i = q.end()
                        continue
            m = self._next.search(low, i, b)
            if m is None:
                break
            kind = m.lastgroup
            if m.group("guard") is not None or m.group("bracket") is not None:
                i = m.end()
                continue
            if m.group("num") is not None:
                if counting > 0 and int(m.group("n")) == counting + 1 and m.start() > start:
                    counting += 1
                    spans.append((start, m.start()))
                    used.append("number")
                    start = i = m.start()
                    fresh = True
                else:
                    i = m.start("n") + 1
                continue
            spans.append((start, m.start()))
            used.append(self._keys[kind])
            start = i = m.end()
            fresh = True
            if counting > 0:
                n = _NUMBERED.match(low, _skip(low, i, b), b)
                counting = int(re.sub(r"\D", "", n.group())) if n else counting
        spans.append((start, b))
        return spans, used, text

    def _closes(self, low: str, i: int, b: int) -> bool:
        i = _skip(low, i, b)
        if i >= b:
            return True
        m = self._next.search(low, i, b)
        return bool(m and m.start() == i and m.group("guard") is None and m.group("bracket") is None) or low[i] in "\r\n\t"

    def split(self, cell: str | None) -> list[str]:
        """The values of a cell, spelled as typed; [] for a blank cell."""
        if not cell or not cell.strip():
            return []
        spans, _, text = self.pieces(cell)
        _, places = compose(cell)
        out = []
        for s, e in spans:
            item = cell[places[s] : places[e]] if places else text[s:e]
            item = unquoted(item.strip())
            if item:
                out.append(item)
        return out


def _skip(low: str, i: int, b: int) -> int:
    while i < b and low[i] in "  　":
        i += 1
    return i


def unquoted(item: str) -> str:
    """Without enclosing quotes; quotes doubled inside become single."""
    if len(item) > 1 and item[0] == item[-1] and item[0] in "\"'":
        return item[1:-1].replace(item[0] * 2, item[0]).strip()
    if len(item) > 1 and item[0] + item[-1] in ("“”", "‘’", "«»"):
        return item[1:-1].strip()
    return item


def _score_task(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[tuple[str, str], np.ndarray] = {}
        one = {k: Splitter(names, [k]) for k in CANDIDATES}
        known = next(iter(one.values())).names
        finder = {k: re.compile(p) for k, p in CANDIDATES.items()}
        for batch in batches:
            for source, raw, times in zip(batch["_s"], batch["_raw"], batch["_n"], strict=True):
                low = lowered(unicodedata.normalize("NFC", raw))
                if not _ANY.search(low):
                    continue
                for k, p in finder.items():
                    if not p.search(low):
                        continue
                    spans, used, text = one[k].pieces(raw)
                    if k not in used:
                        continue
                    parts = [unquoted(text[s:e].strip()) for s, e in spans]
                    full = [x for x in parts if x]
                    if len(full) < 2:  # a sign at an end separates nothing and tells nothing
                        continue
                    # a piece still holding other signs is judged by its own first value
                    good = sum(_NOTE.sub("", lowered(re.split(r"[,;|/\n\t、；]", x)[0].strip(" '\"[]"))) in known for x in full)
                    row = tally.setdefault((source, k), np.zeros(4))
                    row += np.array((1, len(full), good / len(full), 2 <= len(full) <= 12 and len(parts) - len(full) <= 1)) * times
        yield pd.DataFrame([(s, k, int(v[0]), int(v[1]), float(v[2]), int(v[3])) for (s, k), v in tally.items()], columns=["source", "delimiter", "cells", "pieces", "regular", "steady"])

    return run


def _source(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def score_delimiters(df: DataFrame, source: str, raw: str, names: list[str]) -> DataFrame:
    """``(source, delimiter, cells, pieces, regular, steady)`` over all cells.
    A null source is a source of its own, named ''."""
    cells = df.where(F.col(raw).isNotNull()).groupBy(_source(source).alias("_s"), F.col(raw).alias("_raw")).agg(F.count("*").alias("_n"))
    told = cells.mapInPandas(_score_task(names), "source string, delimiter string, cells long, pieces long, regular double, steady long")
    return told.groupBy("source", "delimiter").agg(*[F.sum(c).alias(c) for c in ("cells", "pieces", "regular", "steady")])


def prior(delimiter: str) -> tuple[float, float]:
    """Regular cells and all cells assumed before any is seen."""
    return UNUSUAL if delimiter in NEVER_USUAL else SELDOM.get(delimiter, USUAL)


def judged(scored: DataFrame) -> DataFrame:
    """Adds ``score`` and ``separates`` to :func:`score_delimiters`, from counts and prior."""
    table = F.create_map(*[x for k in CANDIDATES for x in (F.lit(k), F.array(*map(F.lit, prior(k))))])
    assumed = F.element_at(table, F.col("delimiter"))
    score = (F.col("regular") + assumed[0]) / (F.col("cells") + assumed[1]) * (F.col("steady") + 4) / (F.col("cells") + 5)
    return scored.withColumn("score", score).withColumn("separates", F.col("score") >= LEAST_SCORE)


USUALLY = sum(1 << i for i, k in enumerate(CANDIDATES) if prior(k)[0] / prior(k)[1] * 0.8 >= LEAST_SCORE)


def used_delimiters(code: int) -> tuple[str, ...]:
    """The delimiters of a number with a bit per candidate."""
    return tuple(k for i, k in enumerate(CANDIDATES) if code >> i & 1)


def infer_delimiters(df: DataFrame, source: str, raw: str, names: list[str]) -> DataFrame:
    """``(source, uses)`` of every source with a candidate in some cell; ``uses``
    has a bit per candidate. Any other source uses what is usual, ``USUALLY``."""
    bit = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(CANDIDATES) for x in (k, 1 << i)]), F.col("delimiter"))
    usual = bit.bitwiseAND(F.lit(USUALLY))
    change = F.when(F.col("separates"), bit).otherwise(0) - usual
    return judged(score_delimiters(df, source, raw, names)).groupBy("source").agg((F.sum(change) + USUALLY).cast("int").alias("uses"))


REMEMBERED = 200_000


def split_values(df: DataFrame, key: str, source: str, raw: str, names: list[str], least: int = 2) -> DataFrame:
    """``(key, pos, item)``: the values of every cell that holds ``least`` or
    more, ``pos`` from 1. Rows with a null key are kept under the null key."""
    found = cut(infer_delimiters(df, source, raw, names))  # one row a source
    kind = df.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Splitter] = {}
        seen: dict[tuple[int, str], list[str]] = {}
        for batch in batches:
            keys, pos, items = [], [], []
            for k, code, raw in zip(batch["_k"], batch["_u"], batch["_raw"], strict=True):
                values = seen.get((code, raw))
                if values is None:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    splitter = made.get(code) or made.setdefault(code, Splitter(names, used_delimiters(code)))
                    values = splitter.split(raw) if least < 2 or splitter.may_hold_several(raw) else []
                    seen[code, raw] = values
                if len(values) >= least:
                    keys += [k] * len(values)
                    pos += range(1, len(values) + 1)
                    items += values
            yield pd.DataFrame({"_k": pd.Series(keys, dtype=batch["_k"].dtype), "pos": np.asarray(pos, np.int32), "item": pd.Series(items, dtype=object)})

    rows = df.where(F.col(raw).isNotNull()).select(F.col(key).alias("_k"), _source(source).alias("source"), F.col(raw).alias("_raw")).join(found, "source", "left")
    out = rows.select("_k", F.coalesce("uses", F.lit(USUALLY)).alias("_u"), "_raw").mapInPandas(run, f"_k {kind.simpleString()}, pos int, item string")
    return out.select(F.col("_k").alias(key), "pos", "item")
