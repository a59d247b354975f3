"""Amounts written in different units, converted to common ones.

A unit string ("nghìn đồng / giờ", "$4.8k", "million VND per month") is cut by
dynamic programming over three tries - scale prefixes, unit roots and
exponents ("/", "per", "mỗi") - into the best-scoring chain of pieces. A piece
earns its length, a piece that could be several things ("m": million or month,
"năm": year or five) is weighed by a prior of the field it stands in, and
words that are no unit cost a little and are stepped over. A time root after
an exponent counts as a divisor.

Figures are read first, then each figure's surroundings are segmented. A unit
missing beside a figure comes from the other end of the range, then from a
sentence of the row's texts that says in which unit the field is given, then
from the feed.

Defined cases: null, blank or figureless cells give no row; a range whose upper
figure is 0 is no amount; an open end is -1; a null row id is kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY, EXPERIENCE = "money", "experience"

# How scales, currencies, times and exponents are written.
PREFIXES = {
    1e3: ("k", "nghìn", "ngàn", "nghin", "ngan", "thousand"),
    1e6: ("tr", "triệu", "trieu", "million", "mil", "mio", "m"),
    1e9: ("tỷ", "tỉ", "billion", "bn"),
}
CURRENCIES = {
    "VND": ("đ", "đồng", "vnđ", "vnd", "₫", "dong", "việt nam đồng", "đồng việt nam"),
    "USD": ("$", "usd", "us$", "đô", "đô la", "đô la mỹ", "đô-la", "dollar", "dollars", "đôla"),
    "JPY": ("¥", "yên", "jpy", "yên nhật", "yen", "円"),
}
TIMES = {
    "hour": ("h", "giờ", "hour", "hours", "hr", "giờ làm", "tiếng"),
    "day": ("ngày", "ngày công", "day", "days", "ngay"),
    "week": ("tuần", "tuần thực tập", "week", "weeks", "wk", "wks", "w"),
    "month": ("tháng", "th", "month", "months", "mo", "mos", "mth", "mths", "thang", "m", "t"),
    "year": ("năm", "year", "years", "yr", "yrs", "y", "nam", "cả năm"),
}
EXPONENTS = ("/", "một", "mỗi", "theo", "hằng", "hàng", "per", "a", "each", "cho mỗi", "trên")
# Words in which a root is no unit.
NO_UNIT = ("hợp đồng", "lâm đồng", "đồng nai", "đồng tháp", "cộng đồng", "đồng nghiệp", "hội đồng", "đồng phục", "đồng bộ", "đồng đội", "đồng hành", "kinh nghiệm")
# How likely a kind of piece is meant in a field; log weights.
PRIORS = {
    MONEY: {"prefix": 0.0, "money": 0.0, "time": -0.5, "per time": 0.5, "exponent": -0.2},
    EXPERIENCE: {"prefix": -4.0, "money": -6.0, "time": 0.5, "per time": -2.0, "exponent": -0.5},
}
NUMBER_WORDS = {"một": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9, "mười": 10, "nửa": 0.5, "half": 0.5, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
SKIP_COST = 0.3


@dataclass(frozen=True)
class Unit:
    """What a string says: scale, currency, and time (a divisor for money)."""

    scale: float | None = None
    currency: str | None = None
    time: str | None = None

    def filled(self, other: Unit) -> Unit:
        return Unit(self.scale if self.scale is not None else other.scale, self.currency or other.currency, self.time or other.time)

    @property
    def priced(self) -> bool:
        return self.scale is not None or self.currency is not None


NONE = Unit()


def _trie() -> dict:
    root: dict = {}

    def add(word: str, kind: str, value: object) -> None:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append((kind, value))

    for scale, words in PREFIXES.items():
        for w in words:
            add(w, "prefix", scale)
    for currency, words in CURRENCIES.items():
        for w in words:
            add(w, "money", currency)
    for time, words in TIMES.items():
        for w in words:
            add(w, "time", time)
    for w in EXPONENTS:
        add(w, "exponent", None)
    for w in NO_UNIT:
        add(w, "word", None)
    return root


TRIE = _trie()


@lru_cache(maxsize=200_000)
def segment(text: str, field: str) -> Unit:
    """The unit a lower-case string says, by the best chain of pieces."""
    n = len(text)
    prior = PRIORS[field]
    # state: (scale, currency, time, exponent pending, touching); value: score
    states: list[dict[tuple, float]] = [{} for _ in range(n + 1)]
    states[0][(None, None, None, False, False)] = 0.0

    def offer(i: int, state: tuple, score: float) -> None:
        if states[i].get(state, -1e9) < score:
            states[i][state] = score

    for i in range(n):
        if not states[i]:
            continue
        found = []
        node = TRIE
        for j in range(i, n):
            node = node.get(text[j])
            if node is None:
                break
            found += [(j + 1, kind, value) for kind, value in node.get("", ())]
        word = i
        while word < n and text[word].isalpha():
            word += 1
        after = max(word, i + 1)
        for (scale, currency, time, pending, touching), score in list(states[i].items()):
            blank = not text[i].isalnum() and text[i] not in "$¥₫/"
            starts = touching or i == 0 or not (text[i - 1].isalpha() and text[i].isalpha())
            if not touching:  # what a torn-off prefix touches must be a root
                offer(after if starts else i + 1, (scale, currency, time, pending and blank, False), score - (0.0 if blank else SKIP_COST))
            if not starts:
                continue
            for j, kind, value in found:
                whole = j == n or not (text[j - 1].isalpha() and text[j].isalpha())
                gain = score + (j - i) * 0.5 + 1
                if kind == "word":
                    if whole:
                        offer(j, (scale, currency, time, False, False), gain)
                elif kind == "prefix" and scale is None and currency is None:
                    offer(j, (value, currency, time, False, not whole), gain + prior["prefix"] - (0 if whole else 0.6))
                elif kind == "prefix" and scale is None and whole:  # "$4.8k": the sign stands before
                    offer(j, (value, currency, time, False, False), gain + prior["prefix"] - 0.2)
                elif kind == "money" and currency is None and whole:
                    offer(j, (scale, value, time, False, False), gain + prior["money"])
                elif kind == "exponent" and not pending and whole:
                    offer(j, (scale, currency, time, True, False), gain + prior["exponent"] - 1)
                elif kind == "time" and time is None and (whole or field == EXPERIENCE and text[j : j + 1].isdigit()):
                    weight = prior["per time"] if pending else prior["time"]
                    if field == MONEY and not pending:
                        weight -= 0.5 + (1.5 if j - i == 1 else 0)
                    offer(j, (scale, currency, value, False, False), gain + weight)
    best = max(states[n].items(), key=lambda s: (s[1], repr(s[0])), default=((None,) * 3, 0))[0]
    return Unit(*best[:3])


FIGURE = re.compile(r"\d{1,3}(?:[ .,]\d{3})+(?!\d)|\d+[.,]\d+|\d+")
RANGE = re.compile(r"(?:^|(?<=[\s\d$¥₫đa-z]))(?:-|–|—|~|→|đến|tới|to|den|toi)(?=[\s\d$¥]|us|$)")
UPPER = re.compile(r"(?<!\w)(?:tới|lên đến|lên tới|đến|upto|up to|tối đa|không quá|dưới|thấp hơn|nhỏ hơn|chưa đến|chưa tới|at most|less than|under|below|max|maximum|no more than)(?!\w)|[<≤]")
LOWER = re.compile(r"(?<!\w)(?:từ|trên|hơn|ít nhất|tối thiểu|at least|more than|over|from|min|minimum|above)(?!\w)|[>≥]")
OPEN_AFTER = re.compile(r"^\s*[^\W\d]*\+(?!\s*[^\W\d])|^\+|(?<!\w)(?:trở lên|đổ lên|or more|and above|and up)(?!\w)")
NOTES = re.compile(r"\([^()]*\)|(?:\s\+\s|,\s)[^\d]*$|(?<!\w)(?:net|gross)(?!\w)")
NOT_ASKED = re.compile(r"(?<!\w)(?:không yêu cầu|chưa cần|không cần|không đòi hỏi|chưa yêu cầu|no experience|not required|chưa có kinh nghiệm cũng được|miễn kinh nghiệm)(?!\w)")
WORD_FIGURE = re.compile(rf"(?<!\w)({'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))})\s+(?=(?:{'|'.join(w for ws in TIMES.values() for w in ws if len(w) > 2)})(?!\w))")
HALF = re.compile(r"(?<!\w)(?:rưỡi|and a half)(?!\w)")


def figure(text: str) -> float:
    """A separator before exactly three digits groups thousands; otherwise it is decimal."""
    if re.fullmatch(r"\d{1,3}(?:[ .,]\d{3})+", text):
        return float(re.sub(r"[ .,]", "", text))
    return float(text.replace(",", "."))


@dataclass(frozen=True)
class Amount:
    """Figures of a cell before conversion; None for an open end."""

    low: tuple[float, Unit] | None
    high: tuple[float, Unit] | None


@lru_cache(maxsize=100_000)
def read_amount(cell: str, field: str, months: tuple[tuple[str, float], ...] = ()) -> Amount | None:
    """What a cell states, or None. ``cell`` is lower-case NFC text. Of several
    range signs the first and the last figure are the ends; figures that don't
    belong together leave the first. ``months`` are the rates of experience."""
    text = NOTES.sub(" ", cell) if field == MONEY else cell
    if field == EXPERIENCE:
        text = WORD_FIGURE.sub(lambda m: f"{NUMBER_WORDS[m.group(1)]:g} ", text)
    found = list(FIGURE.finditer(text))
    if not found:
        return None
    # groups of figures: those between range signs
    groups: list[list[int]] = [[0]]
    cuts: list[tuple[int, int]] = []
    for k in range(1, len(found)):
        between = text[found[k - 1].end() : found[k].start()]
        sign = RANGE.search(text, found[k - 1].end(), found[k].start() + 1)
        if sign and sign.end() <= found[k].start() and between.strip():
            groups.append([k])
            cuts.append((sign.start(), sign.end()))
        else:
            groups[-1].append(k)
    edges = [0, *(c[0] for c in cuts)], [*(c[0] for c in cuts), len(text)]
    starts = [0, *(c[1] for c in cuts)]
    values = []
    for g, a, b in zip(groups, starts, edges[1], strict=True):
        values.append(_value(text, [found[k] for k in g], a, b, field, dict(months)))
    if len(values) > 2:
        values = [values[0], values[-1]]
    if any(v is None for v in values):
        return None
    before, after = text[: found[0].start()], text[found[groups[-1][-1]].end() :]
    if len(values) == 2:
        (x, u), (y, w) = values
        u, w = _shared(u, w), _shared(w, u)
        return Amount((x, u), (y, w))
    value = values[0]
    if UPPER.search(before):
        return Amount(None, value)
    if LOWER.search(before) or OPEN_AFTER.search(text[found[-1].end() :]) or OPEN_AFTER.search(after):
        return Amount(value, None)
    return Amount(value, value)


def _shared(own: Unit, other: Unit) -> Unit:
    """One unit written for a range holds for both ends."""
    if own.priced or not other.priced:
        return Unit(own.scale, own.currency or (other.currency if own.scale is not None else None), own.time or other.time)
    return Unit(other.scale, other.currency, own.time or other.time)


def _value(text: str, figures: list[re.Match], a: int, b: int, field: str, rates: dict[str, float]) -> tuple[float, Unit] | None:
    first = figures[0]
    if field == EXPERIENCE:
        total, unit = 0.0, NONE
        for k, m in enumerate(figures):
            end = figures[k + 1].start() if k + 1 < len(figures) else b
            u = segment(text[m.end() : end], field)
            if u.time is None and len(figures) > 1:
                return None
            months = figure(m.group())
            if unit.time is None:
                unit, total = Unit(time=u.time), months
                if HALF.search(text, m.end(), end):
                    total += 0.5
            else:  # "2 năm 6 tháng"
                if u.time not in rates or unit.time not in rates:
                    return None
                total += months * rates[u.time] / rates[unit.time]
        return total, unit
    x = figure(first.group())
    tail = text[first.end() : b]
    if len(figures) > 1:  # "12tr5", "13 triệu 500"
        join = text[first.end() : figures[1].start()]
        u = segment(join, field)
        if u.scale is None or u.currency or u.time:
            return x, u
        digits = figures[1].group()
        x += float(f"0.{digits}")
        tail = join.rstrip() + " " + text[figures[1].end() : figures[2].start() if len(figures) > 2 else b]
    unit = segment(tail.strip(), field)
    if unit.scale is not None and len(figures) == 1 and HALF.search(tail):
        x += 0.5
    lead = segment(text[a : first.start()].strip(), field)
    return x, Unit(unit.scale, unit.currency or lead.currency, unit.time)


SENTENCE = re.compile(r"[^.;!?\n]+")
CUES = {
    MONEY: re.compile(r"(?<!\w)(?:lương|thu nhập|trả công|tiền công|thù lao|thu nhập|salary|salaries|wage|wages|pay|income)(?!\w)"),
    EXPERIENCE: re.compile(r"(?<!\w)(?:kinh nghiệm|thâm niên|experience|seniority)(?!\w)"),
}
MEASURES = re.compile(r"(?<!\w)(?:tính|ghi|đơn vị|số|là|trả|figures?|in|given|counted|measured)(?!\w)")


@lru_cache(maxsize=200_000)
def _sentence_unit(sentence: str, field: str) -> Unit | None:
    if not CUES[field].search(sentence) or not MEASURES.search(sentence) or re.search(r"\d", sentence):
        return None
    unit = segment(sentence.strip(), field)
    if field == MONEY:
        return unit if unit.currency and unit.time else None
    rest = CUES[EXPERIENCE].sub(" ", sentence)
    return unit if unit.time and re.search(r"(?<!\w)(?:tính|ghi|đơn vị|counted|measured|given|in)(?!\w)", rest) else None


def told_unit(texts: tuple[str | None, ...], field: str) -> Unit | None:
    """The unit that a sentence of the texts says the field is given in."""
    for text in texts:
        if not text:
            continue
        low = unicodedata.normalize("NFC", text).lower()
        if not CUES[field].search(low):
            continue
        for s in SENTENCE.finditer(low):
            unit = _sentence_unit(s.group(), field)
            if unit is not None:
                return unit
    return None


class Converter:
    """Converts amounts with the rates; feeds maps feed to (pay unit, experience unit) as written."""

    def __init__(self, rates: dict[tuple[str, str], float], feeds: dict[str, tuple[str, str]]) -> None:
        self.money = {u: f for (q, u), f in rates.items() if q == "money"}
        self.period = {u: f for (q, u), f in rates.items() if q == "pay_period"}
        self.experience = {u: f for (q, u), f in rates.items() if q == "experience"}
        self._months = tuple(sorted(self.experience.items()))
        self.feeds = {f: (segment((a or "").lower(), MONEY), segment((b or "").lower(), EXPERIENCE)) for f, (a, b) in feeds.items()}

    def pay(self, x: float, unit: Unit) -> int | None:
        currency = self.money.get(unit.currency or "VND")
        period = self.period.get(unit.time or "month")
        if currency is None or period is None:
            return None
        return math.floor(x * (unit.scale or 1.0) * currency * period + 0.5 + 1e-9)

    def months(self, x: float, unit: Unit) -> int | None:
        factor = self.experience.get(unit.time or "")
        return None if factor is None else math.floor(x * factor + 0.5 + 1e-9)

    def convert(self, cell: str | None, field: str, feed: str | None, texts: tuple[str | None, ...]) -> tuple[int, int] | None:
        """(low, high) in the common unit, -1 for an open end; None if nothing is stated."""
        if not cell or not cell.strip():
            return None
        low_text = unicodedata.normalize("NFC", cell).lower().strip()
        if field == EXPERIENCE and NOT_ASKED.search(low_text):
            return 0, 0
        amount = read_amount(low_text, field, self._months)
        if amount is None:
            return None
        ends = [amount.low, amount.high]
        if field == MONEY and (amount.high or amount.low)[0] == 0:
            return None
        bare = [e is not None and not (e[1].priced if field == MONEY else e[1].time) for e in ends]
        other: Unit | None = None
        if any(bare):
            other = told_unit(texts, field)
            if other is None:
                other = self.feeds.get(feed or "", (None, None))[field == EXPERIENCE]
        if field == EXPERIENCE and ends[0] and ends[1]:  # "2 - 3 năm": the unit stands at one end
            written = ends[0][1].time or ends[1][1].time
            if written:
                ends = [(x, Unit(time=u.time or written)) for x, u in ends]
                bare = [False, False]
        out = []
        for end, empty in zip(ends, bare, strict=True):
            if end is None:
                out.append(-1)
                continue
            x, unit = end
            if empty:
                if other is None:
                    return None
                unit = Unit(other.scale, other.currency, unit.time or other.time) if field == MONEY else other
            value = self.pay(x, unit) if field == MONEY else self.months(x, unit)
            if value is None:
                return None
            out.append(value)
        return out[0], out[1]


MAX_RATES = 100_000


def small_rows(df: DataFrame, what: str) -> list:
    """Rows of a small reference table, refused beyond a documented bound."""
    rows = df.limit(MAX_RATES + 1).collect()
    if len(rows) > MAX_RATES:
        raise ValueError(f"{what} has more than {MAX_RATES} rows")
    return rows


def convert_amounts(df: DataFrame, key: str, feed: str, fields: dict[str, str], texts: tuple[str, ...], rates: DataFrame, feeds: DataFrame) -> DataFrame:
    """``(key, fieldname, low, high)``, a row for each amount stated.

    ``fields`` maps column to quantity ('money' or 'experience'); ``rates`` has
    quantity, unit, factor; ``feeds`` has feed, salary_unit, experience_unit.
    One pass over the rows, no shuffle.
    """
    rate = {(r["quantity"], r["unit"]): r["factor"] for r in small_rows(rates.select("quantity", "unit", "factor"), "rates")}
    by_feed = {r["feed"]: (r["salary_unit"], r["experience_unit"]) for r in small_rows(feeds.select("feed", "salary_unit", "experience_unit"), "feeds")}
    columns = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = Converter(rate, by_feed)
        for batch in batches:
            keys, names, lows, highs = [], [], [], []
            told = [batch[f"_t{i}"] for i in range(len(texts))]
            for row in zip(batch["_k"], batch["_f"], *[batch[f"_v{i}"] for i in range(len(columns))], *told, strict=True):
                k, f = row[0], row[1]
                said = row[2 + len(columns) :]
                for name, cell in zip(columns, row[2:], strict=False):
                    got = converter.convert(cell, fields[name], f, said)
                    if got:
                        keys.append(k)
                        names.append(name)
                        lows.append(got[0])
                        highs.append(got[1])
            yield pd.DataFrame({"_k": pd.Series(keys, dtype=batch["_k"].dtype), "fieldname": pd.Series(names, dtype=object), "low": np.asarray(lows, np.int64), "high": np.asarray(highs, np.int64)})

    rows = df.select(F.col(key).alias("_k"), F.col(feed).alias("_f"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)], *[F.col(c).alias(f"_t{i}") for i, c in enumerate(texts)])
    out = rows.mapInPandas(run, f"_k {df.schema[key].dataType.simpleString()}, fieldname string, low long, high long")
    return out.select(F.col("_k").alias(key), "fieldname", "low", "high")
