"""Text functions as column expressions. Only NFC needs Python: Spark has no
Unicode normalisation, so :func:`nfc` is one Arrow UDF, applied once, early."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Vietnamese syllables whose tone mark moves to the second vowel.
TONE_MOVES = (
    ("òa", "oà"), ("óa", "oá"), ("ỏa", "oả"), ("õa", "oã"), ("ọa", "oạ"),
    ("òe", "oè"), ("óe", "oé"), ("ỏe", "oẻ"), ("õe", "oẽ"), ("ọe", "oẹ"),
    ("ùy", "uỳ"), ("úy", "uý"), ("ủy", "uỷ"), ("ũy", "uỹ"), ("ụy", "uỵ"),
)


# What stands in Vietnamese answers as a figure, each shape in turn: citations,
# years, millions with a tail ("12tr5"), figures with or without a currency.
FIGURE = (
    r"\[#?\s*\d+(?:\s*,\s*#?\s*\d+)*\]|#\d+"
    r"|(?:năm|/)\s*(?:19|20)\d{2}(?![\p{L}\p{N}_])"
    r"|\d+\s*tr\s*\d+(?![\p{L}\p{N}_])"
    r"|\d+(?:[.,]\d+)*(?:\s*(?i:đồng|vnđ|vnd|đ)(?![\p{L}\p{N}_]))?"
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def nfc(x: Column | str) -> Column:
    return _nfc(col(x))


def spaces(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def norm(x: Column | str) -> Column:
    """NFC, lower case, single blanks."""
    return spaces(F.lower(nfc(x)))


def surface(x: Column | str) -> Column:
    """:func:`norm` without closing punctuation."""
    return F.regexp_replace(norm(x), r"[\s.,;:]+$", "")


def tone_new_style(x: Column | str) -> Column:
    """Lower-case NFC text with tone marks in the new position ("hòa" to "hoà")."""
    out = col(x)
    for old, new in TONE_MOVES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def place_key(x: Column | str) -> Column:
    return F.btrim(spaces(F.replace(tone_new_style(F.lower(col(x))), F.lit("-"), F.lit(" "))), F.lit(" ."))


def syllables(x: Column | str) -> Column:
    """Lower-case runs of letters, digits and '_', in order; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def once(x: Column, f) -> Column:
    """f(x) with ``x`` worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def with_pairs(w: Column) -> Column:
    """Words, then neighbouring pairs joined by '_'."""
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda a, b: F.concat_ws("_", a, b)))


def tokens(x: Column | str) -> Column:
    """Syllables, then neighbouring pairs joined by '_'."""
    return once(syllables(x), with_pairs)


def joined(*parts: Column | str, sep: str = ". ") -> Column:
    """Texts joined, null and blank ones skipped."""
    return F.concat_ws(sep, *[F.when(F.trim(col(p)) != "", col(p)) for p in parts])


def number_text(x: Column | str, percent: bool = False) -> Column:
    """One decimal with a decimal comma, none for whole numbers: 12,5 / 12 / 50,9%."""
    value = col(x).cast("double") * (100 if percent else 1)
    text = F.replace(F.regexp_replace(F.format_string("%.1f", F.bround(value, 1)), r"\.0$", ""), F.lit("."), F.lit(","))
    out = F.concat(text, F.lit("%")) if percent else text
    return F.when(value.isNotNull(), out)


def pretty(x: Column | str) -> Column:
    return F.replace(col(x), F.lit("_"), F.lit(" "))


def other_years(x: Column | str, own: int = 2025) -> Column:
    """Years 1900-2099 named in a text besides ``own``, ascending."""
    found = F.transform(F.regexp_extract_all(col(x), F.lit(r"(?<![\p{L}\p{N}_])((?:19|20)\d{2})(?![\p{L}\p{N}_])"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(F.lit(own))))


def numbers(x: Column | str) -> Column:
    """Figures of a Vietnamese sentence as doubles, in order. Citations ("[#12]",
    "#12") and years ("năm 2025", "/2025") are none; dots group thousands and
    commas are decimal; "12tr5" is 12.5; sums in đồng from 100,000 up are
    given in millions. One pattern finds the figures, then each is read by its
    first and last letters."""

    def value(m: Column) -> Column:
        short = F.contains(m, F.lit("tr"))
        digits = F.translate(m, " \t\n\r\u00a0đồngvĐỒNGVdD", "")
        pieces = F.split(digits, r"\.")
        grouped = (F.size(pieces) > 1) & F.forall(F.slice(pieces, 2, 1 << 10), lambda p: F.length(F.substring_index(p, ",", 1)) == 3) & (F.length(pieces[0]) <= 3)
        plain = F.when(short, F.concat_ws(".", F.transform(F.split(digits, "tr"), lambda p: F.trim(p)))).when(grouped | F.contains(digits, F.lit(",")), F.translate(digits, ",.", ".")).otherwise(digits)
        v = plain.try_cast("double")
        last = F.lower(F.substring(m, -1, 1))
        return F.when((v >= 100_000) & last.isin("g", "đ", "d"), v / 1_000_000).otherwise(v)

    counted = F.filter(F.regexp_extract_all(col(x), F.lit(FIGURE), F.lit(0)), lambda m: F.substring(m, 1, 1).between("0", "9"))
    return F.coalesce(F.filter(F.transform(counted, value), lambda v: v.isNotNull()), F.array().cast("array<double>"))


def close_to(x: Column, allowed: Column, absolute: float = 0.05, relative: float = 0.005) -> Column:
    """Whether a number is one of ``allowed``, within the larger tolerance."""
    return F.exists(allowed, lambda a: F.abs(x - a) <= F.greatest(F.lit(absolute), relative * F.abs(a)))


def unquote_path(path: str) -> str:
    """A path as git writes it: quoted, with octal bytes, when it has odd signs."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    out = bytearray()
    for part in re.finditer(r"\\([0-7]{3})|\\(.)|([^\\])", path[1:-1]):
        octal, sign, plain = part.groups()
        if octal:
            out.append(int(octal, 8))
        else:
            out += ({"n": "\n", "t": "\t"}.get(sign, sign) if sign else plain).encode()
    return out.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def unquoted(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unquote_path(x))
