"""Mapping freely typed values to a list of canonical entries.

Every entry goes into one trie by several paths: its name, its other names,
and spellings people use instead (joined words, swapped letters of one sound,
signs written out, initials that no other entry has). Which words and sounds
count so is a parameter, :class:`Spelling`. A typed value is cleaned into a few forms and
each form is run through the trie with a Levenshtein automaton - a bit-parallel
NFA that follows all edits up to the bound at once, a swap of neighbours
counting as one - so a lookup costs the part of the trie that is still within
the bound, not the number of entries. It returns *all* entries within a
distance that depends on the length; :meth:`Matcher.resolve` then picks one.

Forms are compared without tone marks and blanks, since both get lost most
often; the marks decide between entries equally near.

Defined cases: null and blank values have no entry (0); a value of any length
is looked at whole, but one longer than the longest path plus the bound can
match nothing and is not run; entries equally near in every respect give the
smaller id; an empty list maps everything to 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.packed import Splitter

VERSION = re.compile(r"\s+(?:v\.?\s?)?\d+(?:\.\d+)*\+?$")


@dataclass(frozen=True)
class Spelling:
    """How people write names: words before and after that say how well a skill is
    known, not which; letters written for one another; signs written out."""

    before: tuple[str, ...] = ("có kiến thức về", "có kiến thức", "hiểu biết về", "sử dụng tốt", "thành thạo", "kinh nghiệm", "kỹ năng", "nắm vững", "biết", "có khả năng", "am hiểu", "sử dụng")
    after: tuple[str, ...] = ("ở mức khá", "là lợi thế", "loại giỏi", "nâng cao", "cơ bản", "tốt", "ưu tiên", "bắt buộc", "khá", "giỏi")
    sounds: tuple[tuple[str, str], ...] = (("s", "x"), ("x", "s"), ("ch", "tr"), ("tr", "ch"), ("y", "i"), ("i", "y"), ("l", "n"), ("n", "l"), ("d", "gi"), ("gi", "d"), ("r", "d"), ("v", "d"))
    written: tuple[tuple[str, str], ...] = (("&", " and "), ("&", " n "), ("&", " và "), ("+", " plus "), ("#", " sharp "), (" và ", " với "), (" và ", " & "), ("/", " "), (" - ", " "), (".", " dot "), (".", ""))
    shortest_initials: int = 3


# What a path of the trie is.
NAME, SOUND, INITIALS = 0, 1, 2
TELEX_TONES = {"s": "́", "f": "̀", "r": "̉", "x": "̃", "j": "̣"}
TELEX_LETTERS = (("dd", "đ"), ("aa", "â"), ("ee", "ê"), ("oo", "ô"), ("aw", "ă"), ("ow", "ơ"), ("uw", "ư"))
VOWELS = "aăâeêioôơuưy"


def tidy(text: str) -> str:
    """NFC, lower case, single blanks."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text).lower()).strip()


class _Unmarked(dict):
    """Letter to letter without marks, found out once per letter."""

    def __missing__(self, code: int) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        self[code] = bare = "d" if bare == "đ" else bare
        return bare


_UNMARKED = _Unmarked()


def plain(text: str) -> str:
    """Without tone marks and letter marks."""
    return text if text.isascii() else text.translate(_UNMARKED)


def squeezed(text: str) -> str:
    """Without blanks and the signs typed for them."""
    return re.sub(r"[^\w+#&]|_", "", text)


def from_telex(text: str) -> str | None:
    """The text with Telex keystrokes carried out, or None if it has none."""
    words, changed = text.split(" "), False
    for k, word in enumerate(words):
        if not re.fullmatch(r"[a-zđăâêôơưàáảãạèéẻẽẹìíỉĩịòóỏõọùúủũụỳýỷỹỵ]+", word):
            continue
        new, tone = word, ""
        for a, b in TELEX_LETTERS:
            new = new.replace(a, b)
        if new and new[-1] in TELEX_TONES and len(new) > 1 and any(c in VOWELS for c in new[:-1]) and plain(new) == new.replace("đ", "d").replace("â", "a").replace("ê", "e").replace("ô", "o").replace("ă", "a").replace("ơ", "o").replace("ư", "u"):
            tone, new = TELEX_TONES[new[-1]], new[:-1]
        if tone:
            at = [i for i, c in enumerate(new) if c in VOWELS]
            marked = [i for i in at if new[i] in "ăâêôơư"]
            spot = marked[-1] if marked else (at[-1] if at[-1] < len(new) - 1 else at[max(0, len(at) - 2)])
            new = unicodedata.normalize("NFC", new[: spot + 1] + tone + new[spot + 1 :])
        if new != word:
            words[k], changed = new, True
    return " ".join(words) if changed else None


def bound(length: int) -> int:
    """Edits allowed for a form of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 12 else 3


def distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Edits between two strings, a swap of neighbours counting as one."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return row[-1]


class Trie:
    """Paths of letters to payloads, searched with a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.longest = 0
        self.frozen: tuple | None = None

    def add(self, path: str, payload: object) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(payload)
        self.longest = max(self.longest, len(path))
        self.frozen = None

    def exact(self, text: str) -> list:
        node = self.root
        for c in text:
            node = node.get(c)
            if node is None:
                return []
        return node.get("", [])

    def _freeze(self, node: dict, depth: int) -> tuple:
        """(payloads, children, shortest and longest path through the node)."""
        ends = tuple(node.get("", ()))
        low, high = (depth, depth) if ends else (1 << 30, 0)
        children = []
        for c, child in node.items():
            if c:
                below = self._freeze(child, depth + 1)
                children.append((c, below, below[2], below[3]))
                low, high = min(low, below[2]), max(high, below[3])
        return ends, tuple(children), low, high

    def within(self, text: str, k: int) -> list[tuple[int, object]]:
        """(distance, payload) of every path within ``k`` edits of ``text``.
        Bit i of state d says that the first i letters are reached with at most d
        edits; paths too short or too long for the text are not entered."""
        if k == 0:
            return [(0, p) for p in self.exact(text)]
        m = len(text)
        if m > self.longest + k:
            return []
        if self.frozen is None:
            self.frozen = self._freeze(self.root, 0)
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << (i + 1)
        final, every = 1 << m, (1 << (m + 1)) - 1
        short, long = m - k, m + k
        found: list[tuple[int, object]] = []
        levels = range(1, k + 1)
        # the last two states: a swap goes from the one before last
        stack = [(self.frozen, [(1 << (d + 1)) - 1 for d in range(k + 1)], [0] * (k + 1), 0)]
        while stack:
            (ends, children, _, _), now, last, last_mask = stack.pop()
            if ends:
                for d, bits in enumerate(now):
                    if bits & final:
                        found += [(d, p) for p in ends]
                        break
            for c, child, low, high in children:
                if high < short or low > long:
                    continue
                mask = masks.get(c, 0)
                swap = (mask << 1) & last_mask
                before = (now[0] << 1) & mask
                new = [before]
                for d in levels:
                    less = now[d - 1]
                    before = (((now[d] << 1) & mask) | less | ((less | before) << 1) | ((last[d - 1] << 2) & swap)) & every
                    new.append(before)
                if before:
                    stack.append((child, new, now, mask))
        return found


class Matcher:
    """The entries of a list, ready for lookups; rows are (id, name, other names)."""

    def __init__(self, rows: list[tuple[int, str, list[str] | None]], spelling: Spelling = Spelling()) -> None:
        self.trie = Trie()
        self.spelling = spelling
        self.first = tuple(plain(w) + " " for w in spelling.before)
        self.last = tuple(" " + plain(w) for w in spelling.after)
        self.names: dict[int, list[str]] = {}
        self.splitter = Splitter([n for _, n, _ in rows])
        exact: dict[str, int] = {}
        for key, name, others in rows:
            spelled = [tidy(x) for x in [name, *(others or [])] if x and x.strip()]
            self.names[key] = spelled
            for s in spelled:
                exact.setdefault(squeezed(plain(s)), key)
        self.cache: dict[tuple[str, str], int] = {}
        self.seen: dict[str, tuple[int, float]] = {}
        initials: dict[str, set[int]] = {}
        for key, spelled in self.names.items():
            for s in spelled:
                paths = {squeezed(plain(s))}
                for a, b in spelling.written:
                    if a in s:
                        paths.add(squeezed(plain(s.replace(a, b))))
                if s.endswith("ing"):
                    paths.add(squeezed(plain(s[:-3])))
                for p in paths:
                    if p:
                        self.trie.add(p, (key, s, NAME))
                for a, b in spelling.sounds:  # one sound written for another costs half an edit
                    p = squeezed(plain(s)).replace(a, b)
                    if p not in paths and exact.get(p, key) == key and len(p) > 3:
                        self.trie.add(p, (key, s, SOUND))
            for s in spelled[:1]:
                words = re.findall(r"\w+", plain(s.replace("+", " plus ").replace("#", " sharp ")))
                if len(words) >= spelling.shortest_initials:
                    initials.setdefault("".join(w[0] for w in words), set()).add(key)
        for p, keys in initials.items():
            if len(keys) == 1:
                key = next(iter(keys))
                self.trie.add(p, (key, self.names[key][0], INITIALS))

    def forms(self, value: str) -> list[str]:
        """The value as typed, then without words of level and version."""
        text = tidy(value)
        text = re.sub(r"\s*\([^()]*\)\s*$", "", text).strip(" .,;:'\"")
        out = [text]
        while True:
            before = text
            text = VERSION.sub("", text)
            low = plain(text)
            if low.startswith(self.first):
                p = next(w for w in self.first if low.startswith(w))
                text = text[len(p) :].strip()
            elif low.endswith(self.last):
                p = next(w for w in self.last if low.endswith(w))
                text = text[: -len(p)].strip()
            if text == before or not text:
                break
            out.append(text)
        return [x for x in dict.fromkeys(out) if x]

    def _typed(self, value: str) -> list[str]:
        """The forms, and each with Telex keystrokes carried out."""
        out = []
        for form in self.forms(value):
            keyed = from_telex(form)
            out += [form, keyed] if keyed else [form]
        return out

    def candidates(self, value: str, typed: list[str] | None = None) -> list[tuple[float, float, int]]:
        """(distance, tie distance, id) of all entries within the bound of any
        form, nearest first, one row an entry. Initials count only letter for letter."""
        best: dict[int, tuple[float, float]] = {}
        for t in typed or self._typed(value):
            p = squeezed(plain(t))
            for d, (key, spelled, kind) in self.trie.within(p, bound(len(p))):
                if kind == INITIALS:
                    if d == 0 and p == t:
                        best[key] = min((0.0, 0.0), best.get(key, (1e9, 0.0)))
                    continue
                far = d + 0.5 * (kind == SOUND)
                if far <= best.get(key, (1e9, 0))[0]:
                    cost = (far, distance(squeezed(t), squeezed(spelled)) + 0.01 * distance(t, spelled))
                    best[key] = min(cost, best.get(key, (1e9, 0)))
        return sorted((d, tie, key) for key, (d, tie) in best.items())

    def _lookup(self, value: str) -> tuple[int, float]:
        """(id, distance) of the nearest entry, kept for values seen again in another cell."""
        if value not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[value] = self._nearest(value)
        return self.seen[value]

    def _nearest(self, value: str) -> tuple[int, float]:
        typed = self._typed(value)
        for wanted in (NAME, INITIALS):  # spelled right but for marks and blanks: nothing can be nearer
            for t in typed:
                p = squeezed(plain(t))
                hits = {key for key, _, kind in self.trie.exact(p) if kind == wanted and (wanted == NAME or p == t)}
                if len(hits) == 1:
                    return next(iter(hits)), 0.0
        got = self.candidates(value, typed)
        return (got[0][2], got[0][0]) if got else (0, 1e9)

    def resolve(self, value: str | None, context: str | None = None) -> int:
        """The entry meant by a value, or 0. ``context`` is the cell it was
        taken from: where the value is cut short, the cell's own value is used."""
        if value is None or not value.strip():
            return 0
        key = (value, context or "")
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[key] = self._resolve(value, context)
        return self.cache[key]

    def _resolve(self, value: str, context: str | None) -> int:
        own, far = self._lookup(value)
        if own and far == 0:
            return own
        if context:
            mine = squeezed(plain(self.forms(value)[-1])) if self.forms(value) else ""
            for part in self.splitter.split(context):
                for form in self.forms(part):
                    whole = squeezed(plain(form))
                    if mine and whole != mine and whole.startswith(mine):
                        longer, d = self._lookup(form)
                        if longer:
                            return longer
        return own


def load(entries: DataFrame, key: str, name: str, others: str, most: int = 100_000) -> list[tuple[int, str, list[str] | None]]:
    """The reference list, refused beyond ``most`` entries: every task holds the trie."""
    rows = entries.where(F.col(name).isNotNull()).select(key, name, others).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    return [(r[0], r[1], r[2]) for r in rows]


def map_values(df: DataFrame, key: str, value: str, context: str, entries: list[tuple[int, str, list[str] | None]], spelling: Spelling = Spelling()) -> DataFrame:
    """``(key, value, id)`` for every row with a value: the entry it means, or 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(entries, spelling)
        for batch in batches:
            ids = [matcher.resolve(v, c) for v, c in zip(batch["_v"], batch["_c"], strict=True)]
            yield pd.DataFrame({"_k": batch["_k"], "_v": batch["_v"], "id": np.asarray(ids, np.int64)})

    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(context).alias("_c"))
    return rows.mapInPandas(run, f"_k {df.schema[key].dataType.simpleString()}, _v string, id long").select(F.col("_k").alias(key), F.col("_v").alias(value), "id")


def near_entries(df: DataFrame, value: str, entries: list[tuple[int, str, list[str] | None]], spelling: Spelling = Spelling()) -> DataFrame:
    """``(value, id, distance, rank)``: of every different value all entries within
    the bound of its length, nearest first; a value near none gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(entries, spelling)
        for batch in batches:
            rows = [(v, key, d, i) for v in batch["_v"] for i, (d, _, key) in enumerate(matcher.candidates(v) if v.strip() else [], 1)]
            yield pd.DataFrame(rows, columns=["_v", "id", "distance", "rank"])

    values = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v")).distinct()
    return values.mapInPandas(run, "_v string, id long, distance double, rank int").withColumnRenamed("_v", value)
