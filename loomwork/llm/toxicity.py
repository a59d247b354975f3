"""Scores for abusive, hateful or sexual content by a factorization machine.

Texts are cut into sentences and undisguised - invisible signs, letters spelled
apart, digits and masks for letters, stretched letters. What is scored is the
set of hashed words of a sentence, and of each two neighbouring sentences, so
that an insult and the group it is meant for may stand in two of them:

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

There are no terms of several words: what only two words together tell (an
insult with a group, a body part with an offer) can be learned as a product of
factors alone, and a word that is harmless in a rule or a report stays harmless
there. A document's score is that of its worst sentence or pair.

The model is trained from reviewers' marks, on at most ``MARKED`` marked
documents chosen by hash; every document is scored, whole. Marks name
documents, not sentences: a marked document's worst sentence stands for it and
is chosen anew in every round. Held-out models, fitted in parallel tasks, score
each mark without having seen it: marks they strongly contradict are taken as
mistakes and left out, and the threshold is the one that does best on those
scores. Masked words are resolved by words and neighbours counted over all
documents.

Defined cases: null and blank texts score 0; a text of any length is read
whole; ties between raters count as marked; with no marks of either kind the
model says 0 throughout.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKED = 20_000
DOUBTED = 0.1
FOLDS = 5  # at every size: held-out models see 80 % of the marks
MOST_WEIGHT = 8.0
LEAST_UPDATES = 60  # of one fitting, however few samples there are
BITS = 17
FACTORS = 8
REMEMBERED = 200_000  # sentences a task keeps the score of

INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤﻿­]")
APART = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[.\-_·|]+[^\W\d_])+(?![^\W\d_])|(?<![^\W\d_])[^\W\d_](?:\*[^\W\d_]){2,}\*?(?![^\W\d_*])")
SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_])+(?!\S|\w)")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
DIGITS = str.maketrans("0134578@$9", "oieastbasg")  # digits written for letters
# What stands behind a figure as a measure.
MEASURES = frozenset("k tr km m kg th h p cm s đ x st nd rd g pm am t usd vnd y yr yrs mm gb mb w v d l ml ha tỷ triệu".split())
LETTER = re.compile(r"[^\W\d_]")
FIGURES = re.compile(r"[0-9@$]")
JOINS = re.compile(r"[.\-_·|*]")
MIXED = re.compile(r"[\w@$*]*[0-9@$][\w@$*]*")
SENTENCE = re.compile(r"[.!?\n;…]+(?=\s|$)|\n+|[^\w\s.,!?;:'\"()*%/&+\-–—…\[\]]+")
WORD = re.compile(r"[^\W_]+(?:\*+[^\W_]*)*|\*+[^\W_]+")


class _Plain(dict):
    """Letter to letter without marks, found out once per letter."""

    def __missing__(self, code: int) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code).replace("đ", "d")) if not unicodedata.combining(c))
        self[code] = bare
        return bare


_PLAIN = _Plain()
_HASHES: dict[str, int] = {}


def plain(text: str) -> str:
    return text if text.isascii() else text.translate(_PLAIN)


def _unleet(match: re.Match) -> str:
    word = match.group()
    if word.isdigit() or not LETTER.search(word):
        return word
    if sum(c.isdigit() for c in word) > 4 or word.lstrip("0123456789") in MEASURES:
        return word
    return word.translate(DIGITS)


def undisguise(text: str) -> str:
    """Lower-case NFC text with letters put together again."""
    t = INVISIBLE.sub("", unicodedata.normalize("NFC", text)).lower()
    if JOINS.search(t):
        t = APART.sub(lambda m: re.sub(r"[.\-_·|*]+", "", m.group()), t)
    t = SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    t = STRETCHED.sub(r"\1", t)
    return MIXED.sub(_unleet, t) if FIGURES.search(t) else t


def words_of(sentence: str) -> list[str]:
    """The words of a sentence as it stands in the text, without marks; '*' stands for masked letters."""
    return WORD.findall(plain(undisguise(sentence)))


def parts(text: str | None) -> list[str]:
    """The sentences of a text as they stand there."""
    return [p for p in SENTENCE.split(text) if p.strip()] if text else []


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence that has any."""
    return [w for w in map(words_of, parts(text)) if w]


class Unmask:
    """Guesses masked words from frequency and neighbours: ``single`` counts
    words that fit a masked one, ``pairs`` neighbours of which one does."""

    def __init__(self, single: dict[str, int], pairs: dict[tuple[str, str], int]) -> None:
        self.single, self.pairs = single, pairs
        self.fits: dict[str, list[str]] = defaultdict(list)
        for w in single:
            for i in range(len(w)):
                self.fits[w[:i] + "*" + w[i + 1 :]].append(w)

    def __call__(self, words: list[str]) -> list[str]:
        if not any("*" in w for w in words):
            return words
        out = list(words)
        for i, w in enumerate(words):
            if "*" not in w:
                continue
            fits = self.fits.get(w, [])
            joined = w.replace("*", "")
            if joined in self.single:
                fits = [*fits, joined]
            if fits:
                left = out[i - 1] if i else ""
                right = words[i + 1] if i + 1 < len(words) else ""
                out[i] = max(fits, key=lambda x: (50 * self.pairs.get((left, x), 0) + 50 * self.pairs.get((x, right), 0) + self.single[x] ** 0.5, x))
            else:
                out[i] = joined or w
        return out


def counted(texts: list[list[str]], least: int = 2) -> Unmask:
    """:class:`Unmask` from all words and neighbours of a few texts."""
    clear = [[w if "*" not in w else "" for w in words] for words in texts]
    single = Counter(w for ws in clear for w in ws if w and len(w) < 16 and not w.isdigit())
    pairs = Counter((a, b) for ws in clear for a, b in zip(ws, ws[1:], strict=False) if a and b)
    return Unmask({w: n for w, n in single.items() if n >= least}, {p: n for p, n in pairs.items() if n >= least})


def terms(words: list[str]) -> np.ndarray:
    """Distinct hashed words of a sentence; all numbers are one word."""
    out = set()
    for w in words:
        h = _HASHES.get(w)
        if h is None:
            if len(_HASHES) > 500_000:
                _HASHES.clear()
            h = _HASHES[w] = zlib.crc32(b"0" if w.isdigit() else w.encode()) & ((1 << BITS) - 1)
        out.add(h)
    return np.array(sorted(out), np.int64)


def bag(text: str | None, unmask: Unmask) -> list[np.ndarray]:
    """The terms of each sentence, then of each two neighbouring ones."""
    one = [terms(unmask(w)) for w in sentences(text)]
    return one + [np.union1d(a, b) for a, b in zip(one, one[1:], strict=False)]


@dataclass
class Machine:
    """A trained factorization machine."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    threshold: float = 0.5

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One per sentence; ``ids`` are the sentences' terms one after another."""
        if not len(starts):
            return np.zeros(0, np.float32)
        size = np.diff(np.r_[starts, len(ids)])
        x = 1 / np.sqrt(size)
        v = self.v[ids]
        total = np.add.reduceat(v, starts, axis=0)
        square = np.add.reduceat(v * v, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[ids], starts) * x + 0.5 * ((total * total - square).sum(axis=1)) * x * x


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.int64)), np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)


def fit(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 1e-4, seed: int = 7, batch: int = 1024) -> Machine:
    """Logistic loss, Adagrad in one process."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(1 << BITS, np.float32), rng.normal(0, 0.05, (1 << BITS, FACTORS)).astype(np.float32))
    gw, gv, g0 = np.full(1 << BITS, 1e-2, np.float32), np.full((1 << BITS, FACTORS), 1e-2, np.float32), 1e-2
    every, start = _flat(sets)
    every = every.astype(np.int32)
    length = np.diff(np.r_[start, len(every)])
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    updates = -(-len(sets) // batch)
    for _ in range(max(epochs, -(-LEAST_UPDATES // max(1, updates)))):
        order = rng.permutation(len(sets))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            size = length[some]
            starts = np.r_[0, np.cumsum(size)[:-1]]
            ids = every[np.repeat(start[some] - starts, size) + np.arange(size.sum())]
            x = (1 / np.sqrt(size)).astype(np.float32)
            row = np.repeat(np.arange(len(some)), size)
            v = m.v[ids]
            total = np.add.reduceat(v, starts, axis=0)
            square = np.add.reduceat(v * v, starts, axis=0)
            z = m.w0 + np.add.reduceat(m.w[ids], starts) * x + 0.5 * (total * total - square).sum(axis=1) * x * x
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some]
            sort = np.argsort(ids)
            ordered = ids[sort]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            unique, row = ordered[first], row[sort]
            dw = np.add.reduceat((off * x)[row], first) + decay * m.w[unique]
            dv = np.add.reduceat((off * x * x)[row][:, None] * (total[row] - v[sort]), first, axis=0) + decay * m.v[unique]
            gw[unique] += dw * dw
            gv[unique] += dv * dv
            g0 += float(off.sum()) ** 2
            m.w[unique] -= rate * dw / np.sqrt(gw[unique])
            m.v[unique] -= rate * dv / np.sqrt(gv[unique])
            m.w0 -= rate * float(off.sum()) / g0**0.5
    return m


def _bag_scores(m: Machine, bags: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The worst sentence's logit of each document, and which sentence it is."""
    flat = [s for b in bags for s in b]
    z = m.logits(*_flat(flat)) if flat else np.zeros(0)
    best, which, at = np.full(len(bags), -20.0), np.zeros(len(bags), np.int64), 0
    for i, b in enumerate(bags):
        if b:
            k = int(z[at : at + len(b)].argmax())
            best[i], which[i] = z[at + k], k
            at += len(b)
    return best, which


def _first_guess(bags: list[list[np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Which sentence of each document has the terms most typical of marked documents."""
    n = np.zeros((2, 1 << BITS))
    for b, c in zip(bags, y, strict=True):
        if b:
            n[int(c), np.unique(np.concatenate(b))] += 1
    many = np.maximum(np.array([(y == 0).sum(), (y == 1).sum()], float), 1)
    odds = np.log((n[1] + 0.5) / (many[1] + 1)) - np.log((n[0] + 0.5) / (many[0] + 1))
    odds *= n.sum(axis=0) >= 2
    which = np.zeros(len(bags), np.int64)
    for i, b in enumerate(bags):
        if b:
            which[i] = int(np.argmax([np.sort(odds[s])[-6:].sum() for s in b]))
    return which


def _step(bags: list[list[np.ndarray]], y: np.ndarray, some: np.ndarray, which: np.ndarray, epochs: int) -> Machine:
    """The model of one round from ``some`` of the marked documents. Units alike
    are one sample of more weight, up to a cap."""
    sample: dict[tuple[bytes, float], float] = defaultdict(float)
    for i, worst in zip(some, which, strict=True):
        units = bags[i]
        if not y[i]:
            for u in units:
                sample[u.tobytes(), 0.0] += 1.0
        elif units:
            sample[units[worst].tobytes(), 1.0] += 2.0
    total: dict[bytes, float] = defaultdict(float)
    for (key, _), n in sample.items():
        total[key] += n
    weights = np.array([n * min(1.0, MOST_WEIGHT / total[key]) for (key, _), n in sample.items()], np.float32)
    return fit([np.frombuffer(key, np.int64) for key, _ in sample], np.array([c for _, c in sample], np.float32), weights, epochs=epochs, batch=512)


def _train(bags: list[list[np.ndarray]], y: np.ndarray, shares: list[np.ndarray], steps: Callable[[list[tuple]], list[Machine]], rounds: int = 3) -> list[Machine]:
    """The model of each of the ``shares`` of the marked documents."""
    which = [_first_guess([bags[i] for i in some], y[some]) for some in shares]
    models: list[Machine] = []
    for r in range(rounds):
        models = steps([(some, w, 3 if r < rounds - 1 else 6) for some, w in zip(shares, which, strict=True)])
        which = [_bag_scores(m, [bags[i] for i in some])[1] for m, some in zip(models, shares, strict=True)]
    return models


def best_threshold(p: np.ndarray, y: np.ndarray, near: float = 0.005) -> float:
    """The lowest threshold whose F1 is within ``near`` of the highest: where F1
    hardly differs, a case missed counts more than one to look at."""
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(np.flatnonzero(f1 >= f1.max() - near)[-1])
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + low) / 2)


def _learn(bags: list[list[np.ndarray]], y: np.ndarray, steps: Callable[[list[tuple]], list[Machine]]) -> Machine:
    """``steps`` runs :func:`_step` for each of several argument lists."""
    fold = np.arange(len(y)) % FOLDS
    out = np.zeros(len(y))
    held = [h for h in range(FOLDS) if len(set(y[fold != h])) == 2]
    for h, m in zip(held, _train(bags, y, [np.flatnonzero(fold != h) for h in held], steps, rounds=2), strict=True):
        b = np.flatnonzero(fold == h)
        out[b] = _bag_scores(m, [bags[i] for i in b])[0]
    p = 1 / (1 + np.exp(-out))
    keep = np.flatnonzero(~((y == 1) & (p < DOUBTED)) & ~((y == 0) & (p > 1 - DOUBTED)))
    if y[keep].sum() < 2:
        keep = np.arange(len(y))
    m = _train(bags, y, [keep], steps)[0]
    m.threshold = best_threshold(p[keep], y[keep])
    return m


def _enough(y: np.ndarray) -> bool:
    return y.sum() >= 2 and (1 - y).sum() >= 2


def _nothing() -> Machine:
    return Machine(-20.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))


def learn(texts: list[str | None], marked: np.ndarray) -> tuple[Machine, Unmask]:
    """The model, from texts and whether each is marked as a case."""
    y = np.asarray(marked, np.int64)
    unmask = counted([s for t in texts for s in sentences(t)])
    if not _enough(y):
        return _nothing(), unmask
    bags = [bag(t, unmask) for t in texts]
    return _learn(bags, y, lambda steps: [_step(bags, y, *s) for s in steps]), unmask


def marks(labels: DataFrame, key: str, label: str, clear: str = "none") -> DataFrame:
    """``(key, marked)``: whether at least half of a document's marks name it a case; null marks don't count."""
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key)
    return votes.agg((F.avg(F.when(F.col(label) == clear, 0.0).otherwise(1.0)) >= 0.5).alias("marked"))


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each masked word with what stands before and after it."""
    for b in batches:
        seen = {(w, words[i - 1].replace("*", "") if i else "", words[i + 1].replace("*", "") if i + 1 < len(words) else "") for t in b["_t"] for words in sentences(t) for i, w in enumerate(words) if "*" in w}
        yield pd.DataFrame(sorted(seen), columns=["m", "l", "r"])


class Fitting:
    """Counts words that fit one of the masked words, and their neighbours next to these."""

    def __init__(self, masks: Iterable[tuple[str, str, str]]) -> None:
        masks = list(masks)
        self.shapes = {m for m, _, _ in masks} | {m.replace("*", "") for m, _, _ in masks}
        self.before, self.after = {x for _, x, _ in masks}, {x for _, _, x in masks}
        self.known: dict[str, bool] = {}
        self.counts: Counter = Counter()

    def fits(self, word: str) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = len(word) < 16 and "*" not in word and not word.isdigit() and (word in self.shapes or any(word[:i] + "*" + word[i + 1 :] in self.shapes for i in range(len(word))))
            self.known[word] = got
        return got

    def add(self, words: list[str], times: int) -> None:
        for i, w in enumerate(words):
            if self.fits(w):
                self.counts["", w] += times
                if i and (words[i - 1] in self.before or self.fits(words[i - 1])):
                    self.counts[words[i - 1], w] += times
                if i + 1 < len(words) and words[i + 1] in self.after and not self.fits(words[i + 1]):  # else counted from there
                    self.counts[w, words[i + 1]] += times


def corpus_unmask(documents: DataFrame, text: str, least: int = 2) -> Unmask:
    """:class:`Unmask` from words and neighbours of all ``documents``, in one pass
    over them and one over those with a mask. Sentences repeated in a task are
    read once. What reaches the driver is the masked words with their neighbours
    and what fits them, not the vocabulary."""
    rows = documents.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    masks = [tuple(r) for r in rows.where(F.contains("_t", F.lit("*"))).mapInPandas(_masked, "m string, l string, r string").distinct().collect()]
    if not masks:
        return Unmask({}, {})
    shared = documents.sparkSession.sparkContext.broadcast(masks)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitting, said = Fitting(shared.value), Counter()

        def read() -> None:
            for sentence, n in said.items():
                fitting.add(words_of(sentence), n)
            said.clear()

        for batch in batches:
            for t in batch["_t"]:
                said.update(parts(t))
                if len(said) > REMEMBERED:
                    read()
        read()
        yield pd.DataFrame([(a, b, n) for (a, b), n in fitting.counts.items()], columns=["a", "b", "n"])

    counts = rows.mapInPandas(tally, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("a", "b").collect()
    return Unmask({r["b"]: r["n"] for r in counts if not r["a"]}, {(r["a"], r["b"]): r["n"] for r in counts if r["a"]})


def train(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MARKED) -> tuple[Machine, Unmask]:
    """The model from at most ``most`` marked documents, chosen by hash."""
    mark = marks(labels, key, label)
    chosen = mark.orderBy(F.xxhash64(key), key).limit(most)
    rows = documents.select(key, text).join(F.broadcast(chosen), key).select(key, text, "marked").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[key]).encode()), r[key], r[text] or ""))
    y = np.array([r["marked"] for r in rows], np.int64)
    if not _enough(y):
        return _nothing(), Unmask({}, {})
    unmask = corpus_unmask(documents, text)
    bags = [bag(r[text], unmask) for r in rows]
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast((bags, y))

    def steps(each: list[tuple]) -> list[Machine]:
        return sc.parallelize(each, len(each)).map(lambda s: _step(*shared.value, *s)).collect()

    return _learn(bags, y, steps), unmask


class Scorer:
    """Scores of texts; sentences seen before in the task are not read again."""

    def __init__(self, machine: Machine, unmask: Unmask) -> None:
        self.machine, self.unmask = machine, unmask
        self.known: dict[str, np.ndarray] = {}

    def terms(self, sentence: str) -> np.ndarray:
        got = self.known.get(sentence)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            words = words_of(sentence)
            got = self.known[sentence] = terms(self.unmask(words) if "*" in sentence else words)
        return got

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The worst unit of each text, 0 to 1."""
        sets, owner = [], []
        for i, t in enumerate(texts):
            for p in parts(t):
                s = self.terms(p)
                if len(s):
                    sets.append(s)
                    owner.append(i)
        best = np.full(len(texts), -30.0)
        if sets:
            at = np.array(owner)
            ids, starts = _flat(sets)
            np.maximum.at(best, at, self.machine.logits(ids, starts))
            two = np.flatnonzero(at[1:] == at[:-1])
            if len(two):  # neighbours: both sets' terms, each once
                size = np.diff(np.r_[starts, len(ids)])
                both = size[two] + size[two + 1]
                inside = np.repeat(starts[two] - np.r_[0, np.cumsum(both)[:-1]], both) + np.arange(both.sum())
                code = np.sort(np.repeat(np.arange(len(two)) << BITS, both) | ids[inside])
                code = code[np.r_[True, code[1:] != code[:-1]]]
                first = np.searchsorted(code, np.arange(len(two)) << BITS)
                np.maximum.at(best, at[two], self.machine.logits(code & ((1 << BITS) - 1), first))
        return np.where(best > -30.0, 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)


def score(documents: DataFrame, key: str, text: str, model: tuple[Machine, Unmask], keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, score)`` of every document, 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            texts = batch["_t"].tolist()
            # a few documents at once, so that very long ones don't add up
            got = [scorer(texts[i : i + 256]) for i in range(0, len(texts), 256)]
            yield batch.drop(columns="_t").assign(score=np.round(np.concatenate(got), 6) if got else np.zeros(0))

    rows = documents.select(F.col(key), *keep, F.col(text).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_t")
    return rows.mapInPandas(run, f"{schema}, score double")
