"""Drawing documents so that every source gives its share of all tokens.

1. *Classifier*: naive Bayes over hashed words, one table of counts per source
   and fold, counted over all documents of the listed sources. Each document is
   judged by the tables of the other folds only, so it never votes for itself.
   How often texts stored under one source read like another's is counted with
   it, and a document's memberships are what its text says times how often its
   stored source holds such texts; but for a few documents' worth (``TRUST``)
   nothing is assumed about how right stored sources are. Memberships are kept in steps of 1/``STEPS``; documents of the
   same source and memberships share a rate and are one row from here on.
2. *Rates*: how often documents are used, from a flat rate to begin with,
   between 0 and the source's cap, so that the expected tokens of every domain
   meet its target: least squares by projected gradient. A step is one pass
   over the distinct memberships that sums a number per domain; rates are
   replayed from the steps, so no state is kept. It runs until the totals are
   met or no step lowers the squares any more.
3. *Whole repeats*: floor(rate + shift + u), u being the document's hash in
   0..1 and the shift one number per source in -1..1 that makes the source's
   whole repeats hold as many tokens as its rates ask for.

The total is the largest at which all shares can be met under the caps, unless
given. A listed source that has no tokens or no repeats allowed cannot give
its share: the others keep their proportions and it is reported with 0.

Defined cases: documents of no source or of an unlisted one are drawn only
with ``sourceless``, then by their memberships alone and at most as often as
their strongest domain allows; empty texts are never drawn; null ids are kept;
no documents give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.tokens import TOKENIZER, encoding
from loomwork.session import cut

BUCKETS = 1 << 13
FOLDS = 4
STEPS = 256
EFFECTIVE_WORDS = 20.0  # words of one text depend on each other: a longer text counts as so many
DOUBT = 0.003  # what any text may belong to any domain
TRUST = 20.0  # documents by which a stored source is believed before any is counted
BINS = 1 << 13
MAX_SOURCES = 256
MAX_STEPS = 1000
WORD = re.compile(r"[^\W_]+")


class Buckets(dict):
    """Word to bucket, hashed once per task; forgotten when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = zlib.crc32(word.encode()) & (BUCKETS - 1)
        return b


def word_buckets(text: str | None, known: Buckets | None = None) -> list[int]:
    """The hashed distinct words of a text."""
    if not text:
        return []
    known = Buckets() if known is None else known
    return [known[w] for w in set(WORD.findall(unicodedata.normalize("NFC", text).lower()))]


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column one after another, and where each list begins and ends."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def measured(documents: DataFrame, key: str, text: str, source: str, sources: list[str], path: str, pattern: str | None, sourceless: bool) -> DataFrame:
    """``(_id, _k, _n, _b)``: place of the source (-1: none listed), tokens and word
    buckets of every document that can be drawn; each text is read once."""
    place = {s: i for i, s in enumerate(sources)}
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoding(path, pattern).encode_ordinary, Buckets()
        for batch in batches:
            texts = batch.column("_t").to_pylist()
            words = [word_buckets(t, known) for t in texts]
            k = [place.get(s, -1) for s in batch.column("_s").to_pylist()]
            n = [len(encode(t)) if t else 0 for t in texts]
            sets = lists(np.array([b for w in words for b in w], np.int16), np.cumsum([len(w) for w in words], dtype=np.int64), pa.int16())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(k, pa.int32()), pa.array(n, pa.int64()), sets], ["_id", "_k", "_n", "_b"])

    drawn = F.lit(True) if sourceless else F.col(source).isin(sources)
    rows = documents.where(drawn).select(F.col(key).alias("_id"), F.col(source).cast("string").alias("_s"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, f"_id {kind}, _k int, _n long, _b array<smallint>").where(F.col("_n") > 0)


def word_tables(docs: DataFrame, width: int) -> np.ndarray:
    """Documents with each word by (fold, source, bucket), summed per task and
    then over tasks; what the driver gets has a fixed size."""
    shape = (FOLDS, width, BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(np.prod(shape), np.int64)
        for batch in batches:
            b, at = flat(batch.column("_b"))
            cell = batch.column("_f").to_numpy().astype(np.int64) * width + batch.column("_k").to_numpy()
            total += np.bincount(np.repeat(cell * BUCKETS, np.diff(at)) + b, minlength=len(total))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(total[i], pa.int64())], ["i", "n"])

    table = np.zeros(np.prod(shape))
    sums = docs.where(F.col("_k") >= 0).select("_k", "_f", "_b").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    table[sums["i"].to_numpy(np.int64)] = sums["n"]
    return table.reshape(shape)


def log_tables(tables: np.ndarray) -> np.ndarray:
    """For each fold the log share of every word (bucket) by source, from the other folds."""
    other = tables.sum(axis=0) - tables
    total = other.sum(axis=2, keepdims=True)
    return np.where(total > 0, np.log((other + 0.5) / (total + 0.5 * BUCKETS)), -np.inf)


def text_memberships(buckets: np.ndarray, at: np.ndarray, log: np.ndarray) -> np.ndarray:
    """(documents, sources): what the words alone say, by one fold's table."""
    size = np.diff(at)
    seen = np.isfinite(log[:, 0])
    sums = np.concatenate([np.zeros((len(log), 1)), np.cumsum(np.where(seen[:, None], log, 0)[:, buckets], axis=1)], axis=1)
    score = ((sums[:, at[1:]] - sums[:, at[:-1]]) * np.minimum(1.0, EFFECTIVE_WORDS / np.maximum(1, size))).T
    score[:, ~seen] = -np.inf
    if not seen.any():
        return np.full(score.shape, 1 / max(1, score.shape[1]))
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def combined(told: np.ndarray, k: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What the text says times how often the stored source holds such texts
    (``held``: source by domain; its column sums for no source), in whole STEPS."""
    prior = np.vstack([held, held.sum(axis=0)])[k]
    p = told * np.where(prior.sum(axis=1, keepdims=True) > 0, prior, 1.0)
    total = p.sum(axis=1, keepdims=True)
    p = np.where(total > 0, p / np.where(total > 0, total, 1), told)
    return np.round(p * STEPS).astype(np.int16)


def _told(batch: pa.RecordBatch, logs: np.ndarray) -> np.ndarray:
    b, at = flat(batch.column("_b"))
    fold = batch.column("_f").to_numpy()
    out = np.zeros((batch.num_rows, logs.shape[1]))
    for f in range(FOLDS):
        own = np.flatnonzero(fold == f)
        if len(own):
            size = np.diff(at)[own]
            inside = np.repeat(at[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            told = text_memberships(b[inside], np.r_[0, np.cumsum(size)], logs[f])
            k = batch.column("_k").to_numpy()[own]
            alone = (k >= 0) & ~np.isfinite(logs[f][k, 0])  # no other fold has a document of its source: the text can't speak for it
            told[alone] = np.eye(logs.shape[1])[k[alone]]
            out[own] = (told + DOUBT) / (1 + DOUBT * logs.shape[1])
    return out


def memberships(docs: DataFrame, width: int) -> DataFrame:
    """``(_id, _k, _n, _q)``: adds the memberships, in whole STEPS."""
    sc = docs.sparkSession.sparkContext
    logs = sc.broadcast(log_tables(word_tables(docs, width)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                np.add.at(held, batch.column("_k").to_numpy(), _told(batch, logs.value))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(held.ravel(), pa.float64())], ["i", "x"])

    held = np.zeros(width * width)
    for r in docs.where(F.col("_k") >= 0).select("_k", "_f", "_b").mapInArrow(tally, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        held[r["i"]] = r["x"]
    held = held.reshape(width, width) + TRUST * np.eye(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = combined(_told(batch, logs.value), batch.column("_k").to_numpy(), held)
                rows = lists(q.ravel(), np.arange(1, len(q) + 1) * width, pa.int16())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_k"), batch.column("_n"), rows], ["_id", "_k", "_n", "_q"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, _k int, _n long, _q array<smallint>")


def shared(q: np.ndarray) -> np.ndarray:
    """Memberships as shares that add to 1."""
    return q / np.maximum(1, q.sum(axis=1, keepdims=True))


def limits(p: np.ndarray, k: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """How often a document may be used: its source's cap, else that of its strongest domain."""
    return np.where(k >= 0, caps[k], caps[p.argmax(axis=1)])


def replay(p: np.ndarray, cap: np.ndarray, flat_rate: float, steps: list[np.ndarray]) -> np.ndarray:
    """Each document's rate after the steps so far."""
    r = np.minimum(flat_rate, cap)
    for g in steps:
        r = np.clip(r - p @ g, 0, cap)
    return r


@dataclass
class Fit:
    """Rates as a flat rate and steps, and the domain totals they lead to."""

    flat_rate: float
    steps: list[np.ndarray]
    wanted: np.ndarray
    expected: np.ndarray


def _arrays(batch: pa.RecordBatch, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(memberships, source, tokens, cap) of a batch."""
    p = shared(flat(batch.column("_q"))[0].reshape(batch.num_rows, len(caps)).astype(float))
    k = batch.column("_k").to_numpy()
    return p, k, batch.column("_n").to_numpy(), limits(p, k, caps)


def sums(groups: DataFrame, caps: np.ndarray, value) -> np.ndarray:
    """The sum over all groups of a small array that ``value`` makes of (p, k, n, cap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + value(*_arrays(batch, caps))
        total = np.atleast_1d(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

    got = {r["i"]: r["x"] for r in groups.select("_k", "_n", "_q").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    return np.array([got.get(i, 0.0) for i in range(max(got, default=-1) + 1)])


def fit_rates(groups: DataFrame, caps: np.ndarray, wanted: np.ndarray, held: np.ndarray, near: float = 5e-4, rate: float = 0.9, most: int = MAX_STEPS) -> Fit:
    """Least squares of the domain totals, each scaled by what the domain holds.
    Ends when all are within ``near`` of the whole, or where the squares no
    longer fall; more than ``most`` steps are an error."""
    flat_rate = float(wanted.sum() / max(1.0, held.sum()))
    fit = Fit(flat_rate, [], wanted, np.zeros(len(wanted)))
    before = np.inf
    for _ in range(most):
        done = list(fit.steps)
        got = sums(groups, caps, lambda p, k, n, cap, done=done: (replay(p, cap, flat_rate, done) * n) @ p)
        off = got - wanted
        squares = float((off * off / np.maximum(held, 1.0)).sum())
        if squares > before * 0.99:  # a point where steps hardly help
            return fit if squares >= before else Fit(flat_rate, done, wanted, got)
        fit, before = Fit(flat_rate, done, wanted, got), squares
        if np.abs(off).max() <= near * wanted.sum():
            return fit
        fit.steps = [*done, rate * np.divide(off, held, out=np.zeros(len(held)), where=held > 0)]
    raise RuntimeError(f"the rates did not settle in {most} steps")


def shifts(docs: DataFrame, caps: np.ndarray, wanted: np.ndarray, fit: Fit) -> np.ndarray:
    """The shift of each source at which its whole repeats hold what its rates
    ask for. From -1 to 1 a document's repeats change at most twice; the last
    place is for documents of no source."""
    width = len(caps) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(width * (BINS + 2))
        for batch in batches:
            if batch.num_rows:
                p, k, n, cap = _arrays(batch, caps)
                at = replay(p, cap, fit.flat_rate, fit.steps) + batch.column("_u").to_numpy()
                low = np.floor(at - 1)
                first = np.clip(low, 0, cap)
                tally += np.bincount(k % width * (BINS + 2), weights=n * first, minlength=len(tally))
                for j in (1, 2):
                    rises = n * (np.clip(low + j, 0, cap) - np.clip(low + j - 1, 0, cap))
                    bin_ = np.clip(np.ceil((low + j - at + 1) / 2 * BINS), 0, BINS + 1).astype(np.int64)
                    tally += np.bincount(k % width * (BINS + 2) + bin_, weights=rises, minlength=len(tally))
        i = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(tally[i], pa.float64())], ["i", "n"])

    tally = np.zeros(width * (BINS + 2))
    rows = docs.mapInArrow(run, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    tally[rows["i"].to_numpy(np.int64)] = rows["n"]
    held = np.cumsum(tally.reshape(width, BINS + 2)[:, : BINS + 1], axis=1)
    return np.abs(held - wanted[:, None]).argmin(axis=1) / BINS * 2 - 1


@dataclass
class Mix:
    """``chosen`` has (key, source, repeats, tokens), tokens being those of one
    use; ``goals`` (source, share, max_repeats); ``fit`` how the rates came about."""

    chosen: DataFrame
    goals: list[tuple[str, float, int]]
    fit: Fit


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER, pattern: str | None = None, total: float | None = None, sourceless: bool = False) -> Mix:
    """The documents to draw; see the head of this file."""
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = [(r["source"], float(r["s"] or 0), int(r["m"] or 0)) for r in listed]
    names = [g[0] for g in goals]
    width = len(names)
    caps = np.array([max(0, g[2]) for g in goals], float)
    kind = documents.schema[key].dataType.simpleString()
    spark = documents.sparkSession
    if not width:
        return Mix(spark.createDataFrame([], f"{key} {kind}, source string, repeats int, tokens long"), goals, Fit(0.0, [], np.zeros(0), np.zeros(0)))
    hashed = F.xxhash64("_id", F.lit("mix"))
    read = measured(documents, key, text, source, names, path, pattern, sourceless).withColumn("_f", F.pmod(hashed, F.lit(FOLDS)).cast("int"))
    docs = cut(memberships(cut(read), width).withColumn("_u", F.pmod(F.shiftright(hashed, 8), F.lit(1 << 30)) / F.lit(float(1 << 30))))
    groups = cut(docs.groupBy("_k", "_q").agg(F.sum("_n").alias("_n")))
    every = sums(groups, caps, lambda p, k, n, cap: np.r_[n @ p, (cap * n) @ p])
    held, most = (every[:width], every[width:]) if len(every) else (np.zeros(width), np.zeros(width))
    stored = {r["_k"]: r["n"] for r in groups.groupBy("_k").agg(F.sum("_n").alias("n")).collect()}
    own = np.array([stored.get(k, 0) > 0 for k in range(width)])
    share = np.where(own & (caps > 0), [max(0.0, g[1]) for g in goals], 0.0)
    caps = np.where(share > 0, caps, 0)
    fit = Fit(0.0, [], np.zeros(width), np.zeros(width))
    shift = np.zeros(width + 1)
    if share.sum() > 0:
        share = share / share.sum()
        able = share > 0
        reach = float((most[able] / share[able]).min())
        fit = fit_rates(groups, caps, share * (min(total, reach) if total else reach), held)
        rates = sums(groups, caps, lambda p, k, n, cap: np.bincount(k % (width + 1), weights=n * replay(p, cap, fit.flat_rate, fit.steps), minlength=width + 1))
        shift = shifts(docs.select("_k", "_n", "_q", "_u"), caps, rates, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.array([*names, None], dtype=object)
        for batch in batches:
            if batch.num_rows:
                p, k, n, cap = _arrays(batch, caps)
                at = replay(p, cap, fit.flat_rate, fit.steps) + batch.column("_u").to_numpy()
                times = np.clip(np.floor(at + shift[k] + 1e-9), 0, cap).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(place[k], pa.string()), pa.array(times), pa.array(n)], ["_id", "source", "repeats", "tokens"])

    chosen = docs.mapInArrow(run, f"_id {kind}, source string, repeats int, tokens long").where(F.col("repeats") > 0)
    return Mix(chosen.withColumnRenamed("_id", key), goals, fit)


def shares(mixed: Mix) -> DataFrame:
    """``(source, target_share, max_repeats, documents, tokens, share, most_repeats,
    wanted_tokens, expected_tokens, steps)`` for every listed source: what its own
    documents give, and what its domain was asked to give and gives by the
    memberships after so many steps."""
    spark = mixed.chosen.sparkSession
    fit = mixed.fit
    rows = [(*g, float(w), float(x), len(fit.steps)) for g, w, x in zip(mixed.goals, fit.wanted, fit.expected, strict=True)]
    listed = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, wanted_tokens double, expected_tokens double, steps int")
    each = mixed.chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = each.agg(F.sum("tokens").alias("_all"))
    joined = listed.join(F.broadcast(each), "source", "left").crossJoin(F.broadcast(total))  # at most MAX_SOURCES rows and one row
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens")]
    return joined.select("source", "target_share", "max_repeats", *zero, F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "wanted_tokens", "expected_tokens", "steps")
