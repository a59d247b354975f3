"""Pairs of items in the same basket, by heavy-light decomposition.

The distinct (basket, item) rows are split by item frequency:

* heavy items, at most ``max_heavy`` of them because each takes more than
  ``rows / max_heavy`` rows: their pairs are counted with a dense bit matrix,
  one packed bit vector per item and block of baskets, AND and popcount;
* light items: pairs are counted in a hash table per task, chunk by chunk;
* mixed pairs: each light item's basket list probes the block's heavy matrix.

Every task works on whole baskets in blocks and hands on counts, never pairs,
so what is shuffled is bounded by the distinct pairs per task. Items under
``min_pair`` baskets can be in no reported pair and are left out beforehand
(exact). A basket holds each item once, so no basket is longer than the number
of items, however many rows a basket has.

A basket of more than ``part`` items is cut by hash into g = ceil(n / part)
parts, and each two parts, and each part with itself, are a unit of their own:
its pairs are spread over g * (g + 1) / 2 tasks, none of which holds more than
about 2 * ``part`` of its items, at the price of g copies of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut

BLOCK = 8192
CHUNK = 1 << 20
FLUSH = 300_000
PART = 2000
SALTS = 16
ROWS = 1 << 16  # rows a task gathers before it counts


def distinct_baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``(_b, _i)``; rows with a null basket or item are left out."""
    return df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("_b"), F.col(item).alias("_i")).distinct()


def _light_pairs(start: np.ndarray, size: np.ndarray, code: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Encoded pairs (smaller code first) of each basket's sorted light codes,
    at most about CHUNK at once: one step per distance within the basket."""
    if not len(size):
        return
    pending, held = [], 0
    for step in range(1, int(size.max())):
        many = np.flatnonzero(size > step)
        at = 0
        while at < len(many):
            part = many[at : at + CHUNK // 8]
            at += len(part)
            counts = size[part] - step
            left = np.repeat(start[part] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            pending.append(code[left] * width + code[left + step])
            held += len(left)
            if held > CHUNK:
                yield np.concatenate(pending)
                pending, held = [], 0
    if pending:
        yield np.concatenate(pending)


def block_counts(basket: np.ndarray, item: np.ndarray, heavy: np.ndarray, n_heavy: int, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all pairs within one block. ``basket`` is dense from 0,
    ``item`` holds codes of which those under ``n_heavy`` are heavy. Returns
    pair codes ``a * n_items + b`` with a < b as codes, and their counts."""
    out_codes, out_counts = [], []
    n_baskets = int(basket.max()) + 1 if len(basket) else 0
    dense = np.zeros((n_baskets, n_heavy), dtype=bool)
    dense[basket[heavy], item[heavy]] = True
    if n_heavy > 1:
        bits = np.packbits(dense, axis=0)  # n_baskets / 8 x n_heavy
        bits = np.vstack([bits, np.zeros((-len(bits) % 8, n_heavy), np.uint8)])
        words = np.ascontiguousarray(bits.T).view(np.uint64)
        for a in range(n_heavy - 1):
            n = np.bitwise_count(words[a] & words[a + 1 :]).sum(axis=1, dtype=np.int64)
            b = np.flatnonzero(n)
            out_codes.append(a * n_items + (a + 1 + b))
            out_counts.append(n[b])
    light = ~heavy
    lb, li = basket[light], item[light]
    if len(li) and n_heavy:
        order = np.argsort(li, kind="stable")
        sl, sb = li[order], lb[order]
        starts = np.flatnonzero(np.r_[True, sl[1:] != sl[:-1]])
        for at in range(0, len(starts), 256):
            chosen = starts[at : at + 256]
            end = starts[at + 256] if at + 256 < len(starts) else len(sl)
            n = np.add.reduceat(dense[sb[chosen[0] : end]], chosen - chosen[0], axis=0, dtype=np.int64)
            which, h = np.nonzero(n)
            out_codes.append(h * n_items + sl[chosen][which])
            out_counts.append(n[which, h])
    if len(li):
        order = np.lexsort((li, lb))
        lb, li = lb[order], li[order]
        start = np.flatnonzero(np.r_[True, lb[1:] != lb[:-1]])
        size = np.diff(np.r_[start, len(lb)])
        for pairs in _light_pairs(start, size, li, n_items):
            codes, n = np.unique(pairs, return_counts=True)
            out_codes.append(codes)
            out_counts.append(n)
    if not out_codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _summed(np.concatenate(out_codes), np.concatenate(out_counts))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(codes, return_inverse=True)
    return unique, np.bincount(where, weights=counts, minlength=len(unique)).astype(np.int64)


def split_pairs(items: np.ndarray, second: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of one unit of a large basket, in pieces: each item of
    the first part with each of the second, or of a part of its ``own`` with each other."""
    left = np.flatnonzero(~second)
    right = left if own else np.flatnonzero(second)
    rows = max(1, CHUNK // max(1, len(right)))
    for at in range(0, len(left), rows):
        some = left[at : at + rows]
        i, j = np.repeat(some, len(right)), np.tile(right, len(some))
        keep = items[i] < items[j] if own else np.ones(len(i), bool)
        yield i[keep], j[keep]


def _count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by unit. Item codes are the task's own: heavy items
    first. Counts are kept per task and handed on when the table is large; pairs
    of a large basket's unit are handed on at once, each is there once."""
    table: dict[tuple[str, str], int] = {}
    count_of: dict[str, int] = {}

    def work(rows: pd.DataFrame, unit: np.ndarray) -> None:
        code, uniques = pd.factorize(rows["_i"])
        flag = rows["_h"].to_numpy()
        first = np.zeros(len(uniques), bool)
        first[code] = flag
        count = np.zeros(len(uniques), np.int64)
        count[code] = rows["_n"].to_numpy()
        rank = np.argsort(~first, kind="stable")
        place = np.empty(len(uniques), np.int64)
        place[rank] = np.arange(len(uniques))
        n_items = len(uniques)
        codes, n = block_counts(unit - unit[0], place[code], flag, int(first.sum()), n_items)
        names = np.asarray(uniques, dtype=object)[rank]
        for name, k in zip(names, count[rank], strict=True):
            count_of[name] = int(k)
        for a, b, k in zip(names[codes // n_items], names[codes % n_items], n.tolist(), strict=True):
            key = (a, b) if a < b else (b, a)
            table[key] = table.get(key, 0) + k

    def flush() -> pd.DataFrame:
        keys = list(table)
        a, b = [k[0] for k in keys], [k[1] for k in keys]
        out = pd.DataFrame({"_a": a, "_c": b, "_k": list(table.values()), "_na": [count_of[x] for x in a], "_nc": [count_of[x] for x in b]})
        table.clear()
        count_of.clear()  # every block sets its own items again
        return out

    def large(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        items, n = rows["_i"].to_numpy(), rows["_n"].to_numpy()
        low, high = divmod(int(rows["_p"].iloc[0]), int(rows["_g"].iloc[0]))
        for i, j in split_pairs(items, rows["_s"].to_numpy(), low == high):
            turn = items[i] > items[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            yield pd.DataFrame({"_a": items[i], "_c": items[j], "_k": np.ones(len(i), np.int64), "_na": n[i], "_nc": n[j]})

    def finish(rows: pd.DataFrame, ends: np.ndarray) -> Iterator[pd.DataFrame]:
        """Counts the units that end at ``ends``."""
        unit = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        parted = rows["_g"].to_numpy()[: ends[-1]] > 1
        for k in np.unique(unit[parted]):
            yield from large(rows.iloc[ends[k - 1] if k else 0 : ends[k]])
        whole = np.flatnonzero(~parted)
        for at in np.unique(unit[whole] // BLOCK):
            some = whole[unit[whole] // BLOCK == at]
            work(rows.iloc[some], pd.factorize(unit[some])[0].astype(np.int64))
            if len(table) > FLUSH:
                yield flush()

    held: list[pd.DataFrame] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) < ROWS:
            continue
        rows = pd.concat(held, ignore_index=True)
        b, p = rows["_b"].to_numpy(), rows["_p"].to_numpy()
        ends = 1 + np.flatnonzero((b[1:] != b[:-1]) | (p[1:] != p[:-1]))
        if len(ends):  # the last unit may go on
            yield from finish(rows, ends)
        held = [rows.iloc[ends[-1] if len(ends) else 0 :]]
    if held:
        rows = pd.concat(held, ignore_index=True)
        b, p = rows["_b"].to_numpy(), rows["_p"].to_numpy()
        yield from finish(rows, np.r_[1 + np.flatnonzero((b[1:] != b[:-1]) | (p[1:] != p[:-1])), len(rows)])
    if table:
        yield flush()


def in_units(rows: DataFrame, part: int, baskets: DataFrame | None = None) -> DataFrame:
    """``rows`` (_b, _i, ...) with ``_g`` parts of its basket, ``_p`` the unit within
    the basket and ``_s``, whether the row is of the unit's second part. The large
    baskets, counted in ``baskets``, are written down: as a rule there are few, and
    the rows need no shuffle to learn of them."""
    sizes = cut((rows if baskets is None else baskets).groupBy("_b").agg(F.count("*").alias("_size")).where(F.col("_size") > part))
    sized = rows.join(sizes, "_b", "left").withColumn("_g", F.coalesce(F.ceil(F.col("_size") / part), F.lit(1)).cast("int")).drop("_size")
    own = F.pmod(F.xxhash64("_i", F.lit("part")), F.col("_g").cast("long")).cast("int")
    unit = F.struct(F.least("_own", "_with").alias("lo"), F.greatest("_own", "_with").alias("hi"))
    spread = sized.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    named = spread.withColumn("_u", unit).withColumn("_p", F.col("_u.lo") * F.col("_g") + F.col("_u.hi"))
    return named.withColumn("_s", (F.col("_own") == F.col("_u.hi")) & (F.col("_u.lo") != F.col("_u.hi"))).drop("_own", "_with", "_u")


def pair_counts(baskets: DataFrame, min_pair: int = 5, max_heavy: int = 256, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """``(pairs, totals)``: pairs ``(a, b, n_a, n_b, n_ab)`` with a < b by code
    point and n_ab >= ``min_pair``; totals one row with ``n``, the number of
    baskets. Items that are in no basket with another give no pair.
    """
    baskets = cut(baskets)  # distinct rows, read several times below
    totals = baskets.agg(F.count_distinct("_b").alias("n"))
    every = baskets.groupBy("_i").agg(F.count("*").alias("_n"))
    split = every.agg((F.sum("_n") / F.lit(max_heavy)).alias("_limit"))  # one row
    counts = every.where(F.col("_n") >= min_pair).crossJoin(F.broadcast(split))
    # each heavy item holds over rows / max_heavy rows, so there are fewer than max_heavy
    heavy = counts.where(F.col("_n") > F.col("_limit")).select("_i", "_n", F.lit(True).alias("_h"))
    # a light item still may hold rows / max_heavy rows, so its rows are spread over salts
    light = counts.where(F.col("_n") <= F.col("_limit")).select("_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = baskets.join(F.broadcast(heavy), "_i", "left")
    salted = joined.where(F.col("_h").isNull()).select("_b", "_i", F.pmod(F.xxhash64("_b"), F.lit(SALTS)).cast("int").alias("_salt"))
    rows = joined.where(F.col("_h")).select("_b", "_i", "_n", "_h").unionByName(salted.join(light, ["_i", "_salt"]).select("_b", "_i", "_n", F.lit(False).alias("_h")))
    units = in_units(rows, part, baskets)
    counted = units.repartition("_b", "_p").sortWithinPartitions("_b", "_p").mapInPandas(_count_task, "_a string, _c string, _k long, _na long, _nc long")
    pairs = counted.groupBy(F.col("_a").alias("a"), F.col("_c").alias("b")).agg(F.max("_na").alias("n_a"), F.max("_nc").alias("n_b"), F.sum("_k").alias("n_ab")).where(F.col("n_ab") >= min_pair)
    return pairs, totals


def associated_pairs(df: DataFrame, basket: str, item: str, min_pair: int = 5, min_lift: float = 4, max_heavy: int = 256) -> DataFrame:
    """``(skill_a, skill_b, n_ab, n_a, n_b, n, lift)`` of pairs seen together in
    at least ``min_pair`` baskets and at least ``min_lift`` times as often as
    chance would give, lift = n_ab * n / (n_a * n_b)."""
    pairs, totals = pair_counts(distinct_baskets(df, basket, item), min_pair, max_heavy)
    n = F.col("n")
    return (
        pairs.crossJoin(F.broadcast(totals))  # totals is one row
        .where(F.col("n_ab") * n >= min_lift * F.col("n_a") * F.col("n_b"))
        .select(F.col("a").alias("skill_a"), F.col("b").alias("skill_b"), "n_ab", "n_a", "n_b", "n", (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"))
    )
