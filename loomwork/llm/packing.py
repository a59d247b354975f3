"""Filling containers of fixed capacity with items of varying length.

An item longer than the capacity is cut into full pieces, each a container of
its own, and a remainder; no other item is ever cut. For the rest only the
histogram of lengths matters, at most ``capacity`` numbers however many items
there are, so the plan is made on the driver:

* *Configuration LP*: choose how often to use each way of filling a container
  (a filling) so that every length is covered, with as few containers as
  possible. It starts from the fillings of a best-fit packing.
* *Pricing*: at given prices of the lengths a knapsack dynamic program finds
  the most valuable filling, and with it, for every length, the most valuable
  one that holds this length. Total price over highest value is a lower bound
  on any packing; the first prices, each length's share of the capacity, give
  the bound of the total length. Fillings worth more than the program pays for
  a container join the program.
* *Multiplicative weights*: between pricings the program over the fillings so
  far is a game of prices against fillings. Both sides' weights are multiplied
  by exponentials of their gains (with the last gain counted twice, which
  settles faster); the averages give uses of fillings and the next prices.
* It ends when value and bound are within ``gap``, after ``rounds`` pricings,
  or when ``IDLE`` pricings running brought neither nearer. Both are reported.
* *Rounding*: numbers of uses are rounded down, then up by what was cut off,
  largest first, as long as all items exist; what is left, a number of items
  bounded by the fillings and not by the data, is packed best-fit from the
  longest down. The plan is the best rounding of all rounds.

Then each item's rank among the items of its length, found by counting in hash
buckets, gives its container by looking up the plan's rank ranges. No length
is gathered in one task.

Defined cases: items of no length take no container and give no row; null ids
are kept; equal ids are items each; an empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut

GAP = 0.002
ROUNDS = 24
GAME_STEPS = 1500
IDLE = 6
RATE = 0.3


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Value of the best filling of each room up to the capacity, and the place of
    one length in it (-1: the room is that of a smaller one). ``lengths`` ascend."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for w in range(int(lengths[0]), capacity + 1):
        gains = best[w - lengths[: upto[w]]] + values[: upto[w]]
        j = int(gains.argmax())
        if gains[j] > best[w - 1] + 1e-15:
            best[w], pick[w] = gains[j], j
        else:
            best[w] = best[w - 1]
    return best, pick


def traced(pick: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """Place of length to count of the best filling of ``room``."""
    out: dict[int, int] = {}
    while room > 0:
        j = int(pick[room])
        if j < 0:
            room -= 1
        else:
            out[j] = out.get(j, 0) + 1
            room -= int(lengths[j])
    return out


def completed(filling: dict[int, int], lengths: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """The filling with counts cut back to what there is and free room filled again, longest first."""
    out = {j: min(n, int(limits[j])) for j, n in filling.items()}
    room = capacity - sum(n * int(lengths[j]) for j, n in out.items())
    j = int(np.searchsorted(lengths, room, side="right")) - 1
    while j >= 0 and room >= lengths[0]:
        more = min(int(limits[j]) - out.get(j, 0), room // int(lengths[j]))
        if more > 0:
            out[j] = out.get(j, 0) + more
            room -= more * int(lengths[j])
        j = min(j, int(np.searchsorted(lengths, room, side="right"))) - 1
    return out


class Program:
    """The configuration program over the fillings known so far. Rows are
    lengths; ``use`` is the best covering known, in uses of each filling."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> None:
        self.lengths, self.demand, self.capacity = lengths, demand, capacity
        self.fillings: list[dict[int, int]] = []
        self.known: set[tuple] = set()
        self.row, self.column, self.count = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.use = np.zeros(0)
        self.bound = float((lengths * demand).sum()) / capacity
        self.mix: np.ndarray | None = None

    @property
    def value(self) -> float:
        return float(self.use.sum())

    def add(self, fillings: list[dict[int, int]]) -> int:
        """Takes new fillings in; returns how many were new."""
        new = []
        for f in fillings:
            key = tuple(sorted(f.items()))
            if key not in self.known:
                self.known.add(key)
                new.append(f)
        at = len(self.fillings)
        self.fillings += new
        cells = [(j, at + i, n) for i, f in enumerate(new) for j, n in f.items()]
        if cells:
            a = np.array(cells, np.int64)
            self.row, self.column = np.r_[self.row, a[:, 0]], np.r_[self.column, a[:, 1]]
            self.count = np.r_[self.count, a[:, 2].astype(float)]
        self.use = np.r_[self.use, np.zeros(len(new))]
        if self.mix is not None:
            self.mix = np.r_[self.mix, np.zeros(len(new))]
        return len(new)

    def price(self, prices: np.ndarray) -> list[dict[int, int]]:
        """Raises the bound by these prices; the fillings worth a place, best first."""
        best, pick = knapsack(self.lengths, prices, self.capacity)
        top = best[self.capacity]
        self.bound = max(self.bound, float((prices * self.demand).sum()) / top)
        pays = float((prices * self.demand).sum()) / self.value  # what the program pays for a container
        worth = prices + best[self.capacity - self.lengths]
        limits = np.minimum(self.demand, self.capacity // self.lengths)
        out = []
        for j in np.argsort(-worth, kind="stable"):
            if worth[j] <= pays * (1 + 1e-9):
                break
            f = traced(pick, self.lengths, self.capacity - int(self.lengths[j]))
            f[int(j)] = f.get(int(j), 0) + 1
            out.append(completed(f, self.lengths, limits, self.capacity))
        return out

    def play(self, steps: int = GAME_STEPS) -> np.ndarray:
        """The game of prices against fillings by multiplicative weights; takes
        the averages over if they cover in fewer containers, returns the prices."""
        gain = self.count / self.demand[self.row] * self.value  # coverage of a length when the whole value is one filling
        m, p = len(self.lengths), len(self.fillings)
        start = self.mix if self.mix is not None else self.use / self.value
        log_x = np.log(np.maximum(0.9 * start + 0.1 / p, 1e-12))
        log_y = np.zeros(m)
        sum_x, sum_y = np.zeros(p), np.zeros(m)
        last_c = last_v = None
        best, best_x = self.value, None
        for step in range(1, steps + 1):
            x = np.exp(log_x - log_x.max())
            x /= x.sum()
            y = np.exp(log_y - log_y.max())
            y /= y.sum()
            c = np.bincount(self.row, weights=gain * x[self.column], minlength=m)
            v = np.bincount(self.column, weights=gain * y[self.row], minlength=p)
            log_y -= RATE * (c if last_c is None else 2 * c - last_c)
            log_x += RATE * (v if last_v is None else 2 * v - last_v)
            last_c, last_v = c, v
            sum_x += x
            sum_y += y
            if step % 250 == 0 or step == steps:
                mean = sum_x / sum_x.sum()
                least = np.bincount(self.row, weights=gain * mean[self.column], minlength=m).min()
                if least > 0 and self.value / least < best:
                    best, best_x = self.value / least, mean
                if step % 500 == 0:
                    sum_x, sum_y = sum_x * 0.25, sum_y * 0.25  # early plays count less
        self.mix = sum_x / sum_x.sum()
        if best_x is not None:
            self.use = best_x * best
        return sum_y / sum_y.sum() / self.demand


@dataclass
class Plan:
    """How items of each length go to containers: uses of fillings."""

    capacity: int
    containers: int = 0
    # per slot: length, first rank, items of the length in a container, first container, uses
    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    value: float = 0.0  # of the program
    bound: float = 0.0  # no packing needs fewer
    pricings: int = 0

    def use(self, filling: list[tuple[int, int]], times: int, taken: dict[int, int]) -> None:
        for length, n in filling:
            self.length.append(length)
            self.rank.append(taken.get(length, 0))
            self.each.append(n)
            self.first.append(self.containers)
            taken[length] = taken.get(length, 0) + n * times
        self.containers += times


def rounded(program: Program) -> list[tuple[dict[int, int], int]]:
    """Whole uses of fillings (by length) that hold every item once."""
    lengths, left = program.lengths, program.demand.copy()
    out: list[tuple[dict[int, int], int]] = []
    whole = np.floor(program.use + 1e-9)
    off = program.use - whole

    def take(i: int, times: int) -> None:
        f = program.fillings[i]
        n = min(times, *[int(left[j]) // k for j, k in f.items()])
        if n > 0:
            for j, k in f.items():
                left[j] -= k * n
            out.append(({int(lengths[j]): k for j, k in f.items()}, n))

    for i in np.flatnonzero(whole):
        take(int(i), int(whole[i]))
    for i in np.argsort(-off, kind="stable"):
        if off[i] < 0.2:
            break
        take(int(i), 1)
    return out + best_fit(lengths, left, program.capacity)


def make_plan(histogram: dict[int, int], capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> Plan:
    """The plan for so many items of each length (0 < length <= capacity)."""
    plan = Plan(capacity)
    taken: dict[int, int] = {}
    full = histogram.get(capacity, 0)
    if full:
        plan.use([(capacity, 1)], full, taken)
    lengths = np.array(sorted(k for k in histogram if k < capacity), np.int64)
    plan.value = plan.bound = float(full)
    if not len(lengths):
        return plan
    demand = np.array([histogram[int(k)] for k in lengths], np.int64)
    place = {int(k): j for j, k in enumerate(lengths)}
    program = Program(lengths, demand, capacity)
    packed = best_fit(lengths, demand, capacity)
    program.add([{place[k]: n for k, n in f.items()} for f, _ in packed])
    at = {tuple(sorted(f.items())): i for i, f in enumerate(program.fillings)}
    for f, times in packed:
        program.use[at[tuple(sorted((place[k], n) for k, n in f.items()))]] += times
    best = packed
    prices = lengths / capacity
    idle = 0
    while plan.pricings < rounds and idle < IDLE and program.value > max(program.bound * (1 + gap), math.ceil(program.bound - 1e-6) + 1e-6):
        before = program.value, program.bound
        plan.pricings += 1
        program.add(program.price(prices))
        prices = program.play()
        idle = 0 if program.value < before[0] * (1 - 1e-4) or program.bound > before[1] * (1 + 1e-4) else idle + 1
        now = rounded(program)
        if sum(n for _, n in now) < sum(n for _, n in best):
            best = now
    plan.value, plan.bound = full + program.value, full + program.bound
    for filling, times in best:
        plan.use(sorted(filling.items()), times, taken)
    return plan


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit from the longest item down, as (filling, how often). Containers
    filled alike are one group, so the work depends on the histogram only."""
    groups: dict[int, list[list]] = {}  # by room: [filling, how many]
    rooms = np.zeros(capacity + 1, np.int64)

    def put(room: int, filling: dict[int, int], n: int) -> None:
        for g in groups.setdefault(room, []):
            if g[0] == filling:
                g[1] += n
                break
        else:
            groups[room].append([filling, n])
        rooms[room] += n

    for i in np.argsort(-lengths, kind="stable"):
        length, n = int(lengths[i]), int(left[i])
        while n > 0:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = length + int(fit[0])
                filling, many = groups[room].pop()
                rooms[room] -= many
            else:
                room, filling, many = capacity, {}, n
            each = min(room // length, n)
            boxes = min(many, n // each)
            put(room - each * length, filling | {length: each}, boxes)
            n -= boxes * each
            if len(fit) and many > boxes:
                put(room, filling, many - boxes)
    return [(f, k) for gs in groups.values() for f, k in gs if k]


def ranked(items: DataFrame, by: str, key: str, buckets: int) -> DataFrame:
    """``items`` with ``_rank``, dense from 0 among the rows of the same ``by``:
    counted in hash buckets of the key, then added up, so that a ``by`` shared
    by most rows is still spread over the tasks."""
    bucketed = items.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(by, "_bucket").agg(F.count("*").alias("_many"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_many").over(before), F.lit(0).cast("long"))).drop("_many")
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(key))
    numbered = bucketed.withColumn("_in", inside)
    return numbered.join(offsets, [by, "_bucket"]).withColumn("_rank", F.col("_offset") + F.col("_in") - 1).drop("_bucket", "_in", "_offset")


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048, rows_per_bucket: int = 50_000) -> DataFrame:
    """``(key, piece, container, tokens)``: every piece of every item with its
    container; ``piece`` counts from 1 and is 1 for items left whole."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = cut(sizes.where(F.col(size) > 0).select(F.col(key).alias("_id"), F.col(size).cast("long").alias("_n")))
    kind = sizes.schema[key].dataType
    rest = F.when(F.col("_n") <= capacity, F.col("_n")).otherwise(F.col("_n") % capacity)
    counted = items.groupBy(rest.alias("_rest")).agg(F.count("*").alias("c")).where(F.col("_rest") > 0).collect()  # at most ``capacity`` rows
    histogram = {int(r["_rest"]): int(r["c"]) for r in counted}
    plan = make_plan(histogram, capacity)
    buckets = max(16, sum(histogram.values()) // rows_per_bucket)
    full = items.where(F.col("_n") > capacity).select("_id", F.explode(F.sequence(F.lit(1), (F.col("_n") / capacity).cast("int"))).alias("piece"))
    full = full.select("_id", "piece", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), "piece").alias("container"), F.lit(capacity).cast("long").alias("tokens"))
    parts = items.withColumn("_rest", rest).where(F.col("_rest") > 0).withColumn("piece", F.when(F.col("_n") > capacity, (F.col("_n") / capacity).cast("int") + 1).otherwise(1))
    placed = ranked(parts.select("_id", "_rest", "piece"), "_rest", "_id", buckets)
    order = np.lexsort((np.array(plan.rank, np.int64), np.array(plan.length, np.int64)))
    length, rank, each, first = (np.array(x, np.int64)[order] for x in (plan.length, plan.rank, plan.each, plan.first))
    far = np.int64(1 << 44)  # ranks stay below it
    at = sizes.sparkSession.sparkContext.broadcast((length * far + rank, each, first))  # bounded by the capacity, not by the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, per, begin = at.value
        for b in batches:
            slot = np.searchsorted(start, b["_rest"].to_numpy(np.int64) * far + b["_rank"].to_numpy(np.int64), side="right") - 1
            box = begin[slot] + (b["_rank"].to_numpy(np.int64) - start[slot] % far) // per[slot]
            yield pd.DataFrame({"_id": b["_id"], "piece": b["piece"], "container": "mixed-" + pd.Series(box, index=b.index).astype(str), "tokens": b["_rest"]})

    mixed = placed.select("_id", "piece", "_rest", "_rank").mapInPandas(run, f"_id {kind.simpleString()}, piece int, container string, tokens long")
    return full.unionByName(mixed).select(F.col("_id").alias(key), "piece", "container", "tokens")


def container_fill(packed: DataFrame) -> DataFrame:
    """``(container, pieces, tokens)``."""
    return packed.groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
