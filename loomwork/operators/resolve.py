"""Entity resolution: near pairs of unit vectors, constrained clustering, tiers."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut

TILE = 4096
MAX_PIVOTS = 8192


def near_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, kind: str | None = None, pivots: int | None = None, tile: int = TILE) -> DataFrame:
    """``(a, b, score)``, a < b: all pairs of unit vectors with cosine >= ``threshold``, exactly.

    Vectors are filed under the nearest of ``pivots`` sampled ones, the root of
    their number unless given, at most MAX_PIVOTS; by
    the triangle inequality of angles two cells farther apart than their radii
    and the threshold's angle hold no pair and are never compared. The others
    are compared tile by tile with matrix products; cells are cut into tiles of
    ``tile`` rows by hash, so a cell of equal vectors is no hot spot. With
    ``kind`` only vectors of one kind are paired. Null vectors pair with none.
    """
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(vector).alias("_v"), (F.col(kind) if kind else F.lit("")).alias("_kind"))
    n = rows.count()
    some = pivots or max(1, min(MAX_PIVOTS, math.isqrt(n), n // tile * 8))  # few vectors need no cells
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(some).collect()
    id_type = rows.schema["_id"].dataType.simpleString()
    empty = rows.sparkSession.createDataFrame([], f"a {id_type}, b {id_type}, score double")
    if not sample:
        return empty
    centres = np.array([r["_v"] for r in sample], np.float64)
    angle = math.acos(max(-1.0, min(1.0, threshold)))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cos = np.clip(np.stack(b["_v"].to_numpy()).astype(np.float64) @ centres.T, -1, 1)
                cell = cos.argmax(axis=1)
                yield b.assign(_cell=cell.astype(np.int32), _far=np.arccos(cos[np.arange(len(b)), cell]))

    filed = rows.mapInPandas(file, f"_id {id_type}, _v array<float>, _kind string, _cell int, _far double")
    cells = {r["_cell"]: (r["far"], r["n"]) for r in filed.groupBy("_cell").agg(F.max("_far").alias("far"), F.count("*").alias("n")).collect()}  # at most ``pivots`` rows
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    parts = {c: max(1, math.ceil(n / tile)) for c, (_, n) in cells.items()}
    partners = {c: [d for d in cells if between[c, d] - cells[c][0] - cells[d][0] <= angle + 1e-6] for c in cells}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, some in b.groupby("_cell"):
                own = some["_part"].to_numpy() % parts[cell]
                for other in partners[cell]:
                    for j in range(parts[other]):
                        # a tile pair is named from its smaller end
                        first = np.where((cell < other) | ((cell == other) & (own <= j)), True, False)
                        name = np.where(first, [f"{cell}.{i}-{other}.{j}" for i in own], [f"{other}.{j}-{cell}.{i}" for i in own])
                        yield pd.DataFrame({"_id": some["_id"], "_v": some["_v"], "_kind": some["_kind"], "_tile": name, "_own": [f"{cell}.{i}" for i in own]})

    tiles = filed.select("_id", "_v", "_kind", "_cell", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(1 << 20)).cast("int").alias("_part")).mapInPandas(spread, f"_id {id_type}, _v array<float>, _kind string, _tile string, _own string")

    def compare(name: tuple, b: pd.DataFrame) -> pd.DataFrame:
        left, _, right = name[0].partition("-")
        x, y = b[b["_own"] == left], b[b["_own"] == right]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": b["_id"][:0], "b": b["_id"][:0], "score": np.zeros(0)})
        score = np.stack(x["_v"].to_numpy()).astype(np.float64) @ np.stack(y["_v"].to_numpy()).astype(np.float64).T
        i, j = np.nonzero(score >= threshold)
        a, c = x["_id"].to_numpy()[i], y["_id"].to_numpy()[j]
        keep = (x["_kind"].to_numpy()[i] == y["_kind"].to_numpy()[j]) & ((a < c) if left == right else (a != c))
        a, c, s = a[keep], c[keep], score[i, j][keep]
        return pd.DataFrame({"a": np.minimum(a, c), "b": np.maximum(a, c), "score": s})

    return tiles.groupBy("_tile").applyInPandas(compare, f"a {id_type}, b {id_type}, score double")


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)``: the smallest id reachable over the pairs. Large-star
    and small-star steps in turn, so rounds grow with the logarithm of the
    longest path; it goes on until a round changes nothing. Each round is cut, so the plan stays short."""
    edges = cut(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where(F.col("u") > F.col("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        edges = cut(small, replaces=edges)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if now == before:
            break
        before = now
    member = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return member.unionByName(member.select(F.col("component").alias("id"), "component").distinct())


# Programming languages, which never merge with one another.
LANGUAGES = ("java", "javascript", "python", "c", "c++", "c#", "php", "ruby", "go", "kotlin", "swift", "typescript", "scala", "r", "matlab", "sql")


def conflicting(a: str, b: str, forbidden: set[tuple[str, str]] = frozenset()) -> bool:
    """Whether two names must stay apart: said so, other figures, or other languages."""
    if (a, b) in forbidden or (b, a) in forbidden:
        return True
    x, y = set(re.findall(r"\d+", a)), set(re.findall(r"\d+", b))
    if x and y and x != y:
        return True
    x, y = ({w for w in re.split(r"[\s,/]+", s) if w in LANGUAGES} for s in (a, b))
    return bool(x and y and x != y)


def representative(group: list[str], counts: dict[str, int]) -> str:
    """The commonest name, of those the shortest, then the smallest."""
    return min(group, key=lambda n: (-counts.get(n, 0), len(n), n))


def may_join(x: list[str], y: list[str], counts: dict[str, int], most: int, vectors: dict[str, np.ndarray] | None, floor: float, forbidden: set[tuple[str, str]]) -> bool:
    """Whether two clusters may become one."""
    both = x + y
    if len(both) > most or any(conflicting(m, n, forbidden) for m in x for n in y):
        return False
    h = representative(both, counts)
    return vectors is None or all(float(np.dot(vectors[m], vectors[h])) >= floor for m in both if m != h)


def greedy_clusters(names: list[str], counts: dict[str, int], pairs: list[tuple[str, str, float]], most: int, vectors: dict[str, np.ndarray] | None, floor: float, forbidden: set[tuple[str, str]] = frozenset()) -> dict[str, str]:
    """Name to representative: pairs from the best down join their clusters
    unless that grows beyond ``most``, puts conflicting names together, or
    leaves a member whose cosine with the new representative is below ``floor``."""
    home = {n: n for n in names}
    members = {n: [n] for n in names}
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        x, y = home[a], home[b]
        if x == y or not may_join(members[x], members[y], counts, most, vectors, floor, forbidden):
            continue
        members[x] += members[y]
        for m in members.pop(y):
            home[m] = x
    return {n: representative(members[home[n]], counts) for n in names}


MAX_COMPONENT = 20_000
MAX_CLUSTER = 100


def merge_clusters(pairs: DataFrame, skills: DataFrame, most: int = MAX_CLUSTER, floor: float = 0.7, with_vectors: bool = True, forbidden: set[tuple[str, str]] = frozenset(), largest: int = MAX_COMPONENT) -> DataFrame:
    """``(skill, canonical)`` of the names that merge. Greedy order only matters
    within a connected component, so each of up to ``largest`` names is one
    group; larger ones go through :func:`merge_in_rounds`, with the same result.
    ``pairs`` has (a, b, score), ``skills`` (skill, count, vector)."""
    found = cut(components(pairs))
    sizes = found.groupBy("component").agg(F.count("*").alias("_size"))
    ends = pairs.join(found.withColumnRenamed("id", "a"), "a").join(sizes, "component").select("component", "_size", "a", "b", "score")
    vector = F.col("vector") if with_vectors else F.lit(None).cast("array<float>")
    names = found.withColumnRenamed("id", "skill").join(skills, "skill").join(sizes, "component").select("component", "_size", F.col("skill").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("score"), F.col("count").alias("n"), vector.alias("v"))
    rows = names.unionByName(ends.select("component", "_size", "a", "b", "score", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<float>").alias("v")))

    def work(b: pd.DataFrame) -> pd.DataFrame:
        node, edge = b[b["b"].isna()], b[b["b"].notna()]
        counts = dict(zip(node["a"], node["n"].astype(int), strict=True))
        vectors = dict(zip(node["a"], node["v"], strict=True)) if with_vectors else None
        got = greedy_clusters(list(node["a"]), counts, list(zip(edge["a"], edge["b"], edge["score"], strict=True)), most, vectors, floor, forbidden)
        merged = [(k, v) for k, v in got.items() if k != v]
        return pd.DataFrame(merged, columns=["skill", "canonical"])

    small = rows.where(F.col("_size") <= largest).groupBy("component").applyInPandas(work, "skill string, canonical string")
    big = ends.where(F.col("_size") > largest).select("a", "b", "score")
    if not big.limit(1).count():
        return small
    return small.unionByName(merge_in_rounds(big, skills, most, floor, with_vectors, forbidden))


def merge_in_rounds(pairs: DataFrame, skills: DataFrame, most: int, floor: float, with_vectors: bool = True, forbidden: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """The clusters of :func:`greedy_clusters` for components of any size. A pair
    depends only on earlier pairs that touch its two clusters, so in each round
    all pairs that come first for both of theirs are decided at once. Clusters
    hold at most ``most`` names, so no row grows beyond that."""
    vector = F.col("vector") if with_vectors else F.lit(None).cast("array<float>")
    used = pairs.select(F.col("a").alias("skill")).unionByName(pairs.select(F.col("b").alias("skill"))).distinct()
    facts = cut(used.join(skills, "skill").select("skill", F.col("count").alias("n"), vector.alias("v")))
    home = cut(facts.select("skill", F.col("skill").alias("cluster")))
    left = cut(pairs.select("a", "b", "score").distinct())
    order = [F.desc("score"), F.asc("a"), F.asc("b")]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for x, y in zip(b["mx"], b["my"], strict=True):
                rows = [*x, *y]
                counts = {r["skill"]: int(r["n"]) for r in rows}
                vectors = {r["skill"]: np.asarray(r["v"], np.float64) for r in rows} if with_vectors else None
                said.append(may_join([r["skill"] for r in x], [r["skill"] for r in y], counts, most, vectors, floor, forbidden))
            yield b[["a", "b", "x", "y"]].assign(joined=said)

    while True:
        at = left.join(home.select(F.col("skill").alias("a"), F.col("cluster").alias("x")), "a").join(home.select(F.col("skill").alias("b"), F.col("cluster").alias("y")), "b").where(F.col("x") != F.col("y"))
        at = cut(at.select("a", "b", "score", "x", "y"))
        if not at.limit(1).count():
            break
        ends = at.select("*", F.explode(F.array("x", "y")).alias("c"))
        first = ends.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy(*order))).where(F.col("_r") == 1)
        ready = first.groupBy("a", "b", "x", "y").agg(F.count("*").alias("k")).where(F.col("k") == 2).drop("k")
        groups = home.join(facts, "skill").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("skill", "n", "v"))).alias("m"))
        told = ready.join(groups.select(F.col("cluster").alias("x"), F.col("m").alias("mx")), "x").join(groups.select(F.col("cluster").alias("y"), F.col("m").alias("my")), "y")
        decided = cut(told.select("a", "b", "x", "y", "mx", "my").mapInPandas(decide, "a string, b string, x string, y string, joined boolean"))
        left = cut(at.select("a", "b", "score").join(decided.select("a", "b"), ["a", "b"], "left_anti"), replaces=left)
        moved = decided.where("joined").select(F.col("y").alias("cluster"), "x")
        home = cut(home.join(moved, "cluster", "left").select("skill", F.coalesce("x", "cluster").alias("cluster")), replaces=home)
    heads = home.join(facts, "skill").groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("_n"), F.length("skill").alias("_l"), F.col("skill").alias("_s"))).alias("_h"))
    return home.join(heads, "cluster").select("skill", F.col("_h._s").alias("canonical")).where(F.col("skill") != F.col("canonical"))


def resolve_tiers(skills: DataFrame, auto: float = 0.9, low: float = 0.78, judge: Callable[[pd.DataFrame], pd.Series] | None = None, least: int = 5, kinds: tuple[str, ...] | None = None, most: int = MAX_CLUSTER, floor: float = 0.7) -> DataFrame:
    """``(skill, canonical, tier)``: pairs from ``auto`` up merge by themselves;
    pairs from ``low`` up are asked of ``judge`` on representatives, each pair
    once, when both are frequent, of an allowed kind and without conflict. ``skills`` has
    (skill, count, kind, vector)."""
    near = cut(near_pairs(skills, "skill", "vector", min(low, auto) if judge else auto, "kind"))
    sure = near.where(F.col("score") >= auto)
    first = cut(merge_clusters(sure, skills, most, floor))
    if judge is None:
        return first.withColumn("tier", F.lit("embedding"))
    facts = skills.select("skill", "count", "kind")

    def rep(side: str) -> DataFrame:
        return first.select(F.col("skill").alias(side), F.col("canonical").alias(f"_{side}"))

    band = near.where(F.col("score") < auto).join(rep("a"), "a", "left").join(rep("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "score")
    pairs = band.where(F.col("x") != F.col("y")).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"))
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("skill").alias(side), F.col("count").alias(f"n{side}"), F.col("kind").alias("kind" if side == "a" else "_kind_b")), side)
    pairs = pairs.where(F.least("na", "nb") >= least)
    if kinds:
        pairs = pairs.where(F.col("kind").isin(*kinds))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[not conflicting(x, y) for x, y in zip(b["a"], b["b"], strict=True)]]
            if len(b):
                yield b[np.asarray(judge(b), bool)]

    approved = pairs.select("a", "b", "score").mapInPandas(ask, "a string, b string, score double")
    final = merge_clusters(cut(sure.select("a", "b", "score").unionByName(approved)), skills, most, floor)
    told = first.select("skill", F.col("canonical").alias("_first"))
    return final.join(told, "skill", "left").select("skill", "canonical", F.when(F.col("_first") == F.col("canonical"), "embedding").otherwise("judged").alias("tier"))


def ask_in_batches(items: list, ask: Callable[[list], list], size: int = 25, missing: object = False) -> list:
    """Answers to items asked ``size`` at a time; a batch that fails is halved
    until it succeeds, a single failing item gives ``missing``."""
    if not items:
        return []
    if len(items) > size:
        return [x for at in range(0, len(items), size) for x in ask_in_batches(items[at : at + size], ask, size, missing)]
    try:
        return list(ask(items))
    except Exception:
        if len(items) == 1:
            return [missing]
        half = len(items) // 2
        return ask_in_batches(items[:half], ask, size, missing) + ask_in_batches(items[half:], ask, size, missing)


def apply_merges(mentions: DataFrame, merges: DataFrame, key: str = "posting_id") -> DataFrame:
    """Mentions under canonical names, each once per posting."""
    return mentions.join(merges.select("skill", "canonical"), "skill", "left").select(key, F.coalesce("canonical", "skill").alias("skill")).distinct()


def threshold_sweep(pairs: DataFrame, truth: Column, score: Column, candidates: list[float]) -> DataFrame:
    """``(threshold, tp, fp, fn, precision, recall, f1)`` of each candidate threshold, in one pass."""
    one = pairs.select(truth.cast("boolean").alias("_t"), score.alias("_s"))
    counts = one.agg(*[f for i, t in enumerate(candidates) for f in (F.count_if(F.col("_t") & (F.col("_s") >= t)).alias(f"tp{i}"), F.count_if(~F.col("_t") & (F.col("_s") >= t)).alias(f"fp{i}"), F.count_if(F.col("_t") & (F.col("_s") < t)).alias(f"fn{i}"))])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn")]) for i, t in enumerate(candidates)])).alias("r")).select("r.*")
    return with_scores(rows)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision (null without positives), recall and f1 (0 where either is missing or 0)."""
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return counts.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def choose_threshold(sweep: DataFrame, least: float = 0.95) -> DataFrame:
    """The lowest threshold precise enough; null if none is."""
    return sweep.agg(F.min(F.when(F.col("precision") >= least, F.col("threshold"))).alias("threshold"))
