import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import cooccurrence as P
from loomwork.llm import quantiles as Q
from loomwork.llm import topn as N


def test_top_n_against_plain(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), rng.randrange(300), rng.choice([0, 1, 2, 3, None]), rng.randrange(20)) for _ in range(2000)] + [(None, 1, 2, 1), ("d", None, 2, 1), ("d", 5, 1, None), ("d", 5, 2, 3), ("d", 5, 0, 3)]
    df = spark.createDataFrame(rows, "g string, i int, s int, t int").withColumn("rank", F.lit("clash"))
    latest = {}
    for g, i, s, t in rows:
        if g is not None and i is not None and s is not None and 0 <= s <= 2:
            key = (-1 if t is None else t, s)
            latest[g, i] = max(latest.get((g, i), (-2, -2)), key)
    want = set()
    for g in {g for g, _ in latest}:
        best = sorted((-s, i) for (h, i), (_, s) in latest.items() if h == g)[:10]
        want |= {(g, i, -s, r) for r, (s, i) in enumerate(best, 1)}
    for salts in (1, 7, 32):
        scored = N.latest_scores(df, "g", "i", "s", "t", F.col("s").between(0, 2))
        assert {tuple(r) for r in N.top_n(scored, 10, salts).collect()} == want
    assert N.top_n(N.latest_scores(df.limit(0), "g", "i", "s", "t"), 10).count() == 0
    with pytest.raises(ValueError):
        N.top_n(scored, 0)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_packed_latest_scores(spark, kind):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(40), rng.choice([-1, 0, 1, 2, 3, None]), rng.choice([None, "1969-05-01 00:00:00.000001", "2024-01-01 10:00:00", "2024-01-01 10:00:00.000001"])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, s int, t string").withColumn("t", F.col("t").cast(kind))
    plain = N.latest_scores(df, "g", "i", "s", "t", F.col("s").between(0, 2))
    packed = N.latest_scores(df, "g", "i", "s", "t", between=(0, 2))
    assert packed.dtypes == plain.dtypes and sorted(packed.collect()) == sorted(plain.collect())


def _plain(baskets, least):
    n, pairs, each = len(baskets), Counter(), Counter()
    for items in baskets.values():
        each.update(items)
        pairs.update(combinations(sorted(items), 2))
    return {(a, b): (k, each[a], each[b], n) for (a, b), k in pairs.items() if k >= least}


@pytest.mark.parametrize("max_heavy", [1, 4, 256])
def test_pairs_against_plain(spark, max_heavy, monkeypatch):
    rng = random.Random(1)
    items = [f"i{k}" for k in range(30)]
    rows = [(b, items[min(int(rng.expovariate(0.2)), 29)]) for b in range(400) for _ in range(rng.randint(0, 9))]
    rows += [(7, i) for i in items] + [(None, "i1"), (3, None)] + [(5, "i0")] * 50
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    df = spark.createDataFrame(rows, "b long, i string").withColumn("n", F.lit(1))
    got = {(r["skill_a"], r["skill_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in P.associated_pairs(df, "b", "i", 5, 0, max_heavy).collect()}
    assert got == _plain(baskets, 5)
    lifted = {k: v for k, v in got.items() if v[0] * v[3] >= 1.5 * v[1] * v[2]}
    assert {(r["skill_a"], r["skill_b"]) for r in P.associated_pairs(df, "b", "i", 5, 1.5, max_heavy).collect()} == set(lifted)


@pytest.mark.parametrize("part", [1, 3, 8])
def test_large_baskets_in_parts_against_plain(spark, part, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 50)
    rng = random.Random(4)
    items = [f"i{k:02d}" for k in range(40)]
    baskets = {b: set(rng.sample(items, rng.choice([1, 2, 5, 30]))) for b in range(60)}
    df = spark.createDataFrame([(b, i) for b, some in baskets.items() for i in some], "b long, i string")
    pairs, totals = P.pair_counts(P.distinct_baskets(df, "b", "i"), 2, 4, part)
    n = totals.collect()[0]["n"]
    assert {(r["a"], r["b"]): (r["n_ab"], r["n_a"], r["n_b"], n) for r in pairs.collect()} == _plain(baskets, 2)


def test_one_basket_of_many_items_is_spread(spark):
    """No unit holds more than two parts, and every pair is counted once."""
    df = spark.range(6000).select(F.lit(1).cast("long").alias("b"), F.format_string("i%05d", "id").alias("i"))
    units = P.in_units(P.distinct_baskets(df, "b", "i").withColumn("_n", F.lit(1)).withColumn("_h", F.lit(False)), 500)
    sizes = [r["count"] for r in units.groupBy("_b", "_p").count().collect()]
    assert len(sizes) == 12 * 13 // 2 and max(sizes) < 2.4 * 500
    small = df.where("id < 1500")
    pairs, _ = P.pair_counts(P.distinct_baskets(small, "b", "i"), 1, 256, 200)
    got = pairs.agg(F.count("*"), F.max("n_ab")).collect()[0]
    assert tuple(got) == (1500 * 1499 // 2, 1)


def test_no_pairs(spark):
    df = spark.createDataFrame([(i, "only") for i in range(9)], "b long, i string")
    assert P.associated_pairs(df, "b", "i", 1, 0).count() == 0
    assert P.associated_pairs(df.limit(0), "b", "i", 1, 0).count() == 0


def test_block_of_one_huge_basket():
    n = 3000
    codes, counts = P.block_counts(np.zeros(n, np.int64), np.arange(n), np.arange(n) < 3, 3, n)
    assert len(codes) == n * (n - 1) // 2 and counts.min() == counts.max() == 1


def test_key_keeps_order(spark):
    xs = [-float("inf"), -1e300, -2.5, -1e-310, 0.0, -0.0, 1e-310, 1.0, 1.0000000000000002, 7.5, 1e300, float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Q.order_key(F.col("x")).alias("k"))
    rows = df.collect()
    for a in rows:
        for b in rows:
            assert (a["x"] < b["x"]) == (a["k"] < b["k"])
    assert all(r["x"] == r["y"] for r in df.select("x", Q.key_value(F.col("k")).alias("y")).collect())


def test_key_is_the_bits_of_the_double(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 4000).view(np.float64)
    powers = np.ldexp(1.0, np.arange(-1074, 1024))
    x = np.concatenate([x[~np.isnan(x)], powers, -powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), rng.lognormal(2, 2, 2000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", Q.order_key(F.col("x")).alias("k"))
    for r in df.select("x", "k", Q.key_value(F.col("k")).alias("y")).collect():
        bits = int(np.float64(abs(r["x"])).view(np.int64))
        assert r["k"] == (bits if r["x"] >= 0 else -bits - 1) and r["x"] == r["y"]


def test_a_level_is_one_join(spark):
    """The plan doesn't grow with the levels before."""
    q = Q.radix_quantiles(spark.createDataFrame(_values(), "g string, x double"), ["g"], "x", QS)
    plan = q._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Window [") <= 1


QS = (0.0, 0.1, 0.5, 0.75, 1.0)


def _values():
    rng = np.random.default_rng(4)
    rows = [("a", float(x)) for x in rng.lognormal(2, 2, 700)] + [("b", -float(x)) for x in rng.lognormal(0, 1, 101)]
    return rows + [("c", 5.0)] * 300 + [("c", 5.5), ("d", 1.0), ("e", None), ("e", float("nan")), (None, 3.0), ("b", 0.0), ("b", -0.0)]


def test_exact_quantiles(spark):
    rows = _values()
    df = spark.createDataFrame(rows, "g string, x double").withColumn("n", F.lit("clash"))
    got = {r["g"]: (r["n"], r["q"]) for r in Q.radix_quantiles(df, ["g"], "x", QS).collect()}
    assert set(got) == set("abcd")
    for g in "abcd":
        x = np.array([v for k, v in rows if k == g])
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, QS), rtol=1e-12)
    assert Q.radix_quantiles(df.limit(0), ["g"], "x", QS).count() == 0
    with pytest.raises(ValueError):
        Q.radix_quantiles(df, ["g"], "x", (2.0,))


@pytest.mark.parametrize("bits", [16, 23])
def test_combined_summaries_within_bound(spark, bits):
    rows = _values()
    df = spark.createDataFrame([(i % 5, *r) for i, r in enumerate(rows)], "day int, g string, x double")
    parts = [Q.summarize(df.where(F.col("day") == d), ["g"], "x", bits) for d in range(5)]
    whole = Q.summarize(df, ["g"], "x", bits)
    joined = Q.combine(parts)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, whole.collect()))
    got = {r["g"]: (r["n"], r["q"]) for r in Q.summary_quantiles(joined, QS, bits).collect()}
    for g in "abcd":
        x = np.sort([v for k, v in rows if k == g])
        assert got[g][0] == len(x)
        for q, estimate in zip(QS, got[g][1], strict=True):
            true = x[max(1, int(np.ceil(q * len(x)))) - 1]
            assert abs(estimate - true) <= 2.0 ** (11 - bits) * abs(true) + 1e-300
