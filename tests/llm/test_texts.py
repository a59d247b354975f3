import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import mixing as X
from loomwork.llm import packing as K
from loomwork.llm import tokens as Tk
from loomwork.llm import toxicity as Y


def test_token_counts(spark):
    encode = Tk.encoding(Tk.TOKENIZER).encode_ordinary
    texts = ["xin chào", "", None, "a" * 5000, "<|endoftext|>", "từ ngữ " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1))
    got = {r["doc_id"]: r["n_tokens"] for r in Tk.count_tokens(df, "doc_id", "text").collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_knapsack_against_plain():
    rng = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 20), 5)))
        values = np.array([rng.random() for _ in lengths])
        best, pick = K.knapsack(lengths, values, 23)
        plain = [0.0] * 24
        for w in range(1, 24):
            plain[w] = max([plain[w - 1], *(plain[w - n] + v for n, v in zip(lengths, values) if n <= w)])
        assert np.allclose(best, plain)
        filling = K.traced(pick, lengths, 23)
        assert sum(int(lengths[j]) * n for j, n in filling.items()) <= 23
        assert sum(values[j] * n for j, n in filling.items()) == pytest.approx(plain[23])


def _histogram(sizes):
    return {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}


def _best_fit(histogram, capacity):
    lengths = np.array(sorted(histogram))
    return sum(n for _, n in K.best_fit(lengths, np.array([histogram[int(k)] for k in lengths]), capacity))


RNG = np.random.default_rng(0)
HARD = {
    "uniform": RNG.integers(1, 2048, 20000),
    "middle": RNG.integers(600, 1401, 20000),
    "thirds": RNG.integers(500, 760, 20000),
    "worst for best fit": np.repeat([1045, 553, 532, 471], [6000, 6000, 6000, 12000]),
    "few": RNG.choice([700, 650, 610, 450, 333, 1100, 950, 290], 20000),
    "thirty": RNG.choice(RNG.integers(300, 900, 30), 20000),
}


@pytest.mark.parametrize("name", HARD)
def test_the_program_is_solved(name):
    """The value lies between the bound and a best-fit packing, and the plan within 1 % of the bound."""
    histogram = _histogram(HARD[name])
    plan = K.make_plan(histogram, 2048)
    simple = _best_fit(histogram, 2048)
    assert plan.bound - 1e-6 <= plan.value <= simple + 1e-6
    assert plan.bound - 1e-6 <= plan.containers <= min(simple, plan.bound * 1.01)
    if name not in ("uniform", "middle"):  # best fit itself is within 1 % there
        assert plan.containers < simple * 0.995


def test_without_priced_fillings_the_hard_cases_stay_far_off(monkeypatch):
    monkeypatch.setattr(K.Program, "price", lambda self, prices: [])
    for name in ("few", "thirty", "worst for best fit"):
        plan = K.make_plan(_histogram(HARD[name]), 2048)
        assert plan.containers > plan.bound * 1.02


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(3.5, 1, 800).astype(int), 1, 256)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
    plan = K.make_plan(histogram, 256)
    used, seen = np.zeros(plan.containers, int), {}
    ends = {}
    for length, rank, each, first, nxt in zip(plan.length, plan.rank, plan.each, plan.first, plan.first[1:] + [plan.containers], strict=True):
        ends.setdefault(first, []).append((length, rank, each))
    starts = [*sorted(ends), plan.containers]
    for first, end in zip(starts, starts[1:]):
        for length, rank, each in ends[first]:
            assert rank == seen.get(length, 0)
            seen[length] = rank + each * (end - first)
            used[first:end] += length * each
    assert seen == histogram and used.max() <= 256
    assert plan.containers <= np.ceil(sizes.sum() / 256) * 1.02 + 1


def test_packing_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 99)) for i in range(400)] + [(1000, 0), (1001, 250), (1002, 300), (1003, 100), (None, 5), (7, 40), (1004, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("container", F.lit("clash"))
    out = [tuple(r) for r in K.pack(df, "doc_id", "n_tokens", 100, rows_per_bucket=10).collect()]
    assert sorted(t for d, p, c, t in out if d == 1001) == [50, 100, 100]
    assert sorted(t for d, p, c, t in out if d == 1002) == [100, 100, 100]
    assert sum(t for *_, t in out) == sum(n or 0 for _, n in rows)
    fill = {}
    for _, _, c, t in out:
        fill[c] = fill.get(c, 0) + t
    assert max(fill.values()) <= 100 and len(fill) <= sum(fill.values()) / 100 * 1.05 + 2
    assert len([1 for d, p, c, t in out if p > 1]) == 4 and not [1 for d, *_ in out if d in (1000, 1004)]
    assert K.pack(df.limit(0), "doc_id", "n_tokens", 100).count() == 0


def test_equal_lengths_are_spread(spark):
    out = K.pack(spark.range(900).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("n")), "doc_id", "n", 100, rows_per_bucket=50)
    sizes = [r["pieces"] for r in K.container_fill(out).collect()]
    assert sum(sizes) == 900 and max(sizes) == 3 and len(sizes) == 300


WORDS = {"a": "mèo kêu sữa lông", "b": "xe máy xăng lốp", "c": "sách bút vở mực"}


def _corpus(spark, n=600):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[s].split()) for _ in range(rng.randint(5, 60))), s) for i, s in enumerate(rng.choices("abc", (6, 3, 1), k=n))]
    return spark.createDataFrame(rows + [(n, None, "a"), (n + 1, "", "b"), (n + 2, "mèo", None), (n + 3, "mèo", "unlisted")], "doc_id long, text string, source string")


def test_mixing_meets_shares(spark):
    docs = _corpus(spark).withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.25, 3), ("none there", 0.05, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = X.mix(docs, targets)
    rows = {r["source"]: r for r in X.shares(mixed).collect()}
    assert rows["none there"]["tokens"] == 0 and set(rows) == {"a", "b", "c", "none there"}
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.25)):
        assert rows[s]["share"] == pytest.approx(share / 0.95, abs=0.012) and rows[s]["most_repeats"] <= rows[s]["max_repeats"]
    # the largest total: some source is used to its cap
    assert any(r["most_repeats"] == r["max_repeats"] for r in rows.values())
    assert mixed.chosen.where("doc_id >= 600").count() == 0
    small = X.mix(docs, targets, total=2000).chosen
    assert small.agg(F.sum(F.col("repeats") * F.col("tokens"))).collect()[0][0] == pytest.approx(2000, rel=0.1)


def _mislabelled(spark, n=3000):
    """A tenth of the documents stand under another source than their text's."""
    rng = random.Random(8)
    rows = []
    for i, s in enumerate(rng.choices("abc", (7, 2, 1), k=n)):
        text = " ".join(rng.choice(WORDS[s].split()) for _ in range(rng.randint(8, 40)))
        rows.append((i, text, s if rng.random() > 0.1 else rng.choice("abc".replace(s, "")), s))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, truth string")


SHARES = {"a": 0.35, "b": 0.4, "c": 0.25}


def _domain_shares(docs, chosen):
    rows = chosen.join(docs.select("doc_id", "truth"), "doc_id").groupBy("truth").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()
    total = sum(r["t"] for r in rows)
    return {r["truth"]: r["t"] / total for r in rows}


def test_mixing_counts_documents_where_their_texts_belong(spark, monkeypatch):
    docs = _mislabelled(spark)
    targets = spark.createDataFrame([(s, x, 3) for s, x in SHARES.items()], "source string, target_share double, max_repeats int")
    mixed = X.mix(docs, targets)
    fit = mixed.fit
    assert len(fit.steps) > 0 and np.abs(fit.expected - fit.wanted).max() <= 0.005 * fit.wanted.sum()
    got = _domain_shares(docs, mixed.chosen)
    assert all(abs(got[s] - x) < 0.015 for s, x in SHARES.items())
    # neither the flat rate without steps nor the stored source alone meets the targets
    monkeypatch.setattr(X, "fit_rates", lambda groups, caps, wanted, held: X.Fit(float(wanted.sum() / held.sum()), [], wanted, wanted))
    flat = _domain_shares(docs, X.mix(docs, targets).chosen)
    assert max(abs(flat[s] - x) for s, x in SHARES.items()) > 0.1
    monkeypatch.undo()
    monkeypatch.setattr(X, "combined", lambda told, k, held: (np.eye(told.shape[1])[k] * X.STEPS).astype(np.int16))
    stored = _domain_shares(docs, X.mix(docs, targets).chosen)
    assert max(abs(stored[s] - x) for s, x in SHARES.items()) > 0.03


def test_mixing_draws_documents_of_no_source_by_their_texts(spark):
    docs = _mislabelled(spark, 900).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    targets = spark.createDataFrame([(s, x, 2) for s, x in SHARES.items()], "source string, target_share double, max_repeats int")
    assert X.mix(docs, targets).chosen.where("source is null").count() == 0
    every = X.mix(docs, targets, sourceless=True).chosen
    assert every.where("source is null").count() > 30
    got = _domain_shares(docs, every)
    assert all(abs(got[s] - x) < 0.03 for s, x in SHARES.items())


def test_mixing_with_many_repeats(spark):
    """A small source asked for dozens of times reaches its share."""
    docs = _corpus(spark)
    targets = spark.createDataFrame([("a", 0.2, 1), ("c", 0.8, 40)], "source string, target_share double, max_repeats int")
    rows = {r["source"]: r for r in X.shares(X.mix(docs, targets)).collect()}
    assert rows["c"]["share"] == pytest.approx(0.8, abs=0.01) and rows["c"]["most_repeats"] > 5


def test_mixing_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    docs = _corpus(spark, 5).limit(0)
    mixed = X.mix(docs, targets)
    assert mixed.chosen.count() == 0 and [r["share"] for r in X.shares(mixed).collect()] == [0.0]
    none = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert X.mix(_corpus(spark, 5), none).chosen.count() == 0


def test_memberships_follow_text_and_source():
    tables = np.zeros((X.FOLDS, 2, X.BUCKETS))
    mine, other = X.word_buckets(WORDS["a"]), X.word_buckets(WORDS["b"])
    tables[:, 0, mine], tables[:, 1, other] = 50, 50
    log = X.log_tables(tables)[0]
    flat = np.array([*mine, *other])
    told = X.text_memberships(flat, np.array([0, len(mine), len(flat), len(flat)]), log)
    assert told[0, 0] > 0.99 and told[1, 1] > 0.99 and np.allclose(told.sum(axis=1), 1)
    q = X.combined(told, np.array([0, 0, 0]), np.array([[90.0, 10.0], [10.0, 90.0]]))
    assert q[0, 0] > 250 and q[1, 1] > 250 and q[2, 0] == round(0.9 * X.STEPS)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("n.g.u quá", "ngu quá"),
        ("đ*ồ* ngốc", None),
        ("m*à*y l à đ-ồ", "mày là"),
        ("mày​ l​à", "mày là"),
        ("nhhhhhà màyyyy", "nhà mày"),
        ("y0u 4r3", "you are"),
        ("năm 2025 có 30 người", "năm 2025 có 30 người"),
    ],
)
def test_undisguise(text, expected):
    got = Y.undisguise(text)
    if expected:
        assert got.startswith(expected)


def test_masks_are_guessed():
    unmask = Y.counted([["toan", "lu", "khon", "nan"]] * 5 + [["nha", "may"]] * 3)
    assert unmask(["lu", "khon", "na*"]) == ["lu", "khon", "nan"] and unmask(["z*q"]) == ["zq"]


INSULTS = ["đồ ngu", "thằng khốn", "đồ cặn bã", "lũ chó má"]
FILLER = ["Mức lương ổn định.", "Đồng nghiệp thân thiện.", "Ca tối hơi bận rộn.", "Hỏi nhiều về excel.", "Văn phòng gần chợ.", "Công ty có căng tin."]
CLEAR = ["Khi khách chửi đồ ngu, nhân viên giữ bình tĩnh.", "Quy định cấm gọi ai là thằng khốn.", "Cửa hàng tắm chó mèo."]


def _texts(n, seed):
    rng = random.Random(seed)
    texts, marked = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        parts = rng.sample(FILLER, 3)
        if bad:
            parts.insert(rng.randrange(4), f"Mày là {rng.choice(INSULTS)}, cút đi.")
        elif rng.random() < 0.4:
            parts.append(rng.choice(CLEAR))
        texts.append(" ".join(parts))
        marked.append(bad)
    return texts, marked


def test_held_out_accuracy_with_wrong_marks():
    texts, marked = _texts(500, 1)
    rng = random.Random(9)
    noisy = [m if rng.random() > 0.05 else not m for m in marked]
    machine, unmask = Y.learn(texts, np.array(noisy, np.int64))
    held, truth = _texts(300, 2)
    z, _ = Y._bag_scores(machine, [[Y.terms(unmask(s)) for s in Y.sentences(t)] for t in held])
    said = 1 / (1 + np.exp(-z)) >= machine.threshold
    assert (said == np.array(truth)).mean() > 0.95


def test_interactions_beat_single_words():
    """Two words are harmless alone and a case together: no additive weights can tell."""
    rng = random.Random(4)
    sets, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["insult" if a else "praise", "group" if b else "thing", rng.choice("pqrst")]
        rng.shuffle(words)
        sets.append(np.unique([__import__("zlib").crc32(w.encode()) & ((1 << Y.BITS) - 1) for w in words]))
        y.append(float(a == b))
    m = Y.fit(sets, np.array(y, np.float32), np.ones(len(y), np.float32), epochs=12)
    assert ((m.logits(*Y._flat(sets)) > 0) == (np.array(y) > 0)).mean() > 0.97


def test_scores_of_rows(spark):
    texts, marked = _texts(200, 1)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(900, None, None), (901, " \n ", "s"), (902, "Chào. " * 20000 + "Mày là đồ ngu, cút đi.", "s"), (903, "M*à*y l à đ.ồ n.g.u, cút đi.", "s")], "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, "abusive" if m else "none", "r") for i, m in enumerate(marked)] + [(0, None, "r"), (None, "none", "r")], "doc_id long, label string, rater string")
    model = Y.train(docs, labels, "doc_id", "text", "label")
    got = {r["doc_id"]: r["score"] for r in Y.score(docs, "doc_id", "text", model).collect()}
    t = model[0].threshold
    assert len(got) == 204 and got[900] == 0 and got[901] == 0 and got[902] >= t and got[903] >= t
    none = Y.train(docs, labels.limit(0), "doc_id", "text", "label")
    assert max(r["score"] for r in Y.score(docs, "doc_id", "text", none).collect()) < 0.01


def _without_factors(sets, y, weight, **settings):
    """Logistic regression on the same samples: the linear weights alone."""
    m = Y.Machine(0.0, np.zeros(1 << Y.BITS, np.float32), np.zeros((1 << Y.BITS, Y.FACTORS), np.float32))
    g = np.full(1 << Y.BITS, 1e-2, np.float32)
    ids, starts = Y._flat(sets)
    size = np.diff(np.r_[starts, len(ids)])
    x = 1 / np.sqrt(size)
    for _ in range(80):
        off = (1 / (1 + np.exp(-np.clip(m.logits(ids, starts), -30, 30))) - y) * weight
        d = np.bincount(ids, weights=np.repeat(off * x, size), minlength=1 << Y.BITS)
        g += d * d
        m.w -= 0.3 * d / np.sqrt(g)
        m.w0 -= 0.05 * off.mean()
    return m


GROUPS, SCORN = ["nhóm alpha", "dân beta", "bọn gamma", "người delta"], ["là rác rưởi", "đáng bị đuổi", "toàn lũ bẩn", "không phải người"]
THINGS, PRAISE = ["thùng số ba", "kho phía nam", "máy in cũ", "giấy vụn"], ["rất thân thiện", "làm việc giỏi", "được quý trọng", "luôn đúng giờ"]


def _pairs_of_meaning(n, seed, apart):
    """Scorn of a group is a case and scorn of a thing none; what is praise of a
    group is a case said of a thing, so no word tells by itself. With ``apart``
    who and what stand in neighbouring sentences, and only scorn of a group is a case."""
    rng = random.Random(seed)
    texts, marked = [], []
    for _ in range(n):
        group, scorn = rng.random() < 0.5, rng.random() < 0.5
        who, what = rng.choice(GROUPS if group else THINGS), rng.choice(SCORN if scorn else PRAISE)
        said = f"Đây là {who}. Tất cả {what}." if apart else f"{who} {rng.choice(['thì', 'ở đây', 'bao giờ cũng'])} {what}."
        texts.append(" ".join([*rng.sample(FILLER, 2), said, rng.choice(FILLER)]))
        marked.append(int(group and scorn if apart else group == scorn))
    return texts, np.array(marked)


def _right(texts, y, test, truth) -> float:
    machine, unmask = Y.learn(texts, y)
    p = 1 / (1 + np.exp(-Y._bag_scores(machine, [Y.bag(t, unmask) for t in test])[0]))
    return float(((p >= machine.threshold) == truth).mean())


def test_factors_beat_linear_weights_on_held_out_texts(monkeypatch):
    data = *_pairs_of_meaning(700, 5, False), *_pairs_of_meaning(300, 6, False)
    with_factors = _right(*data)
    monkeypatch.setattr(Y, "fit", _without_factors)
    assert with_factors > 0.97 and _right(*data) < 0.8


def test_insult_and_group_may_stand_in_neighbouring_sentences(monkeypatch):
    data = *_pairs_of_meaning(4000, 5, True), *_pairs_of_meaning(300, 6, True)
    with_neighbours = _right(*data)
    monkeypatch.setattr(Y, "bag", lambda t, unmask: [Y.terms(unmask(w)) for w in Y.sentences(t)])
    assert with_neighbours > 0.95 and _right(*data) < 0.9


def test_scorer_gives_the_scores_of_the_bags():
    texts, y = _texts(200, 2)
    machine, unmask = Y.learn(texts, y)
    more = [*texts[:50], None, "", "... !!", "một. hai. ba.", "Chào. " * 3000]
    plain = [max((1 / (1 + np.exp(-machine.logits(s, np.array([0]))[0])) for s in Y.bag(t, unmask) if len(s)), default=0.0) for t in more]
    assert np.allclose(Y.Scorer(machine, unmask)(more), plain, atol=1e-5)


@pytest.mark.parametrize("n", [500, 2500])
def test_held_out_models_see_four_fifths_at_every_size(n, monkeypatch):
    seen = []
    step = Y._step
    monkeypatch.setattr(Y, "fit", lambda *a, **k: Y.Machine(0.0, np.zeros(1 << Y.BITS, np.float32), np.zeros((1 << Y.BITS, Y.FACTORS), np.float32)))
    monkeypatch.setattr(Y, "_step", lambda bags, y, some, *a: seen.append(len(some)) or step(bags, y, some, *a))
    Y.learn(*_texts(n, 3))
    assert seen[:10] == [n * 4 // 5] * 10


def test_masks_are_resolved_by_words_of_all_documents(spark):
    """The clear words stand in unmarked documents only; pairs decide between two that fit."""
    marked = [(i, "Mày là rác thải, wor*hless b*t." if i % 2 else "Mức lương ổn định.") for i in range(12)]
    more = [(100 + i, t) for i, t in enumerate(["Quite worthless bat."] * 2 + ["a worthless bit"] * 3 + ["bat"] * 9 + ["once only"])]
    docs = spark.createDataFrame([*marked, *more, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "abusive" if i % 2 else "none") for i in range(12)], "doc_id long, label string")
    unmask = Y.train(docs, labels, "doc_id", "text", "label")[1]
    assert unmask(["wor*hless", "b*t"]) == ["worthless", "bit"]
    whole = Y.counted([s for _, t in [*marked, *more] for s in Y.sentences(t)])
    assert unmask.single == {w: n for w, n in whole.single.items() if w in ("worthless", "bat", "bit")}
    assert unmask.pairs == {p: n for p, n in whole.pairs.items() if p[0] == "worthless"}
