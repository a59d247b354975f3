import random
import re
import unicodedata

import pytest

from loomwork.operators import packed as P

NAMES = ["ci/cd", "r&d", "sổ sách và chứng từ", "an toàn, vệ sinh lao động", "xuất - nhập khẩu", "excel", "python", "c++", "tư vấn"]
USE = [k for k in P.used_delimiters(P.USUALLY) if k not in P.SELDOM]


@pytest.fixture(scope="module")
def splitter():
    return P.Splitter(NAMES, USE)


@pytest.mark.parametrize(
    ("cell", "expected"),
    [
        ("a, b; c", ["a", "b", "c"]),
        ("A | B || C|", ["A", "B", "C"]),
        ("x/y", ["x", "y"]),
        ("CI/CD, Python", ["CI/CD", "Python"]),
        ("An toàn, vệ sinh lao động.", ["An toàn, vệ sinh lao động."]),
        ("Xuất - Nhập Khẩu – Excel", ["Xuất - Nhập Khẩu", "Excel"]),
        ("do-kiem, A - B", ["do-kiem", "A", "B"]),
        ("R&D & Excel", ["R&D", "Excel"]),
        ("C++ + Excel", ["C++", "Excel"]),
        ("Sổ Sách Và Chứng Từ và Excel", ["Sổ Sách Và Chứng Từ", "Excel"]),
        ("Excel hoặc Python", ["Excel", "Python"]),
        ('"Vải, da và lụa";Python', ["Vải, da và lụa", "Python"]),
        ('Python,"Excel ""loại C"""', ["Python", 'Excel "loại C"']),
        ("['Nhập liệu / đối soát', 'Python']", ["Nhập liệu / đối soát", "Python"]),
        ('["a", "b"]', ["a", "b"]),
        ("1. a\n2. b\n3. c", ["a", "b", "c"]),
        ("1/ a\n2/ b", ["a", "b"]),
        ("(1) a, (2) b", ["a", "b"]),
        ("  1. a 2. b ", ["a", "b"]),
        ("- a\n- b", ["a", "b"]),
        ("• a • b", ["a", "b"]),
        ("Excel (làm tốt, làm nhanh), Python", ["Excel (làm tốt, làm nhanh)", "Python"]),
        (", a, ,b,", ["a", "b"]),
        ("it's, that's", ["it's", "that's"]),
        ("(a, b", ["(a", "b"]),
        ("Telesales;", ["Telesales"]),
        ("   ", []),
        ("", []),
        (None, []),
    ],
)
def test_split(splitter, cell, expected):
    assert splitter.split(cell) == expected


def test_decomposed_text_keeps_its_spelling(splitter):
    cell = unicodedata.normalize("NFD", "Sổ sách và chứng từ và tư vấn")
    assert splitter.split(cell) == [unicodedata.normalize("NFD", "Sổ sách và chứng từ"), unicodedata.normalize("NFD", "tư vấn")]


def test_random_lists_round_trip(splitter):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    item = st.text("abcxyzđếo ", min_size=1, max_size=8).map(lambda s: " ".join(s.split())).filter(bool)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(item, min_size=2, max_size=6), st.sampled_from([", ", ";", " | ", "\n", " - ", "、"]))
    def check(items, sign):
        assert splitter.split(sign.join(items)) == items

    check()


def test_inference_and_rows(spark):
    rows = [(i, "a", "excel, python", "k") for i in range(40)] + [(100, "a", "node.js; excel", "k"), (101, None, "excel|python", "k"), (102, "b", None, "k"), (103, "b", "excel", "k"), (None, "b", "excel/python", "k"), (105, "a", "x, " * 4000 + "y", "k")]
    df = spark.createDataFrame(rows, "mention_id long, source string, raw string, item string")
    found = {r["source"]: P.used_delimiters(r["uses"]) for r in P.infer_delimiters(df, "source", "raw", NAMES).collect()}
    assert "," in found["a"] and "dot" not in found["a"] and found["b"] == P.used_delimiters(P.USUALLY)
    out = P.split_values(df, "mention_id", "source", "raw", NAMES)
    assert out.dtypes == [("mention_id", "bigint"), ("pos", "int"), ("item", "string")]
    got = {(r[0], r[1]): r[2] for r in out.collect()}
    assert got[0, 1] == "excel" and got[0, 2] == "python" and got[100, 1] == "node.js" and got[101, 2] == "python" and got[None, 2] == "python"
    assert (103, 1) not in got and got[105, 4001] == "y"
    assert P.split_values(df.limit(0), "mention_id", "source", "raw", NAMES).count() == 0


def _sources(spark):
    """'colons' separates by ':' and '_' alone, 'paths' has '/' within values only, 'plain' has few cells."""
    rng = random.Random(3)
    names = ["excel", "python", "word", "kế toán"]
    rows = [("colons", rng.choice((":", " : ", "_")).join(rng.sample(names, rng.randint(2, 3)))) for _ in range(60)]
    rows += [("paths", f"dự án {i}/phần {j}") for i in range(12) for j in range(5)] + [("paths", "excel, python")] * 20
    rows += [("plain", "word: excel"), ("plain", "word/excel"), (None, "a_b: c")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "mention_id long, source string, raw string")


def test_a_source_is_split_by_what_it_uses(spark, monkeypatch):
    df = _sources(spark)

    def split():
        out = {}
        for r in P.split_values(df, "mention_id", "source", "raw", NAMES).collect():
            out.setdefault(r["mention_id"], {})[r["pos"]] = r["item"]
        return {k: [v[i + 1] for i in range(len(v))] for k, v in out.items()}

    got = split()
    cells = {r["mention_id"]: r for r in df.collect()}
    for k, r in cells.items():
        if r["source"] == "colons":
            assert got[k] == [x.strip() for x in re.split("[:_]", r["raw"])]
        elif r["source"] == "paths":
            assert got.get(k) == (["excel", "python"] if "," in r["raw"] else None)
        else:
            assert got.get(k) == (["word", "excel"] if "/" in r["raw"] else None)
    usual = df.sparkSession.createDataFrame([], "source string, uses int")
    monkeypatch.setattr(P, "infer_delimiters", lambda *a: usual)
    skipped = split()
    assert sum(skipped.get(k) == v for k, v in got.items()) < len(got) / 2


def test_all_bits_are_used_names():
    assert P.used_delimiters((1 << len(P.CANDIDATES)) - 1) == tuple(P.CANDIDATES)
    assert set(P.used_delimiters(P.USUALLY)) == set(P.CANDIDATES) - P.NEVER_USUAL
