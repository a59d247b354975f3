import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwork.llm import canonical as C

REF = [(1, "python", None), (2, "java", None), (3, "javascript", ["ecmascript"]), (4, "c++", None), (5, "c#", None), (6, "giao tiếp", ["communication", "kỹ năng trao đổi"]), (7, "quản lý kho", ["warehouse management"]), (8, "quản lý hồ sơ", None), (9, "tiếng anh", ["english"]), (10, "tiếng hàn", None), (11, "telesales", None), (12, "bảo trì máy", None), (13, "r&d", None), (14, "sổ sách và chứng từ", None), (15, "chốt đơn", None), (16, "đọc bản vẽ kỹ thuật", None), (17, "sketchup", None)]


@pytest.fixture(scope="module")
def matcher():
    return C.Matcher(REF)


@pytest.mark.parametrize(
    ("value", "context", "expected"),
    [
        ("Python", None, 1),
        ("pnthon", None, 1),
        ("giao tiep", None, 6),
        (unicodedata.normalize("NFD", "giao tiếp"), None, 6),
        ("giao tieeps", None, 6),
        ("chốt ddown", None, 15),
        ("Communication", None, 6),
        ("ky nang trao doi", None, 6),
        ("Thành thạo giao tiếp tốt", None, 6),
        ("java 10+", None, 2),
        ("java v4", None, 2),
        ("javaxcript", None, 3),
        ("telexales", None, 11),
        ("bảo trì mái", None, 12),
        ("skettrup", None, 17),
        ("c plus plus", None, 4),
        ("cpp", None, 4),
        ("C#", None, 5),
        ("r and d", None, 13),
        ("r n d", None, 13),
        ("sổ sách với chứng từ", None, 14),
        ("quanlykho", None, 7),
        ("quản_lý-kho", None, 7),
        ("dbvkt", None, 16),
        ("tieng anh", None, 9),
        ("tieng han", None, 10),
        ("quản lý", "Biết Quản Lý Hồ Sơ", 8),
        ("quản lý", None, 0),
        ("cobol", None, 0),
        ("thuần dưỡng voi", None, 0),
        ("", None, 0),
        ("   ", None, 0),
        (None, None, 0),
        ("x" * 100_000, None, 0),
    ],
)
def test_resolve(matcher, value, context, expected):
    assert matcher.resolve(value, context) == expected


def test_automaton_against_plain_distance():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    trie = C.Trie()
    for w in words:
        trie.add(w, w)
    for _ in range(60):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        for k in (1, 2, 3):
            got = sorted(set(trie.within(q, k)))
            assert got == sorted({(C.distance(q, w), w) for w in words if C.distance(q, w) <= k})


def test_all_entries_within_the_bound(matcher):
    near = matcher.candidates("tieng ahn")
    assert {key for *_, key in near} == {9, 10}
    assert C.Matcher([]).resolve("python") == 0


def test_rows(spark):
    df = spark.createDataFrame([(1, "pythn", None, 0), (1, "pythn", None, 0), (2, None, "python", 0), (None, "Java 2", "x", 0), (3, "cobol", None, 0)], "mention_id long, skill string, raw string, id int")
    out = C.map_values(df, "mention_id", "skill", "raw", REF).select("mention_id", F.col("id"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(["(1, 1)", "(1, 1)", "(None, 2)", "(3, 0)"])
    assert C.map_values(df.limit(0), "mention_id", "skill", "raw", REF).count() == 0
    ref = spark.createDataFrame(REF, "skill_id long, skill string, also_called array<string>")
    assert C.load(ref, "skill_id", "skill", "also_called")[0] is not None
    with pytest.raises(ValueError):
        C.load(ref, "skill_id", "skill", "also_called", most=3)


def test_entries_of_one_letter_are_found():
    m = C.Matcher([(1, "R", None), (2, "C", None), (3, "C++", ["cpp"]), (4, "excel", None)])
    assert [m.resolve(x) for x in ("r", "R", "c", "C", "C++", "cpp", "x")] == [1, 1, 2, 2, 3, 3, 0]


def test_initials_are_paths_of_the_trie():
    rows = [(1, "quản trị nhân sự", None), (2, "quan hệ khách hàng", None), (3, "quản lý khách hàng", None), (4, "quy lý kho hàng", None)]
    m = C.Matcher(rows)
    assert any(kind == C.INITIALS for _, _, kind in m.trie.exact("qtns"))
    assert m.resolve("qtns") == 1 and m.resolve("QTNS tốt") == 1
    assert m.resolve("qlkh") == 0  # two entries have these
    assert m.resolve("qtnx") == 0  # initials count letter for letter


def test_spelling_is_a_parameter():
    rows = [(1, "excel", None)]
    assert C.Matcher(rows).resolve("rành excel") == 0
    assert C.Matcher(rows, C.Spelling(before=("rành",))).resolve("rành excel") == 1


def test_near_entries_gives_all_within_the_bound(spark):
    entries = [(1, "excel", None), (2, "excek", None), (3, "python", None)]
    df = spark.createDataFrame([("excelk",), ("excelk",), ("zzzzzz",), (None,), ("  ",)], "skill string").withColumn("id", F.lit("clash"))
    got = [tuple(r) for r in C.near_entries(df, "skill", entries).orderBy("rank").collect()]
    assert got == [("excelk", 1, 1.0, 1), ("excelk", 2, 1.0, 2)]
