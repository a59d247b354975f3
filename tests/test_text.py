import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwork.functions import jsons as J
from loomwork.functions import text as T
from loomwork.operators import cleaning as C


def test_norm_and_surface(one):
    assert one(T.surface("s"), s=unicodedata.normalize("NFD", "  Kế   Toán. ,")) == "kế toán"
    assert one(T.tone_new_style("s"), s="hòa thúy khỏe thủy") == "hoà thuý khoẻ thuỷ"


def test_tokens(one):
    assert one(T.tokens("s"), s="Phần mềm kế toán") == ["phần", "mềm", "kế", "toán", "phần_mềm", "mềm_kế", "kế_toán"]
    assert one(T.tokens("s"), s="một") == ["một"]
    assert one(T.tokens("s"), s="") == [] and one(T.tokens("s"), s=None) == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [("lương 12.500.000 đồng", [12.5]), ("12tr5", [12.5]), ("1.178 tin", [1178.0]), ("14,5 triệu và 12.5", [14.5, 12.5]), ("xem [#1234] năm 2025", []), ("#77 có 3 tin", [3.0]), ("", []), (None, [])],
)
def test_numbers(one, text, expected):
    assert one(T.numbers("s"), s=text) == expected


def test_number_text(one):
    for x, expected in (("12.5", "12,5"), ("12.0", "12"), (None, None)):
        assert one(T.number_text(F.col("s").cast("double")), s=x) == expected
    assert one(T.number_text(F.col("s").cast("double"), percent=True), s="0.509") == "50,9%"


def test_years_and_paths(one):
    assert one(T.other_years("s"), s="năm 2023, 2025 và 1999; mã 20231") == [1999, 2023]
    assert T.unquote_path('"th\\341\\273\\255.py"') == "thử.py" and T.unquote_path("plain.py") == "plain.py"


def test_json_answers(one):
    assert one(J.without_thinking("s"), s="<think>\nx</think> ok") == "ok"
    assert one(J.json_part("s"), s='nói: {"a": 1} hết') == '{"a": 1}'
    got = one(J.judgements("s", 3), s='{"answers": [{"id": 1, "same": true}, {"id": 9, "same": true}]}')
    assert got["same"] == [True, False, False] and not got["complete"]
    assert one(J.judgements("s", 2), s="broken")["same"] == [False, False]
    assert one(J.grades("s", 3), s='[{"id": 1, "grade": 2}, {"id": 3, "grade": 7}]') == [2, None, None]
    read = one(J.answer("s"), s='{"answer": "có", "refuse": true, "citations": [4, 5]}')
    assert (read["text"], read["refuse"], read["citations"]) == ("có", True, [4, 5])
    read = one(J.answer("s"), s="tin #12 và #13")
    assert read["citations"] == [12, 13] and read["refuse"] is False
    assert one(J.verdict("s", "v", {"đúng": "correct"}), s='{"v": "Đúng"}') == "correct"
    assert one(J.verdict("s", "v", {"đúng": "correct"}), s="không") is None


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Hà Nội", ["hà nội"]), ("quận 7", ["hồ chí minh"]), ("hà nội, xyz abc", ["hà nội"]), ("TP. Đà Nẵng & tỉnh Bình Dương", ["đà nẵng", "hồ chí minh"]), ("Hòa Bình", ["phú thọ"]), ("Nhật Bản", ["foreign"]), (None, ["unknown"]), ("['Huế']", ["huế"])],
)
def test_places(one, raw, expected):
    assert one(C.provinces("s"), s=raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Nhân viên Kinh Doanh (lương cao)", "kinh doanh"),
        ("Kế toán trưởng - Hà Nội", "kế toán trưởng"),
        ("Sale Admin tại Huế", "sales admin"),
        ("Nữ thư ký", "thư ký"),
        ("Lái xe lương 10 triệu", "lái xe"),
        ("Kỹ sư / Giám sát", "kỹ sư"),
        ("Trợ lý biết tiếng Nhật", "trợ lý"),
    ],
)
def test_titles(one, raw, expected):
    assert one(C.title("s"), s=raw) == expected


def test_pay_and_experience(one):
    for s, m, low, high in (("10.0 - 15.0 triệu", "15", 10.0, 15.0), ("18.0 triệu", "18", 18.0, 18.0), ("0.0 triệu", "0", None, None), ("8.0 - 9.0 triệu", None, None, None), (None, "5", None, None)):
        got = one(C.pay_range("s", F.col("m").cast("int")), s=s, m=m)
        assert (got["low"], got["high"]) == (low, high)
    for x, band in (("5", "under_7m"), ("7", "7_10m"), ("49.9", "30_50m"), ("50", "50m_plus"), (None, None)):
        assert one(C.pay_band(F.col("s").cast("double")), s=x) == band
    for s, months in (("Không yêu cầu", 0.0), ("6 tháng", 6.0), ("1 năm", 12.0), ("nhiều", None), (None, None)):
        assert one(C.experience_months("s"), s=s) == months
    for x, level in (("0", "none"), ("6", "under_1y"), ("24", "1_2y"), ("30", "3_4y"), ("60", "5y_plus"), (None, None)):
        assert one(C.experience_level(F.col("s").cast("double")), s=x) == level


def test_schooling_and_lists(one, spark):
    for items, level in ((["đại học", "cao đẳng"], "college"), (["marketing"], "unspecified"), (["sau đại học"], "postgraduate"), ([], "unspecified")):
        array = F.array(*[F.lit(i) for i in items]).cast("array<string>")
        assert one(C.education(array)) == level
    assert one(C.majors(F.array(F.lit("kế toán"), F.lit("đại học")))) == ["kế toán"]
    assert one(C.languages("s"), s="Tiếng Anh, UNK, ") == ["tiếng anh"]
    for raw, items in (("['a', 'b']", ["a", "b"]), ("", []), (None, []), ("word", ["word"]), ("{'a': 1}", ["{'a': 1}"]), ("['a', None, ' ']", ["a", "None"])):
        assert C.read_list(raw) == items


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Tin học văn phòng (Word, Excel)", ["tin học văn phòng", "word", "excel"]), ("Tiếng Anh (nghe, nói)", ["tiếng anh"]), ("Tools: a, b", ["tools", "a", "b"]), ("a; b, c", ["a", "b", "c"]), ("", [])],
)
def test_compounds(one, raw, expected):
    assert one(C.compound_parts("s"), s=raw) == expected


@pytest.mark.parametrize(
    ("part", "expected"),
    [("ReactJS", "react"), ("React.js", "react"), ("React 17+", "react"), ("Thành thạo React js", "react"), ("d3.js", "d3.js"), ("Adobe Photoshop", "photoshop"), ("Microsoft Office", "tin học văn phòng"), ("Kỹ năng giao tiếp tốt", "giao tiếp"), ("kỹ năng", ""), ("3ds max", "3ds max")],
)
def test_canonical(part, expected):
    assert C.canonical(part) == expected


def test_skill_tables(spark):
    rows = [(1, "['ReactJS', 'Excel']", "['giao tiếp', 'react']"), (2, None, "['Giao tiếp']"), (3, "['Kỹ năng']", None)]
    df = spark.createDataFrame(rows, "posting_id long, technical_skills string, soft_skills string")
    parts = C.skill_parts(df, "posting_id", {"technical": "technical_skills", "soft": "soft_skills"})
    first = {(r["posting_id"], r["skill"]): r["source"] for r in C.first_mentions(parts, "posting_id").collect()}
    assert first == {(1, "react"): "technical", (1, "excel"): "technical", (1, "giao tiếp"): "soft", (2, "giao tiếp"): "soft"}
    kinds = {r["skill"]: r["kind"] for r in C.kinds(parts).collect()}
    assert kinds == {"react": "soft", "excel": "technical", "giao tiếp": "soft"}


def test_titles_of_rows(spark):
    df = spark.createDataFrame([("a b", "A b")] * 2 + [("a b", "a B")] * 2 + [("c", "C"), (None, None)], "norm string, job_title string")
    got = {r["norm"]: (r["job_title_node"], r["job_title_display"]) for r in C.title_columns(df, "job_title", "norm", 4).collect()}
    assert got == {"a b": ("a b", "A b"), "c": (None, "C"), None: (None, None)}
