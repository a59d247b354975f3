import pytest

from loomwork.operators import units as U

RATES = {("money", "VND"): 0.001, ("money", "thousand VND"): 1.0, ("money", "million VND"): 1000.0, ("money", "USD"): 25.0, ("money", "JPY"): 0.2} | {("pay_period", p): f for p, f in (("month", 1.0), ("year", 1 / 12), ("week", 4.0), ("day", 26.0), ("hour", 208.0))} | {("experience", "month"): 1.0, ("experience", "year"): 12.0, ("experience", "week"): 0.25}
FEEDS = {"millions": ("million VND per month", "year"), "hourly": ("thousand VND per hour", "month"), "dollars": ("USD per month", "week")}


@pytest.fixture(scope="module")
def converter():
    return U.Converter(RATES, FEEDS)


@pytest.mark.parametrize(
    ("cell", "expected"),
    [
        ("10.0 - 15.0 triệu", (10000, 15000)),
        ("18,5 triệu", (18500, 18500)),
        ("12tr5", (12500, 12500)),
        ("13 triệu 500 / tháng", (13500, 13500)),
        ("Từ 9,5 triệu tới 12tr5 net", (9500, 12500)),
        ("5 triệu rưỡi", (5500, 5500)),
        ("Từ 9300 đến 14,600 ngàn/tháng", (9300, 14600)),
        ("36 300 000 VNĐ", (36300, 36300)),
        ("120tr/năm", (10000, 10000)),
        ("74-95K/giờ", (74 * 208, 95 * 208)),
        ("500k một ngày", (13000, 13000)),
        ("Từ $4.8k tới 6,000 đô la / năm", (10000, 12500)),
        ("US$ 700 ~ US$ 900/th", (17500, 22500)),
        ("¥140,000 ~ ¥190,000/month", (28000, 38000)),
        ("Lên đến 15 triệu", (-1, 15000)),
        ("Upto 15tr + hoa hồng", (-1, 15000)),
        ("> 8.5 triệu VNĐ/month", (8500, -1)),
        ("Từ 20 triệu (gross)", (20000, -1)),
        ("2,4 triệu mỗi tuần", (9600, 9600)),
        ("8.0 - 0.0 triệu", None),
        ("0.0 triệu", None),
        ("Thỏa thuận", None),
        ("", None),
        (None, None),
    ],
)
def test_pay(converter, cell, expected):
    assert converter.convert(cell, U.MONEY, "dollars", (None, None)) == expected


def test_unit_of_text_then_feed(converter):
    assert converter.convert("80 - 90", U.MONEY, "millions", ("Con số lương là nghìn đồng cho mỗi giờ làm.", None)) == (80 * 208, 90 * 208)
    assert converter.convert("80 - 90", U.MONEY, "millions", (None, "Mức lương tính bằng JPY mỗi tháng.")) == (16, 18)
    assert converter.convert("80", U.MONEY, "hourly", ("Lập báo cáo tuần, lưu trữ chứng từ theo tháng tại lâm đồng.", None)) == (80 * 208,) * 2
    assert converter.convert("80", U.MONEY, "nobody", (None, None)) is None
    # a written unit without a period is per month whatever the text says
    assert converter.convert("9 triệu", U.MONEY, "hourly", ("Lương trả theo giờ, đơn vị nghìn đồng.", None)) == (9000, 9000)


@pytest.mark.parametrize(
    ("cell", "feed", "expected"),
    [
        ("2 năm", None, (24, 24)),
        ("2-3 năm", None, (24, 36)),
        ("9 - 15 tháng", None, (9, 15)),
        ("Dưới 3 năm", None, (-1, 36)),
        ("5+ years", None, (60, -1)),
        ("3 năm trở lên", None, (36, -1)),
        ("2 năm 6 tháng", None, (30, 30)),
        ("2y 3m", None, (27, 27)),
        ("một năm rưỡi", None, (18, 18)),
        ("nửa năm", None, (6, 6)),
        ("năm năm", None, (60, 60)),
        ("6m", None, (6, 6)),
        ("12 tuần thực tập", None, (3, 3)),
        ("2", "millions", (24, 24)),
        ("7+", "millions", (84, -1)),
        ("12", "hourly", (12, 12)),
        ("Không yêu cầu kinh nghiệm", None, (0, 0)),
        ("No experience required", None, (0, 0)),
        ("Theo vị trí", "millions", None),
        ("3", None, None),
    ],
)
def test_experience(converter, cell, feed, expected):
    assert converter.convert(cell, U.EXPERIENCE, feed, (None, None)) == expected


def test_ambiguous_pieces_follow_the_field():
    assert U.segment("m", U.MONEY).scale == 1e6
    assert U.segment("m", U.EXPERIENCE).time == "month"
    assert U.segment("nghìn đồng / giờ", U.MONEY) == U.Unit(1e3, "VND", "hour")
    assert U.segment("hợp đồng", U.MONEY) == U.NONE


def test_rows_with_nulls_repeats_and_long_texts(spark):
    rates = spark.createDataFrame([(q, u, f) for (q, u), f in RATES.items()], "quantity string, unit string, factor double")
    feeds = spark.createDataFrame([(f, a, b) for f, (a, b) in FEEDS.items()], "feed string, salary_unit string, experience_unit string")
    long = "Mô tả công việc. " * 5000 + "Lương trả theo giờ, đơn vị nghìn đồng."
    rows = [(1, "millions", "9", "2", None, None), (1, "millions", "9", "2", None, None), (2, None, None, None, None, None), (None, "hourly", "50", None, "", None), (3, "millions", "60", " ", long, None)]
    df = spark.createDataFrame(rows, "row_id long, feed string, salary string, experience_required string, description string, requirements_text string").selectExpr("*", "'x' AS low", "'y' AS fieldname")
    out = U.convert_amounts(df, "row_id", "feed", {"salary": U.MONEY, "experience_required": U.EXPERIENCE}, ("description", "requirements_text"), rates, feeds)
    got = sorted((str(r[0]), *r[1:]) for r in out.collect())
    assert got == sorted([("1", "salary", 9000, 9000)] * 2 + [("1", "experience_required", 24, 24)] * 2 + [("None", "salary", 50 * 208, 50 * 208), ("3", "salary", 60 * 208, 60 * 208)])
    assert out.limit(0).count() == 0
    assert U.convert_amounts(df.limit(0), "row_id", "feed", {"salary": U.MONEY}, ("description",), rates, feeds).count() == 0


FEW_RATES = {("money", "VND"): 0.001, ("pay_period", "month"): 1.0, ("experience", "month"): 1.0, ("experience", "year"): 12.0, ("experience", "day"): 1 / 30}


def test_parts_of_an_experience_take_their_rates_from_the_table():
    c = U.Converter(FEW_RATES, {})
    assert c.convert("2 năm 60 ngày", U.EXPERIENCE, None, ()) == (26, 26)
    without = U.Converter({k: v for k, v in FEW_RATES.items() if k[1] != "day"}, {})
    assert without.convert("2 năm 60 ngày", U.EXPERIENCE, None, ()) is None
    half = U.Converter(FEW_RATES | {("experience", "year"): 10.0}, {})
    assert half.convert("2 năm 6 tháng", U.EXPERIENCE, None, ()) == (26, 26)


def test_several_range_signs_and_loose_figures():
    c = U.Converter(FEW_RATES, {})
    assert c.convert("1 - 3 - 5 năm", U.EXPERIENCE, None, ()) == (12, 60)
    assert c.convert("8 triệu - 10 triệu - 12 triệu", U.MONEY, None, ()) == (8000, 12000)
    assert c.convert("12 triệu đồng ca 8 tiếng 26 buổi", U.MONEY, None, ()) == (12000, 12000)
