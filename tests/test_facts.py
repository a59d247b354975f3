import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import association as A
from loomwork.operators import facts as X
from loomwork.operators import linking as L
from loomwork.operators import retrieval as S


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, "kế toán tổng hợp", "tài_chính", ["hà nội"], "1_2y", float(8 + i)) for i in range(6)] + [(10 + i, "thủ kho", "kho_vận", ["huế"], "none", 5.0) for i in range(3)] + [(20, "kế toán kho", "tài_chính", ["huế", "hà nội"], None, float("nan"))]
    postings = spark.createDataFrame(rows, "posting_id long, job_title_node string, category string, provinces array<string>, experience_level string, salary_mid double")
    mentions = spark.createDataFrame([(i, s) for i in range(6) for s in (["excel", "misa"] if i % 2 else ["excel"])] + [(10, "excel"), (20, "misa"), (20, "excel"), (20, "excel")], "posting_id long, skill string")
    return postings, mentions, A.pmi_pairs(mentions, "posting_id", "skill", least=2)


def _facts(spark, small, text, plan=False):
    names = L.Names(["tài_chính", "kho_vận"], {t: t for t in ("kế toán tổng hợp", "thủ kho", "kế toán kho")}, {s: s for s in ("excel", "misa")})
    asked = spark.createDataFrame([("q", text), ("empty", None)], "id string, text string").withColumn("values", F.lit("clash"))
    rows = X.question_facts(L.link_entities(asked, "id", "text", names), "id", *small, plan=plan).where("id = 'q'").collect()
    return {r["kind"]: r for r in rows}


def test_kinds_of_facts(spark, small):
    got = _facts(spark, small, "Lương kế toán tổng hợp ở Hà Nội, biết excel")
    assert got["salary"]["values"] == [10.5, 9.25, 11.75, 6.0] and got["salary"]["sources"][:2] == [2, 3]
    assert got["count"]["values"] == [6.0] and got["skill_rate"]["values"] == [100.0]
    assert got["top_skills"]["values"] == [100.0, 50.0] and "misa 50%" in got["missing_skills"]["text"] and "excel" not in got["missing_skills"]["text"]
    got = _facts(spark, small, "thủ kho ở huế")
    assert set(got) == {"insufficient", "count", "top_skills"} and got["insufficient"]["values"] == [3.0]
    assert set(_facts(spark, small, "lương kế toán tổng hợp ở nhật bản")) == {"out_of_scope"}
    assert set(_facts(spark, small, "lương kế toán tổng hợp năm 2019")) == {"out_of_scope"}
    got = _facts(spark, small, "ngành tài chính trả lương cao nhất cho ai")
    assert got["best_paid_titles"]["values"] == [10.5]
    got = _facts(spark, small, "kỹ năng nào hay đi cùng misa")
    assert set(got) == {"related_skills"} and got["related_skills"]["text"].startswith("misa hay đi cùng excel")
    assert "related_skills" in _facts(spark, small, "muốn làm kế toán tổng hợp, tôi biết excel", plan=True)
    assert not _facts(spark, small, "trời đẹp quá")


def _answers(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, refuse boolean, citations array<bigint>")


def test_worded_answers_are_checked(spark):
    facts = spark.createDataFrame([("a", "salary", "Lương 12,5 triệu.", [12.5], [1, 2]), ("b", "salary", "Lương 9 triệu.", [9.0], [3]), ("c", "insufficient", "Chỉ có 2 tin.", [2.0], [4])], "id string, kind string, text string, values array<double>, sources array<bigint>")
    asked = spark.createDataFrame([(k, "?") for k in "abcd"], "id string, text string")
    said = _answers(spark, [("a", "Khoảng 12,5 triệu", False, [1]), ("b", "Khoảng 19 triệu", False, [3]), ("c", "2 triệu", False, [4])])
    got = {r["id"]: r for r in X.answer_from_facts(facts, asked, "id", said.drop("refuse")).collect()}
    assert got["a"]["worded"] and got["a"]["text"].startswith("Khoảng")
    assert not got["b"]["worded"] and got["b"]["text"] == "Lương 9 triệu." and got["b"]["citations"] == [3]
    assert got["c"]["refuse"] and got["d"]["refuse"]


def test_scores_of_answers(spark):
    questions = spark.createDataFrame(
        [("s", "salary_title", "one_hop", 12.5, None, [1, 2]), ("c", "count_title_province", "one_hop", 30.0, None, [1]), ("r", "skill_rate", "one_hop", 50.0, None, []), ("n", "best_paid_title", "multi_hop", 20.0, "kế toán; thủ kho", []), ("o", "foreign", "out_of_scope", None, None, []), ("f", "salary_title", "one_hop", 5.0, None, [])],
        "id string, type string, group string, number double, name string, ids array<bigint>",
    )
    good = _answers(spark, [("s", "12,6 triệu", False, [1, 9]), ("c", "30 tin", False, []), ("r", "50,2%", False, None), ("n", "Kế toán, thủ kho: 20 triệu", False, []), ("o", "không có", True, []), ("f", "không rõ", True, [])])
    got = {r["id"]: r for r in X.score_answers(good, questions, "id").collect()}
    assert all(got[k]["correct"] for k in "scrno") and not got["f"]["correct"] and got["f"]["false_refusal"]
    assert got["s"]["citation_precision"] == 0.5 and got["c"]["citation_precision"] is None
    bad = _answers(spark, [("s", "12,8 triệu", False, []), ("c", "31 tin", False, []), ("r", "50,3%", False, []), ("n", "kế toán 20", False, []), ("o", "12 triệu", False, [])])
    got = {r["id"]: r for r in X.score_answers(bad, questions, "id").collect()}
    assert not any(r["correct"] for r in got.values()) and got["f"]["false_refusal"] and not got["o"]["false_refusal"]


def test_altered_facts_are_refused(spark):
    from loomwork.plans import labour

    rows = labour.verified_facts(spark, "/root/testdata/sf0.001").collect()
    assert {r["shape"] for r in rows} == {"as said", "other figure", "foreign source"}
    assert all(r["ok"] == (r["shape"] == "as said") for r in rows)


def test_encoders(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "c d e")], "k int, t string").withColumn("vector", F.lit("clash"))
    got = {r["k"]: r["vector"] for r in S.encoded(texts, "k", "t", lambda ts: np.array([[len(t), 1.0] for t in ts]), size=2).collect()}
    assert got[1] == got[3] and got[2] == [0.0, 1.0] and np.isclose(np.linalg.norm(got[4]), 1)
    got = {r["k"]: r["vector"] for r in S.hashed_vectors(texts, "k", "t", 16).collect()}
    assert set(got) == {1, 3, 4} and got[1] == got[3] and np.isclose(np.linalg.norm(got[4]), 1, atol=1e-6)
