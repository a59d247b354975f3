import pytest

from loomwork.plans import labour

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tfidf_topk", "five_systems", "hybrid_search", "shown_matches"])
def test_every_cv_asks(spark, name):
    """No CV of this data has an id that 100 divides."""
    every = {r["cv_id"] for r in spark.read.parquet(f"{SF}/cvs.parquet").collect()}
    assert {r["cv_id"] for r in labour.QUERIES[name](spark, SF).select("cv_id").collect()} == every
