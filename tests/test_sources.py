import pytest
from pyspark.sql import functions as F

from loomwork.sources import files as S
from loomwork.streaming import windows as W


def test_csv_and_sheets(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('job_title,salary_max,description\n"a","5","line\nbreak ""q"""\nb,,\n', encoding="utf-8")
    got = [tuple(r) for r in S.read_postings_csv(spark, str(path)).orderBy("posting_id").collect()]
    assert got == [(0, "a", 5, 'line\nbreak "q"'), (1, "b", None, None)]
    sheet = spark.createDataFrame([("s-000", "0.9", ""), ("s-001", "x", "same")], "pair_id string, cosine string, label string")
    S.write_sheet(sheet, str(tmp_path / "sheet"))
    back = S.read_sheet(spark, str(tmp_path / "sheet"), ("cosine",)).orderBy("pair_id")
    assert [tuple(r) for r in back.collect()] == [("s-000", 0.9, ""), ("s-001", None, "same")]
    assert S.next_unlabelled(back, "pair_id").collect()[0][0] == "s-000"
    done = S.set_label(back, "pair_id", "s-000", "other", ("same", "other"))
    assert done.where(S.fully_labelled(["label"])).count() == 2
    with pytest.raises(ValueError):
        S.set_label(back, "pair_id", "s-000", "perhaps", ("same", "other"))


def test_json_env_and_report(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1.5, "b": "x"}\n{"a": NaN, "b": "y"}\nbroken\n', encoding="utf-8")
    rows = S.without_nan(S.read_jsonl(spark, str(tmp_path / "r.jsonl"), "a double, b string")).orderBy("b").collect()
    assert [tuple(r) for r in rows] == [(None, None), (1.5, "x"), (None, "y")]
    (tmp_path / ".env").write_text('# note\nA="1"\n\nB = two=2\n', encoding="utf-8")
    env = S.read_env(spark, str(tmp_path / ".env"))
    over = spark.createDataFrame([("A", "9"), ("C", "3")], "key string, value string")
    assert {r["key"]: r["value"] for r in S.overlaid(env, over).collect()} == {"A": "9", "B": "two=2", "C": "3"}
    table = S.markdown_table(spark.createDataFrame([("x", 0.5), ("y", None)], "k string, v double"), {"v": ".1%"})
    assert table.splitlines()[2:] == ["| x | 50.0% |", "| y | – |"]


def test_digests_and_fetch(spark, tmp_path):
    source = tmp_path / "a.bin"
    source.write_bytes(b"abc")
    d = S.digest(source)
    assert S.file_digests(spark, str(source)).collect()[0]["sha256"] == d
    got = S.fetch(source.as_uri(), tmp_path / "b" / "c.bin", d)
    assert got.read_bytes() == b"abc" and S.fetch("file:///nowhere", got, d) == got
    with pytest.raises(ValueError):
        S.fetch(source.as_uri(), tmp_path / "bad.bin", "0" * 64)
    assert not (tmp_path / "bad.bin").exists() and not (tmp_path / "bad.bin.part").exists()


def test_chunks_resume(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "row long, text string")
    mark = S.fingerprint_of(rows, "row", "text", 4)
    assert mark == S.fingerprint_of(rows.orderBy(F.desc("row")), "row", "text", 4) != S.fingerprint_of(rows.limit(9), "row", "text", 4)
    store = str(tmp_path / "store")
    todo = S.missing_chunks(rows, store, mark, 4)
    S.append_chunks(todo.where("chunk < 2"), store, mark)
    assert sorted(r["row"] for r in S.missing_chunks(rows, store, mark, 4).collect()) == [8, 9]
    with pytest.raises(ValueError):
        S.missing_chunks(rows, store, "other", 4)


def test_answer_cache(spark, tmp_path):
    asked = spark.createDataFrame([("p", "m", None), ("p", "m", "x")], "provider string, model string, prompt string").withColumn("key", S.cache_key("provider", "model", "prompt"))
    S.write_cached(asked.where("prompt = 'x'").select("key", F.lit("yes").alias("answer")), str(tmp_path / "cache"))
    got = {r["prompt"]: r["answer"] for r in S.read_cached(spark, str(tmp_path / "cache"), asked).collect()}
    assert got == {None: None, "x": "yes"}


def test_windows_on_batch_and_stream(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,i*20,0) AS ts, 'a' AS kind, 1.0D AS value FROM (SELECT explode(sequence(0, 5)) AS i)")
    batch = sorted((str(r["start"]), r["n"]) for r in W.tumbling(df, "ts", "kind").collect())
    assert [n for _, n in batch] == [3, 3]
    assert W.sessions(df, "ts", "kind").count() == 1
    df.write.parquet(str(tmp_path / "in"))
    stream = W.tumbling(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "kind")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r["start"]), r["n"]) for r in spark.table("windows").collect()) == batch


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_ids_of_a_csv_in_order_and_tables_of_any_length(spark, tmp_path):
    lines = ["job_title,salary_max,other"] + [f'"title {i}",{i},x' for i in range(2500)]
    (tmp_path / "a.csv").write_text("\n".join(lines), encoding="utf-8")
    rows = S.read_postings_csv(spark, str(tmp_path / "a.csv")).orderBy("posting_id").collect()
    assert [r["posting_id"] for r in rows] == list(range(2500)) and all(r["job_title"] == f"title {r['salary_max']}" == f"title {r['posting_id']}" for r in rows)
    assert S.markdown_table(spark.range(1500)).count("\n") == 1502


def test_only_the_shards_asked_for_are_read(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i}",) for i in range(300)], "q string").select(S.cache_key("q").alias("key"), F.col("q").alias("answer"))
    S.write_cached(df, str(tmp_path / "c"))
    asked = df.where("answer = 'q7'").select("key").unionByName(spark.createDataFrame([("zz",)], "key string"))
    got = S.read_cached(spark, str(tmp_path / "c"), asked)
    assert {r["key"][:2]: r["answer"] for r in got.collect()}["zz"] is None and got.where("answer = 'q7'").count() == 1
    assert "PartitionFilters: [shard" in got._jdf.queryExecution().executedPlan().toString()


def test_jsonl_round_trip_and_meta(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "k int, t string, x double")
    S.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, S.read_jsonl(spark, str(tmp_path / "j"), "k int, t string, x double").collect())) == [(1, "a", None), (2, None, 2.5)]
    told = S.with_meta(df, date="2026-01-01", revision="abc")
    assert told.columns == ["date", "revision", "k", "t", "x"] and told.where("revision = 'abc'").count() == 2
    with pytest.raises(ValueError):
        S.with_meta(df, k=1)
