import json

import pytest
from pyspark.sql import functions as F

from gristmill.sources import files, sinks
from gristmill.streaming import battles as stream


def test_latest_file():
    assert files.latest(["a/data_20240101.csv", "a/data_20240615.csv", "a/data_20250101.csv"]).endswith("20250101.csv")
    assert files.latest(["data_2024-01-01.csv", "data_2025-06-15.csv"]) == "data_2025-06-15.csv"
    assert files.latest(["data_foo.csv"]) == "data_foo.csv"
    with pytest.raises(ValueError):
        files.latest([])


def test_roster(spark, tmp_path):
    p = tmp_path / "roster.csv"
    p.write_text('Model,openbench_id,reasoning\n"A\nB",a,true\nC,,false\nD,d,FALSE\nE,e,yes\n')
    assert [tuple(r) for r in files.read_roster(spark, str(p), ["E"]).collect()] == [("A\nB", "a", True), ("D", "d", False)]
    p.write_text("Name,openbench_id\nA,a\n")
    with pytest.raises(ValueError):
        files.read_roster(spark, str(p))


def test_conversations_and_stories(spark, tmp_path):
    turn = lambda n: {"turn": 1, "prompt": "p", "response": "r" * n}
    (tmp_path / "j" / "m").mkdir(parents=True)
    for k, (done, n) in enumerate([(True, 30), (False, 30), (True, 5), (True, 60_000)]):
        (tmp_path / "j" / "m" / f"{k}.json").write_text(json.dumps({"model": f"m{k}", "scenario_id": "1", "completed": done, "turns": [turn(n)]}))
    assert [r["model"] for r in files.read_conversations(spark, str(tmp_path / "j")).collect()] == ["m0"]
    (tmp_path / "s" / "model-x").mkdir(parents=True)
    (tmp_path / "s" / "model-x" / "prompt_3.txt").write_text("a\nb")
    assert [tuple(r) for r in files.read_stories(spark, str(tmp_path / "s")).collect()] == [("model-x", "prompt_3", "a\nb")]


def test_tables_in_pages(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td> 1 </td><td><b>2</b>x</td></tr><tr><td>only</td></tr></table>"
    text = "intro\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 |\n\n| c |\n"
    pages = spark.createDataFrame([(1, html, text), (2, None, None)], "id long, html string, text string")
    assert [r["cells"] for r in files.table_rows(pages, "id", "html").orderBy("row").collect()] == [["A", "B"], ["1", "2x"]]
    assert [r["cells"] for r in files.table_rows(pages, "id", "text", "markdown").orderBy("row").collect()] == [["a", "b"], ["1", "2"]]
    assert files.embedded_csv("var x = 1; data = `a,b\n1,2\n`;", "data") == "a,b\n1,2"
    wide = files.wide_from_json(spark.createDataFrame([(1, '{"b": "2", "a": "1"}'), (2, '{"c": "3"}')], "id long, j string"), "id", "j")
    assert wide.columns == ["id", "a", "b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.5)], "name string, score double")
    out = sinks.write_scores(df, str(tmp_path / "x"), "20260101", "score")
    assert [tuple(r) for r in files.read_csv(spark, out).collect()] == [("c", "2.5000"), ("a", "1.0000"), ("b", None)]
    calls = []
    make = lambda s: calls.append(1) or s.select("name")
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "c"), {"k": 1}, df, make).count() == 3
    assert len(calls) == 1
    sinks.cached(spark, str(tmp_path / "c"), {"k": 2}, df, make)
    assert len(calls) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp") + F.expr("make_interval(0,0,0,0,0,cast(id as int),0)")).alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") * 1.5).alias("value"), F.lit("{}").alias("props"),
    )
    for k in range(3):
        rows.where(f"event_id between {k * 90} and {k * 90 + 119}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    assert whole.count() > 300
    unique = stream.once(stream.read_events(spark, str(tmp_path / "in")), "event_id", "ts", "10 days")
    stream.run_to_end(unique, str(tmp_path / "c1"), stream.append_to_table(str(tmp_path / "out")), "append")
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == 300 and got.exceptAll(whole.dropDuplicates(["event_id"])).count() == 0
    seen: dict = {}
    counts = stream.windowed_counts(stream.read_events(spark, str(tmp_path / "in")), "ts", "1 hour", "10 days", "event_type")
    stream.run_to_end(counts, str(tmp_path / "c2"), lambda b, n: seen.update({(r["start"], r["event_type"]): r["n"] for r in b.collect()}))
    batch = whole.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").count()
    assert seen == {(r["start"], r["event_type"]): r["count"] for r in batch.collect()}


def test_ratings_by_stream_equal_the_batch_fold(spark, tmp_path):
    from gristmill.operators import rate

    rows = [(f"j{k % 2}", k, f"m{k % 3}", f"m{3 + k % 4}", ("model_1", "model_2", "draw")[k * k % 3]) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], stream.RESULTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        source = stream.read_events(spark, str(tmp_path / "in" / "*"), schema=stream.RESULTS)
        stream.run_to_end(source, str(tmp_path / "check"), stream.rate_batches(spark, str(tmp_path / "out")), "append")
    got = {(r["judge"], r["model"]): (r["mu"], r["sigma"], r["games"]) for r in stream.latest_ratings(spark, str(tmp_path / "out")).collect()}
    want = {(r["judge"], r["model"]): (r["mu"], r["sigma"], r["games"]) for r in rate.skill_ratings(spark.createDataFrame(rows, stream.RESULTS), "judge").collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k], want[k], strict=True))


def test_a_tournament_keeps_its_budget_and_goes_on(spark, tmp_path):
    models = spark.createDataFrame([(f"i{i}", f"m{m}") for i in range(4) for m in range(4)], "item string, model string")

    def play(pairs):
        better = F.col("model_a") > F.col("model_b")
        return pairs.withColumn("margin_a", F.when(better, 3).otherwise(1).cast("long")).withColumn("margin_b", F.when(better, 1).otherwise(3).cast("long"))

    stream.tournament(spark, models, "j", str(tmp_path / "t"), play, 10, 6)
    battles = lambda: spark.read.parquet(str(tmp_path / "t" / "battles" / "*"))
    assert battles().count() == 10
    ratings = stream.tournament(spark, models, "j", str(tmp_path / "t"), play, 24, 10)
    assert battles().count() == 24 and battles().select("item", "model_a", "model_b").distinct().count() == 24
    both = battles().select("item", F.least("model_a", "model_b").alias("x"), F.greatest("model_a", "model_b").alias("y")).groupBy("item", "x", "y").count()
    assert both.where("count != 2").count() == 0
    mu = {r["model"]: r["mu"] for r in ratings.collect()}
    assert mu["m3"] > mu["m0"]
