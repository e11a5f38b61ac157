"""Sources and sinks on small files with what goes wrong in real ones."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.sources import files, pages, sinks


def test_encodings_and_rosters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name, Score \n\"é\n\n\",\"1,5\"\n".encode())
    (tmp_path / "b.csv").write_bytes("Name,Score\né,2\n".encode("latin-1"))
    assert files.encoding_of(spark, str(tmp_path / "a.csv")) == "UTF-8" and files.encoding_of(spark, str(tmp_path / "b.csv")) == "ISO-8859-1"
    assert [tuple(r) for r in files.read_csv_any(spark, str(tmp_path / "a.csv")).collect()] == [("é\n\n", "1,5")]
    b = files.read_csv_any(spark, str(tmp_path / "b.csv"))
    assert b.columns == ["Name", "Score"] and b.first()["Name"] == "é"
    at, df = files.first_readable(spark, [str(tmp_path / "none.csv"), str(tmp_path / "b.csv")])
    assert at.endswith("b.csv") and df.count() == 1
    with pytest.raises(FileNotFoundError):
        files.first_readable(spark, [str(tmp_path / "none.csv")])


def test_newest_files_and_name_maps(spark, tmp_path):
    import os

    for k, run in enumerate(("r1", "r2", "r3")):
        (tmp_path / run).mkdir()
        (tmp_path / run / ("out.csv" if run != "r3" else "other.csv")).write_text("x\n1\n")
        os.utime(next((tmp_path / run).iterdir()), (1_700_000_000 + k, 1_700_000_000 + k))
    assert files.newest(spark, str(tmp_path), "out.csv").endswith("r2/out.csv")
    assert files.newest(spark, str(tmp_path), "none.csv") is None and files.newest(spark, str(tmp_path / "no"), "out.csv") is None
    (tmp_path / "good.json").write_text('{"a": "A",\n "b": "B"}')
    (tmp_path / "bad.json").write_text("{broken")
    got = files.read_name_maps(spark, [str(tmp_path / n) for n in ("good.json", "bad.json", "none.json")])
    assert sorted(map(tuple, got.collect())) == [("good", "a", "A"), ("good", "b", "B")]


def test_responses_corpora_and_schemas(spark, tmp_path):
    (tmp_path / "r.csv").write_text('model_name,question_id,run,status,response\nm,q1,2,ok,later\nm,q1,1,ok,"first, <think>x</think>one"\nm,q2,1,error,bad\nm,q9,1,ok,left out\n')
    got = files.read_responses(spark, str(tmp_path / "r.csv"), ["q9"])
    assert [tuple(r) for r in got.collect()] == [("m", "q1", "first, <think>x</think>one")]
    other = spark.createDataFrame([("n", 7, " <think>all of it</think> "), ("n", 8, "kept")], "who string, k int, body string")
    both = files.unified_corpora({"style": (got, {"model": "model_name", "key": "question_id", "text": "response"}), "logic": (other, {"model": "who", "key": "k", "text": "body"})}, T.without_reasoning)
    assert sorted(map(tuple, both.collect())) == [("logic", "n", "8", "kept"), ("style", "m", "q1", "first, one")]
    out = files.completed(spark.createDataFrame([("1", "x", "gone")], "seq string, judge string, extra string"), "judge string, seq long, margin double")
    assert out.columns == ["judge", "seq", "margin"] and tuple(out.first()) == ("x", 1, None)


def test_scenarios_and_prompts(spark, tmp_path):
    (tmp_path / "s.txt").write_text("junk\n######## 1 | Work | Lunch | theft\n####### Prompt1\n\nHello\nyou\n####### Prompt2\n\n####### Prompt3\nBye\n######## 12 |  Home | Cat \n####### Prompt1\nMeow\n######## x | no | id\n")
    got = {r["id"]: tuple(r)[1:] for r in files.scenarios(spark, str(tmp_path / "s.txt")).collect()}
    assert got[1] == ("Work", "Lunch | theft", ["Hello\nyou", "Bye"]) and got[12][:2] == ("Home", "Cat") and set(got) == {1, 12}
    assert [r["id"] for r in files.scenarios(spark, str(tmp_path / "s.txt"), [12]).collect()] == [12]
    (tmp_path / "prompt_7.txt").write_text("Write one sentence.\n\nCore Concept: time: its end\nTone:dry\nno pair\n")
    r = files.prompt_elements(spark, str(tmp_path / "prompt_7.txt")).first()
    assert (r["id"], r["template"], r["elements"]) == ("7", "Write one sentence.", {"core_concept": "time: its end", "tone": "dry"})


def test_sqlite_and_script_csv(spark, tmp_path):
    for k in range(2):
        with sqlite3.connect(tmp_path / f"{k}.db") as db:
            db.execute("create table trials (id integer, score real)")
            db.executemany("insert into trials values (?, ?)", [(10 * k + j, j / 2) for j in range(3)])
    got = files.sqlite_rows(spark, str(tmp_path / "*.db"), "select id, score from trials where score > 0", "id long, score double")
    assert sorted(map(tuple, got.collect())) == [(1, 0.5), (2, 1.0), (11, 0.5), (12, 1.0)]
    page = spark.createDataFrame([(1, "var x; const data = `name,score\na,1.5\n\nb,\n`;"), (2, "nothing")], "page_id long, html string")
    assert sorted(map(tuple, files.csv_in_script(page, "page_id", "html", "data", "name string, score double").collect())) == [(1, "a", 1.5), (1, "b", None)]


def test_records_in_payloads(spark):
    entries = [{"rating": 1500.5 - k, "modelDisplayName": f'm "{k}"\\é', "rank": k} for k in range(4)]
    deep = {"a": [{"b": {"entries": entries, "few": entries[:2]}}], "c": [{"rating": 1}]}
    line = "3:" + json.dumps(["$", "div", None, deep])
    half = len(line) // 2
    pushed = "".join(f"<script>self.__next_f.push({json.dumps([1, part])})</script>" for part in ("0:null\n" + line[:half], line[half:] + "\n4:broken{"))
    plain = f"<html><script>var d = {json.dumps(deep)}; more()</script></html>"
    table = spark.createDataFrame([(1, pushed), (2, plain), (3, "<script>{no json</script>"), (4, None)], "page_id long, html string")
    rows = pages.records(table, "page_id", "html", ["rating", "modelDisplayName"])
    own = rows.select("page_id", "place", F.from_json("record", "rating double, modelDisplayName string").alias("r")).select("page_id", "place", "r.*")
    want = [(p, k, e["rating"], e["modelDisplayName"]) for p in (1, 2) for k, e in enumerate(entries)]
    assert sorted(map(tuple, own.collect())) == want


def test_tables_with_marked_cells(spark):
    html = """<table><tr><th>Model</th><th>Score (%)</th></tr><tr><td>A <span class="icon think"></span></td><td>45.5 <b>%</b></td></tr>
    <tr><td>B<i class="think"></i><i class="capable"></i></td><td>7%</td></tr><tr><td>ragged</td></tr></table>"""
    got = pages.marked_tables(spark.createDataFrame([(1, html), (2, None)], "k long, h string"), "k", "h", "think", "capable").orderBy("row").collect()
    assert [r["cells"] for r in got] == [["Model", "Score (%)"], ["A (Reasoning)", "45.5 %"], ["B", "7%"]]


def test_atomic_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_atomic(spark, path)
    assert sinks.write_atomic(spark.range(3), path) == 1
    spark.range(99).write.parquet(f"{path}/data/000002-broken")
    assert sinks.read_atomic(spark, path).count() == 3
    assert sinks.write_atomic(spark.range(5), path) == 2 and sinks.read_atomic(spark, path).count() == 5


def test_appended_rows_labels_and_latin(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_rows(spark.createDataFrame([("a", 1, "x")], "name string, n int, extra string"), path, ["n", "name", "note"])
    sinks.append_rows(spark.createDataFrame([("b,\n", 2)], "name string, n int"), path, ["n", "name", "note"])
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert got.columns == ["n", "name", "note"] and sorted((r["n"], r["name"]) for r in got.collect()) == [("1", "a"), ("2", "b,\n")]
    df = spark.createDataFrame([(1, 2, 3, "é\"q\"")], "label_b int, z int, label_a int, name string")
    assert sinks.with_labels(df, ["name", "z"]).columns == ["name", "z", "label_a", "label_b"]
    sinks.write_latin(df.select("name", "z"), str(tmp_path / "latin"))
    (part,) = (tmp_path / "latin").glob("part-*")
    assert part.read_bytes() == 'name,z\r\n"é""q""",2\r\n'.encode("latin-1")


def test_runs_splits_and_copies(spark, tmp_path):
    out = sinks.write_run({"scores": spark.createDataFrame([("a", 1.5)], "m string, s double")}, {"k": 3}, str(tmp_path), "run1")
    settings, tables = sinks.read_run(spark, out)
    assert settings == {"k": 3} and [tuple(r) for r in tables["scores"].collect()] == [("a", "1.5")]
    made = []

    def make(keys):
        made.append(1)
        return keys.crossJoin(spark.range(2).withColumnRenamed("id", "repeat")).withColumn("fold", (F.col("id") + F.col("repeat")) % 3)

    for n, times in ((30, 1), (30, 1), (31, 2)):
        got = sinks.saved_splits(spark.range(n), "id", str(tmp_path / "splits"), 3, 2, make)
        assert got.count() == 2 * n and len(made) == times
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.csv").write_text("x\n1\n")
    store = str(tmp_path / "store")
    assert sinks.copy_newer(spark, {"a": str(tmp_path / "src")}, store) == ["a"] and sinks.copy_newer(spark, {"a": str(tmp_path / "src")}, store) == []
    assert sinks.read_atomic(spark, f"{store}/a").first()["x"] == "1"
    assert len(sinks.file_mark(spark, str(tmp_path / "src")).first()["sha256"]) == 64


def test_marks_tell_doubled_rows_apart(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "x"), (3, "z"), (3, "z")], "k int, v string")
    assert sinks.content_mark(a) != sinks.content_mark(b) and sinks.content_mark(a) == sinks.content_mark(a.orderBy(F.desc("k")))
