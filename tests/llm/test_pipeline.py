"""The pipeline's stages, each against a plain version on what its predecessor kept."""

import random

import corpus_pipeline
from gristmill.llm import quality
from gristmill.llm.tokens import Tokens, default_tokenizer
from tests.llm.fixtures import lower_ascii, prose
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_dedup import plain_similar
from tests.llm.test_scores import junk
from tests.llm.test_tokens_media_urls import check_sequences

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r, texts = random.Random(1), []
    for k in range(160):
        texts.append(junk(k) if k % 8 == 0 else "\n".join(prose(50 * k + j, 25) for j in range(r.randint(1, 5))) + ".")
    texts += [texts[1], texts[2] + "\none more line of words", None, "", texts[5].replace("alpha", "ALPHA")]
    near = texts[7].split(" ")
    near[3] = "altered"
    texts.append(" ".join(near))
    item = prose(777, 30)
    texts += [prose(778, 30) + " " + item + " " + prose(779, 30), "some words " + " ".join(item.split()[5:25])]
    return texts, item


def write(spark, path):
    texts, item = corpus()
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 8 != 0), 0) for k in range(160) if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item


def plain_lines(docs):
    key = lambda s: lower_ascii(s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in sorted(docs.items()):
        for s in (t or "").split("\n"):
            if len(key(s)) >= 10:
                held.setdefault(key(s), []).append(i)
    out = {}
    for i, t in docs.items():
        kept = [s for s in (t or "").split("\n") if i == min(held.get(key(s), [i])) or len(set(held[key(s)])) < 2]
        out[i] = t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)
    return out


def test_stages_one_by_one(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows, item = write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        steps.append(docs.collect())
    first = {r["doc_id"]: r["text"] for r in steps[0]}
    scores = quality.quality_report(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert set(first) == {r["doc_id"] for r in scores if r["predicted"]}
    good = [k for k in range(160) if k % 8]
    assert len(set(first) & set(good)) > 0.97 * len(good) and len(set(first) & set(range(0, 160, 8))) <= 2
    second = {r["doc_id"]: r["text"] for r in steps[1]}
    assert second == plain_lines(first)
    assert all(r["n_chars"] == len(r["text"] or "") for r in steps[1])
    third = {r["doc_id"]: r["text"] for r in steps[2]}
    ids = sorted(second)
    want = plain_similar([second[i] for i in ids])
    assert set(third) == {ids[v] for v in want.values()}
    fourth = {r["doc_id"]: r["text"] for r in steps[3]}
    hits = plain_hits(list(third.items()), [(1, item)])
    assert set(fourth) == {i for i in third if not hits[i][4]} and len(fourth) < len(third)
    tokens = Tokens(default_tokenizer())
    total = {}
    for r in steps[4]:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(tokens.ids(t)) + 1 for i, t in fourth.items()}
    check_sequences(steps[4])
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in steps[4])


def test_stages_keep_columns_of_any_name_and_take_odd_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    write(spark, path)
    texts, _ = corpus()
    names = ["n_lines", "n_dropped", "score", "predicted", "held_out", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "a.b", "h", "row", "node"]
    schema = "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names)  # no n_chars
    docs = spark.createDataFrame([(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)], schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(tuple(r)[2:] == tuple(f"{n}{r['doc_id']}" for n in names) for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
