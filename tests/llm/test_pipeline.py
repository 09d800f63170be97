"""The stages on the smallest tables, each against what it promises; and the queries' SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from merset.llm.queries import ORACLES, QUERIES
from merset.session import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"] for r in kept["language"]} == {i for i, r in start.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in kept["near_duplicates"] if not any(t in r["text"] for t in items)}
    assert {r["doc_id"] for r in kept["decontamination"]} == clean
    assert {r["doc_id"] for r in kept["secrets"]} == clean
    assert not any(re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"]) for r in kept["secrets"])
    assert {r["doc_id"] for r in kept["mixing"]} <= clean and all(r["taken"] > 0 for r in kept["mixing"])
    assert len(kept["near_duplicates"]) < len(kept["language"])
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, kept["mixing"]))


def test_language_stage_decides(spark, sf_dir, monkeypatch):
    """Against plain rules on a small table: gibberish and unwanted languages go, a missing lang is filled in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 200").limit(60)
    odd = [(9001, "\u4e16\u754c \u4eba\u6c11 " * 30, None), (9002, "12 34 --", "en"), (9003, None, "en"), (9004, "", None), (9005, "the", "en")]
    rows = docs.select("doc_id", "text", "lang").collect()
    table = spark.createDataFrame([*rows, *odd, (9006, rows[0]["text"], None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine"))
    known = {r["doc_id"]: r["lang"] for r in rows}
    got = {r["doc_id"]: r["lang"] for r in pipeline.by_language(spark, table, sf_dir).collect()}
    assert got == known | {9005: "en", 9006: rows[0]["lang"]} | ({9001: got[9001]} if 9001 in got else {})
    assert pipeline.by_language(spark, table, sf_dir).columns == table.columns
    monkeypatch.setattr(pipeline, "LANGUAGES", ("de",))
    assert {r["doc_id"] for r in pipeline.by_language(spark, table, sf_dir).collect()} - {9001, 9005, 9006} <= {i for i, x in known.items() if x == "de"}
    none = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in pipeline.by_language(spark, none, sf_dir).collect()} == {*known, 9001, 9005, 9006}


def test_near_duplicate_stage_against_brute_force(spark, prose, rng):
    """Five words, 80 %: one row of each group, that of the smallest id, and all rows of no group."""
    base = prose(80).split()
    texts = [prose(40) for _ in range(20)]
    for _ in range(25):
        w = list(base)
        for k in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            w[k] = f"new{int(rng.integers(1 << 30))}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + [None, ""]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if shingles[i] and 5 * len(shingles[i] & shingles[j]) >= 4 * len(shingles[i] | shingles[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = pipeline.without_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, x in enumerate(root) if x == i)


def test_decontamination_keeps_clean_rows_of_null_and_repeated_ids(spark, tmp_path, prose):
    item = "Question: which river crosses the old town near the stone bridge? Answer: the green Danube"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = lambda: f"{prose(30)} {item} {prose(30)}"
    clean = [(None, prose(60)), (None, prose(60)), (7, prose(60)), (3, prose(60)), (None, None), (4, None)]
    rows = [(None, leak()), (7, leak()), (9, leak()), *clean]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = pipeline.decontaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, ((i, t, "s") for i, t in clean)))


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in want)
