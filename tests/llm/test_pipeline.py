"""The corpus pipeline stage by stage on the smallest tables, and its registration."""

from __future__ import annotations

import os
import random

import pytest
from check_oracle import compare, duck
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from parcelmill.llm import language, ngram_join, packing, queries
from parcelmill.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(duck(SF_DIR), queries.QUERIES[name](spark, SF_DIR), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_returns_a_row_for_each_document(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    ids = table(spark, SF_DIR, "documents").select("doc_id")
    assert got.select("doc_id").distinct().count() == ids.count()


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents").withColumn("quality_score", F.lit("mine")).withColumn("found_lang_pred", F.lit("mine"))
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == columns, name
        assert kept.exceptAll(docs).count() == 0, name
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        seen.append(docs.count())
        if name == "n-gram Jaccard join":
            again = ngram_join.near_duplicates(docs)
            assert again.where("component_id != doc_id").count() == 0
    assert seen[0] > seen[1] >= seen[2] > seen[3] >= seen[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    words = docs.select(F.sum(packing.word_count(F.col("text")))).first()[0]
    assert packed.select(F.sum("length")).first()[0] == words
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_language_stage_drops_unlearned_languages_and_keeps_insertions(spark):
    rows = table(spark, SF_DIR, "documents").where("length(text) between 300 and 600").orderBy("doc_id").collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], r["text"])
    one, other = [by_lang[k] for k in sorted(by_lang)][:2]
    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(80))
    texts = {
        "one": one, "insertion": f"{one} {other * 3} {one}", "halves": f"{one} {other}", "han": "中文字 这是一个 测试 " * 20,
        "cyrillic": "это простой русский текст " * 20, "noise": noise, "digits": "12 34",
        "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_language(spark, docs, SF_DIR).collect()}
    assert kept == {"one", "insertion", "halves"}
    found = language.identify(docs, language.fit(table(spark, SF_DIR, "documents")))
    score = {r["doc_id"]: r["lang_score"] for r in found.collect()}
    assert score["han"] == score["cyrillic"] == 0 and score["noise"] < 0.3 and score["polish"] < 0.5 and score["one"] > 0.8
    for r in found.collect():
        assert all(0 <= s["known"] <= s["letters"] for s in r["lang_spans"])
        assert sum(s["letters"] for s in r["lang_spans"]) == sum(c.isalpha() for c in r["text"])


def test_stages_of_nothing(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
