"""Quality classifier and language identification: held-out accuracy, exact paths, awkward inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.llm import language, quality
from parcelmill.llm.common import crc_fold, fresh

DOCS = "doc_id long, text string, lang string, source string, `a.b` string"


def sentences(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)) + "."


GOOD = ["ka", "lo", "mi", "ren", "tas"]
TONGUES = {"xx": ["ka", "lo", "mi", "ren"], "yy": ["zu", "per", "ghi", "éo"], "zz": ["до", "ми", "ре", "фа"]}


def test_crc_fold(spark):
    df = spark.createDataFrame([(k,) for k in (None, 0, 5, 123456)], "doc_id long")
    got = [r[0] for r in df.select(crc_fold(F.col("doc_id"), 5)).collect()]
    assert got == [zlib.crc32(("" if k is None else str(k)).encode()) % 5 for k in (None, 0, 5, 123456)]


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "SCORE int, score_ int")
    assert fresh(df, "score") == "score__"


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        text = sentences(rng, GOOD, int(rng.integers(5, 60)))
        rows.append((k, text if k % 4 else text.upper().replace(" ", "!! "), None, "s", "x"))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "ka lo", None, None, None)]
    rows += [(5, rows[5][1], None, "s", "x"), (1002, "ka lo mi " * 100_000, None, "s", "x")]
    labels = [(k, int(k % 4 > 0), 0) for k in range(400)] + [(5, 1, 0), (7, None, 0), (None, 1, 0), (9999, 1, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, rated):
    docs, labels = rated
    model = quality.fit(docs, labels, bits=14)
    got = quality.score(docs.withColumn("score", F.lit("x")), model, into="of_quality")
    assert got.columns == [*docs.columns, "score", "of_quality"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["of_quality"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and all((r["of_quality"] >= quality.THRESHOLD) == (r["doc_id"] % 4 > 0) for r in held)
    empty = {r["of_quality"] for r in rows if not r["text"]}
    assert len(empty) == 1
    with pytest.raises(ValueError):
        quality.score(docs, model, into="TEXT")


def test_held_out_labels_teach_nothing(spark, rated):
    docs, labels = rated
    turned = labels.withColumn("quality", F.when(crc_fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = quality.fit(docs, labels, bits=12), quality.fit(docs, turned, bits=12)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


def test_quality_without_labels(spark, rated):
    docs, labels = rated
    model = quality.fit(docs, labels.limit(0), bits=12)
    assert {r[0] for r in quality.score(docs, model).select("score").collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_equal_a_plain_dot_product():
    rng = np.random.default_rng(1)
    texts = ["Ka lo!! MI", "", "one 22 three | four", "é x"]
    weights = rng.normal(size=1 << 10)
    raws = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raws])
    together = quality._scores(np.concatenate(raws), offsets, weights, 0.3, 10)
    for raw, score in zip(raws, together, strict=True):
        total = 0.3
        for slots, _ in quality.features(raw, np.array([0, len(raw)]), 10):
            total += sum(weights[s] for s in slots) / len(slots) if len(slots) else 0
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        lang = list(TONGUES)[0 if k % 2 else k % 3]  # one language has most rows
        rows.append((k, sentences(rng, TONGUES[lang], int(rng.integers(5, 60))), lang, lang, "x"))
    return spark.createDataFrame(rows, DOCS), rng


def test_languages(spark, spoken):
    docs, rng = spoken
    model = language.fit(docs, bits=12)
    assert model.languages == ["xx", "yy", "zz"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["a.b"]) for r in docs.collect()]
    outer, inner = sentences(rng, TONGUES["xx"], 40), sentences(rng, TONGUES["yy"], 30)
    mixed = f"{outer} {inner} {outer}"
    rows += [
        (1000, None, "xx", "s", "x"), (1001, "", "xx", "s", "x"), (1002, "12 — 34 !!", None, None, None), (None, "ka lo mi", None, None, None),
        (1003, mixed, None, None, None), (1004, "中文字", None, None, None), (1005, outer * 3_000, None, None, None), (1006, "😀", None, None, None),
    ]
    table = spark.createDataFrame(rows, DOCS).withColumn("lang_score", F.lit(1))
    with pytest.raises(ValueError):
        language.identify(table, model)
    got = language.identify(table, model, into="guess")
    assert got.columns[:6] == table.columns
    by_id = {r["doc_id"]: r for r in got.collect()}
    held = [r for k, r in by_id.items() if k is not None and k < 300 and zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 40 and all(r["guess_pred"] == r["lang"] and r["guess_score"] == 1 for r in held)
    for k in (1000, 1001, 1002, 1006):
        assert (by_id[k]["guess_pred"], by_id[k]["guess_score"], by_id[k]["guess_spans"]) == ("und", 0, [])
    assert by_id[1004]["guess_pred"] in model.languages and by_id[None]["guess_pred"] == "xx" and by_id[1005]["guess_pred"] == "xx"
    spans = by_id[1003]["guess_spans"]
    assert [s["lang"] for s in spans] == ["xx", "yy", "xx"] and by_id[1003]["guess_pred"] == "xx"
    inside = mixed[spans[1]["first"] : spans[1]["end"]]
    assert inside[:-1] in inner + " " and abs(len(inside) - len(inner)) < 20
    assert spans[0]["first"] == 0 and mixed[spans[2]["end"] - 1] == outer[-2]


def test_no_language_learned(spark, spoken):
    docs, _ = spoken
    model = language.fit(docs.withColumn("lang", F.lit(None).cast("string")), bits=10)
    assert {tuple(r) for r in language.identify(docs, model, into="l").select("l_pred", "l_score").collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), model, into="l").count() == 0


def all_paths(scores, switch):
    """The best total over all paths, by dynamic programming over every pair of languages."""
    value = list(scores[0])
    for row in scores[1:]:
        value = [max(value[i] - switch * (i != j) for i in range(len(row))) + row[j] for j in range(len(row))]
    return max(value)


@settings(max_examples=1000, deadline=None)
@example([[-3, 0, 4], [6, 4, 0]], 5)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=25), st.integers(1, 12))
def test_path_is_the_best(rows, switch):
    scores = np.array(rows, dtype=float)
    path = language.best_path(scores, switch)
    total = scores[np.arange(len(path)), path].sum() - switch * np.count_nonzero(np.diff(path))
    assert total == all_paths(rows, switch)


def test_counts_of_words_equal_counts_of_places(monkeypatch):
    given_texts = ["Ka lo ka LO ren", None, "", "до до ми", "éo " * 40, "\U00030001\U00030002"]
    want, scripts = np.zeros(1 << 8), np.zeros(len(language.SCRIPTS))
    for text in given_texts:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        words = language.find_words(raw, np.array([0, len(raw)]))
        for first, end, script in zip(words.starts, words.ends, words.scripts, strict=True):
            scripts[script] += end - first
            for slots, _ in language._ngrams(words.points, np.array([first]), np.array([end]), 8):
                np.add.at(want, slots, 1)
    assert scripts[language.SCRIPTS.index("Han")] == 2
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(language, "COUNT_BYTES", size)
        grams, counted = language._counts(given_texts, 8)
        assert np.array_equal(grams, want) and np.array_equal(counted, scripts)


def test_training_equals_updates_of_dense_vectors():
    """Follow-the-regularised-leader over whole vectors, coordinate by coordinate as published."""
    rng, bits = np.random.default_rng(6), 6
    rows = [(sentences(rng, GOOD, int(rng.integers(0, 9))) if k else None, int(rng.integers(0, 2))) for k in range(25)]
    weights, bias = quality.fit_rows(rows, bits, epochs=2, seed=3)
    model = quality.Ftrl(1 << bits)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def leader():
        return np.array([
            0.0 if abs(a) <= model.l1 else -(a - np.sign(a) * model.l1) / ((model.beta + b**0.5) / model.alpha + model.l2)
            for a, b in zip(z, n, strict=True)
        ])

    order = np.random.default_rng(3)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            raw = np.frombuffer((rows[k][0] or "").encode(), dtype=np.uint8)
            x = np.zeros(len(z))
            x[-1] = 1
            for slots, _ in quality.features(raw, np.array([0, len(raw)]), bits):
                for slot in slots:
                    x[slot] += 1 / len(slots)
            w = leader()
            g = (1 / (1 + np.exp(-(w @ x))) - rows[k][1]) * x
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / model.alpha * w
            n += g * g
    assert np.allclose(leader(), [*weights, bias], atol=1e-9)
