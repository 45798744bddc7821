"""Word hashing, decontamination, token counts and the license scan against plain Python."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.llm import decontamination, licenses, texts, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
words_of = lambda text: WORD.findall((text or "").translate(LOWER))
DOCS = "doc_id long, text string, hits string, `n words` int, items string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .é \n中", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_of_slices(rows, limit):
    found = []
    for first, end, raw, offsets in texts.text_slices(pa.array(rows, pa.string()), limit):
        raw = texts.LOWER[raw]
        starts, ends, word_of = texts.word_bounds(raw, offsets, texts.LETTERS_DIGITS)
        data = raw.tobytes()
        for k in range(end - first):
            found.append([data[starts[w] : ends[w]].decode() for w in range(word_of[k], word_of[k + 1])])
    assert found == [words_of(r) for r in rows]


def test_hashes_do_not_depend_on_the_place():
    text = ("ab cd " * 50_000 + "x" * 3_000_000 + " ab").encode()
    raw = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = texts.word_bounds(raw, np.array([0, len(raw)]), texts.NO_SPACE)
    hashes = texts.span_hashes(raw, starts, ends)
    assert len(set(hashes[0:-2:2].tolist())) == 1 and hashes[-1] == hashes[0] and len(set(hashes.tolist())) == 3


def contained(docs, items, width=13):
    windows = {}
    for item, text in items:
        words = words_of(text)
        if words:
            size = min(width, len(words))
            for k in range(len(words) - size + 1):
                windows.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k : k + size])):
                    hit.update(range(k, k + size))
                    ids |= found
        out.append((key, len(words), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def sample():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of"] + [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, say(int(n))) for k, n in enumerate(rng.integers(1, 40, 12))]
    items += [(99, ""), (98, None), (None, "a b c d"), (3, say(20)), (50, "short, Item"), (51, items[2][1])]
    docs = [(k, say(int(n))) for k, n in enumerate(rng.integers(0, 80, 60))]
    docs += [(100 + k, say(10) + ". " + (t or "") + "! " + say(30)) for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (None, "x short item y"), (7, "A, b; C d"), (7, "A, b; C d"), (202, say(30_000) + " " + items[0][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    docs, items = sample()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs_of(spark, docs), table, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == contained(docs, items)
    clean = decontamination.clean_documents(docs_of(spark, docs), table, block_bytes=block_bytes)
    assert clean.columns == ["doc_id", "text", "hits", "n words", "items"]
    kept = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr)
    bad = {(k, n, h) for k, n, h, _ in contained(docs, items) if h and 20 * h >= n}
    expected = [d for d in docs if (d[0], len(words_of(d[1])), next(iter(contained([d], items)))[2]) not in bad]
    assert kept == sorted(expected, key=repr)


def test_decontamination_without_rows(spark):
    docs, items = sample()
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(docs_of(spark, docs), none).collect()
    assert len(got) == len(docs) and not any(r["n_hit"] or r["items"] for r in got)
    assert decontamination.decontaminate(docs_of(spark, []), spark.createDataFrame(items, none.schema)).count() == 0


def test_digest(spark):
    df = spark.createDataFrame([(["1", "10", "2"],), ([],)], "items array<string>")
    got = [r[0] for r in df.select(decontamination.digest(F.col("items"))).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ("1,10,2", "")]


def model_path():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    return path if os.path.exists(path) else pytest.skip("no vocabulary")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab  .\n\té中<s>▁", max_size=60), st.integers(1, 12))
def test_safe_parts_keep_the_count(text, limit):
    encoder = token_counts.tokenizer(model_path())
    assert sum(len(x) for x in encoder.encode(list(token_counts.safe_parts(text, limit)))) == len(encoder.encode(text))


def test_token_counts(spark):
    encoder = token_counts.tokenizer(model_path())
    rows = [(1, "Hello  world"), (2, None), (3, ""), (None, "<s> </s>"), (4, "wörd " * 40_000), (4, "wörd " * 40_000), (5, "x" * 50_000)]
    got = token_counts.count_tokens(docs_of(spark, rows), model_path()).collect()
    expected = [(k, len((t or "").encode()), n := len(encoder.encode(t or "")), n > 4096) for k, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(docs_of(spark, []), model_path()).count() == 0


def test_license_places_equal_brute_force(spark):
    rows = [
        (1, "The MIT License; mit-license and permit license, mit license"), (2, None), (3, ""), (4, "Apache Licence here"),
        (5, "under the GNU Genral Public License, version 3. general public license"), (None, "MIT"), (6, "license mit license"),
        (7, "word " * 50_000 + "Apache License"), (7, "plain"), (7, "plain"), (8, "permission is hereby grantd, free of charge to any persn obtaining a copy"),
        (9, "mit"), (10, "license"), (11, "Apache\nLicense"), (12, "All rights reservd."),
    ]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs_of(spark, rows)).collect()}
    for key, text in rows:
        words, places, labels = words_of(text), [], set()
        for phrase, label in licenses.PHRASES:
            parts = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        r = got[(key, len(words))]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == sorted(labels) and labels <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert got[(4, 3)]["labels"] == ["apache"] and got[(4, 3)]["base_labels"] == []
    assert got[(8, 13)]["labels"] == ["mit"] and got[(12, 3)]["labels"] == ["reserved"]
    assert licenses.scan(docs_of(spark, rows)).count() == len(rows) and licenses.scan(docs_of(spark, [])).count() == 0


def distance(a, b):
    """Edits that turn ``a`` into ``b``, by dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


@seed(1)
@settings(max_examples=150, deadline=None)
@given(st.data())
def test_notices_with_permitted_edits_are_found(data):
    notice, label = data.draw(st.sampled_from(licenses.NOTICES))
    text = list(notice)
    for _ in range(licenses.edits(notice)):
        at = data.draw(st.integers(1, len(text) - 2))
        kind = data.draw(st.sampled_from("sid"))
        text[at : at + (kind != "i")] = [] if kind == "d" else ["q"]
    whole = "Some words before " + "".join(text) + " and some after"
    raw = whole.encode()
    found = licenses._scan_slice(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    # The operator sees words with single blanks; there an edit may be one more.
    edited = " ".join("".join(text).split())
    if distance(edited, notice) <= licenses.edits(notice):
        assert label in found[0][5]
    words, limit = whole.split(), {of: max(licenses.edits(n) for n, x in licenses.NOTICES if x == of) for _, of in licenses.NOTICES}
    for span in found[0][7]:
        place = " ".join(words[span["first"] : span["end"]])
        notices = [n for n, x in licenses.NOTICES if x == span["label"]]
        assert min(distance(place, n) for n in notices) <= span["edits"] <= limit[span["label"]]


@pytest.mark.parametrize(
    ("text", "places"),
    [
        ("licensd under cc by licensed under cc by", [(0, 4, 1), (4, 8, 0)]),
        ("licensd under cc by and licensd under cc by licensed under cc by", [(0, 4, 1), (5, 9, 1), (9, 13, 0)]),
        ("licensed under cc by licensd under cc by é licensed undr cc by", [(0, 4, 0), (4, 8, 1), (9, 13, 1)]),
    ],
)
def test_adjacent_notices_are_all_found(text, places):
    raw = text.encode()
    spans = licenses._scan_slice(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0][7]
    assert [(s["first"], s["end"], s["edits"]) for s in spans] == places


def test_list_of_adjacent_notices():
    for notice in ("licensed under cc by", "licensed under the mit license", "all rights reserved"):
        edited = notice[:2] + notice[3:]
        for n in (1, 5, 60):
            raw = " ".join([edited] * n + [notice]).encode()
            spans = licenses._scan_slice(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0][7]
            size = len(notice.split())
            got = {(s["first"], s["edits"]) for s in spans}
            assert {(size * k, 1) for k in range(n)} | {(size * n, 0)} <= got
