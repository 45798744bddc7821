"""Exact top-k search, spelling variants and the divergence audit against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.llm import divergence, spelling, top_k

LOW = "abcdefghijklmnopqrstuvwxyz"
UP = LOW.upper()


def lower(text):
    return text.translate(str.maketrans(UP, LOW))


# Top-k search

SPARSE = "id long, terms array<string>, weights array<long>, score string"


def products(rows, asked, k):
    usable = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) == len(r[2]) and None not in r[1] and None not in r[2]
    known = {(r[0], tuple(r[1]), tuple(r[2])) for r in rows if usable(r)}
    out = []
    for key, terms, weights in {(r[0], tuple(r[1]), tuple(r[2])) for r in asked if usable(r)}:
        wanted = defaultdict(int)
        for t, w in zip(terms, weights, strict=True):
            wanted[t] += w
        scored = []
        for other, *lists in known:
            if other != key:
                score = sum(wanted[t] * w for t, w in zip(*lists, strict=True))
                scored.append((-min(max(score, top_k.LOWEST), top_k.HIGHEST), other))
        out += [(key, rank + 1, other, -score) for rank, (score, other) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def random_rows(rng, n):
    rows = []
    for key in range(n):
        size = int(rng.integers(0, 7))
        rows.append((key, [f"t{x}" for x in rng.integers(0, 12, size)], [int(x) for x in rng.integers(-3, 4, size)], "x"))
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_top_k_equals_brute_force(spark, monkeypatch, small):
    if small:  # many chunks and blocks
        monkeypatch.setattr(top_k, "CHUNK_TERMS", 40)
        monkeypatch.setattr(top_k, "BLOCK_TERMS", 30)
    rows = random_rows(np.random.default_rng(5), 150)
    rows += rows[:5] + [(7, ["t1"], [9], "other lists"), (None, ["t1"], [1], "x"), (200, None, [1], "x"), (201, ["t1"], None, "x")]
    rows += [(202, ["t1"], [1, 2], "x"), (203, ["t1", None], [1, 2], "x"), (204, ["t1"], [None], "x"), (205, [], [], "x"), (-3, ["t1"] * 500, [1] * 500, "x")]
    rows += [(300, ["t2"], [5], "x")] * 200  # one row repeated
    df = spark.createDataFrame(rows, SPARSE)
    asked = [r for r in rows if r[0] is None or r[0] % 3 == 0]
    got = top_k.top_k(df, spark.createDataFrame(asked, SPARSE), 4)
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == products(rows, asked, 4)


def test_fewer_candidates_than_ranks_and_none(spark):
    rows = random_rows(np.random.default_rng(6), 4)
    df = spark.createDataFrame(rows, SPARSE)
    assert sorted(tuple(r) for r in top_k.top_k(df, df, 5).collect()) == products(rows, rows, 5)
    assert top_k.top_k(df.limit(0), df, 5).count() == 0 and top_k.top_k(df, df.limit(0), 5).count() == 0
    one = df.where("id = 1")
    assert top_k.top_k(one, one, 5).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 1 << 40, 1 << 62])
def test_large_weights(spark, size):
    rows = [(k, ["a", "b", "a"], [size - k, -size + 3 * k, k], "x") for k in range(9)]
    df = spark.createDataFrame(rows, SPARSE)
    assert sorted(tuple(r) for r in top_k.top_k(df, df, 3).collect()) == products(rows, rows, 3)


def test_scaled_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [([0.5, -0.001, 0.0, 1.0],), ([],), (None,), ([1.0, None],), ([1.0, nan],), ([inf],), ([1e300],)]
    df = spark.createDataFrame(rows, "v array<double>")
    terms, weights = top_k.scaled(F.col("v"), 256)
    got = [tuple(r) for r in df.select(terms.alias("t"), weights.alias("w")).collect()]
    assert got[0] == ([0, 1, 3], [128, -1, 256]) and got[1] == ([], []) and got[2:6] == [(None, None)] * 4
    assert got[6] == ([0], [top_k.HIGHEST])


@seed(1)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=40), st.integers(1, 9))
def test_best_places(scores, k):
    got = sorted(top_k.best(np.array(scores), k).tolist())
    assert got == sorted(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k])


# Spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants(counts, least=2, ratio=10):
    total = Counter()
    for word, n in counts:
        if word is not None:
            total[word] += n or 0
    words = {w: n for w, n in total.items() if n >= least}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = top if top is not None and words[top] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def mutated(rng, word):
    letters = "abcdeéß×ñüz"
    at = int(rng.integers(0, len(word)))
    kind, new = rng.integers(0, 3), letters[int(rng.integers(0, len(letters)))]
    return word[:at] + (new if kind < 2 else "") + word[at + (kind != 1) :]


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_variants_equal_brute_force(spark, symbols):
    rng = np.random.default_rng(8)
    words = {"", "a", "b", "ab", "aaaaaaaa", "aaaaaaa", "aaaaaaab", "x" * 60, "x" * 61}
    while len(words) < 60:
        words.add("".join(rng.choice(list("abceé"), int(rng.integers(1, 9)))))
    for _ in range(3):  # chains of edits
        words |= {mutated(rng, w) for w in sorted(words) if w}
    counts = [(w, int(10 ** rng.integers(0, 5) * rng.integers(1, 4))) for w in sorted(words)]
    counts += counts[:20] + [(None, 99), ("nought", None), ("once", 1)]
    df = spark.createDataFrame([(*c, "x") for c in counts], "word string, n long, root string").repartition(3)
    got = spelling.spelling_variants(df, symbols=symbols)
    assert sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()) == variants(counts)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_long_chain_of_forms(spark):
    counts = [("w" * (k + 1), 2 * 10**k) for k in range(15)]
    df = spark.createDataFrame(counts, "word string, n long")
    assert {r["root"] for r in spelling.spelling_variants(df).collect()} == {"w" * 15}


def plain_hash(word, symbols):
    return sum((ord(c) % symbols + 1) * int(spelling._BASE) ** k for k, c in enumerate(word)) % (1 << 64)


@seed(1)
@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abéx", max_size=9), min_size=1, max_size=5), st.integers(1, 5), st.sampled_from([1, 64, 1 << 20]))
def test_neighbourhoods_are_full(words, symbols, at_once):
    old, spelling.MADE_AT_ONCE = spelling.MADE_AT_ONCE, at_once
    try:
        assert spelling.reduced_hashes(pa.array(words), symbols).tolist() == [plain_hash(w, symbols) for w in words]
        made = [set() for _ in words]
        for places, hashes in spelling.neighbourhoods(pa.array(words), symbols):
            for place, h in zip(places.tolist(), hashes.tolist(), strict=True):
                made[place].add(h)
    finally:
        spelling.MADE_AT_ONCE = old
    alphabet = [chr(s + 256 * symbols * 100) for s in range(symbols)]  # one code point for each symbol
    for word, found in zip(words, made, strict=True):
        wanted = {plain_hash(word, symbols)}
        for k in range(len(word) + 1):
            wanted |= {plain_hash(word[:k] + c + word[k:], symbols) for c in alphabet}
            if k < len(word):
                wanted |= {plain_hash(word[:k] + c + word[k + 1 :], symbols) for c in ["", *alphabet]}
        assert found == wanted


DOCS = "doc_id long, text string, lang string, source string, `word` string, n string"


def test_runs_and_misspelt(spark):
    texts = ["Alphabet, ALPHABET2alphabets ÉCOLES_àÿÀabcd ×÷ßabcdé short", None, "", "abcdefg" * 50 + " " + "word" * 30, "а бвгдежз latinword"]
    rows = [(None if k == 4 else k, t, None, None, "x", "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    want = [(None if k == 4 else k, lower(r)) for k, t in enumerate(texts) for r in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(r) >= 7]
    for piece in (1 << 20, 5):
        got = spelling.runs(df, "A-Za-zÀ-ÿ", 7, piece=piece)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)

    def cut(key, run, one_in):
        h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
        at = h % len(run)
        return run[:at] + run[at + 1 :] if h % one_in == 0 else run

    for one_in in (1, 2, 31):
        named = got.select("key", "run", spelling.misspelt(F.col("key"), F.col("run"), one_in).alias("word")).collect()
        assert all(r["word"] == cut(r["key"], r["run"], one_in) for r in named)


# Divergence audit


def audited(rows, min_docs, top):
    rows = [[x or "" for x in r] for r in rows]
    terms = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    docs, counts = Counter(), defaultdict(Counter)
    for lang, source, found in terms:
        docs.update({(lang, t) for t in found})
        counts[lang, source].update(found)
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for (of, t), n in docs.items() if of == lang and n >= min_docs)
        of_lang = {source: c for (of, source), c in counts.items() if of == lang}
        whole = Counter()
        for c in of_lang.values():
            whole.update(c)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}  # noqa: B023

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(whole)
        for source, c in of_lang.items():
            p = shares(c)
            pairs = [(-sum(f(p[t], r[t]) for t in kept), o) for o, r in ((o, shares(c)) for o, c in of_lang.items() if o != source)]
            best = [(-f(p[t], q[t]), t) for t in kept if c[t] and p[t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", best, top)):
                order = sorted(found, key=lambda x: (x[0], x[1].encode()))[:limit]
                out += [(lang, source, part, item, -value, k + 1) for k, (value, item) in enumerate(order)]
    return sorted(out)


def mixed_docs(rng):
    vocabulary = [f"{a}{b}" for a in "abcdéß" for b in ("", "x", "yy", "ZZ", "中")]
    weights = rng.dirichlet(np.ones(len(vocabulary)))
    rows = []
    for k in range(240):
        lang, source = ["en", "de", None, ""][k % 4 if k % 3 else 0], [None, "", "s1", "s2", "s3"][int(rng.integers(0, 5))]
        words = rng.choice(vocabulary, int(rng.integers(0, 30)), p=weights)
        rows.append((" ,1_".join(words), lang, source))
    rows += rows[:7] + [(None, "en", "no text"), ("", "en", "s1"), ("rare words only", "xx", "a"), (None, "xx", "b"), ("alone", "yy", "a"), ("c", "de", "y" * 5000)]
    return rows + [("A ax Ayy " * 40_000, "en", "s2")]


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:  # many slices, tiles and blocks; the functions inside tasks take these as they are sent
        monkeypatch.setattr(divergence, "SLICE_POSTINGS", 7)
        monkeypatch.setattr(divergence, "TASK_PAIRS", 9)
    rows = mixed_docs(np.random.default_rng(9))
    df = spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], DOCS.replace("word", "term")).repartition(4)
    got = divergence.audit(df, min_docs=4, top=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, 4, 3)


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert divergence.audit(df).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, None, None)], DOCS)
    assert divergence.audit(alone).count() == 0


@pytest.mark.parametrize("slice_bytes", [16, 300])
def test_counts_of_texts_longer_than_a_slice(spark, slice_bytes):
    rows = mixed_docs(np.random.default_rng(10))[:60] + [("A ax Ayy é1b " * 500, "en", "s2"), ("long" * 200, "en", "s2")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    count = lambda size: sorted(map(tuple, divergence.term_counts(df, slice_bytes=size).collect()))
    assert count(slice_bytes) == count(1 << 22)


def test_blocks_of_long_texts():
    raw = np.frombuffer(("ab cd1" + "é" * 50 + " x" * 20 + "zzz").encode(), dtype=np.uint8)
    for limit in (1, 3, 10, 1000):
        parts = list(divergence._blocks(raw, limit))
        assert np.array_equal(np.concatenate(parts), raw)
        for a, b in zip(parts, parts[1:], strict=False):
            assert not (divergence.LETTERS[a[-1]] and divergence.LETTERS[b[0]])


def test_slices_in_small_scatters(monkeypatch):
    rng = np.random.default_rng(2)
    codes, peers = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(6)))
    chosen = rng.random(len(codes)) < 0.5
    codes, peers = np.unique(codes[chosen], return_inverse=True)[1], peers[chosen]
    p, base = rng.integers(2, 10**9, len(codes)), rng.integers(1, 10**6, 6)
    dense = np.tile(base, (codes.max() + 1, 1))
    dense[codes, peers] = p
    for at_once in (1, 5, 1 << 20):
        monkeypatch.setattr(divergence, "SCATTERED", at_once)
        index = divergence._Slice(codes, peers, p, 6)
        for row in range(6):
            mine = peers == row
            got = divergence._accumulate(row, p[mine], index, base, codes[mine])
            want = divergence.distance(dense[:, [row]], dense).sum(axis=0)
            assert np.array_equal(np.delete(got, row), np.delete(want, row))
