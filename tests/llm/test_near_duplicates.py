"""Components, the n-gram join and the vector index against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from parcelmill.llm import embeddings, ngram_join
from parcelmill.llm.components import components

DOCS = "doc_id long, text string, `set` string, component_id string, n string"


def joined(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    links += [(k, k + 1) for k in range(500, 540)] + [(700, 700), (800, 801), (801, 800)] + [(900, k) for k in range(901, 960)]
    nodes = {n for a, b in links for n in (a, b) if a != b}
    got = components(spark.createDataFrame(links, "a long, b long"))
    # Every node with a link has a row, the smallest of its component too.
    assert {r["node"]: r["component"] for r in got.collect()} | {n: n for n in set(joined(nodes, []) ) if n in {joined(nodes, [x for x in links if x[0] != x[1]])[n]}} == joined(
        nodes, [x for x in links if x[0] != x[1]]
    )


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    root = joined(range(len(rows)), links)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[root[k]] = min(least.get(root[k], key), key)
    return sorted(((key, len(s), least.get(root[k]) if s else key) for k, ((key, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"e{rng.integers(1 << 40)}"
    return words


def corpus(seed):
    """Random texts, chains of edits near the limit, a large group of near copies, passages that many texts share."""
    rng = np.random.default_rng(seed)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 2000, n)]
    texts = [say(int(n)) for n in rng.integers(1, 120, 60)]
    passage = say(30)
    texts += [say(int(n)) + passage + say(int(n)) for n in rng.integers(1, 25, 60)]
    base = say(90)
    texts += [edited(rng, base, int(n)) for n in rng.integers(0, 5, 80)]
    chain = say(80)
    for _ in range(8):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [t for t in texts[:10] for _ in range(3)]
    texts += [["one", "two"], ["one", "two"], ["two", "one"], ["a"], [], ["A", "b", "C"], ["a", "B", "c"]]
    order = rng.permutation(len(texts))
    rows = [(int(k), " ".join(texts[k])) for k in order]
    rows += [(9000, None), (9001, "\t \n"), (None, " ".join(texts[3])), (None, "unlike anything else here at all"), rows[0]]
    rows += [(9002, " ".join(base * 400)), (9003, " ".join(base * 401))]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 32), (2, 4), (3, 2), (4, 1000)])
def test_join_equals_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(3)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs, hot=hot).collect()), key=repr)
    assert got == brute(rows)


def test_first_of_each(spark):
    rows = [r for r in corpus(5) if r[0] is not None]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    least = {key for key, _, component in brute(rows) if key == component}
    assert {r["doc_id"] for r in kept.collect()} == least


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, item string"


def nearby(rows, least=0.9):
    unit = []
    for _, v in rows:
        v = None if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, dtype=np.float32).astype(float)
        unit.append(None if v is None else v / np.linalg.norm(v))
    links = [
        (a, b)
        for a in range(len(rows)) for b in range(a)
        if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    ]
    root = joined(range(len(rows)), links)
    counts = np.bincount(np.array(links).ravel(), minlength=len(rows))
    return sorted(((key, int(counts[k]), rows[root[k]][0]) for k, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block_rows", [512, 16])
def test_vectors_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(7)
    rows = [rng.normal(size=16) for _ in range(150)]
    hub = rng.normal(size=16)
    rows += [hub + rng.normal(size=16) * 0.05 for _ in range(120)] + [hub] * 40 + [3 * hub]
    rows += [rows[k] + rng.normal(size=16) * 0.05 for k in range(30)]
    rows += [[0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, [2.0] * 3, []]
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in enumerate(rows)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)
    got = embeddings.near_vectors(table, block_rows=block_rows).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == nearby(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("pivots", [64, embeddings.MAX_PIVOTS])
def test_recall_near_the_limit(spark, monkeypatch, pivots):
    """Pairs with a cosine of 0.90 to 0.93; the pivots are no vectors of the table, as nearly all are on large ones."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one, aside = unit(rng.normal(size=(600, 64))), rng.normal(size=(600, 64))
    aside = unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    cosine = rng.uniform(0.9001, 0.93, (600, 1))
    other = cosine * one + np.sqrt(1 - cosine**2) * aside
    monkeypatch.setattr(embeddings, "_pivots", lambda drawn: unit(rng.normal(size=(pivots, drawn.shape[1]))))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.concatenate([one, other]))]
    got = embeddings.near_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS).repartition(3)).collect()
    there = nearby(rows)
    assert sum(n for _, n, _ in there) >= 1200
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(n for _, n, _ in there)
    assert sum(r["kept"] for r in got) <= 600 + 0.01 * 600


def test_agreement_is_the_footrule_of_the_orders():
    rng = np.random.default_rng(3)
    near = 6
    one, other = (np.array([rng.permutation(9)[:near] for _ in range(40)]) for _ in range(2))
    shared, like = embeddings.agreement(one[:, None], other[None])
    for i, a in enumerate(one.tolist()):
        for j, b in enumerate(other.tolist()):
            place = lambda order, p: order.index(p) if p in order else near
            footrule = sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})
            assert shared[i, j] == len({*a} & {*b}) and 2 * like[i, j] == near * (near + 1) - footrule
            assert embeddings.agreement(one[i], other[j], 4)[0] == len([p for p in {*a} & {*b} if p <= 4])


def test_positions_of_unrelated_vectors_differ():
    """The bound on positions keeps pairs at the limit and drops most others that share two pivots."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    drawn, pivots = unit(rng.normal(size=(2000, 64))), unit(rng.normal(size=(64, 64)))
    least = embeddings.least_agreement(drawn, pivots, 6, 2, 0.9)
    orders = embeddings.nearest_pivots(drawn[:600], pivots, 6)
    shared, like = embeddings.agreement(orders[:, None], orders[None])
    enough = np.triu(shared >= 2, 1)
    assert least > 0 and (like[enough] >= least).mean() < 0.9
    assert embeddings.least_agreement(np.ones((3, 1)), np.ones((1, 1)), 1, 1, 0.9) == 0


def test_vectors_without_key_or_rows(spark):
    rows = [(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, 0.5])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = sorted((tuple(r) for r in embeddings.near_vectors(table).collect()), key=repr)
    assert got == sorted([(None, 2, None, False), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True)], key=repr)
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    assert [tuple(r) for r in embeddings.near_vectors(table.selectExpr("vec_id", "cast(null as array<float>) embedding").limit(1)).collect()] == [(None, 0, None, False)]


def test_prefixes_follow_the_cost_of_candidates():
    n = 80  # up to 10 matches, 20 shingles may differ
    at = np.arange(30)
    rare, common = np.full(30, 2), np.full(30, 31)
    m, frequent, costly, posted = ngram_join._choice(at, rare, n, 7, 75, 32)
    assert (frequent, costly) == (0, False) and posted.tolist() == list(range(20 + m))
    # Cheap shingles behind dear ones: a longer prefix costs little and saves pairs.
    later = np.concatenate([common[:21], rare[21:]])
    assert ngram_join._choice(at, later, n, 7, 75, 32)[0] > 1
    # Dear shingles behind cheap ones: the shortest prefix.
    assert ngram_join._choice(at, np.concatenate([rare[:21], common[21:]]), n, 7, 75, 32)[0] == 1
    # Frequent shingles in the shortest prefix call for a longer one; too many make a set costly.
    some = rare.copy()
    some[:3] = 100
    m, frequent, costly, posted = ngram_join._choice(at, some, n, 7, 75, 32)
    assert m > 3 and frequent == 3 and not costly and posted.min() == 3
    some[:8] = 100
    m, frequent, costly, posted = ngram_join._choice(at, some, n, 7, 75, 32)
    assert (m, frequent, costly) == (10, 8, True) and posted.tolist() == list(range(8, 30))


@pytest.mark.parametrize("hot", [2, 3, 1000])
def test_join_of_passages_equals_brute_force(spark, hot):
    """Sets built from a small stock of passages, some nearly the same, and lists of few words among them."""
    rng = np.random.default_rng(11)
    stock = [" ".join(f"p{k}w{j}" for j in range(30)) for k in range(10)]
    rows = [(k, " ".join(stock[p] for p in rng.permutation(10)[: int(rng.integers(4, 9))])) for k in range(70)]
    rows += [(100 + k, " ".join(stock[p] for p in [0, 1, 2, 3, 4, 5 + k % 2])) for k in range(12)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(3)
    assert sorted((tuple(r) for r in ngram_join.near_duplicates(docs, hot=hot).collect()), key=repr) == brute(rows)
