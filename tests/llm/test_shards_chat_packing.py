"""Sharding, chat collapse and packing against plain Python, with the awkward inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.llm import chat, packing, sharding

DOCS = "doc_id long, source string, text string, shard string, `a.b` string, rank int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


def interleaved(rows, shards):
    """(key, source, crc, shard, slot) by sorting everything in one list."""
    by_source = {}
    for key, source, text in rows:
        draw = hashlib.md5(f"42|{'' if key is None else key}".encode()).hexdigest()
        crc = None if text is None else zlib.crc32(text.encode())
        size = (0 if text is None else len(text.encode())) + 1
        low = lambda x: (x is not None, x or 0)
        by_source.setdefault(source, []).append((draw, low(key), low(crc), size, key, crc))
    placed = []
    for source, of in by_source.items():
        for k, (draw, lk, lc, size, key, crc) in enumerate(sorted(of, key=lambda r: r[:4])):
            placed.append(((k + 0.5) / len(of), (source is not None, source or ""), draw, lk, lc, size, key, source, crc))
    placed.sort(key=lambda r: r[:6])
    out, seen = [], {}
    for place, (*_, key, source, crc) in enumerate(placed):
        shard = place * shards // len(placed)
        out.append((key, source, crc, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + 1
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_follow_the_mixture(spark, shards):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", f"text é {k}") for k in range(200)]
    rows += [(None, None, None), (None, None, "x"), (5, "hot", "again"), (5, "hot", "again"), (7, "s1", "")]
    got = sharding.interleave_shards(docs_of(spark, rows), shards).collect()
    mine = [(r["doc_id"], r["source"], r["text_crc32"], r["shard"], r["slot"]) for r in got]
    assert sorted(mine, key=repr) == sorted(interleaved(rows, shards), key=repr)
    counts = [sum(r["shard"] == s for r in got) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    hot = [sum(r["shard"] == s and r["source"] == "hot" for r in got) for s in range(shards)]
    # The cut follows the rows, so rounding in each of the sources may move it by a row.
    assert max(hot) - min(hot) <= 2 + len({r[1] for r in rows})


def test_shards_of_nothing(spark):
    assert sharding.interleave_shards(docs_of(spark, []), 8).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave_shards(docs_of(spark, []), 0)


TURNS = "conv_id long, turn long, role string, text string, conv string, turns string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def collapsed(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append(((turn is not None, turn or 0), role or "unknown", text or ""))
    for said in conversations.values():
        said.sort(key=lambda t: (t[0], t[1], hashlib.sha256(f"{len(t[1])}|{t[1]}|{t[2]}".encode()).hexdigest()))
    keys = {c: tuple(t[1:] for t in said) for c, said in conversations.items()}
    proper = {k[:n] for k in keys.values() for n in range(1, len(k))}
    out = {}
    for c, k in keys.items():
        if k not in proper:
            out.setdefault(k, []).append(c)
    return {
        (min((c for c in of if c is not None), default=None), len(k), len(of), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in k))
        for k, of in out.items()
    }


def test_snapshots_collapse_to_the_longest(spark):
    rows = []
    for conv in range(1, 7):  # 1 to 6 are snapshots of one conversation, 6 the longest
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(conv)]
    rows += [(10, 0, "user", "turn 0"), (10, 1, "assistant", "another way")]  # branches off
    rows += [(11, 0, "user", "turn 0"), (11, 1, "assistant", "another way")]  # equal to 10
    rows += [(12, 0, "use", "rturn 0")]  # same letters, other role
    rows += [(None, 0, None, None), (None, 1, "user", "no id"), (13, None, "user", ""), (14, 0, "user", None)]
    rows += [(15, 3, "user", "b"), (15, 3, "user", "a")]  # a turn number twice
    rows += [(16, 0, "user", "long " * 20_000)]
    got = chat.maximal_conversations(turns_of(spark, rows)).collect()
    assert {(r["conv_id"], r["n_turns"], r["n_copies"], r["rendered"]) for r in got} == collapsed(rows)
    assert not {1, 2, 3, 4, 5} & {r["conv_id"] for r in got}


def test_very_common_first_turn(spark):
    rows = [(c, k, "user", "hello" if k == 0 else f"{c}/{k}") for c in range(300) for k in range(2 - (c % 3 == 0))]
    got = chat.maximal_conversations(turns_of(spark, rows)).collect()
    assert {(r["conv_id"], r["n_turns"], r["n_copies"], r["rendered"]) for r in got} == collapsed(rows)


def test_no_conversations(spark):
    assert chat.maximal_conversations(turns_of(spark, [])).count() == 0


def brute_filling(lengths, room):
    """Pieces from long to short, each that still fits."""
    total = 0
    for length in lengths:
        if length <= room - total:
            total += length
    return total


def brute_best_fit(lengths, capacities, cost):
    """(contents, size it was opened with) of each bin."""
    bins = []  # [used, opened size, last piece]
    for k, length in enumerate(lengths):
        open_ = [(b[1] - b[0], -b[2], n) for n, b in enumerate(bins) if b[1] - b[0] >= length]
        if open_:
            n = min(open_)[2]
        else:
            prices = []
            for c in capacities:
                if c >= length:
                    content = length + brute_filling(lengths[k + 1 :], c - length)
                    prices.append((cost(min(s for s in capacities if s >= content)) / content, -c))
            bins.append([0, -min(prices)[1], 0])
            n = len(bins) - 1
        bins[n][0] += length
        bins[n][2] = k + 1
    return [(b[0], b[1]) for b in bins]


def small_cost(c):
    return 6 + c + c * c / 40


@seed(1)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_equals_brute_force(lengths):
    capacities = [8, 20, 40]
    lengths = sorted(lengths, reverse=True)
    where, offsets, final, opened = packing.best_fit(lengths, capacities, small_cost)
    used = [0] * len(final)
    for length, bin_, offset in zip(lengths, where, offsets, strict=True):
        assert offset == used[bin_]
        used[bin_] += length
    assert list(zip(used, opened, strict=True)) == brute_best_fit(lengths, capacities, small_cost)
    assert final == [min(c for c in capacities if c >= n) for n in used]


def test_choosing_sizes_and_reducing_them_both_save():
    rng = random.Random(4)
    totals = {"ours": 0.0, "as opened": 0.0, "smallest": 0.0, "largest": 0.0}
    reduced = 0
    for _ in range(200):
        lengths = sorted((rng.choice([rng.randint(9, 18), rng.randint(11, 13)]) for _ in range(rng.randint(1, 40))), reverse=True)
        _, _, final, opened = packing.best_fit(lengths, [8, 20, 40], small_cost)
        totals["ours"] += sum(map(small_cost, final))
        totals["as opened"] += sum(map(small_cost, opened))
        reduced += sum(a < b for a, b in zip(final, opened, strict=True))
        # One permitted length only, and the smallest that fits each first piece (any cost that doesn't look ahead).
        totals["largest"] += sum(map(small_cost, packing.best_fit(lengths, [40], small_cost)[2]))
        totals["smallest"] += sum(map(small_cost, packing.best_fit(lengths, [8, 20, 40], lambda c: c**3)[2]))
    assert reduced > 10
    assert totals["ours"] < totals["as opened"] and totals["ours"] < 0.99 * totals["smallest"] and totals["ours"] < 0.99 * totals["largest"]


def test_real_lengths_cost_less_than_any_single_length():
    rng = random.Random(5)
    lengths = sorted((min(int(rng.lognormvariate(5.5, 1.2)) + 1, 4096) for _ in range(2_000)), reverse=True)
    ours = sum(map(packing.sequence_cost, packing.best_fit(lengths)[2]))
    assert ours < sum(map(packing.sequence_cost, packing.best_fit(lengths, [4096])[2]))
    assert ours < sum(map(packing.sequence_cost, packing.best_fit(lengths, cost=lambda c: c**3)[2]))


def test_pack_keeps_every_word_once(spark):
    rows = [(k, "s", " ".join(["w"] * (k * 37 % 900))) for k in range(300)]
    rows += [(None, None, None), (None, "s", "a b"), (1, "s", ""), (2, "s", "x " * 30_000), (3, "s", "same"), (3, "s", "same")]
    length = F.size(F.split("text", " "))
    docs = docs_of(spark, rows)
    got = packing.pack(docs, F.when(F.length("text") > 0, length), capacities=(64, 256, 512), group_rows=50).collect()
    expected = sorted((str(r[0]), len(r[2].split(" ")) if r[2] else 0) for r in rows)
    total = {}
    for r in got:
        assert 0 <= r["length"] <= 512 and r["start"] == r["piece"] * 512
        total[str(r["doc_id"])] = total.get(str(r["doc_id"]), 0) + r["length"]
    assert {k: sum(n for key, n in expected if key == k) for k, _ in expected} == total
    bins = {}
    for r in got:
        assert (r["length"] == 0) == (r["bin"] is None) == (r["capacity"] is None) == (r["bin_offset"] is None)
        if r["bin"] is not None:
            bins.setdefault((r["pack_group"], r["bin"]), []).append(r)
    for of in bins.values():
        of.sort(key=lambda r: (r["bin_offset"], r["length"]))
        assert [r["bin_offset"] for r in of] == [sum(x["length"] for x in of[:k]) for k in range(len(of))]
        used = sum(r["length"] for r in of)
        assert {r["capacity"] for r in of} == {min(c for c in (64, 256, 512) if c >= used)}
    assert packing.pack(docs_of(spark, []), length).count() == 0


def test_word_count(spark):
    df = spark.createDataFrame([("a b\tc\n",), ("",), (None,), ("   ",), ("é",)], "text string")
    assert [r[0] for r in df.select(packing.word_count(F.col("text"))).collect()] == [4, 0, 0, 0, 2]
