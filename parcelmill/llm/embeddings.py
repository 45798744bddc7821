"""Near-duplicate vectors by a permutation index over pivots.

Pivots are reference vectors from a bounded sample of the table, none a near copy
of another; their number follows the root of the row count within fixed bounds. A vector is
described by its ``near`` nearest pivots in order, more of them the more pivots there
are. Each vector is entered in the inverted
list of every combination of ``shared`` of its pivots, so a list holds just the
vectors that share them. A pair meets in one list only, the first of its
common combinations.

Lists are cut into blocks of at most ``block_rows`` vectors and every pair of
blocks is a task of its own, so a group of copies as large as a third of the
table is spread over many tasks. A first pass over the lists sees the orders of
pivots alone: a pair is a candidate if it shares enough pivots and these stand at
like positions in both orders (``agreement``). How far the positions of vectors at
the limit drift apart is measured on drawn pairs (``least_agreement``). Only vectors that have a
candidate are loaded, for the blocks in which they have one, and verified by their cosine.
A task returns counts and a spanning set of links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.llm.common import field, written
from parcelmill.llm.components import components

#: Fewest nearest pivots that describe a vector; ``near_count`` asks for more with more pivots.
NEAR = 6
SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 64, 4_096
#: Vectors drawn for each pivot wanted, and the cosine from which one is too close to a pivot.
PIVOT_SAMPLE, PIVOT_COSINE = 4, 0.8
BLOCK_ROWS = 512
#: Pairs at the limit drawn to learn how like their orders of pivots are, and the share of them that the bound may lose.
TRIALS, LOST = 4_096, 0.002
#: Positions compared at once, which bounds the memory of a step.
PAIR_CELLS = 1 << 21
SEED = 42


def pivot_count(rows: int) -> int:
    wanted = 64
    while wanted * wanted < 4 * rows:
        wanted *= 2
    return min(max(wanted, MIN_PIVOTS), MAX_PIVOTS)


def near_count(pivots: int) -> int:
    """Nearest pivots by which a vector is described: 6 of 64, 12 of 4,096.

    Among more pivots the order of the nearest is less stable; with a fixed number two vectors at
    the limit would share too few of them on large tables.
    """
    return max(NEAR, (pivots - 1).bit_length())


def agreement(one: np.ndarray, other: np.ndarray, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shared pivots of two arrays of orders, and how like their positions are; the arrays are broadcast.

    A shared pivot counts ``near`` less the later of its two positions (from 0), so the sum is what
    the footrule distance of the orders leaves of its greatest value, halved. With ``top``, only
    pivots up to this number are counted as shared.
    """
    near = one.shape[-1]
    same = (one[..., :, None] == other[..., None, :]).astype(np.float32)
    flat = same.reshape(-1, near * near)  # a view: what is cleared below is cleared in both
    like = flat @ _weights(near)
    if top is not None:
        same *= (one <= top)[..., :, None]
    shared = flat @ np.ones(near * near, dtype=np.float32)
    return shared.astype(np.int32).reshape(same.shape[:-2]), like.astype(np.int32).reshape(same.shape[:-2])


@lru_cache
def _weights(near: int) -> np.ndarray:
    """What a pivot at positions (i, j) counts, row by row."""
    place = np.arange(near)
    return (near - np.maximum.outer(place, place)).ravel().astype(np.float32)


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` pivots with the greatest cosine for each row, nearest first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :near].astype(np.int32)


def least_agreement(drawn: np.ndarray, pivots: np.ndarray, near: int, shared: int, least: float) -> int:
    """The likeness of positions that all but ``LOST`` of the pairs at the limit reach, among those that share enough pivots.

    Each of at most ``TRIALS`` drawn vectors gets a partner at a cosine of exactly ``least`` in a seeded random
    direction. 0 leaves every pair that shares enough pivots a candidate, as where no partner exists
    (fewer than two dimensions).
    """
    drawn = drawn[:TRIALS]
    if drawn.shape[1] < 2 or not 0 < least < 1:
        return 0
    aside = np.random.default_rng(SEED).normal(size=drawn.shape)
    aside -= (aside * drawn).sum(axis=1, keepdims=True) * drawn
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    partner = least * drawn + np.sqrt(1 - least * least) * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 0)
    seen = []
    for at in range(0, len(drawn), 512):
        common, like = agreement(*(nearest_pivots(x[at : at + 512], pivots, near) for x in (drawn, partner)))
        seen.append(like[common >= shared])
    seen = np.concatenate(seen) if seen else np.zeros(0, dtype=np.int16)
    return int(np.quantile(seen, LOST, method="lower")) if len(seen) else 0


def _unit(lists: pa.ListArray, size: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(vector):
    """True for vectors with a direction: no missing or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    least: float = 0.9,
    near: int | None = None,
    shared: int = SHARED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    ``n_links`` counts the other rows found with a cosine of at least ``least``;
    ``component_id`` is the smallest key reachable by links; ``kept`` marks it.
    Without ``near``, ``near_count`` gives it.

    Vectors that are missing, zero or hold missing or non-finite components link
    with nothing, and so do vectors of different lengths with each other. Equal
    vectors are compared once and counted as often as they occur. Rows of one
    key are one node, linked by all its vectors. A row without a key gets no
    component; it counts as a link of others. An empty table gives no rows.
    """
    rows = vectors.select(field(key).alias("key"), field(vector).alias("vector"))
    # Equal vectors form one item, named by a hash of 128 bits so that nothing is gathered per key.
    named = rows.withColumn("usable", usable(F.col("vector"))).withColumn("item", F.when(F.col("usable"), F.md5(F.to_json("vector").cast("binary"))))
    items = written(
        named.where("usable").groupBy("item").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("times"), F.min("key").alias("key")),
        "vectors",
    )
    sizes = sorted(r["size"] for r in items.select(F.size("vector").alias("size")).distinct().collect())
    found = None
    for size in sizes:
        of_size = items.where(F.size("vector") == size)
        part = _links(of_size, size, least, near, shared, block_rows)
        found = part if found is None else found.unionByName(part)
    keyed = named.select("key", "item")
    if found is None:
        return keyed.select(
            F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"),
            F.col("key").isNotNull().alias("kept"),
        )
    found = written(found, "vector-links")
    counts = found.where("other is null").groupBy("item").agg(F.sum("n").alias("n"))
    groups = components(found.where("other is not null"), "item", "other")
    of_items = (
        items.select("item", "times", F.col("key").alias("least_key"))
        .join(counts, "item", "left")
        .join(groups.select(F.col("node").alias("item"), "component"), "item", "left")
        .withColumn("component", F.coalesce("component", "item"))
    )
    smallest = of_items.groupBy("component").agg(F.min("least_key").alias("component_id"))
    per_item = of_items.join(smallest, "component").select(
        F.col("item").alias("of_item"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), "component_id"
    )
    joined = keyed.join(per_item, F.col("item") == F.col("of_item"), "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )


def _links(items: DataFrame, size: int, least: float, near: int | None, shared: int, block_rows: int) -> DataFrame:
    """(item, other, n): links for components, and rows without ``other`` that add n to the item's count."""
    drawn = _drawn(items, size)
    pivots = _pivots(drawn)
    near = min(near_count(len(pivots)) if near is None else near, len(pivots))
    shared = min(shared, near)
    rule = _Rule(near, shared, least_agreement(drawn, pivots, near, shared, least), len(pivots))
    reference = items.sparkSession.sparkContext.broadcast(pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                order = nearest_pivots(_unit(part.column("vector"), size), reference.value, near)
                yield pa.record_batch(
                    [*part.columns, pa.array(list(order), pa.list_(pa.int32()))], names=["item", "vector", "times", "nearest"]
                )

    kind = items.schema["vector"].dataType.simpleString()
    described = items.select("item", "vector", "times").mapInArrow(
        describe, f"item string, vector {kind}, times long, nearest array<int>"
    )
    described = written(described, "described")
    picks = list(combinations(range(near), shared))
    # A list is named by its pivots in rising order, as one number.
    names = [
        "aggregate(array_sort(array(" + ", ".join(f"nearest[{k}]" for k in pick) + f")), 0L, (a, p) -> a * {len(pivots)} + p)" for pick in picks
    ]
    entries = described.select("item", "nearest", F.explode(F.array(*[F.expr(n) for n in names])).alias("list"))
    sizes = entries.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # Lists of one vector are gone; longer ones are cut into blocks by a hash of the item.
    placed = entries.join(sizes, "list").select(
        "item", "nearest", "list", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks")
    ).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # Block b meets every block c: the pair (low, high) gets both.
    copies = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "item", "nearest", "list", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")
    )

    def screen(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        """The rows that have a candidate in their pair of blocks."""
        wanted = np.zeros(table.num_rows, dtype=bool)
        orders = _orders(table)
        for a, b, top in _meetings(table, cuts, rule):
            common, like = agreement(orders[a][:, None], orders[b][None], top)
            one, other = np.nonzero((common == rule.shared) & (like >= rule.like))
            apart = a[one] != b[other]
            wanted[a[one[apart]]] = wanted[b[other[apart]]] = True
        kept = table.select(["item", *_PLACE, "block"]).filter(pa.array(wanted)).combine_chunks()
        return pa.record_batch([c.combine_chunks() for c in kept.columns], names=kept.column_names)

    def verify(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        return _verified(table, cuts, size, least, rule)

    def by_place(rows: DataFrame, work, schema: str) -> DataFrame:
        """Apply ``work`` to the rows of whole pairs of blocks; a pair may reach over batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
                places = [table.column(c).to_numpy() for c in _PLACE]
                new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in places], axis=0)) + 1
                if len(new):
                    yield work(table.slice(0, new[-1]), [0, *new.tolist()])
                rest = table.slice(new[-1]) if len(new) else table
            if rest is not None and rest.num_rows:
                yield work(rest, [0, rest.num_rows])

        return rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(run, schema)

    screened = by_place(copies, screen, "item string, list long, low int, high int, block int")
    return by_place(screened.join(described, "item"), verify, "item string, other string, n long")


#: The columns that name a pair of blocks of a list.
_PLACE = ["list", "low", "high"]


class _Rule(NamedTuple):
    """Which pairs are candidates: pivots of an order, shared ones, likeness of their positions, and the base of list names."""

    near: int
    shared: int
    like: int
    base: int


def _drawn(items: DataFrame, size: int) -> np.ndarray:
    """A seeded sample of the vectors, ``PIVOT_SAMPLE`` for each pivot wanted."""
    wanted = PIVOT_SAMPLE * pivot_count(items.count())
    rows = items.orderBy(F.xxhash64(F.lit(SEED), "item"), "item").limit(wanted).select("vector").collect()
    return _unit(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), size)


def _pivots(drawn: np.ndarray) -> np.ndarray:
    """Reference vectors that are no near copies of each other, at most a quarter of ``PIVOT_SAMPLE`` times their number.

    Pivots inside one group of copies would tell its members apart by chance
    only, and their lists would miss each other.
    """
    wanted = min(max(len(drawn) // PIVOT_SAMPLE, MIN_PIVOTS), MAX_PIVOTS)
    chosen = np.zeros((wanted, drawn.shape[1]))
    count = 0
    for vector in drawn:
        if count < wanted and (count == 0 or (chosen[:count] @ vector).max() < PIVOT_COSINE):
            chosen[count] = vector
            count += 1
    return chosen[:count]


def _orders(table: pa.Table) -> np.ndarray:
    return table.column("nearest").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _meetings(table: pa.Table, cuts: list[int], rule: _Rule) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows that meet between two cuts, as two index arrays and the last pivot of their list.

    All rows of a list share its pivots. It is the list in which a pair is compared if they share
    no other pivot up to the last one. Some rows come at a time, which bounds the memory.
    """
    lists, low, high, block = (table.column(c).to_numpy() for c in (*_PLACE, "block"))
    cuts = cuts if cuts[-1] == table.num_rows else [*cuts, table.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        rows = np.arange(start, end)
        within = low[start] == high[start]
        a, b = (rows, rows) if within else (rows[block[rows] == low[start]], rows[block[rows] == high[start]])
        step = max(1, PAIR_CELLS // (len(b) * rule.near**2)) if len(b) else len(a) + 1
        for at in range(0, len(a) if len(b) else 0, step):
            yield a[at : at + step], b, int(lists[start] % rule.base)


def _verified(table: pa.Table, cuts: list[int], size: int, least: float, rule: _Rule) -> pa.RecordBatch:
    """Counts and a spanning set of links of each group of rows between two cuts.

    The product of the blocks costs less than comparing orders, so it comes first; links are
    the candidates among the pairs that pass it.
    """
    times = table.column("times").to_numpy()
    unit = _unit(table.column("vector").combine_chunks(), size)
    items, orders = table.column("item"), _orders(table)
    found_one, found_other = [], []
    for a, b, top in _meetings(table, cuts, rule):
        one, other = np.nonzero(unit[a] @ unit[b].T >= least)
        one, other = a[one], b[other]
        # Between blocks all rows of one come apart from those of the other; within one, a pair counts once.
        once = one < other if np.isin(a[:1], b).any() else one != other
        one, other = one[once], other[once]
        if not len(one):
            continue
        common, like = agreement(orders[one], orders[other], top)
        linked = (common == rule.shared) & (like >= rule.like)
        found_one.append(one[linked])
        found_other.append(other[linked])
    one = np.concatenate(found_one) if found_one else np.zeros(0, dtype=np.int64)
    other = np.concatenate(found_other) if found_other else np.zeros(0, dtype=np.int64)
    n = np.zeros(len(unit), dtype=np.int64)
    np.add.at(n, one, times[other])
    np.add.at(n, other, times[one])
    counted = np.flatnonzero(n)
    tree = list(_forest(one.tolist(), other.tolist()))
    nodes = pa.array(np.concatenate([counted, np.array([k for k, _ in tree], dtype=np.int64)]))
    others = pa.array([None] * len(counted) + [m for _, m in tree], pa.int64())
    return pa.record_batch(
        [
            items.take(nodes).combine_chunks().cast(pa.string()),
            items.take(others).combine_chunks().cast(pa.string()),
            pa.array(np.concatenate([n[counted], np.zeros(len(tree), dtype=np.int64)])),
        ],
        names=["item", "other", "n"],
    )


def _forest(one: list[int], other: list[int]) -> Iterator[tuple[int, int]]:
    """The links that join nodes not joined before."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.get(k, k) != k:
            parent[k] = parent.get(parent[k], parent[k])
            k = parent[k]
        return k

    for a, b in zip(one, other, strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            yield a, b
