"""Near-duplicate texts by an exact Jaccard join on word shingles with adaptive prefixes.

A document is the set of its distinct 5-word shingles, held as 64-bit hashes.
Equal sets form one class. Two sets with similarity of at least ``percent``
share at least T(n) = ceil(percent * n / 100) shingles of either. In any fixed
order of all shingles, a prefix of n - T(n) + m shingles of each set then has at
least min(m of one, m of the other) shingles in common: longer prefixes, more
matches. How long pays off is decided set by set, by what its candidates cost:

1. Shingles are in the order of their hashes. The frequency of every shingle in the longest prefixes, m = n // 8,
   is counted. Sets whose prefix holds too few shared shingles have no partner and are done.
2. Each set weighs m = 1, 2, 4, … up to n // 8: a longer prefix posts more shingles, and each posting is read by its list; but a partner must
   match more often, so fewer pairs are loaded and verified. A pair's postings in
   the prefix divided by the matches it needs bounds its candidates. The m with the least cost is taken. Frequent
   shingles (in ``HOT`` sets or more) are not posted; an m counts only if a rare shingle is among the matches
   with any partner. Pairs are verified if they match often enough: the lesser m, less the lesser number of
   frequent shingles.
3. Sets without such an m are costly: mostly shared passages and large groups of near
   copies. For pairs among them the whole sets are counted and the prefix is
   taken from the rarest shingles on. Lists of a large group are not expanded
   into pairs: each list is compared to one hub first, which joins its group
   with a link for each member; only pairs that are still in different groups
   follow, less those that can't share enough: at most what both share with the
   hub and shared shingles outside of it, and at most what stands behind their
   first common shingle.

Every link between different sets ends in one component, although not every pair
inside a component is written. Sets are told apart by 64 bits of a digest: for
d documents the chance of a false merge is about d^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.llm import texts
from parcelmill.llm.common import field, narrow, written
from parcelmill.llm.components import components

WIDTH = 5
PERCENT = 75
#: A shingle in so many sets or more is frequent.
HOT = 32
#: What loading and verifying a pair costs, in postings read.
VERIFY = 16
#: How often shingles of costly sets are counted again among the sets that are left.
PRUNINGS = 3


def least_overlap(n, percent: int):
    """The fewest shingles that a partner shares with a set of n."""
    return -(-percent * n // 100)


def matches(n):
    """By how many shingles the first prefix of a set of n is longer than needed for one match."""
    return n // 8 if n >= 8 else 1


def _matches(n: str) -> str:
    return f"greatest(({n}) div 8, 1)"


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text of a batch that has words."""
    for first, end, raw, offsets in texts.text_slices(batch.column(column)):
        raw = texts.LOWER[raw]
        starts, ends, word_of = texts.word_bounds(raw, offsets, texts.NO_SPACE)
        words = texts.span_hashes(raw, starts, ends)
        for row in range(first, end):
            own = words[word_of[row - first] : word_of[row - first + 1]]
            if len(own):
                shingles = np.sort(texts.shingle_hashes(own, min(width, len(own))))
                yield row, shingles[np.concatenate([[True], shingles[1:] != shingles[:-1]])]


def _name(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class _Rows:
    """Collects rows of (number, array) and hands them out as record batches of bounded size."""

    def __init__(self, names: list[str], limit: int = 1 << 18):
        self.names, self.limit = names, limit
        self.clear()

    def clear(self) -> None:
        self.numbers: list[tuple[int, ...]] = []
        self.arrays: list[np.ndarray] = []
        self.size = 0

    def add(self, numbers: tuple[int, ...], array: np.ndarray) -> bool:
        self.numbers.append(numbers)
        self.arrays.append(array)
        self.size += len(array)
        return self.size >= self.limit

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([row[k] for row in self.numbers], pa.int64()) for k in range(len(self.names) - 1)]
        lengths = np.array([len(a) for a in self.arrays], dtype=np.int64)
        flat = np.concatenate(self.arrays).view(np.int64) if self.arrays else np.zeros(0, dtype=np.int64)
        out = pa.record_batch([*columns, texts.list_array(lengths, flat, pa.int64())], names=self.names)
        self.clear()
        return out


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT
) -> DataFrame:
    """One row per document: key, n_shingles, component_id.

    ``component_id`` is the smallest key reachable by links, the document's own
    included. Texts that are missing or without words have no shingles and link
    with nothing; texts of fewer than ``width`` words have one shingle, the
    whole. Rows may repeat. A row without a key counts in its component but is
    never its smallest key; a component of such rows has none. Other columns are
    not read. An empty table gives no rows.
    """
    rows = docs.select(field(key).alias("key"), field(text).alias("text"))
    classes = written(_classes(rows, width), "classes")
    sizes = classes.where("set is not null").groupBy("set").agg(F.max("n").alias("n"))
    profile = written(_profile(rows, sizes, width, percent, hot), "profile")
    candidates = written(_rare_pairs(profile, percent), "candidates")
    sets = _token_sets(rows, profile, candidates, width)
    links = _verified_candidates(candidates, sets, percent)
    links = _costly_links(sets, links, percent)
    groups = components(links)
    smallest = classes.where("set is not null").groupBy("set").agg(F.min("key").alias("least_key"))
    named = smallest.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn(
        "component", F.coalesce("component", "set")
    )
    least = named.groupBy("component").agg(F.min("least_key").alias("component_id"))
    per_set = named.join(least, "component").select(F.col("set").alias("of_set"), "component_id")
    return classes.join(per_set, F.col("set") == F.col("of_set"), "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )


def first_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, without those linked to one with a smaller key.

    Rows without a key can't be named by the join and stay; rows of one key stay or go together.
    """
    found = near_duplicates(docs, key=key, text=text, **options)
    gone = written(
        found.select(field(key).alias("gone"), "component_id").where("gone != component_id").select("gone").distinct(), "gone"
    )
    return docs.join(narrow(gone, gone.count()), field(key) == F.col("gone"), "left_anti")


def _classes(rows: DataFrame, width: int) -> DataFrame:
    """(key, n, set): the number of shingles and the name of the set, missing where it is empty."""
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType)]).add("n", "long").add("set", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name = [0] * batch.num_rows, [None] * batch.num_rows
            for row, shingles in shingle_sets(batch, "text", width):
                n[row], name[row] = len(shingles), _name(shingles)
            yield pa.record_batch([batch.column("key"), pa.array(n, pa.int64()), pa.array(name, pa.int64())], names=["key", "n", "set"])

    return rows.mapInArrow(run, schema)


def _profile(rows: DataFrame, sizes: DataFrame, width: int, percent: int, hot: int) -> DataFrame:
    """Sets that may have a partner: (set, n, m, frequent, costly, rare).

    ``m`` says how often partners must match. ``rare`` are the shared shingles of the prefix below ``hot`` sets, and
    ``frequent`` counts the others.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are sent once
        out = _Rows(["set", "tokens"])
        for batch in batches:
            for _, shingles in shingle_sets(batch, "text", width):
                name = _name(shingles)
                if name not in seen:
                    seen.add(name)
                    n = len(shingles)
                    if out.add((name,), shingles[: n - least_overlap(n, percent) + matches(n)]):
                        yield out.batch()
        yield out.batch()

    entries = rows.select("text").mapInArrow(prefixes, "set long, tokens array<long>").select(
        "set", F.posexplode("tokens").alias("at", "token")
    )
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    shared = (
        entries.join(counts, "token")
        .groupBy("set")
        .agg(F.array_sort(F.collect_list(F.struct("at", "token", "sets"))).alias("shared"))
        .join(sizes, "set")
    )
    # What any partner must match: its own prefix may be shorter, as it may be smaller.
    must = _matches(f"({percent} * n + 99) div 100")
    kept = shared.where(f"size(shared) >= {must}").withColumn("must", F.expr(must))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_set = [_choice(np.array(at), np.array(sets), n, must, percent, hot) for at, sets, n, must in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True)]
            m, frequent, costly, places = (list(x) for x in zip(*of_set, strict=True)) if of_set else ([], [], [], [])
            tokens = [np.array(t, dtype=np.int64)[p] for t, p in zip(batch.column(2).to_pylist(), places, strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(4), pa.array(m, pa.int64()), pa.array(frequent, pa.int64()), pa.array(costly, pa.bool_()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["set", "n", "m", "frequent", "costly", "rare"],
            )

    parts = kept.select("set", *[F.col(f"shared.{x}").alias(x) for x in ("at", "token", "sets")], "n", F.col("must").cast("long").alias("must"))
    return parts.mapInArrow(chosen, "set long, n long, m long, frequent long, costly boolean, rare array<long>")


def _choice(at: np.ndarray, sets: np.ndarray, n: int, must: int, percent: int, hot: int) -> tuple[int, int, bool, np.ndarray]:
    """(m, frequent shingles, costly, places of the posted shingles) of a set, from the places and frequencies of its shared prefix shingles.

    Of m = 1, 2, 4, … and n // 8 the one with the least cost among those with fewer frequent shingles than any partner
    must match. Without one the set is costly and posts its rare shingles of the longest prefix.
    """
    most = matches(n)
    needless = n - least_overlap(n, percent)
    rare = sets < hot
    best = None
    for m in sorted({1 << k for k in range(most.bit_length()) if 1 << k <= most} | {most}):
        inside = at < needless + m
        frequent = int(np.count_nonzero(inside & ~rare))
        left = min(m, must) - frequent
        if left > 0:
            posted = inside & rare
            read = int((sets[posted] - 1).sum())
            price = read + VERIFY * read / left
            if best is None or price < best[0]:
                best = (price, m, frequent, False, np.flatnonzero(posted))
    if best:
        return best[1:]
    return most, int(np.count_nonzero(~rare)), True, np.flatnonzero(rare)


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _rare_pairs(profile: DataFrame, percent: int) -> DataFrame:
    """(a, b, matched): pairs with enough rare prefix shingles in common, not both costly."""
    posted = profile.select("set", "n", "m", "frequent", "costly", F.explode("rare").alias("token"))
    sides = [posted.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("set", "n", "m", "frequent", "costly")]) for side in "ab"]
    wanted = "least(a_m, b_m) - least(a_frequent, b_frequent)"
    return (
        sides[0]
        .join(sides[1], "token")
        .where((F.col("a_set") < F.col("b_set")) & _similar_sizes("a_n", "b_n", percent) & ~(F.col("a_costly") & F.col("b_costly")))
        .select(F.col("a_set").alias("a"), F.col("b_set").alias("b"), F.expr(wanted).alias("wanted"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("matched"), F.first("wanted").alias("wanted"))
        .where("matched >= wanted")
        .select("a", "b", "matched")
    )


def _token_sets(rows: DataFrame, profile: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(set, n, costly, tokens) of all sets that are costly or in a candidate pair."""
    costly = profile.where("costly").select("set")
    needed = written(
        candidates.select(F.explode(F.array("a", "b")).alias("set")).unionByName(costly).distinct().join(
            costly.withColumn("costly", F.lit(True)), "set", "left"
        ).select("set", F.coalesce("costly", F.lit(False)).alias("costly")),
        "needed",
    )
    needed = narrow(needed, needed.count())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            name: list[int | None] = [None] * batch.num_rows
            for row, shingles in shingle_sets(batch, "text", width):
                of_row = _name(shingles)
                if of_row not in seen:
                    seen.add(of_row)
                    name[row] = of_row
            yield pa.record_batch([pa.array(name, pa.int64()), batch.column("text")], names=["set", "text"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(["set", "n", "costly", "tokens"])
        for batch in batches:
            sets, costly = batch.column("set").to_pylist(), batch.column("costly").to_pylist()
            for row, shingles in shingle_sets(batch, "text", width):
                if out.add((sets[row], len(shingles), int(costly[row])), shingles):
                    yield out.batch()
        yield out.batch()

    chosen = (
        rows.select("text").mapInArrow(named, "set long, text string").where("set is not null").join(needed, "set")
        .groupBy("set", "costly").agg(F.first("text").alias("text"))
    )
    return written(chosen.mapInArrow(tokens, "set long, n long, costly long, tokens array<long>"), "token-sets")


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap, a_n, b_n) of pairs of sets."""
    tokens = sets.select("set", "tokens")
    loaded = pairs.select("a", "b").join(tokens.select(F.col("set").alias("a"), F.col("tokens").alias("a_tokens")), "a").join(
        tokens.select(F.col("set").alias("b"), F.col("tokens").alias("b_tokens")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for side in ("a_tokens", "b_tokens"):
                column = batch.column(side)
                offsets = column.offsets.to_numpy()
                columns.append((offsets, column.values.to_numpy().view(np.uint64)))
            (a_at, a_values), (b_at, b_values) = columns
            overlap = np.zeros(batch.num_rows, dtype=np.int64)
            for k in range(batch.num_rows):
                a, b = a_values[a_at[k] : a_at[k + 1]], b_values[b_at[k] : b_at[k + 1]]
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                place = np.searchsorted(large, small)
                place[place == len(large)] = 0
                overlap[k] = np.count_nonzero(large[place] == small)
            yield pa.record_batch(
                [batch.column("a"), batch.column("b"), pa.array(overlap), pa.array(np.diff(a_at).astype(np.int64)), pa.array(np.diff(b_at).astype(np.int64))],
                names=["a", "b", "overlap", "a_n", "b_n"],
            )

    return loaded.mapInArrow(run, "a long, b long, overlap long, a_n long, b_n long")


def _linked(percent: int) -> str:
    return f"100 * overlap >= {percent} * (a_n + b_n - overlap)"


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose sets are not in one component yet."""
    label = {s: groups.select(F.col("node").alias(s), F.col("component").alias(f"{s}_label")) for s in ("a", "b")}
    return pairs.join(label["a"], "a", "left").join(label["b"], "b", "left").where(
        "coalesce(a_label, a) != coalesce(b_label, b)"
    )


def _verified_candidates(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the candidates: the best partner of each set first, then what is still in different groups."""
    both = candidates.select(
        F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "matched"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "matched"))).alias("p")
    ).select("p.*")
    best = both.groupBy("node").agg(F.max_by("other", F.struct("matched", "other")).alias("other")).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    ).distinct()
    first = written(_tested(best, sets), "tested")
    links = first.where(_linked(percent)).select("a", "b")
    rest = _apart(candidates.join(first.select("a", "b"), ["a", "b"], "left_anti"), components(links))
    more = written(_tested(rest, sets).where(_linked(percent)).select("a", "b"), "tested")
    return links.unionByName(more)


def _costly_links(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and what joins pairs of costly sets that share frequent shingles only."""
    costly = sets.where("costly = 1")
    least = f"({percent} * n + 99) div 100"
    entries = costly.select("set", "n", F.explode("tokens").alias("token"))
    for _ in range(PRUNINGS):
        # A shingle counts only where another set that is still in question has it too.
        counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
        shared = written(
            entries.select("set", "n", "token").join(counts, "token")
            .groupBy("set", "n")
            .agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("shared"))
            .where(f"size(shared) >= {least}"),
            "shared",
        )
        entries = shared.select("set", "n", F.explode("shared.token").alias("token"))
    # The shingles that no other costly set has come first in the order, so the prefix ends after so many shared ones.
    posted = shared.select(
        "set", "n", F.size("shared").alias("most"),
        F.posexplode(F.expr(f"slice(shared.token, 1, cast(size(shared) - {least} + 1 as int))")).alias("at", "token"),
    )
    posted = written(posted, "posted")
    hubs = posted.groupBy("token").agg(F.max_by("set", F.struct(F.col("most") / F.col("n"), "n", "set")).alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    posted = written(posted.join(hubs.select("token", "hub"), "token"), "posted")
    to_hub = posted.where("set != hub").select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct()
    tested = written(_tested(to_hub, sets), "tested")
    links = links.unionByName(tested.where(_linked(percent)).select("a", "b"))
    groups = components(links)
    known = tested.select(
        F.explode(F.array(F.struct(F.col("a").alias("set"), F.col("b").alias("hub"), "overlap"), F.struct(F.col("b").alias("set"), F.col("a").alias("hub"), "overlap"))).alias("k")
    ).select("k.*")
    members = (
        posted.join(known, ["set", "hub"], "left")
        .withColumn("inner", F.coalesce("overlap", "n"))  # the hub's own shingles are all its own
        .join(groups.withColumnRenamed("node", "set"), "set", "left")
        .withColumn("label", F.coalesce("component", "set"))
        .select(
            "token", "set", "n", (F.col("most") - F.col("at")).alias("left"), "inner",
            (F.col("most") - F.least("inner", "most")).alias("outer"), "label",
        )
    )
    members = written(members, "members")
    # In each list the largest group needs no pairs inside it; members of the others are compared to all.
    per_label = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("sets"))
    main = per_label.groupBy("token").agg(F.max_by("label", F.struct("sets", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", "main")
    listed = members.join(main, "token")
    one, other = (listed.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("set", "n", "left", "inner", "outer", "label", "main")]) for s in "xy")
    pairs = (
        one.where("x_label != x_main").join(other, "token")
        .where(
            (F.col("x_label") != F.col("y_label"))
            & ((F.col("y_label") == F.col("y_main")) | (F.col("x_set") < F.col("y_set")))
            & _similar_sizes("x_n", "y_n", percent)
            # All they can share is what both share with the hub, and shared shingles outside of it.
            & F.expr(
                f"(least(x_inner, y_inner) + least(x_outer, y_outer)) * {100 + percent} >= {percent} * (x_n + y_n)"
            )
            # The first shingle they have in common stands early enough in both for the rest to suffice.
            & F.expr(f"least(x_left, y_left) * {100 + percent} >= {percent} * (x_n + y_n)")
        )
        .select(F.least("x_set", "y_set").alias("a"), F.greatest("x_set", "y_set").alias("b"))
    )
    pairs = pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest = written(_tested(pairs, sets).where(_linked(percent)).select("a", "b"), "tested")
    return links.unionByName(rest)
