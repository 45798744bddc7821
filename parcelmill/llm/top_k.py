"""Exact top-k search over sparse integer vectors: exhaustive term-at-a-time accumulation.

A row is a list of terms with integer weights, its score for a query the inner product. Candidates are
dealt into chunks and queries into blocks, both of bounded size. A task holds one chunk and one block: it
turns the chunk into posting lists (positions and weights of each term) and, query by query, scatters the
weighted lists of the query's terms into one dense array with a score for each row of the chunk. A partition
of that array gives the chunk's best rows; those of all chunks are merged by rank.

Every candidate is scored for every query, those without a common term with 0. Nothing is broadcast and
nothing is collected; the work is the number of chunks times the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.llm.common import field

#: Terms of a chunk of candidates and of a block of queries, on average; a task holds one of each.
CHUNK_TERMS = 4 << 20
BLOCK_TERMS = 1 << 20
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column, scale: int) -> tuple[Column, Column]:
    """(terms, weights) of a dense vector: places and ``floor(scale * x)`` where that isn't 0.

    Both are missing if the vector is missing or holds a missing or non-finite component.
    """
    usable = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    pairs = F.filter(F.transform(whole, lambda w, k: F.struct(k.cast("long").alias("term"), w.alias("weight"))), lambda p: p["weight"] != 0)
    return F.when(usable, pairs["term"]), F.when(usable, pairs["weight"])


class _Postings:
    """The term-major index of a chunk: rows in order of their ids, posting lists by term code."""

    def __init__(self, codes: np.ndarray, positions: np.ndarray, weights: np.ndarray, terms: int, rows: int, kind: type):
        by_term = np.argsort(codes, kind="stable")
        codes, positions, weights = codes[by_term], positions[by_term], weights[by_term]
        again = np.zeros(len(codes), dtype=bool)
        again[1:] = (codes[1:] == codes[:-1]) & (positions[1:] == positions[:-1])
        if again.any():  # a row's weights of one term are added up
            heads = np.flatnonzero(~again)
            codes, positions, weights = codes[heads], positions[heads], np.add.reduceat(weights.astype(object), heads)
        self.starts = np.searchsorted(codes, np.arange(terms + 1))
        self.positions, self.weights, self.rows = positions, weights.astype(kind), rows

    def scores(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        scores = np.zeros(self.rows, dtype=self.weights.dtype)
        for code, weight in zip(codes.tolist(), weights.tolist(), strict=True):
            first, end = self.starts[code], self.starts[code + 1]
            if end - first == self.rows:  # the list of a term that all rows have is in order
                scores += self.weights[first:end] * weight
            else:
                scores[self.positions[first:end]] += self.weights[first:end] * weight
        return np.clip(scores, LOWEST, HIGHEST).astype(np.int64) if scores.dtype == object else scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, of equal ones those that come first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column and the end of each list."""
    column = column.combine_chunks()
    return column.flatten(), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))


def _tile(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        kind_of_id = rows.schema.field("id").type
        out = pa.schema([("query_id", kind_of_id), ("mark", pa.int64()), ("id", kind_of_id), ("score", pa.int64())])
        if not rows.num_rows or not queries.num_rows:
            return out.empty_table()
        rows = rows.take(pc.sort_indices(rows["id"]))
        terms, ends = _lists(rows["terms"])
        asked, asked_ends = _lists(queries["terms"])
        codes = pa.concat_arrays([terms, asked]).dictionary_encode()
        count, codes = len(codes.dictionary), codes.indices.to_numpy()
        weights = _lists(rows["weights"])[0].to_numpy()
        asked_weights = _lists(queries["weights"])[0].to_numpy()
        sizes = np.diff(ends, prepend=0)
        # No score exceeds this, so the narrowest exact kind can be chosen.
        top = max(abs(int(weights.max(initial=0))), abs(int(weights.min(initial=0))))
        asked_top = max(abs(int(asked_weights.max(initial=0))), abs(int(asked_weights.min(initial=0))))
        limit = top * asked_top * int(sizes.max(initial=0)) * int(np.diff(asked_ends, prepend=0).max(initial=0))
        kind = np.int32 if limit < 1 << 31 else np.int64 if limit < 1 << 63 else object
        index = _Postings(codes[: len(terms)], np.repeat(np.arange(rows.num_rows), sizes), weights, count, rows.num_rows, kind)
        ids = rows["id"].combine_chunks()
        first_of = pc.index_in(queries["id"], ids).to_numpy(zero_copy_only=False)
        same = np.diff(np.flatnonzero(np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False), [True]])))
        copies = dict(zip(np.cumsum(same) - same, same, strict=True))  # rows with the same id, by the first one's place
        found, values, asking = [], [], []
        low = 0
        for q, end in enumerate(asked_ends.tolist()):
            scores = index.scores(codes[len(terms) + low : len(terms) + end], asked_weights[low:end])
            low = end
            places = None
            if not np.isnan(first_of[q]):
                own = int(first_of[q])
                places = np.delete(np.arange(index.rows), slice(own, own + int(copies[own])))
                scores = scores[places]
            top_places = best(scores, k)
            values.append(scores[top_places])
            found.append(top_places if places is None else places[top_places])
            asking.append(np.full(len(top_places), q))
        asking = pa.array(np.concatenate(asking))
        return pa.table(
            [
                queries["id"].take(asking), queries["mark"].take(asking), ids.take(pa.array(np.concatenate(found))),
                pa.array(np.concatenate(values).astype(np.int64)),
            ],
            schema=out,
        )

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, *, key: str = "id", terms: str = "terms", weights: str = "weights") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows with the highest scores for each query, ties to smaller ids.

    Both tables have an id, a list of terms (of any type) and a list of long weights of the same length; other
    columns are ignored. A term that a list repeats counts with the sum of its weights; a row without terms
    scores 0. Rows without an id, without lists, with lists of different lengths or with a missing
    element take no part. A row repeated with the same id, terms and weights counts once; an id with different
    lists names several rows. Rows with the query's own id are no candidates for it; a query with fewer than
    ``k`` candidates gets all. Scores beyond 64 bits are reported (and compared) as the nearest 64-bit number.
    No queries or no candidates give no rows.
    """
    kind = dict(rows.dtypes)[key]

    def usable(df: DataFrame) -> DataFrame:
        whole = lambda c: F.forall(c, lambda x: x.isNotNull())
        chosen = df.select(field(key).cast(kind).alias("id"), field(terms).alias("terms"), field(weights).cast("array<bigint>").alias("weights"))
        fits = (F.size("terms") == F.size("weights")) & whole(F.col("terms")) & whole(F.col("weights"))
        # Equal rows are dropped before they are dealt, so one row repeated very often is no hot chunk.
        return chosen.where(F.col("id").isNotNull() & fits).distinct().withColumn("mark", F.xxhash64("id", "terms", "weights"))

    candidates, asked = usable(rows), usable(queries)
    spark = rows.sparkSession

    def parts(df: DataFrame, limit: int) -> int:
        return -(-(df.agg(F.sum(F.size("terms") + F.lit(1)).alias("n")).first()["n"] or 0) // limit)

    chunks = max(parts(candidates, CHUNK_TERMS), spark.sparkContext.defaultParallelism)
    blocks = max(parts(asked, BLOCK_TERMS), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = candidates.withColumn("chunk", F.pmod("mark", F.lit(chunks)).cast("int")).drop("mark").withColumn("block", every(blocks))
    sent = asked.withColumn("block", F.pmod("mark", F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))
    schema = f"query_id {kind}, mark long, id {kind}, score long"
    partial = dealt.groupBy("chunk", "block").cogroup(sent.groupBy("chunk", "block")).applyInArrow(_tile(k), schema)
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")

