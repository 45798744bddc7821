"""Documents packed into sequences of several permitted lengths, best fit first.

A document longer than the largest length fills whole sequences with its first
parts; the rest is packed like the others. Pieces are taken from long to short.
A piece goes into the open bin with the least room that still holds it. If none
does, a bin is opened, and its size is chosen over all permitted lengths at once: for
each, the lengths still to come tell what would fill the bin, and the size with the least cost per unit of that
content wins, the larger among equals. A sequence has a fixed cost, so a large bin pays off while small pieces remain, and a
quadratic one, so the largest isn't always the best. Other bins may get what was expected; at the end each bin is
reduced to the smallest permitted length that holds its contents.

Packing runs in groups of about ``group_rows`` pieces, dealt by a hash of id and
place, so hot sources, ids and long runs of equal documents are spread evenly. Lengths are
worked out once and written, so what is dealt doesn't change if a task is run again.
Another split of the input into tasks may give another, equally valid packing.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.llm.common import field, written

CAPACITIES = (512, 1024, 2048, 4096)
GROUP_ROWS = 2_000


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: a fixed part, linear work per token and a quadratic share for attention."""
    return 512 + capacity + capacity * capacity / 8_192


class _Room:
    """Open bins by the room left in them: sorted rooms, and the bins of each."""

    def __init__(self):
        self.sizes: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_: int) -> None:
        if room > 0:
            if room not in self.bins:
                bisect.insort(self.sizes, room)
                self.bins[room] = []
            self.bins[room].append(bin_)

    def take(self, length: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``length``, with that room."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room]
            self.sizes.pop(at)
        return bin_, room


def _filling(lengths: Sequence[int], sums: Sequence[int], first: int, room: int) -> int:
    """How much of ``room`` the pieces from ``first`` on fill, the longest that fits each time; ``sums`` are their running totals."""
    total, at = 0, first
    while True:
        at = max(at, bisect.bisect_left(lengths, -room, key=lambda x: -x))
        if at >= len(lengths):
            return total
        end = bisect.bisect_right(sums, sums[at] + room) - 1
        total, room, at = total + sums[end] - sums[at], room - (sums[end] - sums[at]), end


def best_fit(
    lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost
) -> tuple[list[int], list[int], list[int], list[int]]:
    """Pack positive lengths given from long to short: (bin of each, offset in it, final capacity of each bin, the one it was opened with)."""
    capacities = sorted(capacities)
    sums = [0, *accumulate(lengths)]
    room, used, opened, where, offsets = _Room(), [], [], [], []

    def smallest(content: int) -> int:
        return capacities[bisect.bisect_left(capacities, content)]

    for k, length in enumerate(lengths):
        taken = room.take(length)
        if taken:
            bin_, left = taken
        else:

            def price(c: int) -> tuple[float, int]:
                content = length + _filling(lengths, sums, k + 1, c - length)  # noqa: B023
                return cost(smallest(content)) / content, -c

            left = min((c for c in capacities if c >= length), key=price)
            bin_ = len(used)
            used.append(0)
            opened.append(left)
        where.append(bin_)
        offsets.append(used[bin_])
        used[bin_] += length
        room.add(left - length, bin_)
    return where, offsets, [smallest(size) for size in used], opened


def pack(
    docs: DataFrame,
    length: Column,
    *,
    key: str = "doc_id",
    capacities: Sequence[int] = CAPACITIES,
    cost: Callable[[int], float] = sequence_cost,
    group_rows: int = GROUP_ROWS,
    seed: int = 42,
) -> DataFrame:
    """One row per piece: key, piece, start, length, pack_group, bin, capacity, bin_offset.

    ``start`` is where the piece begins in its document, ``bin_offset`` where it
    lies in its bin; (pack_group, bin) names a bin.

    Documents without length (missing or empty text) keep one row, a piece of length 0 that is
    in no bin: its bin, capacity and offset are missing. A missing key is allowed; repeated
    rows are packed separately. Other columns are not read. An empty table gives
    no rows.
    """
    largest = max(capacities)
    rows = written(
        docs.select(
            field(key).alias("key"),
            F.coalesce(length, F.lit(0)).cast("long").alias("total"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "lengths",
    )
    pieces = rows.select(
        "key",
        "row",
        "total",
        F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(total - 1) div {largest}"), F.lit(0)).cast("int"))).alias("piece"),
    ).select(
        "key",
        "row",
        "piece",
        (F.col("piece").cast("long") * largest).alias("start"),
        F.least(F.lit(largest), F.col("total") - F.col("piece").cast("long") * largest).cast("long").alias("length"),
    )
    count = rows.agg(F.sum(F.greatest(F.expr(f"(total - 1) div {largest}"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-count // group_rows))
    # The place in the table is hashed too: one id on very many rows is still spread evenly.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "key", "row", "piece"), F.lit(groups)))
    schema = T.StructType(
        [T.StructField("key", rows.schema["key"].dataType)]
    ).add("piece", "integer").add("start", "long").add("length", "long").add("pack_group", "long").add("bin", "long").add(
        "capacity", "integer"
    ).add("bin_offset", "long")

    def in_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "key", "piece"], ascending=[False, True, True], kind="stable", na_position="last")
        where, offsets, final, _ = best_fit([n for n in group["length"].tolist() if n], capacities, cost)
        # The pieces without length come last.
        whole = lambda values, kind: pd.Series([*values, *[None] * (len(group) - len(where))], index=group.index, dtype=kind)
        return group.assign(
            bin=whole(where, "Int64"), bin_offset=whole(offsets, "Int64"), capacity=whole([final[b] for b in where], "Int32")
        )[schema.fieldNames()]

    return dealt.drop("row").groupBy("pack_group").applyInPandas(in_group, schema).withColumnRenamed("key", key)


def word_count(text: Column) -> Column:
    """Length of a text in words and the separator after it; an empty or missing text has none."""
    words = F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+"))
    return F.when(words > 0, words + 1).otherwise(0)
