"""Shards that all match the mixture of sources, by proportional interleaving.

Every row gets its rank in a seeded shuffle of its source and from that the
fraction of the source that lies before it. Sorted by this fraction, sources are
interleaved in proportion to their sizes, so any cut of the order into equal
pieces gives shards with the mixture of the whole and row counts at most one
apart.

Neither the rank nor the order is found in one task: both are cut into slices
whose number is the square root of the count of rows. Slice counts give the
offset of each slice, and only inside a slice rows are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelmill.llm.common import field

_HASH_SPAN = float(1 << 32)


def _slices(rows):
    return F.ceil(F.sqrt(rows.cast("double"))).cast("long")


def interleave_shards(
    docs: DataFrame,
    shards: int = 8,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 42,
) -> DataFrame:
    """One row per input row: key, source, size, text_crc32, fraction, shard, slot.

    ``slot`` numbers the rows of a shard from 0 in the interleaved order.

    A missing source is a source of its own; a missing key is shuffled as empty
    text; a missing text has size 1 and no checksum. Rows equal in key and text
    are interchangeable, so ties do not change the result. Other columns of the
    input are not read, whatever their names. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = docs.select(
        field(key).alias("key"),
        field(source).cast("string").alias("source"),
        (F.coalesce(F.octet_length(field(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(field(text).cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(field(key).cast("string"), F.lit(""))).cast("binary")).alias("draw"),
    )
    per_source = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    same_source = F.col("source").eqNullSafe(F.col("of_source"))
    placed = (
        rows.join(per_source.withColumnRenamed("source", "of_source"), same_source)
        .drop("of_source")
        .withColumn(
            "slice",
            F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / _HASH_SPAN * _slices(F.col("rows"))),
        )
    )
    placed = _numbered(placed, ["source", "slice"], ["source"], "slice", ["draw", "key", "text_crc32", "size"], "rank")
    # A rank from 0 in a source of n rows: the middle of its share of the source.
    placed = placed.withColumn("fraction", (F.col("rank") + 0.5) / F.col("rows"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    placed = placed.crossJoin(F.broadcast(total)).withColumn(
        "slice", F.floor(F.col("fraction") * _slices(F.col("total")))
    )
    placed = _numbered(placed, ["slice"], [], "slice", ["fraction", "source", "draw", "key", "text_crc32", "size"], "place")
    return placed.withColumn("shard", F.expr(f"(place * {shards}) div total").cast("int")).select(
        F.col("key").alias(key), "source", "size", "text_crc32", "fraction", "shard",
        # The first place of shard s is the smallest p with p * shards >= s * total.
        F.expr(f"place - (shard * total + {shards} - 1) div {shards}").cast("long").alias("slot"),
    )


def _numbered(rows: DataFrame, cell: list[str], group: list[str], slice_: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of their slices and, within one, of ``order``."""
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("in_cell"))
    before = Window.partitionBy(*group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"of_{c}") for c in cell],
        F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("offset"),
    )
    match = None
    for c in cell:
        equal = F.col(c).eqNullSafe(F.col(f"of_{c}"))
        match = equal if match is None else match & equal
    inside = Window.partitionBy(*cell).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(offsets, match)
        .withColumn(name, F.col("offset") + F.col("nth") - 1)
        .drop("offset", "nth", *[f"of_{c}" for c in cell])
    )
