"""Typed table scans and sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.runtime import lookup_join, quoted

#: Rows of a file of a partitioned sink.
FILE_ROWS = 1_000_000

ASSESSMENTS = """
    par_id string, usedesc string, school_desc string, muni_desc string, sale_desc string,
    sale_price double, sale_date string, year_blt bigint, style_desc string, bedrooms bigint,
    fullbaths bigint, halfbaths bigint, finished_living_area double, lot_area double,
    grade_desc string, condition_desc string, extfinish_desc string, roof_desc string,
    basement_desc string, cdu_desc string, heatingcooling_desc string, fireplaces bigint,
    bsmtgarage bigint
"""
PARCEL_POINTS = "pin string, longitude double, latitude double"
VERTICES = "geo_id string, part_id int, seq int, x double, y double"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; ``NA`` and empty fields are missing."""
    return spark.read.csv(
        path, header=True, schema=schema, nullValue="NA", mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def spread_by(df: DataFrame, column: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows dealt so that each value of ``column`` is written by one task for every ``file_rows`` rows.

    Values are counted first, so a small folder gets one file and a hot one as many as it needs.
    Equal rows stay together.
    """
    counts = df.groupBy(column).agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).alias("__slices"))
    slot = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.col("__slices"))
    dealt = lookup_join(df, counts, [column]).withColumn("__slot", slot)
    return dealt.repartition(quoted(column), F.col("__slot")).drop("__slices", "__slot")


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """CSV sink with a header; a partitioned one writes as few files a value as its rows need."""
    writer = (spread_by(df, partition_by) if partition_by else df).write.mode("overwrite").options(
        header=True, nullValue="NA", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet sink; a partitioned one writes as few files a value as its rows need."""
    writer = (spread_by(df, partition_by) if partition_by else df).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_polygons(spark: SparkSession, path: str, schema: str = VERTICES) -> DataFrame:
    """A polygon layer as vertex rows, from parquet."""
    return spark.read.schema(schema).parquet(path)


def write_polygons(vertices: DataFrame, path: str) -> None:
    write_table(vertices.select("geo_id", "part_id", "seq", "x", "y"), path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """One row per column: position, name, type and the first few values as text, in the order of the rows."""
    head = df.limit(rows).select(
        F.monotonically_increasing_id().alias("__row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    )
    placed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("__row", "value"))))
    firsts = head.unpivot(["__row"], df.columns, "column", "value").groupBy("column").agg(
        F.array_join(F.transform(placed, lambda p: p["value"]), ", ").alias("first_values")
    )
    described = df.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position long, column string, type string",
    )
    return described.join(F.broadcast(firsts), "column", "left").select(
        "position", "column", "type", "first_values"
    )


def publish(df: DataFrame, view: str) -> DataFrame:
    """Make a table known to later steps by name."""
    df.createOrReplaceTempView(view)
    return df


def pull(df: DataFrame, column: str) -> DataFrame:
    return df.select(column)
