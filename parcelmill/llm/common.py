"""Tables written for reuse, and helpers that keep clashing column names apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.runtime import scratch_path

#: A side with at most so many narrow rows (two or three numbers each) may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, prunable, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, count: int) -> DataFrame:
    """``df``, a table of numbers whose row count is known, marked for broadcast if it is small."""
    return F.broadcast(df) if count <= BROADCAST_ROWS else df


def field(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A name beginning with ``name`` that begins no column of ``df``."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def widened(df: DataFrame, run, extra: T.StructType) -> DataFrame:
    """``df`` with more columns, computed in Arrow batches by ``run``: it yields the batch's columns and the new ones.

    Inside, columns are named by their place, so names may hold any characters.
    """
    fields = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate([*df.schema.fields, *extra.fields])]
    plain = df.toDF(*[f.name for f in fields[: len(df.columns)]])
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*df.columns, *extra.names)
