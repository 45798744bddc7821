"""Session settings, lineage cuts and joins that stay safe on hot keys.

Three rules hold everywhere in the package:

* group statistics are pre-aggregated and joined back, never computed by a
  window over raw rows, so one key with a third of the table is not one task;
* a side is broadcast only after its rows and bytes were checked;
* lineage is cut with ``checkpoint()`` into the folder named by
  ``spark.checkpoint.dir``, so a lost executor never loses a step.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def session(app: str = "parcelmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tuned for; ``conf`` overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="parcelmill-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most so many rows and, written as text, at most so many bytes."""
    if rows <= 0 or not df.columns:
        return False
    text = F.to_json(F.struct(*[quoted(c).cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)]))
    n, length = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return n <= rows and (length or 0) <= size


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def key_pairs(on) -> list[tuple[str, str]]:
    return [(key, key) if isinstance(key, str) else tuple(key) for key in on]


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on,
    how: str = "left",
    *,
    base_table: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join rows to a per-key table; a missing key matches a missing key.

    ``small`` is computed once and measured in rows and bytes. If it fits it is
    broadcast and ``big`` is not shuffled at all. If not, both sides are shuffled
    on the key, and adaptive execution splits keys that hold too many rows of
    ``big``. ``base_table=True`` measures a stored table without copying it.
    """
    pairs = key_pairs(on)
    right = small.withColumnsRenamed({r: f"__key_{k}" for k, (_, r) in enumerate(pairs)})
    if not base_table:
        right = settle(right)
    match: Column = reduce(
        lambda a, b: a & b, [quoted(left).eqNullSafe(F.col(f"__key_{k}")) for k, (left, _) in enumerate(pairs)]
    )
    if fits(right, max_rows):
        right = F.broadcast(right)
    return big.join(right, match, how).drop(*[f"__key_{k}" for k in range(len(pairs))])


def big_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join of two tables that both grow: as ``lookup_join`` on a stored right side."""
    return lookup_join(left, right, on, how, base_table=True, max_rows=max_rows)
