"""Session settings, the shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows below which a sheet-like table may be broadcast (a few MB at most).
BROADCAST_ROWS = 50_000

# Compressed shuffle data that one task should read. Counts and their keys compress well: 8 MB are 400,000 counts,
# Spark's default of 64 MB are 2 GB in the aggregates and sorts of one task.
ADVISORY_BYTES = "8m"
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the library relies on; cluster sizing is left alone, and so is a size of partitions that the session has set."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Partition values such as chr=1 stay strings.
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        # A join on (keys, tile, bin) may reuse a layout hashed on (keys, tile).
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    if spark.conf.get(_ADVISORY, None) is None:  # a size that the user has set stays
        spark.conf.set(_ADVISORY, ADVISORY_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="cutsites-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of executors, once for a Spark context (for the few operators with Python in tasks)."""
    context = spark.sparkContext
    if not getattr(context, "_cutsites_sent", False):
        root = Path(__file__).resolve().parent
        target = Path(os.path.realpath(tempfile.mkdtemp(prefix="cutsites-"))) / "cutsites-code.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        context._cutsites_sent = True


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A literal table (sheet, rules, oligos) as a local relation.

    Built through Arrow, so Spark knows its size and plans its joins by that size.
    """
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows.

    Counts through ``limit``, so a large table costs one bounded job; beyond the
    bound the hint is left out and Spark joins by shuffle. Meant for tables that
    are cheap to read (sheets, contig lists, rule lists).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
