"""Reading tables, appending columns by Arrow batches, and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutsites.llm.arrays import Texts, chunks
from cutsites.session import scratch_path

TEXT = "__text"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fraction_key(*parts: str) -> F.Column:
    """A uniform number in [0, 1) from text expressions, the same in any SQL engine: 13 hex digits of md5."""
    return F.expr(f"cast(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) as double) / 4503599627370496D")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of executors, once for a Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_cutsites_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = Path(os.path.realpath(tempfile.mkdtemp(prefix="cutsites-"))) / "cutsites.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
        context._cutsites_shipped = True


def per_text(
    df: DataFrame,
    make: Callable[[Texts], dict[str, object]],
    fields: Sequence[T.StructField],
    keep: Iterable[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Append columns computed from whole texts.

    ``make`` gets the texts of a chunk and returns one array per field. Columns of ``df`` named
    in ``keep`` (all by default) pass through; a computed column replaces one of the same name.
    """
    ship(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(TEXT))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    types = {f.name: t.type for f, t in zip(fields, to_arrow_schema(T.StructType(list(fields))), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, TEXT):
                made = make(texts)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                columns += [v if isinstance(v := made[n], pa.Array) else pa.array(v, type=t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *types])

    return source.mapInArrow(run, schema)
