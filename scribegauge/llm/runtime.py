"""Session-level helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed, ensure_checkpoint_dir


def saved(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Unlike a checkpoint it is compressed and read by column.  The files are
    deleted by ``free``, or when the driver's Python ends.  Shuffle files that
    led to the table are needed no more; Spark drops them when the driver
    collects its garbage, which ``release`` asks for after a large shuffle, as a
    long job would else keep them all.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    if release:
        gc.collect()
        spark._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def free(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more, before the driver's Python ends."""
    for table in tables:
        if path := getattr(table, "_saved_at", None):
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Measured size up to which one side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if its measured rows fit ``limit`` bytes; else leave the join to shuffle.

    The size is that of the rows as JSON, which is above what a broadcast holds
    for the narrow tables this is meant for; ``df`` should be materialised.
    """
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 16).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= limit else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str,
    arrow_schema: pa.Schema,
    setup: Callable[[], Callable[[list], list[tuple]]],
    slice_rows: int = 512,
) -> DataFrame:
    """Run a row-batch function over Arrow batches with bounded memory.

    ``setup`` is called once per task and returns a function that takes one
    Python list per input column (at most ``slice_rows`` long each) and
    returns output tuples in the order of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = setup()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                part = batch.slice(start, slice_rows)
                rows = process([part.column(i).to_pylist() for i in range(part.num_columns)])
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(cols, arrow_schema)],
                        schema=arrow_schema,
                    )

    return df.select(*columns).mapInArrow(run, schema)


def fold_of(doc_id) -> object:
    """crc32 of the id as text, mod 4, as a Column (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(4)


def fold_of_value(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
