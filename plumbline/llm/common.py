"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a batch that crosses into Python; whole texts can be long, so batches stay small.
ARROW_ROWS = 1000
#: Most bytes that a side may have to be broadcast.  Larger sides are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers: at most ARROW_ROWS texts are held at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: later stages neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes what stored() wrote.  Runs at exit; call it earlier once all results have been consumed."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already
            return


atexit.register(release)


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted rows fit BROADCAST_BYTES, else df as it is (joined by a shuffle)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def crc_fold(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo a number of folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def crc_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; a folder in PLUMBLINE_TOKENIZERS goes before the installed ones."""
    folder = os.environ.get("PLUMBLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
