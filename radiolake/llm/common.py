"""What the operators of this subpackage share: shared folder, kept tables, batches, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one Arrow batch: long texts make wide rows, so the default of 10,000 is too many.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir.

    Where it is unset, a session of one machine gets a temporary folder; on a cluster that would be
    another folder on every executor, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="radiolake-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_hashes(hashes: DataFrame, n: int, name: str) -> DataFrame:
    """The n smallest of distinct hashes (column h, perhaps with others), kept; all, if fewer.

    Hashes are spread evenly, so a share of their range holds few more than n: only those are
    put in order, and no task takes n of every other one.
    """
    hashes = keep(hashes, name)
    total = hashes.count()
    share = 1.1 * (n + 1000) / max(total, 1)
    while True:
        low = hashes
        if share < 1:
            low = hashes.where(F.col("h") <= int(-(1 << 63) + share * (1 << 64)))
        if share >= 1 or low.count() >= n:
            rest = [F.col(c) for c in hashes.columns if c != "h"]
            return keep(low.orderBy("h", *rest).limit(n), name)
        share *= 2


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: T.StructType | str) -> DataFrame:
    """`fn` over Arrow batches of at most BATCH_ROWS rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(batch.slice(at, BATCH_ROWS))
                if out is not None:
                    yield out
    return bounded(df).mapInArrow(run, schema)


def bounded(df: DataFrame) -> DataFrame:
    """Arrow batches of few rows and bytes, whatever the session's default is."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def with_id(df: DataFrame, id_col: str, rest: str) -> T.StructType:
    """A result schema: the id in its own type, then the DDL columns of `rest`."""
    return T.StructType([T.StructField("id", df.schema[id_col].dataType),
                         *T.StructType.fromDDL(rest).fields])


def texts(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def crc_mod(col: str, n: int):
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
