"""Files and stage tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss"}


def shared_dir(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``; a temporary folder only in local mode, where the setting may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="barloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of fewer rows while a table is written: batches of whole texts are what workers hold most of."""
    before = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt by ``key`` once: joins on ``key`` then move only their other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    rows = df.repartition(n, key).write.format("parquet").option("path", path)
    rows.bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, sep, rest = uri.partition("://")
    if not sep:  # file:/path or /path
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def put_file(uri: str, *blocks: bytes) -> int:
    """Write one file under a temporary name, then move it: a retried or speculative task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(draft) as out:
        for block in blocks:
            out.write(block)
            size += len(block)
    fs.move(draft, path)
    return size


def get_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as src:
        return src.read()
