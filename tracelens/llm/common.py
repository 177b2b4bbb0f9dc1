"""Helpers shared by the operators: the shared folder, id ranges, slices of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator holds in numpy arrays at a time (one document at least).
SLICE_BYTES = 4 << 20
#: Rows of a file of a table known to be small, and the least number of such files.
ROWS_PER_FILE, LEAST_FILES = 250_000, 3
#: Bytes of a source table for which a table made from it gets a file.
SOURCE_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one on a local master
    (tests), and an error on any other: executors could not see it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if not path and now.isDefined():
        path = now.get()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracelens-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def compact(df: DataFrame, source: DataFrame) -> DataFrame:
    """df in one partition for SOURCE_BYTES of the table that it comes from, or as many as it has, if they are fewer: small inputs
    that are dealt over many partitions don't become as many small files."""
    files = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SOURCE_BYTES
    return df.coalesce(max(LEAST_FILES, files)) if files < 1 << 20 else df  # an unknown size counts as a very large one


def cut(df: DataFrame, most: int | None = None, **totals: Column) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read from there: later plans start from files, and a lost
    executor costs no computation before that point again. most: rows that df has at most, if known; a small table then gets
    few files (one for ROWS_PER_FILE rows, one task each) however many partitions its plan has. totals: aggregates to be taken on
    the way (see `total`)."""
    path = new_folder(df.sparkSession, "cut")
    seen = Observation()
    out = df if most is None else df.coalesce(max(LEAST_FILES, -(-most // ROWS_PER_FILE)))
    out.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in totals.items()]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracelens_path, out._tracelens_totals = path, seen.get
    return out


def total(table: DataFrame, name: str = "rows"):
    """An aggregate that `cut` took while it wrote the table; its rows are always counted."""
    return table._tracelens_totals[name]


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `cut` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_tracelens_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def with_range(df: DataFrame, key: str, rows_per_range: int = 256, most: int = 65536, name: str = "range_id") -> DataFrame:
    """Adds the number of the id range that a row falls in: ranges ascend with key and hold about rows_per_range rows.

    Bounds are approximate quantiles of the key over all rows; there are at most `most` of them, which is the most that
    is ever held on the driver. Each row gets a range, whatever the ids look like; rows with equal ids share one.
    """
    ids = df.select(F.col(key).cast("double").alias("k"))
    rows = ids.count()
    parts = max(1, min(most, -(-rows // rows_per_range)))
    cuts: list[float] = []
    if parts > 1:
        at = [i / parts for i in range(1, parts)]
        cuts = sorted(set(ids.select(F.percentile_approx("k", at, max(10000, 4 * parts))).first()[0] or []))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    spare = f"__{name}_key"
    out = Bucketizer(splits=splits, inputCol=spare, outputCol=name, handleInvalid="keep").transform(df.withColumn(spare, F.col(key).cast("double")))
    return out.withColumn(name, F.col(name).cast("int")).drop(spare)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `limit` bytes together, and one row at least."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
    trim()


def trim() -> None:
    """Gives freed memory back to the system: idle Python workers share an executor's memory with the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
