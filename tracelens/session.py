"""Session set-up: a tuned builder, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "tracelens", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local use; on a cluster, spark-submit's own settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, wherever the driver found it (once per application), and
    bounds the bytes of the batches that they are handed, which rows of long texts would make large."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if getattr(sc, "_tracelens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tracelens-"), "tracelens_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    sc._tracelens_shipped = True


def small(df, rows: int = 10_000):
    """df marked for broadcast if it has that many rows at most, which is counted; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if is_small(df, rows) else df


#: Rows of a table of questions' terms, candidates or winners up to which it is broadcast to the corpus' tables (see small).
MANY = 100_000


def is_small(df, rows: int = 10_000) -> bool:
    return df.limit(rows + 1).count() <= rows


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one on a local master, and
    an error on any other."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (now.get() if now.isDefined() else None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracelens-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Of the tables kept in the shared folder: a third smaller than Spark's default.
CODEC = "zstd"


def cut(df):
    """The rows of df, written now as Parquet in the folder that driver and executors share and read from there: later plans start
    from files, of which they read the columns that they need, and a lost executor repeats nothing before this point."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a plan's input for which a bucket is made, and of a bucket of an input with fewer of those than the cluster has cores.
BUCKET_BYTES, LEAST_BYTES = 16 << 20, 4 << 20


def buckets(df) -> int:
    """How many buckets a table made from df gets: one for BUCKET_BYTES of what Spark estimates df at, but work for all cores."""
    size, cores = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), df.sparkSession.sparkContext.defaultParallelism
    if size >= 1 << 50:  # not known
        return cores
    return max(1, size // BUCKET_BYTES, min(cores, size // LEAST_BYTES))


def bucketed(df, key: str, n: int, dealt: bool = False):
    """What `cut` gives, as a table in n buckets of a key: later aggregations by the key, with or without other columns, need no
    shuffle. dealt: df comes row by row from a table in the same buckets, so that it isn't dealt again.

    Such tables are read a bucket in a task from now on, whatever is done with the rows. Left alone, Spark reads them by size where it
    sees no use in buckets, and a task that writes several buckets first sorts its rows by bucket: more than fit its memory."""
    df.sparkSession.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    name = f"tracelens_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).option("compression", CODEC).option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)
