"""What the operators of this subpackage share: tables, staged intermediate results and caches of a worker."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may go without that setting, as in tests; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="prosa-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage ends there and lost executors cost no recomputation.

    The files go when the driver's Python ends, or with drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, which nothing reads again."""
    remove(df.sparkSession, df._staged_at)


def stage_parts(spark: SparkSession, parts, schema: str, name: str) -> DataFrame:
    """Writes one DataFrame after the other into one staged table and reads the whole; no part gives an empty one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    spark.createDataFrame([], schema).write.option("compression", "zstd").parquet(path)
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Bytes in memory up to which a staged table is broadcast.
MOST_BROADCAST = 32_000_000


def _bytes_of(kind: str, column):
    """The size of a value in memory, about."""
    if kind == "string" or kind == "binary":
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    return F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("x")))), F.lit(0)) + 16


def broadcast_if_small(staged: DataFrame) -> DataFrame:
    """The staged table, marked for a broadcast if its measured size allows it."""
    size = staged.agg(F.sum(sum(_bytes_of(kind, F.col(c)) for c, kind in staged.dtypes))).first()[0] or 0
    return F.broadcast(staged) if size <= MOST_BROADCAST else staged


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are staged and no longer referenced."""
    import gc
    import time

    for _ in range(2):  # the first run frees what Python holds, the second what that held; deletion itself runs beside
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def crc32_of_id(column="doc_id"):
    """crc32 of an id as text, as a column; the folds of labels and of training texts use its remainder. Null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def unit_hash(*columns: str):
    """A column in [0, 1) that depends on the given columns only: the same rows are drawn in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks. Callers bound its size."""
    import sys

    return sys.__dict__.setdefault("_prosa_cache", {}).setdefault(name, {})
