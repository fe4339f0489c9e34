"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The folder is the one named by spark.checkpoint.dir; a private one is made only where that
    setting is absent, as in tests. Spark's cleaner removes the files with the last reference.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="orrery-ckpt-"))
    return df.checkpoint()


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held(id_col: str, modulus: int, rest: int) -> Column:
    """True if the crc32 remainder equals `rest`; rows without an id count as not held out."""
    return F.coalesce(remainder(id_col, modulus) == rest, F.lit(False))


_kept: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again; removed when the driver ends.

    For tables with millions of narrow rows this takes a fraction of a checkpoint's space.
    """
    path = _place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Shuffle `df` by `key` and keep it as a table of buckets, which is grouped by `key` without another shuffle."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _place(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def _place(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = f"{folder or tempfile.mkdtemp(prefix='orrery-')}/stored-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_remove)
    _kept.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _kept:
        if spark.sparkContext._jsc is None:
            continue
        spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1].replace('-', '_')}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
