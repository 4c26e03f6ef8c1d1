"""Intermediate tables in the shared folder that the cluster names.

Multi-pass operators cut their lineage here: what is written survives the loss
of executors, and later passes read it instead of recomputing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only if it is unset."""
    named = spark.sparkContext.getConf().get(CONF)
    if named:
        return named.rstrip("/")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="frameloom-"))
    return _fallback[0]


#: With this, the shuffle files of a query go once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` as a zstd Parquet table in the shared folder and read it back.

    The table replaces the shuffle files that led to it, so these are removed. With
    ``by`` it is bucketed by that column, under a name in the catalog: joins and groups
    by it of tables with as many ``buckets`` need no exchange."""
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    writer = df.write.option("compression", "zstd")
    try:
        if by is None:
            writer.parquet(path)
        else:
            writer.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path) if by is None else spark.table(name)
    table.stored_at, table.stored_as = path, by and name
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for t in tables:
        if t.stored_as:
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.stored_as}")
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shard_count(df: DataFrame, least: int = 24) -> int:
    """Shards for a table: twice the partitions of its scan, so a shard's share
    of the input stays the same at every size."""
    return max(least, 2 * df.rdd.getNumPartitions())
