"""Incremental import: each micro-batch is upserted into a versioned snapshot directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.reconcile import apply_upsert


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath() for s in system.listStatus(root)]
    return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and system.exists(fs.Path(p, "_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version, None before the first."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{versions[-1]}") if versions else None


def write_version(batch: DataFrame, path: str, key: list[str], digest: str, order: str, number: int | None = None) -> None:
    """Upserts ``batch`` (its latest row per key) as a new version; a version counts once its _SUCCESS is there, so a lost job leaves the old one.

    number: of the micro-batch; its version is that number plus one, so that a batch which comes again replaces its own version and builds on the one before.
    """
    spark = batch.sparkSession
    columns = [c for c in batch.columns if c not in key]
    latest = batch.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*key, "r.*").select(batch.columns)
    versions = [v for v in _versions(spark, path) if number is None or v <= number]
    if versions:
        latest = apply_upsert(latest, spark.read.parquet(f"{path}/v{versions[-1]}"), key, digest)
    latest.write.mode("overwrite").parquet(f"{path}/v{(versions[-1] if versions else 0) + 1 if number is None else number + 1}")


def start(stream: DataFrame, path: str, key: list[str], digest: str, order: str, checkpoint: str) -> StreamingQuery:
    """Runs the upsert for every micro-batch of ``stream``."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_version(batch, path, key, digest, order, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
