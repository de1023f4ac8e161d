"""Event-time windows, for a table or a stream alike, and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summed(df: DataFrame, window: Column, *keys: str, ts: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), *keys, "n", "total")


def late(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, size: str = "1 hour", ts: str = "ts", delay: str | None = "10 minutes") -> DataFrame:
    return _summed(late(df, ts, delay), F.window(ts, size), "event_type", ts=ts)


def sliding(df: DataFrame, size: str = "2 hours", step: str = "1 hour", ts: str = "ts", delay: str | None = "10 minutes") -> DataFrame:
    return _summed(late(df, ts, delay), F.window(ts, size, step), ts=ts)


def sessions(df: DataFrame, gap: str = "30 minutes", ts: str = "ts", delay: str | None = "10 minutes") -> DataFrame:
    return _summed(late(df, ts, delay), F.session_window(ts, gap), "user_id", ts=ts)


def changes(before: DataFrame, after: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """(key, change) between two snapshots of a manifest: added, removed or changed; equal rows are left out."""
    same = F.lit(True)
    for m in marks:
        same = same & F.col(f"b.{m}").eqNullSafe(F.col(f"a.{m}"))
    x = before.alias("b").join(after.alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    change = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"a.{key}").isNull(), "removed").when(~same, "changed")
    return x.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), change.alias("change")).filter("change IS NOT NULL")


def carried(entity: DataFrame, measured: DataFrame, previous: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Entities with this run's metrics, and the previous run's where this one has none."""
    new = measured.select(*keys, *[F.col(m).alias(f"_new_{m}") for m in metrics])
    old = previous.select(*keys, *[F.col(m).alias(f"_old_{m}") for m in metrics])
    x = entity.drop(*metrics).join(new, keys, "left").join(old, keys, "left")
    return x.select(*[c for c in x.columns if not c.startswith(("_new_", "_old_"))], *[F.coalesce(f"_new_{m}", f"_old_{m}").alias(m) for m in metrics])


def ingest(stream: DataFrame, path: str, checkpoint: str, partition: str = "file_path"):
    """Each batch of records replaces its own files' partitions of the table at path (only those it brings)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
