"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: With it, Spark deletes a statement's shuffle files as soon as the statement is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; a cluster is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="faktum-shared-")
        spark.sparkContext.setCheckpointDir(_own[key])
    return _own[key]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans it
        pass


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut, and a lost executor costs nothing.

    The shuffle files of the statement that wrote it go at once; the table goes with released() or at the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/faktum/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    _paths[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for table in tables:
        if (path := _paths.pop(table, None)) is not None:
            _delete(table.sparkSession, path)


def tasks(spark: SparkSession) -> int:
    """The number of partitions that the session deals shuffled rows to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def owners_for(docs: DataFrame, text: str, share: int) -> int:
    """So many owners that each gets about share bytes of the texts at most, and at least one for each shuffle partition."""
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(tasks(docs.sparkSession), -(-int(size) // share))


def unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it a column that docs doesn't have (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Copies of a row that one task makes.
COPIES = 4096


def repeated(rows: DataFrame, count: str, number: str) -> DataFrame:
    """Each row as often as count says, with its number from 1 on. A row with very many copies is dealt out before they are made."""
    few = rows.filter(F.col(count) <= COPIES).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))))
    many = rows.filter(F.col(count) > COPIES).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / COPIES))))
    dealt = many.repartition(tasks(rows.sparkSession), *[F.col(c) for c in rows.columns], F.col("_run"))
    many = dealt.withColumn(number, F.explode(F.sequence(F.col("_run") * COPIES + 1, F.least(F.col(count), (F.col("_run") + 1) * COPIES)))).drop("_run")
    return few.unionByName(many)
