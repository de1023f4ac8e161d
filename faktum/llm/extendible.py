"""Extendible hashing over a DataFrame of weighted keys, in DataFrame functions only.

Every row carries a hash of 180 bits as three longs of 60 bits. A bucket is a hash prefix. The directory starts with one
bucket of depth 0; a bucket whose weight is over the limit is split on the next bit, and only such a bucket, until each
fits or holds one row. The doubling of the directory is done a few levels at once: weights are summed by fine prefix cells,
rolled up to every depth, and a bucket of depth d is a leaf when it fits and its parent doesn't. Cells that are still too
heavy at the finest level are gone into in another round, which reads their rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.llm.store import saved

#: Bits in each of the three hash words.
WORD_BITS = 60
#: A directory of at most so many cells is broadcast (24 bytes a cell); a larger one is joined by shuffle.
BROADCAST_CELLS = 1 << 16


def hash60(text: Column) -> Column:
    """The first 60 bits of MD5, as DuckDB and Spark both can write them."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _bits(value: Column, depth: Column) -> Column:
    """The binary digits of value, as many as depth."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(value.cast("string"), 10, 2), depth.cast("int"), "0"))


def leaves(cells: DataFrame, cell_bits: int, limit: int) -> DataFrame:
    """cells (group, cell, weight, n) -> (group, cell, depth, weight, n, fits): each cell's bucket.

    A bucket fits when its weight is at most limit or it holds one row. group is a bucket that an earlier round left too heavy.
    """
    levels = (
        cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(cell_bits))))
        .withColumn("prefix", F.expr(f"shiftright(cell, {cell_bits} - depth)"))
        .groupBy("group", "depth", "prefix")
        .agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
        .withColumn("fits", (F.col("weight") <= limit) | (F.col("n") <= 1))
    )
    ends = levels.filter(F.col("fits") | (F.col("depth") == cell_bits))
    of_cell = cells.select("group", "cell", F.explode(F.sequence(F.lit(0), F.lit(cell_bits))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {cell_bits} - depth)"))
    return (
        of_cell.join(ends, ["group", "depth", "prefix"])
        .groupBy("group", "cell")
        .agg(F.min_by(F.struct("depth", "prefix", "weight", "n", "fits"), "depth").alias("leaf"))
        .select("group", "cell", "leaf.*")
    )


def assign(rows: DataFrame, limit: int, keep: list[str]) -> DataFrame:
    """rows with h1, h2, h3 (60-bit longs), weight -> keep columns, bucket (binary prefix), depth, bucket_weight, fits.

    Rows whose 180 bits are all equal stay in one bucket, which then has fits = false.
    """
    spark = rows.sparkSession
    rest = rows.select(*keep, "h1", "h2", "h3", "weight", F.lit("").alias("group"))
    done: list[DataFrame] = []
    used = 0
    heaviest = rest.agg(F.sum("weight")).first()[0] or 0
    while True:
        room = WORD_BITS - used % WORD_BITS
        cell_bits = min(room, 20, max(1, math.ceil(math.log2(max(2, heaviest / max(1, limit)))) + 3))
        word = f"h{used // WORD_BITS + 1}"
        rest = rest.withColumn("cell", F.expr(f"shiftright({word}, {room - cell_bits}) & {(1 << cell_bits) - 1}L"))
        cells = rest.groupBy("group", "cell").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        directory = saved(leaves(cells, cell_bits, limit).withColumnsRenamed({"weight": "bucket_weight", "n": "bucket_n"}), "directory")
        size, heaviest = directory.agg(F.count(F.lit(1)), F.max(F.when(~F.col("fits"), F.col("bucket_weight")))).first()
        routed = rest.join(F.broadcast(directory) if size <= BROADCAST_CELLS else directory, ["group", "cell"])
        routed = routed.withColumn("bucket", F.concat("group", _bits(F.col("prefix"), F.col("depth"))))
        used += cell_bits
        if heaviest is None or used >= 3 * WORD_BITS:
            done.append(routed)
            break
        done.append(routed.filter("fits"))
        rest = saved(routed.filter("not fits").select(*keep, "h1", "h2", "h3", "weight", F.col("bucket").alias("group")), "overfull")
    out = done[0].select(*keep, "bucket", F.length("bucket").alias("depth"), "bucket_weight", "fits")
    for x in done[1:]:
        out = out.unionByName(x.select(*keep, "bucket", F.length("bucket").alias("depth"), "bucket_weight", "fits"))
    return out
