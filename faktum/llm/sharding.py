"""Sharding by extendible hashing: only a shard over the byte limit is split, on one more bit of the key's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faktum.llm import extendible
from faktum.llm.store import repeated, saved, unused

#: Bytes of text that a shard may hold in production.
SHARD_BYTES = 1 << 20


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, shard (the bucket's hash prefix in binary), depth, shard_bytes, oversize.

    Rows of one key go on by a hash of key and text, and repeated rows by their number among equal rows, so that a key with
    any share of the rows is spread over as many shards as it fills. Null or empty text: 0 bytes. A null key is a key. A row
    that is over the limit by itself gets a shard of its own with oversize true. Empty input gives no rows. Columns of docs
    other than key and text aren't read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    slim = docs.select(F.col(key).alias("_key"), F.octet_length(body).cast("long").alias("weight"), extendible.hash60(name).alias("h1"), extendible.hash60(F.concat_ws("\x01", name, body)).alias("h2"))
    copies = slim.groupBy("_key", "weight", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    rows = repeated(copies, "n", "copy").withColumn("h3", extendible.hash60(F.concat_ws("\x01", F.col("h2").cast("string"), F.col("copy").cast("string"))))
    named = rows.withColumn("_bytes", F.col("weight")).withColumn("_h2", F.col("h2")).withColumn("_copy", F.col("copy"))
    named = saved(named, "slim")  # texts are read and hashed once
    out = extendible.assign(named, limit, keep=["_key", "_bytes", "_h2", "_copy"])
    return out.select(F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), F.col("bucket").alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("bucket_weight").alias("shard_bytes"), (F.col("bucket_weight") > limit).alias("oversize"), "_h2", "_copy")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> None:
    """docs as Parquet, one folder shard=s... (s and the hash prefix) for each shard; all columns stay, whatever their names.

    Rows that are equal in key and text are spread as shard() says, in order of a hash of their other columns, so that a task
    that runs again gives the same. Nulls, empty and long texts are as in shard(). An empty table writes no shard.
    """
    h, copy, order = unused(docs, "h_"), unused(docs, "copy_"), unused(docs, "order_")
    plan = shard(docs, limit, key, text).select(F.col(key).alias("k"), F.col("_h2").alias("h"), F.col("_copy").alias("c"), F.concat(F.lit("s"), "shard").alias("s"))
    body, name = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    keyed = docs.withColumn(h, extendible.hash60(F.concat_ws("\x01", name, body))).withColumn(order, F.to_json(F.struct(*docs.columns)))
    keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(key, h).orderBy(order)).cast("long"))
    joined = keyed.join(plan, keyed[key].eqNullSafe(plan["k"]) & (keyed[h] == plan["h"]) & (keyed[copy] == plan["c"]))
    joined.select(*[keyed[c] for c in docs.columns], F.col("s").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """The shards of all documents under the production limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs.select("doc_id", "text")).drop("_h2", "_copy")


#: A document's leaf is its shallowest prefix of MD5 bits that fits; keys of documents are unique, so 60 bits do.
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h
  FROM documents),
x AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS depth)),
w AS (SELECT depth, prefix, sum(n_bytes) AS bytes, count(*) AS n FROM x GROUP BY depth, prefix),
leaf AS (
  SELECT x.doc_id, x.n_bytes, min(x.depth) AS depth, arg_min(x.prefix, x.depth) AS prefix, arg_min(w.bytes, x.depth) AS bytes
  FROM x JOIN w ON x.depth = w.depth AND x.prefix = w.prefix
  WHERE w.bytes <= {SHARD_BYTES} OR w.n = 1 GROUP BY x.doc_id, x.n_bytes)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, CAST(depth AS INT) AS depth,
       CAST(bytes AS BIGINT) AS shard_bytes, bytes > {SHARD_BYTES} AS oversize FROM leaf
"""
