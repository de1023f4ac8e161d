"""Exact dedup through an extendible-hash index on shared files.

Only texts whose 64-bit hash occurs more than once can have copies; their hashes are the keys of the index. A directory over
hash prefixes doubles where a bucket holds more than BUCKET_BYTES of text, until every bucket fits. Readers look a row's
bucket up in the directory, fold equal texts into at most SALTS entries a text, so that a text with any share of the rows
is spread and folded before it is sent, and send the entries to the owners of their buckets. An owner has a range of buckets, which
is a range of keys: it chains entries of one hash, compares their bytes and writes each text's entry (bucket, hash, SHA-256,
row that stays, copies) to the shared folder. A look-up needs an entry in the bucket that the hash's own bits name.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.llm import extendible
from faktum.llm.store import released, repeated, saved, tasks, unused

#: Bytes of text that a bucket of the index may hold before it is split (a single longer text has a bucket of its own).
BUCKET_BYTES = 64 << 10
#: Entries that readers may send for one text.
SALTS = 32
#: A directory or index of at most so many entries (under 10 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_KEYS = 1 << 16
#: What a null text counts as. Texts are compared as they are: equality is after no change.
_EMPTY = ""


def _first_word(h: Column) -> Column:
    """The upper 60 bits of a hash, which the directory goes by."""
    return F.shiftrightunsigned(h, 4)


def directory(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The saved directory of the hashes that occur more than once: h, bucket (a prefix of the hash in binary)."""
    body = F.coalesce(F.col(text), F.lit(_EMPTY))
    hashes = docs.select(F.xxhash64(body).alias("h"), F.octet_length(body).cast("long").alias("size")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    keys = saved(hashes.filter("n > 1").select("h", _first_word(F.col("h")).alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("h3"), F.greatest("size", F.lit(1)).alias("weight")), "keys")
    return saved(extendible.assign(keys, bucket_bytes, keep=["h"]).select("h", "bucket"), "directory")


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The saved index of texts that occur more than once: bucket, h, sha, keep, n; one row for each such text."""
    body = F.coalesce(F.col(text), F.lit(_EMPTY))
    buckets = directory(docs, text, bucket_bytes)
    if buckets.count() <= BROADCAST_KEYS:
        buckets = F.broadcast(buckets)
    salt = F.pmod(F.xxhash64(F.col("_key")), F.lit(SALTS)).alias("salt")
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("h"), body.alias("body")).join(buckets, "h")
    entries = rows.groupBy("bucket", "h", "body", salt).agg(F.count(F.lit(1)).alias("n"), F.max("_key").alias("keep"))
    owned = entries.repartitionByRange(tasks(docs.sparkSession), "bucket")
    chains = owned.groupBy("bucket", "h").agg(F.collect_list(F.struct("body", "n", "keep")).alias("chain"))
    texts = chains.withColumn("body", F.explode(F.array_distinct(F.transform("chain", lambda x: x["body"]))))
    same = F.filter("chain", lambda x: x["body"] == F.col("body"))
    found = texts.withColumn("n", F.aggregate(same, F.lit(0).cast("long"), lambda n, x: n + x["n"])).withColumn("keep", F.array_max(F.transform(same, lambda x: x["keep"])))
    return saved(found.filter("n > 1").select("bucket", "h", F.sha2("body", 256).alias("sha"), "keep", "n"), "index")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. The row with the largest key stays; of repeated rows (equal
    key and text) one stays. A null key loses to any other. Very long texts are compared whole. An empty table gives no rows;
    other columns aren't read.
    """
    found = index(docs, key, text, bucket_bytes)
    body = F.coalesce(F.col(text), F.lit(_EMPTY))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("h"), F.sha2(body, 256).alias("sha")).groupBy("_key", "h", "sha").agg(F.count(F.lit(1)).alias("copies"))
    bits = F.lpad(F.conv(_first_word(rows["h"]).cast("string"), 10, 2), extendible.WORD_BITS, "0")
    joined = rows.join(found, (rows["h"] == found["h"]) & (rows["sha"] == found["sha"]) & bits.startswith(found["bucket"]), "left").select("_key", rows["sha"], "copies", "keep", "n")
    out = repeated(joined, "copies", "copy")
    keep = F.when(F.col("n").isNull(), F.col("_key")).otherwise(F.col("keep"))
    return out.select(F.col("_key").alias(key), keep.alias("keep_id"), F.coalesce(F.col("n"), F.lit(1).cast("long")).alias("group_size"), (F.col("_key").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay, whatever their names.

    A text's SHA-256 and the key name its row; of rows that are equal in both one stays, any of them. Null texts count as
    empty texts, so one row of all those stays. An empty table gives no rows.
    """
    sha, gone, again = unused(docs, "sha_"), unused(docs, "gone_"), unused(docs, "again_")
    saved_index = index(docs, key, text)
    found = saved_index.select(F.col("sha").alias(gone), "keep")
    if saved_index.count() <= BROADCAST_KEYS:  # the documents then needn't be dealt
        found = F.broadcast(found)
    hashed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text), F.lit(_EMPTY)), 256))
    joined = hashed.join(found, hashed[sha] == found[gone], "left")
    left = joined.filter(found[gone].isNull() | hashed[key].eqNullSafe(found["keep"])).select(*[hashed[c] for c in hashed.columns], found[gone])
    table = saved(left, "kept")
    copies = saved(table.filter(F.col(gone).isNotNull()).groupBy(gone).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(gone).alias(again)), "again")
    released(saved_index)
    if copies.isEmpty():
        return table.select(docs.columns)
    once = table.join(copies, F.col(gone) == F.col(again), "left_semi").dropDuplicates([gone])
    return table.join(copies, F.col(gone) == F.col(again), "left_anti").unionByName(once).select(docs.columns)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, their copies and which of them stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs.select("doc_id", "text"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
