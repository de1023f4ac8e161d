"""Ranked text search over names, substring search, and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.functions.text import dot, identifier_words, idf, trigrams, unit
from faktum.schema import CALLABLE, TYPES

# The ranking's parameters, the vectors' length, and the least similarity of a hit.
K1, B, DIMENSIONS, FLOOR = 1.2, 0.75, 192, 0.3


def words_of(entity: DataFrame) -> DataFrame:
    """(id, name, kind, words): the words of names, qualified names and paths."""
    words = F.concat(identifier_words(F.col("name")), identifier_words(F.col("qualified_name")), identifier_words(F.col("file_path")))
    return entity.filter("name <> ''").select("id", "name", "kind", words.alias("words"))


def bm25(entity: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The entities with any of the query's words; types first, then by score.

    An entity is scored from its own row; only the query's words, their frequencies and the mean length are carried over.
    """
    spark = entity.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.array_distinct(identifier_words(F.col("q"))).alias("asked"))
    counts = F.transform("asked", lambda a: F.size(F.filter("words", lambda w: w == a)))
    # the words of one query: the split stays in one place, or each count would split anew
    hits = words_of(entity).crossJoin(F.broadcast(asked)).select("id", "name", "kind", F.size("words").alias("length"), F.explode(F.array(F.struct(counts.alias("tf")))).alias("c")).select("id", "name", "kind", "length", "c.tf")
    sizes = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    found = hits.filter(F.exists("tf", lambda f: f > 0))
    df = found.select(F.posexplode("tf").alias("at", "f")).groupBy("at").agg(F.count_if(F.col("f") > 0).alias("df"))
    dfs = df.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("dfs"))
    x = found.crossJoin(F.broadcast(dfs.crossJoin(sizes)))
    weight = lambda d: F.log((F.col("n") - d + 0.5) / (d + 0.5) + 1)
    part = lambda tf, d: weight(d) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    score = F.aggregate(F.zip_with("tf", "dfs", lambda tf, d: F.when(tf > 0, part(tf, d)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    out = x.select("id", F.round(score, 6).alias("score"), "name", "kind")
    return out.orderBy(F.when(F.col("kind").isin(*TYPES), 0).otherwise(1), F.desc("score"), "id").limit(limit)


def by_substring(entity: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Names that hold the query, case aside; short names first. From three characters on, all its trigrams must be in the name."""
    q = query.replace("%", " ").replace("_", " ") if len(query) < 3 else query
    out = entity.filter(F.lower("name").contains(q.lower()))
    if len(query) >= 3:
        grams = sorted({query.lower()[i : i + 3] for i in range(len(query) - 2)})
        out = out.filter(F.forall(F.array(*map(F.lit, grams)), lambda g: F.contains(F.lower("name"), g)))
    return out.select("id", "name", F.length("name").alias("size")).orderBy("size", "name", "id").limit(limit)


def trigram_index(entity: DataFrame) -> DataFrame:
    return entity.select("id", F.explode(trigrams(F.col("name"))).alias("gram"))


def tiered(entity: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Ranked hits, then substring hits that aren't among them."""
    first = bm25(entity, query, limit).select("id", F.lit(1).alias("tier"), "score")
    second = by_substring(entity, query, limit).select("id", F.lit(2).alias("tier"), F.lit(0.0).alias("score"))
    both = first.unionByName(second).groupBy("id").agg(F.min("tier").alias("tier"), F.max("score").alias("score"))
    return both.join(entity.select("id", "name"), "id").orderBy("tier", F.desc("score"), F.length("name"), "id").limit(limit)


def term_weights(entity: DataFrame) -> DataFrame:
    """(term, df, idf) over functions and methods."""
    x = entity.filter(F.col("kind").isin(*CALLABLE))
    n = x.agg(F.count(F.lit(1)).alias("n"))
    words = x.select("id", F.explode(F.array_distinct(identifier_words(F.col("name")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return words.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def vectors(entity: DataFrame) -> DataFrame:
    """(id, vector): signed feature hashes of the names' trigrams (two places each) and words by their weight, of length 1."""
    x = entity.filter(F.col("kind").isin(*CALLABLE))
    place = lambda h: F.pmod(h, F.lit(DIMENSIONS)).cast("int")
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    grams = x.select("id", F.explode(trigrams(F.col("name"))).alias("f")).select("id", F.explode(F.array(F.xxhash64("f"), F.xxhash64("f", F.lit(1)))).alias("h"), F.lit(1.0).alias("w"))
    words = x.select("id", F.explode(F.array_distinct(identifier_words(F.col("name")))).alias("term")).join(term_weights(entity), "term").select("id", F.xxhash64("term", F.lit(2)).alias("h"), F.col("idf").alias("w"))
    parts = grams.unionByName(words).groupBy("id", place(F.col("h")).alias("at")).agg(F.sum(sign(F.col("h")) * F.col("w")).alias("v"))
    dense = parts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return dense.select("id", unit(values).alias("vector"))


def nearest(vecs: DataFrame, query: DataFrame, k: int = 10, floor: float = FLOOR) -> DataFrame:
    """(id, score): the k vectors most similar to the one query vector (column q), over the floor."""
    x = vecs.crossJoin(F.broadcast(query.limit(1))).select("id", F.round(dot(F.col("vector"), F.col("q")), 6).alias("score"))
    return x.filter(F.col("score") > floor).orderBy(F.desc("score"), "id").limit(k)
