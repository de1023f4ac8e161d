"""The test tables seen as a code graph: entities, relations and the other frames, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ENTITY = """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 10 < 6 THEN 0 WHEN p_partkey % 10 < 8 THEN 1 WHEN p_partkey % 10 = 8 THEN 2 ELSE 4 END AS kind,
  CASE WHEN p_partkey % 97 = 0 THEN 'main' WHEN p_partkey % 89 = 0 THEN 'Run' ELSE replace(p_name,' ','_') END AS name,
  concat(p_type,'.',replace(p_name,' ','_'),'_',CAST(p_partkey AS STRING)) AS qualified_name,
  concat('/src/',lower(p_type),'/',lower(replace(p_brand,'#','')),'/f',CAST(p_partkey % 7 AS STRING),'.',
    CASE p_partkey % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'py' WHEN 2 THEN 'rs' WHEN 3 THEN 'cpp' WHEN 4 THEN 'c' WHEN 5 THEN 'java' ELSE 'ts' END) AS file_path,
  concat('/src/',lower(p_type),'/',lower(replace(p_brand,'#','')),'/') AS module_path,
  CASE p_partkey % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' WHEN 3 THEN 'cpp' WHEN 4 THEN 'c' WHEN 5 THEN 'java' ELSE 'typescript' END AS language,
  p_size * 10 AS start_row, p_size * 10 + 9 AS end_row, CAST(p_partkey % 3 AS INT) AS visibility,
  1 + p_size % 10 AS cyclomatic, p_size % 4 AS nesting_depth, 1 + p_size % 10 + p_size % 4 AS cognitive, CAST(p_partkey % 4 AS INT) AS arity
FROM part
UNION ALL SELECT 10000000 + s_suppkey, 7, s_name, concat('ext.',s_name), concat('/vendor/n',CAST(s_nationkey AS STRING),'/lib.go'),
  concat('/vendor/n',CAST(s_nationkey AS STRING),'/'), 'go', 0, 0, 1, 0, 0, 0, 0 FROM supplier"""

RELATION = """
SELECT source_id, target_id, type, max(confidence) AS confidence FROM (
 SELECT s AS source_id, t AS target_id, 1 AS type, d AS confidence FROM (
  SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount) AS t, l_quantity AS q, l_discount AS d FROM lineitem) x
 WHERE t IS NOT NULL AND q >= 45
 UNION ALL SELECT l_partkey, 10000000 + l_suppkey, 4, l_discount FROM lineitem WHERE l_quantity >= 50) y
GROUP BY source_id, target_id, type"""

#: Facts as events: which of the fact kinds an event type stands for.
FACT = """
SELECT event_id AS id, event_id % (SELECT count(*) FROM part) AS function_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'sync' WHEN 'view' THEN 'sync' ELSE 'memory' END AS category,
  CASE event_type WHEN 'error' THEN 'bare_except' WHEN 'click' THEN 'mutex' WHEN 'view' THEN 'mutex' ELSE 'cstring' END AS primitive,
  CASE event_type WHEN 'error' THEN 'suppression' WHEN 'click' THEN 'lock' WHEN 'view' THEN 'defer_unlock' WHEN 'purchase' THEN 'alloc' ELSE 'free' END AS kind,
  concat('s', CAST(user_id AS STRING)) AS symbol, 0.9 AS confidence FROM events"""

CALL_RECORD = f"""
SELECT o_orderkey AS rid, e.file_path, CAST(o_custkey % 520 AS INT) AS at_row FROM orders JOIN ({ENTITY}) e ON e.id = o_orderkey % (SELECT count(*) FROM part)"""

REFERENCE = """
SELECT r.source_id * 100000000 + r.target_id AS ref_id, r.source_id AS caller_id, t.name, t.arity,
  CAST(r.source_id % 4 AS INT) AS call_kind, CASE WHEN r.source_id % 5 = 0 THEN t.qualified_name ELSE '' END AS qualified_target,
  CASE WHEN r.source_id % 6 = 0 THEN split_part(t.qualified_name, '.', 1) ELSE '' END AS receiver_type
FROM relation r JOIN entity t ON r.target_id = t.id WHERE r.type = 1"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part", "supplier")
    return spark.sql(ENTITY)


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    return spark.sql(RELATION)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return entity(spark, sf_dir), relation(spark, sf_dir)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events", "part")
    return spark.sql(FACT)


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders", "part", "supplier")
    return spark.sql(CALL_RECORD).withColumnRenamed("at_row", "row")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = graph(spark, sf_dir)
    e.createOrReplaceTempView("entity")
    r.createOrReplaceTempView("relation")
    return spark.sql(REFERENCE)


#: What DuckDB reads before a query: the frames as common table expressions.
WITH = f"WITH RECURSIVE entity AS ({ENTITY}), relation AS ({RELATION}), calls AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relation WHERE type = 1 AND source_id <> target_id)"
