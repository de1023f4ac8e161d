"""Aggregations: statistics, hotspots, modules, workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faktum.operators.lookup import is_language_entry, with_ends
from faktum.schema import CALLABLE, CALLS

# Thresholds of module roles; names that start a workflow.
API_RATIO, API_INCOMING, API_USED = 2, 3, 0.1
CORE_INCOMING, CORE_USED, UTILITY_OUTGOING, UTILITY_USED, BUSINESS_INCOMING, LEAST_MODULE = 10, 0.05, 5, 0.05, 10, 3
WORKFLOW_NAMES = ("main", "Run", "Init", "Serve", "Start")
STEP_NAMES = ("main", "Run", "Serve", "Start", "Handle", "Process")


def graph_stats(entity: DataFrame, relation: DataFrame) -> DataFrame:
    e = entity.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("file_path").alias("files"))
    return e.crossJoin(relation.agg(F.count(F.lit(1)).alias("relations"), F.count_if(F.col("type") == CALLS).alias("calls")))


def hotspots(entity: DataFrame, relation: DataFrame, top: int = 10) -> DataFrame:
    hits = relation.filter(F.col("type") == CALLS).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return hits.join(entity, "id").select("id", "name", "callers", "cyclomatic", "cognitive").orderBy(F.desc("callers"), "id").limit(top)


def module_map(entity: DataFrame) -> DataFrame:
    return entity.filter(F.col("kind").isin(*CALLABLE)).groupBy("module_path").agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("file_path").alias("files"), F.sum("cyclomatic").alias("cyclomatic"), F.max("cognitive").alias("most_cognitive"))


def module_summary(entity: DataFrame, relation: DataFrame) -> DataFrame:
    """Per module of at least three entities; incoming and outgoing are aggregated by themselves, never over one joined table."""
    base = entity.groupBy(F.col("module_path").alias("module")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("visibility") == 1).alias("pub"), F.bool_or(is_language_entry()).alias("entry")).filter(F.col("total") >= LEAST_MODULE)
    m = entity.select("id", F.col("module_path").alias("module"))
    hit = relation.join(m, m["id"] == relation["target_id"])
    incoming = hit.groupBy("module").agg(F.countDistinct(F.when(F.col("source_id") != F.col("target_id"), F.col("source_id"))).alias("incoming"), F.countDistinct("target_id").alias("alive"))
    out = relation.join(m, m["id"] == relation["source_id"])
    outgoing = out.groupBy("module").agg(F.countDistinct(F.when(F.col("source_id") != F.col("target_id"), F.col("target_id"))).alias("outgoing"))
    inner = internal_edges(entity, relation)
    x = base.join(incoming, "module", "left").join(outgoing, "module", "left").join(inner, "module", "left").na.fill(0, ["incoming", "alive", "outgoing", "internal"])
    return x.withColumn("dead", F.col("total") - F.col("alive")).withColumn("utilization", 1 - F.col("dead") / F.col("total")).drop("alive")


def module_roles(summary: DataFrame) -> DataFrame:
    c = F.col
    name = F.lower("module")
    role = (
        F.when(name.isin("test", "tests") | name.contains("/test/") | name.contains("/tests/"), "test")
        .when((c("pub") > 0) & (c("incoming") >= API_RATIO * c("outgoing")) & (c("incoming") >= API_INCOMING) & (c("utilization") >= API_USED), "api")
        .when(c("entry"), "entry")
        .when((c("incoming") >= CORE_INCOMING) & (c("outgoing") <= c("incoming")) & (c("utilization") >= CORE_USED) & (c("pub") > 0), "core")
        .when((c("outgoing") <= UTILITY_OUTGOING) & (c("pub") > 0) & (c("utilization") >= UTILITY_USED), "utility")
        .when((c("pub") > 0) & (c("incoming") >= BUSINESS_INCOMING), "business")
        .when(((c("incoming") == 0) & (c("outgoing") == 0)) | (c("dead") == c("total")), "dead")
        .otherwise("infra")
    )
    return summary.select("module", role.alias("role"))


def internal_edges(entity: DataFrame, relation: DataFrame) -> DataFrame:
    x = with_ends(entity, relation, ("module_path",)).filter("source_id <> target_id AND source_module_path = target_module_path")
    return x.groupBy(F.col("source_module_path").alias("module")).agg(F.count(F.lit(1)).alias("internal"))


def module_edges(entity: DataFrame, relation: DataFrame) -> DataFrame:
    x = with_ends(entity, relation.filter(F.col("type") == CALLS), ("file_path", "module_path")).filter("source_file_path <> target_file_path")
    return x.groupBy(F.col("source_module_path").alias("src_module"), F.col("target_module_path").alias("tgt_module")).agg(F.count(F.lit(1)).alias("calls"))


def architecture_state(entity: DataFrame, relation: DataFrame, top: int = 10) -> DataFrame:
    x = module_edges(entity, relation).filter("src_module <> tgt_module")
    return x.orderBy(F.desc("calls"), "src_module", "tgt_module").limit(top).select("src_module", "tgt_module", "calls", F.lit(0).alias("violations"), F.lit(1.0).alias("compliance"))


def workflow_state(entity: DataFrame, relation: DataFrame, top: int = 20) -> DataFrame:
    """What starting functions call: how many of its callees others call too."""
    named = F.col("name").isin(*WORKFLOW_NAMES)
    starts = entity.filter(named).select(F.col("id").alias("source_id"))
    called = relation.join(starts, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    flow = entity.filter(~named).join(called, "id", "left_semi").select("id", "name")
    calls = relation.filter(F.col("type") == CALLS)
    popular = calls.groupBy("target_id").agg(F.countDistinct("source_id").alias("by"))
    steps = calls.withColumnRenamed("source_id", "id").join(flow, "id", "left_semi").join(popular, "target_id")
    counts = steps.groupBy("id").agg(F.count(F.lit(1)).alias("steps_total"), F.countDistinct(F.when(F.col("by") > 1, F.col("target_id"))).alias("steps_done"))
    out = flow.join(counts, "id", "left").na.fill(0, ["steps_total", "steps_done"])
    state = F.when(F.col("steps_total") == 0, "Empty").when(F.col("steps_done") >= F.col("steps_total"), "Done").otherwise("Partial")
    return out.withColumn("state", state).orderBy("id").limit(top)


def workflow_steps(entity: DataFrame, relation: DataFrame, most: int = 20) -> DataFrame:
    """Step 0 is the entry, then its callees in order of id."""
    calls = relation.filter(F.col("type") == CALLS)
    entries = entity.filter(F.col("kind").isin(*CALLABLE) & F.col("name").isin(*STEP_NAMES)).join(calls, entity["id"] == calls["source_id"], "left_semi").select(F.col("id").alias("workflow"), "name")
    steps = calls.join(entries, calls["source_id"] == entries["workflow"]).withColumn("step", F.row_number().over(Window.partitionBy("workflow").orderBy("target_id"))).filter(F.col("step") <= most)
    return entries.select("workflow", F.lit(0).alias("step"), F.col("workflow").alias("entity_id")).unionByName(steps.select("workflow", "step", F.col("target_id").alias("entity_id")))


def language_histogram(entity: DataFrame) -> DataFrame:
    return entity.groupBy("language").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("file_path").alias("files"))


def multi_language(entity: DataFrame, by: str = "module_path", limit: int = 20) -> DataFrame:
    x = entity.groupBy(by).agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.countDistinct("language").alias("n")).filter("n > 1")
    return x.orderBy(by).limit(limit)


def modules_hierarchy(entity: DataFrame) -> DataFrame:
    """Each module's size, commonest language (ties: the first by name) and parent folder."""
    per = entity.groupBy("module_path", "language").agg(F.count(F.lit(1)).alias("n"))
    x = per.groupBy("module_path").agg(F.sum("n").alias("entities"), F.min_by("language", F.struct(-F.col("n"), "language")).alias("language"))
    return x.withColumn("parent", F.regexp_extract("module_path", r"^(.*/)[^/]+/$", 1))


def readiness(entity: DataFrame, relation: DataFrame) -> DataFrame:
    eligible = entity.filter(F.col("kind").isin(*CALLABLE))
    calls = relation.filter(F.col("type") == CALLS)
    ends = calls.select(F.col("source_id").alias("id")).union(calls.select("target_id")).distinct()
    a = eligible.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("cyclomatic") > 0).alias("measured"))
    b = eligible.join(ends, "id", "left_semi").agg(F.count(F.lit(1)).alias("connected"))
    return a.crossJoin(b).withColumn("ratio", F.round(F.col("connected") / F.greatest(F.col("eligible"), F.lit(1)), 4))


def type_info(types: DataFrame, refs: DataFrame, part: str | None = None, limit: int = 100) -> DataFrame:
    x = types.filter(F.lower("name").contains(part.lower())) if part else types
    counts = refs.groupBy("name").agg(F.count(F.lit(1)).alias("ref_count"))
    return x.join(counts, "name", "left").na.fill(0, ["ref_count"]).orderBy(F.desc("ref_count"), "id").limit(limit)


def unique_relations(relation: DataFrame) -> DataFrame:
    """One row for each (source, target, type): the one with the least id."""
    w = Window.partitionBy("source_id", "target_id", "type").orderBy("id")
    return relation.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page(df: DataFrame, key: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*key).offset(offset).limit(limit)


def overview(entity: DataFrame, relation: DataFrame) -> DataFrame:
    """One row of what a project is: languages, modules, entry points, readiness."""
    from faktum.operators.lookup import entry_points

    a = entity.agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.countDistinct("module_path").alias("modules"))
    return a.crossJoin(entry_points(entity).agg(F.count(F.lit(1)).alias("entry_points"))).crossJoin(readiness(entity, relation))


def failures(events: DataFrame) -> DataFrame:
    """Parse failures by file: how often, first and last time, last error. Columns: file_path, at, error."""
    return events.groupBy("file_path").agg(F.count(F.lit(1)).alias("fail_count"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("error", F.struct("at", "error")).alias("last_error"))
