"""Semantic facts from records, and declarative rules over facts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.schema import RECORD_KIND


@dataclass(frozen=True)
class Rule:
    """needs and without are category/primitive/kind; combine is collect, missing, missing_per_function or count."""

    group: str
    name: str
    needs: tuple[str, ...]
    combine: str = "collect"
    severity: int = 1
    without: tuple[str, ...] = field(default=())


# The rules, in order of their groups.
RULES = (
    Rule("concurrency", "mutex_without_unlock", ("sync/mutex/lock",), "missing", 2, ("sync/mutex/defer_unlock",)),
    Rule("concurrency", "rwmutex_usage", ("sync/rwmutex/lock",)),
    Rule("concurrency", "atomic_operations", ("sync/atomic/load",)),
    Rule("concurrency", "waitgroup_usage", ("sync/waitgroup/add",)),
    Rule("drift", "dead_pattern_todo", ("pattern/todo/marker",)),
    Rule("drift", "dead_pattern_fixme", ("pattern/fixme/marker",), severity=2),
    Rule("drift", "framework_without_ffi", ("framework/gin/router",), "missing", 1, ("ffi/extern_call/call",)),
    Rule("error", "bare_except_collect", ("error/bare_except/suppression",), severity=2),
    Rule("error", "empty_catch_collect", ("error/empty_catch/suppression",), severity=2),
    Rule("ffi", "extern_call_collect", ("ffi/extern_call/call",)),
    Rule("ffi", "unchecked_c_error", ("ffi/unchecked_error/missing",), severity=2),
    Rule("framework", "framework_detected", ("framework/gin/router", "framework/echo/router", "framework/django/router", "framework/express/router", "framework/gorm/orm")),
    Rule("memory", "cstring_leak", ("memory/cstring/alloc",), "missing_per_function", 2, ("memory/cstring/free",)),
    Rule("pattern", "todo_collect", ("pattern/todo/marker",)),
    Rule("pattern", "unwrap_risk", ("pattern/unwrap/risk",), severity=2),
    Rule("pattern", "panic_risk", ("pattern/panic/risk",), severity=2),
    Rule("pattern", "unsafe_risk", ("pattern/unsafe/risk",), severity=2),
    Rule("security", "unsafe_code_risk", ("pattern/unsafe/risk",), severity=2),
    Rule("security", "unchecked_ffi", ("ffi/extern_call/call",), severity=2),
    Rule("security", "jni_without_validation", ("ffi/jni/export",), severity=2),
    Rule("security", "bare_except_security", ("error/bare_except/suppression",), severity=2),
    Rule("sync", "mutex_without_defer_unlock", ("sync/mutex/lock",), "missing", 2, ("sync/mutex/defer_unlock",)),
    Rule("test_quality", "unwrap_in_non_test", ("pattern/unwrap/risk",), severity=2),
    Rule("test_quality", "panic_in_non_test", ("pattern/panic/risk",), severity=2),
    Rule("test_quality", "todo_accumulation", ("pattern/todo/marker",), "count"),
)


def rule_frame(spark, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.group, r.name, r.combine, r.severity, n, optional) for r in rules for optional, of in ((False, r.needs), (True, r.without)) for n in of]
    return spark.createDataFrame(rows, "rule_set string, rule string, combine string, severity int, need string, optional boolean")


def items(facts: DataFrame, rules: tuple[Rule, ...] = RULES, group: str | None = None) -> DataFrame:
    """(rule_set, rule, combine, severity, id, function_id, symbol, confidence): the facts that each rule takes as evidence.

    All rules at once: facts meet the rules' needs in one join, and exclusions are one anti-join by rule and function.
    """
    chosen = tuple(r for r in rules if group is None or r.group == group)
    needs = F.broadcast(rule_frame(facts.sparkSession, chosen))  # the rules are a fixed list
    met = facts.withColumn("need", F.concat_ws("/", "category", "primitive", "kind")).join(needs, "need")
    barred = met.filter("optional").select("rule_set", "rule", "function_id").distinct()
    x = met.filter("not optional").join(barred, ["rule_set", "rule", "function_id"], "left_anti")
    return x.select("rule_set", "rule", "combine", "severity", "id", "function_id", "symbol", "confidence").dropDuplicates(["rule_set", "rule", "id"])


def evidence(facts: DataFrame, rules: tuple[Rule, ...] = RULES, group: str | None = None) -> DataFrame:
    """One row per rule with facts (per function too for missing_per_function): how many items, the least confidence, the first symbol."""
    x = items(facts, rules, group).withColumn("function", F.when(F.col("combine") == "missing_per_function", F.col("function_id")))
    out = x.groupBy("rule_set", "rule", "combine", "severity", "function").agg(F.count(F.lit(1)).alias("facts"), F.min("confidence").alias("least"), F.min_by("symbol", "id").alias("symbol"))
    counted = F.col("combine") == "count"
    return out.select("rule_set", "rule", "severity", "function", "facts", F.when(counted, 0).otherwise(F.col("facts")).alias("items"), F.when(counted, 1.0).otherwise(F.col("least")).alias("confidence"), "symbol")


def classified(records: DataFrame) -> DataFrame:
    """Records with the fact they stand for: category, primitive, fact; others are left out. Columns: kind, name, language, qualified_name."""
    name, lang = F.col("name"), F.lower("language")
    call = F.col("kind") == RECORD_KIND["call"]
    note = F.col("kind") == RECORD_KIND["comment"]
    upper = F.upper("name")
    cases = [
        (call & name.rlike(r"\.(RLock|WLock)$"), "sync/rwmutex/lock"),
        (call & name.rlike(r"\.(RUnlock|WUnlock)$"), "sync/rwmutex/defer_unlock"),
        (call & name.rlike(r"\.Lock$"), "sync/mutex/lock"),
        (call & name.rlike(r"\.Unlock$"), "sync/mutex/defer_unlock"),
        (call & name.rlike(r"\.Load") & F.lower("name").contains("atomic"), "sync/atomic/load"),
        (call & name.rlike(r"\.Add$") & F.lower("name").rlike("waitgroup|wg"), "sync/waitgroup/add"),
        (call & name.isin("C.CString", "C.CBytes"), "memory/cstring/alloc"),
        (call & (name == "C.free"), "memory/cstring/free"),
        (call & name.isin("malloc", "calloc", "realloc"), "memory/heap/alloc"),
        (call & (name == "free"), "memory/heap/free"),
        ((lang == "python") & (name == "except") & (F.col("qualified_name") == ""), "error/bare_except/suppression"),
        (lang.isin("javascript", "typescript") & (name == "catch") & (F.col("qualified_name") == ""), "error/empty_catch/suppression"),
        (note & upper.contains("TODO"), "pattern/todo/marker"),
        (note & upper.contains("FIXME"), "pattern/fixme/marker"),
        (call & (lang == "rust") & name.rlike(r"(^|\.)unwrap$"), "pattern/unwrap/risk"),
        (call & ((lang == "rust") & name.startswith("panic!") | (lang == "go") & (name == "panic")), "pattern/panic/risk"),
        ((lang == "rust") & (name == "unsafe"), "pattern/unsafe/risk"),
        (call & (lang == "go") & name.startswith("C."), "ffi/extern_call/call"),
        (name.startswith("JNIEXPORT_") | name.startswith("Java_"), "ffi/jni/export"),
    ]
    for framework, kind in (("gin", "router"), ("echo", "router"), ("django", "router"), ("express", "router"), ("gorm", "orm")):
        cases.append(((F.col("kind") == RECORD_KIND["import"]) & F.lower("name").contains(framework), f"framework/{framework}/{kind}"))
    label = F.lit(None).cast("string")
    for condition, value in reversed(cases):
        label = F.when(condition, value).otherwise(label)
    parts = F.split("label", "/")
    return records.withColumn("label", label).filter("label IS NOT NULL").select("*", parts[0].alias("category"), parts[1].alias("primitive"), parts[2].alias("fact")).drop("label")
