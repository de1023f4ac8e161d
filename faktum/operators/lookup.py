"""Lookups and joins over entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.schema import CALLABLE, CALLS

# Names that start a program; foreign-function prefixes; intents of a question and words that tell them.
ENTRY_NAMES = ("main", "Main", "run", "Run", "start", "Start", "init", "Init", "setup", "Setup")
FFI_PREFIXES = ("extern_", "ffi_", "wasm_", "cabi_", "jni_", "JNI_", "CALLBACK_")
INTENTS = (("entry_points", "entry|main|start"), ("callgraph", "call|invoke"), ("drivers", "driver"), ("memory", "memory|alloc"), ("scheduler", "schedul"), ("overview", "overview|architecture|summary"))


def find_definition(entity: DataFrame, name: str, path: str | None = None, limit: int | None = 20) -> DataFrame:
    out = entity.filter((F.col("name") == name) | (F.col("qualified_name") == name))
    out = out.filter(F.lower("file_path").contains(path.lower())) if path else out
    return out.orderBy("id").limit(limit) if limit else out


def by_symbol(entity: DataFrame, name: str) -> DataFrame:
    """A name with '::' or '.' is a qualified one."""
    return entity.filter(F.col("qualified_name" if "::" in name or "." in name else "name") == name)


def candidates(entity: DataFrame, name: str) -> DataFrame:
    """The entities of an ambiguous bare name; none if it is unique."""
    found = by_symbol(entity, name)
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("_n")))).filter("_n > 1").drop("_n")


def entry_points(entity: DataFrame) -> DataFrame:
    return entity.filter(F.col("kind").isin(*CALLABLE) & F.col("name").isin(*ENTRY_NAMES))


def is_language_entry() -> Column:
    lang, name = F.lower("language"), F.col("name")
    return (lang.isin("c", "cpp", "c++", "go", "rust") & (name == "main")) | ((lang == "go") & (name == "init"))


def neighbours_of(entity: DataFrame, relation: DataFrame, seeds: DataFrame, inward: bool, limit: int | None = 1000) -> DataFrame:
    """Callers (inward) or callees of the seed ids: one row an entity, the confidence of its first relation."""
    here, there = ("target_id", "source_id") if inward else ("source_id", "target_id")
    edges = relation.filter(F.col("type") == CALLS).join(seeds.select(F.col("id").alias(here)).distinct(), here, "left_semi")
    best = edges.groupBy(F.col(there).alias("id")).agg(F.min_by("confidence", here).alias("confidence"))
    out = best.join(entity, "id").select("id", "name", "file_path", "start_row", "confidence")
    return out.orderBy("id").limit(limit) if limit else out


def callers(entity: DataFrame, relation: DataFrame, name: str, limit: int | None = 1000) -> DataFrame:
    return neighbours_of(entity, relation, by_symbol(entity, name), True, limit)


def callees(entity: DataFrame, relation: DataFrame, name: str, limit: int | None = 1000) -> DataFrame:
    return neighbours_of(entity, relation, by_symbol(entity, name), False, limit)


def references(entity: DataFrame, relation: DataFrame, name: str, types: tuple[int, ...] = (1, 3), limit: int = 100) -> DataFrame:
    seeds = by_symbol(entity, name).select(F.col("id").alias("target_id"))
    sources = relation.filter(F.col("type").isin(*types)).join(seeds, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return entity.join(sources, "id", "left_semi").orderBy("id").limit(limit)


def edges_around(entity: DataFrame, relation: DataFrame, node: int, edge_type: int = 0, limit: int = 500) -> DataFrame:
    edges = relation.filter(F.col("type") == edge_type) if edge_type > 0 else relation
    e = entity.select(F.col("id").alias("other"), "name", "kind")
    out = edges.filter(F.col("source_id") == node).select(F.lit("out").alias("direction"), F.col("target_id").alias("other"), "type", "confidence")
    inward = edges.filter(F.col("target_id") == node).select(F.lit("in").alias("direction"), F.col("source_id").alias("other"), "type", "confidence")
    return out.orderBy("other", "type").limit(limit).unionByName(inward.orderBy("other", "type").limit(limit)).join(e, "other")


def explained(entity: DataFrame, relation: DataFrame, name: str) -> DataFrame:
    """All definitions, callers and callees of a name in one table."""
    part = lambda df, role: df.select(F.lit(role).alias("role"), "id", "name", "file_path")
    return part(find_definition(entity, name, limit=None), "definition").unionByName(part(callers(entity, relation, name, None), "caller")).unionByName(part(callees(entity, relation, name, None), "callee"))


def with_ends(entity: DataFrame, relation: DataFrame, columns: tuple[str, ...] = ("name", "kind", "file_path", "module_path")) -> DataFrame:
    """Relations with columns of both ends, as source_* and target_*."""
    side = lambda p: entity.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return relation.join(side("source"), "source_id").join(side("target"), "target_id")


def cover(lo: Column, hi: Column) -> Column:
    """The largest aligned blocks (level, block) that fill lo..hi: two a level at most. A block holds the rows whose number shifted right by its level is its own."""
    size = lambda k: F.pow(F.lit(2), k).cast("long")
    def at(k: Column) -> Column:
        first, last = F.ceil(lo / size(k)).cast("long"), F.floor((hi + 1) / size(k)).cast("long") - 1
        block = lambda x, parity: F.when((first <= last) & (F.pmod(x, F.lit(2)) == parity), F.struct(k.cast("int").alias("level"), x.alias("block")))
        return F.array(block(first, 1), block(last, 0))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(32)), at)))


def enclosing(records: DataFrame, entity: DataFrame) -> DataFrame:
    """Each record (rid, file_path, row) with the innermost function around it: the latest start, then the least id.

    Functions and records aren't paired: a function is written to the few blocks that fill its rows, a block keeps its best
    function, and each different row of a file looks up the blocks it is in, one a level.
    """
    e = entity.filter(F.col("kind").isin(*CALLABLE)).groupBy("file_path", "start_row", "end_row").agg(F.min("id").alias("fid"))
    end = F.when(F.col("end_row") == 0, F.lit(2**31 - 1)).otherwise(F.col("end_row")).cast("long")
    blocks = e.withColumn("b", F.explode(cover(F.col("start_row").cast("long"), end))).select("file_path", "b.*", "start_row", "fid")
    best = blocks.groupBy("file_path", "level", "block").agg(F.max_by("fid", F.struct("start_row", -F.col("fid"))).alias("fid"), F.max("start_row").alias("start_row"))
    levels = best.select("level").distinct()  # 33 at most
    rows = records.select("file_path", "row").distinct().crossJoin(F.broadcast(levels)).withColumn("block", F.call_function("shiftright", F.col("row").cast("long"), F.col("level")))
    inner = rows.join(best, ["file_path", "level", "block"]).groupBy("file_path", "row").agg(F.max_by("fid", F.struct("start_row", -F.col("fid"))).alias("fid"), F.max("start_row").alias("start_row"))
    return records.join(inner, ["file_path", "row"]).groupBy("rid").agg(F.max_by("fid", F.struct("start_row", -F.col("fid"))).alias("function_id"))


def first_of_file(entity: DataFrame) -> DataFrame:
    return entity.filter(F.col("kind").isin(*CALLABLE)).groupBy("file_path").agg(F.min_by("id", F.struct("start_row", "id")).alias("function_id"))


def ancestors(path: Column) -> Column:
    """All folders that a path is under, each with its slash: what turns a prefix join into an equal join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))


def prefix_members(scope: DataFrame, entity: DataFrame) -> DataFrame:
    """(scope name, entity id) for each entity whose file is under the scope; letters' case doesn't count."""
    e = entity.select("id", F.explode(F.array_distinct(ancestors(F.lower("file_path")))).alias("under"))
    return scope.select("name", F.lower("name").alias("under")).join(e, "under").select("name", "id")


def containing(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(owner, interface) where the owner's members hold all of the interface's: relational division. Columns: owner, member; interface, member."""
    need = wanted.groupBy("interface").agg(F.countDistinct("member").alias("need"))
    have = wanted.distinct().join(sets.distinct(), "member").groupBy("owner", "interface").agg(F.count(F.lit(1)).alias("have"))
    return have.join(need, "interface").filter("have = need").select("owner", "interface")


def ffi_named(entity: DataFrame, limit: int = 30) -> DataFrame:
    starts = F.lit(False)
    for p in FFI_PREFIXES:
        starts = starts | F.col("name").startswith(p)
    return entity.filter(starts).orderBy("id").limit(limit)


def intent(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit("general")
    for name, words in reversed(INTENTS):
        out = F.when(q.rlike(words), name).otherwise(out)
    return F.when(q.rlike(r"module\s+[\w/.-]+"), F.concat(F.lit("module:"), F.regexp_extract(q, r"module\s+([\w/.-]+)", 1))).otherwise(out)
