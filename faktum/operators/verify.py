"""Claims, verdicts, drift, dead code and the state of a project."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions.text import contract_name, pascal
from faktum.operators.lookup import ENTRY_NAMES, prefix_members, with_ends
from faktum.schema import CALLABLE, CALLS

# verdicts' confidences, penalties of a project's score, layers by suffix or folder, what claims are read by.
SUPPORTED, CONTRADICTED, UNKNOWN = "Supported", "Contradicted", "Unknown"
PENALTY = {"sync": 0.05, "memory": 0.10, "error": 0.04, "pattern": 0.03, "ffi": 0.04, "architecture": 0.02, "dead": 0.005}
LAYERS = (("Controller", "controller$", "/controllers/|/api/"), ("Service", "service$", "/services/"), ("Repository", "(repository|repo|store|dao)$", "/repository/|/data/"))
CONTRACTS = {"threadsafe": r"thread[-\s]?safe", "memorysafe": r"memory[-\s]?safe", "zerocopy": r"zero[-\s]?copy", "lockfree": r"lock[-\s]?free"}
LANGUAGE_NAMES = ("c", "cpp", "go", "java", "javascript", "python", "rust", "typescript")
NEGATION = r"(?i)\b(not|isn't|never|no|don't|doesn't)\b"


def implementing(subjects: DataFrame, entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(subject, id): entities that can stand for a subject: they are called or public, and their names agree.

    Names agree when equal, or one begins with the other (four letters at least), as they are, without '_', or without the
    part before the first '_'. All of these agree in the first letter of one form, so names meet through their first four.
    """
    live = entity.join(relation.filter(F.col("type") == CALLS).select(F.col("target_id").alias("id")).distinct().withColumn("called", F.lit(True)), "id", "left").filter(F.col("called") | (F.col("visibility") == 1))
    low = F.lower("name")
    tail = F.when(low.contains("_"), F.replace(F.substring(low, F.instr(low, "_") + 1, F.length(low)), F.lit("_"), F.lit(""))).otherwise("")
    forms = live.select("id", F.explode(F.array_distinct(F.array(low, F.replace(low, F.lit("_"), F.lit("")), tail))).alias("form")).filter("form <> ''")
    s = subjects.select("subject").distinct()
    asked = s.select("subject", F.explode(F.array_distinct(F.array(F.lower("subject"), F.replace(F.lower("subject"), F.lit("_"), F.lit(""))))).alias("ask"))
    equal = asked.join(forms, F.col("ask") == F.col("form")).select("subject", "id")
    key = lambda c: F.substring(c, 1, 4)
    near = asked.filter(F.length("ask") >= 4).withColumn("k", key("ask")).join(forms.filter(F.length("form") >= 4).withColumn("k", key("form")), "k").filter(F.startswith("ask", "form") | F.startswith("form", "ask")).select("subject", "id")
    return equal.unionByName(near).distinct()


def capability_verdicts(claims: DataFrame, capabilities: DataFrame, entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(subject, verdict, confidence): a capability that isn't declared or has no implementing entity contradicts its claim."""
    s = claims.select("subject").distinct()
    declared = capabilities.select(F.lower("name").alias("d")).distinct()
    known = s.join(declared, F.startswith("d", F.lower("subject"))).select("subject").distinct().withColumn("declared", F.lit(True))
    built = implementing(s, entity, relation).select("subject").distinct().withColumn("built", F.lit(True))
    x = s.join(known, "subject", "left").join(built, "subject", "left")
    verdict = F.when(F.col("declared").isNull() | F.col("built").isNull(), CONTRADICTED).otherwise(SUPPORTED)
    return x.select("subject", verdict.alias("verdict"), F.when(F.col("declared").isNull(), 0.9).when(F.col("built").isNull(), 0.7).otherwise(0.85).alias("confidence"))


def function_verdicts(claims: DataFrame, entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(subject, object, verdict, confidence): 'subject should object'. It helps when the function calls something named like the object."""
    f = entity.filter(F.col("kind").isin(*CALLABLE)).select("id", F.lower("name").alias("low"))
    x = claims.select("subject", "object").distinct().join(f, F.lower("subject") == F.col("low"), "left")
    r = relation.filter(F.col("type") == CALLS)
    ends = r.select(F.col("source_id").alias("id")).union(r.select("target_id")).distinct().withColumn("linked", F.lit(True))
    called = r.select(F.col("source_id").alias("id"), "target_id").join(entity.select(F.col("id").alias("target_id"), F.replace(F.lower("name"), F.lit("_"), F.lit("")).alias("callee")), "target_id")
    near = x.filter("id IS NOT NULL").join(called, "id").filter(F.contains("callee", F.replace(F.lower("object"), F.lit(" "), F.lit("")))).select("subject", "object").distinct().withColumn("near", F.lit(True))
    y = x.join(ends, "id", "left").groupBy("subject", "object").agg(F.bool_or(F.col("id").isNotNull()).alias("found"), F.bool_or(F.coalesce("linked", F.lit(False))).alias("linked")).join(near, ["subject", "object"], "left")
    verdict = F.when(~F.col("found"), CONTRADICTED).when(~F.col("linked"), UNKNOWN).otherwise(SUPPORTED)
    return y.select("subject", "object", verdict.alias("verdict"), F.when(~F.col("found"), 0.85).when(F.col("near"), 0.75).otherwise(0.55).alias("confidence"))


def contract_verdicts(claims: DataFrame, contracts: DataFrame, entity: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(subject, verdict, confidence): a declared contract is supported if some entity's name fits its pattern."""
    s = claims.select(contract_name(F.col("subject")).alias("subject")).distinct()
    known = contracts.select(contract_name(F.col("name")).alias("subject")).distinct().withColumn("declared", F.lit(True))
    hits = entity.agg(*[F.bool_or(F.col("name").rlike("(?i)" + p)).alias(k) for k, p in patterns.items()])
    x = s.join(known, "subject", "left").crossJoin(F.broadcast(hits))
    fits = F.lit(None).cast("boolean")
    for k in patterns:
        fits = F.when(F.col("subject") == k, F.coalesce(F.col(k), F.lit(False))).otherwise(fits)
    yes = F.when(F.col("subject") == "threadsafe", 0.7).otherwise(0.6)
    no = F.when(F.col("subject") == "zerocopy", 0.3).otherwise(0.4)
    return x.select("subject", F.when(F.col("declared") & fits, SUPPORTED).otherwise(UNKNOWN).alias("verdict"), F.when(F.col("declared").isNull(), 0.5).when(fits.isNull(), 0.3).when(fits, yes).otherwise(no).alias("confidence"))


def layer(name: Column, path: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, (_, suffix, folders) in reversed(list(enumerate(LAYERS))):
        out = F.when(F.lower(name).rlike(suffix) | F.lower(path).rlike(folders), rank).otherwise(out)
    return out


def layer_drift(entity: DataFrame, relation: DataFrame, top: int = 100) -> DataFrame:
    """Calls that go up the layers, or from controller to controller."""
    e = entity.withColumn("layer", layer(F.col("name"), F.col("file_path"))).filter("layer IS NOT NULL")
    x = with_ends(e, relation.filter(F.col("type") == CALLS), ("layer",)).filter("source_id <> target_id")
    kind = F.when(F.col("source_layer") > F.col("target_layer"), "reverse call").when((F.col("source_layer") == 0) & (F.col("target_layer") == 0), "same-layer bypass")
    return x.select("source_id", "target_id", kind.alias("violation")).filter("violation IS NOT NULL").orderBy("source_id", "target_id").limit(top)


def architecture_verdict(chains: DataFrame, entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(a, b, verdict, confidence) of each step of a claimed chain of layers, by the calls between members of the two."""
    x = with_ends(entity, relation.filter(F.col("type") == CALLS), ("name", "file_path"))
    flow = lambda one, two: F.contains(F.lower("source_name"), F.lower(one)) & F.contains(F.lower("target_name"), F.lower(two))
    j = chains.select("a", "b").distinct().join(x.select("source_name", "target_name").distinct(), flow("a", "b") | flow("b", "a"), "left")
    y = j.groupBy("a", "b").agg(F.count_if(flow("a", "b")).alias("forward"), F.count_if(flow("b", "a")).alias("back"))
    return y.select("a", "b", F.when(F.col("back") > 0, CONTRADICTED).when(F.col("forward") == 0, UNKNOWN).otherwise(SUPPORTED).alias("verdict"), F.when(F.col("back") > 0, 0.75).when(F.col("forward") == 0, 0.5).otherwise(0.8).alias("confidence"))


def capability_drift(capabilities: DataFrame, entity: DataFrame, relation: DataFrame) -> DataFrame:
    """Declared capabilities that nothing implements."""
    s = capabilities.select(F.col("name").alias("subject")).distinct()
    return s.join(implementing(s, entity, relation), "subject", "left_anti")


def documentation_drift(documents: DataFrame, entity: DataFrame) -> DataFrame:
    """(language): languages that a document's plain text names (fenced blocks aside) and no entity is written in."""
    plain = F.regexp_replace(F.lower("content"), r"(?s)```.*?```", " ")
    text = F.replace(F.replace(plain, F.lit("c++"), F.lit("cpp")), F.lit("golang"), F.lit("go"))
    words = documents.select(F.explode(F.array_distinct(F.split(text, r"[^a-z]+"))).alias("language")).filter(F.col("language").isin(*[x for x in LANGUAGE_NAMES if x != "c"])).distinct()
    return words.join(entity.select(F.when(F.col("language") == "c", "cpp").otherwise(F.col("language")).alias("language")), "language", "left_anti")


def claims(texts: DataFrame) -> DataFrame:
    """(id, predicate, subject, object) that sentences of (id, text) make; negated sentences make none.

    A text is split once and each sentence read once. Patterns are tried only where a word that they can't do without occurs.
    """
    words = ("support", "implement", "has", "contain", "should", "thread", "memory", "zero", "lock", "->")
    told = lambda low: reduce(or_, [low.contains(w) for w in words])
    s = texts.filter(told(F.lower("text"))).select("id", F.explode(F.split("text", r"(?<=[.!?\n])\s+")).alias("s")).select("id", "s", F.lower("s").alias("low")).filter(told(F.col("low"))).filter(~F.col("s").rlike(NEGATION))
    def first(pattern: str, g: int = 1) -> Column:
        return F.regexp_extract("s", pattern, g)

    def thing(x: Column) -> Column:
        return pascal(F.regexp_replace(x, r"(?i)( and | is | but | or | are | was | were | in |[,.;!\n]).*$", ""))

    def claim(needs: tuple[str, ...], predicate: str, subject: Column, object_: Column | None = None) -> Column:
        made = F.struct(F.lit(predicate).alias("predicate"), subject.alias("subject"), (F.lit("") if object_ is None else object_).alias("object"))
        return F.when(reduce(or_, [F.col("low").contains(w) for w in needs]), made)

    parts = [claim(needs, p, thing(first(rx))) for needs, p, rx in ((("support",), "supported_by", r"(?i)supports?\s+([A-Za-z][A-Za-z0-9_\- ]{1,50})"), (("implement",), "implemented_by", r"(?i)implements?\s+([A-Za-z][A-Za-z0-9_\- ]{1,50})"), (("has", "contain"), "has", r"(?i)\b(?:has|contains?)\s+(?:an?\s+|the\s+)?([A-Za-z][A-Za-z0-9_\- ]{1,50})"))]
    should = r"(?i)\b([A-Za-z_]\w{0,60})\s+should\s+([A-Za-z][A-Za-z0-9_\- ,]{0,80})"
    parts.append(claim(("should",), "should", first(should), F.rtrim(first(should, 2))))
    parts += [claim((rx.split("[")[0],), "contract", F.when(F.col("s").rlike("(?i)" + rx), k).otherwise("")) for k, rx in CONTRACTS.items()]
    chain = r"([A-Za-z]+)\s*->\s*([A-Za-z]+)\s*->\s*([A-Za-z]+)"
    parts.append(claim(("->",), "follows", first(chain), F.concat_ws(">", first(chain, 2), first(chain, 3))))
    return s.select("id", F.explode(F.array_compact(F.array(*parts))).alias("c")).select("id", "c.*").filter("subject <> ''").distinct()


def trust(verdicts: DataFrame) -> DataFrame:
    """One row: how many verdicts of each kind, and the trust they leave (1 without claims)."""
    x = verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in (SUPPORTED, CONTRADICTED, UNKNOWN)])
    decided = F.col("supported") + F.col("contradicted")
    total = decided + F.col("unknown")
    return x.withColumn("trust", F.when(total == 0, 1.0).when(decided == 0, 0.0).otherwise(F.round(F.col("supported") / decided, 6))).withColumn("integrity", F.greatest(F.lit(0.0), F.round(1 - 0.1 * (F.col("contradicted") + F.col("unknown")), 6)))


def dead_functions(entity: DataFrame, relation: DataFrame, top: int | None = 500) -> DataFrame:
    """Functions that no relation names, the first by id; without top all of them, for counts."""
    x = entity.filter(F.col("kind").isin(*CALLABLE) & (F.col("visibility") != 1) & ~F.col("name").isin(*ENTRY_NAMES))
    for end in ("source_id", "target_id"):
        x = x.join(relation.select(F.col(end).alias("id")), "id", "left_anti")
    return x if top is None else x.orderBy("id").limit(top)


def dead_modules(entity: DataFrame, relation: DataFrame, least: int = 10, top: int = 500) -> DataFrame:
    """(name, entities): modules of some size that nothing outside refers to; a module holds all files under its path."""
    scope = entity.select(F.col("module_path").alias("name")).distinct()
    m = prefix_members(scope, entity)
    size = m.groupBy("name").agg(F.count(F.lit(1)).alias("entities")).filter(F.col("entities") >= least)
    into = relation.join(m.withColumnRenamed("id", "target_id"), "target_id").select("name", "source_id")
    outside = into.distinct().join(m.withColumnRenamed("id", "source_id"), ["name", "source_id"], "left_anti").select("name").distinct()
    return size.join(outside, "name", "left_anti").orderBy("name").limit(top)


def capabilities(documents: DataFrame) -> DataFrame:
    """(name) of what lines with support or feature list in documents (content)."""
    lines = documents.select(F.explode(F.split("content", "\n")).alias("line")).filter(F.col("line").rlike("support|Supports|Feature|feature"))
    name = F.substring(pascal(F.regexp_replace("line", r"^[-*\s]+", "")), 1, 40)
    return lines.select(name.alias("name")).filter("name <> ''").distinct()


def contracts(documents: DataFrame, entity: DataFrame, top: int = 20) -> DataFrame:
    """(name, origin): contract words of documents' lines without negation, and entities named as open tasks."""
    lines = documents.select(F.explode(F.split("content", "\n")).alias("line")).filter(~F.col("line").rlike(NEGATION))
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike("(?i)" + rx), k) for k, rx in CONTRACTS.items()]))
    named = lines.select(F.explode(found).alias("name")).distinct().withColumn("origin", F.lit("document"))
    tasks = entity.filter(F.upper("name").rlike("TODO|FIXME|HACK|XXX")).orderBy("id").limit(top).select("name", F.lit("entity").alias("origin"))
    return named.unionByName(tasks)


def project_state(items: DataFrame, violations: int | Column, dead: DataFrame, entity: DataFrame) -> DataFrame:
    """One row: issues by category, sub-scores and confidence, each from 0 to 1."""
    names = [k for k in PENALTY if k not in ("architecture", "dead")]
    x = items.agg(*[F.count_if(F.col("rule_set") == k).alias(k) for k in names]).crossJoin(dead.agg(F.count(F.lit(1)).alias("dead"))).crossJoin(entity.agg(F.count(F.lit(1)).alias("entities")))
    x = x.withColumn("architecture", F.lit(violations) if isinstance(violations, int) else violations)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    score = F.lit(1.0)
    for k, p in PENALTY.items():
        score = score - p * F.col(k)
    return x.withColumn("confidence", F.round(clamp(score), 6)).withColumn("architecture_score", F.round(clamp(1 - 0.02 * F.col("architecture")), 6)).withColumn("dead_share", F.round(F.col("dead") / F.greatest("entities", F.lit(1)), 6))


def snapshot(state: DataFrame) -> DataFrame:
    """The state as one JSON text."""
    return state.select(F.to_json(F.struct(*state.columns)).alias("snapshot"))
