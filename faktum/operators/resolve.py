"""Resolving call sites to entities: candidates by name, gates, weighted evidence, a margin, and fuzzy tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faktum.functions.text import canonical_type, family
from faktum.schema import CALLABLE

# Weights of the factors in order of evaluation, and thresholds.
WEIGHTS = {"module": 0.15, "import": 0.80, "namespace": 0.10, "signature": 0.10, "distance": 0.05, "constructor": 0.10, "receiver": 0.15, "common": 0.10, "call_kind": 0.15, "definition": 0.20}
LEAST, MARGIN, MOST_CANDIDATES, FUZZY_HITS, FAST = 0.40, 0.15, 50, 5, 0.85
# Names too common to tell anything, compared by case.
COMMON = (
    "Len", "Init", "Run", "Stop", "Close", "Open", "Read", "Write", "Get", "Set", "Add", "Remove", "Update", "Delete", "Create", "New",
    "Process", "Handle", "Execute", "Start", "End", "Error", "String", "Format", "Marshal", "Unmarshal", "Equals", "Compare", "Hash",
    "Copy", "Clone", "Reset", "Clear", "IsEmpty", "IsValid", "HasNext", "Next", "Previous", "First", "Last", "Value", "Key", "Int", "Float",
    "Bool", "Bytes", "Size", "Cap",
)
# Names that are matched exactly or not at all.
NOT_FUZZY = (
    "Error", "Len", "String", "Done", "Contains", "Errorf", "Sprintf", "Printf", "Print", "Println", "Panic", "Fatal", "Append", "Make",
    "Copy", "Delete", "Close", "Cap", "Range", "Value",
)


def candidates(refs: DataFrame, entity: DataFrame, imports: DataFrame) -> DataFrame:
    """Each reference with the callable or type entities of its name that language and visibility let it see.

    refs: ref_id, caller_id, name, arity, call_kind, qualified_target, receiver_type. imports: file_path, module.
    References with more candidates than MOST_CANDIDATES are left out.
    """
    e = entity.filter(F.col("kind").isin(*CALLABLE, 2, 3, 4))
    c = e.select("id", "name", "kind", F.col("qualified_name").alias("qname"), F.col("file_path").alias("file"), F.col("module_path").alias("module"), F.col("language").alias("lang"), F.col("arity").alias("c_arity"))
    caller = entity.select(F.col("id").alias("caller_id"), F.col("file_path").alias("from_file"), F.col("module_path").alias("from_module"), F.col("language").alias("from_lang"))
    few = refs.select("ref_id", "name").join(e.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name").filter(F.col("n") <= MOST_CANDIDATES).select("ref_id")
    x = refs.join(few, "ref_id", "left_semi").join(caller, "caller_id").join(c, "name").filter(F.col("id") != F.col("caller_id"))
    x = x.filter((family(F.col("lang")) == family(F.col("from_lang"))) | (F.col("lang") == "") | (F.col("from_lang") == ""))
    first = F.substring("name", 1, 1)
    hidden = ((F.col("lang") == "go") & (first == F.lower(first)) & first.rlike("[a-z]") & (F.col("module") != F.col("from_module"))) | ((F.col("lang") == "python") & (first == "_") & (F.col("file") != F.col("from_file")))
    known = imports.select(F.col("file_path").alias("from_file"), F.col("module"), F.lit(True).alias("imported")).distinct()
    return x.filter(~hidden).join(known, ["from_file", "module"], "left").withColumn("imported", F.coalesce("imported", F.lit(False)))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)[^/]+/$", 1)


def scored(cands: DataFrame) -> DataFrame:
    """Candidates with their points (thousandths, whole), their weighted mean, and the factor that decides (the first of the largest)."""
    c = F.col
    same = c("module") == c("from_module")
    module = F.when(same, 1.0).when(_parent(c("module")) == _parent(c("from_module")), 0.5).otherwise(0.0)
    receiver = canonical_type(c("receiver_type"))
    score = {
        "module": module,
        "import": F.when(same | c("imported"), 1.0).otherwise(0.0),
        "namespace": module,
        "signature": F.when((c("arity") == 0) & (c("c_arity") == 0), 0.5).when(c("arity") == c("c_arity"), 1.0).when(c("c_arity") == 0, 0.5).otherwise(-0.5),
        "distance": F.when(c("file") == c("from_file"), 1.0).when(same, 0.3).otherwise(0.0),
        "constructor": F.when(c("kind").isin(2, 3), 1.0).otherwise(0.0),
        "receiver": F.when(receiver == "", 0.5).when(c("qname").startswith(F.concat(receiver, F.lit("."))) | c("qname").startswith(F.concat(receiver, F.lit("::"))), 1.0).when(F.contains(c("qname"), receiver), 0.5).when(F.contains(F.lower("file"), F.lower(receiver)), 0.2).otherwise(0.0),
        "common": F.when(c("name").isin(*COMMON) & ~same, -0.25).otherwise(0.0),
        "call_kind": F.when(c("call_kind") == 3, 0.3).when(c("call_kind") == 2, -0.3).when(c("call_kind") == 1, -0.1).otherwise(0.0),
        "definition": F.when((c("lang") == "cpp") & c("file").rlike(r"\.(h|hh|hpp|hxx)$"), -0.5).otherwise(1.0),
    }
    counts = lambda k: F.when(c("call_kind") == 0, 0.0).otherwise(WEIGHTS[k]) if k == "call_kind" else F.lit(WEIGHTS[k])
    total = sum((counts(k) for k in WEIGHTS), F.lit(0.0))
    points = sum((counts(k) * score[k] for k in WEIGHTS), F.lit(0.0))
    ranked = F.array(*[F.struct((counts(k) * score[k]).alias("v"), F.lit(-i).alias("at"), F.lit(k).alias("name")) for i, k in enumerate(WEIGHTS)])
    return cands.withColumn("points", F.round(1000 * points).cast("long")).withColumn("score", F.round(points / total, 6)).withColumn("factor", F.array_max(ranked)["name"])


def resolved(scores: DataFrame) -> DataFrame:
    """(ref_id, caller_id, id, confidence, resolution): the best candidate, if good enough and clear of the second.

    A single candidate in the caller's folder is taken at once. A candidate whose qualified name is the one asked for is clear.
    """
    w = Window.partitionBy("ref_id")
    order = w.orderBy(F.desc("score"), "id")
    x = scores.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).filter("rank = 1")
    named = (F.col("qualified_target") != "") & (F.col("qname") == F.col("qualified_target"))
    local = (F.col("n") == 1) & (F.col("module") == F.col("from_module"))
    clear = F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 6) >= MARGIN)
    kind = F.when(local, "exact_local").when(named, "qualified").otherwise(F.col("factor"))
    return x.filter(local | named | ((F.col("score") >= LEAST) & clear)).select("ref_id", "caller_id", "id", F.when(local, FAST).otherwise(F.col("score")).alias("confidence"), kind.alias("resolution"))


def edges(chosen: DataFrame) -> DataFrame:
    """Call relations from resolutions: of several references between two entities the first counts."""
    return chosen.groupBy(F.col("caller_id").alias("source_id"), F.col("id").alias("target_id")).agg(F.min_by("confidence", "ref_id").alias("confidence"), F.min_by("resolution", "ref_id").alias("resolution"), F.lit(1).alias("type"))


def fuzzy(names: DataFrame, entity: DataFrame, hits: int = FUZZY_HITS) -> DataFrame:
    """(name, tier, ids), for names that aren't in NOT_FUZZY: equal but for case, else a prefix either way, else a suffix (three letters at least); the first ids.

    Prefixes and suffixes meet through their first or last three letters, so names are never compared pairwise.
    """
    n = names.select("name").filter(~F.col("name").isin(*NOT_FUZZY)).distinct().withColumn("low", F.lower("name"))
    e = entity.select("id", F.lower("name").alias("e"))
    same = n.join(e, F.col("low") == F.col("e")).select("name", F.lit(1).alias("tier"), "id")
    head, tail = lambda c: F.substring(c, 1, 3), lambda c: F.substring(c, -3, 3)
    long_ = n.filter(F.length("low") >= 3)
    prefix = long_.withColumn("k", head("low")).join(e.withColumn("k", head("e")), "k").filter(F.startswith("e", "low") & (F.col("e") != F.col("low"))).select("name", F.lit(2).alias("tier"), "id")
    suffix = long_.withColumn("k", tail("low")).join(e.withColumn("k", tail("e")), "k").filter(F.endswith("e", "low") & (F.col("e") != F.col("low"))).select("name", F.lit(3).alias("tier"), "id")
    every = same.unionByName(prefix).unionByName(suffix)
    best = every.withColumn("best", F.min("tier").over(Window.partitionBy("name"))).filter("tier = best")
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("id"))).filter(F.col("r") <= hits)
    return first.groupBy("name").agg(F.min("tier").alias("tier"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))


def dispatch(calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(ref_id, id, confidence): a call on an interface's method goes to that method of each type that implements it.

    calls: ref_id, interface, method; implements: interface, type; methods: type, method, id.
    """
    return calls.join(implements, "interface").join(methods, ["type", "method"]).select("ref_id", "id", F.lit(0.60).alias("confidence"), F.lit("dispatch").alias("resolution")).distinct()
