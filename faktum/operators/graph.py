"""Traversals, paths, impact, communities and components over call relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faktum.functions.lineage import cut
from faktum.schema import CALLABLE, CALLS

# Bounds of the operators.
PATH_DEPTH, IMPACT_DEPTH, RADIUS, TREE_DEPTH, ROUNDS = 10, 3, 8, 5, 20


def calls(relation: DataFrame, reverse: bool = False, both: bool = False) -> DataFrame:
    """Distinct call edges (a, b) without loops."""
    e = relation.filter((F.col("type") == CALLS) & (F.col("source_id") != F.col("target_id"))).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    if both:  # the relation is read once
        return e.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("e")).select("e.*").distinct()
    return (e.select(turned.alias("e")).select("e.*") if reverse else e).distinct()


def adjacency(relation: DataFrame) -> DataFrame:
    return calls(relation).groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias("callees"))


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth, via): all that the seed ids reach in at most depth steps, at the least depth, via the least predecessor.

    The frontier and what was seen are tables; each step is one join and one anti-join.
    """
    seen = cut(seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via")).dropDuplicates(["id"]))
    frontier = seen
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("via"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(relation: DataFrame, source: int, target: int, depth: int = PATH_DEPTH) -> DataFrame:
    """(step, id) of a shortest path of calls; no rows if there is none. The way back takes the least predecessor."""
    spark = relation.sparkSession
    at = cut(reach(cut(calls(relation)), spark.createDataFrame([(source,)], "id long"), depth))
    end = at.filter(F.col("id") == target)
    row = end.first()
    if row is None:
        return spark.createDataFrame([], "step int, id long")
    path = end.select(F.col("depth").alias("step"), "id", "via")
    out = path.select("step", "id")
    for _ in range(row["depth"]):
        path = at.join(path.select(F.col("via").alias("id")), "id").select(F.col("depth").alias("step"), "id", "via")
        out = out.unionByName(path.select("step", "id"))
    return out


def distances(relation: DataFrame, source: int, depth: int = PATH_DEPTH) -> DataFrame:
    return reach(cut(calls(relation)), relation.sparkSession.createDataFrame([(source,)], "id long"), depth).select("id", F.col("depth").alias("hops"))


def subgraph(entity: DataFrame, relation: DataFrame, centre: int, radius: int = 1, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """Entities within radius steps either way; kinds restrict what is shown, not what is passed through."""
    near = reach(cut(calls(relation, both=True)), relation.sparkSession.createDataFrame([(centre,)], "id long"), min(max(radius, 1), RADIUS))
    out = near.join(entity, "id").select("id", "name", "kind", F.col("depth").alias("hops"))
    return out.filter(F.col("kind").isin(*kinds)) if kinds else out


def call_tree(relation: DataFrame, root: int, depth: int = 3, reverse: bool = False) -> DataFrame:
    """(depth, id, parent, walks): the levels of the tree of calls from root, where a function is shown each time it is reached.

    Walks that end in the same (parent, id) at a level are one row with their number, so rows don't grow with the walks.
    """
    e = cut(calls(relation, reverse))
    level = relation.sparkSession.createDataFrame([(root,)], "id long").select(F.lit(0).alias("depth"), "id", F.lit(None).cast("long").alias("parent"), F.lit(1).cast("long").alias("walks"))
    out = level
    for d in range(1, min(depth, TREE_DEPTH) + 1):
        here = level.groupBy(F.col("id").alias("a")).agg(F.sum("walks").alias("walks"))
        level = cut(e.join(here, "a").select(F.lit(d).alias("depth"), F.col("b").alias("id"), F.col("a").alias("parent"), "walks"))
        out = out.unionByName(level)
    return out


def name_chain(entity: DataFrame, relation: DataFrame, source: str, target: str, most: int = 64) -> DataFrame:
    """(hops): the length of the shortest chain of names, where entities of one name are one."""
    n = entity.select("id", "name")
    e = calls(relation).join(n.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(n.select(F.col("id").alias("b"), F.col("name").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct()
    e = cut(e)
    seen = frontier = cut(relation.sparkSession.createDataFrame([(source, 0)], "id string, hops int"))
    for d in range(1, most + 1):
        step = e.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if not frontier.filter(F.col("id") == target).isEmpty():
            break
    return seen.filter(F.col("id") == target).select("hops")


def impact(entity: DataFrame, relation: DataFrame, files: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """(direction, id, depth): functions that changed files (file_path) reach as callers or callees, without the seeds."""
    seeds = entity.filter(F.col("kind").isin(*CALLABLE)).join(files, "file_path", "left_semi").select("id")
    forth = cut(calls(relation))
    back = forth.select(F.col("b").alias("a"), F.col("a").alias("b"))
    parts = [reach(back if reverse else forth, seeds, depth).filter("depth > 0").select(F.lit(name).alias("direction"), "id", "depth") for name, reverse in (("callers", True), ("callees", False))]
    return parts[0].unionByName(parts[1])


def communities(entity: DataFrame, relation: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, label) by synchronous label propagation over undirected calls.

    A node takes its neighbours' commonest label: its own if that ties for most, else the least. A node without calls keeps
    its own. It ends when nothing changes or after rounds steps, as labels may alternate for ever.

    A node and its neighbours are one row, which a round joins with the node's label; the votes are then sent once, to where
    they are counted. A node's own label comes among its votes with weight 0, so it wins no more than a tie it has part in.
    """
    e = calls(relation, both=True).join(entity.select(F.col("id").alias("a")), "a", "left_semi").join(entity.select(F.col("id").alias("b")), "b", "left_semi")
    near = cut(e.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("near")))
    labels = near.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        told = near.join(labels, "id").select(F.explode("near").alias("id"), "label", F.lit(1).alias("n"), F.lit(False).alias("own"))
        votes = told.unionByName(labels.select("id", "label", F.lit(0).alias("n"), F.lit(True).alias("own"))).repartition("id")
        counts = votes.groupBy("id", "label").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        best = counts.groupBy("id").agg(F.max_by("label", F.struct("n", "own", -F.col("label"))).alias("label"), F.max(F.when(F.col("own"), F.col("label"))).alias("was"))
        new = cut(best.select("id", "label", (F.col("label") != F.col("was")).alias("moved")))
        labels = new.select("id", "label")
        if new.filter("moved").isEmpty():
            break
    return labels


def community_summary(entity: DataFrame, relation: DataFrame, rounds: int = ROUNDS, top: int = 500) -> DataFrame:
    """(representative, size, inner, outer): the member of highest degree stands for a community; edges counted are directed."""
    labels = cut(communities(entity, relation, rounds))
    degree = calls(relation, both=True).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    sizes = labels.join(degree, "id").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.struct(-F.col("degree"), "id")).alias("representative"))
    edges = relation.filter((F.col("type") == CALLS) & (F.col("source_id") != F.col("target_id")))
    ends = edges.join(labels.select(F.col("id").alias("source_id"), F.col("label").alias("label")), "source_id").join(labels.select(F.col("id").alias("target_id"), F.col("label").alias("other")), "target_id")
    counts = ends.groupBy("label").agg(F.count_if(F.col("label") == F.col("other")).alias("inner"), F.count_if(F.col("label") != F.col("other")).alias("outer"))
    return sizes.join(counts, "label", "left").na.fill(0, ["inner", "outer"]).select("representative", "size", "inner", "outer").orderBy(F.desc("size"), "representative").limit(top)


def components(relation: DataFrame) -> DataFrame:
    """(id, component): weakly connected components of calls, each named by its least id; loops alone make none.

    Labels fall to the least of the neighbours' and then jump along labels of labels, so that long chains take few rounds.
    """
    e = cut(calls(relation, both=True))
    labels = cut(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = e.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("jump"))
        new = cut(low.join(up, "low", "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("to"), "component"))
        labels = new.select("id", F.col("to").alias("component"))
        if new.filter("to <> component").isEmpty():
            return labels


def component_stats(relation: DataFrame) -> DataFrame:
    sizes = components(relation).groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def matched_by_name(refs: DataFrame, entity: DataFrame) -> DataFrame:
    """(ref_id, id): a reference's entity by qualified name, else by name and arity, else by name where the arity isn't known (0)."""
    e = entity.select("id", F.col("name").alias("e_name"), "qualified_name", "arity")
    exact = refs.join(e, refs["qualified_target"] == e["qualified_name"]).select("ref_id", "id", F.lit(0).alias("p"))
    x = refs.withColumnRenamed("arity", "r_arity").join(e, F.col("name") == F.col("e_name"))
    rest = x.filter((F.col("r_arity") == F.col("arity")) | (F.col("arity") == 0)).select("ref_id", "id", F.when(F.col("r_arity") == F.col("arity"), 1).otherwise(2).alias("p"))
    w = Window.partitionBy("ref_id").orderBy("p")
    return exact.unionByName(rest).withColumn("r", F.rank().over(w)).filter("r = 1").select("ref_id", "id")
