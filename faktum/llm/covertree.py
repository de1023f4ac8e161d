"""Embedding near-dedup by dual traversal of cover trees; it gives exactly the pairs at or over a cosine threshold.

Vectors of one label are compared as points on the unit sphere, where a cosine is a distance. Equal vectors are one point with
a weight. A label's points are split among pivots, level by level, until cells are blocks of at most BLOCK points; the cells of
all levels, with their covering radii, are the upper part of a tree that is traversed by joins. Each block gets a cover tree: the
levels have halving radii, a node's children are a net of half its radius, and its covering radius is the largest distance
from its centre to a point under it. Two trees are traversed together. A pair of nodes is left out when their centres are
farther apart than both covering radii and the threshold allow, and taken whole when they are so near that all their points
must be linked; only pairs of leaves between these bounds are compared point by point, in double precision. A task gives each point's number of links and the few links that
connect its points, so a group of any size costs no list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faktum.llm.components import connected
from faktum.llm.store import released, saved

#: Least cosine of a link; points in a block and in a leaf; pivots that split a cell, levels of splits, and a cell's points in a task.
COSINE, BLOCK, LEAF, FAN, DEPTH, DEALT = 0.98, 2048, 24, 64, 16, 32768
#: Blocks that one block is compared with in a task, about.
TOGETHER = 8
_SLACK = 1e-7


class Tree:
    """A cover tree over rows of unit vectors."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.centre, self.radius, self.kids, self.points = x, [], [], [], []
        self._grow(np.arange(len(x)), 2.0)

    def _grow(self, points: np.ndarray, cover: float) -> None:
        todo = [(points, cover, None)]
        while todo:
            points, cover, parent = todo.pop()
            me = len(self.centre)
            self.centre.append(points[0])
            gap = 2 - 2 * self.x[points] @ self.x[points[0]]
            self.radius.append(float(np.sqrt(max(0.0, gap.max()))))
            self.points.append(points)
            self.kids.append([])
            if parent is not None:
                self.kids[parent].append(me)
            if len(points) <= LEAF or self.radius[me] < 1e-7:
                continue
            left = points
            while len(left):
                near = 2 - 2 * self.x[left] @ self.x[left[0]] <= (cover / 2) ** 2
                near[0] = True
                todo.append((left[near], cover / 2, me))
                left = left[~near]

    def parts(self, node: int) -> list[int]:
        return self.kids[node] or [node]


def traverse(a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked to each point of a and of b, and links that connect what is linked: (i, j), j of b being len(a.x) + j.

    With a and b the same tree, links of a point to itself don't count, and the second array is the first.
    """
    same = a is b
    limit = float(np.sqrt(2 - 2 * cosine))
    na = len(a.x)
    shift = 0 if same else na
    got_a = np.zeros(na)
    got_b = got_a if same else np.zeros(len(b.x))
    group = np.arange(na + (0 if same else len(b.x)))
    links: list[tuple[int, int]] = []

    def connect(i: np.ndarray, j: np.ndarray) -> None:
        j = j + shift
        open_ = group[i] != group[j]
        while open_.any():
            i, j = i[open_], j[open_]
            links.append((int(i[0]), int(j[0])))
            group[group == group[j[0]]] = group[i[0]]
            open_ = group[i] != group[j]

    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        if not a.kids[p] and not b.kids[q]:
            i, j = a.points[p], b.points[q]
            hit = a.x[i] @ b.x[j].T >= cosine
            if same and p == q:
                np.fill_diagonal(hit, False)
                got_a[i] += hit @ weight_a[i]
            else:
                got_a[i] += hit @ weight_b[j]
                got_b[j] += weight_a[i] @ hit
            r, c = np.nonzero(hit)
            connect(i[r], j[c])
            continue
        one, two = np.array(a.parts(p)), np.array(b.parts(q))
        r1, r2 = np.array(a.radius)[one] if len(one) < 9 else a.radii[one], np.array(b.radius)[two] if len(two) < 9 else b.radii[two]
        apart = np.sqrt(np.maximum(0, 2 - 2 * a.x[a.centres[one]] @ b.x[b.centres[two]].T))
        reach = r1[:, None] + r2[None, :]
        maybe = apart <= reach + limit + _SLACK
        whole = apart + reach <= limit - 1e-6
        if same and p == q:
            maybe &= one[:, None] <= two[None, :]
            whole &= one[:, None] < two[None, :]
        for s, t in zip(*np.nonzero(maybe & whole), strict=True):
            i, j = a.points[one[s]], b.points[two[t]]
            got_a[i] += weight_b[j].sum()
            got_b[j] += weight_a[i].sum()
            connect(i, np.full(len(i), j[0]))
            connect(np.full(len(j), i[0]), j)
        todo += [(int(one[s]), int(two[t])) for s, t in zip(*np.nonzero(maybe & ~whole), strict=True)]
    return got_a, got_b, links


def grown(x: np.ndarray) -> Tree:
    t = Tree(x)
    t.centres, t.radii = np.array(t.centre), np.array(t.radius)
    return t


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares can't overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a column of arrays of one length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Some points of a cell, each with the nearest pivot as its new cell and the distance; without pivots all stay."""
    parent = rows.column("cell")
    cell, gap = parent, pa.nulls(len(rows), pa.float64())
    if len(pivots) and len(rows):
        centre, near, best = _vectors(pivots.column("embedding")), [], []
        x = _vectors(rows.column("embedding"))
        for i in range(0, len(x), BLOCK):
            cosine = x[i : i + BLOCK] @ centre.T
            at = cosine.argmax(1)
            near.append(at)
            best.append(cosine[np.arange(len(at)), at])
        cell = pa.array(pivots.column("id").to_numpy()[np.concatenate(near)], pa.int64())
        gap = pa.array(np.sqrt(np.maximum(0.0, 2 - 2 * np.concatenate(best))))
    kept = [rows.column(c) for c in ("dim", "cid", "weight", "embedding")]
    return pa.table([cell, parent, gap, *kept], ["cell", "parent", "gap", "dim", "cid", "weight", "embedding"])


_MOVED = "cell long, parent long, gap double, dim int, cid long, weight long, embedding array<double>"


def _length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def _levels(points: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their cells, and the upper levels of the labels' trees: parent, id, centre and covering radius of each node.

    A label is one cell at first. While a cell has more than BLOCK points, it is split among at most FAN pivots of its own;
    points go to the nearest one. A large cell's points are dealt to many tasks. Pivots are for speed: any cells give the same links.
    """
    now = saved(points.select(F.xxhash64("label", "dim").alias("cell"), "dim", "cid", "weight", F.col("embedding").cast("array<double>").alias("embedding")), "cells")
    levels: list[DataFrame] = []
    for level in range(DEPTH):
        sizes = now.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
        large = saved(sizes.select("cell", "n", F.least(2 * F.ceil(F.col("n") / BLOCK), F.lit(FAN)).alias("pivots"), F.ceil(F.col("n") / DEALT).alias("salts")), "large")
        if large.isEmpty():
            break
        big = now.join(large, "cell")
        # a hash bound lets through about twice the wanted pivots of a cell, before they are ranked
        order = F.xxhash64("cid", F.lit(level))
        some = big.filter(F.pmod(order, F.lit(1 << 40)) < 2 * F.col("pivots") / F.col("n") * (1 << 40))
        rank = F.row_number().over(Window.partitionBy("cell").orderBy(order, "cid"))
        chosen = saved(some.withColumn("rank", rank).filter("rank <= pivots").select("cell", "salts", F.xxhash64("cell", "rank", F.lit(level)).alias("id"), "embedding"), "pivots")
        sent = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        dealt = big.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")))
        moved = saved(dealt.groupBy("cell", "salt").cogroup(sent.groupBy("cell", "salt")).applyInArrow(_nearest, _MOVED), "moved")
        largest = F.array_max(F.transform("embedding", F.abs))
        scaled = chosen.select("id", F.transform("embedding", lambda x: x / largest).alias("v"))
        centre = scaled.select("id", F.transform("v", lambda x: x / _length(F.col("v"))).alias("centre"))
        radius = moved.filter("cell <> parent").groupBy("parent", F.col("cell").alias("id")).agg(F.max("gap").alias("radius"))
        levels.append(saved(radius.join(centre, "id").select("parent", "id", "centre", "radius"), "nodes"))
        before = now
        now = saved(before.join(large, "cell", "left_anti").unionByName(moved.drop("parent", "gap")), "cells")
        released(before, large, chosen, moved)
    return now, levels


def _pairs(roots: DataFrame, levels: list[DataFrame], cosine: float) -> DataFrame:
    """one and two: cells whose points may be linked, each pair once and each cell with itself, by traversal of the upper levels.

    A pair's children are paired if their centres are no farther apart than both covering radii and the threshold allow; a
    cell without children stands for itself. A node has FAN children at most.
    """
    limit = float(np.sqrt(2 - 2 * cosine))
    none = F.lit(None)
    sides = [c for s in "ab" for c in (none.cast("array<double>").alias(f"centre_{s}"), none.cast("double").alias(f"radius_{s}"))]
    pairs = roots.select(F.col("cell").alias("one"), F.col("cell").alias("two"), *sides)
    for nodes in levels:
        a, b = (nodes.select(F.col("parent").alias(f"p{s}"), F.col("id").alias(f"i{s}"), F.col("centre").alias(f"c{s}"), F.col("radius").alias(f"r{s}")) for s in "ab")
        both = pairs.join(a, F.col("one") == F.col("pa"), "left").join(b, F.col("two") == F.col("pb"), "left")
        kids = [F.coalesce("ia", "one").alias("one"), F.coalesce("ib", "two").alias("two"), (F.col("one") == F.col("two")).alias("same")]
        kids += [F.coalesce(f"{x[0]}{s}", f"{x}_{s}").alias(f"{x}_{s}") for s in "ab" for x in ("centre", "radius")]
        apart = _length(F.zip_with("centre_a", "centre_b", lambda x, y: x - y))
        near = (F.col("one") == F.col("two")) | F.coalesce(apart <= F.col("radius_a") + F.col("radius_b") + limit + _SLACK, F.lit(True))
        before, pairs = pairs, saved(both.select(kids).filter((~F.col("same") | (F.col("one") <= F.col("two"))) & near).drop("same"), "pairs")
        released(before)
    return pairs.select("one", "two")


def _compared(others: pa.Table, own: pa.Table, cosine: float) -> pa.Table:
    """cid, links and other of a block against others: a class's linked weight (other null), or a link that connects (links 0)."""
    def read(row):
        return np.frombuffer(row["cids"], np.int64), np.frombuffer(row["weights"], np.int64).astype(float), grown(np.frombuffer(row["points"]).reshape(-1, row["dim"]))

    out = []
    ca, wa, a = read(own.slice(0, 1).to_pylist()[0])  # its tree is built once for all others
    for i in range(len(others)):
        row = others.slice(i, 1).to_pylist()[0]
        if row["one"] == row["two"]:
            got, _, links = traverse(a, a, wa, wa, cosine)
            cids = ca
        else:
            cb, wb, b = read(row)
            got_a, got_b, links = traverse(a, b, wa, wb, cosine)
            cids, got = np.concatenate((ca, cb)), np.concatenate((got_a, got_b))
        at = np.flatnonzero(got)
        ends = np.array([(cids[i], cids[j]) for i, j in links], np.int64).reshape(-1, 2)
        out.append(pa.table({"cid": np.concatenate((cids[at], ends[:, 0])), "links": np.concatenate((got[at].astype(np.int64), np.zeros(len(ends), np.int64))), "other": pa.array([None] * len(at) + ends[:, 1].tolist(), pa.int64())}))
    return pa.concat_tables(out)


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: key, n_links (other rows linked directly), component_id, kept.

    A row whose vector or label is null, or whose vector is empty, zero or has null or non-finite numbers, links with nothing
    and is kept. Vectors of different lengths don't link. Equal vectors of a label link, repeated rows too. An empty table
    gives no rows; other columns aren't read.
    """
    v = F.col(embedding)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), v.alias("embedding"), (F.col(label).isNotNull() & _usable(v)).alias("fine"))
    cid = F.xxhash64("label", "embedding")
    points = rows.filter("fine").groupBy("label", F.size("embedding").alias("dim"), cid.alias("cid"), "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"))
    points = saved(points.select("label", "dim", "cid", "weight", "embedding", "least"), "points")
    celled, levels = _levels(points)
    pairs = _pairs(points.select(F.xxhash64("label", "dim").alias("cell")).distinct(), levels, cosine)
    # what still is larger than a block, because no pivots divide it, is dealt by hash, and all of its chunks are compared
    chunks = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    whose = saved(chunks.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")), "chunks")
    placed = celled.join(chunks, "cell").withColumn("chunk", F.when(F.col("chunks") == 1, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("cid"), "chunks")))

    def block(t: pa.Table) -> pa.Table:
        x, cids, weights = _vectors(t.column("embedding")), t.column("cid").to_numpy(), t.column("weight").to_numpy()
        order = np.argsort(cids)
        return pa.table({"cell": t.column("cell").slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "dim": t.column("dim").slice(0, 1), "cids": [cids[order].tobytes()], "weights": [weights[order].tobytes()], "points": [x[order].tobytes()]})

    made = placed.select("cell", "chunk", "dim", "cid", "weight", "embedding").groupBy("cell", "chunk").applyInArrow(block, "cell long, chunk long, dim int, cids binary, weights binary, points binary")
    blocks = saved(made.withColumn("block", F.xxhash64("cell", "chunk")).drop("cell", "chunk"), "blocks")
    left, right = (whose.select(F.col("cell").alias(cell), F.col("chunk").alias(chunk)) for cell, chunk in (("one", "c1"), ("two", "c2")))
    both = pairs.join(left, "one").join(right, "two").filter((F.col("one") != F.col("two")) | (F.col("c1") <= F.col("c2"))).select(F.xxhash64("one", "c1").alias("one"), F.xxhash64("two", "c2").alias("two"))
    many = both.groupBy("one").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("slices"))
    both = saved(both.join(many, "one").select("one", "two", F.pmod(F.xxhash64("two"), "slices").alias("slice")), "pairs")
    others = both.join(blocks.withColumnRenamed("block", "two"), "two").select("one", "slice", "two", "dim", "cids", "weights", "points")
    own = both.select("one", "slice").distinct().join(blocks.withColumnRenamed("block", "one"), "one").select("one", "slice", "dim", "cids", "weights", "points").toDF("own_one", "own_slice", "dim", "cids", "weights", "points")
    found = saved(others.groupBy("one", "slice").cogroup(own.groupBy("own_one", "own_slice")).applyInArrow(lambda t, a: _compared(t, a, cosine), "cid long, links long, other long"), "found")
    released(celled, *levels, blocks, both, whose)
    roots = connected(found.filter("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = points.select("label", "cid", "weight", "least").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = saved(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = known.join(least, "root").select(F.col("cid"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.withColumn("cid", F.when(F.col("fine"), cid)).join(answer, "cid", "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""
