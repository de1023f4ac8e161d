"""A small pattern language over the graph: MATCH (Type[:name])-[Edge[*min..max]]->(Type[:name]) [LIMIT n] [RETURN ...]."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.functions.lineage import cut
from faktum.schema import CALLABLE, EDGE_TYPE, NODE_KIND

# What the language names, and the bounds of a walk and of a result.
NODES = ("Function", "Method", "Class", "Struct", "Interface", "Variable", "Module", "File")
EDGES = ("References", "Calls", "Defines", "Contains", "Imports", "Inherits")
MOST_HOPS, MOST_ROWS = 8, 10_000


class PatternError(ValueError):
    """A pattern that can't be read; the message says what is wrong with it."""


@dataclass(frozen=True)
class End:
    kind: str
    name: str | None

    def of(self, entity: DataFrame) -> DataFrame:
        kinds = CALLABLE if self.kind == "Function" else (NODE_KIND[self.kind],)
        out = entity.filter(F.col("kind").isin(*kinds))
        return out.filter(F.col("name") == self.name) if self.name else out


@dataclass(frozen=True)
class Pattern:
    source: End
    edge: str
    target: End
    least: int
    most: int
    limit: int


_TOKEN = re.compile(r"\s*(MATCH\b|LIMIT\b|RETURN\b|->|[()\[\]:*-]|\.\.|[^\s()\[\]:*.-][^\s()\[\]:*]*|\.)", re.IGNORECASE)


def parse(text: str) -> Pattern:
    tokens = [m[1] for m in _TOKEN.finditer(text)]
    at = 0

    def take(want: str | None = None, what: str = "") -> str:
        nonlocal at
        got = tokens[at] if at < len(tokens) else ""
        if want is not None and got.upper() != want:
            raise PatternError(f"expected {what or want!r}, found {got or 'the end'!r}")
        at += 1
        return got

    def end() -> End:
        nonlocal at
        take("(", "opening parenthesis")
        kind = take()
        if kind not in NODES:
            raise PatternError(f"unknown node type {kind!r}")
        name = None
        if at < len(tokens) and tokens[at] == ":":
            take()
            held = []
            while at < len(tokens) and tokens[at] not in (")", "]"):
                held.append(take())
            name = "".join(held)
        take(")", "closing parenthesis")
        return End(kind, name)

    take("MATCH")
    source = end()
    take("-")
    take("[")
    edge = take()
    if edge not in EDGES:
        raise PatternError(f"unknown edge type {edge!r}")
    span = ""
    while at < len(tokens) and tokens[at] != "]":
        span += take()
    take("]")
    take("->")
    target = end()
    least, most = hops(span)
    limit = None
    while at < len(tokens):
        word = take().upper()
        if word == "LIMIT":
            if limit is not None:
                raise PatternError("LIMIT is given twice")
            n = take()
            if not n.isdigit() or int(n) < 1:
                raise PatternError("LIMIT must be at least 1")
            limit = int(n)
        elif word == "RETURN":
            while at < len(tokens) and tokens[at].upper() != "LIMIT":
                take()
        else:
            raise PatternError(f"text after the pattern: {word!r}")
    return Pattern(source, edge, target, least, most, min(limit or MOST_ROWS, MOST_ROWS))


def hops(span: str) -> tuple[int, int]:
    """Least and most steps: '' and '*' or '*n' are 1 and 1, '2..' is 2 and 2, '..3' is 1 and 3."""
    m = re.fullmatch(r"\*(\d*)\.\.(\d*)", span)
    if not m:
        if span and not re.fullmatch(r"\*\d*", span):
            raise PatternError(f"can't read the steps {span!r}")
        return 1, 1
    least = int(m[1] or 1)
    most = int(m[2]) if m[2] else least
    if least < 1 or most < least:
        raise PatternError(f"can't read the steps {span!r}")
    return least, min(most, MOST_HOPS)


def match(entity: DataFrame, relation: DataFrame, pattern: Pattern | str) -> DataFrame:
    """(source_id, target_id, hops): the ends that walks of the pattern connect; a walk ends at the first target it meets.

    Each level keeps one row for a source and the node its walks have come to, so walks aren't listed one by one.
    """
    p = parse(pattern) if isinstance(pattern, str) else pattern
    edges = relation.filter(F.col("type") == EDGE_TYPE[p.edge]).select("source_id", "target_id").distinct()
    sources = p.source.of(entity).select(F.col("id").alias("source_id"))
    targets = p.target.of(entity).select(F.col("id").alias("target_id"))
    if p.most == 1:
        out = edges.join(sources, "source_id", "left_semi").join(targets, "target_id", "left_semi").withColumn("hops", F.lit(1))
        return out.select("source_id", "target_id", "hops").orderBy("source_id", "target_id", "hops").limit(p.limit)
    edges = cut(edges)  # every step reads them
    level = sources.select("source_id", F.col("source_id").alias("node"))
    out = None
    for d in range(1, p.most + 1):
        level = cut(level.join(edges.select(F.col("source_id").alias("node"), "target_id"), "node").select("source_id", F.col("target_id").alias("node")).distinct())
        if d >= p.least:
            hit = level.join(targets.select(F.col("target_id").alias("node")), "node", "left_semi").select("source_id", F.col("node").alias("target_id"), F.lit(d).alias("hops"))
            out = hit if out is None else out.unionByName(hit)
            level = level.join(targets.select(F.col("target_id").alias("node")), "node", "left_anti")
    return out.orderBy("source_id", "target_id", "hops").limit(p.limit)


def hints(entity: DataFrame, end: End) -> DataFrame:
    """Of an end that matches nothing: the kinds under which its name does occur."""
    if end.name is None:
        return entity.sparkSession.createDataFrame([], "kind int, n long")
    return entity.filter(F.col("name") == end.name).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
