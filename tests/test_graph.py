"""Traversals, communities, components and patterns on small graphs."""

import pytest

from faktum.operators import graph as G
from faktum.operators import pattern as D


def rel(spark, pairs, kind=1):
    rows = [(a, b, kind, 1.0) for a, b in pairs]
    return spark.createDataFrame(rows, "source_id long, target_id long, type int, confidence double")


def ents(spark, ids, kind=0):
    return spark.createDataFrame([(i, kind, f"n{i}", f"q.n{i}", f"/a/f{i}.go", "/a/", "go", 0, 9, 0, 1, 0, 1, 0) for i in ids], "id long, kind int, name string, qualified_name string, file_path string, module_path string, language string, start_row int, end_row int, visibility int, cyclomatic int, nesting_depth int, cognitive int, arity int")


@pytest.mark.parametrize(("target", "want"), [(1, [1]), (2, [1, 2]), (4, [1, 2, 3, 4]), (13, []), (99, [])])
def test_shortest_path(spark, target, want):
    """G3: hops 0 for itself, none beyond ten steps or when not connected."""
    r = rel(spark, [(i, i + 1) for i in range(1, 13)])
    assert [x.id for x in G.shortest_path(r, 1, target).orderBy("step").collect()] == want


def test_impact(spark):
    """G9: three steps at most, seeds left out, both ways."""
    e, r = ents(spark, range(1, 10)), rel(spark, [(i, i + 1) for i in range(1, 9)])
    files = spark.createDataFrame([("/a/f5.go",)], "file_path string")
    got = {(x.direction, x.id, x.depth) for x in G.impact(e, r, files).collect()}
    assert got == {("callees", 6, 1), ("callees", 7, 2), ("callees", 8, 3), ("callers", 4, 1), ("callers", 3, 2), ("callers", 2, 3)}


def test_communities(spark):
    """G10: two triangles with a bridge are two communities; loops and other edges don't count."""
    calls = rel(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (3, 3)]).unionByName(rel(spark, [(8, 9)], 0))
    rows = G.community_summary(ents(spark, range(1, 10)), calls).collect()
    assert sorted(x["size"] for x in rows) == [3, 3]
    assert sum(x["outer"] for x in rows) == 1


def test_components(spark):
    r = rel(spark, [(1, 2), (2, 3), (5, 4), (7, 7), *[(i, i + 1) for i in range(100, 140)]])
    got = {x.id: x.component for x in G.components(r).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 4 and 7 not in got and got[140] == 100
    assert tuple(G.component_stats(r).first()) == (3, 41)


@pytest.mark.parametrize("bad", ["MATCH (Thing)-[Calls]->(Method)", "MATCH (Function-[Calls]->(Method)", "MATCH (Function)-[Eats]->(Method)", "MATCH (Function)-[Calls]->(Method) LIMIT 0", "MATCH (Function)-[Calls]->(Method) LIMIT 1 LIMIT 2", "MATCH (Function)-[Calls]->(Method) and more"])
def test_pattern_errors(bad):
    with pytest.raises(D.PatternError):
        D.parse(bad)


@pytest.mark.parametrize(("span", "want"), [("", (1, 1)), ("*", (1, 1)), ("*3", (1, 1)), ("*2..", (2, 2)), ("*..3", (1, 3)), ("*1..9", (1, 8))])
def test_hops(span, want):
    """D6."""
    assert D.hops(span) == want


def test_multi_hop_ends_at_the_first_target(spark):
    """D3, Q3: walks follow the edge that the pattern names and end at a target."""
    e = ents(spark, [1, 2, 5]).unionByName(ents(spark, [3, 4], 1))
    got = {(x.source_id, x.target_id, x.hops) for x in D.match(e, rel(spark, [(1, 2), (2, 3), (3, 4)]), "MATCH (Function:n1)-[Calls*1..3]->(Method) RETURN x").collect()}
    assert got == {(1, 3, 2)}
    assert [x.kind for x in D.hints(e, D.End("Method", "n1")).collect()] == [0]


def test_communities_query_runs_to_its_end(spark):
    """The registered query against propagation in plain Python, until nothing moves or twenty rounds."""
    from collections import Counter

    from faktum.plans import catalog
    from faktum.plans import projection as P

    e, r = P.graph(spark, "/root/testdata/sf0.001")
    ids = {x.id for x in e.select("id").collect()}
    near: dict[int, set] = {}
    for a, b in {(x.source_id, x.target_id) for x in r.filter("type = 1 AND source_id <> target_id").collect()}:
        if a in ids and b in ids:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, history = {i: i for i in near}, []
    for _ in range(G.ROUNDS):
        history.append(want)
        votes = {i: Counter(want[j] for j in near[i]) for i in near}
        want = {i: max(v, key=lambda x: (v[x], x == want[i], -x)) for i, v in votes.items()}  # noqa: B023
        if want == history[-1]:
            break
    assert len(history) > 5
    assert {x.id: x.label for x in catalog.QUERIES["communities"](spark, "/root/testdata/sf0.001").collect()} == want


def test_names_that_are_not_matched_loosely(spark):
    from faktum.operators import resolve

    entity = spark.createDataFrame([(1, "error"), (2, "Closed"), (3, "parse")], "id long, name string")
    got = resolve.fuzzy(spark.createDataFrame([("Error",), ("Close",), ("PARSE",)], "name string"), entity).collect()
    assert [(r.name, r.ids) for r in got] == [("PARSE", "3")]
    assert len(set(resolve.COMMON)) == 48 and len(set(resolve.NOT_FUZZY)) == 20


def test_a_round_of_communities_sends_edges_once(spark, monkeypatch):
    """G10: one join and one shuffle for the votes a round; labels of a graph with a hub, ties and loops as in plain Python."""
    import random
    from collections import Counter

    rnd = random.Random(5)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(110)} | {(0, i) for i in range(30)}
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = {x.id: x.label for x in G.communities(ents(spark, range(55)), rel(spark, pairs)).collect()}
    near: dict[int, set] = {}
    for a, b in pairs:
        if a != b and max(a, b) < 55:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {i: i for i in near}
    for _ in range(G.ROUNDS):
        votes = {i: Counter(want[j] for j in near[i]) for i in near}
        want = {i: max(v, key=lambda x: (v[x], x == want[i], -x)) for i, v in votes.items()}  # noqa: B023
    assert got == want
    assert plans[2:] and all(p.count("Join ") == 1 for p in plans[2:])
