"""Evidence rules, verification, text functions and source reading."""

import os

from pyspark.sql import functions as F

from faktum.functions import text as X
from faktum.operators import evidence as E
from faktum.operators import lookup as L
from faktum.operators import resolve as R
from faktum.operators import verify as V
from faktum.sources import files as S
from faktum.streaming import windows as W


def test_rules(spark):
    """M7: one scenario for each way of combining."""
    facts = [(1, 1, "sync", "mutex", "lock"), (2, 2, "sync", "mutex", "lock"), (3, 2, "sync", "mutex", "defer_unlock"), (4, 3, "memory", "cstring", "alloc"), (5, 4, "memory", "cstring", "alloc"), (6, 4, "memory", "cstring", "free"), (7, 5, "error", "bare_except", "suppression"), (8, 5, "pattern", "todo", "marker")]
    df = spark.createDataFrame([(*f, "s", 0.9) for f in facts], "id long, function_id long, category string, primitive string, kind string, symbol string, confidence double")
    got = {(x.rule, x.function): (x.facts, x.items, x.confidence) for x in E.evidence(df).collect()}
    assert got[("mutex_without_unlock", None)] == (1, 1, 0.9) and got[("cstring_leak", 3)] == (1, 1, 0.9) and ("cstring_leak", 4) not in got
    assert got[("todo_accumulation", None)] == (1, 0, 1.0) and got[("bare_except_collect", None)][0] == 1


def test_classified(spark):
    rows = [(9, "mu.Lock", "go"), (9, "mu.RLock", "go"), (9, "C.CString", "go"), (14, "TODO FIXME x", "go"), (9, "x.unwrap", "rust"), (11, "github.com/gin-gonic/gin", "go"), (9, "plain", "go")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "kind int, name string, language string, qualified_name string")
    got = {(x.name, x.primitive, x.fact) for x in E.classified(df).collect()}
    assert got == {("mu.Lock", "mutex", "lock"), ("mu.RLock", "rwmutex", "lock"), ("C.CString", "cstring", "alloc"), ("TODO FIXME x", "todo", "marker"), ("x.unwrap", "unwrap", "risk"), ("github.com/gin-gonic/gin", "gin", "router")}


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(X.identifier_words(F.lit("parseHTTPRequest_fast-path"))) == ["parse", "http", "request", "fast", "path"]
    assert one(X.canonical_type(F.lit("*pkg.Type"))) == "Type" and one(X.canonical_type(F.lit("a + b"))) == ""
    assert one(X.relative_path(F.lit("src/a/b.ts"), F.lit("../c/d"))) == "src/c/d"
    assert one(X.module_of(F.lit("plain.go"))) == "" and one(X.token_estimate(F.lit("abcdé"))) == 2
    assert one(X.filled(F.lit("{count} in {file} {other}"), count=F.lit("3"), file=F.lit("f"))) == "3 in f {other}"
    assert one(X.pascal(F.lit("fast full-text search"))) == "FastFullTextSearch"


def test_claims_and_verdicts(spark):
    texts = spark.createDataFrame([(1, "It supports fast search. It is not thread-safe.")], "id int, text string")
    assert [(x.predicate, x.subject) for x in V.claims(texts).collect()] == [("supported_by", "FastSearch")]
    t = V.trust(spark.createDataFrame([("Supported",), ("Supported",), ("Contradicted",), ("Unknown",)], "verdict string")).first()
    assert (t.supported, t.contradicted, t.unknown, t.trust, t.integrity) == (2, 1, 1, 0.666667, 0.8)


def test_enclosing_takes_the_innermost(spark):
    """J9."""
    e = spark.createDataFrame([(1, 0, "/f", 0, 100), (2, 0, "/f", 10, 20), (3, 2, "/f", 12, 13)], "id long, kind int, file_path string, start_row int, end_row int")
    got = {x.rid: x.function_id for x in L.enclosing(spark.createDataFrame([(7, "/f", 15), (8, "/f", 50), (9, "/g", 1)], "rid long, file_path string, row int"), e).collect()}
    assert got == {7: 2, 8: 1}


def test_python_sources_to_calls(spark, tmp_path):
    """S1-S9 to R11: files, records, entities, references, resolved calls; a broken file fails alone."""
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("def helper(x):\n    return x\n\nclass K:\n    def go(self):\n        return helper(1)\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "node_modules" / "x.py").write_text("y = 1\n")
    (tmp_path / "pkg" / "gen.py").write_text("z = 1\n")
    found = S.discover(spark, str(tmp_path), ("gen.py",))
    assert sorted(x.path for x in found.collect()) == ["pkg/a.py", "pkg/bad.py"]
    records, failures = S.parse_python(found)
    assert [os.path.basename(x.file_path) for x in failures.collect()] == ["bad.py"]
    e = S.entities(records)
    assert sorted((x.name, x.kind) for x in e.collect()) == [("K", 2), ("go", 1), ("helper", 0)]
    imports = spark.createDataFrame([], "file_path string, module string")
    got = R.resolved(R.scored(R.candidates(S.call_sites(records, e), e, imports)))
    names = e.select("id", "name")
    assert [tuple(x) for x in got.join(names, "id").select("name", "resolution").collect()] == [("helper", "exact_local")]


def test_manifest_changes_and_carry_over(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "k int, m int")
    b = spark.createDataFrame([(1, 1), (2, 2), (4, 1)], "k int, m int")
    assert {tuple(x) for x in W.changes(a, b, "k", ["m"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert {tuple(x) for x in W.carried(spark.createDataFrame([(1,), (2,)], "k int"), b.filter("k = 1"), a.filter("k = 2"), ["m"], ["k"]).collect()} == {(1, 1), (2, 1)}


def test_windows_on_a_stream_agree_with_the_table(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet("/root/testdata/sf0.001/events.parq*")
    q = W.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM w").collect())) == sorted(map(tuple, W.tumbling(table).collect()))


def test_project_state_counts_all_dead_functions(spark):
    """The orphan report ends at 500; the project's sum doesn't."""
    from faktum.plans import catalog
    from faktum.plans import projection as P

    e, r = (spark.createDataFrame([(i, 0, 0, f"f{i}") for i in range(620)], "id long, kind int, visibility int, name string"), spark.createDataFrame([(0, 1), (2, 700)], "source_id long, target_id long"))
    assert V.dead_functions(e, r).count() == 500
    keep = P.graph
    P.graph = lambda s, d: (e, r)
    try:
        row = catalog.QUERIES["project_state_score"](spark, "/root/testdata/sf0.001").collect()[0]
    finally:
        P.graph = keep
    assert row.dead == 617 and row.dead_share == round(617 / 620, 6)


def test_explained_shows_all_callers_and_callees(spark):
    """J6: over a thousand of each."""
    e = spark.createDataFrame([(0, "Run"), *[(i, f"f{i}") for i in range(1, 2301)]], "id long, name string").selectExpr("id", "name", "name AS qualified_name", "'/f' AS file_path", "0 AS start_row")
    r = spark.createDataFrame([*[(i, 0) for i in range(1, 1101)], *[(0, i) for i in range(1101, 2301)]], "source_id long, target_id long").selectExpr("*", "1 AS type", "1.0 AS confidence")
    got = {x.role: x["count"] for x in L.explained(e, r, "Run").groupBy("role").count().collect()}
    assert got == {"definition": 1, "caller": 1100, "callee": 1200}


def test_explained_shows_all_definitions(spark):
    """J6: over twenty of one name."""
    e = spark.range(25).selectExpr("id", "'Run' AS name", "'q' AS qualified_name", "'/f' AS file_path", "0 AS start_row")
    r = spark.createDataFrame([], "source_id long, target_id long, type int, confidence double")
    assert [x.id for x in L.explained(e, r, "Run").filter("role = 'definition'").orderBy("id").collect()] == list(range(25))


def test_enclosing_against_all_pairs(spark):
    """J9: overlaps, open ends, rows before any function, a row's record repeated; records and functions of a file aren't joined pair by pair."""
    import random

    rnd = random.Random(3)
    functions = [(i, rnd.choice((0, 1, 2)), f"/f{i % 3}", s, rnd.choice((0, s, s + rnd.randrange(40), s + 1000))) for i in range(300) for s in [rnd.randrange(-20, 200)]]
    records = [(i // 2, f"/f{rnd.randrange(4)}", rnd.randrange(-40, 1300)) for i in range(900)]
    want: dict[int, tuple] = {}
    for rid, path, row in records:
        for i, kind, file, s, t in functions:
            if kind < 2 and file == path and s <= row and (t >= row or t == 0):
                want[rid] = max(want.get(rid, (s, -i)), (s, -i))
    found = L.enclosing(spark.createDataFrame(records, "rid long, file_path string, row int"), spark.createDataFrame(functions, "id long, kind int, file_path string, start_row int, end_row int"))
    assert {x.rid: x.function_id for x in found.collect()} == {k: -v[1] for k, v in want.items()}


def test_enclosing_looks_up_blocks_not_pairs(spark):
    """J9: 3,000 functions of one place and 3,000 records in it take thousands of joined rows, not nine millions."""
    import re

    e = spark.range(3000).selectExpr("id", "0 AS kind", "'/f' AS file_path", "10 AS start_row", "19 AS end_row")
    out = L.enclosing(spark.range(3000).selectExpr("id AS rid", "'/f' AS file_path", "CAST(10 + id % 10 AS INT) AS row"), e)
    assert {(x.function_id) for x in out.collect()} == {0} and out.count() == 3000
    keys = re.findall(r"Join Inner, (.*)", out._jdf.queryExecution().analyzed().toString())
    assert keys and all("row" in k or "block" in k for k in keys)


def test_bm25_scores_each_row_alone(spark):
    """T2: no hash table or sort of all words; a name without words counts among the documents, as in the SQL."""
    from math import log

    from faktum.operators import search as T

    rows = [(1, "main", "", "", 0), (2, "mainLib", "", "", 2), (3, "x", "a.b", "", 0), (4, "_", "", "", 0)]
    e = spark.createDataFrame(rows, "id long, name string, qualified_name string, file_path string, kind int")
    out = T.bm25(e, "main lib main")
    want = lambda tf_df, length: round(sum(log((4 - d + 0.5) / (d + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / 1.5)) for d in tf_df), 6)
    assert [(x.id, x.score) for x in out.collect()] == [(2, want((2, 1), 2)), (1, want((2,), 1))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan and "Join Inner, (id" not in plan


def test_claims_read_each_sentence_once(spark):
    """One pass over the texts, with every kind of claim in one sentence or in several, in any case of letters."""
    rows = [(1, "It SUPPORTS fast search, Implements a cache and hasn't much. Parser should REJECT bad input! Zero-Copy and LOCK free.\nA -> B -> C"), (2, "The phase has changed.\tIt never supports magic. Supports it"), (3, None), (4, "support"), (5, "It contains an index. It contains an index.")]
    out = V.claims(spark.createDataFrame(rows, "id int, text string"))
    assert {tuple(x) for x in out.collect()} == {
        (1, "supported_by", "FastSearch", ""), (1, "implemented_by", "ACache", ""), (1, "should", "Parser", "REJECT bad input"), (1, "contract", "zerocopy", ""), (1, "contract", "lockfree", ""), (1, "follows", "A", "B>C"),
        (2, "has", "Changed", ""), (2, "supported_by", "It", ""), (5, "has", "Index", ""),
    }
    assert out.count() == 9
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
