"""All queries of the library by name, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktum.functions import text as X
from faktum.operators import graph as G
from faktum.operators import lookup as L
from faktum.operators import pattern as D
from faktum.operators import rollup as A
from faktum.operators import search as T
from faktum.plans import projection as P
from faktum.streaming import windows as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W = P.WITH


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change impact of one file's functions."""
    return QUERIES["impact_depth3"](spark, sf_dir)


def query(name: str, sql: str | None = None, plain: bool = False):
    """Registers a query over (spark, sf_dir) with its SQL, after the frames unless plain."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if plain else f"{W} {sql}"
        return f

    return keep


def over_graph(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda s, d: f(*P.graph(s, d))
    ORACLE_SQL[name] = f"{W} {sql}"


def over_entity(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda s, d: f(P.entity(s, d))
    ORACLE_SQL[name] = f"{W} {sql}"


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _pick(name: str) -> str:
    return f"(SELECT id FROM entity WHERE name = '{name}')"


# lookups
over_entity("find_definition", lambda e: L.find_definition(e, "main").select("id", "name", "file_path"), "SELECT id, name, file_path FROM entity WHERE name = 'main' OR qualified_name = 'main' ORDER BY id LIMIT 20")
over_entity("find_symbol", lambda e: L.by_symbol(e, "main").select("id", "name"), "SELECT id, name FROM entity WHERE name = 'main'")
over_entity("locate_node", lambda e: e.filter("id = 7").select("id", "name", "kind"), "SELECT id, name, kind FROM entity WHERE id = 7")
over_entity("locate_by_name", lambda e: L.by_symbol(e, "ext.Supplier#000000001").select("id", "name"), "SELECT id, name FROM entity WHERE qualified_name = 'ext.Supplier#000000001'")
over_entity("ambiguity_candidates", lambda e: L.candidates(e, "Run").select("id", "name", "kind", "file_path"), "SELECT id, name, kind, file_path FROM entity WHERE name = 'Run' AND (SELECT count(*) FROM entity WHERE name = 'Run') > 1")
over_entity("entry_points", lambda e: L.entry_points(e).select("id", "name", "file_path"), "SELECT id, name, file_path FROM entity WHERE kind IN (0, 1) AND name IN ('main','Main','run','Run','start','Start','init','Init','setup','Setup')")
over_entity("language_entry_points", lambda e: e.filter(L.is_language_entry()).select("id", "language"), "SELECT id, language FROM entity WHERE (language IN ('c','cpp','c++','go','rust') AND name = 'main') OR (language = 'go' AND name = 'init')")
over_entity("complexity", lambda e: e.filter("id = 11").select("id", "cyclomatic", "cognitive", "nesting_depth", (F.col("cyclomatic") > 0).alias("available")), "SELECT id, cyclomatic, cognitive, nesting_depth, cyclomatic > 0 AS available FROM entity WHERE id = 11")
over_entity("test_files", lambda e: e.filter(~X.is_test_path(F.col("file_path"))).groupBy("language").agg(F.count(F.lit(1)).alias("n")), "SELECT language, count(*) AS n FROM entity WHERE NOT (file_path ILIKE '%\\_test.%' ESCAPE '\\' OR file_path ILIKE '%/tests/%' OR file_path ILIKE '%\\_spec.%' ESCAPE '\\' OR file_path ILIKE '%/benches/%') GROUP BY language")
over_entity("module_path_projection", lambda e: e.select("id", X.module_of(F.col("file_path")).alias("module")), "SELECT id, regexp_extract(file_path, '^(.*/)', 1) AS module FROM entity")
over_entity("ffi_named", lambda e: L.ffi_named(e.withColumn("name", F.concat(F.when(F.col("id") % 50 == 0, "ffi_").otherwise(""), F.col("name")))).select("id", "name"), "SELECT id, concat('ffi_', name) AS name FROM entity WHERE id % 50 = 0 ORDER BY id LIMIT 30")
_near = lambda here, there: f"SELECT e.id, e.name, e.file_path, e.start_row, x.confidence FROM (SELECT {there} AS id, arg_min(confidence, {here}) AS confidence FROM relation WHERE type = 1 AND {here} IN {_pick('main')} GROUP BY {there}) x JOIN entity e USING (id) ORDER BY e.id LIMIT 1000"
over_graph("find_callers", lambda e, r: L.callers(e, r, "main"), _near("target_id", "source_id"))
over_graph("find_callees", lambda e, r: L.callees(e, r, "main"), _near("source_id", "target_id"))
over_graph("callers_by_entity", lambda e, r: L.neighbours_of(e, r, e.filter("id = 7"), True), _near("target_id", "source_id").replace(_pick("main"), "(7)"))
over_graph("references_semi", lambda e, r: L.references(e, r, "main").select("id", "name"), f"SELECT id, name FROM entity WHERE id IN (SELECT source_id FROM relation WHERE type IN (1, 3) AND target_id IN {_pick('main')}) ORDER BY id LIMIT 100")
over_graph("neighbors_out_in", lambda e, r: L.edges_around(e, r, 7), "SELECT 'out' AS direction, target_id AS other, type, confidence, name, kind FROM relation JOIN entity ON id = target_id WHERE source_id = 7 UNION ALL SELECT 'in', source_id, type, confidence, name, kind FROM relation JOIN entity ON id = source_id WHERE target_id = 7")
over_graph("explain_symbol", lambda e, r: L.explained(e, r, "Run"), f"SELECT 'definition' AS role, id, name, file_path FROM entity WHERE name = 'Run' UNION ALL SELECT 'caller', id, name, file_path FROM entity WHERE id IN (SELECT source_id FROM relation WHERE type = 1 AND target_id IN {_pick('Run')}) UNION ALL SELECT 'callee', id, name, file_path FROM entity WHERE id IN (SELECT target_id FROM relation WHERE type = 1 AND source_id IN {_pick('Run')})")
over_graph("edges_with_ends", lambda e, r: L.with_ends(e, r).select("source_id", "target_id", "source_name", "target_name", "source_kind", "target_kind"), "SELECT source_id, target_id, s.name AS source_name, t.name AS target_name, s.kind AS source_kind, t.kind AS target_kind FROM relation JOIN entity s ON s.id = source_id JOIN entity t ON t.id = target_id")


@query("enclosing_function", f", rec AS ({P.CALL_RECORD}) SELECT rid, arg_max(e.id, (e.start_row, -e.id)) AS function_id FROM rec JOIN entity e ON e.file_path = rec.file_path AND e.kind IN (0, 1) AND e.start_row <= rec.at_row AND (e.end_row >= rec.at_row OR e.end_row = 0) GROUP BY rid")
def _(s, d):
    return L.enclosing(P.call_records(s, d), P.entity(s, d))


over_entity("first_function_of_file", L.first_of_file, "SELECT file_path, arg_min(id, (start_row, id)) AS function_id FROM entity WHERE kind IN (0, 1) GROUP BY file_path")
over_graph("prefix_scope_pairs", lambda e, r: _scope_pairs(e, r), ", scope AS (SELECT DISTINCT module_path AS name FROM entity), m AS (SELECT s.name, e.id FROM scope s JOIN entity e ON starts_with(lower(e.file_path), lower(s.name))) SELECT x.name AS src, y.name AS tgt, count(*) AS calls FROM relation JOIN m x ON x.id = source_id JOIN m y ON y.id = target_id WHERE type = 1 AND x.name <> y.name GROUP BY x.name, y.name")


def _scope_pairs(e: DataFrame, r: DataFrame) -> DataFrame:
    m = L.prefix_members(e.select(F.col("module_path").alias("name")).distinct(), e)
    x = r.filter("type = 1").join(m.select(F.col("id").alias("source_id"), F.col("name").alias("src")), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("name").alias("tgt")), "target_id")
    return x.filter("src <> tgt").groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("calls"))


@query("interface_containment", "SELECT o AS owner, i AS interface FROM (SELECT p_partkey % 50 AS o, p_size AS m FROM part GROUP BY 1, 2) a JOIN (SELECT p_partkey % 997 AS i, p_size AS m FROM part GROUP BY 1, 2) b USING (m) GROUP BY o, i HAVING count(*) = (SELECT count(DISTINCT p_size) FROM part WHERE p_partkey % 997 = i)")
def _(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return L.containing(p.select((F.col("p_partkey") % 50).alias("owner"), F.col("p_size").alias("member")), p.select((F.col("p_partkey") % 997).alias("interface"), F.col("p_size").alias("member")))


over_graph("orphan_functions", lambda e, r: _orphans(e, r), "SELECT id, name FROM entity WHERE kind IN (0, 1) AND visibility <> 1 AND name NOT IN ('main','Main','run','Run','start','Start','init','Init','setup','Setup') AND id NOT IN (SELECT source_id FROM relation UNION SELECT target_id FROM relation) ORDER BY id LIMIT 500")


def _orphans(e: DataFrame, r: DataFrame) -> DataFrame:
    x = e.filter(F.col("kind").isin(0, 1) & (F.col("visibility") != 1) & ~F.col("name").isin(*L.ENTRY_NAMES))
    x = x.join(r.select(F.col("source_id").alias("id")), "id", "left_anti").join(r.select(F.col("target_id").alias("id")), "id", "left_anti")
    return x.select("id", "name").orderBy("id").limit(500)


# roll-ups
over_graph("graph_stats", A.graph_stats, "SELECT (SELECT count(*) FROM entity) AS entities, (SELECT count(DISTINCT file_path) FROM entity) AS files, count(*) AS relations, count(*) FILTER (type = 1) AS calls FROM relation")
over_graph("hotspots", A.hotspots, "SELECT id, name, callers, cyclomatic, cognitive FROM (SELECT target_id AS id, count(*) AS callers FROM relation WHERE type = 1 GROUP BY 1) JOIN entity USING (id) ORDER BY callers DESC, id LIMIT 10")
over_entity("module_map", A.module_map, "SELECT module_path, count(*) AS functions, count(DISTINCT file_path) AS files, sum(cyclomatic)::BIGINT AS cyclomatic, max(cognitive) AS most_cognitive FROM entity WHERE kind IN (0, 1) GROUP BY module_path")
_summary = """, t AS (SELECT module_path AS module, count(*) AS total, count(*) FILTER (visibility = 1) AS pub, bool_or((language IN ('c','cpp','c++','go','rust') AND name = 'main') OR (language = 'go' AND name = 'init')) AS entry FROM entity GROUP BY 1 HAVING count(*) >= 3),
i AS (SELECT module_path AS module, count(DISTINCT source_id) FILTER (source_id <> target_id) AS incoming, count(DISTINCT target_id) AS alive FROM relation JOIN entity ON id = target_id GROUP BY 1),
o AS (SELECT module_path AS module, count(DISTINCT target_id) FILTER (source_id <> target_id) AS outgoing FROM relation JOIN entity ON id = source_id GROUP BY 1),
n AS (SELECT s.module_path AS module, count(*) AS internal FROM relation JOIN entity s ON s.id = source_id JOIN entity t ON t.id = target_id WHERE source_id <> target_id AND s.module_path = t.module_path GROUP BY 1),
summary AS (SELECT module, total, pub, entry, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(internal, 0) AS internal, total - coalesce(alive, 0) AS dead, 1 - (total - coalesce(alive, 0)) / total AS utilization FROM t LEFT JOIN i USING (module) LEFT JOIN o USING (module) LEFT JOIN n USING (module)) """
over_graph("module_summary", A.module_summary, _summary + "SELECT * FROM summary")
over_graph("module_role", lambda e, r: A.module_roles(A.module_summary(e, r)), _summary + """SELECT module, CASE WHEN lower(module) IN ('test','tests') OR module ILIKE '%/test/%' OR module ILIKE '%/tests/%' THEN 'test'
 WHEN pub > 0 AND incoming >= 2 * outgoing AND incoming >= 3 AND utilization >= 0.1 THEN 'api' WHEN entry THEN 'entry' WHEN incoming >= 10 AND outgoing <= incoming AND utilization >= 0.05 AND pub > 0 THEN 'core'
 WHEN outgoing <= 5 AND pub > 0 AND utilization >= 0.05 THEN 'utility' WHEN pub > 0 AND incoming >= 10 THEN 'business' WHEN (incoming = 0 AND outgoing = 0) OR dead = total THEN 'dead' ELSE 'infra' END AS role FROM summary""")
over_graph("module_internal_edges", A.internal_edges, "SELECT s.module_path AS module, count(*) AS internal FROM relation JOIN entity s ON s.id = source_id JOIN entity t ON t.id = target_id WHERE source_id <> target_id AND s.module_path = t.module_path GROUP BY 1")
_medge = "SELECT s.module_path AS src_module, t.module_path AS tgt_module, count(*) AS calls FROM relation JOIN entity s ON s.id = source_id JOIN entity t ON t.id = target_id WHERE type = 1 AND s.file_path <> t.file_path GROUP BY 1, 2"
over_graph("module_edge", A.module_edges, _medge)
over_graph("architecture_state", A.architecture_state, f"SELECT *, 0 AS violations, 1.0::DOUBLE AS compliance FROM ({_medge}) WHERE src_module <> tgt_module ORDER BY calls DESC, src_module, tgt_module LIMIT 10")
over_graph("workflow_state", A.workflow_state, """, f AS (SELECT DISTINCT e.id, e.name FROM relation r JOIN entity s ON s.id = r.source_id AND s.name IN ('main','Run','Init','Serve','Start') JOIN entity e ON e.id = r.target_id AND e.name NOT IN ('main','Run','Init','Serve','Start')),
c AS (SELECT f.id, count(*) AS steps_total, count(DISTINCT r.target_id) FILTER (EXISTS (SELECT 1 FROM relation q WHERE q.type = 1 AND q.target_id = r.target_id AND q.source_id <> r.source_id)) AS steps_done FROM f JOIN relation r ON r.source_id = f.id AND r.type = 1 GROUP BY f.id)
SELECT id, name, coalesce(steps_total, 0) AS steps_total, coalesce(steps_done, 0) AS steps_done, CASE WHEN coalesce(steps_total, 0) = 0 THEN 'Empty' WHEN steps_done >= steps_total THEN 'Done' ELSE 'Partial' END AS state FROM f LEFT JOIN c USING (id) ORDER BY id LIMIT 20""")
over_graph("workflow_steps", A.workflow_steps, """, w AS (SELECT id FROM entity WHERE kind IN (0, 1) AND name IN ('main','Run','Serve','Start','Handle','Process') AND id IN (SELECT source_id FROM relation WHERE type = 1))
SELECT id AS workflow, 0 AS step, id AS entity_id FROM w UNION ALL SELECT * FROM (SELECT w.id, row_number() OVER (PARTITION BY w.id ORDER BY target_id) AS step, target_id FROM w JOIN relation ON source_id = w.id AND type = 1) WHERE step <= 20""")
over_entity("language_histogram", A.language_histogram, "SELECT language, count(*) AS entities, count(DISTINCT file_path) AS files FROM entity GROUP BY language")
over_entity("multi_language_modules", A.multi_language, "SELECT module_path, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(DISTINCT language) AS n FROM entity GROUP BY 1 HAVING count(DISTINCT language) > 1 ORDER BY 1 LIMIT 20")
over_entity("modules_hierarchy", A.modules_hierarchy, "SELECT module_path, sum(n)::BIGINT AS entities, arg_min(language, (-n, language)) AS language, regexp_extract(module_path, '^(.*/)[^/]+/$', 1) AS parent FROM (SELECT module_path, language, count(*) AS n FROM entity GROUP BY 1, 2) GROUP BY 1")
_ready = "(SELECT count(*) FROM entity WHERE kind IN (0, 1)) AS eligible, (SELECT count(*) FROM entity WHERE kind IN (0, 1) AND cyclomatic > 0) AS measured, (SELECT count(*) FROM entity WHERE kind IN (0, 1) AND id IN (SELECT source_id FROM relation WHERE type = 1 UNION SELECT target_id FROM relation WHERE type = 1)) AS connected"
over_graph("readiness_counts", A.readiness, f"SELECT *, round(connected / greatest(eligible, 1), 4) AS ratio FROM (SELECT {_ready})")
over_graph("project_overview", A.overview, f"SELECT (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM entity) AS languages, (SELECT count(DISTINCT module_path) FROM entity) AS modules, (SELECT count(*) FROM entity WHERE kind IN (0, 1) AND name IN ('main','Main','run','Run','start','Start','init','Init','setup','Setup')) AS entry_points, *, round(connected / greatest(eligible, 1), 4) AS ratio FROM (SELECT {_ready})")
over_graph("type_info_refcount", lambda e, r: A.type_info(e.filter("kind IN (2, 4)").select("id", "name"), L.with_ends(e, r, ("name",)).select(F.col("target_name").alias("name"))), "SELECT e.id, e.name, coalesce(c, 0) AS ref_count FROM entity e LEFT JOIN (SELECT t.name, count(*) AS c FROM relation JOIN entity s ON s.id = source_id JOIN entity t ON t.id = target_id GROUP BY 1) x ON x.name = e.name WHERE kind IN (2, 4) ORDER BY ref_count DESC, id LIMIT 100")
over_entity("graph_page_nodes", lambda e: A.page(e.select("id", "name", "kind"), ["id"], 100, 50), "SELECT id, name, kind FROM entity ORDER BY id LIMIT 100 OFFSET 50")
over_graph("graph_page_edges", lambda e, r: A.page(r.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], 200, 100), "SELECT source_id, target_id, type FROM relation ORDER BY 1, 2, 3 LIMIT 200 OFFSET 100")


@query("relation_dedup", "SELECT min(l_orderkey * 100 + l_linenumber) AS id, l_partkey AS source_id, l_suppkey AS target_id, 1 AS type FROM lineitem GROUP BY 2, 3", plain=True)
def _(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.lit(1).alias("type"))
    return A.unique_relations(li)


@query("parse_failure_upsert", "SELECT concat('f', (user_id % 40)::VARCHAR) AS file_path, count(*) AS fail_count, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_type, (ts, event_type)) AS last_error FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1", plain=True)
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").filter("event_type IN ('error', 'signup')")
    return A.failures(e.select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("file_path"), F.col("ts").alias("at"), F.col("event_type").alias("error")))


# graph
_reach = lambda seeds, edges, depth: f", r AS (SELECT id, 0 AS depth FROM ({seeds}) UNION SELECT b, depth + 1 FROM r JOIN {edges} ON a = r.id WHERE depth < {depth}), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"
_BOTH = "(SELECT a, b FROM calls UNION SELECT b, a FROM calls)"
over_graph("shortest_path_distance", lambda e, r: G.distances(r, 7), _reach("SELECT 7::BIGINT AS id", "calls", 10) + " SELECT id, depth AS hops FROM m")
over_graph("subgraph_radius2", lambda e, r: G.subgraph(e, r, 7, 2), _reach("SELECT 7::BIGINT AS id", _BOTH, 2) + " SELECT id, name, kind, depth AS hops FROM m JOIN entity USING (id)")
_SEEDS = "SELECT id FROM entity WHERE kind IN (0, 1) AND file_path IN (SELECT file_path FROM entity WHERE id < 3)"
over_graph("impact_depth3", lambda e, r: G.impact(e, r, e.filter("id < 3").select("file_path")), f", r AS (SELECT 'callers' AS direction, id, 0 AS depth FROM ({_SEEDS}) UNION SELECT 'callees', id, 0 FROM ({_SEEDS}) UNION SELECT r.direction, CASE direction WHEN 'callers' THEN a ELSE b END, depth + 1 FROM r JOIN calls ON CASE direction WHEN 'callers' THEN b ELSE a END = r.id WHERE depth < 3) SELECT direction, id, min(depth) AS depth FROM r GROUP BY 1, 2 HAVING min(depth) > 0")
over_graph("call_tree_depth3", lambda e, r: G.call_tree(r, 7), ", r AS (SELECT 0 AS depth, 7::BIGINT AS id, NULL::BIGINT AS parent UNION ALL SELECT depth + 1, b, a FROM r JOIN calls ON a = r.id WHERE depth < 3) SELECT depth, id, parent, count(*) AS walks FROM r GROUP BY 1, 2, 3")
over_graph("name_chain_distance", lambda e, r: G.name_chain(e, r, "main", "Run"), ", n AS (SELECT DISTINCT x.name AS a, y.name AS b FROM calls JOIN entity x ON x.id = calls.a JOIN entity y ON y.id = calls.b WHERE x.name <> y.name), r AS (SELECT 'main' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN n ON n.a = r.id WHERE depth < 8) SELECT min(depth) AS hops FROM r WHERE id = 'Run' HAVING min(depth) IS NOT NULL")


def _components_sql(rounds: int = 24) -> str:
    sql = f", u AS MATERIALIZED {_BOTH}, c0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS low FROM u)"
    for k in range(rounds):
        sql += f", c{k + 1} AS MATERIALIZED (SELECT x.id, least(min(x.low), min(y.low)) AS low FROM c{k} x JOIN u ON u.a = x.id JOIN c{k} y ON y.id = u.b GROUP BY x.id)"
    return sql + f" SELECT count(*) AS components, coalesce(max(n), 0) AS largest FROM (SELECT count(*) AS n FROM c{rounds} GROUP BY low HAVING count(*) > 1)"


over_graph("connected_components", lambda e, r: G.component_stats(r), _components_sql())


def _lpa_sql(rounds: int) -> str:
    sql = f", u AS (SELECT a, b FROM calls WHERE a IN (SELECT id FROM entity) AND b IN (SELECT id FROM entity) UNION SELECT b, a FROM calls WHERE a IN (SELECT id FROM entity) AND b IN (SELECT id FROM entity)), l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS label FROM u)"
    for k in range(rounds):
        sql += f", l{k + 1} AS MATERIALIZED (SELECT v.id, arg_max(v.label, (n, (v.label = o.label)::INT, -v.label)) AS label FROM (SELECT u.a AS id, l.label, count(*) AS n FROM u JOIN l{k} l ON l.id = u.b GROUP BY 1, 2) v JOIN l{k} o ON o.id = v.id GROUP BY v.id)"
    return sql


over_graph("communities_lpa5", lambda e, r: G.communities(e, r, 5), _lpa_sql(5) + " SELECT id, label FROM l5")
query("communities")(lambda s, d: G.communities(*P.graph(s, d)))
over_graph("adjacency", lambda e, r: G.adjacency(r), "SELECT a AS id, list_sort(list(b)) AS callees FROM calls GROUP BY a")
over_graph("dsl_single_hop", lambda e, r: D.match(e, r, "MATCH (Function)-[Calls]->(Method) LIMIT 500"), "SELECT source_id, target_id, 1 AS hops FROM relation JOIN entity s ON s.id = source_id AND s.kind IN (0, 1) JOIN entity t ON t.id = target_id AND t.kind = 1 WHERE type = 1 ORDER BY 1, 2 LIMIT 500")
over_graph("dsl_multi_hop", lambda e, r: D.match(e, r, "MATCH (Function:main)-[Calls*1..3]->(Method)"), ", edge AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relation WHERE type = 1), w AS (SELECT id AS source_id, id AS node, 0 AS hops FROM entity WHERE kind IN (0, 1) AND name = 'main' UNION SELECT w.source_id, edge.b, hops + 1 FROM w JOIN edge ON edge.a = w.node WHERE hops < 3 AND (hops = 0 OR node NOT IN (SELECT id FROM entity WHERE kind = 1))) SELECT DISTINCT source_id, node AS target_id, hops FROM w WHERE hops > 0 AND node IN (SELECT id FROM entity WHERE kind = 1) ORDER BY 1, 2, 3 LIMIT 10000")
over_entity("dsl_hints", lambda e: D.hints(e, D.End("Class", "main")), "SELECT kind, count(*) AS n FROM entity WHERE name = 'main' GROUP BY kind")

# text and search
_WORDS = lambda c: f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-./:()]+', ' ', 'g')), ' +'), lambda x: x <> '')"
query("doc_token_count", "SELECT doc_id, ceil((3 * length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 6 * (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))) / 10)::BIGINT AS tokens FROM documents", plain=True)(lambda s, d: _docs(s, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens")))
over_entity("identifier_words", lambda e: e.select("id", F.array_join(X.identifier_words(F.col("qualified_name")), " ").alias("words")), f"SELECT id, array_to_string({_WORDS('qualified_name')}, ' ') AS words FROM entity")
over_entity("trigram_search", lambda e: T.by_substring(e, "bolt"), "SELECT id, name, length(name) AS size FROM entity WHERE name ILIKE '%bolt%' ORDER BY size, name, id LIMIT 20")
_BM = f", w AS (SELECT id, kind, name, list_concat(list_concat({_WORDS('name')}, {_WORDS('qualified_name')}), {_WORDS('file_path')}) AS w FROM entity WHERE name <> ''), t AS (SELECT id, len(w) AS length, unnest(w) AS term FROM w), tf AS (SELECT id, term, length, count(*) AS tf FROM t GROUP BY 1, 2, 3), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w), h AS (SELECT tf.*, count(*) OVER (PARTITION BY term) AS df FROM tf WHERE term IN ('main', 'supplier', 'lib')), sc AS (SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h, s GROUP BY id) "
over_entity("bm25_search", lambda e: T.bm25(e, "main supplier lib"), _BM + "SELECT id, name, kind, score FROM sc JOIN w USING (id) ORDER BY CASE WHEN kind IN (2, 3, 4) THEN 0 ELSE 1 END, score DESC, id LIMIT 20")
over_entity("tfidf_weights", T.term_weights, f"SELECT term, count(*) AS df, round(least(3, ln(1 + n / (1 + count(*)))), 6) AS idf FROM (SELECT unnest(list_distinct({_WORDS('name')})) AS term, (SELECT count(*) FROM entity WHERE kind IN (0, 1)) AS n FROM entity WHERE kind IN (0, 1)) GROUP BY term, n")


@query("embedding_topk", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE round(list_cosine_similarity(embedding::DOUBLE[], q), 6) > 0.05 ORDER BY score DESC, id LIMIT 10", plain=True)
def _(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), X.unit(F.col("embedding")).alias("vector"))
    return T.nearest(v, v.filter("id = 0").select(F.col("vector").alias("q")), 10, 0.05)


@query("route_split", "SELECT page_id, split_part(label, ' ', 1) AS method, substr(label, instr(label, ' ') + 1) AS path FROM (SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END, ' ', url) AS label FROM pages) ORDER BY method, path, page_id LIMIT 500", plain=True)
def _(s, d):
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (F.col("page_id") % 4 + 1).cast("int")), F.col("url")).alias("label"))
    method, path = X.route_parts(F.col("label"))
    return p.select("page_id", method.alias("method"), path.alias("path")).orderBy("method", "path", "page_id").limit(500)


@query("import_paths", "SELECT id, unnest(['pkg.' || name, module]) AS path FROM (SELECT id, name, replace(trim(module_path, '/'), '/', '.') AS module FROM entity)")
def _(s, d):
    e = P.entity(s, d)
    body = F.concat(F.lit('import "pkg.'), F.col("name"), F.lit('"\nfrom '), F.replace(F.btrim("module_path", F.lit("/")), F.lit("/"), F.lit(".")), F.lit(" import x"))
    return e.select("id", F.explode(X.import_paths(body)).alias("path"))


# events and increments
_TS = "to_timestamp(floor(epoch(ts) / {0}) * {0})::TIMESTAMP"
query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3", plain=True)(lambda s, d: S.tumbling(s.read.parquet(f"{d}/events.parquet")))
query("event_sliding", "SELECT b AS start_at, b + INTERVAL 2 HOUR AS end_at, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY 1, 2", plain=True)(lambda s, d: S.sliding(s.read.parquet(f"{d}/events.parquet")))
query("event_session", "WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT min(ts) AS start_at, max(ts) + INTERVAL 30 MINUTE AS end_at, user_id, count(*) AS n, round(sum(value), 4) AS total FROM y GROUP BY user_id, g", plain=True)(lambda s, d: S.sessions(s.read.parquet(f"{d}/events.parquet")))


@query("incremental_manifest_diff", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 AND doc_id % 13 <> 0 THEN 'added' WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0) AND (doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 10 = 0)", plain=True)
def _(s, d):
    m = _docs(s, d).select("doc_id", (F.col("doc_id") * 7 % 1000).alias("mtime"), F.col("n_chars").alias("size"))
    return S.changes(m.filter("doc_id % 11 <> 0"), m.filter("doc_id % 13 <> 0").withColumn("size", F.col("size") + (F.col("doc_id") % 10 == 0).cast("int")), "doc_id", ["mtime", "size"])


# evidence, verification and resolution
from faktum.operators import evidence as E  # noqa: E402
from faktum.operators import resolve as R  # noqa: E402
from faktum.operators import verify as V  # noqa: E402

_FACT = f"WITH RECURSIVE fact AS ({P.FACT})"


@query("facts_by_category", f"{_FACT} SELECT category, primitive, kind, count(*) AS n, count(DISTINCT function_id) AS functions FROM fact GROUP BY 1, 2, 3", plain=True)
def _(s, d):
    return P.facts(s, d).groupBy("category", "primitive", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("function_id").alias("functions"))


def _evidence(name: str, group: str, sql: str) -> None:
    query(name, f"{_FACT} {sql}", plain=True)(lambda s, d: E.evidence(P.facts(s, d), group=group).select("rule", "function", "facts", "items", "confidence", "symbol"))


_evidence("evidence_collect", "error", "SELECT 'bare_except_collect' AS rule, NULL::BIGINT AS function, count(*) AS facts, count(*) AS items, min(confidence)::DOUBLE AS confidence, arg_min(symbol, id) AS symbol FROM fact WHERE kind = 'suppression'")
_evidence("evidence_missing_match", "concurrency", "SELECT 'mutex_without_unlock' AS rule, NULL::BIGINT AS function, count(*) AS facts, count(*) AS items, min(confidence)::DOUBLE AS confidence, arg_min(symbol, id) AS symbol FROM fact WHERE kind = 'lock' AND function_id NOT IN (SELECT function_id FROM fact WHERE kind = 'defer_unlock')")
_evidence("evidence_missing_per_function", "memory", "SELECT 'cstring_leak' AS rule, function_id AS function, count(*) AS facts, count(*) AS items, min(confidence)::DOUBLE AS confidence, arg_min(symbol, id) AS symbol FROM fact WHERE kind = 'alloc' AND function_id NOT IN (SELECT function_id FROM fact WHERE kind = 'free') GROUP BY function_id")


@query("evidence_count", f"{_FACT} SELECT 'lock_count' AS rule, count(*) AS facts, 0 AS items, 1.0::DOUBLE AS confidence FROM fact WHERE kind = 'lock'", plain=True)
def _(s, d):
    return E.evidence(P.facts(s, d), (E.Rule("x", "lock_count", ("sync/mutex/lock",), "count"),)).select("rule", "facts", "items", "confidence")


_VALUES = [("main",), ("Supplier",), ("red_bolt",), ("SmallBolt",), ("zzzz",), ("Run",)]
_MATCH = """, s AS (SELECT unnest(['main', 'Supplier', 'red_bolt', 'SmallBolt', 'zzzz', 'Run']) AS subject), live AS (SELECT id, lower(name) AS low FROM entity WHERE visibility = 1 OR id IN (SELECT target_id FROM relation WHERE type = 1)),
f AS (SELECT DISTINCT id, unnest([low, replace(low, '_', ''), CASE WHEN instr(low, '_') > 0 THEN replace(substr(low, instr(low, '_') + 1), '_', '') ELSE '' END]) AS form FROM live), q AS (SELECT DISTINCT subject, unnest([lower(subject), replace(lower(subject), '_', '')]) AS ask FROM s),
m AS (SELECT DISTINCT subject, id FROM q JOIN f ON form <> '' AND (form = ask OR (length(form) >= 4 AND length(ask) >= 4 AND (starts_with(form, ask) OR starts_with(ask, form))))) """
over_graph("capability_matcher", lambda e, r: V.implementing(e.sparkSession.createDataFrame(_VALUES, "subject string"), e, r), _MATCH + "SELECT subject, id FROM m")
over_graph("capability_verdicts", lambda e, r: V.capability_verdicts(e.sparkSession.createDataFrame(_VALUES, "subject string"), e.sparkSession.createDataFrame([("Mainline",), ("RunFast",), ("zzzz top",)], "name string"), e, r), _MATCH + ", c AS (SELECT unnest(['mainline', 'runfast', 'zzzz top']) AS d), x AS (SELECT subject, EXISTS (SELECT 1 FROM c WHERE starts_with(d, lower(subject))) AS declared, subject IN (SELECT subject FROM m) AS built FROM s) SELECT subject, CASE WHEN declared AND built THEN 'Supported' ELSE 'Contradicted' END AS verdict, CASE WHEN NOT declared THEN 0.9 WHEN NOT built THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence FROM x")
over_graph("capability_drift", lambda e, r: V.capability_drift(e.sparkSession.createDataFrame(_VALUES, "name string"), e, r), _MATCH + "SELECT subject FROM s WHERE subject NOT IN (SELECT subject FROM m)")
_LAYER = "SELECT *, CASE WHEN p_x % 3 = 0 THEN name || 'Controller' WHEN p_x % 3 = 1 THEN name || 'Service' ELSE name || 'Repo' END AS n2 FROM (SELECT *, id % 7 AS p_x FROM entity)"
over_graph("architecture_drift", lambda e, r: V.layer_drift(e.withColumn("name", F.concat("name", F.element_at(F.array(F.lit("Controller"), F.lit("Service"), F.lit("Repo")), (F.col("id") % 7 % 3 + 1).cast("int")))), r), f", l AS (SELECT id, p_x % 3 AS layer FROM ({_LAYER})) SELECT source_id, target_id, CASE WHEN s.layer > t.layer THEN 'reverse call' ELSE 'same-layer bypass' END AS violation FROM relation JOIN l s ON s.id = source_id JOIN l t ON t.id = target_id WHERE type = 1 AND source_id <> target_id AND (s.layer > t.layer OR (s.layer = 0 AND t.layer = 0)) ORDER BY 1, 2 LIMIT 100")
over_graph("dead_modules", lambda e, r: V.dead_modules(e, r), ", scope AS (SELECT DISTINCT module_path AS name FROM entity), m AS (SELECT s.name, e.id FROM scope s JOIN entity e ON starts_with(lower(e.file_path), lower(s.name))) SELECT name, count(*) AS entities FROM m WHERE name NOT IN (SELECT m.name FROM relation JOIN m ON m.id = target_id WHERE NOT EXISTS (SELECT 1 FROM m k WHERE k.name = m.name AND k.id = source_id)) GROUP BY name HAVING count(*) >= 10 ORDER BY name LIMIT 500")
query("project_state_score", f"{P.WITH}, fact AS ({P.FACT}), n AS (SELECT (SELECT count(*) FROM fact WHERE kind = 'lock' AND function_id NOT IN (SELECT function_id FROM fact WHERE kind = 'defer_unlock')) AS sync, (SELECT count(*) FROM fact WHERE kind = 'alloc' AND function_id NOT IN (SELECT function_id FROM fact WHERE kind = 'free')) AS memory, (SELECT count(*) FROM fact WHERE kind = 'suppression') AS error, 0 AS pattern, 0 AS ffi, 0 AS architecture, (SELECT count(*) FROM entity WHERE kind IN (0, 1) AND visibility <> 1 AND name NOT IN ('main','Main','run','Run','start','Start','init','Init','setup','Setup') AND id NOT IN (SELECT source_id FROM relation UNION SELECT target_id FROM relation)) AS dead, (SELECT count(*) FROM entity) AS entities) SELECT *, greatest(0, least(1, round(1 - .05 * sync - .1 * memory - .04 * error - .005 * dead, 6)))::DOUBLE AS confidence, 1.0::DOUBLE AS architecture_score, round(dead / greatest(entities, 1), 6) AS dead_share FROM n", plain=True)(lambda s, d: (lambda e, r: V.project_state(E.items(P.facts(s, d)), 0, V.dead_functions(e, r, None), e))(*P.graph(s, d)))


@query("claim_extract", "SELECT * FROM (VALUES (1, 'supported_by', 'FastSearch', ''), (2, 'should', 'Parser', 'reject bad input'), (3, 'contract', 'threadsafe', ''), (4, 'follows', 'Controller', 'Service>Repository'), (6, 'has', 'Cache', '')) t(id, predicate, subject, object)", plain=True)
def _(s, d):
    rows = [(1, "It supports fast search, and more."), (2, "Parser should reject bad input."), (3, "The queue is thread-safe."), (4, "Controller -> Service -> Repository"), (5, "It never supports magic."), (6, "The store has a cache.")]
    return V.claims(s.createDataFrame(rows, "id int, text string"))


@query("claims_in_documents")
def _(s, d):
    return V.claims(_docs(s, d).select(F.col("doc_id").alias("id"), "text"))


@query("documentation_drift", "SELECT unnest(['javascript']) AS language", plain=True)
def _(s, d):
    docs = s.createDataFrame([("Written in Go and Rust, with JavaScript. ```python\nkotlin\n```",)], "content string")
    return V.documentation_drift(docs, P.entity(s, d))


_CANDS = f""", rf AS ({P.REFERENCE}), imp AS (SELECT DISTINCT s.file_path, t.module_path AS module FROM relation JOIN entity s ON s.id = source_id JOIN entity t ON t.id = target_id WHERE type = 1 AND (source_id + target_id) % 4 = 0),
fam AS (SELECT *, CASE WHEN language IN ('c','cpp','c++') THEN 'c' WHEN language IN ('javascript','typescript','tsx','jsx') THEN 'js' ELSE language END AS f FROM entity),
cnt AS (SELECT name, count(*) AS n FROM entity WHERE kind IN (0, 1, 2, 3, 4) GROUP BY name HAVING count(*) <= 50),
cand AS (SELECT rf.*, e.id, e.kind, e.qualified_name AS qname, e.file_path AS file, e.module_path AS module, e.language AS lang, e.arity AS c_arity, c.file_path AS from_file, c.module_path AS from_module, i.module IS NOT NULL AS imported
 FROM rf JOIN cnt USING (name) JOIN fam c ON c.id = rf.caller_id JOIN fam e ON e.name = rf.name AND e.kind IN (0, 1, 2, 3, 4) AND e.id <> rf.caller_id AND e.f = c.f LEFT JOIN imp i ON i.file_path = c.file_path AND i.module = e.module_path
 WHERE NOT (e.language = 'go' AND regexp_matches(e.name, '^[a-z]') AND e.module_path <> c.module_path) AND NOT (e.language = 'python' AND starts_with(e.name, '_') AND e.file_path <> c.file_path)),
sc AS (SELECT *, CASE WHEN module = from_module THEN 1.0 WHEN regexp_extract(module, '^(.*/)[^/]+/$', 1) = regexp_extract(from_module, '^(.*/)[^/]+/$', 1) THEN 0.5 ELSE 0.0 END AS m FROM cand),
pt AS (SELECT *, .15 * m AS v0, .8 * (CASE WHEN module = from_module OR imported THEN 1.0 ELSE 0.0 END) AS v1, .1 * m AS v2, .1 * (CASE WHEN arity = 0 AND c_arity = 0 THEN .5 WHEN arity = c_arity THEN 1.0 WHEN c_arity = 0 THEN .5 ELSE -.5 END) AS v3, .05 * (CASE WHEN file = from_file THEN 1.0 WHEN module = from_module THEN .3 ELSE 0.0 END) AS v4, .1 * (CASE WHEN kind IN (2, 3) THEN 1.0 ELSE 0.0 END) AS v5,
 .15 * (CASE WHEN receiver_type = '' THEN .5 WHEN starts_with(qname, receiver_type || '.') THEN 1.0 WHEN contains(qname, receiver_type) THEN .5 WHEN contains(lower(file), lower(receiver_type)) THEN .2 ELSE 0.0 END) AS v6, .1 * (CASE WHEN name IN ({', '.join(repr(x) for x in R.COMMON)}) AND module <> from_module THEN -.25 ELSE 0.0 END) AS v7, CASE WHEN call_kind = 0 THEN 0.0 ELSE .15 * (CASE call_kind WHEN 3 THEN .3 WHEN 2 THEN -.3 ELSE -.1 END) END AS v8, .2 AS v9 FROM sc),
fin AS (SELECT *, round((v0 + v1 + v2 + v3 + v4 + v5 + v6 + v7 + v8 + v9) * 1000)::BIGINT AS points FROM pt) """


def _candidates(s: SparkSession, d: str) -> DataFrame:
    refs = P.reference(s, d)
    e, r = P.graph(s, d)
    imports = L.with_ends(e, r.filter("type = 1 AND (source_id + target_id) % 4 = 0")).select(F.col("source_file_path").alias("file_path"), F.col("target_module_path").alias("module"))
    return R.scored(R.candidates(refs, e, imports))


query("resolver_scores", f"{P.WITH} {_CANDS} SELECT ref_id, id, points FROM fin", plain=True)(lambda s, d: _candidates(s, d).select("ref_id", "id", "points"))
query("resolver_edges")(lambda s, d: R.edges(R.resolved(_candidates(s, d))))
over_entity("fuzzy_match_tiers", lambda e: R.fuzzy(e.sparkSession.createDataFrame([("MAIN",), ("small",), ("_bolt",), ("zzz",), ("supplier#0000",)], "name string"), e), """, q AS (SELECT unnest(['MAIN', 'small', '_bolt', 'zzz', 'supplier#0000']) AS name), h AS (SELECT q.name, e.id, CASE WHEN lower(e.name) = lower(q.name) THEN 1 WHEN length(q.name) >= 3 AND starts_with(lower(e.name), lower(q.name)) THEN 2 WHEN length(q.name) >= 3 AND ends_with(lower(e.name), lower(q.name)) THEN 3 END AS tier FROM q JOIN entity e ON TRUE), b AS (SELECT *, min(tier) OVER (PARTITION BY name) AS best FROM h WHERE tier IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM b WHERE tier = best) SELECT name, min(tier) AS tier, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM r WHERE n <= 5 GROUP BY name""")
