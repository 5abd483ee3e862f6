"""A query for each group of operators over the projected relations, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.operators import graph, history, loading, lookups, relations, rules, uses, work
from tessera.operators import predicates as C
from tessera.plans import names
from tessera.plans import projections as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(names.QUERIES)
SQL: dict[str, str] = dict(names.SQL)
EV, COMP, FOLD, HIST = J.EVIDENCE_SQL, J.COMPONENTS_SQL, J.FOLD_SQL, J.HISTORY_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Observations and edges


@query(f"WITH {EV} SELECT src, dst, kind, count(*) AS observations, string_agg(place, ' ' ORDER BY place) AS evidence FROM (SELECT DISTINCT src, dst, kind, file || ':' || line || '>' || target || CASE WHEN test THEN '*' ELSE '' END AS place FROM ev) GROUP BY ALL")
def edge_merge(spark, d):
    place = F.concat(X.location(F.col("file"), F.col("line"), F.lit(None).cast("string")), F.lit(">"), "target", F.when(F.col("test"), "*").otherwise(""))
    merged = relations.merge_edges(J.evidence(spark, d).withColumn("place", place), ["place"])
    return merged.select("src", "dst", "kind", F.size("evidence").cast("long").alias("observations"), F.array_join(F.transform("evidence", lambda e: e["place"]), " ").alias("evidence"))


@query(f"WITH {EV}, {FOLD} SELECT a.n AS src, b.n AS dst, count(DISTINCT (file, line)) AS statements, count(DISTINCT (file, line)) FILTER (NOT test) AS production, count(DISTINCT (file, line)) FILTER (test) AS tests FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.n <> b.n GROUP BY ALL")
def statement_counts(spark, d):
    e = graph.rolled_up(J.evidence(spark, d), J.components(spark, d), 1)
    return relations.statement_counts(e, ["src", "dst"])


@query(f"WITH {EV} SELECT src, dst, bool_or(NOT test) AS in_production, bool_or(NOT test AND NOT type_only) AS runs FROM ev GROUP BY ALL")
def edge_predicates(spark, d):
    merged = relations.merge_edges(J.evidence(spark, d), ["file", "line", "test", "type_only", "server_reference"])
    return merged.select("src", "dst", C.edge_in_production(F.col("evidence")).alias("in_production"), C.edge_runs(F.col("evidence")).alias("runs"))


@query(f"WITH {EV} SELECT file, bool_and(test) AS test_code FROM ev GROUP BY 1")
def test_code_files(spark, d):
    return relations.test_code(J.evidence(spark, d))


@query(f"WITH {EV}, {FOLD}, x AS (SELECT a.n AS src, b.n AS dst, file, line, min(CASE WHEN test THEN 1 WHEN scope = 'local' THEN 2 WHEN type_only THEN 3 ELSE 0 END) AS class FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.n <> b.n GROUP BY ALL) SELECT src, dst, class, count(*) AS statements FROM x GROUP BY ALL")
def pair_class_counts(spark, d):
    rank = F.when(F.col("test"), 1).when(F.col("scope") == "local", 2).when(F.col("type_only"), 3).otherwise(0)
    return relations.pair_classes(graph.rolled_up(J.evidence(spark, d), J.components(spark, d), 1), ["src", "dst"], rank)


@query("SELECT 'u' || user_id AS id, arg_min(event_type, event_id) AS kind, arg_max(event_type, event_id) AS last, arg_min(CASE WHEN value > 50 THEN CAST(event_id AS VARCHAR) END, CASE WHEN value > 50 THEN event_id END) AS path FROM events GROUP BY 1")
def component_merge(spark, d):
    e = J.table(spark, d, "events").select(J.named("u", "user_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("value") > 50, F.col("event_id").cast("string")).alias("path"), F.col("event_id").alias("seq"))
    last = relations.merge_symbols(e.select("id", F.col("kind").alias("last"), "seq"), "seq", fill=())
    return relations.merge_components(e, "seq").join(last, "id")


# Containment and roll-up


@query(f"WITH RECURSIVE {COMP}, up(id, chain, depth, parent) AS (SELECT id, id, 0, parent FROM comp UNION ALL SELECT up.id, comp.id || ' > ' || up.chain, up.depth + 1, comp.parent FROM up JOIN comp ON comp.id = up.parent) SELECT id, chain, depth FROM up WHERE parent IS NULL")
def containment_paths(spark, d):
    return graph.paths(J.components(spark, d)).select("id", F.array_join("chain", " > ").alias("chain"), "depth")


def _roll_up(depth: int) -> tuple[Callable, str]:
    col = "rn"[depth]

    def f(spark, d):
        e = graph.rolled_up(J.evidence(spark, d), J.components(spark, d), depth)
        return e.groupBy("src", "dst", "kind").agg(F.count_distinct(F.struct("file", "line", "target", "test", "scope", "type_only")).alias("observations"))

    f.__name__ = f"rollup_depth{depth}"
    return f, f"WITH {EV}, {FOLD} SELECT a.{col} AS src, b.{col} AS dst, kind, count(DISTINCT (file, line, target, test, scope, type_only)) AS observations FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.{col} <> b.{col} GROUP BY ALL"


for _depth in (0, 1):
    _f, _sql = _roll_up(_depth)
    query(_sql)(_f)


@query(f"WITH {EV}, {FOLD}, e AS (SELECT DISTINCT a.n AS src, b.n AS dst FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.n <> b.n AND NOT test AND type_only), i AS (SELECT id, CAST(sum(i) AS BIGINT) AS dependents, CAST(sum(o) AS BIGINT) AS dependencies FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1) SELECT id, dependents, dependencies, rank() OVER (ORDER BY dependents DESC) AS rank FROM i ORDER BY dependents DESC, dependencies DESC, id LIMIT 10")
def most_depended_on(spark, d):
    e = graph.rolled_up(J.evidence(spark, d).where("not test and type_only"), J.components(spark, d), 1)
    ranked = relations.competition_rank(graph.dependents(e), "dependents")
    return ranked.orderBy(F.desc("dependents"), F.desc("dependencies"), "id").limit(10).select("id", "dependents", "dependencies", "rank")


@query(f"WITH {EV}, {FOLD}, c AS (SELECT a.n AS src, b.n AS dst, a.r = b.r AS within, count(DISTINCT (file, line)) FILTER (NOT test) AS production, count(DISTINCT (file, line)) FILTER (test) AS tests FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.n <> b.n GROUP BY ALL) SELECT src, dst, production, tests, row_number() OVER (ORDER BY within, production DESC, tests DESC, src, dst) AS place FROM c QUALIFY place <= 50")
def dependency_ranking(spark, d):
    comp = J.components(spark, d)
    e = relations.statement_counts(graph.rolled_up(J.evidence(spark, d), comp, 1), ["src", "dst"])
    root = graph.folded(comp, 0)
    e = e.join(root.select(F.col("id").alias("src"), F.col("at").alias("_a")), "src").join(root.select(F.col("id").alias("dst"), F.col("at").alias("_b")), "dst")
    order = [F.col("_a") == F.col("_b"), F.desc("production"), F.desc("tests"), F.col("src"), F.col("dst")]
    return e.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("src", "dst", "production", "tests", "place")


@query(f"WITH {EV} SELECT target, count(DISTINCT src) AS importers, count(DISTINCT CASE WHEN NOT test THEN src END) AS outside_tests, count(DISTINCT (file, line)) AS statements FROM ev GROUP BY 1 ORDER BY importers DESC, statements DESC, outside_tests DESC, target LIMIT 25")
def external_ranking(spark, d):
    e = J.evidence(spark, d).groupBy("target").agg(F.count_distinct("src").alias("importers"), F.count_distinct(F.when(~F.col("test"), F.col("src"))).alias("outside_tests"), relations.statements().alias("statements"))
    return e.orderBy(F.desc("importers"), F.desc("statements"), F.desc("outside_tests"), "target").limit(25)


@query(f"WITH {EV}, {FOLD}, c AS (SELECT a.r AS src, target, count(*) AS n FROM ev JOIN leaf a ON a.id = src GROUP BY ALL) SELECT src, target, n, row_number() OVER w AS rank, greatest(count(*) OVER (PARTITION BY src) - 5, 0) AS rest FROM c WINDOW w AS (PARTITION BY src ORDER BY n DESC, target) QUALIFY rank <= 5")
def top_counts_with_rest(spark, d):
    root = graph.folded(J.components(spark, d), 0).select(F.col("id").alias("src"), "at")
    n = J.evidence(spark, d).join(root, "src").groupBy(F.col("at").alias("src"), "target").agg(F.count("*").alias("n"))
    return relations.top_with_rest(n, ["src"], [F.desc("n"), F.asc("target")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT id, first, n FROM (SELECT 'P' || p_partkey AS id, min('P' || p_partkey) OVER w AS first, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_name)) WHERE n > 1")
def namesakes(spark, d):
    return relations.name_classes(J.table(spark, d, "part").select(J.named("P", "p_partkey").alias("id"), F.col("p_name").alias("name")))


# Paths


def _files(spark, d):
    o = J.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = J.table(spark, d, "customer").join(F.broadcast(J.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", "n_nationkey")
    f = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    leaf = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("zz"))).when(F.col("o_orderkey") % 3 == 0, F.concat(J.named("n", "n_nationkey"), F.lit("/x"))).otherwise(F.concat(J.named("n", "n_nationkey"), F.lit("/"), J.named("c", "c_custkey")))
    return f.select(F.concat(J.named("r", "n_regionkey"), F.lit("/"), leaf, F.lit("/src/"), J.named("o", "o_orderkey"), F.lit(".py")).alias("file"))


_FILES = "files AS (SELECT 'r' || n_regionkey || '/' || CASE WHEN o_orderkey % 7 = 0 THEN 'zz' WHEN o_orderkey % 3 = 0 THEN 'n' || n_nationkey || '/x' ELSE 'n' || n_nationkey || '/c' || c_custkey END || '/src/o' || o_orderkey || '.py' AS file FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {COMP}, {_FILES}, up AS (SELECT file, unnest(list_transform(range(1, len(string_split(file, '/')) + 1), lambda i: array_to_string(string_split(file, '/')[1:i], '/'))) AS path FROM files) SELECT file, arg_max(id, length(path)) AS owner FROM up JOIN comp USING (path) GROUP BY file")
def path_owner(spark, d):
    none = spark.createDataFrame([], "id string, file string")
    return lookups.path_owners(_files(spark, d), J.components(spark, d), none)


_DECLARED = [(f"region{r}", f"r{r}") for r in range(5)] + [("special", "r1/n2"), ("special", "r1/n3"), ("also", "r1/n2"), ("deep", "r2/n8"), ("nobody", "r9"), ("outside", "ext:pypi:*")]
_DECL = "decl AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{s}')" for n, s in _DECLARED) + ") t(name, selector))"
_MEM = "mem AS (SELECT id, name FROM (SELECT comp.id, decl.name, row_number() OVER (PARTITION BY comp.id ORDER BY length(selector) DESC, decl.name) AS n FROM comp JOIN decl ON path = selector OR starts_with(path, selector || '/')) WHERE n = 1)"
_NATIONS = f"{EV}, {COMP}, {FOLD}, {_DECL}, {_MEM}, dep AS (SELECT DISTINCT a.n AS src, b.n AS dst FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.n <> b.n AND NOT test AND type_only AND scope = 'local'), pairs AS (SELECT a.name AS \"from\", b.name AS \"to\", src, dst FROM dep JOIN mem a ON a.id = src JOIN mem b ON b.id = dst WHERE a.name <> b.name)"


def _declared(spark):
    return spark.createDataFrame(_DECLARED, "name string, selector string")


def _nation_rules(spark, d):
    comp = J.components(spark, d)
    members = lookups.membership(comp, _declared(spark))
    e = graph.rolled_up(J.evidence(spark, d).where("not test and type_only and scope = 'local'"), comp, 1).select("src", "dst").distinct()
    return comp, members, e


@query(f"WITH {COMP}, {_DECL}, {_MEM} SELECT id, name FROM mem")
def declared_membership(spark, d):
    return lookups.membership(J.components(spark, d), _declared(spark))


@query(f"WITH {COMP}, {_DECL} SELECT name, selector FROM decl WHERE NOT EXISTS (SELECT 1 FROM comp WHERE path = selector OR starts_with(path, selector || '/'))")
def unmatched_selectors(spark, d):
    return rules.unmatched_selectors(J.components(spark, d), _declared(spark))


@query(f"WITH {_NATIONS} SELECT 1 AS idx, src, dst FROM dep JOIN mem a ON a.id = src JOIN mem b ON b.id = dst WHERE a.name = 'special' AND b.name = 'region0' UNION ALL SELECT 2, src, dst FROM dep JOIN comp a ON a.id = src JOIN comp b ON b.id = dst WHERE (a.path = 'r3' OR starts_with(a.path, 'r3/')) AND b.path = 'r2/n8'")
def deny(spark, d):
    comp, members, e = _nation_rules(spark, d)
    return rules.denied(e, comp, members, spark.createDataFrame([(1, "special", "region0"), (2, "r3", "r2/n8")], "idx int, from string, to string"), _declared(spark))


@query(f"WITH {_NATIONS}, l AS (SELECT * FROM (VALUES ('region0', 0), ('region1', 1), ('region2', 2), ('region3', 3), ('region4', 4)) t(name, rank)) SELECT \"from\", \"to\", src, dst FROM pairs JOIN l a ON a.name = \"from\" JOIN l b ON b.name = \"to\" WHERE b.rank < a.rank")
def layers(spark, d):
    _, members, e = _nation_rules(spark, d)
    return rules.layer_violations(rules.declared_pairs(e, members), spark.createDataFrame([(f"region{i}", i) for i in range(5)], "name string, rank int"))


_ALLOW = [("region0", "region1"), ("region0", "region2"), ("region4", "nobody"), ("deep", "region0")]
_ALLOWS = "al AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ALLOW) + ') t("from", "to"))'


@query(f'WITH {_NATIONS}, {_ALLOWS} SELECT "from", "to", src, dst FROM pairs WHERE "from" IN (SELECT "from" FROM al) AND ("from", "to") NOT IN (SELECT "from", "to" FROM al)')
def allow_unexpected(spark, d):
    _, members, e = _nation_rules(spark, d)
    return rules.unexpected(rules.declared_pairs(e, members), spark.createDataFrame(_ALLOW, "from string, to string"))


@query(f'WITH {_NATIONS}, {_ALLOWS} SELECT "from", "to" FROM al WHERE ("from", "to") NOT IN (SELECT "from", "to" FROM pairs)')
def allow_stale(spark, d):
    _, members, e = _nation_rules(spark, d)
    return rules.stale(rules.declared_pairs(e, members), spark.createDataFrame(_ALLOW, "from string, to string"))


@query(f"WITH {COMP}, d2 AS (SELECT 'half' AS name, 'r0' AS selector), m2 AS (SELECT id FROM comp, d2 WHERE path = selector OR starts_with(path, selector || '/')) SELECT id FROM comp WHERE (starts_with(path, 'r0/') OR starts_with(path, 'r1/') OR path IN ('r0', 'r1')) AND id NOT IN (SELECT parent FROM comp WHERE parent IS NOT NULL) AND id NOT IN (SELECT id FROM m2)")
def coverage_rule(spark, d):
    comp = J.components(spark, d)
    members = lookups.membership(comp, spark.createDataFrame([("half", "r0")], "name string, selector string"))
    return rules.uncovered(comp, members, spark.createDataFrame([("r0",), ("r1",)], "selector string"))


@query(r"""WITH h AS (SELECT 'g' || page_id AS src, replace(trim(m, '/'), '/', '.') AS module FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS m FROM pages)) SELECT DISTINCT src, module FROM h WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('a'), ('docs'), ('item')) t(p) WHERE module = p OR starts_with(module, p || '.') OR starts_with(module, p || '/'))""")
def undeclared_imports(spark, d):
    href = F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"))
    h = J.table(spark, d, "pages").select(J.named("g", "page_id").alias("src"), href.alias("m")).select("src", F.translate(F.expr("trim(both '/' from m)"), "/", ".").alias("module"), F.lit("undeclared").alias("reason"))
    return rules.undeclared(h, spark.createDataFrame([("a",), ("docs",), ("item",)], "prefix string")).select("src", "module").distinct()


@query(f"WITH {J.sparse_sql()}, e AS (SELECT DISTINCT src, dst, file, target FROM sp), m AS (SELECT DISTINCT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src), i AS (SELECT e.* FROM e JOIN m USING (src, dst)), u AS (SELECT dst AS id, list(DISTINCT target) AS used, string_agg(DISTINCT src, ' ' ORDER BY src) AS partners FROM i GROUP BY 1), v AS (SELECT src AS id, list(DISTINCT file) AS uses FROM i GROUP BY 1) SELECT id, partners, len(used) AS used, len(uses) AS uses FROM u JOIN v USING (id) WHERE len(list_intersect(used, uses)) = 0")
def mixed_directions(spark, d):
    m = rules.mixed_directions(J.sparse(spark, d))
    return m.select("id", F.array_join("partners", " ").alias("partners"), F.size("used").cast("long").alias("used"), F.size("uses").cast("long").alias("uses"))


@query(f"WITH {EV}, v AS (SELECT src, dst, kind, file, line, target, CASE WHEN line > 4 THEN 'o' || (CAST(substr(file, 2) AS BIGINT) - 1) END AS via_file, CASE WHEN line > 4 THEN line - 4 END AS via_line FROM ev WHERE NOT test AND line <> 4), direct AS (SELECT * FROM v WHERE via_file IS NULL), place AS (SELECT file, line, min(dst) AS d FROM direct GROUP BY ALL), nm AS (SELECT file, target, min(dst) AS d FROM direct GROUP BY ALL), moved AS (SELECT v.src, coalesce(place.d, nm.d, v.dst) AS dst, v.kind, v.file, v.line, v.target, false AS direct FROM v LEFT JOIN place ON place.file = v.via_file AND place.line = v.via_line LEFT JOIN nm ON nm.file = v.via_file AND nm.target = v.target WHERE v.via_file IS NOT NULL), allv AS (SELECT DISTINCT * FROM (SELECT src, dst, kind, file, line, target, true AS direct FROM direct UNION ALL SELECT * FROM moved) WHERE src <> dst) SELECT src, dst, file, CAST(line AS INTEGER) AS line, target, direct FROM allv a WHERE direct OR NOT EXISTS (SELECT 1 FROM allv b WHERE b.direct AND b.src = a.src AND b.dst = a.dst AND b.kind = a.kind AND b.file = a.file AND b.line = a.line)")
def loaded_dependencies(spark, d):
    e = J.evidence(spark, d).where("line <> 4")
    before = F.concat(F.lit("o"), (F.substring("file", 2, 20).cast("long") - 1).cast("string"))
    e = e.withColumns({"via_file": F.when(F.col("line") > 4, before), "via_line": F.when(F.col("line") > 4, F.col("line") - 4), "names": F.array("target")})
    return lookups.loaded_dependencies(e).select("src", "dst", "file", "line", "target", "direct")


# Fix-points


@query(f"WITH RECURSIVE {J.sparse_sql()}, e AS (SELECT DISTINCT src, dst FROM sp), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def transitive_closure(spark, d):
    return graph.closure(J.sparse(spark, d))


@query(f"WITH RECURSIVE {J.sparse_sql()}, e AS (SELECT DISTINCT src, dst FROM sp), r(id) AS (SELECT src FROM e WHERE dst = 'N1' UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT id FROM r WHERE id <> 'N1'")
def transitive_dependents(spark, d):
    return graph.transitive_dependents(J.sparse(spark, d), "N1")


@query(f"WITH RECURSIVE {J.sparse_sql()}, e AS (SELECT src, dst, min(CASE WHEN scope = 'local' THEN 0 ELSE 1 END) AS cost FROM sp GROUP BY ALL), r(id, distance) AS (SELECT 'N1', 0 UNION SELECT e.dst, r.distance + e.cost FROM r JOIN e ON e.src = r.id WHERE r.distance + e.cost <= 25), m AS (SELECT id, min(distance) AS distance FROM r GROUP BY 1) SELECT m.id, CAST(m.distance AS INTEGER) AS distance FROM m")
def reach_distance(spark, d):
    e = J.sparse(spark, d).select("src", "dst", F.when(F.col("scope") == "local", 0).otherwise(1).alias("cost"))
    return graph.distances(e, spark.createDataFrame([("N1",)], "id string")).select("id", F.col("distance").cast("int").alias("distance"))


_SCC = "r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query(f"WITH RECURSIVE {J.sparse_sql()}, e AS (SELECT DISTINCT src, dst FROM sp), {_SCC} SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src")
def component_cycles(spark, d):
    return graph.strong_components(J.sparse(spark, d))


@query(f"""WITH RECURSIVE {J.sparse_sql()}, e AS (SELECT DISTINCT src, dst FROM sp), {_SCC}, g AS (SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src),
p AS (SELECT g1.component, sp.* FROM sp JOIN g g1 ON g1.id = src JOIN g g2 ON g2.id = dst WHERE g1.component = g2.component), own AS (SELECT DISTINCT component, file AS id, src AS own FROM p UNION SELECT component, target, dst FROM p),
f(component, src, dst) AS (SELECT component, file, target FROM p UNION SELECT f.component, f.src, p.target FROM f JOIN p ON p.component = f.component AND p.file = f.dst),
fh(component, src, dst) AS (SELECT component, file, target FROM p WHERE scope <> 'local' UNION SELECT fh.component, fh.src, p.target FROM fh JOIN p ON p.component = fh.component AND p.file = fh.dst AND p.scope <> 'local'),
spans AS (SELECT DISTINCT a.component FROM f a JOIN f b ON a.component = b.component AND a.src = b.dst AND a.dst = b.src JOIN own x ON x.component = a.component AND x.id = a.src JOIN own y ON y.component = a.component AND y.id = a.dst WHERE a.src <> a.dst AND x.own <> y.own),
spansh AS (SELECT DISTINCT a.component FROM fh a JOIN fh b ON a.component = b.component AND a.src = b.dst AND a.dst = b.src JOIN own x ON x.component = a.component AND x.id = a.src JOIN own y ON y.component = a.component AND y.id = a.dst WHERE a.src <> a.dst AND x.own <> y.own)
SELECT DISTINCT component, CASE WHEN component NOT IN (SELECT component FROM p) THEN 'unknown' WHEN component NOT IN (SELECT component FROM spans) THEN 'no_cycle' WHEN component NOT IN (SELECT component FROM spansh) THEN 'cycle' ELSE 'cycle_without_local' END AS level FROM g""")
def cycle_file_level(spark, d):
    e = J.sparse(spark, d)
    return graph.cycle_levels(e, graph.strong_components(e))


@query(f"WITH RECURSIVE {J.sparse_sql()}, e AS (SELECT DISTINCT src, dst FROM sp), own AS (SELECT 'N' || s_nationkey AS id, s_name AS name FROM supplier), r(id, name) AS (SELECT id, name FROM own UNION SELECT e.src, r.name FROM r JOIN e ON e.dst = r.id) SELECT id, count(*) AS names, min(name) AS first, max(name) AS last FROM r GROUP BY 1")
def exportable_names(spark, d):
    own = J.table(spark, d, "supplier").select(J.named("N", "s_nationkey").alias("id"), F.col("s_name").alias("name"))
    return graph.propagated(J.sparse(spark, d), own).groupBy("id").agg(F.count("*").alias("names"), F.min("name").alias("first"), F.max("name").alias("last"))


_DAG = J.sparse_sql().replace("c_nationkey <> s_nationkey", "c_nationkey < s_nationkey")


@query(f"WITH RECURSIVE {_DAG}, e AS (SELECT DISTINCT src, dst FROM sp), r(id, level) AS (SELECT DISTINCT dst, 0 FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.id) SELECT id, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1")
def topological_levels(spark, d):
    e = J.sparse(spark, d).where("cast(substring(src, 2) as int) < cast(substring(dst, 2) as int)")
    return graph.levels(e)


# History


@query(f"WITH {HIST} SELECT count(*) AS read, CAST(sum((class = 'counted')::BIGINT) AS BIGINT) AS counted, CAST(sum((class = 'large')::BIGINT) AS BIGINT) AS large, CAST(sum((class = 'merge')::BIGINT) AS BIGINT) AS merge, CAST(sum((class = 'boundary')::BIGINT) AS BIGINT) AS boundary FROM cl")
def co_change_counts(spark, d):
    return history.tallies(history.classified(J.commits(spark, d), J.changes(spark, d), max_files=6))


_CO = f"{HIST}, own AS (SELECT ch.* FROM ch JOIN cl ON cl.id = commit AND class = 'counted'), hit AS (SELECT DISTINCT commit FROM own WHERE path IN ('p1', 'p2', 'p3', 'p5')), sh AS (SELECT path, count(*) AS shared FROM own WHERE commit IN (SELECT commit FROM hit) AND path NOT IN ('p1', 'p2', 'p3', 'p5') GROUP BY 1), ow AS (SELECT path, count(*) AS own FROM own GROUP BY 1), t AS (SELECT path, shared, own, (SELECT count(*) FROM hit) AS total FROM sh JOIN ow USING (path))"


@query(f"WITH {_CO} SELECT path, shared, own, total, row_number() OVER (ORDER BY (shared * 1000000000000) // (total + own) DESC, shared DESC, path) AS place FROM t QUALIFY place <= 30")
def co_change_top(spark, d):
    counted = history.classified(J.commits(spark, d), J.changes(spark, d), max_files=6).where("class = 'counted'")
    t = history.co_changed(J.changes(spark, d), counted, spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p5",)], "path string"))
    top = t.orderBy(F.desc(F.expr("cast(shared as decimal(20,0)) * 1000000000000 div (total + own)")), F.desc("shared"), F.asc("path")).limit(30)
    return history.degree_order(top).select("path", "shared", "own", "total", F.col("place").cast("long").alias("place"))


@query(f"WITH {HIST} SELECT commit, path FROM ch JOIN orders ON commit = 'o' || o_orderkey WHERE o_orderpriority = '1-URGENT'")
def commit_files(spark, d):
    urgent = J.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(J.named("o", "o_orderkey").alias("id"))
    return history.commit_files(J.changes(spark, d), urgent)


# Work


def _links(spark, d):
    items = J.table(spark, d, "orders").select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "F", F.lit("2024")).alias("merged_at"), F.when(F.col("o_orderkey") % 5 == 0, J.named("p", "o_custkey")).alias("merge_commit"))
    per = J.table(spark, d, "lineitem").where("l_linenumber <= 2 and l_returnflag = 'A'").select(F.col("l_orderkey").alias("number"), J.named("p", "l_partkey").alias("sha")).distinct()
    known = J.table(spark, d, "part").where("p_size <= 25").select(J.named("p", "p_partkey").alias("id"))
    return items, known, work.commits_of_items(items, per, known)


_LINKS = "it AS (SELECT o_orderkey AS number, o_orderstatus = 'F' AS merged, CASE WHEN o_orderkey % 5 = 0 THEN 'p' || o_custkey END AS mc FROM orders), known AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size <= 25), ln AS (SELECT DISTINCT id, number FROM (SELECT 'p' || l_partkey AS id, l_orderkey AS number FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag = 'A' UNION ALL SELECT mc, number FROM it WHERE mc IS NOT NULL) WHERE id IN (SELECT id FROM known))"


@query(f"WITH {_LINKS} SELECT id, number FROM ln")
def work_links(spark, d):
    return _links(spark, d)[2]


@query(f"WITH {_LINKS} SELECT id FROM known WHERE id NOT IN (SELECT id FROM ln)")
def unlinked_commits(spark, d):
    _, known, links = _links(spark, d)
    return work.unlinked(known, links)


@query(f"WITH {_LINKS} SELECT number FROM it WHERE merged AND number NOT IN (SELECT number FROM ln)")
def unmatched_items(spark, d):
    items, _, links = _links(spark, d)
    return work.unmatched(items, links).select("number")


@query(f"WITH {_LINKS}, f AS (SELECT DISTINCT 'p' || l_partkey AS commit, 's' || l_suppkey AS path FROM lineitem), ow AS (SELECT 's' || s_suppkey AS path, 'N' || s_nationkey AS component FROM supplier) SELECT number, component, count(DISTINCT path) AS files FROM ln JOIN f ON f.commit = ln.id JOIN ow USING (path) GROUP BY ALL")
def code_by_component(spark, d):
    files = J.table(spark, d, "lineitem").select(J.named("p", "l_partkey").alias("commit"), J.named("s", "l_suppkey").alias("path")).distinct()
    owners = J.table(spark, d, "supplier").select(J.named("s", "s_suppkey").alias("path"), J.named("N", "s_nationkey").alias("component"))
    return work.code_of_items(_links(spark, d)[2], files, owners)


@query("WITH x AS (SELECT DISTINCT l_orderkey AS number, l_partkey AS path, l_returnflag FROM lineitem) SELECT number, count(DISTINCT path) AS paths FROM x a WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.number = a.number AND b.path = a.path AND b.l_returnflag <> 'N') GROUP BY 1")
def mention_only(spark, d):
    x = J.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_partkey").alias("path"), "l_returnflag")
    return work.only_mentioned(x.where("l_returnflag <> 'N'"), x.where("l_returnflag = 'N'"))


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'closes' WHEN 'N' THEN 'linked' ELSE 'cross_referenced' END AS type, l_suppkey AS \"from\", l_partkey % 50 AS \"to\", '' AS at, string_agg(DISTINCT l_linestatus, ' ' ORDER BY l_linestatus) AS observed, arg_min(CASE WHEN l_linenumber > 2 THEN l_quantity > 25 END, CASE WHEN l_linenumber > 2 THEN l_orderkey * 1000000 + l_partkey * 10 + l_linenumber END) AS will_close FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus) GROUP BY ALL")
def relation_normalize(spark, d):
    li = J.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("x")).select("*", "x.*")
    kind = F.when(F.col("l_returnflag") == "A", "closes").when(F.col("l_returnflag") == "N", "linked").otherwise("cross_referenced")
    rows = li.select(kind.alias("type"), F.col("l_suppkey").alias("from"), (F.col("l_partkey") % 50).alias("to"), F.lit("").alias("at"), F.array("l_linestatus").alias("observed"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity") > 25).alias("will_close"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return relations.normalized_relations(rows, "seq").withColumn("observed", F.array_join("observed", " "))


_READS = "SELECT user_id AS number, event_type AS state, event_id AS read_at, floor(epoch(ts))::BIGINT AS changed FROM events"


def _reads(spark, d):
    return J.table(spark, d, "events").select(F.col("user_id").alias("number"), F.col("event_type").alias("state"), F.col("event_id").alias("read_at"), F.unix_timestamp("ts").alias("changed"))


@query(f"SELECT number, arg_max(state, read_at) AS state, max(read_at) AS read_at, arg_max(changed, read_at) AS changed FROM ({_READS}) GROUP BY 1")
def keep_last(spark, d):
    return relations.keep_last(_reads(spark, d), ["number"], [F.col("read_at")])


_CUT = 1705276800  # 2024-01-15


@query(f"WITH r AS ({_READS}), held AS (SELECT number, arg_max(state, read_at) AS state, max(read_at) AS read_at, arg_max(changed, read_at) AS changed FROM r WHERE changed < {_CUT} GROUP BY 1), up AS (SELECT * FROM r WHERE changed >= {_CUT} - 300) SELECT number, arg_max(state, read_at) AS state, max(read_at) AS read_at, arg_max(changed, read_at) AS changed FROM (SELECT * FROM held UNION ALL SELECT * FROM up) GROUP BY 1")
def incremental_overlap(spark, d):
    r = _reads(spark, d)
    held = relations.keep_last(r.where(F.col("changed") < _CUT), ["number"], [F.col("read_at")])
    return work.merge_items(held, work.since(r, "changed", _CUT))


_REL = "SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'closes' ELSE 'linked' END AS type, l_suppkey % 200 AS a, l_partkey % 200 AS b, CASE WHEN l_returnflag = 'A' THEN l_suppkey % 200 ELSE l_partkey % 200 END AS rec FROM lineitem WHERE l_suppkey % 200 <> l_partkey % 200"


@query(f"WITH x AS ({_REL}), held AS (SELECT * FROM x WHERE (a + b) % 3 <> 0), rd AS (SELECT * FROM x WHERE (a + b) % 3 = 0 AND (a < 20 OR b < 20)), kept AS (SELECT * FROM held WHERE NOT (a < 20 AND b < 20) AND NOT ((a < 20 OR b < 20) AND rec < 20)) SELECT type, a, b, string_agg(DISTINCT rec, ' ' ORDER BY rec) AS recorded FROM (SELECT * FROM kept UNION ALL SELECT * FROM rd) GROUP BY ALL")
def snapshot_merge(spark, d):
    li = J.table(spark, d, "lineitem")
    a, b = F.col("l_suppkey") % 200, F.col("l_partkey") % 200
    x = li.select(F.when(F.col("l_linenumber") % 2 == 0, "closes").otherwise("linked").alias("type"), a.alias("a"), b.alias("b"), F.when(F.col("l_returnflag") == "A", a).otherwise(b).alias("rec")).where("a <> b").distinct()
    x = x.groupBy("type", "a", "b").agg(F.array_sort(F.collect_set("rec")).alias("recorded"))
    held, read = x.where("(a + b) % 3 <> 0"), x.where("(a + b) % 3 = 0 and (a < 20 or b < 20)")
    m = work.merge_relations(held, read, spark.range(20).select(F.col("id").alias("number")))
    return m.withColumn("recorded", F.array_join(F.transform("recorded", lambda v: v.cast("string")), " "))


# Names and texts


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9]*(?:[0-9][A-Za-z]|[A-Za-z][0-9])[A-Za-z0-9]*\b', '#', 'g'), '(://)[^/@\s]+@', '\1', 'g')) AS masked FROM documents")
def mask_mixed_words(spark, d):
    t = J.table(spark, d, "documents")
    return t.select("doc_id", F.sha2(X.without_credentials(F.regexp_replace("text", r"\b[A-Za-z0-9]*(?:[0-9][A-Za-z]|[A-Za-z][0-9])[A-Za-z0-9]*\b", "#")), 256).alias("masked"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda w: length(w) >= 32 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]'))) AS masked FROM documents")
def redact_tokens(spark, d):
    """Long mixed tokens that redaction masks in each document."""
    t = J.table(spark, d, "documents").select("doc_id", "text", X.masked_tokens(F.col("text")).alias("safe"))
    gone = lambda c: F.size(F.filter(F.expr(f"regexp_extract_all({c}, '[A-Za-z0-9_-]+', 0)"), lambda w: (F.length(w) >= 32) & w.rlike("[0-9]") & w.rlike("[A-Za-z]")))
    return t.select("doc_id", (gone("text") - gone("safe")).cast("long").alias("masked"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1) AS path, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/?(.*)$', 1), '^.*/', '') AS base FROM pages")
def url_parts(spark, d):
    p = J.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+/?(.*)$", 1).alias("path"))
    return p.withColumn("base", P.base(F.col("path")))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY ALL")
def page_links(spark, d):
    return J.table(spark, d, "pages").select("page_id", F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)")).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line, length(text) - strrpos AS col FROM (SELECT doc_id, text, length(text) - length(string_split(text, chr(10))[-1]) - 1 AS strrpos FROM documents)")
def line_offsets(spark, d):
    """Where each whole text ends."""
    t = J.table(spark, d, "documents")
    end = F.length("text")
    return t.select("doc_id", X.line_of(F.col("text"), end).cast("long").alias("line"), X.column_of(F.col("text"), end).cast("long").alias("col"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS minute FROM orders")
def time_labels(spark, d):
    o = J.table(spark, d, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("s"))
    return o.select("o_orderkey", X.rfc3339(F.col("s")).alias("stamp"), X.epoch(X.rfc3339(F.col("s"))).alias("seconds"), X.day(X.rfc3339(F.col("s"))).alias("day"), X.minute(F.col("s")).alias("minute"))


@query("SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS seconds FROM part")
def duration_parse(spark, d):
    unit = F.element_at(F.array(*map(F.lit, "smhd")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return J.table(spark, d, "part").select("p_partkey", X.duration(F.concat(F.col("p_size").cast("string"), unit)).alias("seconds"))


@query("WITH x AS (SELECT p_partkey, lower(p_name) AS n, 'al' || 'mo' AS w FROM part), l AS (SELECT 'P' || p_partkey AS id, n AS name, 'blue' AS wanted, CASE WHEN n = 'blue' THEN 0 WHEN starts_with(n, 'blue') THEN 1 WHEN len(list_filter(regexp_split_to_array(n, '[-_./:\\s]'), lambda p: starts_with(p, 'blue'))) > 0 THEN 2 WHEN contains(n, 'blue') THEN 3 WHEN contains(regexp_replace(n, '[-_./:\\s]', '', 'g'), 'blue') THEN 4 END AS level, p_partkey % 7 = 0 AS test FROM x) SELECT wanted, id, name, row_number() OVER w AS place, CAST(level AS INTEGER) AS level, greatest(count(*) OVER () - 10, 0) AS rest FROM l WHERE level IS NOT NULL WINDOW w AS (ORDER BY level, test, length(name), id) QUALIFY place <= 10")
def near_match_rank(spark, d):
    n = J.table(spark, d, "part").select(J.named("P", "p_partkey").alias("id"), F.lower("p_name").alias("name"), F.lit("part").alias("kind"), (F.col("p_partkey") % 7 == 0).alias("test"))
    return lookups.near_matches(n, spark.createDataFrame([("blue",)], "wanted string")).withColumn("place", F.col("place").cast("long"))


@query("WITH w AS (SELECT DISTINCT 'x' || (o_custkey % 400) AS target FROM orders), s AS (SELECT target, 'S' || s_suppkey AS found, 0 AS step FROM w JOIN supplier ON target = 'x' || s_suppkey UNION ALL SELECT target, 'C' || c_custkey, 1 FROM w JOIN customer ON target = 'x' || (c_custkey % 200) UNION ALL SELECT target, 'P' || p_partkey, 2 FROM w JOIN part ON target = 'x' || (p_partkey + 100)), m AS (SELECT target, min(step) AS step FROM s GROUP BY 1) SELECT target, step, min(found) AS found, count(DISTINCT found) AS answers FROM s JOIN m USING (target, step) GROUP BY ALL")
def resolve_cascade(spark, d):
    t = lambda n: J.table(spark, d, n)
    w = t("orders").select(F.concat(F.lit("x"), F.col("o_custkey") % 400).alias("target")).distinct()
    steps = [t("supplier").select(J.named("x", "s_suppkey").alias("target"), J.named("S", "s_suppkey").alias("found")), t("customer").select(F.concat(F.lit("x"), F.col("c_custkey") % 200).alias("target"), J.named("C", "c_custkey").alias("found")), t("part").select(F.concat(F.lit("x"), F.col("p_partkey") + 100).alias("target"), J.named("P", "p_partkey").alias("found"))]
    return lookups.cascade(w, "target", steps)


@query("WITH i AS (SELECT DISTINCT lower(replace(p_name, ' ', '.')) AS module FROM part), dec AS (SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS name FROM part WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey % 40 = 0), up AS (SELECT module, unnest(list_transform(range(1, len(string_split(module, '.')) + 1), lambda k: array_to_string(string_split(module, '.')[1:k], '.'))) AS prefix FROM i), j AS (SELECT module, arg_max(name, length(prefix)) AS distribution FROM up JOIN dec ON replace(prefix, '.', '-') = name GROUP BY 1) SELECT module, distribution, 'name' AS how FROM j")
def import_distribution_match(spark, d):
    p = J.table(spark, d, "part")
    imports = p.select(F.lower(F.translate("p_name", " ", ".")).alias("module")).distinct()
    declared = p.where("p_partkey % 3 = 0").select(F.lower(F.translate("p_name", " ", "-")).alias("name")).unionByName(p.where("p_partkey % 40 = 0").select(F.lower(F.substring_index("p_name", " ", 1)).alias("name"))).distinct()
    return lookups.distributions(imports, declared, spark.createDataFrame([], "prefix string, distribution string"), spark.createDataFrame([], "top string, distribution string"))


@query("SELECT CASE p_size % 5 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'TypeScript' ELSE 'Go' END AS language, count(*) AS files, CASE WHEN bool_or(p_size % 5 < 3) THEN CAST(sum((p_retailprice > 1000)::BIGINT) AS BIGINT) END AS read, CAST(sum((p_partkey % 9 = 0)::BIGINT) AS BIGINT) AS scripts FROM part WHERE p_size % 5 < 4 GROUP BY 1")
def language_coverage(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("py", "rs", "ts", "go", "txt"))), (F.col("p_size") % 5 + 1).cast("int"))
    files = J.table(spark, d, "part").select(ext.alias("ext"), (F.col("p_retailprice") > 1000).alias("read"), (F.col("p_partkey") % 9 == 0).alias("script"))
    known = spark.createDataFrame([("py", "Python", True), ("rs", "Rust", True), ("ts", "TypeScript", True), ("go", "Go", False)], "ext string, language string, analyzed boolean")
    return relations.coverage(files, known)


@query("SELECT event_type AS key, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def hidden_link_sums(spark, d):
    e = J.table(spark, d, "events").select(F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("long")).alias("links"))
    return relations.summed_maps(e, "links")


def stream_keep_last(spark, d):
    """The items of keep_last, kept by a stream over the same files."""
    from tessera.streaming.snapshot import kept_by_stream

    return kept_by_stream(spark, f"{d}/events.parquet")


query(SQL["keep_last"])(stream_keep_last)


_RENAMES = """c AS (
  SELECT 'o' || l_orderkey AS commit, 'p' || l_partkey AS path, -l_orderkey AS place,
    CASE WHEN min(l_linenumber) = 1 AND l_orderkey % 3 = 0 THEN 'p' || (l_partkey % 50 + 1) END AS renamed_from, min(l_linenumber) = 2 AND l_orderkey % 5 = 0 AS added
  FROM lineitem GROUP BY l_orderkey, l_partkey
),
ev AS (SELECT path, place, max(t) AS t FROM (SELECT path, place, NULL AS t FROM c WHERE added OR renamed_from IS NOT NULL UNION ALL SELECT renamed_from, place, path FROM c WHERE renamed_from IS NOT NULL) GROUP BY ALL),
node AS (SELECT m.path, m.place, m.t, e.place AS ep, e.t AS et FROM ev m ASOF LEFT JOIN ev e ON m.t = e.path AND m.place > e.place WHERE m.t IS NOT NULL)"""


@query(f"WITH RECURSIVE {_RENAMES}, walk AS (SELECT path, place, t, ep, et FROM node UNION ALL SELECT w.path, w.place, n.t, n.ep, n.et FROM walk w JOIN node n ON n.path = w.t AND n.place = w.ep WHERE w.et IS NOT NULL) SELECT c.commit, c.path, CASE WHEN e.t IS NULL THEN c.path ELSE w.t END AS now FROM c ASOF LEFT JOIN ev e ON c.path = e.path AND c.place > e.place LEFT JOIN walk w ON w.path = c.path AND w.place = e.place AND w.et IS NULL")
def rename_identity(spark, d):
    """Orders as commits, the latest key newest: a third of them rename the part of their first line, a fifth add that of their second."""
    li = J.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n"))
    moved = (F.col("n") == 1) & (F.col("l_orderkey") % 3 == 0)
    kind = F.when(moved, "renamed").when((F.col("n") == 2) & (F.col("l_orderkey") % 5 == 0), "added").otherwise("modified")
    changes = li.select(J.named("o", "l_orderkey").alias("commit"), J.named("p", "l_partkey").alias("path"), kind.alias("kind"), F.when(moved, F.concat(F.lit("p"), (F.col("l_partkey") % 50 + 1).cast("string"))).alias("renamed_from"))
    commits = J.table(spark, d, "orders").select(J.named("o", "o_orderkey").alias("id"), F.array().cast("array<string>").alias("parents"), (-F.col("o_orderkey")).alias("pos"))
    return history.identities(commits, changes)


_IMPACT = """e AS (SELECT DISTINCT 'f' || l_partkey AS src, 'f' || (l_suppkey * 3) AS dst, l_returnflag = 'R' AS test FROM lineitem WHERE l_linenumber < 3),
ow AS (SELECT 'f' || p_partkey AS file, 'K' || p_partkey % 50 AS component, p_partkey % 50 >= 45 AS test FROM part),
pw AS (SELECT 'f3' AS id, 0 AS d UNION SELECT e.src, pw.d + 1 FROM pw JOIN e ON e.dst = pw.id WHERE NOT e.test AND pw.d < 30),
aw AS (SELECT 'f3' AS id, 0 AS d UNION SELECT e.src, aw.d + 1 FROM aw JOIN e ON e.dst = aw.id WHERE aw.d < 30),
p AS (SELECT id, min(d) AS d FROM pw GROUP BY 1), a AS (SELECT id, min(d) AS d FROM aw GROUP BY 1)"""


@query(f"WITH RECURSIVE {_IMPACT} SELECT p.id, 'file' AS kind, p.d AS distance, min(q.id) AS hop, false AS test FROM p LEFT JOIN (SELECT e.src, q.id, q.d FROM e JOIN p q ON q.id = e.dst WHERE NOT e.test) q ON q.src = p.id AND q.d + 1 = p.d GROUP BY p.id, p.d UNION ALL SELECT component, 'component', min(d), arg_min(id, (d, id)), false FROM p JOIN ow ON file = id WHERE NOT test GROUP BY 1 UNION ALL SELECT a.id, 'file', a.d, min(q.id), true FROM a JOIN ow ON ow.file = a.id AND ow.test JOIN (SELECT e.src, q.id, q.d FROM e JOIN a q ON q.id = e.dst) q ON q.src = a.id AND q.d + 1 = a.d WHERE a.id NOT IN (SELECT id FROM p) GROUP BY a.id, a.d")
def impact_reach(spark, d):
    """Parts as files: a line item makes its part load the file of three times its supplier's number; file 3 changes."""
    edges = J.table(spark, d, "lineitem").where("l_linenumber < 3").select(J.named("f", "l_partkey").alias("src"), F.concat(F.lit("f"), (F.col("l_suppkey") * 3).cast("string")).alias("dst"), (F.col("l_returnflag") == "R").alias("test")).distinct()
    owners = J.table(spark, d, "part").select(J.named("f", "p_partkey").alias("file"), F.concat(F.lit("K"), (F.col("p_partkey") % 50).cast("string")).alias("component"), (F.col("p_partkey") % 50 >= 45).alias("test"))
    return graph.impact(edges, owners, spark.range(1).select(F.lit("f3").alias("file"))).withColumn("distance", F.col("distance").cast("int"))


# Symbols and sets

_IMPORTS = f"{J.sparse_sql()}, im AS (SELECT DISTINCT src AS file, line, dst AS target, CASE WHEN line = 1 THEN '*' ELSE scope END AS name, line % 2 = 0 AS passes_on FROM sp)"


@query(f"WITH RECURSIVE {_IMPORTS}, s(symbol, file, name) AS (SELECT 'N1::module', 'N1', 'module' UNION SELECT s.symbol, im.file, CASE WHEN im.name = '*' THEN s.name ELSE im.name END FROM s JOIN im ON im.target = s.file AND (im.name = s.name OR im.name = '*') WHERE im.passes_on) SELECT DISTINCT s.symbol, im.file, im.line, im.target AS through, CASE WHEN im.name = '*' THEN 'whole' ELSE 'name' END AS kind FROM im JOIN s ON im.target = s.file AND (im.name = s.name OR im.name = '*')")
def symbol_importers(spark, d):
    im = J.sparse(spark, d).select(F.col("src").alias("file"), "line", F.col("dst").alias("target"), F.when(F.col("line") == 1, "*").otherwise(F.col("scope")).alias("name"), F.lit(None).cast("string").alias("alias"), (F.col("line") % 2 == 0).alias("passes_on")).distinct()
    return uses.symbol_importers(im, spark.createDataFrame([("N1::module", "N1", "module")], "symbol string, file string, name string"))


@query(f"WITH {EV}, m AS (SELECT src AS test, dst AS way, min(line) AS steps, min(CASE WHEN NOT test THEN line END) AS running FROM ev GROUP BY ALL) SELECT test, way, steps, coalesce(running = steps, false) AS runs, running FROM m")
def best_routes(spark, d):
    e = J.evidence(spark, d)
    return uses.best_routes(e.select(F.col("src").alias("test"), F.col("dst").alias("way"), F.col("line").alias("steps"), (~F.col("test")).alias("runs")))


@query("SELECT id FROM (SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) UNION SELECT p_partkey FROM part WHERE p_size = 1")
def tests_only(spark, d):
    li, key = J.table(spark, d, "lineitem"), F.col("l_partkey").alias("id")
    return uses.only_tests(li.where("l_returnflag = 'R'").select(key).distinct(), li.where("l_returnflag = 'A' and l_quantity > 40").select(key).distinct(), J.table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("id")))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT p_partkey FROM part WHERE p_size > 20")
def loaded_by_listed(spark, d):
    return uses.loaded_by_listed(J.table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("id")), J.table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("id")))


@query("SELECT 'p' || l_partkey AS file FROM lineitem WHERE l_quantity > 49 UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'p' || p_partkey FROM part WHERE p_size < 3")
def known_files(spark, d):
    t = lambda n: J.table(spark, d, n)
    return uses.known_files(t("lineitem").where("l_quantity > 49").select(J.named("p", "l_partkey").alias("file")), t("supplier").select(J.named("s", "s_suppkey").alias("file")), t("part").where("p_size < 3").select(J.named("p", "p_partkey").alias("file")))


@query("WITH c AS (SELECT 'P' || p_partkey AS id, p_name AS name FROM part) SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN id ELSE name END AS shown FROM c")
def display_names(spark, d):
    return uses.display_names(J.table(spark, d, "part").select(J.named("P", "p_partkey").alias("id"), F.col("p_name").alias("name")))


@query(f"WITH {EV}, {FOLD}, p AS (SELECT DISTINCT a.n AS src, file, line FROM ev JOIN leaf a ON a.id = src), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY file, line) AS n, count(*) OVER (PARTITION BY src) AS total FROM p) SELECT src, string_agg(file || ':' || line, ' ' ORDER BY n) AS places, any_value(total) AS total FROM r WHERE n <= 3 GROUP BY src")
def capped_evidence(spark, d):
    e = J.evidence(spark, d).join(graph.folded(J.components(spark, d), 1).select(F.col("id").alias("src"), "at"), "src")
    first = uses.first_evidence(e.select(F.col("at").alias("src"), "file", "line"), ["src"])
    return first.select("src", F.array_join(F.transform("places", lambda p: F.concat(p["file"], F.lit(":"), p["line"].cast("string"))), " ").alias("places"), "total")


@query(f"WITH {_LINKS} SELECT number, max(p_partkey * 7 % 1000) AS newest FROM ln JOIN part ON ln.id = 'p' || p_partkey GROUP BY 1")
def newest_commits(spark, d):
    commits = J.table(spark, d, "part").select(J.named("p", "p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1000).alias("time"))
    return uses.newest(_links(spark, d)[2], commits)


@query(f"WITH {_FILES} SELECT file, regexp_replace(file, '/[^/]*$', '') AS parent, regexp_extract(file, '\\.([^./]+)$', 1) AS extension, regexp_replace(regexp_replace(file, '^.*/', ''), '\\.[^.]*$', '') AS stem, len(string_split(file, '/')) + 1 AS ancestors FROM files")
def path_parts(spark, d):
    f = _files(spark, d)
    p = F.col("file")
    return f.select("file", P.parent(p).alias("parent"), P.extension(p).alias("extension"), P.stem(p).alias("stem"), F.size(P.ancestors(p)).cast("long").alias("ancestors"))


@query(r"SELECT p_partkey, lower(regexp_replace(p_name || '_' || p_brand, '[-_. ]+', '-', 'g')) AS distribution, split_part(p_type, ' ', 1) || '/' || split_part(p_type, ' ', 2) AS specifier, split_part(p_type, ' ', 1) AS package, '@types/' || split_part(p_type, ' ', 1) AS types FROM part")
def package_names(spark, d):
    p = J.table(spark, d, "part")
    spec = F.concat_ws("/", F.element_at(F.split("p_type", " "), 1), F.coalesce(F.try_element_at(F.split("p_type", " "), F.lit(2)), F.lit("")))
    return p.select("p_partkey", P.distribution(F.translate(F.concat("p_name", F.lit("_"), "p_brand"), " ", "-")).alias("distribution"), spec.alias("specifier"), P.npm_package(spec).alias("package"), P.types_package(P.npm_package(spec)).alias("types"))


# What runs before what, declarations, notes, answers of a work tracker


@query(f"WITH {COMP}, e AS (SELECT id AS \"at\", 'main/' || id AS entry FROM comp WHERE id LIKE 'N%' OR id LIKE 'R%' OR id LIKE 'S%') SELECT comp.id, e.at AS \"at\", entry FROM comp JOIN e ON e.at = comp.id OR e.at = comp.parent WHERE e.at NOT LIKE 'R%' AND comp.kind = 'module'")
def entries_above(spark, d):
    c = J.components(spark, d)
    entries = c.where("id rlike '^[NRS]'").select(F.col("id").alias("at"), F.concat(F.lit("main/"), "id").alias("entry"))
    return loading.entries_above(c, entries)


_RUN = "own AS (SELECT 'c' || c_custkey AS file, 'C' || c_custkey AS component, 'C' || c_custkey AS id, 'N' || c_nationkey AS n, c_custkey % 5 = 0 AS test FROM customer UNION ALL SELECT 's' || s_suppkey, 'S' || s_suppkey, 'S' || s_suppkey, 'N' || s_nationkey, false FROM supplier)"


def _run(spark, d):
    c = J.components(spark, d)
    above = loading.entries_above(c, c.where("id like 'N%'").select(F.col("id").alias("at"), F.concat(F.lit("main/"), "id").alias("entry")))
    owners = c.where("id rlike '^[CS]'").select(F.lower("id").alias("file"), F.col("id").alias("component"), (F.startswith("id", F.lit("C")) & (F.substring("id", 2, 20).cast("long") % 5 == 0)).alias("test"))
    return owners, above


@query(f"WITH {_RUN} SELECT 'main/' || n AS entry, file, test FROM own")
def files_below_entries(spark, d):
    return loading.files_below(*_run(spark, d))


@query(f"WITH {EV}, {_RUN} SELECT DISTINCT 'main/' || t.n AS entry, src, ev.file, ev.line FROM ev JOIN own t ON t.file = lower(ev.dst) JOIN own s ON s.id = ev.src WHERE s.n <> t.n")
def statements_running_first(spark, d):
    owners, above = _run(spark, d)
    return loading.running_first(J.evidence(spark, d).select("src", "file", "line", F.lower("dst").alias("target")), owners, above)


@query(f"WITH {COMP}, {FOLD} SELECT id, r AS package FROM leaf UNION ALL SELECT id, CASE WHEN kind = 'package' THEN id ELSE parent END FROM comp WHERE id LIKE 'N%' OR id LIKE 'R%'")
def nearest_packages(spark, d):
    return loading.nearest_packages(J.components(spark, d))


_UNITS = "u AS (SELECT l_partkey AS k, list_sort(list_distinct(list('u' || l_suppkey % 4))) AS units FROM lineitem WHERE l_quantity > 40 GROUP BY 1)"


@query(f"WITH {_UNITS} SELECT 'p' || k AS file, array_to_string(units, ' ') AS units FROM u")
def build_units(spark, d):
    li = J.table(spark, d, "lineitem").where("l_quantity > 40")
    u = loading.build_units(li.select(J.named("p", "l_partkey").alias("file"), F.concat(F.lit("u"), (F.col("l_suppkey") % 4).cast("string")).alias("unit")))
    return u.select("file", F.array_join("units", " ").alias("units"))


@query(f"WITH {_UNITS}, p AS (SELECT a.k, a.units AS h, b.units AS t, CASE WHEN a.k % 3 = 0 THEN ['u1'] END AS act FROM u a JOIN u b ON b.k = a.k + 1), w AS (SELECT *, CASE WHEN len(h) > 1 AND act IS NOT NULL THEN act ELSE h END AS walked FROM p), x AS (SELECT k, h, t, walked, NOT list_has_any(h, t) AS crossing FROM w) SELECT k, CASE WHEN crossing AND len(h) > 1 AND NOT list_has_any(walked, ['u0', 'u2']) THEN 'no' WHEN crossing THEN CASE WHEN len(t) > 1 THEN array_to_string(t, ' ') ELSE 'any' END WHEN NOT list_has_any(walked, t) THEN 'no' WHEN len(t) > 1 THEN array_to_string(list_sort(list_intersect(t, walked)), ' ') ELSE 'any' END AS entered FROM x")
def units_entered(spark, d):
    li = J.table(spark, d, "lineitem").where("l_quantity > 40")
    u = loading.build_units(li.select(F.col("l_partkey").alias("file"), F.concat(F.lit("u"), (F.col("l_suppkey") % 4).cast("string")).alias("unit")))
    both = u.select(F.col("file").alias("k"), F.col("units").alias("h")).join(u.select((F.col("file") - 1).alias("k"), F.col("units").alias("t")), "k")
    active = F.when(F.col("k") % 3 == 0, F.array(F.lit("u1")))
    found = loading.entered(F.col("h"), F.col("t"), active, F.array(F.lit("u0"), F.lit("u2")))
    return both.select("k", F.when(found.isNull(), "any").when(F.size(found) == 0, "no").otherwise(F.array_join(F.array_sort(found), " ")).alias("entered"))


@query("SELECT DISTINCT 'o' || l_orderkey AS file, 'p' || l_partkey AS target FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_linestatus = 'O')")
def mock_replacements(spark, d):
    li = J.table(spark, d, "lineitem")
    return loading.replaced(li.select(J.named("o", "l_orderkey").alias("file"), J.named("p", "l_partkey").alias("target"), (F.col("l_returnflag") == "R").alias("replaces"), (F.col("l_linestatus") == "O").alias("real")))


@query("WITH l AS (SELECT DISTINCT o_orderpriority AS file, o_orderdate AS line, CASE WHEN o_orderstatus = 'P' THEN 'x' END AS target FROM orders WHERE o_totalprice > 300000) SELECT DISTINCT o_orderpriority AS file, o_orderdate AS line, CASE WHEN o_orderstatus = 'P' THEN 'x' END AS target, o_custkey AS note FROM orders JOIN l ON l.file = o_orderpriority AND l.line IS NOT DISTINCT FROM o_orderdate AND l.target IS NOT DISTINCT FROM CASE WHEN o_orderstatus = 'P' THEN 'x' END")
def same_line_siblings(spark, d):
    o = J.table(spark, d, "orders").withColumns({"file": F.col("o_orderpriority"), "line": F.col("o_orderdate"), "target": F.when(F.col("o_orderstatus") == "P", "x"), "note": F.col("o_custkey")})
    return loading.with_siblings(o.select("file", "line", "target", "note"), o.where("o_totalprice > 300000"))


_TAKE = "tk AS (SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS package, 'o' || l_orderkey AS file, l_linenumber AS line, 's' || l_partkey % 3 AS specifier, CASE WHEN l_quantity > 45 THEN '*' ELSE l_returnflag END AS taken FROM lineitem JOIN orders ON l_orderkey = o_orderkey), wn AS (SELECT 'S' || s_suppkey AS package, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'R' END AS name FROM supplier)"


def _take(spark, d):
    li = J.table(spark, d, "lineitem").join(J.table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    names = F.array(F.when(F.col("l_quantity") > 45, "*").otherwise(F.col("l_returnflag")))
    return li.select(J.named("C", "o_custkey").alias("src"), J.named("S", "l_suppkey").alias("dst"), J.named("o", "l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string")).alias("specifier"), names.alias("names"))


@query(f"WITH {_TAKE}, n AS (SELECT tk.*, name FROM tk JOIN wn USING (package) WHERE taken = name) SELECT DISTINCT package, name, src, file, line, false AS whole FROM n UNION SELECT DISTINCT tk.package, b.name, src, file, line, true FROM tk JOIN (SELECT DISTINCT package, name, specifier FROM n) b USING (package, specifier) WHERE taken = '*'")
def package_name_statements(spark, d):
    wanted = J.table(spark, d, "supplier").select(J.named("S", "s_suppkey").alias("package"), F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("R").alias("name"))
    return loading.taking(_take(spark, d), wanted)


@query(f"WITH {_TAKE} SELECT DISTINCT taken AS name, package FROM tk WHERE taken IN (SELECT DISTINCT name FROM wn)")
def packages_taking(spark, d):
    names = J.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("R").alias("name"))
    return loading.packages_taking(_take(spark, d), names)


@query(f"WITH {EV}, {FOLD}, x AS (SELECT b.n AS id, src, file, line, bool_or(NOT test) AS p, bool_or(test) AS t FROM ev JOIN leaf a ON a.id = src JOIN leaf b ON b.id = dst WHERE a.n <> b.n GROUP BY ALL) SELECT id, src, count(*) FILTER (p) AS production, count(*) FILTER (t) AS tests FROM x GROUP BY ALL")
def statements_into_subtree(spark, d):
    c = J.components(spark, d)
    return loading.into_subtree(J.evidence(spark, d), c, c.where("id like 'N%'").select("id"))


@query("WITH x AS (SELECT 'm' || l_suppkey AS manifest, 'p' || l_partkey AS name, CASE l_linenumber % 3 WHEN 0 THEN 'dependencies' WHEN 1 THEN 'peerDependencies' ELSE 'devDependencies' END AS section, '^' || CAST(l_quantity AS INT) AS version FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY manifest, name ORDER BY list_position(['dependencies', 'peerDependencies', 'devDependencies'], section), version) AS k FROM x) SELECT manifest, name, section, version FROM r WHERE k = 1")
def nearest_declarations(spark, d):
    section = F.element_at(F.array(*map(F.lit, ("dependencies", "peerDependencies", "devDependencies"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    li = J.table(spark, d, "lineitem").select(J.named("m", "l_suppkey").alias("manifest"), J.named("p", "l_partkey").alias("name"), section.alias("section"), F.concat(F.lit("^"), F.col("l_quantity").cast("int").cast("string")).alias("version"))
    return loading.nearest_declarations(li, ["dependencies", "peerDependencies", "devDependencies"])


@query("WITH code AS (SELECT DISTINCT 'n' || s_nationkey AS a, 'n' || s_nationkey || '/' || s_suppkey % 7 AS b FROM supplier), q AS (SELECT DISTINCT 'n' || c_nationkey AS a, 'n' || c_nationkey || '/' || c_custkey % 11 AS b FROM customer) SELECT b || '/requirements.txt' AS file, CASE WHEN b IN (SELECT b FROM code) THEN b WHEN a IN (SELECT a FROM code) THEN a ELSE '' END AS scope FROM q")
def requirement_scopes(spark, d):
    c, s = J.table(spark, d, "customer"), J.table(spark, d, "supplier")
    at = lambda n, k, m: F.concat(J.named("n", n), F.lit("/"), (F.col(k) % m).cast("string"))
    return loading.requirement_scopes(c.select(F.concat(at("c_nationkey", "c_custkey", 11), F.lit("/requirements.txt")).alias("file")), s.select(F.concat(at("s_nationkey", "s_suppkey", 7), F.lit("/a.py")).alias("file")))


@query("WITH f AS (SELECT DISTINCT 'N' || s_nationkey || '.s' || s_suppkey % 3 AS name, 'f' || s_suppkey AS file FROM supplier) SELECT name, min(file) AS file FROM f WHERE name IN (SELECT 'N' || c_nationkey || '.s' || c_custkey % 5 FROM customer) GROUP BY 1 HAVING count(*) = 1")
def dotted_files(spark, d):
    mod = lambda k, m: F.concat(F.lit("s"), (F.col(k) % m).cast("string"))
    names = J.table(spark, d, "customer").select(F.concat_ws(".", J.named("N", "c_nationkey"), mod("c_custkey", 5)).alias("name"))
    return loading.dotted_files(names, J.table(spark, d, "supplier").select(J.named("N", "s_nationkey").alias("component"), mod("s_suppkey", 3).alias("stem"), J.named("f", "s_suppkey").alias("file")))


@query(r"SELECT DISTINCT doc_id AS file, w AS name FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l FROM documents WHERE text IS NOT NULL), (VALUES ('the'), ('data'), ('and')) n(w), range(1, 100000) r(i) WHERE i <= len(l) AND i <> 1 AND regexp_matches(l[i], '(^|[^\p{L}\p{N}_])' || w || '($|[^\p{L}\p{N}_])')")
def names_outside_lines(spark, d):
    docs = J.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file"), "text")
    names = docs.select("file", F.explode(F.array(*map(F.lit, ("the", "data", "and")))).alias("name"))
    return loading.appearing_outside(docs, names, docs.select("file", F.lit(1).alias("line")))


@query("WITH f AS (SELECT p_partkey, p_type || '/lib' || p_size || CASE p_partkey % 3 WHEN 0 THEN '/index.d.ts' WHEN 1 THEN '/__init__.py' ELSE '/main.rs' END AS path FROM part) SELECT p_partkey, split_part(path, '/', 1) || ' ' || split_part(path, '/', 2) || CASE WHEN p_partkey % 3 = 2 THEN ' main' ELSE '' END AS segments, p_partkey % 3 <> 2 AS may_be FROM f")
def target_segments(spark, d):
    p = J.table(spark, d, "part")
    path = F.concat_ws("/", "p_type", F.concat(F.lit("lib"), F.col("p_size").cast("string")), F.element_at(F.array(*map(F.lit, ("index.d.ts", "__init__.py", "main.rs"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    importer = F.concat("p_type", F.lit("/x/y.ts"))
    module = F.concat(F.lit("../lib"), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.array_join(P.segments(path), " ").alias("segments"), C.may_be(importer, module, path, F.lit(True)).alias("may_be"))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size >= 20 WHEN 1 THEN true WHEN 2 THEN p_size > 20 WHEN 3 THEN p_size >= 20 WHEN 4 THEN p_size >= 20 WHEN 5 THEN true ELSE p_size >= 20 END AS admits FROM part")
def version_majors(spark, d):
    n = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("^"), n, F.lit(".2.0")), F.concat(F.lit(">="), n), F.concat(F.lit("<"), n, F.lit(".0.0")), F.concat(F.lit("<"), n, F.lit(".1")), F.concat(F.lit("1.0.0 - "), n, F.lit(".2.3")), F.lit("latest"), F.concat(F.lit("~1.0 || v"), n, F.lit(".0.0"))]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 7 + 1).cast("int"))
    return J.table(spark, d, "part").select("p_partkey", P.admits_major(text, 20).alias("admits"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'a.b.c.m' WHEN 2 THEN 'a.b' ELSE NULL END AS module, CASE p_partkey % 4 WHEN 0 THEN 'src/ui/pages/' || p_size WHEN 1 THEN 'src/' || p_size WHEN 2 THEN NULL ELSE NULL END AS prefix, p_partkey % 4 < 2 AS subpath FROM part")
def relative_names(spark, d):
    k = (F.col("p_partkey") % 4).cast("int")
    pick = lambda *x: F.element_at(F.array(*[c if not isinstance(c, str) else F.lit(c) for c in x]), k + 1)
    n = F.col("p_size").cast("string")
    written = pick(F.concat(F.lit("./pages/"), n), F.concat(F.lit("../"), n), F.concat(F.lit("pages/"), n), F.concat(F.lit("../../../"), n))
    module = P.relative_module(F.lit("a.b.c"), F.element_at(F.array(*map(F.lit, (0, 1, 2, 5))), k + 1), pick("m", "m", "", "m"))
    sub = P.imports_subpath(pick("kit/sub.js", "kit/sub/deep", "kit/subway", "kit"), F.lit("kit/sub/index"))
    return J.table(spark, d, "part").select("p_partkey", module.alias("module"), P.relative_prefix(F.lit("src/ui/a.ts"), written).alias("prefix"), sub.alias("subpath"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Wrap' WHEN 1 THEN 'Box' WHEN 2 THEN 'Shop' WHEN 3 THEN 'Shop' ELSE 'plain' END AS reached, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'values' WHEN 2 THEN 'values' WHEN 3 THEN NULL ELSE 'trait_values' END AS note, CASE WHEN p_partkey % 5 = 4 THEN 'a,b' ELSE CASE p_partkey % 5 WHEN 0 THEN 'm::Wrap<x::Y>::new' WHEN 1 THEN 'Box::get' WHEN 2 THEN 'Shop.pay' ELSE 'Shop.open' END END AS exported, p_partkey % 5 = 1 AS mock FROM part")
def symbol_notes(spark, d):
    k = (F.col("p_partkey") % 5 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), k)
    name = pick("m::Wrap<x::Y>::new", "Box::get", "Shop.pay", "Shop.open", "plain")
    signature = pick("fn new(x: Self) -> Self", "pub fn get<F: Fn(u32) -> Vec<u8>>(&'a mut self, f: F)", "public async pay(x)", "public static open()", "trait plain")
    renamed = F.array(F.struct(F.lit("plain").alias("taken"), F.array(F.lit("a"), F.lit("b")).alias("exported")))
    return J.table(spark, d, "part").select("p_partkey", X.reached_name(name).alias("reached"), C.values_note(pick("function", "function", "method", "method", "trait"), name, signature).alias("note"), F.array_join(X.exported_names(renamed, name), ",").alias("exported"), C.is_mock_call(pick("import", "vi.mock", "vi.importActual", "jest.unmock", "mock")).alias("mock"))


@query("SELECT l_partkey AS file, CASE WHEN bool_or(l_returnflag = 'R' AND l_linenumber = 1) THEN 'test' WHEN bool_or(l_returnflag = 'A') THEN 'example' WHEN bool_or(l_returnflag = 'N' AND l_linestatus = 'F') THEN 'bench' WHEN bool_or(l_returnflag = 'R') THEN 'helper' ELSE 'test' END AS kind FROM lineitem WHERE l_quantity > 45 GROUP BY 1")
def target_test_kinds(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "test").when(F.col("l_returnflag") == "A", "example").when(F.col("l_linestatus") == "F", "bench").otherwise("lib")
    t = J.table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("file")).agg(F.collect_set(F.struct(kind.alias("kind"), (F.col("l_linenumber") == 1).alias("root"))).alias("targets"))
    return t.select("file", C.target_test_kind(F.col("targets")).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 100 END AS retry_after, CASE WHEN event_id % 4 = 0 OR event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS remaining, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'BAD,' || event_type END AS codes FROM events")
def http_answers(spark, d):
    body = F.concat(F.lit('{"errors":[{"type":"'), "event_type", F.lit('"},{"extensions":{"code":"BAD"}},{"type":"not one word"},{"type":"BAD"}]}'))
    head = F.concat(F.lit("HTTP/2.0 403 Forbidden\r\nRetry-After: "), (F.col("event_id") % 100).cast("string"), F.lit("\r\nX-RateLimit-Remaining: "), F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("user_id").cast("string")), F.lit("\r\n\r\n"))
    out = X.http_answer(F.when(F.col("event_id") % 4 == 0, F.lit("{}")).otherwise(F.concat(head, body)))
    return J.table(spark, d, "events").select("event_id", X.rate_hints(out["headers"])["retry_after"].alias("retry_after"), X.rate_hints(out["headers"])["remaining"].alias("remaining"), F.array_join(X.error_codes(out["body"]), ",").alias("codes"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'from' WHEN 1 THEN 'to' WHEN 2 THEN 'from' WHEN 3 THEN 'to' END AS recorded, CASE p_partkey % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'from' WHEN 2 THEN 'to' WHEN 3 THEN 'both' END AS seen FROM part")
def relation_ends(spark, d):
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return J.table(spark, d, "part").select("p_partkey", X.recorded_by(pick("Issue.subIssues", "ReferencedEvent", "PullRequest.closingIssuesReferences(manual)", "Issue.closedByPullRequestsReferences", "other")).alias("recorded"), X.seen_from(pick("closes", "duplicate_of", "referenced", "linked", "other")).alias("seen"))


@query("SELECT p_partkey, 'forge ' || p_brand || ', ' || p_size || CASE WHEN p_size = 1 THEN ' issue' ELSE ' issues' END || ' and 1 pull request' || CASE WHEN p_partkey % 2 = 0 THEN ' updated since 2025-10-03' ELSE ', every one' END || CASE WHEN p_partkey % 3 = 0 THEN ' (bound of 500 reached: updated since 2025-12-01)' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ', fetched whole 1970-01-02 00:00 UTC, updated 1970-01-03 00:01 UTC' ELSE ', fetched 1970-01-03 00:01 UTC' END || ', as visible to the account that fetched' AS label FROM part")
def range_labels(spark, d):
    on = lambda k, x: F.when(F.col("p_partkey") % k == 0, x)
    s = F.struct(F.lit("forge").alias("source"), F.col("p_brand").alias("repository"), F.col("p_size").alias("issues"), F.lit(1).alias("pull_requests"), on(2, F.lit("2025-10-03T10:00:00Z")).alias("updated_since"), F.lit("2025-12-01T00:00:00Z").alias("effective_since"), F.lit(500).alias("bound"), (F.col("p_partkey") % 3 == 0).alias("reached_bound"), F.lit(172_860).alias("fetched_at"), on(4, F.lit(86_400)).alias("whole_at"))
    return J.table(spark, d, "part").select("p_partkey", X.range_label(s).alias("label"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'pull_request' ELSE 'issue' END AS kind, count(*) AS items FROM orders GROUP BY 1")
def items_by_kind(spark, d):
    return work.items_by_kind(J.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "pull_request").otherwise("issue").alias("kind")))


@query(f"WITH {_LINKS} SELECT number, max(p_partkey * 7 % 1000) AS newest, count(*) AS commits, row_number() OVER (ORDER BY max(p_partkey * 7 % 1000) DESC, number) AS place FROM ln JOIN part ON ln.id = 'p' || p_partkey GROUP BY 1 QUALIFY place <= 100")
def work_order(spark, d):
    commits = J.table(spark, d, "part").select(J.named("p", "p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1000).alias("time"))
    first = work.by_newest_commit(_links(spark, d)[2], commits).limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("newest"), "number")).cast("long"))


@query("SELECT l_orderkey AS number, l_partkey AS way, CASE WHEN l_linestatus = 'O' THEN 'commit' ELSE 'pull_request' END AS kind, bool_or(l_returnflag = 'R') AS direct, max(l_suppkey) AS time FROM lineitem GROUP BY ALL")
def code_ways(spark, d):
    li = J.table(spark, d, "lineitem")
    return work.code_ways(li.select(F.col("l_orderkey").alias("number"), F.col("l_partkey").alias("way"), F.when(F.col("l_linestatus") == "O", "commit").otherwise("pull_request").alias("kind"), (F.col("l_returnflag") == "R").alias("direct"), F.col("l_suppkey").alias("time")))


@query("SELECT s_suppkey AS repository, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 77 WHEN c_custkey IS NOT NULL THEN c_custkey * 10 ELSE 100000000 - 31536000 END AS since, CASE WHEN s_suppkey % 7 = 0 THEN 'all' WHEN s_suppkey % 5 = 0 THEN 'given' WHEN c_custkey IS NOT NULL THEN 'oldest_commit' ELSE 'days' END AS rule FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey < 12")
def fetch_starts(spark, d):
    requests = J.table(spark, d, "supplier").select(F.col("s_suppkey").alias("repository"), (F.col("s_suppkey") % 7 == 0).alias("every"), F.when(F.col("s_suppkey") % 5 == 0, 77).alias("given"), F.lit(100_000_000).alias("now"))
    oldest = J.table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("repository"), (F.col("c_custkey") * 10).alias("time"))
    return work.fetch_start(requests, oldest).select("repository", F.col("since").cast("long").alias("since"), "rule")


@query("SELECT 'h' AS host, s_suppkey AS repository, s_suppkey % 3 > 0 AND s_suppkey % 10 > c_custkey % 4 + 2 AS failed, s_suppkey % 3 > 0 AND coalesce(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 9 END > 4, false) AS waiting FROM supplier JOIN customer ON c_custkey = s_suppkey")
def refresh_views(spark, d):
    k = F.col("s_suppkey")
    status = J.table(spark, d, "supplier").select(F.lit("h").alias("host"), k.alias("repository"), (k % 10).alias("attempt_at"), F.when(k % 3 > 0, "network").alias("error"), F.when(k % 4 > 0, k % 9).alias("next_retry_at"), F.lit(4).alias("now"))
    return work.refresh_views(status, J.table(spark, d, "customer").select(F.lit("h").alias("host"), F.col("c_custkey").alias("repository"), (F.col("c_custkey") % 4 + 2).alias("fetched_at")))


@query("SELECT DISTINCT 'supplier' AS kind, s_name AS name, s_suppkey AS number, NULL::VARCHAR AS brand FROM supplier UNION SELECT 'part', p_name, NULL, p_brand FROM part")
def every_kind(spark, d):
    s, p = J.table(spark, d, "supplier"), J.table(spark, d, "part")
    return relations.every_kind(supplier=s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("number")), part=p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))


@query("WITH RECURSIVE e AS (SELECT DISTINCT 'f' || l_partkey AS src, 'f' || (l_suppkey * 3) AS dst FROM lineitem WHERE l_linenumber < 3 AND l_partkey <> l_suppkey * 3), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src <> a.dst GROUP BY a.src")
def strong_groups(spark, d):
    li = J.table(spark, d, "lineitem").where("l_linenumber < 3")
    return graph.strong_components(li.select(J.named("f", "l_partkey").alias("src"), F.concat(F.lit("f"), (F.col("l_suppkey") * 3).cast("string")).alias("dst")))
