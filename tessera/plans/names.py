"""Queries about names that files pass on, over orders: an order is a file, its lines are statements, each part stands for one of seven names.

A customer's orders follow each other; a line takes from the order before it (odd lines) or the one before that (even
lines). Customers with a key that 3 divides have a ring: their first orders take from their last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import barrels, definitions, gaps, modules, settings
from tessera.plans.projections import named, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def statements(spark: SparkSession, d: str, *, rings: bool) -> DataFrame:
    """file, target, line, name, flag, instruct, typed, other (another name), priority of every line item."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    all_ = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ring = F.lit(rings) & (F.col("o_custkey") % 3 == 0)
    last = F.when(ring, F.max("o_orderkey").over(all_))
    o = o.withColumn("one", F.coalesce(F.lag("o_orderkey").over(w), last)).withColumn("two", F.coalesce(F.lag("o_orderkey", 2).over(w), last))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_tax", "l_discount")
    name = F.concat(F.lit("n"), (F.col("l_partkey") % 7).cast("string"))
    target = F.when(F.col("l_linenumber") % 2 == 1, F.col("one")).otherwise(F.col("two"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        named("o", "l_orderkey").alias("file"), F.concat(F.lit("o"), target.cast("string")).alias("target"),
        F.col("l_linenumber").cast("int").alias("line"), name.alias("name"), F.col("l_returnflag").alias("flag"), (F.col("l_quantity") >= 40).alias("whole"),
        (F.col("l_tax") > 0.06).alias("typed"), F.when(F.col("l_discount") > 0.08, "n0").otherwise(name).alias("other"), F.col("o_orderpriority").alias("priority"),
    )


def statements_sql(rings: bool) -> str:
    last = "max(o_orderkey) OVER (PARTITION BY o_custkey)" if rings else "NULL"
    last = f"CASE WHEN o_custkey % 3 = 0 THEN {last} END"
    return f"""seq AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER w AS pos, coalesce(lag(o_orderkey) OVER w, {last}) AS one, coalesce(lag(o_orderkey, 2) OVER w, {last}) AS two
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), st AS (
  SELECT 'o' || l_orderkey AS file, 'o' || CASE WHEN l_linenumber % 2 = 1 THEN one ELSE two END AS target, CAST(l_linenumber AS INTEGER) AS line, 'n' || l_partkey % 7 AS name, l_returnflag AS flag,
    l_quantity >= 40 AS whole, l_tax > 0.06 AS typed, CASE WHEN l_discount > 0.08 THEN 'n0' ELSE 'n' || l_partkey % 7 END AS other, o_orderpriority AS priority, pos
  FROM lineitem JOIN seq ON o_orderkey = l_orderkey
)"""


def exports(st: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines returned by the first flag are own exports, by the second re-exports; all others are stars."""
    kind = F.when(F.col("flag") == "A", F.when(F.col("whole"), "alias").otherwise("local")).otherwise(F.when(F.col("whole"), "namespace").otherwise("reexport"))
    row = F.struct("line", kind.alias("kind"), F.when(F.col("flag") == "R", F.col("target")).alias("target"), F.col("other").alias("inner"), F.col("typed").alias("type_only"))
    own = st.where("flag in ('A', 'R')").groupBy("file", "name").agg(F.min(row).alias("x")).select("file", "name", "x.*")
    return own, st.where("flag = 'N'").select("file", "target", "line", F.col("typed").alias("type_only"))


_WALK_SQL = f"""WITH RECURSIVE {statements_sql(True)}, own AS (
  SELECT file, name, CASE WHEN flag = 'A' THEN CASE WHEN whole THEN 'alias' ELSE 'local' END WHEN whole THEN 'namespace' ELSE 'reexport' END AS kind, CASE WHEN flag = 'R' THEN target END AS target, other AS inner_
  FROM st WHERE flag IN ('A', 'R') QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY line, kind, target NULLS FIRST, inner_) = 1
), star AS (
  SELECT DISTINCT file, target FROM st WHERE flag = 'N' AND target IS NOT NULL
), asked AS (
  SELECT DISTINCT file, name FROM st
), state AS (
  SELECT file, name FROM asked
  UNION (
    SELECT coalesce(o.target, s.target), CASE WHEN o.file IS NOT NULL THEN o.inner_ ELSE t.name END
    FROM state t LEFT JOIN own o ON o.file = t.file AND o.name = t.name LEFT JOIN star s ON s.file = t.file AND o.file IS NULL
    WHERE (o.kind = 'reexport' AND o.target IS NOT NULL) OR (o.file IS NULL AND s.target IS NOT NULL)
  )
), edge AS (
  SELECT t.file, t.name, o.target AS to_file, o.inner_ AS to_name, false AS star FROM state t JOIN own o ON o.file = t.file AND o.name = t.name WHERE kind = 'reexport' AND target IS NOT NULL
  UNION ALL SELECT t.file, t.name, s.target, t.name, true FROM state t JOIN star s ON s.file = t.file WHERE NOT EXISTS (FROM own o WHERE o.file = t.file AND o.name = t.name)
), there AS (
  SELECT t.file, t.name FROM state t JOIN own o ON o.file = t.file AND o.name = t.name
  UNION SELECT e.file, e.name FROM there x JOIN edge e ON e.to_file = x.file AND e.to_name = x.name AND e.star
), fact AS (
  SELECT * FROM (
    SELECT t.file, t.name, CASE WHEN o.target IS NULL AND kind IN ('reexport', 'namespace') THEN '' WHEN kind = 'namespace' THEN o.target ELSE t.file END AS def
    FROM state t JOIN own o ON o.file = t.file AND o.name = t.name WHERE kind <> 'reexport' OR target IS NULL
    UNION ALL SELECT e.file, e.name, '' FROM edge e WHERE NOT star AND NOT EXISTS (FROM there x WHERE x.file = e.to_file AND x.name = e.to_name))
  UNION SELECT e.file, e.name, f.def FROM fact f JOIN edge e ON e.to_file = f.file AND e.to_name = f.name
), dark AS (
  SELECT file, name FROM there x WHERE NOT EXISTS (FROM fact f WHERE f.file = x.file AND f.name = x.name)
  UNION SELECT e.file, e.name FROM dark x JOIN edge e ON e.to_file = x.file AND e.to_name = x.name
), told AS (
  SELECT file, name, count(DISTINCT def) = 1 AND bool_and(def <> '') AS sure, any_value(def) AS def FROM (SELECT * FROM fact UNION ALL SELECT file, name, '' FROM dark) GROUP BY 1, 2
)
SELECT a.file, a.name, CASE WHEN t.file IS NULL THEN 'missing' WHEN sure THEN 'found' ELSE 'unknown' END AS status, CASE WHEN sure THEN def END AS def_file
FROM asked a LEFT JOIN told t ON t.file = a.file AND t.name = a.name"""


@query(_WALK_SQL)
def export_definitions(spark, d):
    st = statements(spark, d, rings=True)
    own, stars = exports(st)
    return definitions.exported_definitions(own, stars, st.select("file", "name")).select("file", "name", "status", "def_file")


_BOUND_SQL = f"""WITH RECURSIVE {statements_sql(False)}, modes AS (
  SELECT DISTINCT name FROM st
), lists AS (
  SELECT file, any_value(priority) AS priority, list(DISTINCT name) FILTER (flag = 'A') AS names FROM st GROUP BY 1
), base AS (
  SELECT 'o' || o_orderkey AS file, pos, o_custkey, m.name FROM seq, modes m
), flat AS (
  SELECT DISTINCT file, name, CAST(NULL AS VARCHAR) AS target, 'here' AS way, false AS typed, 0 AS line FROM st WHERE flag = 'A'
  UNION ALL SELECT file, name, NULL, 'blind', bool_and(typed), 0 FROM st WHERE flag = 'R' AND target IS NULL GROUP BY ALL
  UNION ALL SELECT file, name, target, CASE WHEN whole THEN 'whole' ELSE 'lead' END, min(struct_pack(t := typed, l := line)).t, min(struct_pack(t := typed, l := line)).l FROM st WHERE flag = 'R' AND target IS NOT NULL GROUP BY file, name, target, whole
), star AS (
  SELECT DISTINCT file, target, typed, line FROM st WHERE flag = 'N'
), src AS (
  SELECT b.file, b.name, b.pos, f.target, f.way, f.typed, f.line FROM base b JOIN flat f ON f.file = b.file AND f.name = b.name
  UNION ALL
  SELECT b.file, b.name, b.pos, s.target, CASE WHEN l.priority = '5-LOW' THEN 'untold' ELSE 'star' END, s.typed, s.line
  FROM base b JOIN star s ON s.file = b.file AND s.target IS NOT NULL JOIN lists l ON l.file = s.target
  WHERE (l.priority NOT IN ('1-URGENT', '5-LOW') OR l.priority = '5-LOW' OR list_contains(coalesce(l.names, []), b.name))
    AND (EXISTS (FROM st x WHERE x.file = b.file AND x.name = b.name AND x.flag IN ('A', 'R')) OR NOT EXISTS (FROM star x WHERE x.file = b.file AND x.target IS NULL))
  UNION ALL
  SELECT b.file, b.name, b.pos, NULL, 'blind', false, 0 FROM base b
  WHERE NOT EXISTS (FROM st x WHERE x.file = b.file AND x.name = b.name AND x.flag IN ('A', 'R')) AND EXISTS (FROM star x WHERE x.file = b.file AND x.target IS NULL)
), val AS (
  SELECT CAST('' AS VARCHAR) AS file, CAST('' AS VARCHAR) AS name, CAST(0 AS BIGINT) AS pos, '' AS status, CAST(NULL AS VARCHAR) AS def_file, CAST(NULL AS VARCHAR) AS def_name, CAST(NULL AS BOOLEAN) AS typed, CAST(0 AS BIGINT) AS step
  UNION ALL (
    WITH now AS (
      SELECT max(step) + 1 AS k FROM val
    ), said AS (
      SELECT b.file, b.name, s.way, s.line, s.target,
        CASE WHEN s.way IS NULL OR (s.way = 'star' AND v.status = 'absent') THEN NULL WHEN s.way = 'here' THEN 'here' WHEN s.way IN ('blind', 'untold') THEN 'unknown' WHEN s.way = 'whole' THEN 'through' WHEN v.status = 'unknown' THEN 'unknown' ELSE 'through' END AS kind,
        CASE WHEN s.way = 'whole' THEN s.target WHEN s.way IN ('lead', 'star') AND v.status IN ('here', 'absent') THEN s.target WHEN s.way IN ('lead', 'star') THEN v.def_file END AS def_file,
        CASE WHEN s.way = 'whole' THEN '*' WHEN s.way IN ('lead', 'star') AND v.status IN ('here', 'absent') THEN b.name WHEN s.way IN ('lead', 'star') THEN v.def_name END AS def_name,
        s.typed OR (s.way IN ('lead', 'star') AND coalesce(v.typed, false)) AS typed
      FROM base b JOIN now ON b.pos = now.k LEFT JOIN src s ON s.file = b.file AND s.name = b.name LEFT JOIN val v ON v.file = s.target AND v.name = b.name
    ), count_ AS (
      SELECT *, bool_or(kind IS NOT NULL AND NOT typed) OVER (PARTITION BY file, name) AS runs FROM said
    ), one AS (
      SELECT file, name, count(DISTINCT struct_pack(a := kind, b := def_file, c := def_name)) FILTER (kind IS NOT NULL AND (NOT runs OR NOT typed)) AS n, min(kind) FILTER (kind IS NOT NULL AND (NOT runs OR NOT typed)) AS kind,
        min(def_file) FILTER (kind IS NOT NULL AND (NOT runs OR NOT typed)) AS def_file, min(def_name) FILTER (kind IS NOT NULL AND (NOT runs OR NOT typed)) AS def_name, bool_and(typed) FILTER (kind IS NOT NULL) AS typed
      FROM count_ GROUP BY 1, 2
    )
    SELECT file, name, now.k, CASE WHEN n = 0 THEN 'absent' WHEN n = 1 THEN kind ELSE 'unknown' END, CASE WHEN n = 1 AND kind = 'through' THEN def_file END, CASE WHEN n = 1 AND kind = 'through' THEN def_name END, CASE WHEN n = 1 AND kind = 'through' THEN typed END, now.k
    FROM one, now
    UNION ALL SELECT file, name, pos, status, def_file, def_name, typed, now.k FROM val, now WHERE pos = now.k - 1 AND pos > 0 AND now.k <= (SELECT max(pos) FROM seq)
  )
)
SELECT v.file, v.name, status, def_file, def_name FROM val v JOIN (SELECT DISTINCT file, name FROM st) a ON a.file = v.file AND a.name = v.name WHERE v.step = v.pos"""


@query(_BOUND_SQL)
def binding_definitions(spark, d):
    st = statements(spark, d, rings=False)
    inner = F.when(F.col("whole"), definitions.WHOLE).otherwise(F.col("name"))
    bound = st.where("flag = 'R'").select("file", "name", "target", inner.alias("inner"), "line", F.col("typed").alias("type_only"))
    stars = st.where("flag = 'N'").select("file", "target", "line", F.col("typed").alias("type_only"))
    own = st.where("flag = 'A'").select("file", "name")
    names = own.groupBy("file").agg(F.collect_set("name").alias("names"))
    listed = st.where("priority in ('1-URGENT', '5-LOW')").select("file", "priority").distinct().join(names, "file", "left")
    listed = listed.select("file", F.when(F.col("priority") == "1-URGENT", F.coalesce("names", F.array().cast("array<string>"))).alias("names"))
    return definitions.bound_definitions(own, bound, stars, listed, st.select("file", "name"), hops=64).select("file", "name", "status", "def_file", "def_name")


def barrel_tables(st: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements, symbols and changes: first flag: a name is taken; second: passed on by name; else passed on whole, as a namespace (large lines of odd number), or only loaded."""
    whole, flag = F.col("whole"), F.col("flag")
    name = F.when(flag.isin("A", "R"), F.col("name")).when(whole & (F.col("line") % 2 == 0), F.lit(None)).otherwise("*")
    alias = F.when(flag == "R", F.col("other")).when((flag == "N") & whole & (F.col("line") % 2 == 1), F.col("name"))
    passes = (flag == "R") | ((flag == "N") & ~(whole & (F.col("line") % 2 == 0)))
    s = st.select("file", "line", "target", name.alias("name"), alias.alias("alias"), passes.alias("passes_on"), F.lit(False).alias("test"), F.col("typed").alias("found"))
    symbols = st.where("typed").select("file", F.col("other").alias("name")).distinct()
    changed = st.where("priority = '1-URGENT'").select(F.col("file").alias("change"), "file").distinct()
    return s, symbols, changed


_BARREL_SQL = f"""WITH RECURSIVE {statements_sql(True)}, s0 AS (
  SELECT DISTINCT file, line, target, CASE WHEN flag IN ('A', 'R') THEN name WHEN whole AND line % 2 = 0 THEN NULL ELSE '*' END AS name, CASE WHEN flag = 'R' THEN other WHEN flag = 'N' AND whole AND line % 2 = 1 THEN name END AS alias,
    flag = 'R' OR (flag = 'N' AND NOT (whole AND line % 2 = 0)) AS passes_on, typed AS found FROM st
), sym AS (
  SELECT DISTINCT file, other AS name FROM st WHERE typed
), changed AS (
  SELECT DISTINCT file AS change, file FROM st WHERE priority = '1-URGENT'
), reach AS (
  SELECT change, file FROM changed
  UNION SELECT r.change, s.target FROM reach r JOIN s0 s ON s.file = r.file AND s.passes_on AND s.target IS NOT NULL AND s.name = '*' AND s.alias IS NULL
), names AS (
  SELECT DISTINCT r.change, n.name FROM reach r JOIN (
    SELECT file, name FROM sym UNION SELECT target, name FROM s0 WHERE target IS NOT NULL UNION SELECT file, coalesce(alias, name) FROM s0 WHERE passes_on AND target IS NOT NULL) n ON n.file = r.file WHERE n.name IS NOT NULL AND n.name <> '*'
), open_ AS (
  SELECT DISTINCT r.change FROM reach r JOIN s0 s ON s.file = r.file AND s.passes_on AND s.target IS NULL
), s AS (
  SELECT * FROM s0 WHERE target IS NOT NULL AND target <> file
), shut AS (
  SELECT file, name FROM sym UNION SELECT file, name FROM s WHERE passes_on AND name <> '*'
), way AS (
  SELECT s.*, x.file IS NOT NULL AS shut FROM s LEFT JOIN shut x ON x.file = s.target AND x.name = s.name
), met AS (
  SELECT c.change, c.file AS barrel, s.file, s.line, s.passes_on, CASE WHEN s.name = '*' AND s.alias IS NULL THEN NULL WHEN s.name = '*' THEN s.alias ELSE coalesce(s.alias, s.name) END AS out_, CASE WHEN s.name = '*' AND s.alias IS NULL THEN 'any' ELSE 'exact' END AS how, false AS link
  FROM changed c JOIN s ON s.target = c.file AND s.passes_on AND s.name IS NOT NULL
  UNION
  SELECT m.change, m.file, w.file, w.line, w.passes_on, CASE WHEN w.name = '*' THEN coalesce(w.alias, m.out_) ELSE coalesce(w.alias, w.name) END, CASE WHEN w.name = '*' AND w.alias IS NOT NULL THEN 'exact' WHEN w.name = '*' OR w.name IS NULL THEN m.how WHEN m.how = 'exact' AND m.out_ = w.name THEN 'exact' ELSE 'possible' END, true
  FROM met m JOIN way w ON w.target = m.file AND m.passes_on AND NOT EXISTS (FROM changed c WHERE c.change = m.change AND c.file = w.file) AND NOT EXISTS (FROM changed c WHERE c.change = m.change AND c.file = m.file)
    AND NOT (m.link AND m.out_ IS NULL AND m.how <> 'any')
    LEFT JOIN names n ON n.change = m.change AND n.name = w.name LEFT JOIN open_ o ON o.change = m.change
  WHERE w.name = '*' OR w.name IS NULL OR (m.how = 'exact' AND m.out_ = w.name)
    OR (m.how = 'possible' AND m.out_ = w.name AND n.name IS NOT NULL AND (w.found OR (NOT w.shut AND w.name <> 'default')))
    OR (m.how = 'any' AND NOT w.shut AND w.name <> 'default' AND n.name IS NOT NULL)
    OR (o.change IS NOT NULL AND NOT w.shut AND w.name <> 'default' AND NOT w.found)
)
SELECT DISTINCT change, barrel, file, line, passes_on FROM met WHERE link AND NOT EXISTS (FROM changed c WHERE c.change = met.change AND c.file = met.file)"""


@query(_BARREL_SQL)
def barrel_links(spark, d):
    s, symbols, changed = barrel_tables(statements(spark, d, rings=True))
    return barrels.passed_on(changed, s, symbols)[0].select("change", "barrel", "file", "line", "passes_on")


_NAMES_SQL = _BARREL_SQL.split(", s AS (\n")[0] + "\nSELECT n.change, count(*) AS names, min(n.name) AS first, bool_or(o.change IS NOT NULL) AS open FROM names n LEFT JOIN open_ o ON o.change = n.change GROUP BY 1"


@query(_NAMES_SQL)
def exported_names(spark, d):
    s, symbols, changed = barrel_tables(statements(spark, d, rings=True))
    e = barrels.exports_of(changed, s, symbols)
    return e.groupBy("change").agg(F.count("name").alias("names"), F.min("name").alias("first"), F.max("open").alias("open")).where("names > 0")


# Spellings, modules, configurations


_SPELL_SQL = f"""WITH RECURSIVE {statements_sql(True)}, own AS (
  SELECT file, name, CASE WHEN flag = 'A' THEN CASE WHEN whole THEN 'alias' ELSE 'local' END WHEN whole THEN 'namespace' ELSE 'reexport' END AS kind, CASE WHEN flag = 'R' THEN target END AS target, other AS inner_
  FROM st WHERE flag IN ('A', 'R') QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY line, kind, target NULLS FIRST, inner_) = 1
), star AS (
  SELECT DISTINCT file, target FROM st WHERE flag = 'N' AND target IS NOT NULL
), pass AS (
  SELECT target, file, name, CASE WHEN kind = 'reexport' THEN inner_ END AS inner_, false AS star FROM own WHERE kind IN ('reexport', 'namespace') AND target IS NOT NULL
  UNION ALL SELECT target, file, NULL, NULL, true FROM star
), sp AS (
  SELECT file || ':' || name AS symbol, file AS module, [name] AS path FROM own WHERE kind = 'local'
  UNION SELECT o.file || ':' || o.name, o.file, [a.name] FROM own o JOIN own a ON a.file = o.file AND a.kind = 'alias' AND a.inner_ = o.name WHERE o.kind = 'local'
  UNION (
    SELECT s.symbol, p.file, CASE WHEN p.star THEN s.path WHEN p.inner_ IS NULL THEN list_prepend(p.name, s.path) ELSE list_prepend(p.name, s.path[2:]) END
    FROM sp s JOIN pass p ON p.target = s.module AND (p.star OR p.inner_ IS NULL OR p.inner_ = s.path[1]) LEFT JOIN own o ON p.star AND o.file = p.file AND o.name = s.path[1]
    WHERE o.file IS NULL AND len(CASE WHEN p.inner_ IS NULL AND NOT p.star THEN list_prepend(p.name, s.path) ELSE s.path END) <= 2)
)
SELECT symbol, module, array_to_string(path, '.') AS path FROM sp"""


@query(_SPELL_SQL)
def symbol_spellings(spark, d):
    own, stars = exports(statements(spark, d, rings=True))
    symbols = own.where("kind = 'local'").select(F.concat_ws(":", "file", "name").alias("symbol"), "file", "name")
    return definitions.spellings(own, stars, symbols, most=2).select("symbol", "module", F.array_join("path", ".").alias("path"))


def module_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Customers are modules below their nations: items by line items, uses and globs of other customers by their orders in turn."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(named("n", "c_nationkey"), F.lit("::"), named("c", "c_custkey")).alias("module"), named("n", "c_nationkey").alias("nation"))
    turn = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.row_number().over(turn).alias("turn"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("i"), (F.col("l_partkey") % 50).cast("string")).alias("name"), "l_suppkey", "l_returnflag", "l_tax").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("module").alias("target"))
    items = li.where("l_tax > 0.06").groupBy("module", "name").agg(F.max(F.col("l_returnflag") != "N").alias("public"))
    items = items.unionByName(li.where("l_tax < 0.01").groupBy(F.col("nation").alias("module"), "name").agg(F.lit(False).alias("public")))
    to = o.join(after, "o_orderkey").select("module", "target", "turn", (F.col("o_orderstatus") == "O").alias("public"), "o_orderkey")
    globs = to.where("turn in (1, 2)").select("module", "target", "public", F.col("turn").alias("line")).unionByName(c.select("module", F.col("nation").alias("target"), F.lit(True).alias("public"), F.lit(0).alias("line")))
    uses = to.where("turn = 3").join(li.select("l_orderkey", "name", "l_linenumber"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("module", "name", "target", "public").agg(F.min("l_linenumber").alias("line")).withColumn("inner", F.col("name"))
    asked = li.select(F.col("module").alias("from"), "module", "name").unionByName(to.where("turn = 1").join(li.select("l_orderkey", "name"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("module").alias("from"), F.col("target").alias("module"), "name")).distinct()
    return items, uses, globs, asked


_SEES = "({0} = {1} OR starts_with({0}, {1} || '::'))"
_MODULE_SQL = f"""WITH RECURSIVE c AS (
  SELECT c_custkey, 'n' || c_nationkey || '::c' || c_custkey AS module, 'n' || c_nationkey AS nation FROM customer
), o AS (
  SELECT o_orderkey, o_orderstatus, module, nation, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders JOIN c ON o_custkey = c_custkey
), li AS (
  SELECT o_orderkey, l_linenumber, 'i' || l_partkey % 50 AS name, l_returnflag, l_tax, module, nation, turn FROM lineitem JOIN o ON l_orderkey = o_orderkey
), item AS (
  SELECT module, name, bool_or(l_returnflag <> 'N') AS public FROM li WHERE l_tax > 0.06 GROUP BY 1, 2
  UNION ALL SELECT DISTINCT nation, name, false FROM li WHERE l_tax < 0.01
), nxt AS (
  SELECT a.module, b.module AS target, a.turn, a.o_orderstatus = 'O' AS public, a.o_orderkey FROM o a JOIN o b ON b.o_orderkey = a.o_orderkey + 1
), glb AS (
  SELECT DISTINCT module, target, public FROM nxt WHERE turn IN (1, 2) AND module <> target UNION SELECT module, nation, true FROM c
), use_ AS (
  SELECT module, name, target, public FROM (SELECT n.module, l.name, n.target, n.public, min(l_linenumber) AS line FROM nxt n JOIN li l ON l.o_orderkey = n.o_orderkey WHERE n.turn = 3 GROUP BY ALL)
), asked AS (
  SELECT module AS frm, module, name FROM li UNION SELECT n.module, n.target, l.name FROM nxt n JOIN li l ON l.o_orderkey = n.o_orderkey WHERE n.turn = 1
), own AS (
  SELECT module, open, name, kind, target FROM (
    SELECT module, name, public, 0 AS rank, NULL AS target, 'local' AS kind FROM item UNION ALL SELECT module, name, public, 1, target, 'use' FROM use_) x, (VALUES (true), (false)) v(open)
  WHERE open OR public QUALIFY row_number() OVER (PARTITION BY module, open, name ORDER BY rank) = 1
), star AS (
  SELECT DISTINCT module, v.open, target, {_SEES.format("module", "target")} AS topen FROM glb, (VALUES (true), (false)) v(open) WHERE v.open OR public
), state AS (
  SELECT module, {_SEES.format("frm", "module")} AS open, name FROM asked
  UNION (
    SELECT coalesce(o.target, s.target), CASE WHEN o.module IS NOT NULL THEN {_SEES.format("t.module", "o.target")} ELSE s.topen END, t.name
    FROM state t LEFT JOIN own o ON o.module = t.module AND o.open = t.open AND o.name = t.name LEFT JOIN star s ON s.module = t.module AND s.open = t.open AND o.module IS NULL
    WHERE o.kind = 'use' OR (o.module IS NULL AND s.target IS NOT NULL))
), edge AS (
  SELECT t.module, t.open, t.name, o.target AS tm, {_SEES.format("t.module", "o.target")} AS topen, false AS star FROM state t JOIN own o ON o.module = t.module AND o.open = t.open AND o.name = t.name WHERE o.kind = 'use'
  UNION ALL SELECT t.module, t.open, t.name, s.target, s.topen, true FROM state t JOIN star s ON s.module = t.module AND s.open = t.open WHERE NOT EXISTS (FROM own o WHERE o.module = t.module AND o.open = t.open AND o.name = t.name)
), there AS (
  SELECT t.module, t.open, t.name FROM state t JOIN own o ON o.module = t.module AND o.open = t.open AND o.name = t.name
  UNION SELECT e.module, e.open, e.name FROM there x JOIN edge e ON e.tm = x.module AND e.topen = x.open AND e.name = x.name AND e.star
), fact AS (
  SELECT * FROM (SELECT t.module, t.open, t.name, t.module AS def FROM state t JOIN own o ON o.module = t.module AND o.open = t.open AND o.name = t.name WHERE kind = 'local'
    UNION ALL SELECT e.module, e.open, e.name, '' FROM edge e WHERE NOT star AND NOT EXISTS (FROM there x WHERE x.module = e.tm AND x.open = e.topen AND x.name = e.name))
  UNION SELECT e.module, e.open, e.name, f.def FROM fact f JOIN edge e ON e.tm = f.module AND e.topen = f.open AND e.name = f.name
), dark AS (
  SELECT module, open, name FROM there x WHERE NOT EXISTS (FROM fact f WHERE f.module = x.module AND f.open = x.open AND f.name = x.name)
  UNION SELECT e.module, e.open, e.name FROM dark x JOIN edge e ON e.tm = x.module AND e.topen = x.open AND e.name = x.name
), told AS (
  SELECT module, open, name, count(DISTINCT def) = 1 AND bool_and(def <> '') AS sure, any_value(def) AS def FROM (FROM fact UNION ALL SELECT *, '' FROM dark) GROUP BY ALL
)
SELECT a.frm AS "from", a.module, a.name, CASE WHEN t.module IS NULL THEN 'missing' WHEN sure THEN 'found' ELSE 'unknown' END AS status, CASE WHEN sure THEN def END AS def_module
FROM asked a LEFT JOIN told t ON t.module = a.module AND t.open = {_SEES.format("a.frm", "a.module")} AND t.name = a.name"""


@query(_MODULE_SQL)
def glob_lookups(spark, d):
    return modules.glob_definitions(*module_tables(spark, d)).select("from", "module", "name", "status", "def_module")


_TREE = """f AS (
  SELECT DISTINCT p FROM (
    SELECT 'n' || c_nationkey || '/c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.rs' ELSE '/mod.rs' END AS p FROM customer
    UNION ALL SELECT 'n' || c_nationkey || '/c' || c_custkey || '/o' || o_orderkey || '.rs' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'n' || c_nationkey || '/shared/p' || l_partkey || '.rs' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'A')
)"""


@query(f"""WITH {_TREE}, a AS (
  SELECT 'n' || c_nationkey AS crate, c_custkey, 'c' || c_custkey AS module, 'n' || c_nationkey || '/c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.rs' ELSE '/mod.rs' END AS file FROM customer
), b AS (
  SELECT crate, module || '::in' || '::o' || o_orderkey AS module, 'n' || c_nationkey || '/c' || o_custkey || '/in/o' || o_orderkey AS stem, o_orderkey, o_orderstatus, c_nationkey, o_custkey FROM orders JOIN a ON o_custkey = a.c_custkey JOIN customer USING (c_custkey)
), l AS (
  SELECT DISTINCT b.crate, b.module || '::l' || l_linenumber AS module, CAST(l_linenumber AS INTEGER) AS line, 'n' || c_nationkey || '/shared/p' || l_partkey || '.rs' AS file FROM lineitem JOIN b ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
), first_ AS (
  SELECT crate, module, line, min(file) AS file FROM l WHERE file IN (SELECT p FROM f) GROUP BY ALL
), won AS (
  SELECT * FROM first_ QUALIFY row_number() OVER (PARTITION BY crate, file ORDER BY module, line) = 1
)
SELECT crate, '' AS module, crate || '/lib.rs' AS file FROM (SELECT DISTINCT 'n' || c_nationkey AS crate FROM customer)
UNION ALL SELECT crate, module, file FROM a
UNION ALL SELECT crate, module || '::in', file FROM a
UNION ALL SELECT crate, module, 'n' || c_nationkey || '/c' || o_custkey || '/in/o' || o_orderkey || '.rs' FROM b WHERE o_orderstatus <> 'P'
UNION ALL SELECT crate, module, min(file) FROM won GROUP BY crate, module""".replace("|| '/c' || c_custkey || '/o' ||", "|| '/c' || c_custkey || '/in/o' ||"))
def module_files(spark, d):
    """Nations are crates, customers files of theirs, orders files in an inline module of these, line items claim files by an explicit path."""
    c = table(spark, d, "customer").select("c_custkey", named("n", "c_nationkey").alias("n"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey"))
    root = F.concat("n", F.lit("/lib.rs"))
    home = F.concat("n", F.lit("/c"), F.col("c_custkey").cast("string"))
    own = F.concat(home, F.when(F.col("c_custkey") % 2 == 0, ".rs").otherwise("/mod.rs"))
    order = F.concat(home, F.lit("/in/o"), F.col("o_orderkey").cast("string"), F.lit(".rs"))
    shared = F.concat(F.lit("../../shared/p"), F.col("l_partkey").cast("string"), F.lit(".rs"))
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    at = F.concat("n", F.lit("/shared/p"), F.col("l_partkey").cast("string"), F.lit(".rs"))
    null, top = F.lit(None).cast("string"), F.lit("").alias("inside")
    files = c.select(own.alias("path")).unionByName(o.where("o_orderstatus <> 'P'").select(order.alias("path"))).unionByName(lines.where("l_returnflag = 'A'").select(at.alias("path")))
    declared = c.select(root.alias("file"), top, named("c", "c_custkey").alias("name"), F.lit(1).alias("line"), null.alias("path"))
    declared = declared.unionByName(o.select(own.alias("file"), F.lit("in").alias("inside"), named("o", "o_orderkey").alias("name"), F.lit(2).alias("line"), null.alias("path")))
    declared = declared.unionByName(lines.select(order.alias("file"), top, named("l", "l_linenumber").alias("name"), F.col("l_linenumber").alias("line"), shared.alias("path")))
    inline = c.select(own.alias("file"), top, F.lit("in").alias("name"))
    roots = c.select(F.col("n").alias("crate"), root.alias("file")).distinct()
    return modules.forest(roots, declared, inline, files)[0].select("crate", "module", "file")


_SETTING_SQL = f"""WITH RECURSIVE {statements_sql(True).split(", st AS (")[0]}, x AS (
  SELECT 'o' || o_orderkey AS config, [CASE WHEN one IS NOT NULL THEN 'o' || one END, CASE WHEN two IS NOT NULL THEN 'o' || two END] AS ups, o.o_orderstatus AS s, o.o_orderpriority AS p FROM seq JOIN orders o USING (o_orderkey)
), own AS (
  SELECT config, '/a/b' AS pointer, CASE WHEN s = 'O' THEN '"' || p || '"' ELSE 'null' END AS value FROM x WHERE s <> 'P'
  UNION ALL SELECT config, '/a', '{{"b":' || CASE WHEN s = 'O' THEN '"' || p || '"' ELSE 'null' END || '}}' FROM x WHERE s <> 'P'
  UNION ALL SELECT config, '/c', '[1]' FROM x WHERE p = '1-URGENT'
), walk AS (
  SELECT config, pointer, config AS at, CAST([] AS INTEGER[]) AS way FROM x, (VALUES ('/a/b'), ('/a'), ('/c')) v(pointer)
  UNION (
    SELECT w.config, w.pointer, x.ups[k], list_append(w.way, -k) FROM walk w JOIN x ON x.config = w.at, (VALUES (1), (2)) v(k)
    WHERE x.ups[k] IS NOT NULL AND len(w.way) < 4 AND NOT EXISTS (FROM own o WHERE o.config = w.at AND o.pointer = w.pointer))
), hit AS (
  SELECT w.config, w.pointer, o.value, o.config AS set_by FROM walk w JOIN own o ON o.config = w.at AND o.pointer = w.pointer QUALIFY row_number() OVER (PARTITION BY w.config, w.pointer ORDER BY way) = 1
)
SELECT x.config, v.pointer, value, set_by FROM x CROSS JOIN (VALUES ('/a/b'), ('/a'), ('/c')) v(pointer) LEFT JOIN hit h ON h.config = x.config AND h.pointer = v.pointer"""


@query(_SETTING_SQL)
def inherited_settings(spark, d):
    """Orders are configurations that extend earlier ones of the customer; most of them set something, some to null."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.when(F.col("o_custkey") % 3 == 0, F.max("o_orderkey").over(Window.partitionBy("o_custkey")))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.coalesce(F.lag("o_orderkey").over(w), last).alias("one"), F.coalesce(F.lag("o_orderkey", 2).over(w), last).alias("two"))
    name = named("o", "o_orderkey").alias("config")
    b = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit('{"b": "'), "o_orderpriority", F.lit('"}'))).otherwise('{"b": null}')
    fields = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit('"a": '), b)), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit('"c": [1]'))))
    configs = o.select(name, F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}")).alias("json"))
    up = lambda c, pos: o.where(F.col(c).isNotNull()).select(name, named("o", c).alias("target"), F.lit(pos).alias("pos"))
    asked = configs.select("config", F.explode(F.array(F.lit("/a/b"), F.lit("/a"), F.lit("/c"))).alias("pointer"))
    return settings.settings(configs, up("one", 1).unionByName(up("two", 2)), asked, depth=4)


# Gaps, collisions, methods


_GAP_SQL = """WITH sup AS (
  SELECT s_suppkey, 'r' || n_regionkey AS r, 'r' || n_regionkey || '/n' || n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey
), place AS (
  SELECT 'dynamic' AS kind, CASE WHEN l_quantity > 40 THEN '' WHEN l_quantity > 20 THEN r ELSE n END AS key, 'o' || l_orderkey AS file, CAST(l_linenumber AS INTEGER) AS line, l_returnflag = 'R' AS test, 'p' || l_partkey AS what FROM lineitem JOIN sup ON l_suppkey = s_suppkey
  UNION ALL SELECT 'named', 's' || l_suppkey, 'o' || l_orderkey, CAST(l_linenumber AS INTEGER), l_returnflag = 'R', 'p' || l_partkey FROM lineitem WHERE l_tax > 0.05
), wanted AS (
  SELECT n || '/s' || s_suppkey AS subject, 'dynamic' AS kind, unnest(['', r, n, n || '/s' || s_suppkey]) AS key, 'o' || s_suppkey AS own FROM sup
  UNION ALL SELECT n || '/s' || s_suppkey, 'named', 's' || s_suppkey, 'o' || s_suppkey FROM sup
), met AS (
  SELECT subject, w.kind, file, line, what, row_number() OVER (PARTITION BY subject, w.kind ORDER BY test, file, line, what) AS k, count(*) OVER (PARTITION BY subject, w.kind) AS total FROM wanted w JOIN place p ON p.kind = w.kind AND p.key = w.key WHERE file <> own
)
SELECT subject, kind, total, string_agg(file || ':' || line || ' ' || what, ', ' ORDER BY k) AS shown FROM met WHERE k <= 5 GROUP BY ALL"""


@query(_GAP_SQL)
def untraced(spark, d):
    """Suppliers are subjects: line items are calls below their directories, or imports of a like name."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    sup = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    r = named("r", "n_regionkey")
    sup = sup.select("s_suppkey", r.alias("r"), F.concat(r, F.lit("/"), named("n", "n_nationkey")).alias("n"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    rest = [named("o", "l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_returnflag") == "R").alias("test"), named("p", "l_partkey").alias("what")]
    key = F.when(F.col("l_quantity") > 40, "").when(F.col("l_quantity") > 20, F.col("r")).otherwise(F.col("n"))
    places = li.select(F.lit("dynamic").alias("kind"), key.alias("key"), *rest).unionByName(li.where("l_tax > 0.05").select(F.lit("named").alias("kind"), named("s", "l_suppkey").alias("key"), *rest))
    path = F.concat("n", F.lit("/"), named("s", "s_suppkey"))
    subject = [path.alias("subject"), named("o", "s_suppkey").alias("own")]
    wanted = sup.select(*subject, F.lit("dynamic").alias("kind"), F.explode(gaps.directories(path)).alias("key")).unionByName(sup.select(*subject, F.lit("named").alias("kind"), named("s", "s_suppkey").alias("key")))
    shown = F.array_join(F.transform("shown", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"), F.lit(" "), x["what"])), ", ")
    return gaps.gap_lists(places, wanted, most=5).select("subject", "kind", "total", shown.alias("shown"))


_NEAR_SQL = f"""WITH {statements_sql(True)}, ends AS (
  SELECT 'o' || o_orderkey AS barrel, 'o' || one AS one, 'o' || two AS two FROM seq
), bar AS (
  SELECT one AS target, barrel, one AS origin, 0 AS place FROM ends WHERE one IS NOT NULL UNION ALL SELECT one, barrel, two, 1 FROM ends WHERE one IS NOT NULL AND two IS NOT NULL
), pass AS (
  SELECT DISTINCT file, line, target FROM st WHERE flag <> 'A' AND target IS NOT NULL AND target <> file
), way AS (
  SELECT b.target, b.barrel, line, place FROM bar b JOIN pass p ON p.file = b.barrel AND p.target = b.origin
), line_ AS (
  SELECT * FROM way UNION ALL SELECT DISTINCT b.target, b.barrel, line, 2147483647 FROM bar b JOIN pass p ON p.file = b.barrel WHERE NOT EXISTS (FROM way w WHERE w.target = b.target AND w.barrel = b.barrel)
), told AS (
  SELECT target, barrel, arg_min(line, struct_pack(a := place, b := line)) AS line, string_agg(DISTINCT line, ',' ORDER BY line) AS lines FROM line_ GROUP BY 1, 2
), tests AS (
  SELECT DISTINCT target AS barrel, file FROM st WHERE typed AND NOT whole AND NOT other = 'n0' AND target IS NOT NULL AND NOT EXISTS (FROM st m WHERE m.target = st.target AND m.file = st.file AND m.other = 'n0')
), missed AS (
  SELECT t.target, t.barrel, count(*) AS n FROM told t JOIN tests x ON x.barrel = t.barrel WHERE NOT EXISTS (FROM st l WHERE l.flag = 'A' AND l.target = t.target AND l.file = x.file) GROUP BY 1, 2
)
SELECT t.target, t.barrel, line, lines, coalesce(n, 0) AS tests_not_listed FROM told t LEFT JOIN missed m ON m.target = t.target AND m.barrel = t.barrel"""


@query(_NEAR_SQL)
def nearest_passing_lines(spark, d):
    st = statements(spark, d, rings=True).where("target is not null")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.when(F.col("o_custkey") % 3 == 0, F.max("o_orderkey").over(Window.partitionBy("o_custkey")))
    ends = table(spark, d, "orders").select(named("o", "o_orderkey").alias("barrel"), F.coalesce(F.lag("o_orderkey").over(w), last).alias("one"), F.coalesce(F.lag("o_orderkey", 2).over(w), last).alias("two")).where("one is not null")
    ends = ends.withColumn("target", named("o", "one"))
    bars = ends.select("target", "barrel", F.col("target").alias("origin"), F.lit(0).alias("place")).unionByName(ends.where("two is not null").select("target", "barrel", named("o", "two").alias("origin"), F.lit(1).alias("place")))
    loading = st.select("file", "target", F.col("typed").alias("test"), F.col("whole").alias("type_only"), (F.col("other") == "n0").alias("replaces"))
    found = gaps.barrel_gaps(bars, st.where("flag <> 'A'").select("file", "line", "target"), loading, st.where("flag = 'A'").select("target", "file"))
    return found.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query("""WITH m AS (SELECT DISTINCT 'p' || l_partkey AS target, 'o' || l_orderkey AS methods_in, 'n' || l_linenumber AS name, l_linestatus = 'O' AS t FROM lineitem WHERE l_returnflag = 'A'),
s AS (SELECT DISTINCT 'p' || l_partkey AS target, 'o' || l_orderkey AS file, CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity >= 40 THEN '*' ELSE 'n' || l_linenumber END AS name, l_linestatus = 'O' AS test FROM lineitem WHERE l_returnflag <> 'A')
SELECT methods_in, file, line, min(m.name) AS name FROM s JOIN m ON m.target = s.target AND (s.name IS NULL OR s.name = '*' OR s.name = m.name) WHERE methods_in <> file AND (NOT m.t OR s.test) GROUP BY ALL""")
def method_takers(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    name, part, order, test = named("n", "l_linenumber"), named("p", "l_partkey"), named("o", "l_orderkey"), F.col("l_linestatus") == "O"
    methods = li.where("l_returnflag = 'A'").select(part.alias("type_file"), order.alias("file"), name.alias("name"), test.alias("test"))
    taken = F.when(F.col("l_quantity") < 5, None).when(F.col("l_quantity") >= 40, "*").otherwise(name)
    s = li.where("l_returnflag <> 'A'").select(order.alias("file"), F.col("l_linenumber").cast("int").alias("line"), part.alias("target"), taken.alias("name"), test.alias("test"))
    return gaps.method_takers(methods, s)


@query("""WITH hit AS (SELECT s_suppkey, c_custkey IS NOT NULL AND c_nationkey <> s_nationkey AS hit, c_custkey IS NOT NULL AND c_custkey % 10 = 0 AS again FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey),
ids AS (SELECT s_suppkey, '' AS rest FROM supplier UNION ALL SELECT DISTINCT l_suppkey, '::p' || l_partkey FROM lineitem)
SELECT 'supplier' AS source, 'x' || s_suppkey || rest AS id, 'x' || s_suppkey || CASE WHEN NOT hit THEN '' WHEN again THEN '+supplier+supplier' ELSE '+supplier' END || rest AS new_id FROM ids JOIN hit USING (s_suppkey)
UNION ALL SELECT 'customer', 'x' || c_custkey, 'x' || c_custkey FROM customer UNION ALL SELECT 'customer', 'x' || c_custkey || '+supplier', 'x' || c_custkey || '+supplier' FROM customer WHERE c_custkey % 10 = 0""")
def id_collisions(spark, d):
    """Customers and suppliers of one number have one id; some customers have the id that a renamed supplier would get."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    row = lambda source, ident, path, pos: [F.lit(source).alias("source"), F.lit(pos).alias("pos"), ident.alias("id"), path.alias("path")]
    x, y = named("x", "c_custkey"), named("x", "s_suppkey")
    rows = c.select(*row("customer", x, named("n", "c_nationkey"), 1)).unionByName(c.where("c_custkey % 10 = 0").select(*row("customer", F.concat(x, F.lit("+supplier")), F.lit("elsewhere"), 2)))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    rows = rows.unionByName(s.select(*row("supplier", y, named("n", "s_nationkey"), 1))).unionByName(li.select(*row("supplier", F.concat(named("x", "l_suppkey"), F.lit("::p"), F.col("l_partkey").cast("string")), F.lit("below"), 2)))
    return gaps.separated(rows, ["customer", "supplier"])
