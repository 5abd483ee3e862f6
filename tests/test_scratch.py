"""Loops delete the tables of their rounds: what stays in the shared folder is what the result reads."""

import os

from tessera.operators import barrels, definitions, graph, modules, settings
from tessera.session import shared_folder

LONG = 12
_BOUND = "file string, name string, target string, inner string, line int, type_only boolean"
_STAR = "file string, target string, line int, type_only boolean"


def _tables(spark):
    top = shared_folder(spark).removeprefix("file://")
    return {at for at, _, names in os.walk(top) if any(n.startswith("part-") and not n.endswith(".crc") for n in names)}


def _left(spark, make):
    before = _tables(spark)
    rows = make().collect()
    new = _tables(spark) - before
    assert not [at for at in new if "/rdd-" in at], "a checkpoint"
    return rows, len(new)


def _chain(spark):
    exports = [("f0", "a", "local", None, None, 1, False)] + [(f"f{i}", "a", "reexport", f"f{i - 1}", "a", 1, False) for i in range(1, LONG)]
    return spark.createDataFrame(exports, "file string, name string, kind string, target string, inner string, line int, type_only boolean"), spark.createDataFrame([], _STAR)


def test_exported(spark):
    exports, stars = _chain(spark)
    rows, left = _left(spark, lambda: definitions.exported_definitions(exports, stars, exports.select("file", "name")))
    assert {(r.status, r.def_file) for r in rows} == {("found", "f0")} and len(rows) == LONG
    assert left <= 12


def test_bound(spark):
    bound = spark.createDataFrame([(f"f{i}", "a", f"f{i - 1}", "a", 1, False) for i in range(1, LONG)], _BOUND)
    own, stars = spark.createDataFrame([("f0", "a")], "file string, name string"), spark.createDataFrame([], _STAR)
    rows, left = _left(spark, lambda: definitions.bound_definitions(own, bound, stars, spark.createDataFrame([], "file string, names array<string>"), bound.select("file", "name")))
    assert {(r.status, r.def_file) for r in rows} == {("through", "f0")} and len(rows) == LONG - 1
    assert left <= 20


def test_spelled(spark):
    exports, stars = _chain(spark)
    symbols = spark.createDataFrame([("s", "f0", "a")], "symbol string, file string, name string")
    rows, left = _left(spark, lambda: definitions.spellings(exports, stars, symbols))
    assert {r.module for r in rows} == {f"f{i}" for i in range(LONG)} and left <= 12


def test_settings(spark):
    configs = spark.createDataFrame([("c0", '{"a": 1}')] + [(f"c{i}", "{}") for i in range(1, 6)], "config string, json string")
    up = spark.createDataFrame([(f"c{i}", f"c{i - 1}", 1) for i in range(1, 6)], "config string, target string, pos int")
    rows, left = _left(spark, lambda: settings.settings(configs, up, spark.createDataFrame([("c5", "/a")], "config string, pointer string")))
    assert [(r.value, r.set_by) for r in rows] == [("1", "c0")] and left <= 9


def test_modules(spark):
    files = spark.createDataFrame([("lib.rs",), ("m.rs",), ("m/n.rs",)], "path string")
    declared = spark.createDataFrame([("lib.rs", "", "m", 1, None), ("m.rs", "", "n", 1, None)], "file string, inside string, name string, line int, path string")
    roots, inline = spark.createDataFrame([("c", "lib.rs")], "crate string, file string"), spark.createDataFrame([], "file string, inside string, name string")
    rows, left = _left(spark, lambda: modules.forest(roots, declared, inline, files)[0])
    assert {(r.module, r.file) for r in rows} == {("", "lib.rs"), ("m", "m.rs"), ("m::n", "m/n.rs")} and left <= 10


def test_barrels(spark):
    rows_ = [(f"f{i}", 1, f"f{i - 1}", "*", None, True, False, False) for i in range(1, LONG)] + [("u", 1, f"f{LONG - 1}", "a", None, False, False, False)]
    s = spark.createDataFrame(rows_, "file string, line int, target string, name string, alias string, passes_on boolean, test boolean, found boolean")
    changed, symbols = spark.createDataFrame([("f0", "f0")], "change string, file string"), spark.createDataFrame([("f0", "a")], "file string, name string")
    links, left = _left(spark, lambda: barrels.passed_on(changed, s, symbols)[0])
    assert ("u", f"f{LONG - 1}") in {(r.file, r.barrel) for r in links} and left <= 2 * LONG + 12


def test_strong(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    rows, _ = _left(spark, lambda: graph.strong_components(edges))
    assert {(r.id, r.component) for r in rows} == {("a", "a"), ("b", "a")}
