"""Globs and shadowing, module trees, spellings and settings, on small planted shapes."""

import random

import pytest

from tessera.operators import definitions, modules, settings
from tessera.plans.engine import Engine

ITEMS, USES, GLOBS = "module string, name string, public boolean", "module string, name string, target string, inner string, public boolean, line int", "module string, target string, public boolean, line int"


def looked_up(spark, items, uses, globs, asked, **more):
    table = spark.createDataFrame
    got = modules.glob_definitions(table(items, ITEMS), table(uses, USES), table(globs, GLOBS), table(asked, "from string, module string, name string"), **more).collect()
    assert len(got) == len(asked)
    return {(r["from"], r.module, r.name): (r.status, r.def_module, r.def_name) for r in got}


def test_globs(spark):
    items = [("a", "x", True), ("b", "x", True), ("a", "only", True), ("own", "x", True), ("p", "secret", False), ("p", "open", True), ("q", "deep", True)]
    uses = [("named", "x", "a", "x", True, 1), ("renamed", "y", "a", "x", True, 1), ("closed", "x", "a", "x", False, 1), ("out", "x", None, "x", True, 1), ("bad", "z", "a", "gone", True, 1)]
    globs = [("both", "a", True, 1), ("both", "b", True, 2), ("own", "a", True, 1), ("same", "a", True, 1), ("same", "named", True, 2), ("above", "both", True, 1), ("p::in", "p", True, 1), ("far", "p", True, 1), ("r1", "r2", True, 1), ("r2", "r1", True, 1), ("r2", "q", True, 2), ("private", "q", False, 1), ("shadow", "a", True, 1), ("shadow", "closed", True, 2)]
    asks = {
        ("z", "both", "x"): ("unknown", None, None), ("z", "both", "only"): ("found", "a", "only"), ("z", "above", "x"): ("unknown", None, None),
        ("z", "own", "x"): ("found", "own", "x"), ("z", "same", "x"): ("found", "a", "x"), ("z", "renamed", "y"): ("found", "a", "x"),
        ("p::in", "p::in", "secret"): ("found", "p", "secret"), ("far", "far", "secret"): ("missing", None, None), ("far", "far", "open"): ("found", "p", "open"),
        ("z", "p", "secret"): ("missing", None, None), ("p", "p", "secret"): ("found", "p", "secret"),
        ("z", "r1", "deep"): ("found", "q", "deep"), ("z", "r1", "nothing"): ("missing", None, None),
        ("z", "private", "deep"): ("missing", None, None), ("private::sub", "private", "deep"): ("found", "q", "deep"),
        ("z", "out", "x"): ("unknown", None, None), ("z", "bad", "z"): ("unknown", None, None), ("z", "shadow", "x"): ("found", "a", "x"),
    }
    assert looked_up(spark, items, uses, globs, list(asks)) == asks
    assert looked_up(spark, [], [], [], []) == {}


def test_one_definition_from_within_and_without(spark):
    """A module that sees what is private, and one that doesn't, find the same item: no disagreement."""
    got = looked_up(spark, [("n", "x", True)], [], [("n::c", "n", True, 1), ("n::c", "m", True, 2), ("m", "n", True, 1)], [("n::c", "n::c", "x")])
    assert got == {("n::c", "n::c", "x"): ("found", "n", "x")}


@pytest.mark.parametrize("seed", range(2))
def test_globs_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    mods = [f"m{i}" for i in range(6)] + [f"m{i}::s{k}" for i in range(6) for k in range(2)]
    names = "abc"
    items = {(m, n): rnd.random() < 0.6 for m in mods for n in names if rnd.random() < 0.25}
    globs = sorted({(m, rnd.choice(mods), rnd.random() < 0.7) for m in mods for _ in range(rnd.choice([0, 1, 1, 2]))})
    sees = lambda a, b: a == b or a.startswith(b + "::")
    found = {(m, o, n): ({m} if (m, n) in items and (o or items[m, n]) else set()) for m in mods for o in (True, False) for n in names}
    own = {k for k, v in found.items() if v}
    for _ in range(60):  # sets only grow
        for m, o, n in found:
            if (m, o, n) not in own:
                for g in globs:
                    if g[0] == m and g[1] != m and (o or g[2]):
                        found[m, o, n] |= found[g[1], sees(m, g[1]), n]
    asked = [(f, m, n) for f in rnd.sample(mods, 5) for m in mods for n in names]
    want = {}
    for f, m, n in asked:
        at = found[m, sees(f, m), n]
        want[f, m, n] = ("missing", None, None) if not at else ("found", *at, n) if len(at) == 1 else ("unknown", None, None)
    assert looked_up(spark, [(m, n, p) for (m, n), p in items.items()], [], [(m, g, p, 1) for m, g, p in globs], asked) == want


def test_forest(spark):
    table = spark.createDataFrame
    files = ["src/lib.rs", "src/a.rs", "src/a/deep.rs", "src/b/mod.rs", "src/b/low.rs", "src/w/in.rs", "src/odd/place.rs", "src/c.rs", "src/c/mod.rs", "tests/t.rs", "src/bin/tool.rs"]
    declared = [
        ("src/lib.rs", "", "a", 1, None), ("src/lib.rs", "", "b", 2, None), ("src/lib.rs", "w", "in", 3, None), ("src/lib.rs", "", "far", 4, "odd/place.rs"), ("src/lib.rs", "", "again", 5, "a.rs"), ("src/lib.rs", "", "none", 6, None), ("src/lib.rs", "", "c", 7, None),
        ("src/a.rs", "", "deep", 1, None), ("src/b/mod.rs", "", "low", 1, None), ("src/b/low.rs", "", "back", 1, "../lib.rs"), ("tests/t.rs", "", "a", 1, "../src/a.rs"),
    ]
    inline = [("src/lib.rs", "", "w"), ("src/a.rs", "", "tests")]
    got, refused = modules.forest(table([("lib", "src/lib.rs"), ("t", "tests/t.rs")], "crate string, file string"), table(declared, "file string, inside string, name string, line int, path string"), table(inline, "file string, inside string, name string"), table([(f,) for f in files], "path string"))
    assert {(r.crate, r.module, r.file, r.inside) for r in got.collect()} == {
        ("lib", "", "src/lib.rs", ""), ("lib", "a", "src/a.rs", ""), ("lib", "a::deep", "src/a/deep.rs", ""), ("lib", "a::tests", "src/a.rs", "tests"), ("lib", "b", "src/b/mod.rs", ""), ("lib", "b::low", "src/b/low.rs", ""),
        ("lib", "w", "src/lib.rs", "w"), ("lib", "w::in", "src/w/in.rs", ""), ("lib", "far", "src/odd/place.rs", ""), ("lib", "c", "src/c.rs", ""), ("t", "", "tests/t.rs", ""), ("t", "a", "src/a.rs", ""), ("t", "a::deep", "src/a/deep.rs", ""), ("t", "a::tests", "src/a.rs", "tests"),
    }
    assert {(r.crate, r.module, r.line, r.file) for r in refused.collect()} == {("lib", "again", 5, "src/a.rs"), ("lib", "none", 6, None), ("lib", "b::low::back", 1, "src/lib.rs")}
    assert got.where("module = 'a::deep' and crate = 'lib'").first().parent == "a"


def test_rust_modules_of_a_tree(spark, tmp_path):
    tree = {
        "kit/Cargo.toml": '[package]\nname = "kit"\nautotests = false\n[[bench]]\nname = "speed"\npath = "perf/speed.rs"\n',
        "kit/src/lib.rs": 'pub mod a;\nmod w {\n    pub mod inner;\n    mod x { mod y; }\n}\n#[path = "odd.rs"]\nmod strange;\nmod gone;\n',
        "kit/src/a.rs": "", "kit/src/w/inner.rs": "", "kit/src/w/x/y.rs": "", "kit/src/odd.rs": "", "kit/src/bin/tool.rs": "mod help;\n", "kit/src/bin/help.rs": "", "kit/tests/t.rs": "", "kit/perf/speed.rs": "",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    grown, refused = Engine.scan(spark, str(tmp_path)).rust_modules
    of = lambda crate: {(r.module, r.file) for r in grown.where(f"crate = '{crate}'").collect()}
    lib = "kit/src/lib.rs"
    assert of(lib) == {("", lib), ("a", "kit/src/a.rs"), ("w", lib), ("w::inner", "kit/src/w/inner.rs"), ("w::x", lib), ("w::x::y", "kit/src/w/x/y.rs"), ("strange", "kit/src/odd.rs")}
    assert of("kit/src/bin/tool.rs") == {("", "kit/src/bin/tool.rs"), ("help", "kit/src/bin/help.rs")}
    assert {r.crate for r in grown.collect()} == {lib, "kit/src/bin/tool.rs", "kit/src/bin/help.rs", "kit/perf/speed.rs"}
    assert [(r.module, r.line) for r in refused.collect()] == [("gone", 8)]


def test_spellings(spark):
    exports = [("a", "x", "local", None, None, 1, False), ("a", "ex", "alias", None, "x", 2, False), ("i", "y", "reexport", "a", "x", 1, False), ("n", "ns", "namespace", "i", None, 1, False), ("s", "x", "local", None, None, 1, False), ("r1", "up", "namespace", "r2", None, 1, False), ("r2", "down", "namespace", "r1", None, 1, False), ("r2", "z", "reexport", "a", "x", 2, False)]
    stars = [("i", "a", 2, False), ("s", "a", 1, False), ("t", "n", 1, False)]
    got = definitions.spellings(spark.createDataFrame(exports, "file string, name string, kind string, target string, inner string, line int, type_only boolean"), spark.createDataFrame(stars, "file string, target string, line int, type_only boolean"), spark.createDataFrame([("S", "a", "x")], "symbol string, file string, name string"), most=3)
    assert {(r.module, ".".join(r.path)) for r in got.collect()} == {
        ("a", "x"), ("a", "ex"), ("i", "y"), ("i", "x"), ("i", "ex"), ("n", "ns.y"), ("n", "ns.x"), ("n", "ns.ex"), ("s", "ex"), ("t", "ns.y"), ("t", "ns.x"), ("t", "ns.ex"),
        ("r2", "z"), ("r1", "up.z"), ("r2", "down.up.z"),
    }


def test_settings(spark):
    up = lambda a, b, k=0: (a, b, k)
    configs = [("leaf", "{}"), ("c1", "{}"), ("c2", "{}"), ("c3", "{}"), ("c4", '{"o": {"paths": {"@": ["x"]}, "strict": null}}'), ("two", "{}"), ("first", '{"o": {"t": 1}}'), ("last", '{"o": {"t": 2}}'), ("none", '{"o": {"t": null}}'), ("nulls", "{}"), ("r1", "{}"), ("r2", "{}"), ("bad", "no json {"), ("odd", '{"a/b": {"c.d": true}}')]
    extends = [up("leaf", "c1"), up("c1", "c2"), up("c2", "c3"), up("c3", "c4"), up("two", "first", 0), up("two", "last", 1), up("nulls", "first", 0), up("nulls", "none", 1), up("r1", "r2"), up("r2", "r1"), up("bad", "first"), up("leaf", None, 1)]
    asked = [("leaf", "/o/paths"), ("leaf", "/o/strict"), ("leaf", "/o/none"), ("two", "/o/t"), ("nulls", "/o/t"), ("r1", "/o/t"), ("bad", "/o/t"), ("odd", "/a~1b/c.d"), ("gone", "/o")]
    table = spark.createDataFrame
    run = lambda **more: {(r.config, r.pointer): (r.value, r.set_by) for r in settings.settings(table(configs, "config string, json string"), table(extends, "config string, target string, pos int"), table(asked, "config string, pointer string"), **more).collect()}
    got = run()
    assert got["leaf", "/o/paths"] == ('{"@":["x"]}', "c4") and got["leaf", "/o/strict"] == ("null", "c4") and got["leaf", "/o/none"] == (None, None)
    assert got["two", "/o/t"] == ("2", "last") and got["nulls", "/o/t"] == ("null", "none") and got["r1", "/o/t"] == (None, None)
    assert got["bad", "/o/t"] == ("1", "first") and got["odd", "/a~1b/c.d"] == ("true", "odd") and got["gone", "/o"] == (None, None)
    assert run(depth=3)["leaf", "/o/paths"] == (None, None)


def test_aliases_are_inherited(spark, tmp_path):
    tree = {
        "tsconfig.base.json": '{"compilerOptions": {"paths": {"@lib/*": ["lib/src/*"]}}}', "web/tsconfig.json": '{"extends": "./config/tsconfig.mid"}', "web/config/tsconfig.mid.json": '{"extends": ["../../tsconfig.base.json"], "compilerOptions": {"strict": true}}',
        "own/tsconfig.json": '{"extends": "../tsconfig.base", "compilerOptions": {"baseUrl": "code"}}', "lib/src/thing.ts": "export const thing = 1;\n", "own/code/plain.ts": "export const p = 1;\n", "own/code/lib/src/thing.ts": "",
        "web/app.ts": "import { thing } from '@lib/thing';\n", "own/app.ts": "import { p } from 'plain';\nimport '@lib/thing';\n", "out.ts": "import '@lib/thing';\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.file, r.line): r.target for r in Engine.scan(spark, str(tmp_path)).imports.collect()}
    assert got == {("web/app.ts", 1): "lib/src/thing.ts", ("own/app.ts", 1): "own/code/plain.ts", ("own/app.ts", 2): "own/code/lib/src/thing.ts", ("out.ts", 1): None}
