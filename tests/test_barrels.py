"""Names through barrels: small planted shapes, and whole trees through the engine."""

import pytest

from tessera.operators import barrels
from tessera.plans.engine import Engine

STATEMENT = "file string, line int, target string, name string, alias string, passes_on boolean, test boolean, found boolean"


def statements(spark, rows):
    return spark.createDataFrame([(f, i, t, n, a, p, False, None) for i, (f, t, n, a, p) in enumerate(rows)], STATEMENT)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_links(spark):
    s = statements(spark, [
        ("index", "a", "*", None, True), ("index", "b", "z", None, True),
        ("top", "index", "*", None, True), ("ns", "index", "*", "lib", True), ("renamed", "a", "x", "ex", True),
        ("takes_x", "index", "x", None, False), ("takes_z", "index", "z", None, False), ("takes_whole", "index", "*", None, False), ("loads", "index", None, None, False), ("takes_own", "index", "mine", None, False),
        ("far_x", "top", "x", None, False), ("far_q", "top", "q", None, False), ("takes_lib", "ns", "lib", None, False), ("takes_ex", "renamed", "ex", None, False), ("takes_old", "renamed", "x", None, False),
        ("a_self", "a", "x", None, False),
    ])
    symbols = table(spark, [("a", "x"), ("a", "y"), ("b", "z"), ("index", "mine")], "file string, name string")
    changed = table(spark, [("c", "a")], "change string, file string")
    links, passes = barrels.passed_on(changed, s, symbols)
    got = {(r.barrel, r.file) for r in links.collect()}
    assert got == {("index", "top"), ("index", "ns"), ("index", "takes_x"), ("index", "takes_whole"), ("index", "loads"), ("top", "far_x"), ("ns", "takes_lib"), ("renamed", "takes_ex")}
    how = {(r.file, r.name, r.how) for r in passes.collect()}
    assert how == {("index", None, "any"), ("top", None, "any"), ("ns", "lib", "exact"), ("renamed", "ex", "exact")}
    # A circle of barrels ends; what one of them passes on from outside may hold any name.
    s = statements(spark, [("p", "a", "*", None, True), ("p", "q", "*", None, True), ("q", "p", "*", None, True), ("a", None, "*", None, True), ("u", "q", "unheard", None, False)])
    assert {(r.barrel, r.file) for r in barrels.passed_on(changed, s, symbols)[0].collect()} == {("p", "q"), ("q", "p"), ("q", "u")}
    assert barrels.passed_on(changed.limit(0), s, symbols)[0].collect() == []


def test_names_of_changed_files(spark):
    s = statements(spark, [("a", "b", "*", None, True), ("b", "c", "n", "m", True), ("u", "a", "used", None, False), ("c", None, "*", None, True), ("b", "d", "*", "space", True)])
    symbols = table(spark, [("a", "own"), ("b", "below"), ("c", "hidden"), ("d", "deep")], "file string, name string")
    got = barrels.exports_of(table(spark, [("1", "a"), ("2", "c")], "change string, file string"), s, symbols).collect()
    assert {(r.change, r.name, r.open) for r in got} == {("1", "own", False), ("1", "below", False), ("1", "m", False), ("1", "used", False), ("1", "space", False), ("2", "hidden", False), ("2", "n", False), ("2", None, True)}


TREE = {
    "lib/a.ts": "export const x = 1;\nexport function y() {}\n",
    "lib/b.ts": "export const z = 2;\n",
    "lib/index.ts": "export * from './a';\nexport { z } from './b';\n",
    "lib/again.ts": "import { x } from './index';\nexport { x as ex };\n",
    "app/uses_x.ts": "import { x } from '../lib/index';\n",
    "app/uses_z.ts": "import { z } from '../lib/index';\n",
    "app/uses_ex.ts": "import { ex } from '../lib/again';\n",
    "app/whole.ts": "import * as lib from '../lib/index';\n",
    "app/below_z.ts": "import { q } from './uses_z';\n",
    "pkg/__init__.py": "from .m import f\nfrom .n import g as h\n",
    "pkg/m.py": "def f(): pass\n",
    "pkg/n.py": "def g(): pass\n",
    "takes_f.py": "from pkg import f\n",
    "takes_h.py": "from pkg import h\n",
    "below_f.py": "import takes_f\n",
    "tests/test_f.py": "from pkg import f\n",
    "secret/key.ts": "export const key = 1;\n",
    "lib/gate.ts": "export { key } from '../secret/key';\n",
    "app/opens.ts": "import { key } from '../lib/gate';\nimport('./parts/' + key);\n",
    "app/parts/one.ts": "export const one = 1;\n",
    "app/lost.ts": "import { one } from 'nowhere/one';\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("barrels")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Engine.scan(spark, str(root))


def test_definitions_of_a_tree(engine):
    got = {(r.target, r.name): (r.def_file, r.def_name) for r in engine.definitions.collect()}
    assert got.pop(("lib/gate.ts", "key")) == ("secret/key.ts", "key")
    assert got == {("lib/index.ts", "x"): ("lib/a.ts", "x"), ("lib/index.ts", "z"): ("lib/b.ts", "z"), ("lib/again.ts", "ex"): ("lib/a.ts", "x"), ("pkg/__init__.py", "f"): ("pkg/m.py", "f"), ("pkg/__init__.py", "h"): ("pkg/n.py", "g")}
    importers = {r.src for r in engine.query("lib/a.ts::x")["importers"].collect()}
    assert importers == {"lib/index.ts", "lib/again.ts", "app/uses_x.ts", "app/uses_ex.ts"}


def test_impact_follows_names(engine):
    reach = lambda target: {r.id: r.distance for r in engine.impact(target).where("kind = 'file'").collect()}
    assert reach("lib/a.ts") == {"lib/a.ts": 0, "lib/index.ts": 1, "lib/again.ts": 1, "app/uses_x.ts": 1, "app/uses_ex.ts": 1, "app/whole.ts": 2}
    assert reach("lib/b.ts") == {"lib/b.ts": 0, "lib/index.ts": 1, "app/uses_z.ts": 1, "app/whole.ts": 2, "app/below_z.ts": 2}
    got = {r.id: (r.distance, r.test) for r in engine.impact("pkg/m.py").where("kind = 'file'").collect()}
    assert got == {"pkg/m.py": (0, False), "pkg/__init__.py": (1, False), "takes_f.py": (1, False), "below_f.py": (2, False), "tests/test_f.py": (1, True)}
    assert "takes_h.py" in reach("pkg/__init__.py")


def test_rules_see_through_re_exports(engine):
    text = '[components]\napp = "app"\nlib = "lib"\nsecret = "secret"\n[[deny]]\nfrom = "app"\nto = "secret"\n'
    got = {(r.subject, r.object) for r in engine.check(text)[0].where("kind = 'denied'").collect()}
    assert got == {("app/opens.ts", "secret/key.ts")}


def test_gaps_of_files(engine):
    got = {(r.subject, r.kind): (r.total, [(x.file, x.line) for x in r.shown]) for r in engine.gaps().collect()}
    assert got == {("app/parts/one.ts", "dynamic"): (1, [("app/opens.ts", 2)]), ("app/parts/one.ts", "named"): (1, [("app/lost.ts", 1)])}
