"""Small source trees, end to end."""

import subprocess

import pytest

from tessera.plans.engine import Engine, parse_rules, render
from tessera.sources import code, git, manifests, snapshot

FILES = {
    "pyproject.toml": '[project]\nname = "shop"\ndependencies = [\n  "requests>=2",\n  "PyYAML",\n]\n[dependency-groups]\ndev = ["pytest"]\n',
    "requirements-dev.txt": "# tools\nruff==0.5  # lint\n-r other.txt\n",
    "shop/__init__.py": "from .cart import Cart\n__all__ = ['Cart']\n",
    "shop/cart.py": "import requests\nimport yaml\nimport os\nfrom shop.price import total\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .user import User\n\nclass Cart:\n    def add(self, x=1, *, y=None):\n        from shop import user\n",
    "shop/price.py": "import missing.thing\n\nRATE = 3\n\ndef total(items, tax=0.2, *rest, **more):\n    return sum(items)\n",
    "shop/user.py": "import importlib\nfrom . import cart\nimportlib.import_module(f'shop.plugins.{1}')\nclass User: pass\n",
    "tests/test_cart.py": "from shop.cart import Cart\n",
    "broken.py": "def (:\n",
    "web/package.json": '{\n  "name": "@shop/web",\n  "dependencies": {\n    "react": "18",\n    "lodash": "4"\n  }\n}\n',
    "web/src/app.ts": "import React from 'react';\nimport { fmt } from './format';\nexport * from './types.js';\n// import x from './comment'\nexport function App() { return fmt(1) }\n",
    "web/src/format.ts": "export const fmt = (n: number) => n;\nimport type { T } from './types';\n",
    "web/tsconfig.json": '{\n  // aliases\n  "compilerOptions": { "baseUrl": "./src", "paths": { "@/*": ["*"], "@fmt": ["format.ts"], }, },\n}\n',
    "kit/package.json": '{"name": "@shop/kit", "main": "lib/main.js"}',
    "kit/lib/main.js": "module.exports = require('./deep')\n",
    "kit/lib/deep.js": "",
    "web/src/more.ts": "import { T } from '@/types';\nimport f from '@fmt';\nimport { App } from 'app';\nimport kit from '@shop/kit';\nimport d from '@shop/kit/lib/deep';\n",
    "rs/app/Cargo.toml": '[package]\nname = "my-app"\n[dependencies]\nserde_json = "1"\n',
    "rs/app/src/main.rs": "mod cart;\nuse cart::Cart;\nuse serde_json::Value;\nuse base_kit::price::total;\nuse std::fmt;\nuse nowhere::X;\n",
    "rs/app/src/cart.rs": "pub mod line;\npub use self::line::Line;\nuse crate::cart::line::*;\npub struct Cart;\n",
    "rs/app/src/cart/line.rs": "use super::Cart;\nuse super::super::other::Y;\npub struct Line;\n",
    "rs/app/src/other/mod.rs": "pub struct Y;\n",
    "rs/kit/Cargo.toml": '[package]\nname = "base-kit"\n',
    "rs/kit/src/lib.rs": "pub mod price;\n",
    "rs/kit/src/price.rs": "pub fn total() {}\n",
    "web/src/types.ts": "export interface T { a: string }\n",
    "web/node_modules/react/index.js": "x",
    "dist/made.py": "import nothing\n",
    "ignored/x.py": "import nothing\n",
    ".gitignore": "ignored/\n*.log\n",
    "a.log": "",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "shop/cart.py", "shop/price.py")
    run("commit", "-qm", "one")
    (root / "shop/cart.py").write_text(FILES["shop/cart.py"] + "\n# more\n")
    (root / "shop/price.py").write_text(FILES["shop/price.py"] + "\n# more\n")
    run("commit", "-qam", "two")
    run("mv", "shop/price.py", "shop/pricing.py")
    run("commit", "-qm", "three")
    run("mv", "shop/pricing.py", "shop/price.py")
    run("commit", "-qm", "four")
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, tree):
    return Engine.scan(spark, tree)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).distinct().collect())


def test_scan_follows_ignore_files(engine):
    names = {r.path for r in engine.tree.collect()}
    assert "shop/cart.py" in names and not names & {"dist/made.py", "ignored/x.py", "a.log", "web/node_modules/react/index.js", ".gitignore"}


def test_manifests(engine):
    got = rows(engine.manifests.where("what = 'dependency'"), "file", "name", "section", "line")
    assert ("pyproject.toml", "pyyaml", "dependencies", 5) in got and ("pyproject.toml", "pytest", "group dev", 8) in got
    assert ("requirements-dev.txt", "ruff", "requirements", 2) in got and ("web/package.json", "lodash", "dependencies", 5) in got
    assert manifests.dev_word("requirements-dev.txt") == "dev" and manifests.dev_word("requirements.txt") is None


def test_imports_between_files(engine):
    got = rows(engine.evidence.where("target is not null"), "src", "dst", "line", "type_only", "scope")
    assert ("shop/__init__.py", "shop/cart.py", 1, False, "module") in got
    assert ("shop/cart.py", "shop/price.py", 4, False, "module") in got
    assert ("shop/cart.py", "shop/user.py", 7, True, "module") in got
    assert ("shop/cart.py", "shop/user.py", 11, False, "local") in got
    assert ("shop/user.py", "shop/cart.py", 2, False, "module") in got
    assert ("tests/test_cart.py", "shop/cart.py", 1, False, "module") in got
    assert ("web/src/app.ts", "web/src/format.ts", 2, False, "module") in got
    assert ("web/src/app.ts", "web/src/types.ts", 3, False, "module") in got
    assert ("web/src/format.ts", "web/src/types.ts", 2, True, "module") in got
    assert not any("comment" in d for _, d, *_ in got)


def test_aliases_and_packages_of_the_tree(engine):
    got = rows(engine.evidence.where("target is not null and (src like 'kit/%' or src = 'web/src/more.ts')"), "src", "dst", "line")
    assert got == [("kit/lib/main.js", "kit/lib/deep.js", 1), ("web/src/more.ts", "kit/lib/deep.js", 5), ("web/src/more.ts", "kit/lib/main.js", 4), ("web/src/more.ts", "web/src/app.ts", 3), ("web/src/more.ts", "web/src/format.ts", 2), ("web/src/more.ts", "web/src/types.ts", 1)]


def test_rust_paths(engine):
    got = sorted((a.removeprefix("rs/"), b.removeprefix("rs/"), n) for a, b, n in rows(engine.evidence.where("src like 'rs/%'"), "src", "dst", "line"))
    assert got == [("app/src/cart.rs", "app/src/cart/line.rs", 2), ("app/src/cart.rs", "app/src/cart/line.rs", 3), ("app/src/cart/line.rs", "app/src/cart.rs", 1), ("app/src/cart/line.rs", "app/src/other/mod.rs", 2), ("app/src/main.rs", "app/src/cart.rs", 2), ("app/src/main.rs", "ext:cargo:serde_json", 3), ("app/src/main.rs", "kit/src/price.rs", 4)]


def test_externals_and_gaps(engine):
    got = rows(engine.evidence.where("target is null and src not like 'rs/%'"), "src", "dst")
    assert got == [("shop/cart.py", "ext:pypi:pyyaml"), ("shop/cart.py", "ext:pypi:requests"), ("web/src/app.ts", "ext:npm:react")]
    assert rows(engine.unmapped, "src", "module", "reason") == [("rs/app/src/main.rs", "nowhere", "undeclared"), ("shop/price.py", "missing.thing", "undeclared")]
    assert rows(engine.facts.where("what = 'error'"), "file") == [("broken.py",)]
    assert rows(engine.facts.where("what = 'dynamic'"), "file", "module") == [("shop/user.py", "shop.plugins.")]


def test_symbols(engine):
    got = rows(engine.symbols, "id", "kind", "signature")
    assert ("shop/price.py::total", "function", "def total(items, tax=..., *rest, **more)") in got and ("shop/price.py::RATE", "constant", None) in got
    assert ("web/src/app.ts::App", "function", None) in got


def test_impact(engine):
    got = {(r.id, r.kind): (r.distance, r.test) for r in engine.impact("shop/price.py").collect()}
    assert got["shop/cart.py", "file"] == (1, False) and got["tests/test_cart.py", "file"] == (2, True) and got["shop", "component"] == (0, False)
    assert ("web/src/app.ts", "file") not in got


def test_query_and_resolve(engine):
    assert engine.resolve("Cart").first().answers == 2
    q = engine.query("shop/cart.py::Cart")
    assert q["component"].first().id == "shop/cart.py"
    assert "shop/__init__.py" in {r.src for r in q["importers"].collect()}
    assert engine.resolve("shop.price").first().found == "shop/price.py"
    assert {r.found for r in engine.resolve("form").collect()} >= {"web/src/format.ts"}
    with pytest.raises(LookupError):
        engine.impact("zzzzzz")


def test_check(engine):
    text = '[components]\nshop = "shop"\nweb = "web"\ngone = "nowhere"\n[[deny]]\nfrom = "shop"\nto = "ext:pypi:requests"\n[layers]\norder = ["web", "shop"]\n[undeclared_imports]\nignore = ["other"]\n[cycles]\n'
    findings, _ = engine.check(text)
    got = rows(findings, "kind", "subject", "object")
    assert ("unmatched_selector", "gone", "nowhere") in got and ("denied", "shop/cart.py", "ext:pypi:requests") in got and ("undeclared", "shop/price.py", "missing.thing") in got
    cycles = rows(findings.where("kind = 'cycle'"), "subject", "object")
    assert {("rs/app/src/cart.rs", "rs/app/src/cart.rs"), ("rs/app/src/cart/line.rs", "rs/app/src/cart.rs")} <= set(cycles)
    assert ("unmatched_ignore", "other", None) in got
    within, _ = engine.check('[components]\n[cycles]\nwithin = ["shop"]\n')
    assert {s for s, _ in rows(within.where("kind = 'cycle'"), "subject", "object")} == {s for s, _ in cycles if s.startswith("shop")}
    with pytest.raises(ValueError):
        parse_rules(engine.spark, "[nonsense]\nx = 1\n")


def test_summary(engine):
    s = engine.summary(1)
    assert {r.language: r.files for r in s["languages"].collect()} == {"Python": 6, "TypeScript": 4, "JavaScript": 2, "Rust": 6}
    assert ("ext:pypi:requests", 1) in rows(s["externals"], "dst", "importers")
    assert "most_depended_on:" in render(s)


def test_history(engine):
    h = engine.history
    assert [len(r.parents) for r in h["commits"].orderBy("pos").collect()] == [1, 1, 1, 0]
    assert rows(h["changes"].where("kind = 'renamed'"), "path", "renamed_from", "similarity") == [("shop/price.py", "shop/pricing.py", 100), ("shop/pricing.py", "shop/price.py", 100)]
    top = engine.co_change("shop/cart.py").first()
    assert (top.path, top.shared, top.own) == ("shop/price.py", 2, 2)


def test_no_history(spark, tmp_path):
    assert git.read(spark, str(tmp_path))["state"].first().state == "no_repository"


def test_snapshot(spark, tmp_path, engine):
    path = str(tmp_path / "s" / "snap.json")
    assert snapshot.read(spark, path) is None
    item = {"number": 1, "kind": "issue", "id": "i", "state": "open", "created_at": "t", "updated_at": "t"}
    end = lambda n: {"kind": "item", "item": n}
    snapshot.write_whole(path, {"schema": 1, "items": [item, item | {"state": "closed"}, item | {"number": 2, "commits": ["c"], "merged_at": "t"}], "relations": [{"type": "closes", "from": end(2), "to": end(1), "observed": ["a"]}, {"type": "closes", "from": end(2), "to": end(1), "observed": ["b"], "will_close": True}]})
    s = snapshot.read(spark, path)
    assert rows(s["items"], "number", "state") == [(1, "closed"), (2, "open")]
    r = s["relations"].collect()
    assert len(r) == 1 and r[0].observed == ["a", "b"] and r[0].will_close
    assert rows(engine.work(path)["unmatched"], "number") == [(2,)]
    snapshot.write_whole(path, {"schema": 2})
    with pytest.raises(ValueError):
        snapshot.read(spark, path)


def test_recorded_nodes(spark):
    import json

    nodes = [{"number": 12, "__typename": "Issue", "state": "OPEN", "parent": {"number": 3}, "closedByPullRequestsReferences": {"nodes": [{"number": 15}]}}, {"number": 15, "__typename": "PullRequest", "state": "MERGED", "mergedAt": "t", "mergeCommit": {"oid": "m"}, "commits": {"nodes": [{"commit": {"oid": "a"}}]}, "closingIssuesReferences": {"nodes": [{"number": 12}]}}]
    got = snapshot.from_nodes(spark.createDataFrame([(json.dumps(n),) for n in nodes], "json string"))
    r = {(x.type, x["from"].item, x.to.item): x.observed for x in got["relations"].collect()}
    assert r == {("sub_issue", 3, 12): ["parent"], ("closes", 15, 12): ["closedByPullRequestsReferences", "closingIssuesReferences"]}


def test_rust_facts():
    text = '// use a::no;\nuse crate::model::{self, Item as Thing, deep::{A, B}};\npub use std::fs::*;\nmod inner;\npub struct S;\npub fn run<T>(x: T) -> S { println!("use z::q;"); S }\n'
    got = [(x["what"], x.get("module"), x.get("name"), x.get("alias"), x["line"]) for x in code.rust_facts(text)]
    assert ("import", "crate::model", "Item", "Thing", 2) in got and ("import", "crate::model::deep", "B", None, 2) in got and ("import", "crate", "model", None, 2) in got
    assert ("star", "std::fs", "*", None, 3) in got and ("module", None, "inner", None, 4) in got and ("symbol", None, "run", None, 6) in got
    assert not any(x[2] in ("no", "q") for x in got)


def test_cargo():
    rows_ = list(manifests.cargo('[package]\nname = "my-app"\n[dependencies]\nserde = "1"\nlocal = { path = "../local" }\n[dev-dependencies]\nx.workspace = true\n[[bin]]\nname = "tool"\npath = "src/t.rs"\n'))
    assert ("dependency", "serde", "normal", "1", 4) in rows_ and ("dependency", "local", "normal", "path:../local", 5) in rows_ and ("dependency", "x", "dev", "workspace", 7) in rows_ and ("target", "tool", "bin", "src/t.rs", None) in rows_ and rows_[0][:4] == ("package", "my-app", "lib", "my_app")


def test_python_uses():
    from tessera.sources.uses import environment_uses, python_uses

    text = "import m\nfrom m import C\nclass D(C): pass\n@C\ndef f(x: C, m=1) -> C:\n    m.g()\n    return C(x)\nm.g(C)\nm.h = 1\ny: C = [m.g for _ in ()]\ndef k():\n    C = 1\n    return C\n"
    got = sorted((n, line, role) for n, line, _, role, _ in python_uses(text, {"C", "m.g", "m.h"}))
    assert got == [("C", 3, "subclass"), ("C", 4, "decorator"), ("C", 5, "annotation"), ("C", 5, "annotation"), ("C", 7, "call"), ("C", 8, "read"), ("C", 10, "annotation"), ("m.g", 8, "call"), ("m.g", 10, "read"), ("m.h", 9, "write")]
    text = "import os\nfrom os import environ as e, getenv\na = os.environ['A']\ne['B'] = '1'\nos.getenv('C', 'x'); getenv(a)\n'D' in os.environ\ne.get('E')\ndict(os.environ)\n"
    assert sorted((n or "", line, role) for n, line, _, role, _ in environment_uses(text)) == [("", 5, "computed read"), ("", 8, "whole"), ("A", 3, "read"), ("B", 4, "write"), ("C", 5, "read"), ("D", 6, "read"), ("E", 7, "read")]


def test_uses_of_a_tree(spark, tree, engine):
    from tessera.sources import uses

    content = uses.read_from(tree, engine.tree)
    got = uses.uses(content, spark.createDataFrame([("shop/cart.py", "total"), ("tests/test_cart.py", "Cart"), ("broken.py", "x")], "file string, name string"))
    assert got.count() == 0  # imported, never used
    assert uses.environment(content).count() == 0


def test_text_under_a_budget():
    from tessera.plans.engine import trimmed

    text = trimmed({"a": ["x" * 50] * 400, "b": ["y"] * 12})
    assert len(text.encode()) <= 8192 and "more" in text and text.count("- y") == 12
    assert trimmed({"a": ["x" * 5000] * 12}).count("- x") == 10


def test_tree_under_a_cap(engine):
    from tessera.operators import graph, uses

    shown = uses.tree_under_cap(engine.components, graph.dependents(engine.evidence), 4)
    assert len(shown) <= 4 and shown[0] == "." and all(x == "." or x.rpartition("/")[0] in ("", *shown) for x in shown)
