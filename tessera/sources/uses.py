"""Uses of names in Python sources, on demand: what a file does with the names it imports, and with the environment."""

from __future__ import annotations

import ast
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import workers_can_import

SCHEMA = "file string, name string, line int, col int, role string, scope string"


def python_uses(text: str, wanted: set[str]) -> Iterator[tuple[str, int, int, str, str]]:
    """name, line, column (1-based), role and scope of every use of the wanted names, or of a bound name's attribute.

    A function that binds a name itself hides it. Roles: call, subclass, annotation, decorator, write, read.
    """
    tree = ast.parse(text)

    def bound(node: ast.AST) -> set[str]:
        args = node.args
        own = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]}
        free = set()
        if not isinstance(node, ast.Lambda):
            todo = list(node.body)
            while todo:
                n = todo.pop()
                if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    own.add(n.name)
                    continue
                if isinstance(n, ast.Global | ast.Nonlocal):
                    free |= set(n.names)
                if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    own.add(n.id)
                todo += ast.iter_child_nodes(n)
        return own - free

    def walk(n: ast.AST, hidden: frozenset[str], role: str, scope: str) -> Iterator[tuple[str, int, int, str, str]]:
        if isinstance(n, ast.Name):
            if n.id in wanted and n.id not in hidden:
                yield n.id, n.lineno, n.col_offset + 1, "write" if isinstance(n.ctx, ast.Store | ast.Del) else role, scope
            return
        if isinstance(n, ast.Attribute):
            dotted, at = n.attr, n.value
            while isinstance(at, ast.Attribute):
                dotted, at = f"{at.attr}.{dotted}", at.value
            if isinstance(at, ast.Name) and at.id not in hidden and f"{at.id}.{dotted}" in wanted:
                yield f"{at.id}.{dotted}", n.lineno, n.col_offset + 1, "write" if isinstance(n.ctx, ast.Store | ast.Del) else role, scope
                return
            yield from walk(n.value, hidden, "read", scope)
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            if not isinstance(n, ast.Lambda):
                for d in n.decorator_list:
                    yield from walk(d.func if isinstance(d, ast.Call) else d, hidden, "decorator", scope)
                for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                    if a.annotation:
                        yield from walk(a.annotation, hidden, "annotation", scope)
                if n.returns:
                    yield from walk(n.returns, hidden, "annotation", scope)
            for d in [*n.args.defaults, *filter(None, n.args.kw_defaults)]:
                yield from walk(d, hidden, "read", scope)
            inner = hidden | bound(n)
            for x in n.body if isinstance(n.body, list) else [n.body]:
                yield from walk(x, inner, "read", "local")
        elif isinstance(n, ast.ClassDef):
            for b in n.bases:
                yield from walk(b, hidden, "subclass", scope)
            for x in [*n.decorator_list, *n.keywords, *n.body]:
                yield from walk(x, hidden, "read", scope)
        elif isinstance(n, ast.Call):
            yield from walk(n.func, hidden, "call", scope)
            for x in [*n.args, *n.keywords]:
                yield from walk(x, hidden, "read", scope)
        elif isinstance(n, ast.AnnAssign):
            yield from walk(n.annotation, hidden, "annotation", scope)
            for x in filter(None, (n.target, n.value)):
                yield from walk(x, hidden, "read", scope)
        else:
            for x in ast.iter_child_nodes(n):
                yield from walk(x, hidden, role if isinstance(n, ast.Subscript) and role in ("annotation", "subclass") else "read", scope)

    yield from walk(tree, frozenset(), "read", "module")


def environment_uses(text: str) -> Iterator[tuple[str | None, int, int, str, str]]:
    """Reads and writes of environment variables; the name is null where it is computed or the whole is taken."""
    tree = ast.parse(text)
    modules, mapping, getenv = set(), set(), set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            modules |= {x.asname or x.name for x in n.names if x.name == "os"}
        elif isinstance(n, ast.ImportFrom) and n.module == "os":
            mapping |= {x.asname or x.name for x in n.names if x.name == "environ"}
            getenv |= {x.asname or x.name for x in n.names if x.name == "getenv"}
    is_os = lambda n, attr: isinstance(n, ast.Attribute) and n.attr == attr and isinstance(n.value, ast.Name) and n.value.id in modules
    is_map = lambda n: is_os(n, "environ") or isinstance(n, ast.Name) and n.id in mapping and isinstance(n.ctx, ast.Load)
    name = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    used = set()
    for n in ast.walk(tree):
        place = getattr(n, "lineno", 0), getattr(n, "col_offset", 0) + 1
        if isinstance(n, ast.Subscript) and is_map(n.value):
            used.add(n.value)
            role = "read" if isinstance(n.ctx, ast.Load) else "write"
            yield name(n.slice), *place, role if name(n.slice) else f"computed {role}", "module"
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and is_map(n.func.value):
            used.add(n.func.value)
            if n.func.attr in ("get", "pop", "setdefault") and n.args:
                role = "read" if n.func.attr == "get" else "write"
                yield name(n.args[0]), *place, role if name(n.args[0]) else f"computed {role}", "module"
            else:
                yield None, *place, "whole", "module"
        elif isinstance(n, ast.Call) and n.args and (is_os(n.func, "getenv") or isinstance(n.func, ast.Name) and n.func.id in getenv):
            yield name(n.args[0]), *place, "read" if name(n.args[0]) else "computed read", "module"
        elif isinstance(n, ast.Compare) and len(n.comparators) == 1 and is_map(n.comparators[0]):
            used.add(n.comparators[0])
            yield name(n.left), *place, "read" if name(n.left) else "computed read", "module"
    for n in ast.walk(tree):
        if is_map(n) and n not in used:
            yield None, n.lineno, n.col_offset + 1, "whole", "module"


def _rows(files: DataFrame, per_file) -> DataFrame:
    workers_can_import(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                try:
                    out += [(row.path, *x) for x in per_file(row)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["file", "name", "line", "col", "role", "scope"]).astype({"line": "int32", "col": "int32"})

    return files.mapInPandas(run, SCHEMA)


def uses(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Uses in the files that want any: files (path, content), wanted (file, name). Only these files are read again."""
    own = wanted.groupBy(F.col("file").alias("path")).agg(F.collect_set("name").alias("names"))
    return _rows(files.select("path", "content").join(own, "path"), lambda r: python_uses(bytes(r.content).decode(), set(r.names)))


def environment(files: DataFrame) -> DataFrame:
    """Uses of environment variables in all Python files."""
    return _rows(files.where(F.col("path").rlike(r"\.pyi?$")).select("path", "content"), lambda r: environment_uses(bytes(r.content).decode()))


def read_from(root: str, files: DataFrame) -> DataFrame:
    from tessera.sources.files import with_content

    return with_content(files.select("path", "size", "modified"), os.path.abspath(root))
