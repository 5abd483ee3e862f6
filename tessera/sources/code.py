"""Facts of source files: imports, exports, symbols and module structure, as tagged rows.

Python is read with the standard library's syntax tree; Rust and TypeScript with small scanners that blank out comments
and strings first. What can't be read is a row too, never a guess.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.session import workers_can_import

#: what: import, star, dynamic, symbol, export, module, macro, mock, error. level: leading dots, or 1 for a re-export. alias: the new name, of an export its own one. Of a Rust
#: module, module is the inline modules around it and signature its explicit path.
SCHEMA = "file string, what string, module string, name string, alias string, line int, level int, scope string, type_only boolean, kind string, signature string"
_EMPTY = {"module": None, "name": None, "alias": None, "line": None, "level": 0, "scope": "module", "type_only": False, "kind": None, "signature": None}


def python_facts(text: str) -> Iterator[dict]:
    tree = ast.parse(text)

    def guarded(test: ast.expr) -> bool:
        return isinstance(test, ast.Name) and test.id == "TYPE_CHECKING" or isinstance(test, ast.Attribute) and test.attr == "TYPE_CHECKING"

    def walk(nodes: list, scope: str, types: bool) -> Iterator[dict]:
        for n in nodes:
            at = {"line": getattr(n, "lineno", None), "scope": scope, "type_only": types}
            if isinstance(n, ast.Import):
                for x in n.names:
                    yield {"what": "import", "module": x.name, "alias": x.asname, **at}
            elif isinstance(n, ast.ImportFrom):
                for x in n.names:
                    yield {"what": "star" if x.name == "*" else "import", "module": n.module or "", "name": x.name, "alias": x.asname, "level": n.level, **at}
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                if scope == "module":
                    kind = "class" if isinstance(n, ast.ClassDef) else "function"
                    head = f"class {n.name}({', '.join(ast.unparse(b) for b in n.bases)})" if kind == "class" else f"def {n.name}({_bare(n.args)})"
                    yield {"what": "symbol", "name": n.name, "kind": kind, "signature": head.replace("()", "") if kind == "class" else head, **at}
                yield from walk(n.body, "local", types)
            elif isinstance(n, ast.Assign) and scope == "module":
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        if t.id == "__all__" and isinstance(n.value, ast.List | ast.Tuple):
                            for x in n.value.elts:
                                if isinstance(x, ast.Constant) and isinstance(x.value, str):
                                    yield {"what": "export", "name": x.value, **at}
                        elif t.id.isupper():
                            yield {"what": "symbol", "name": t.id, "kind": "constant", **at}
            elif isinstance(n, ast.If):
                yield from walk(n.body, scope, types or guarded(n.test))
                yield from walk(n.orelse, scope, types)
            else:
                for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                    inner = getattr(n, field, None)
                    if isinstance(inner, list):
                        yield from walk([x for x in inner if isinstance(x, ast.stmt | ast.ExceptHandler | ast.match_case)], scope, types)

    def _bare(a: ast.arguments) -> str:
        parts = [x.arg for x in [*a.posonlyargs, *a.args]]
        defaults = len(a.defaults)
        parts = [p + ("=..." if i >= len(parts) - defaults else "") for i, p in enumerate(parts)]
        if a.vararg:
            parts.append("*" + a.vararg.arg)
        elif a.kwonlyargs:
            parts.append("*")
        parts += [x.arg + ("" if d is None else "=...") for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        return ", ".join(parts + (["**" + a.kwarg.arg] if a.kwarg else []))

    yield from walk(tree.body, "module", False)
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else ""
            if name in ("import_module", "__import__") and n.args:
                arg = n.args[0]
                head = arg.left if isinstance(arg, ast.BinOp) else arg.values[0] if isinstance(arg, ast.JoinedStr) and arg.values else arg
                text_ = head.value if isinstance(head, ast.Constant) and isinstance(head.value, str) else None
                if isinstance(arg, ast.Constant) and text_ is not None:
                    yield {"what": "import", "module": text_.lstrip("."), "level": len(text_) - len(text_.lstrip(".")), "line": n.lineno, "scope": "local"}
                else:
                    yield {"what": "dynamic", "name": name, "module": text_, "line": n.lineno}


def blanked(text: str, *, raw_strings: bool = False, keep_strings: bool = False) -> str:
    """Comments (and the insides of strings) as spaces, of the same length."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    if raw_strings:
        pattern = r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'"

    def blank(m: re.Match) -> str:
        s = m.group()
        if s.startswith(("//", "/*")):
            return re.sub(r"[^\n]", " ", s)
        return s if keep_strings else s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]

    return re.sub(pattern, blank, text, flags=re.S)


def use_leaves(tree: str) -> Iterator[tuple[str, str | None]]:
    """The paths that a Rust `use` names, with their new names."""
    parts, depth, last = [], 0, 0
    if "{" in tree:
        head, rest = tree.split("{", 1)
        inner = rest[: rest.rindex("}")]
        for i, c in enumerate(inner + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(inner[last:i])
                last = i + 1
        for p in parts:
            if p.strip():
                for path, alias in use_leaves(p.strip()):
                    yield (head.strip().rstrip(":") if path == "self" else head.strip() + path), alias
    else:
        path, _, alias = re.sub(r"\s+", " ", tree.strip()).partition(" as ")
        yield path.replace(" ", ""), alias or None


def closing(code: str, at: int) -> int:
    """Where the brace at a place closes, or the end."""
    depth = 0
    for m in re.compile("[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code)


def rust_facts(text: str) -> Iterator[dict]:
    code = blanked(text, raw_strings=True)
    line = lambda i: code.count("\n", 0, i) + 1
    depth = lambda i: code.count("{", 0, i) - code.count("}", 0, i)
    tests = [m.start() for m in re.finditer(r"#\[cfg\(test\)\]", code)]
    for m in re.finditer(r"\b(pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code):
        for path, alias in use_leaves(m[2]):
            module, _, name = path.rpartition("::")
            yield {"what": "star" if name == "*" else "import", "module": module or name, "name": name, "alias": alias, "line": line(m.start()), "level": int(bool(m[1])), "scope": "local" if depth(m.start()) > 1 else "module", "kind": "test" if any(t < m.start() for t in tests) else None}
    spans: list[tuple[int, str]] = []  # where the inline modules around here end, and their names
    for m in re.finditer(r"\b(pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*([;{])", code):
        spans = [x for x in spans if m.start() < x[0]]
        path = re.search(r'#\[path\s*=\s*"([^"]+)"\]\s*(?:#\[[^\]]*\]\s*)*$', text[max(0, m.start() - 400) : m.start()])
        yield {"what": "module", "module": "::".join(x[1] for x in spans) or None, "name": m[2], "line": line(m.start()), "kind": "file" if m[3] == ";" else "inline", "signature": path[1] if path else None}
        if m[3] == "{":
            spans.append((closing(code, m.end() - 1), m[2]))
    for m in re.finditer(r"^[ \t]*pub(?:\([^)]*\))?\s+(?:async\s+|unsafe\s+|const\s+(?=fn)|extern\s+\S+\s+)*(fn|struct|enum|trait|type|const|static|union|macro)\s+(\w+)([^{;=]*)", code, re.M):
        yield {"what": "symbol", "name": m[2], "kind": m[1], "line": line(m.start(2)), "signature": re.sub(r"\s+", " ", f"{m[1]} {m[2]}{m[3]}").strip()}
    for m in re.finditer(r"\b(\w+)!\s*[({\[]", code):
        yield {"what": "macro", "name": m[1], "line": line(m.start())}


_FROM = r"from\s*(['\"])([^'\"]+)\1"


def typescript_facts(text: str) -> Iterator[dict]:
    code = blanked(text, keep_strings=True)
    bare = blanked(text)
    line = lambda i: code.count("\n", 0, i) + 1

    def names(block: str) -> Iterator[tuple[str, str | None, bool]]:
        for x in block.split(","):
            if m := re.fullmatch(r"\s*(type\s+)?([\w$]+|\"[^\"]*\")(?:\s+as\s+([\w$]+))?\s*", x):
                yield m[2], m[3], bool(m[1])

    for m in re.finditer(r"\bimport\s+(type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\*\s*as\s+([\w$]+)\s*|\{([^}]*)\}\s*)?" + _FROM.replace(r"\1", r"\5"), code):
        at = {"module": m[6], "line": line(m.start()), "type_only": bool(m[1])}
        if m[2]:
            yield {"what": "import", "name": "default", "alias": m[2], **at}
        if m[3]:
            yield {"what": "star", "name": "*", "alias": m[3], **at}
        for name, alias, types in names(m[4] or ""):
            yield {"what": "import", "name": name, "alias": alias, **at, "type_only": at["type_only"] or types}
    for m in re.finditer(r"\bimport\s*(['\"])([^'\"]+)\1", code):
        yield {"what": "import", "module": m[2], "line": line(m.start())}
    for m in re.finditer(r"\bexport\s+(type\s+)?(?:\*(?:\s*as\s+([\w$]+))?|\{([^}]*)\})\s*" + _FROM.replace(r"\1", r"\4"), code):
        at = {"module": m[5], "line": line(m.start()), "type_only": bool(m[1]), "level": 1}
        if m[3] is None:
            yield {"what": "star", "name": "*", "alias": m[2], **at}
        for name, alias, types in names(m[3] or ""):
            yield {"what": "import", "name": name, "alias": alias, **at, "type_only": at["type_only"] or types}
    for m in re.finditer(r"\bexport\s+(type\s+)?\{([^}]*)\}(?!\s*from)", code):
        for name, alias, _ in names(m[2]):
            yield {"what": "export", "name": alias or name, "alias": name, "line": line(m.start()), "type_only": bool(m[1])}
    for m in re.finditer(r"\bexport\s+(default\s+)?(?:declare\s+)?(?:async\s+|abstract\s+)*(function|class|const|let|var|interface|type|enum|namespace)\*?\s+([\w$]+)", bare):
        yield {"what": "symbol", "name": "default" if m[1] else m[3], "kind": m[2], "line": line(m.start()), "type_only": m[2] in ("interface", "type")}
    for m in re.finditer(r"\b(require|import)\s*\(\s*(?:(['\"])([^'\"]+)\2\s*\)|[^)]*)", code):
        if m[3]:
            yield {"what": "import", "module": m[3], "line": line(m.start()), "scope": "local" if m[1] == "import" else "module"}
        else:
            head = re.search(r"[`'\"]([^`'\"$]*)", m.group())
            yield {"what": "dynamic", "name": m[1], "module": head[1] if head else None, "line": line(m.start())}
    for m in re.finditer(r"\b(?:jest|vi)\.(mock|doMock|unstable_mockModule)\s*\(\s*(['\"])([^'\"]+)\2", code):
        yield {"what": "mock", "name": m[1], "module": m[3], "line": line(m.start())}


READERS = {"py": python_facts, "pyi": python_facts, "rs": rust_facts, **dict.fromkeys(("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), typescript_facts)}


def facts(files: DataFrame) -> DataFrame:
    """Facts of all source files among files (path, content), file by file, in Arrow batches."""
    workers_can_import(files.sparkSession)
    columns = ["file", "what", "module", "name", "alias", "line", "level", "scope", "type_only", "kind", "signature"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = list(READERS[path.rpartition(".")[2]](bytes(content).decode("utf-8")))
                except (SyntaxError, ValueError, RecursionError) as e:
                    found = [{"what": "error", "signature": str(e)[:200]}]
                out += [{**_EMPTY, **x, "file": path} for x in found]
            yield pd.DataFrame(out, columns=columns).astype({"line": "Int32", "level": "Int32", "type_only": bool})

    return files.where(files.path.rlike(r"\.(" + "|".join(READERS) + r")$")).select("path", "content").mapInPandas(run, SCHEMA)
