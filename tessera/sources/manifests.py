"""Package manifests as rows: names, dependencies, sections and the lines that declare them."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import workers_can_import

#: file, what (package, dependency, target, member, entry, error), name, section, value, line.
SCHEMA = "file string, what string, name string, section string, value string, line int"
Row = tuple[str, str, str | None, str | None, int | None]
_REQUIREMENT = re.compile(r"\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)")
_DEV = re.compile(r"(?:^|[-_./])(dev|test|tests|docs?|lint|ci|build)(?:[-_./]|$)")


def normal(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def toml_lines(text: str) -> dict[tuple[str, str], int]:
    """The line of every key, by table."""
    out: dict[tuple[str, str], int] = {}
    table = ""
    for i, line in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*\[+\s*([^\]]+?)\s*\]+", line):
            table = m[1].replace('"', "").replace(" ", "")
            head, _, last = table.rpartition(".")
            out.setdefault((head, last), i)
        elif m := re.match(r"""\s*["']?([A-Za-z0-9_.@/-]+?)["']?\s*=""", line):
            out.setdefault((table, m[1].split(".")[0]), i)
    return out


def _listed(text: str, value: str) -> int | None:
    for i, line in enumerate(text.splitlines(), 1):
        if re.search(rf"""["']{re.escape(value)}["']""", line):
            return i
    return None


def cargo(text: str) -> Iterator[Row]:
    data, lines = tomllib.loads(text), toml_lines(text)
    package = data.get("package", {})
    if package:
        yield "package", package["name"], "lib", data.get("lib", {}).get("name") or package["name"].replace("-", "_"), lines.get(("package", "name"))
    if "workspace" in data:
        for x in data["workspace"].get("members", []):
            yield "member", x, "members", None, _listed(text, x)
        for x in data["workspace"].get("exclude", []):
            yield "member", x, "exclude", None, _listed(text, x)
    tables = {"normal": "dependencies", "dev": "dev-dependencies", "build": "build-dependencies"}
    places = [("", data), *((f"target.{k}.", v) for k, v in data.get("target", {}).items())]
    for prefix, place in places:
        for kind, table in tables.items():
            for name, spec in place.get(table, {}).items():
                spec = spec if isinstance(spec, dict) else {"version": spec}
                value = "workspace" if spec.get("workspace") else f"path:{spec['path']}" if "path" in spec else spec.get("version")
                yield "dependency", spec.get("package", name), kind, value, lines.get((f"{prefix}{table}", name))
    for name, spec in data.get("workspace", {}).get("dependencies", {}).items():
        spec = spec if isinstance(spec, dict) else {"version": spec}
        yield "dependency", spec.get("package", name), "workspace", f"path:{spec['path']}" if "path" in spec else spec.get("version"), lines.get(("workspace.dependencies", name))
    # The switches that keep a kind of target from being found by its place.
    for key, kind in (("autobins", "bin"), ("autotests", "test"), ("autoexamples", "example"), ("autobenches", "bench")):
        if package.get(key) is False:
            yield "undiscovered", kind, key, None, lines.get(("package", key))
    for kind in ("lib", "bin", "test", "example", "bench"):
        own = data.get(kind, [])
        for x in own if isinstance(own, list) else [own]:
            yield "target", x.get("name") or package.get("name"), kind, x.get("path"), None


def pyproject(text: str) -> Iterator[Row]:
    data, lines = tomllib.loads(text), toml_lines(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    if name := project.get("name") or poetry.get("name"):
        yield "package", name, "project", None, lines.get(("project" if project.get("name") else "tool.poetry", "name"))
    groups = [("dependencies", project.get("dependencies", []))]
    groups += [(f"extra {k}", v) for k, v in project.get("optional-dependencies", {}).items()]
    groups += [(f"group {k}", v) for k, v in data.get("dependency-groups", {}).items()]
    for section, own in groups:
        for x in own:
            if isinstance(x, str) and (m := _REQUIREMENT.match(x)):
                yield "dependency", normal(m[1]), section, x, _listed(text, x)
    for table, section in (("dependencies", "dependencies"), ("dev-dependencies", "dev")):
        for x in poetry.get(table, {}):
            if x != "python":
                yield "dependency", normal(x), section, None, lines.get((f"tool.poetry.{table}", x))
    for group, own in poetry.get("group", {}).items():
        for x in own.get("dependencies", {}):
            yield "dependency", normal(x), f"group {group}", None, lines.get((f"tool.poetry.group.{group}.dependencies", x))


def requirements(text: str) -> Iterator[Row]:
    for i, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*", "", line)
        if line.strip() and not line.lstrip().startswith("-") and (m := _REQUIREMENT.match(line)):
            yield "dependency", normal(m[1]), "requirements", line.strip(), i


def json_lines(text: str) -> dict[tuple[str, str], int]:
    """The line of every key one level below the top."""
    out: dict[tuple[str, str], int] = {}
    depth, keys, at, i = 0, {}, 1, 0
    while i < len(text):
        c = text[i]
        if c == "\n":
            at += 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        elif c == '"':
            end = i + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            word, rest = text[i + 1 : end], text[end + 1 :].lstrip()
            if rest.startswith(":"):
                keys[depth] = word
                if depth == 2:
                    out.setdefault((keys.get(1, ""), word), at)
            i = end
        i += 1
    return out


def package_json(text: str) -> Iterator[Row]:
    data, lines = json.loads(text), json_lines(text)
    if not isinstance(data, dict):
        raise ValueError("not an object")
    if isinstance(data.get("name"), str):
        yield "package", data["name"], data.get("type", "commonjs"), None, None
    spaces = data.get("workspaces", [])
    for x in spaces.get("packages", []) if isinstance(spaces, dict) else spaces:
        yield "member", x, "workspaces", None, None
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, version in (data.get(section) or {}).items():
            yield "dependency", name, section, version, lines.get((section, name))

    def entries(value: object) -> Iterator[str]:
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            for x in value.values():
                yield from entries(x)
        elif isinstance(value, list):
            for x in value:
                yield from entries(x)

    for key in ("main", "module", "types", "typings", "browser", "bin", "exports"):
        for x in entries(data.get(key)):
            yield "entry", x.removeprefix("./"), key, None, None


def pnpm(text: str) -> Iterator[Row]:
    inside = False
    for i, line in enumerate(text.splitlines(), 1):
        if re.match(r"packages\s*:", line):
            inside = True
        elif inside and (m := re.match(r"""\s*-\s*["']?([^"'#]+?)["']?\s*(?:#.*)?$""", line)):
            yield "member", m[1], "workspaces", None, i
        elif line.strip() and not line.startswith((" ", "-", "#")):
            inside = False


def config(text: str) -> Iterator[Row]:
    """Path aliases of a script project's configuration (JSON with comments): pattern, and each target with the base directory before it."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    data = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    options = data.get("compilerOptions", {})
    base = (options.get("baseUrl") or ".").rstrip("/")
    yield "config", None, "json", json.dumps(data), None
    above = data.get("extends", [])
    for i, x in enumerate(above if isinstance(above, list) else [above]):
        yield "extends", x, "extends", str(i), None
    if "baseUrl" in options:
        yield "alias", "*", "baseUrl", f"{base}/*", None
    for pattern, targets in options.get("paths", {}).items():
        for t in targets:
            yield "alias", pattern, "paths", f"{base}/{t.removeprefix('./')}", None


def reader_of(name: str):
    """The reader of a manifest by its base name, or None."""
    if re.fullmatch(r"(?:[\w.-]*[-_.])?requirements(?:[-_.][\w.-]*)?\.(?:txt|in)", name):
        return requirements
    return {"Cargo.toml": cargo, "pyproject.toml": pyproject, "package.json": package_json, "pnpm-workspace.yaml": pnpm}.get(name, config if re.fullmatch(r"[tj]sconfig([.-][\w.-]+)?\.json", name) else None)


def dev_word(path: str) -> str | None:
    """The word that makes a requirements file one for development."""
    m = _DEV.search(path.rpartition(".")[0])
    return m[1] if m else None


def manifests(files: DataFrame) -> DataFrame:
    """Rows of all manifests among files (path, content). A file that can't be read gives one row `error`."""
    workers_can_import(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"], strict=True):
                read = reader_of(path.rpartition("/")[2])
                try:
                    out += [(path, *row) for row in read(bytes(content).decode("utf-8"))]
                except (ValueError, KeyError, AttributeError, TypeError) as e:
                    out.append((path, "error", None, None, str(e)[:200], None))
            frame = pd.DataFrame(out, columns=["file", "what", "name", "section", "value", "line"])
            yield frame.astype({"line": "Int32"})

    wanted = files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(r"^(Cargo\.toml|pyproject\.toml|package\.json|[tj]sconfig([.-][\w.-]+)?\.json|pnpm-workspace\.yaml|.*requirements.*\.(txt|in))$"))
    kept = wanted.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(r"^(Cargo\.toml|pyproject\.toml|package\.json|[tj]sconfig([.-][\w.-]+)?\.json|pnpm-workspace\.yaml|([\w.-]*[-_.])?requirements([-_.][\w.-]*)?\.(txt|in))$"))
    return kept.select("path", "content").mapInPandas(run, SCHEMA)


def installed(records: DataFrame) -> DataFrame:
    """What installed distributions provide: prefix, distribution. records: path of a RECORD file, content."""
    dist = F.regexp_extract("path", r"([^/]+?)-[^-/]+\.dist-info/RECORD$", 1)
    lines = records.select(F.lower(F.regexp_replace(dist, r"[-_.]+", "-")).alias("distribution"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    module = F.regexp_replace(F.regexp_replace(F.substring_index("line", ",", 1), r"/__init__\.pyi?$", ""), r"\.(py|pyi|so|pyd)$|\.cpython[^/]*$", "")
    names = lines.where("line rlike '^[A-Za-z_][^,]*[.](py|pyi|so|pyd),'").select("distribution", F.translate(module, "/", ".").alias("prefix"))
    return names.where(~F.col("prefix").contains("-")).distinct()
