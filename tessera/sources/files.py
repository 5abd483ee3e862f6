"""The files of a source tree as rows, and what their names say."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import base, extension, parent, stem
from tessera.session import workers_can_import

#: Languages by suffix. The first three have analyzers.
LANGUAGES = {
    "Rust": ["rs"],
    "Python": ["py", "pyi"],
    "TypeScript": ["ts", "tsx", "mts", "cts"],
    "JavaScript": ["js", "jsx", "mjs", "cjs"],
    "Go": ["go"],
    "Java": ["java"],
    "Kotlin": ["kt", "kts"],
    "Scala": ["scala"],
    "C": ["c", "h"],
    "C++": ["cc", "cpp", "cxx", "hpp"],
    "C#": ["cs"],
    "Swift": ["swift"],
    "Ruby": ["rb"],
    "PHP": ["php"],
    "Shell": ["sh", "bash"],
    "Lua": ["lua"],
    "Elixir": ["ex", "exs"],
    "Erlang": ["erl"],
    "Haskell": ["hs"],
    "OCaml": ["ml", "mli"],
    "Dart": ["dart"],
    "R": ["r", "R"],
    "Julia": ["jl"],
    "Zig": ["zig"],
    "Vue": ["vue"],
}
ANALYZED = ("Rust", "Python", "TypeScript", "JavaScript")
#: Directories never looked into, and build outputs by the manifest that must stand beside them.
SKIPPED = ("node_modules", "__pycache__")
OUTPUTS = {"dist": ["package.json", "pyproject.toml", "setup.py"], "build": ["package.json", "pyproject.toml", "setup.py", "build.gradle"], "target": ["Cargo.toml", "pom.xml"]}


def languages(spark: SparkSession) -> DataFrame:
    """ext, language, analyzed: a fixed table."""
    return spark.createDataFrame([(e, n, n in ANALYZED) for n, own in LANGUAGES.items() for e in own], "ext string, language string, analyzed boolean")


def _ignored(patterns: list[tuple[str, str]]):
    """A column expression for ignore rules (directory of the file, pattern), last match first."""
    out = F.lit(False)
    for at, raw in patterns:
        text = raw.strip()
        if not text or text.startswith("#"):
            continue
        keep, text = text.startswith("!"), text.lstrip("!")
        rooted, only_dir = "/" in text.rstrip("/"), text.endswith("/")
        body, i = "", 0
        text = text.strip("/")
        while i < len(text):
            if text.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif text.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                c = text[i]
                body, i = body + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".^$+{}[]()|\\" else c), i + 1
        head = (at + "/" if at else "") + ("" if rooted else "(?:.*/)?")
        out = F.when(F.col("path").rlike(f"^{head}{body}{'/' if only_dir else '(?:/|$)'}"), not keep).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, *, content: bool = True) -> DataFrame:
    """Every file below root that isn't ignored: path (from root), size, modified, and content (bytes).

    Hidden and dependency directories are skipped, ignore files are followed, and a build output goes if the manifest
    of the tool that writes it stands beside it and it is no Python package. Links to files are followed, links to
    directories are not. The driver lists the tree, whose folder the workers must see too: Spark's own listing leaves
    out names that begin with an underscore, such as packages' initial files. Contents are read by the workers.
    """
    workers_can_import(spark)
    root = root.removeprefix("file://").rstrip("/")
    found, rules = [], []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED and not os.path.islink(os.path.join(at, d)))
        inside = os.path.relpath(at, root).replace(os.sep, "/").removeprefix(".").lstrip("/")
        for n in sorted(names):
            full = os.path.join(at, n)
            if n in (".gitignore", ".ignore"):
                with open(full, encoding="utf-8", errors="replace") as f:
                    rules += [(inside, line) for line in f.read().splitlines()]
            elif not n.startswith(".") and os.path.isfile(full):
                st = os.stat(full)
                found.append((f"{inside}/{n}" if inside else n, st.st_size, st.st_mtime_ns))
    rows = spark.createDataFrame(found, "path string, size long, modified long")
    rules.sort(key=lambda r: r[0].count("/") + bool(r[0]))
    rows = without_outputs(rows.where(~_ignored(rules)))
    return with_content(rows, root) if content else rows


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Files (path, size, modified) with their bytes; a file that is gone meanwhile drops out."""

    def run(parts):
        for part in parts:
            data = []
            for path in part["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data.append(f.read())
                except OSError:
                    data.append(None)
            part["content"] = data
            yield part[part["content"].notna()]

    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "path string, size long, modified long, content binary")


def without_outputs(files: DataFrame) -> DataFrame:
    """Files but for those in build outputs."""
    named = files.sparkSession.createDataFrame([(d, m) for d, own in OUTPUTS.items() for m in own], "name string, manifest string")
    beside = files.select(parent(F.col("path")).alias("at"), base(F.col("path")).alias("manifest")).join(F.broadcast(named), "manifest").select(F.concat(F.when(F.col("at") != "", F.concat("at", F.lit("/"))).otherwise(""), "name").alias("dir")).distinct()
    packages = files.where(base(F.col("path")) == "__init__.py").select(parent(F.col("path")).alias("dir"))
    outputs = beside.join(packages, "dir", "left_anti")
    inside = files.select("path", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 1, 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("dir")).join(outputs, "dir", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def described(files: DataFrame) -> DataFrame:
    """Files with dir, base, stem, ext and language."""
    known = F.create_map(*[F.lit(x) for n, own in LANGUAGES.items() for e in own for x in (e, n)])
    p = F.col("path")
    out = files.withColumns({"dir": parent(p), "base": base(p), "stem": stem(p), "ext": extension(p)})
    return out.withColumn("language", F.try_element_at(known, F.col("ext")))


def stamp(files: DataFrame) -> str:
    """One value for sizes and times of all files: equal trees have equal stamps."""
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "size", "modified").cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s}"
