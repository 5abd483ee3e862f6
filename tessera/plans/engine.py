"""A repository as relations, and the questions asked of it.

    engine = Engine.scan(spark, "/path/to/tree")
    engine.summary(depth=1), engine.query("pkg/module.py"), engine.impact("pkg/module.py"), engine.check(rules)

All answers are DataFrames, or dictionaries of them; render() makes text of them.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import lexical, module_path, npm_package, npm_subpath, parent, under
from tessera.operators import barrels, definitions, gaps, graph, lookups, modules, relations, rules, settings, work
from tessera.operators import history as commits
from tessera.operators.predicates import test_file
from tessera.session import settle
from tessera.sources import code, files, git, manifests, snapshot

_SCRIPT = r"[.][cm]?[jt]sx?$"
_EXTENSIONS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def python_imports(facts: DataFrame, tree: DataFrame) -> DataFrame:
    """Python imports with the file they load: file, line, module, name, target, scope, type_only, alias, whole, passes_on.

    A module's dotted name is its path below any directory of the tree that isn't a package; `from m import n` loads
    the submodule m.n if there is one (whole), else m. Relative imports climb from the file's package. What a package's
    own file takes by name at module level it passes on.
    """
    py = tree.where("ext in ('py', 'pyi')").select(F.col("path").alias("target"), module_path(F.regexp_replace("path", r"/__init__\.pyi?$|^__init__\.pyi?$", "")).alias("p"))
    initials = tree.where("base = '__init__.py'").select("dir")
    # The name under which a file is imported starts below the nearest directory that is no package.
    up = py.select("target", "p", F.explode(F.expr("transform(sequence(0, size(split(p, '/')) - 1), i -> struct(i as i, array_join(slice(split(p, '/'), 1, i), '/') as head, array_join(slice(split(p, '/'), i + 1, 100), '.') as dotted))")).alias("x")).select("target", "x.*")
    packages = initials.select(F.col("dir").alias("head"), F.lit(True).alias("_pkg"))
    named = up.join(packages, "head", "left").where("_pkg is null").groupBy("target").agg(F.max_by("dotted", "i").alias("dotted"))
    f = facts.where("what in ('import', 'star') and file rlike '[.]pyi?$'")
    dir_parts = F.filter(F.split(parent(F.col("file")), "/"), lambda x: x != "")
    above = F.slice(dir_parts, 1, F.greatest(F.size(dir_parts) - F.greatest(F.col("level") - 1, F.lit(0)), F.lit(0)))
    absolute = F.when(F.col("level") > 0, F.array_join(F.filter(F.concat(above, F.split(F.col("module"), r"\.")), lambda x: x != ""), "/"))
    f = f.withColumn("path", absolute).withColumn("full", F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.concat_ws(".", "module", "name")).otherwise(F.col("module")))
    by_path = py.select(F.col("p").alias("_p"), F.col("target").alias("_t"))
    relative = f.where("level > 0").withColumn("_full", F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.concat_ws("/", F.when(F.col("path") != "", F.col("path")), "name")).otherwise(F.col("path")))
    relative = relative.join(by_path.withColumnRenamed("_p", "_full").withColumnRenamed("_t", "_sub"), "_full", "left").join(by_path.withColumnRenamed("_p", "path"), "path", "left")
    relative = relative.select("file", "line", "module", "name", F.coalesce("_sub", "_t").alias("target"), "scope", "type_only", "alias", F.col("_sub").isNotNull().alias("whole"))
    direct = f.where("level = 0").join(named.select(F.col("dotted").alias("full"), F.col("target").alias("_sub")), "full", "left").join(named.select(F.col("dotted").alias("module"), F.col("target").alias("_t")), "module", "left")
    direct = direct.select("file", "line", "module", "name", F.coalesce("_sub", "_t").alias("target"), "scope", "type_only", "alias", F.col("_sub").isNotNull().alias("whole"))
    initial = F.col("file").rlike(r"(^|/)__init__\.pyi?$")
    return relative.unionByName(direct).withColumn("passes_on", initial & (F.col("scope") == "module") & F.col("name").isNotNull())


def script_aliases(declared: DataFrame) -> DataFrame:
    """Path aliases that hold below a script project's configuration, its own or inherited: dir, name (a pattern), to.

    `paths` and `baseUrl` come from the nearest configuration that sets them, each by itself; targets are below the base
    URL, which its own configuration's directory holds, else below the directory of the configuration that sets `paths`.
    """
    configs = declared.where("what = 'config'").select(F.col("file").alias("config"), F.col("value").alias("json"))
    entry = F.col("name")
    at = lexical(F.concat_ws("/", F.when(parent(F.col("file")) != "", parent(F.col("file"))), F.when(entry.endswith(".json"), entry).otherwise(F.concat(entry, F.lit(".json")))))
    above = declared.where("what = 'extends'").select(F.col("file").alias("config"), F.when(entry.rlike(r"^\.{1,2}/"), at).alias("target"), F.col("value").cast("int").alias("pos"))
    leaves = configs.where(F.col("config").rlike(r"(^|/)[tj]sconfig\.json$"))
    pointers = F.explode(F.array(F.lit("/compilerOptions/paths"), F.lit("/compilerOptions/baseUrl")))
    set_ = settle(settings.settings(configs, above, leaves.select("config", pointers.alias("pointer"))).where("value is not null and value <> 'null'"))
    base = set_.where("pointer like '%baseUrl'").select("config", lexical(F.concat_ws("/", F.when(parent(F.col("set_by")) != "", parent(F.col("set_by"))), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))).alias("base"))
    paths = set_.where("pointer like '%paths'").join(base, "config", "left").select("config", F.coalesce("base", parent(F.col("set_by"))).alias("base"), F.explode(F.from_json("value", "map<string, array<string>>")).alias("name", "targets"))
    rows = paths.select("config", "name", F.explode("targets").alias("t"), "base").unionByName(base.select("config", F.lit("*").alias("name"), F.lit("*").alias("t"), "base"))
    return rows.select(parent(F.col("config")).alias("dir"), "name", lexical(F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), "t")).alias("to"))


def typescript_imports(facts: DataFrame, tree: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports of script files with the file that they load, if it is in the tree; other packages have none.

    In this order: a relative specifier; an alias of the nearest configuration whose pattern fits, the longest first; a
    package of the tree by its name, through its declared entries, its sources or its directory. Of each the first of
    the usual suffixes that is there. declared: manifest rows, of which the aliases and packages are few and broadcast.
    """
    f = facts.where("what in ('import', 'star', 'mock') and module is not null and file rlike '[.][cm]?[jt]sx?$'")
    f = f.withColumn("_id", F.struct("file", "line", "module", "name", "alias", "what"))
    home = parent(F.col("file"))
    m = F.col("module")
    near = f.where(m.rlike(r"^\.{1,2}(/|$)")).select("_id", F.lit(0).alias("rank"), lexical(F.concat_ws("/", F.when(home != "", home), m)).alias("at"))
    bare = f.where(~m.rlike(r"^\.{1,2}(/|$)"))
    aliases = script_aliases(declared).select("dir", F.substring_index("name", "*", 1).alias("head"), F.when(F.col("name").contains("*"), F.substring_index("name", "*", -1)).alias("tail"), "to")
    fits = F.when(F.col("tail").isNull(), m == F.col("head")).otherwise(F.startswith(m, F.col("head")) & F.endswith(m, F.col("tail")) & (F.length(m) >= F.length("head") + F.length("tail")))
    inside = F.substring(m, F.length("head") + 1, F.length(m) - F.length("head") - F.length(F.coalesce("tail", F.lit(""))))
    aliased = bare.join(F.broadcast(aliases), fits & under(F.col("file"), F.col("dir")))
    aliased = aliased.select("_id", (1 + 2000 * (100 - F.least(F.size(F.split("dir", "/")), F.lit(99))) - F.least(F.length("head"), F.lit(999))).alias("rank"), lexical(F.replace(F.col("to"), F.lit("*"), F.when(F.col("tail").isNull(), "").otherwise(inside))).alias("at"))
    packages = declared.where("what = 'package' and file like '%package.json'").select(parent(F.col("file")).alias("dir"), F.col("name").alias("_package"))
    entries = declared.where("what = 'entry'").select(parent(F.col("file")).alias("dir"), F.col("name").alias("entry"))
    sub = F.coalesce(npm_subpath(m), F.lit(""))
    own = bare.withColumn("_package", npm_package(m)).join(F.broadcast(packages), "_package")
    ways = F.array(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.when(sub != "", sub)), F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.lit("src"), F.when(sub != "", sub).otherwise("index")))
    by_name = own.select("_id", F.posexplode(ways).alias("k", "at")).select("_id", (1_000_000 + F.col("k")).alias("rank"), "at")
    by_entry = own.where(sub == "").join(F.broadcast(entries), "dir").select("_id", F.lit(999_999).alias("rank"), lexical(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "entry")).alias("at"))
    ways = near.unionByName(aliased).unionByName(by_name).unionByName(by_entry).where("at is not null")
    tries = ways.select("_id", "rank", F.posexplode(F.array(*[F.concat(F.regexp_replace("at", r"\.(js|mjs|cjs)$", "") if e.startswith((".ts", ".mts")) else F.col("at"), F.lit(e)) for e in _EXTENSIONS])).alias("order", "target"))
    found = tries.join(tree.select(F.col("path").alias("target")), "target").groupBy("_id").agg(F.min_by("target", F.struct("rank", "order")).alias("target"))
    return f.join(found, "_id", "left").select("file", "line", "module", "name", "target", "scope", "type_only", "alias", (F.col("what") == "star").alias("whole"), ((F.col("what") != "mock") & (F.col("level") == 1)).alias("passes_on"))


def rust_imports(facts: DataFrame, tree: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports of Rust files with the file of the longest module path that they name; other crates have none.

    A crate is the nearest directory with a package manifest; a file's module path is its path below src. A path
    starts at the crate, at the module itself or above it, at another crate of the tree by its library's name, or at a
    module below one's own. Paths are resolved by their leading segments, an equi-join.
    """
    crates = declared.where("what = 'package' and file like '%Cargo.toml'").select(parent(F.col("file")).alias("crate"), F.col("value").alias("lib"))
    sources = lookups.nearest(tree.where("ext = 'rs'").select("path"), "path", crates.select("crate").withColumn("_c", F.col("crate")), "crate").select(F.col("path").alias("file"), F.col("_c").alias("crate"))
    below = F.when(F.col("crate") == "", F.col("file")).otherwise(F.expr("substring(file, length(crate) + 2)"))
    mod = F.regexp_replace(F.regexp_replace(below, r"^src/|\.rs$", ""), r"(^|/)(mod|lib|main)$", "")
    sources = settle(sources.withColumn("mod", F.translate(mod, "/", ":")).withColumn("mod", F.replace("mod", F.lit(":"), F.lit("::"))))
    f = facts.where("what in ('import', 'star') and file like '%.rs'").join(sources, "file")
    full = F.split(F.when((F.col("name") == "*") | (F.col("name") == F.col("module")), F.col("module")).otherwise(F.concat_ws("::", "module", "name")), "::")
    f = f.withColumns({"_id": F.struct("file", "line", "module", "name", "alias"), "seg": full, "own": F.filter(F.split("mod", "::"), lambda x: x != "")})
    head = F.element_at("seg", 1)
    ups = F.size("seg") - F.size(F.array_remove("seg", "super"))
    rest = F.slice("seg", 2, F.size("seg"))
    same = f.select("_id", "crate", F.when(head == "crate", rest).when(head == "self", F.concat("own", rest)).when(head == "super", F.concat(F.slice("own", 1, F.greatest(F.size("own") - ups, F.lit(0))), F.expr("slice(seg, 1 + size(seg) - size(array_remove(seg, 'super')), size(seg))"))).otherwise(F.concat("own", "seg")).alias("at"), F.when(head.isin("crate", "self", "super"), -1).otherwise(F.size("own")).alias("more_than"))
    other = f.join(F.broadcast(crates.select(F.col("crate").alias("_to"), "lib")), head == F.col("lib")).select("_id", F.col("_to").alias("crate"), rest.alias("at"), F.lit(-1).alias("more_than"))
    ways = same.unionByName(other).select("_id", "crate", "more_than", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("at")), lambda k: F.array_join(F.slice("at", 1, F.size("at") - k), "::"))).alias("k", "mod"))
    known = sources.where("file not like '%/main.rs' or mod <> ''").select("crate", "mod", F.col("file").alias("target"))
    met = ways.join(known, ["crate", "mod"]).withColumn("n", F.size(F.filter(F.split("mod", "::"), lambda x: x != ""))).where("n > more_than")
    found = met.groupBy("_id").agg(F.max_by("target", F.struct("n", "target")).alias("target"))
    return f.join(found, "_id", "left").select("file", "line", "module", "name", "target", "scope", "type_only", "alias", (F.col("what") == "star").alias("whole"), (F.col("level") == 1).alias("passes_on"))


#: Where the build tool looks for targets, by their kind.
_LAYOUT = {"lib": r"^src/lib\.rs$", "bin": r"^src/(main\.rs|bin/[^/]+\.rs|bin/[^/]+/main\.rs)$", "test": r"^tests/([^/]+\.rs|[^/]+/main\.rs)$", "example": r"^examples/([^/]+\.rs|[^/]+/main\.rs)$", "bench": r"^benches/([^/]+\.rs|[^/]+/main\.rs)$", "build": r"^build\.rs$"}


def cargo_targets(tree: DataFrame, declared: DataFrame) -> DataFrame:
    """Root files of the targets of Rust packages: package (its directory), kind, file.

    Those that a manifest gives a path to, and those at the usual places below the nearest package, unless its manifest
    switches that kind off.
    """
    manifest = declared.where("file like '%Cargo.toml'")
    packages = manifest.where("what = 'package'").select(parent(F.col("file")).alias("package"))
    sources = lookups.nearest(tree.where("ext = 'rs'").select("path"), "path", packages.select("package").withColumn("_p", F.col("package")), "package").select(F.col("path").alias("file"), F.col("_p").alias("package"))
    below = F.when(F.col("package") == "", F.col("file")).otherwise(F.expr("substring(file, length(package) + 2)"))
    kind = F.coalesce(*[F.when(below.rlike(pattern), k) for k, pattern in _LAYOUT.items()])
    off = manifest.where("what = 'undiscovered'").select(parent(F.col("file")).alias("package"), F.col("name").alias("kind"))
    placed = sources.select("package", kind.alias("kind"), "file").where("kind is not null").join(off, ["package", "kind"], "left_anti")
    own = manifest.where("what = 'target' and value is not null").select(parent(F.col("file")).alias("package"), F.col("section").alias("kind"), "value")
    own = own.select("package", "kind", lexical(F.concat_ws("/", F.when(F.col("package") != "", F.col("package")), "value")).alias("file"))
    return placed.unionByName(own.join(tree.select(F.col("path").alias("file")), "file", "left_semi").select("package", "kind", "file")).distinct()


def script_exports(facts: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Export tables of script files, as definitions.exported_definitions takes them: exports and stars.

    Declarations; names that an export list gives, of the file's own or of what it imports; re-exports, of names and of
    whole files. A file's first statement for a name counts, declarations first.
    """
    script = F.col("file").rlike(_SCRIPT)
    taken = imports.where(script & ~F.col("passes_on") & F.col("name").isNotNull()).select("file", F.coalesce("alias", "name").alias("local"), F.col("name").alias("_taken"), F.col("target").alias("_target"), "whole")
    row = lambda rank, kind, target, inner: ["file", "name", F.struct(F.lit(rank).alias("rank"), "line", kind.alias("kind"), target.alias("target"), inner.alias("inner"), "type_only").alias("x")]
    null = F.lit(None).cast("string")
    own = facts.where(script & (F.col("what") == "symbol")).select(*row(0, F.lit("local"), null, null))
    lists = facts.where(script & (F.col("what") == "export")).select("file", "name", F.coalesce("alias", "name").alias("local"), "line", "type_only").join(taken, ["file", "local"], "left")
    kind = F.when(F.col("whole"), "namespace").when(F.col("_taken").isNotNull(), "reexport").when(F.col("local") != F.col("name"), "alias").otherwise("local")
    lists = lists.select(*row(1, kind, F.col("_target"), F.coalesce("_taken", "local")))
    passed = imports.where(script & F.col("passes_on"))
    named = passed.where(~F.col("whole") | F.col("alias").isNotNull()).withColumn("_inner", F.col("name"))
    named = named.withColumn("name", F.coalesce("alias", "name")).select(*row(2, F.when(F.col("whole"), "namespace").otherwise("reexport"), F.col("target"), F.col("_inner")))
    exports = own.unionByName(lists).unionByName(named).groupBy("file", "name").agg(F.min("x").alias("x")).select("file", "name", "x.kind", "x.target", "x.inner", "x.line", "x.type_only")
    return exports, passed.where(F.col("whole") & F.col("alias").isNull()).select("file", "target", "line", "type_only")


def python_bindings(facts: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What Python files define, bind and list, as definitions.bound_definitions takes them: defined, bound, stars, listed."""
    py = F.col("file").rlike(r"[.]pyi?$")
    module = imports.where(py & (F.col("scope") == "module"))
    defined = facts.where(py & (F.col("what") == "symbol") & (F.col("scope") == "module")).select("file", "name")
    named = module.where(F.col("name").isNotNull() & (F.col("name") != definitions.WHOLE)).select("file", F.coalesce("alias", "name").alias("name"), "target", F.when(F.col("whole"), definitions.WHOLE).otherwise(F.col("name")).alias("inner"), "line", "type_only")
    plain = module.where(F.col("name").isNull()).select("file", F.coalesce("alias", F.substring_index("module", ".", 1)).alias("name"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("inner"), "line", "type_only")
    listed = facts.where(py & (F.col("what") == "export")).groupBy("file").agg(F.collect_set("name").alias("names"))
    return defined, named.unionByName(plain), module.where(F.col("name") == definitions.WHOLE).select("file", "target", "line", "type_only"), listed


@dataclass
class Engine:
    spark: SparkSession
    root: str
    tree: DataFrame
    facts: DataFrame
    manifests: DataFrame
    limits: dict[str, int] = field(default_factory=lambda: {"list": 10, "evidence": 3})

    @classmethod
    def scan(cls, spark: SparkSession, root: str, *, manifests_only: bool = False) -> Engine:
        """The tree is listed and parsed once; what comes of it is kept in the shared folder."""
        all_files = files.scan(spark, root)
        tree = settle(files.described(all_files.drop("content")))
        facts = settle(code.facts(all_files.limit(0) if manifests_only else all_files))
        return cls(spark, root, tree, facts, settle(manifests.manifests(all_files)))

    @cached_property
    def imports(self) -> DataFrame:
        """Statements that import: file, line, module, name, target, scope, type_only, alias, whole, passes_on, test."""
        both = python_imports(self.facts, self.tree).unionByName(typescript_imports(self.facts, self.tree, self.manifests)).unionByName(rust_imports(self.facts, self.tree, self.manifests))
        return settle(both.distinct().withColumn("test", test_file(F.col("file"))))

    @cached_property
    def rust_modules(self) -> tuple[DataFrame, DataFrame]:
        """Modules of every target of the Rust packages, a target by its root file, and declarations that load nothing (modules.forest)."""
        roots = cargo_targets(self.tree, self.manifests).select(F.col("file").alias("crate"), "file").distinct()
        mods = self.facts.where("what = 'module' and file like '%.rs'").select("file", F.coalesce("module", F.lit("")).alias("inside"), "name", "line", F.col("signature").alias("path"), "kind")
        grown, refused = modules.forest(roots, mods.where("kind = 'file'"), mods.where("kind = 'inline'"), self.tree.select("path"))
        return settle(grown), settle(refused)

    @cached_property
    def definitions(self) -> DataFrame:
        """Where names are defined that statements take from files of the tree: target, name, def_file, def_name, line, through re-exports alone; line is the target's that passes the name on."""
        asked = self.imports.where(F.col("target").isNotNull() & F.col("name").isNotNull() & (F.col("name") != definitions.WHOLE) & ~F.col("whole")).select(F.col("target").alias("file"), "name").distinct()
        scripts = definitions.exported_definitions(*script_exports(self.facts, self.imports), asked.where(F.col("file").rlike(_SCRIPT))).where("status = 'found'")
        python = definitions.bound_definitions(*python_bindings(self.facts, self.imports), asked.where(F.col("file").rlike("[.]pyi?$"))).where("status = 'through'")
        columns = ["file", "name", "def_file", "def_name", "line"]
        both = scripts.select(columns).unionByName(python.select(columns))
        return settle(both.where("file <> def_file").withColumnRenamed("file", "target"))

    @cached_property
    def statements(self) -> DataFrame:
        """Imports of files of the tree by name, as barrels.passed_on takes them."""
        name = F.when(F.col("whole") | (F.col("name") == definitions.WHOLE), definitions.WHOLE).otherwise(F.col("name"))
        known = self.definitions.select("target", "name", F.lit(True).alias("found"))
        return settle(self.imports.select("file", "line", "target", name.alias("name"), "alias", "passes_on", "test").join(known, ["target", "name"], "left"))

    @cached_property
    def components(self) -> DataFrame:
        """Packages by their manifests (the root at least), directories with sources below them, source files as modules; externals by declaration."""
        null = F.lit(None).cast("string")
        own = self.manifests.where("what = 'package'").select(parent(F.col("file")).alias("path"), F.col("name").alias("label"), F.col("file").alias("manifest"))
        root = self.spark.createDataFrame([("", "root", "")], "path string, label string, manifest string").join(own.where("path = ''").select("path"), "path", "left_anti")
        packages = own.unionByName(root).groupBy("path").agg(F.min("label").alias("name"))
        sources = self.tree.where(F.col("ext").isin(*code.READERS)).select("path", "dir", "language")
        dirs = sources.select(F.explode(F.expr("transform(sequence(1, greatest(size(split(dir, '/')), 1)), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")).alias("path")).where("path <> ''").distinct().join(packages.select("path"), "path", "left_anti")
        ident = lambda p: F.when(p == "", ".").otherwise(p)
        p = F.col("path")
        rows = packages.select(ident(p).alias("id"), "name", F.lit("package").alias("kind"), null.alias("language"), "path", F.when(p != "", F.lit("up")).alias("parent"))
        rows = rows.unionByName(dirs.select(p.alias("id"), p.alias("name"), F.lit("module").alias("kind"), null.alias("language"), "path", F.lit("up").alias("parent")))
        rows = rows.unionByName(sources.select(p.alias("id"), p.alias("name"), F.lit("module").alias("kind"), "language", "path", F.lit("up").alias("parent")))
        rows = rows.withColumn("parent", F.when(F.col("parent").isNotNull(), ident(parent(p))))
        known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("_k"))
        rows = rows.join(known, "parent", "left").withColumn("parent", F.when(F.col("_k"), F.col("parent")).when(F.col("parent").isNotNull(), ".")).drop("_k")
        deps = self.manifests.where("what = 'dependency' and name is not null")
        eco = F.when(F.col("file").endswith("package.json"), "npm").when(F.col("file").endswith("Cargo.toml"), "cargo").otherwise("pypi")
        inner = packages.select(F.col("name").alias("_own"))
        ext = deps.join(inner, deps.name == inner._own, "left_anti").select(F.concat_ws(":", F.lit("ext"), eco, "name").alias("id"), "name").distinct()
        ext = ext.select("id", "name", F.lit("external").alias("kind"), null.alias("language"), null.alias("path"), null.alias("parent"))
        return settle(rows.select(*ext.columns).unionByName(ext))

    @cached_property
    def evidence(self) -> DataFrame:
        """Observations: imports between files, and imports of declared externals."""
        inside = self.imports.where("target is not null and target <> file").select(F.col("file").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("kind"), "file", "line", "target", F.coalesce("name", F.lit("*")).alias("name"), "test", "type_only", "scope")
        out = self.imports.where("target is null")
        externals = self.components.where("kind = 'external'").select(F.col("id").alias("dst"), F.substring_index("id", ":", -1).alias("_n"))
        npm = out.where("file rlike '[.][cm]?[jt]sx?$'").withColumn("_n", npm_package(F.col("module"))).join(externals.where("dst like 'ext:npm:%'"), "_n")
        py_names = lookups.distributions(out.where("file rlike '[.]pyi?$' and module <> ''").select("module"), externals.where("dst like 'ext:pypi:%'").select(F.col("_n").alias("name")), self.spark.createDataFrame([], "prefix string, distribution string"), self.spark.createDataFrame(WELL_KNOWN, "top string, distribution string"))
        py = out.where("file rlike '[.]pyi?$'").join(py_names, "module").withColumn("dst", F.concat(F.lit("ext:pypi:"), "distribution"))
        cols = ["src", "dst", "kind", "file", "line", "target", "name", "test", "type_only", "scope"]
        rs = out.where("file like '%.rs'").withColumn("_n", F.substring_index("module", "::", 1)).join(externals.where("dst like 'ext:cargo:%'").select("dst", F.translate("_n", "-", "_").alias("_n")), "_n")
        ext = npm.select(*out.columns, "dst").unionByName(py.select(*out.columns, "dst")).unionByName(rs.select(*out.columns, "dst")).select(F.col("file").alias("src"), "dst", F.lit("imports").alias("kind"), "file", "line", F.lit(None).cast("string").alias("target"), F.coalesce("name", F.lit("*")).alias("name"), "test", "type_only", "scope")
        rows = inside.select(*cols).unionByName(ext.select(*cols)).groupBy(*[c for c in cols if c != "name"]).agg(F.array_sort(F.collect_set("name")).alias("names"))
        return settle(rows.withColumn("server_reference", F.lit(False)))

    @cached_property
    def unmapped(self) -> DataFrame:
        """Imports that no file and no declaration explains: src, module, reason, file, line, test."""
        known = self.evidence.select("file", "line").distinct()
        u = self.imports.where("target is null and module <> ''").join(known, ["file", "line"], "left_anti")
        std = F.col("file").rlike("[.]pyi?$") & F.substring_index("module", ".", 1).isin(*STANDARD)
        node = F.col("module").startswith("node:") | (F.col("file").endswith(".rs") & F.substring_index("module", "::", 1).isin("std", "core", "alloc"))
        return settle(u.where(~std & ~node).select(F.col("file").alias("src"), "module", F.when(F.col("module").startswith("."), "not_found").otherwise("undeclared").alias("reason"), "file", "line", "test"))

    @cached_property
    def symbols(self) -> DataFrame:
        return settle(self.facts.where("what = 'symbol'").select(F.concat_ws("::", "file", "name").alias("id"), "name", "kind", F.col("file").alias("component"), "signature", "file", "line"))

    @cached_property
    def history(self) -> dict[str, DataFrame]:
        return git.read(self.spark, self.root.removeprefix("file://"))

    def edges(self) -> DataFrame:
        return relations.merge_edges(self.evidence, ["file", "line", "target", "names", "test", "type_only", "server_reference", "scope"])

    def coverage(self) -> DataFrame:
        read = self.facts.where("what <> 'error'").select(F.col("file").alias("path")).distinct().withColumn("_r", F.lit(True))
        parsed = self.facts.where("what = 'error'").select(F.col("file").alias("path")).distinct().withColumn("_e", F.lit(True))
        f = self.tree.join(read, "path", "left").join(parsed, "path", "left")
        return relations.coverage(f.select("ext", F.col("_e").isNull().alias("read"), F.lit(False).alias("script")), files.languages(self.spark))

    def summary(self, depth: int = 1) -> dict[str, DataFrame]:
        """Components at a depth, what depends on what, what is used most, externals, languages, gaps."""
        rolled = settle(graph.rolled_up(self.evidence, self.components, depth))
        degrees = graph.dependents(rolled.where("dst not like 'ext:%'"))
        top = relations.competition_rank(degrees, "dependents").orderBy(F.desc("dependents"), F.desc("dependencies"), "id").limit(self.limits["list"])
        pairs = relations.statement_counts(rolled, ["src", "dst"]).drop("statements")
        ext = rolled.where("dst like 'ext:%'").groupBy("dst").agg(F.count_distinct("src").alias("importers"), relations.statements().alias("statements"))
        shown = graph.folded(self.components, depth).select("at").distinct().join(self.components, F.col("at") == F.col("id")).select("id", "name", "kind", "path", "parent")
        return {"components": shown, "most_depended_on": top, "dependencies": pairs.where("dst not like 'ext:%'").orderBy(F.desc("production"), F.desc("tests"), "src", "dst"), "externals": ext.orderBy(F.desc("importers"), F.desc("statements"), "dst"), "languages": self.coverage(), "gaps": self.unmapped.groupBy("reason").agg(F.count_distinct(F.struct("file", "line")).alias("statements"))}

    def resolve(self, target: str) -> DataFrame:
        """What a target may mean, by the first kind that matches: id, kind of match, number of answers."""
        wanted = self.spark.createDataFrame([(target.removeprefix("./").rstrip("/") or ".",)], "target string")
        t = wanted.first().target
        lit = F.lit(t).alias("target")
        c, s = self.components, self.symbols
        steps = [c.where(F.col("id") == t).select(lit, F.col("id").alias("found")), s.where(F.col("id") == t).select(lit, F.col("id").alias("found")), c.where(F.col("name") == t).select(lit, F.col("id").alias("found")), s.where(F.col("name") == t).select(lit, F.col("id").alias("found")), c.where(F.translate(F.regexp_replace("id", r"\.[a-z]+$", ""), "/", ".") == t).select(lit, F.col("id").alias("found")), lookups.named(c, "id", t).select(lit, F.col("id").alias("found")), c.where(F.col("id") == F.concat(F.lit("ext:npm:"), npm_package(F.lit(t)))).select(lit, F.col("id").alias("found")), self.unmapped.where(F.col("module") == t).select(lit, F.col("src").alias("found"))]
        exact = lookups.cascade(wanted, "target", steps)
        if not exact.isEmpty():
            return exact
        names = c.select("id", "name", "kind", F.lit(False).alias("test")).unionByName(s.select("id", "name", "kind", F.lit(False).alias("test")))
        near = lookups.near_matches(names, wanted.withColumnRenamed("target", "wanted"))
        return near.select(F.col("wanted").alias("target"), F.lit(len(steps)).alias("step"), F.col("id").alias("found"), F.col("rest").alias("answers"))

    def query(self, target: str) -> dict[str, DataFrame]:
        """One component, directory, file or symbol: children, symbols, statements each way, gaps."""
        ident = self.resolve(target).first()
        if ident is None:
            raise LookupError(target)
        at = ident.found
        file = at.partition("::")[0]
        inside = lambda c: (F.col(c) == file) | F.startswith(F.col(c), F.lit(file + "/")) | F.lit(file == ".")
        e = self.evidence
        out = {"component": self.components.where(F.col("id") == file), "children": self.components.where(F.col("parent") == file), "symbols": self.symbols.where(inside("component")).orderBy("file", "line"), "uses": e.where(inside("src") & ~inside("dst")), "used_by": e.where(inside("dst") & ~inside("src")), "gaps": self.unmapped.where(inside("src"))}
        if "::" in at:
            name = at.partition("::")[2]
            through = self.definitions.where((F.col("def_file") == file) & F.col("def_name").isin(name, definitions.WHOLE)).select("target", F.col("name").alias("_n"))
            passed = e.join(through, "target").where(F.array_contains("names", F.col("_n"))).select(e.columns)
            out["importers"] = e.where((F.col("target") == file) & (F.array_contains("names", name) | F.array_contains("names", "*"))).unionByName(passed).distinct()
        return out

    def impact(self, target: str) -> DataFrame:
        """Files, components and tests that a change of the target reaches, nearest first.

        A file that passes names of the changed ones on is followed to those that take them, or may; whoever takes other
        names from it is not reached. A statement is next to the file that defines what it takes, through any re-exports.
        """
        at = self.resolve(target).first()
        if at is None:
            raise LookupError(target)
        file = at.found.partition("::")[0]
        sources = self.tree.where(F.col("ext").isin(*code.READERS)).select(F.col("path").alias("file"), "dir")
        changed = sources.where((F.col("file") == file) | F.startswith(F.col("file"), F.lit(file + "/")) | F.lit(file == ".")).select("file")
        passing = self.statements.where("passes_on and target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst"), "line").distinct()
        loads = self.evidence.where("target is not null").select("src", F.col("target").alias("dst"), "line", "test").join(passing.withColumn("passes_on", F.lit(True)), ["src", "dst", "line"], "left").na.fill(False, ["passes_on"])
        defined = self.statements.where("not passes_on").join(self.definitions.drop("line"), ["target", "name"]).where("file <> def_file").select(F.col("file").alias("src"), F.col("def_file").alias("dst"), "test", F.lit(False).alias("passes_on"))
        loads = loads.select("src", "dst", "test", "passes_on").unionByName(defined).distinct()
        links, _ = barrels.passed_on(changed.select(F.lit("").alias("change"), "file"), self.statements, self.symbols.select("file", "name"))
        owners = sources.select("file", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("component"), test_file(F.col("file")).alias("test"))
        return graph.impact(loads, owners, changed, links=links).orderBy("distance", "kind", "id")

    @cached_property
    def loaded(self) -> DataFrame:
        """The evidence, and what statements take through re-exports, with the place that passes it on: what lookups.loaded_dependencies judges."""
        null = F.lit(None)
        own = self.evidence.select("src", "dst", "kind", "file", "line", "target", "names", "test", null.cast("string").alias("via_file"), null.cast("int").alias("via_line"))
        through = self.statements.join(self.definitions.withColumnRenamed("line", "via_line"), ["target", "name"]).where("file <> def_file")
        via = through.select(F.col("file").alias("src"), F.col("def_file").alias("dst"), F.lit("imports").alias("kind"), "file", "line", F.col("def_file").alias("target"), F.array("name").alias("names"), "test", F.col("target").alias("via_file"), "via_line")
        return settle(own.unionByName(via))

    def gaps(self, most: int | None = None) -> DataFrame:
        """What may load each source file unseen (gaps.gap_lists): calls of computed names below a directory of its path, imports without a file that end in its name."""
        f = self.facts.where("what = 'dynamic'").withColumn("test", test_file(F.col("file")))
        head = F.coalesce("module", F.lit(""))
        python = F.translate(F.regexp_replace(head, r"[^.]*$", ""), ".", "/")
        script = F.when(head.rlike(r"^\.{1,2}/"), lexical(F.concat_ws("/", F.when(parent(F.col("file")) != "", parent(F.col("file"))), F.regexp_replace(head, "[^/]*$", "")))).otherwise("")
        below = F.rtrim(F.when(F.col("file").rlike(_SCRIPT), script).otherwise(python), F.lit("/"))
        calls = f.select(F.lit("dynamic").alias("kind"), F.coalesce(below, F.lit("")).alias("key"), "file", "line", "test", F.col("name").alias("what"))
        like = self.unmapped.select(F.lit("named").alias("kind"), F.regexp_extract("module", r"([\w$-]+)[^\w$-]*$", 1).alias("key"), "file", "line", "test", F.col("module").alias("what"))
        sources = self.tree.where(F.col("ext").isin(*code.READERS)).select("path", F.col("path").alias("own"), F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("stem"))
        wanted = sources.select(F.col("path").alias("subject"), F.lit("dynamic").alias("kind"), F.explode(gaps.directories(F.col("path"))).alias("key"), "own")
        wanted = wanted.unionByName(sources.select(F.col("path").alias("subject"), F.lit("named").alias("kind"), F.col("stem").alias("key"), "own"))
        return gaps.gap_lists(calls.unionByName(like), wanted, most=most or self.limits["list"])

    def check(self, text: str) -> tuple[DataFrame, DataFrame]:
        """Findings and signals under rules written in TOML."""
        table, members = parse_rules(self.spark, text), None
        members = lookups.membership(self.components, table["declared"])
        findings = rules.check(self.evidence, self.components, table, members, self.unmapped, lookups.loaded_dependencies(self.loaded))
        signals = rules.mixed_directions(graph.rolled_up(self.evidence.where("not (test or type_only) and target is not null"), self.components, 1))
        return findings.orderBy("ordinal", "subject", "object"), signals

    def co_change(self, target: str, *, max_files: int = 30) -> DataFrame:
        """Files that change together with the target's, renames followed, by how often."""
        h = self.history
        at = self.resolve(target).first()
        file = at.found.partition("::")[0] if at else target
        now = commits.identities(h["commits"], h["changes"])
        changes = h["changes"].join(now, ["commit", "path"]).withColumn("path", F.col("now")).drop("now")
        paths = changes.select("path").distinct().where((F.col("path") == file) | F.startswith(F.col("path"), F.lit(file + "/")))
        counted = commits.classified(h["commits"], h["changes"], max_files=max_files).where("class = 'counted'")
        return commits.degree_order(commits.co_changed(changes, counted, paths))

    def work(self, path: str, number: int | None = None) -> dict[str, DataFrame]:
        """Items of a snapshot with their links, commits known here and the components that these change."""
        snap = snapshot.read(self.spark, path)
        if snap is None:
            raise FileNotFoundError(path)
        links = work.commits_of_items(snap["items"], snap["item_commits"], self.history["commits"])
        owners = self.components.where("kind <> 'external'").select("path", F.col("id").alias("component")).where("path is not null")
        changed = commits.commit_files(self.history["changes"], links.select("id").distinct())
        out = {"items": snap["items"], "links": work.ends(snap["relations"]), "commits": links, "unmatched": work.unmatched(snap["items"], links), "unlinked": work.unlinked(self.history["commits"].select("id"), links), "code": work.code_of_items(links, changed, owners)}
        return out if number is None else {k: v.where(F.col("number") == number) if "number" in v.columns else v for k, v in out.items()}

    def write(self, folder: str) -> None:
        """The graph as JSON lines, a folder per relation, whose files are in a fixed order one after the other."""
        for name, df, order in (("components", self.components, ["id"]), ("symbols", self.symbols, ["id", "line"]), ("edges", self.edges(), ["src", "dst", "kind"]), ("unmapped_imports", self.unmapped, ["file", "line", "module"])):
            df.orderBy(*order).write.mode("overwrite").json(f"{folder}/{name}")


#: Modules of the Python standard library come from the interpreter; names that differ from their distribution's.
STANDARD = tuple(sorted(__import__("sys").stdlib_module_names))
WELL_KNOWN = [("yaml", "pyyaml"), ("PIL", "pillow"), ("bs4", "beautifulsoup4"), ("sklearn", "scikit-learn"), ("cv2", "opencv-python"), ("dateutil", "python-dateutil"), ("attr", "attrs"), ("dotenv", "python-dotenv"), ("jwt", "pyjwt"), ("google", "protobuf")]
_RULE_KEYS = {"components", "deny", "layers", "allow", "coverage", "cycles", "undeclared_imports"}


def parse_rules(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Rule tables of a TOML text; unknown keys are errors.

    [components] name = selector or list; [[deny]] from, to; [layers] order = names, top first; [allow] name = names;
    [coverage] require = selectors; [cycles] within = selectors, all components without them; [undeclared_imports] ignore = prefixes.
    """
    data = tomllib.loads(text)
    if unknown := set(data) - _RULE_KEYS:
        raise ValueError(f"unknown rule keys: {', '.join(sorted(unknown))}")
    listed = lambda x: x if isinstance(x, list) else [x]
    out = {"declared": spark.createDataFrame([(n, s) for n, own in data.get("components", {}).items() for s in listed(own)], "name string, selector string")}
    if "deny" in data:
        out["deny"] = spark.createDataFrame([(i, x["from"], x["to"]) for i, x in enumerate(data["deny"])], "idx int, from string, to string")
    if "layers" in data:
        out["layers"] = spark.createDataFrame([(n, i) for i, n in enumerate(data["layers"]["order"])], "name string, rank int")
    if "allow" in data:
        out["allow"] = spark.createDataFrame([(n, x) for n, own in data["allow"].items() for x in listed(own)], "from string, to string")
    if "coverage" in data:
        out["required"] = spark.createDataFrame([(x,) for x in data["coverage"]["require"]], "selector string")
    if "cycles" in data:
        out["cycle_scope"] = spark.createDataFrame([(x,) for x in listed(data["cycles"].get("within", []))], "selector string")
    if "undeclared_imports" in data:
        out["ignore"] = spark.createDataFrame([(x,) for x in data["undeclared_imports"].get("ignore", [])], "prefix string")
    return out


def render(tables: dict[str, DataFrame], most: int = 10) -> str:
    """Tables as text, the first rows of each and how many more there are."""
    out = []
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out.append(f"{name}:" + (" none" if not rows else ""))
        out += ["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in rows[:most]]
        if len(rows) > most:
            out.append(f"  +{df.count() - most} more")
    return "\n".join(out) + "\n"



def trimmed(lists: dict[str, list[str]], most_bytes: int = 8192, least: int = 10) -> str:
    """Ranked lists as text under a budget: the lowest row of the longest list goes until it fits, but for a floor per list."""
    kept = {k: list(v) for k, v in lists.items()}

    def text() -> str:
        return "".join(f"{k}\n" + "".join(f"- {x}\n" for x in v) + (f"  +{len(lists[k]) - len(v)} more\n" if len(v) < len(lists[k]) else "") for k, v in kept.items())

    while len(text().encode()) > most_bytes:
        longest = max(kept, key=lambda k: len("".join(kept[k])) if len(kept[k]) > least else -1)
        if len(kept[longest]) <= least:
            break
        kept[longest].pop()
    return text()
