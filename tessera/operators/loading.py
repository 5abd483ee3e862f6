"""What runs before what: entries above a module, build units, mocks, statements beside each other, declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import ancestors
from tessera.operators.graph import paths


def entries_above(components: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry files of a module and of the modules above it, up to the first component that is none: id, at, entry.

    components: id, kind, parent. entries: at (a component), entry (its file that runs first).
    """
    chain = paths(components).select("id", F.posexplode(F.reverse("chain")).alias("up", "at"))
    chain = chain.join(components.select(F.col("id").alias("at"), "kind"), "at")
    # Of each chain what lies below its first component that is no module.
    ended = chain.where("kind <> 'module'").groupBy("id").agg(F.min("up").alias("_end"))
    below = chain.join(ended, "id", "left").where("_end is null or up < _end")
    return below.join(entries, "at").select("id", "at", "entry").distinct()


def files_below(owners: DataFrame, above: DataFrame) -> DataFrame:
    """Each file with the other files that run before it: entry, file, test. owners: file, component, test; above: of entries_above."""
    return owners.join(above.select(F.col("id").alias("component"), "entry"), "component").where("file <> entry").select("entry", "file", "test").distinct()


def running_first(statements: DataFrame, owners: DataFrame, above: DataFrame) -> DataFrame:
    """Statements that make an entry run first: entry, src, file, line.

    statements: src, file, line, target. A statement runs the entries above its target's component, but those that also
    lie above its own component, which ran before, and but for the target itself.
    """
    met = statements.join(owners.select(F.col("file").alias("target"), "component"), "target").join(above.select(F.col("id").alias("component"), "entry"), "component")
    met = met.where("entry <> target").select("entry", "src", "file", "line").distinct()
    return met.join(above.select(F.col("id").alias("src"), "entry").distinct(), ["src", "entry"], "left_anti").select("entry", "src", "file", "line")


def nearest_packages(components: DataFrame) -> DataFrame:
    """The nearest package at or above each component: id, package; components outside packages are left out."""
    chain = paths(components).select("id", F.posexplode("chain").alias("depth", "at"))
    return chain.join(components.where("kind = 'package'").select(F.col("id").alias("at")), "at").groupBy("id").agg(F.max_by("at", "depth").alias("package"))


def build_units(sources: DataFrame) -> DataFrame:
    """The crates that compile each file: file, units (sorted). sources: file, unit."""
    return sources.groupBy("file").agg(F.array_sort(F.collect_set("unit")).alias("units"))  # bounded by a package's targets


def entered(here: Column, there: Column, active: Column, importable: Column) -> Column:
    """In which units a walk enters an importer: null where any, empty where it does not; all four are arrays of units.

    A file of one unit, or of none that is known, is entered in any. Files of common units are entered in those walked;
    where nothing is common, another unit's code can take only units that others can import.
    """
    walked = F.when((F.size(here) > 1) & active.isNotNull(), active).otherwise(here)
    crossing = ~F.arrays_overlap(here, there)
    barred = crossing & (F.size(here) > 1) & ~F.arrays_overlap(walked, importable)
    within = F.when(crossing, there).otherwise(F.array_intersect(there, walked))
    no = F.array().cast("array<string>")
    found = F.when(barred | (F.size(within) == 0), no).when(F.size(there) > 1, within)
    return F.when(here.isNotNull() & there.isNotNull(), found)


def replaced(imports: DataFrame) -> DataFrame:
    """Files that a mock replaces for a file's whole run: file, target. imports: file, target, replaces, real (runs or keeps the real module)."""
    known = imports.where("target is not null")
    return known.where("replaces").select("file", "target").distinct().join(known.where("real").select("file", "target").distinct(), ["file", "target"], "left_anti")


def with_siblings(evidence: DataFrame, listed: DataFrame) -> DataFrame:
    """Observations at the places (file, line, target) of those listed, these included."""
    e, at = evidence.alias("e"), listed.select("file", "line", "target").distinct().alias("l")
    same = (F.col("e.file") == F.col("l.file")) & F.col("e.line").eqNullSafe(F.col("l.line")) & F.col("e.target").eqNullSafe(F.col("l.target"))
    return e.join(at, same, "left_semi").distinct()


def taking(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """Statements that take a name from a package, and whole ones by the same specifier: package, name, src, file, line, whole.

    evidence: src, dst (the package), file, line, specifier, names (`*` for the whole module). wanted: package, name.
    """
    e = evidence.select("src", F.col("dst").alias("package"), "file", "line", "specifier", F.explode("names").alias("taken"))
    named = e.join(wanted, "package").where("taken = name").select("package", "name", "specifier", "src", "file", "line")
    by = named.select("package", "name", "specifier").distinct()
    whole = e.where("taken = '*'").join(by, ["package", "specifier"]).select("package", "name", "src", "file", "line", F.lit(True).alias("whole"))
    return named.select("package", "name", "src", "file", "line", F.lit(False).alias("whole")).unionByName(whole).distinct()


def packages_taking(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """The packages from which each name (names: name) is taken: name, package. evidence: dst, names."""
    return evidence.select(F.col("dst").alias("package"), F.explode("names").alias("name")).join(names.select("name").distinct(), "name").select("name", "package").distinct()


def into_subtree(evidence: DataFrame, components: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct statements from outside into each component and what lies below it: id, src, production, tests. of: id."""
    below = paths(components).select("id", F.explode("chain").alias("at")).join(of.select(F.col("id").alias("at")).distinct(), "at")
    into = evidence.join(below.select(F.col("id").alias("dst"), "at"), "dst")
    outside = into.join(below.select(F.col("id").alias("src"), "at"), ["src", "at"], "left_anti")
    each = outside.groupBy("at", "src", "file", "line").agg(F.max((~F.col("test")).cast("long")).alias("p"), F.max(F.col("test").cast("long")).alias("t"))
    return each.groupBy(F.col("at").alias("id"), "src").agg(F.sum("p").alias("production"), F.sum("t").alias("tests"))


def nearest_declarations(declared: DataFrame, order: list[str]) -> DataFrame:
    """The declaration of each package that counts, by its section's place in order: manifest, name, section, version."""
    rank = F.coalesce(*[F.when(F.col("section") == s, i) for i, s in enumerate(order)], F.lit(len(order)))
    return declared.groupBy("manifest", "name").agg(F.min_by(F.struct("section", "version"), F.struct(rank, "version")).alias("d")).select("manifest", "name", "d.*")


def requirement_scopes(requirements: DataFrame, code: DataFrame) -> DataFrame:
    """The closest directory at or above each requirements file that has code below it: file, scope; "" (the root) if none has. code: file."""
    holds = code.select(F.explode(ancestors(F.col("file"), itself=False)).alias("at")).distinct()
    up = requirements.select("file", F.explode(ancestors(F.col("file"), itself=False)).alias("at"))
    near = up.join(holds, "at").groupBy("file").agg(F.max_by("at", F.length("at")).alias("scope"))
    return requirements.select("file").distinct().join(near, "file", "left").select("file", F.coalesce("scope", F.lit("")).alias("scope"))


def dotted_files(names: DataFrame, files: DataFrame) -> DataFrame:
    """The file that a name `<component>.<stem>` means, if it is the only one: name, file. files: component, stem, file."""
    known = files.select(F.concat_ws(".", "component", "stem").alias("name"), "file").distinct()
    found = known.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min("file").alias("file"), F.count("*").alias("n"))
    return found.where("n = 1").select("name", "file")


def appearing_outside(texts: DataFrame, names: DataFrame, skip: DataFrame) -> DataFrame:
    """Names that a file writes as whole words, in code, strings or comments, on a line outside those given: file, name.

    texts: file, text. names: file, name (identifiers). skip: file, line (from 1).
    """
    lines = texts.join(names.select("file").distinct(), "file", "left_semi").select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "row"))
    words = lines.select("file", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(F.split("row", r"[^\p{L}\p{N}_]+"))).alias("name"))
    return words.join(names.distinct(), ["file", "name"]).join(skip.distinct(), ["file", "line"], "left_anti").select("file", "name").distinct()
