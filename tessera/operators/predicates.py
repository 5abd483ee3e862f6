"""Filters over observations, edges, components and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.paths import base, ends_in, lexical, parent, segments, under


def runs_in_production(e: Column | None = None) -> Column:
    """An observation outside tests that is there at run time."""
    get = (lambda x: e[x]) if e is not None else F.col
    return ~(get("test") | get("type_only") | get("server_reference"))


def edge_in_production(evidence: Column) -> Column:
    """Some observation outside tests, or none at all."""
    return (F.size(evidence) == 0) | F.exists(evidence, lambda e: ~e["test"])


def edge_runs(evidence: Column) -> Column:
    return (F.size(evidence) == 0) | F.exists(evidence, runs_in_production)


def passes_on(note: Column) -> Column:
    return F.coalesce(note == "export", F.lit(False))


def re_exports(note: Column) -> Column:
    return passes_on(note) | F.coalesce(F.startswith(note, F.lit("export ")) & ~note.rlike(r" via .+:\d+$"), F.lit(False))


def runs_first(note: Column) -> Column:
    return F.coalesce(note == "package", F.lit(False))


def is_entry(note: Column) -> Column:
    return F.coalesce(note == "entry", F.lit(False))


def declares_global(note: Column) -> Column:
    return F.coalesce(note == "global", F.lit(False))


def directive(note: Column) -> Column:
    return F.when(note.isin("use client", "use server"), note)


def may_load(prefix: Column, place: Column) -> Column:
    """Whether a load of a computed name can reach a place; an unknown prefix can reach any."""
    path = prefix["path"]
    either = F.startswith(place, path) | F.startswith(path, F.concat(place, F.lit("/")))
    return prefix.isNull() | (path.isNull() & prefix["first"].isNull()) | F.coalesce(either, F.lit(False)) | F.coalesce(F.array_contains(prefix["first"], place), F.lit(False))


def selector_matches(selector: Column, ident: Column, kind: Column, path: Column) -> Column:
    """A path at a segment boundary, or an external's id with an optional * at its end."""
    external = F.startswith(selector, F.lit("ext:"))
    starred = F.when(F.endswith(selector, F.lit("*")), F.startswith(ident, F.regexp_replace(selector, r"\*$", ""))).otherwise(ident == selector)
    return F.coalesce(F.when(external, (kind == "external") & starred & ~lacks_ecosystem(selector)).otherwise((kind != "external") & under(path, F.when(selector == ".", "").otherwise(selector))), F.lit(False))


def lacks_ecosystem(selector: Column) -> Column:
    """An external selector without its middle part, which can match nothing."""
    return selector.rlike(r"^ext:(?!\*$)[^:]*$")


def test_file(path: Column) -> Column:
    """By name, or by a directory that holds tests."""
    return test_name(path) | path.rlike(r"(^|/)(tests?|__tests__|spec)/")


def test_name(path: Column) -> Column:
    return base(path).rlike(r"^(test_.+\.py|.+_test\.(py|go|rs)|conftest\.py|.+\.(test|spec)\.[cm]?[jt]sx?)$")


def test_kind(path: Column) -> Column:
    return F.when(base(path) == "conftest.py", "conftest").when(test_name(path), "test").otherwise("helper")


def same_statement(left: str, right: str) -> Column:
    """Equality of the statement key (file, line), whose line may be null."""
    return (F.col(f"{left}.file") == F.col(f"{right}.file")) & F.col(f"{left}.line").eqNullSafe(F.col(f"{right}.line"))


def may_be(importer: Column, module: Column, target: Column, same_package: Column) -> Column:
    """Whether an import that nothing answered may mean a target (a file's path).

    A relative one if it lands on the target from the importer's directory; an aliased or plain path, or a dotted name,
    if the target's path ends in its segments, an alias (@/ or ~/) only in the target's own package; a bare name if it
    is the target's last segment.
    """
    goal = segments(target)
    lands = segments(lexical(F.concat_ws("/", F.when(parent(importer) != "", parent(importer)), module))) == goal
    alias = module.rlike("^[@~#]/")
    path = segments(F.regexp_replace(module, "^[@~#]/", ""))
    dotted = F.split(module, r"\.")
    by_end = F.when(alias, same_package & ends_in(goal, path)).when(F.contains(module, F.lit("/")), ends_in(goal, path)).otherwise(ends_in(goal, dotted))
    return F.coalesce(F.when(module.rlike(r"^\.{1,2}(/|$)"), lands).otherwise(by_end), F.lit(False))


#: A test runner's calls that put a mock in a module's place.
MOCK_CALLS = ("vi.mock", "vi.doMock", "vi.importMock", "jest.mock", "jest.doMock", "jest.requireMock", "jest.createMockFromModule", "jest.genMockFromModule")
#: The words that may stand before a class member.
MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor")


def is_mock_call(note: Column) -> Column:
    return F.coalesce(note.isin(*MOCK_CALLS), F.lit(False))


def takes_self(signature: Column) -> Column:
    """Whether a function's first parameter is self; generics before the parameters may hold brackets of their own."""
    flat = F.replace(F.regexp_replace(signature, r"^.*?\bfn ", ""), F.lit("->"), F.lit("  "))
    for _ in range(4):  # generics in generics, innermost first
        flat = F.regexp_replace(flat, r"<[^<>]*>", "")
    return F.coalesce(flat.rlike(r"^[^(]*\(\s*(&\s*('\w+\s+)?)?(mut\s+)?self\b"), F.lit(False))


def instance_method(name: Column, signature: Column) -> Column:
    """A method that is called through values: a class member without static, or a method that takes self."""
    static = F.coalesce(signature, F.lit("")).rlike(rf"^\s*(({'|'.join(MODIFIERS)})\s+)*static(\s|$)")
    return F.when(F.contains(name, F.lit(".")), ~static).when(F.contains(name, F.lit("::")), takes_self(F.coalesce(signature, F.lit("")))).otherwise(False)


def values_note(kind: Column, name: Column, signature: Column) -> Column:
    """Which caveat calls through values need: of a method's values, of a trait's, or none (null)."""
    return F.when(instance_method(name, signature), "values").when(kind == "trait", "trait_values")


def target_test_kind(targets: Column) -> Column:
    """The kind of a test file by the build targets that hold it, an array of (kind, root): a test's root comes first."""
    has = lambda kind, root=None: F.exists(targets, lambda t: (t["kind"] == kind) & (F.lit(True) if root is None else t["root"] == root))
    return F.when(has("test", True), "test").when(has("example"), "example").when(has("bench"), "bench").when(has("test", False), "helper").otherwise("test")
