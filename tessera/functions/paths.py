"""Paths and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    """Without leading ./ and trailing /; the root is the empty string."""
    p = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"/+$", "")
    return F.when(p == ".", "").otherwise(p)


def parent(path: Column) -> Column:
    """The directory a path lies in; empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name; null where there is none or only a leading one."""
    ext = F.regexp_extract(base(path), r"^.+\.([^.]+)$", 1)
    return F.when(ext != "", ext)


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"(?<=.)\.[^.]*$", "")


def ancestors(path: Column, *, itself: bool = True) -> Column:
    """The path, its directories, and the root, longest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    ups = F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, 1, n - i), "/"))
    ups = F.when(path == "", F.array(F.lit(""))).otherwise(ups)
    return F.array_distinct(ups) if itself else F.filter(F.array_distinct(ups), lambda x: x != path)


def prefixes(name: Column, separator: str) -> Column:
    """Leading runs of segments of a dotted or slashed name, longest first."""
    parts = F.split(name, r"\." if separator == "." else separator)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, 1, n - i), separator))


def covered_by(module: Column, prefix: Column) -> Column:
    """Whether the prefix is the module or ends before one of its . or / boundaries."""
    return (module == prefix) | F.startswith(module, F.concat(prefix, F.lit("."))) | F.startswith(module, F.concat(prefix, F.lit("/")))


def under(path: Column, directory: Column) -> Column:
    """Whether a path is a directory or lies below it; everything lies below the root."""
    return (directory == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def last_segment(name: Column) -> Column:
    """After the last slash, else after the last dot or colon."""
    return F.when(F.instr(name, "/") > 0, base(name)).otherwise(F.regexp_extract(name, r"([^.:]*)$", 1))


def module_path(path: Column) -> Column:
    """Without extension, and without a trailing index."""
    p = F.regexp_replace(path, r"\.[A-Za-z]+$", "")
    return F.when(p == "index", "").otherwise(F.regexp_replace(p, r"/index$", ""))


def lexical(path: Column) -> Column:
    """Dots and double dots resolved; null where they lead out of the root."""
    out = F.aggregate(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), F.array().cast("array<string>"), lambda a, x: F.when(a.isNull() | ((x == "..") & (F.size(a) == 0)), F.lit(None).cast("array<string>")).when(x == "..", F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x))))
    return F.array_join(out, "/")


def distribution(name: Column) -> Column:
    """A Python distribution's name in normal form."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def requirement(text: Column) -> Column:
    """The name at the start of a requirement; null where there is none."""
    name = F.regexp_extract(text, r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1)
    return F.when(name != "", name)


def npm_package(specifier: Column) -> Column:
    """The first segment of an import specifier, the first two of a scoped one."""
    return F.when(F.startswith(specifier, F.lit("@")), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def npm_subpath(specifier: Column) -> Column:
    """What follows the package; null for the package itself."""
    rest = F.substring(specifier, F.length(npm_package(specifier)) + 2, F.length(specifier))
    return F.when(rest != "", rest)


def types_package(package: Column) -> Column:
    """The package that holds another's type declarations."""
    return F.concat(F.lit("@types/"), F.replace(F.regexp_replace(package, "^@", ""), F.lit("/"), F.lit("__")))


def import_name(crate: Column) -> Column:
    return F.translate(crate, "-", "_")


def renamed_id(ident: Column, old: Column, new: Column) -> Column:
    """An id and everything below it (::) under another name."""
    return F.when(ident == old, new).when(F.startswith(ident, F.concat(old, F.lit("::"))), F.concat(new, F.substring(ident, F.length(old) + 1, F.length(ident)))).otherwise(ident)


def admits_major(version: Column, major: int) -> Column:
    """Whether a version range admits a release of a major or a later one.

    One of its alternatives does (between ||): by its leading number, which of a hyphen range is the upper end's; by an
    upper bound above it (`<` of exactly the major does not, with a minor above 0 it does); by being open upwards; or
    by naming no number at all.
    """

    def one(alternative: Column) -> Column:
        first = F.substring_index(F.trim(F.substring_index(alternative, " - ", -1)), " ", 1)
        numbers = F.transform(F.split(F.regexp_extract(F.regexp_replace(first, r"^[\^~<>=v]+", ""), r"^\d+(?:\.\d+)*", 0), r"\."), lambda n: n.try_cast("bigint"))
        leading = numbers[0]
        below = (leading > major) | ((leading == major) & F.exists(F.slice(numbers, 2, 1 << 10), lambda n: n > 0))
        bound = F.when(F.startswith(first, F.lit("<=")), leading >= major).otherwise(below)
        open_ = F.startswith(first, F.lit(">")) & ~F.contains(alternative, F.lit("<"))
        return F.when(leading.isNull(), True).when(F.startswith(first, F.lit("<")), bound).otherwise((leading >= major) | open_)

    return F.exists(F.transform(F.split(version, r"\|\|"), lambda a: F.trim(a)), one)


#: File names that stand for their directory in an import.
ENTRY_NAMES = ("index", "__init__", "mod")


def tail(parts: Column) -> Column:
    """Segments of a path or import without the last one's extension, and without an entry file at the end."""
    n = F.size(parts)
    last = F.substring_index(F.element_at(parts, -1), ".", 1)
    front = F.slice(parts, 1, n - 1)
    return F.when(n == 0, parts).when((n > 1) & last.isin(*ENTRY_NAMES), front).otherwise(F.concat(front, F.array(last)))


def segments(path: Column) -> Column:
    """A file's path as an import would name it, in segments."""
    return tail(F.filter(F.split(path, "/"), lambda x: x != ""))


def ends_in(whole: Column, end: Column) -> Column:
    """Whether an array ends in another, not empty one."""
    return (F.size(end) > 0) & (F.size(end) <= F.size(whole)) & (F.slice(whole, F.greatest(F.size(whole) - F.size(end) + 1, F.lit(1)), F.size(end)) == end)


def relative_prefix(file: Column, written: Column) -> Column:
    """The path, from the root, that a relative beginning of a computed specifier gives; null for a bare one, or one that leaves the root or says nothing."""
    at = lexical(F.concat_ws("/", F.when(parent(file) != "", parent(file)), F.regexp_replace(written, r"/[^/]*$", "")))
    path = F.concat(at, F.when(at == "", "").otherwise("/"), F.substring_index(written, "/", -1))
    return F.when(written.rlike(r"^\.\.?/") & (path != ""), path)


def relative_module(base_dotted: Column, level: Column, module: Column) -> Column:
    """The absolute dotted path of an import with so many leading dots; null where it climbs above the top package."""
    parts = F.split(base_dotted, r"\.")
    kept = F.size(parts) - level + 1
    up = F.when(kept >= 0, F.array_join(F.concat(F.slice(parts, 1, F.greatest(kept, F.lit(0))), F.when(module != "", F.array(module)).otherwise(F.array().cast("array<string>"))), "."))
    return F.when(level == 0, module).otherwise(up)


def imports_subpath(written: Column, spec: Column) -> Column:
    """Whether an import names a package's subpath or a module below it; extensions and index files make no difference."""
    w, s = module_path(written), module_path(spec)
    return F.coalesce((w == s) | F.startswith(w, F.concat(s, F.lit("/"))), F.lit(False))
