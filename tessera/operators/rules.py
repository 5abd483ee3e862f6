"""Declared architecture: findings where relations don't follow the rules, and signals.

Rule tables have a rule file's few rows and are broadcast. Findings have kind, subject, object and detail, and an order:
unmatched selectors, denied dependencies, layers, allowances, coverage, undeclared imports, cycles, ignores without use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import covered_by
from tessera.operators.graph import cycle_levels, strong_components
from tessera.operators.predicates import selector_matches

ORDER = ("unmatched_selector", "denied", "unknown_name", "layer", "unexpected", "stale", "uncovered", "undeclared", "cycle", "unmatched_ignore")


def selected(components: DataFrame, selectors: DataFrame) -> DataFrame:
    """Ids of the components that a selector (one column) matches."""
    return components.join(F.broadcast(selectors), selector_matches(F.col("selector"), F.col("id"), F.col("kind"), F.col("path"))).select("id").distinct()


def unmatched_selectors(components: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared selectors that match no component: name, selector."""
    c = components.select("id", "kind", "path")
    met = c.join(F.broadcast(declared), selector_matches(F.col("selector"), F.col("id"), F.col("kind"), F.col("path"))).select("name", "selector").distinct()
    return declared.select("name", "selector").join(met, ["name", "selector"], "left_anti")


def _side(dependencies: DataFrame, end: str, components: DataFrame, members: DataFrame) -> DataFrame:
    own = components.select(F.col("id").alias(end), F.col("kind").alias(f"_{end}_kind"), F.col("path").alias(f"_{end}_path"))
    return dependencies.join(own, end, "left").join(members.select(F.col("id").alias(end), F.col("name").alias(f"_{end}_name")), end, "left")


def denied(dependencies: DataFrame, components: DataFrame, members: DataFrame, deny: DataFrame, declared: DataFrame) -> DataFrame:
    """Dependencies that a deny rule forbids: idx, src, dst. A side of a rule is a declared name or else a selector."""
    d = _side(_side(dependencies.select("src", "dst").distinct(), "src", components, members), "dst", components, members)
    names = declared.select("name").distinct()
    rules = deny.join(names.select(F.col("name").alias("from"), F.lit(True).alias("_f")), "from", "left").join(names.select(F.col("name").alias("to"), F.lit(True).alias("_t")), "to", "left")

    def holds(rule: str, known: str, end: str):
        return F.when(F.col(known).isNotNull(), F.col(rule) == F.col(f"_{end}_name")).otherwise(selector_matches(F.col(rule), F.col(end), F.col(f"_{end}_kind"), F.col(f"_{end}_path")))

    return d.join(F.broadcast(rules), holds("from", "_f", "src") & holds("to", "_t", "dst")).select("idx", "src", "dst").distinct()


def declared_pairs(dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """Dependencies between different declarations: from, to, src, dst."""
    a, b = members.select(F.col("id").alias("src"), F.col("name").alias("from")), members.select(F.col("id").alias("dst"), F.col("name").alias("to"))
    return dependencies.join(a, "src").join(b, "dst").where(F.col("from") != F.col("to")).select("from", "to", "src", "dst")


def unknown_names(names: DataFrame, declared: DataFrame) -> DataFrame:
    return names.select("name").distinct().join(declared.select("name"), "name", "left_anti")


def layer_violations(pairs: DataFrame, layers: DataFrame) -> DataFrame:
    """Dependencies on a layer above one's own: from, to, src, dst. layers: name, rank, 0 at the top."""
    a, b = layers.select(F.col("name").alias("from"), F.col("rank").alias("_a")), layers.select(F.col("name").alias("to"), F.col("rank").alias("_b"))
    return pairs.join(F.broadcast(a), "from").join(F.broadcast(b), "to").where("_b < _a").select("from", "to", "src", "dst")


def unexpected(pairs: DataFrame, allow: DataFrame) -> DataFrame:
    """Dependencies of declarations that have an allow list, on others than it names: from, to, src, dst."""
    listed = allow.select("from").distinct()
    return pairs.join(F.broadcast(listed), "from", "left_semi").join(F.broadcast(allow.select("from", "to")), ["from", "to"], "left_anti").select("from", "to", "src", "dst")


def stale(pairs: DataFrame, allow: DataFrame) -> DataFrame:
    """Allowances that nothing makes use of: from, to."""
    return allow.select("from", "to").distinct().join(pairs.select("from", "to").distinct(), ["from", "to"], "left_anti")


def uncovered(components: DataFrame, members: DataFrame, required: DataFrame) -> DataFrame:
    """Leaf components under a required selector that no declaration takes: id."""
    inner = components.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = components.where("kind <> 'external'").join(inner, "id", "left_anti")
    met = leaves.join(F.broadcast(required), selector_matches(F.col("selector"), F.col("id"), F.col("kind"), F.col("path")))
    return met.select("id").distinct().join(members.select("id"), "id", "left_anti")


def undeclared(unmapped: DataFrame, ignore: DataFrame) -> DataFrame:
    """Imports that no manifest declares and no ignored prefix covers."""
    return unmapped.where("reason = 'undeclared'").join(F.broadcast(ignore), covered_by(F.col("module"), F.col("prefix")), "left_anti")


def unmatched_ignores(unmapped: DataFrame, ignore: DataFrame) -> DataFrame:
    met = unmapped.where("reason = 'undeclared'").select("module").distinct().join(F.broadcast(ignore), covered_by(F.col("module"), F.col("prefix"))).select("prefix").distinct()
    return ignore.select("prefix").distinct().join(met, "prefix", "left_anti")


def cycles(evidence: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Components in a cycle of what runs in production, with the verdict on files: id, component, level."""
    e = evidence.where("not (test or type_only)")
    if scope is not None:
        e = e.join(scope.select(F.col("id").alias("src")), "src", "left_semi").join(scope.select(F.col("id").alias("dst")), "dst", "left_semi")
    groups = strong_components(e.select("src", "dst"))
    return groups.join(cycle_levels(e.select("src", "dst", "file", "target", "scope"), groups), "component").select("id", "component", "level")


def mixed_directions(evidence: DataFrame) -> DataFrame:
    """Components that use partners which use them back, through different files: id, partners, used, uses.

    evidence: src, dst, file, target of what runs in production. Partners are mutual. used: target files of what
    partners take from the component; uses: files of the component that take from partners. Reported if both are there
    and share no file.
    """
    e = evidence.where("src <> dst").select("src", "dst", "file", "target").distinct()
    pairs = e.select("src", "dst").distinct()
    mutual = pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    inside = e.join(mutual, ["src", "dst"])
    used = inside.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("used"), F.array_sort(F.collect_set("src")).alias("partners"))
    uses = inside.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("file")).alias("uses"))
    return used.join(uses, "id").where((F.size("used") > 0) & (F.size("uses") > 0) & ~F.arrays_overlap("used", "uses")).select("id", "partners", "used", "uses")


def check(evidence: DataFrame, components: DataFrame, rules: dict[str, DataFrame], members: DataFrame, unmapped: DataFrame | None = None, dependencies: DataFrame | None = None) -> DataFrame:
    """All findings: ordinal, kind, subject, object, detail. rules: declared and any of deny, layers, allow, required, ignore, cycle_scope.

    cycle_scope has selectors; without a row every component is in scope. dependencies: src, dst that the rules are held
    against (lookups.loaded_dependencies), else those of the evidence outside tests.
    """
    dependencies = (evidence.where("not test") if dependencies is None else dependencies).select("src", "dst").distinct()
    pairs = declared_pairs(dependencies, members)
    null = F.lit(None).cast("string")
    row = lambda df, kind, a, b=null, d=null: df.select(F.lit(ORDER.index(kind)).alias("ordinal"), F.lit(kind).alias("kind"), (F.col(a) if isinstance(a, str) else a).alias("subject"), (F.col(b) if isinstance(b, str) else b).alias("object"), (F.col(d) if isinstance(d, str) else d).cast("string").alias("detail"))
    out = [row(unmatched_selectors(components, rules["declared"]), "unmatched_selector", "name", "selector")]
    if "deny" in rules:
        out.append(row(denied(dependencies, components, members, rules["deny"], rules["declared"]), "denied", "src", "dst", "idx"))
    if "layers" in rules:
        out += [row(unknown_names(rules["layers"], rules["declared"]), "unknown_name", "name"), row(layer_violations(pairs, rules["layers"]), "layer", "src", "dst", F.concat_ws(" -> ", "from", "to"))]
    if "allow" in rules:
        out += [row(unexpected(pairs, rules["allow"]), "unexpected", "src", "dst", F.concat_ws(" -> ", "from", "to")), row(stale(pairs, rules["allow"]), "stale", "from", "to")]
    if "required" in rules:
        out.append(row(uncovered(components, members, rules["required"]), "uncovered", "id"))
    if unmapped is not None and "ignore" in rules:
        out += [row(undeclared(unmapped, rules["ignore"]), "undeclared", "src", "module"), row(unmatched_ignores(unmapped, rules["ignore"]), "unmatched_ignore", "prefix")]
    if "cycle_scope" in rules:
        scope = None if rules["cycle_scope"].isEmpty() else selected(components, rules["cycle_scope"])
        out.append(row(cycles(evidence, scope), "cycle", "id", "component", "level"))
    return reduce(DataFrame.unionByName, out)
