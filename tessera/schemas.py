"""Schemas of the relations: a typed property graph of a repository, its history and its work items.

Facts live in `edge_evidence`, a row per observation; `edges` has them merged, as sorted sets of structs. Enums are
strings with a rank where their order matters. Absent booleans are false, absent arrays empty, absent scalars null.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Field order is sort order; null sorts first, as in Spark.
EVIDENCE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("note", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("exported_as", T.ArrayType(T.StructType([T.StructField("taken", T.StringType()), T.StructField("exported", T.ArrayType(T.StringType()))]))),
        T.StructField("test", T.BooleanType()),
        T.StructField("type_only", T.BooleanType()),
        T.StructField("replaces", T.BooleanType()),
        T.StructField("server_reference", T.BooleanType()),
        T.StructField("exposed", T.ArrayType(T.StringType())),
    ]
)


def _table(text: str) -> str:
    return text.replace("EVIDENCE", EVIDENCE.simpleString())


def columns(relation: str) -> list[str]:
    """Names of a relation's columns."""
    text, depth, out = RELATIONS[relation], 0, [""]
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip().split(" ")[0] for x in out]


RELATIONS: dict[str, str] = {
    "components": _table("id string, name string, kind string, language string, path string, parent string, evidence array<EVIDENCE>"),
    "symbols": _table("id string, name string, kind string, component string, signature string, evidence array<EVIDENCE>"),
    "edges": _table("src string, dst string, kind string, evidence array<EVIDENCE>"),
    "edge_evidence": "src string, dst string, kind string, " + ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in EVIDENCE.fields),
    "unmapped_imports": _table("src string, module string, reason string, provided_by array<string>, evidence EVIDENCE"),
    "dynamic_imports": _table("src string, call string, prefix struct<written:string,path:string,first:array<string>>, evidence EVIDENCE"),
    "unread_macros": _table("src string, name string, names array<string>, evidence EVIDENCE"),
    "coverage": _table("language string, files bigint, read bigint, scripts bigint"),
    "commits": _table("id string, parents array<string>, time bigint, boundary boolean, omitted bigint, pos bigint"),
    "changes": _table("commit string, path string, kind string, renamed_from string, similarity int"),
    "head_files": _table("path string, entry string"),
    "items": _table("number bigint, kind string, id string, title string, state string, state_reason string, created_at string, updated_at string, closed_at string, merged_at string, merge_commit string, commit_count bigint"),
    "item_commits": _table("number bigint, sha string, pos int"),
    "relations": _table("type string, from struct<kind:string,item:bigint,repository:string,number:bigint,commit:string>, to struct<kind:string,item:bigint,repository:string,number:bigint,commit:string>, observed array<string>, at string, will_close boolean"),
}

#: Declaration orders, where they differ from the alphabet's.
EDGE_KINDS = ("depends_on", "imports", "calls", "implements")
SCOPES = ("module", "local")
STATEMENT_CLASSES = ("production", "test", "entry", "through")
RELATION_TYPES = ("sub_issue", "blocked_by", "closes", "linked", "cross_referenced", "referenced", "closed_by")
SNAPSHOT_SCHEMA = 1
