"""The work snapshot as JSON: reading, writing whole, and turning recorded API nodes into rows."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relations import keep_last, normalized_relations
from tessera.schemas import RELATIONS, SNAPSHOT_SCHEMA, columns

REF = "struct<kind:string,item:bigint,repository:string,number:bigint,commit:string>"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """items, item_commits and relations in normal form; None without a file. A newer schema is refused."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except FileNotFoundError:
        return None
    if data.get("schema", 0) > SNAPSHOT_SCHEMA:
        raise ValueError(f"snapshot of schema {data['schema']}; this reads up to {SNAPSHOT_SCHEMA}")
    fields = columns("items")
    items = [tuple(x.get(k) for k in fields) for x in data.get("items", [])]
    commits = [(x["number"], sha, i) for x in data.get("items", []) for i, sha in enumerate(x.get("commits", []))]
    end = lambda r: (r.get("kind", "item"), r.get("item"), r.get("repository"), r.get("number"), r.get("commit"))
    links = [(r["type"], end(r["from"]), end(r["to"]), r.get("observed", []), r.get("at"), r.get("will_close")) for r in data.get("relations", [])]
    return normal(spark.createDataFrame(items, RELATIONS["items"]), spark.createDataFrame(commits, RELATIONS["item_commits"]), spark.createDataFrame(links, RELATIONS["relations"]))


def normal(items: DataFrame, item_commits: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The last read of each item, and one relation for each type, ends and time."""
    seq = F.monotonically_increasing_id()
    last = keep_last(items.withColumn("_seq", seq), ["number"], [F.col("_seq")]).drop("_seq")
    merged = normalized_relations(relations.withColumn("_seq", seq), "_seq").select(*columns("relations"))
    return {"items": last, "item_commits": item_commits.distinct(), "relations": merged}


def write_whole(path: str, value: object) -> None:
    """A JSON file that readers see before or after, never in part."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, indent=1, sort_keys=True)
        f.write("\n")
    os.replace(f.name, path)


def from_nodes(nodes: DataFrame) -> dict[str, DataFrame]:
    """Rows of recorded issue and pull request nodes: a column `json` per row.

    Connections give relations as this end records them; a hidden end counts as not visible.
    """
    node = "struct<number:bigint,__typename:string,id:string,title:string,state:string,stateReason:string,createdAt:string,updatedAt:string,closedAt:string,mergedAt:string,mergeCommit:struct<oid:string>,commits:struct<nodes:array<struct<commit:struct<oid:string>>>>,parent:struct<number:bigint>,subIssues:struct<nodes:array<struct<number:bigint>>>,blockedBy:struct<nodes:array<struct<number:bigint>>>,closedByPullRequestsReferences:struct<nodes:array<struct<number:bigint>>>,closingIssuesReferences:struct<nodes:array<struct<number:bigint>>>>"
    n = nodes.select(F.from_json("json", node).alias("n")).select("n.*")
    kind = F.when(F.col("__typename") == "PullRequest", "pull_request").otherwise("issue")
    state = F.when(F.col("mergedAt").isNotNull(), "merged").otherwise(F.lower("state"))
    items = n.select("number", kind.alias("kind"), "id", "title", state.alias("state"), F.lower("stateReason").alias("state_reason"), F.col("createdAt").alias("created_at"), F.col("updatedAt").alias("updated_at"), F.col("closedAt").alias("closed_at"), F.col("mergedAt").alias("merged_at"), F.col("mergeCommit.oid").alias("merge_commit"), F.when(F.col("commits").isNotNull(), F.size("commits.nodes").cast("bigint")).alias("commit_count"))
    commits = n.select("number", F.posexplode("commits.nodes").alias("pos", "c")).select("number", F.col("c.commit.oid").alias("sha"), "pos")
    ref = lambda c: F.struct(F.lit("item").alias("kind"), c.alias("item"), F.lit(None).cast("string").alias("repository"), F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("commit"))

    def links(field: str, name: str, outgoing: bool) -> DataFrame:
        x = n.select("number", F.explode(f"{field}.nodes").alias("o")).where("o is not null").select("number", F.col("o.number").alias("other"))
        a, b = ("number", "other") if outgoing else ("other", "number")
        return x.select(F.lit(name).alias("type"), ref(F.col(a)).alias("from"), ref(F.col(b)).alias("to"), F.array(F.lit(field)).alias("observed"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("boolean").alias("will_close"))

    parents = n.where("parent is not null").select(F.lit("sub_issue").alias("type"), ref(F.col("parent.number")).alias("from"), ref(F.col("number")).alias("to"), F.array(F.lit("parent")).alias("observed"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("boolean").alias("will_close"))
    every = parents.unionByName(links("subIssues", "sub_issue", True)).unionByName(links("blockedBy", "blocked_by", True)).unionByName(links("closedByPullRequestsReferences", "closes", False)).unionByName(links("closingIssuesReferences", "closes", True))
    return normal(items, commits, every)
