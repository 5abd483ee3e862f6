"""Work items and their links to commits and code; the incrementally kept snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relations import keep_last

OVERLAP_SECONDS = 300


def commits_of_items(items: DataFrame, item_commits: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits with the items that hold them, by their list or as the commit that merged them: id, number."""
    by_list = item_commits.select(F.col("sha").alias("id"), "number")
    by_merge = items.where("merge_commit is not null").select(F.col("merge_commit").alias("id"), "number")
    return by_list.unionByName(by_merge).distinct().join(commits.select("id"), "id", "left_semi")


def unlinked(commits: DataFrame, links: DataFrame) -> DataFrame:
    return commits.join(links.select("id").distinct(), "id", "left_anti")


def unmatched(items: DataFrame, links: DataFrame) -> DataFrame:
    """Merged items none of whose commits is known here."""
    return items.where("merged_at is not null").join(links.select("number").distinct(), "number", "left_anti")


def ends(relations: DataFrame) -> DataFrame:
    """Each relation from both of its ends that are items here: number, type, other, outgoing."""
    a = relations.where("from.item is not null").select(F.col("from.item").alias("number"), "type", F.col("to").alias("other"), F.lit(True).alias("outgoing"))
    b = relations.where("to.item is not null").select(F.col("to.item").alias("number"), "type", F.col("from").alias("other"), F.lit(False).alias("outgoing"))
    return a.unionByName(b)


def code_of_items(links: DataFrame, files: DataFrame, owners: DataFrame) -> DataFrame:
    """Components with the files that items' commits change: number, component, files. links: id, number; files: commit, path; owners: path, component."""
    touched = links.join(files, links.id == files.commit).select("number", "path").distinct()
    return touched.join(owners, "path").groupBy("number", "component").agg(F.count("*").alias("files"))


def only_mentioned(linked: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Of each item, how many paths are reached by mentions alone: number, paths. Both: number, path."""
    return mentioned.select("number", "path").distinct().join(linked.select("number", "path").distinct(), ["number", "path"], "left_anti").groupBy("number").agg(F.count("*").alias("paths"))


def merge_items(held: DataFrame, read: DataFrame, order: str = "read_at") -> DataFrame:
    """Items after an update: the last read of each number; doing it twice changes nothing."""
    return keep_last(held.unionByName(read), ["number"], [F.col(order)])


def merge_relations(held: DataFrame, read: DataFrame, reread: DataFrame) -> DataFrame:
    """Relations after an update: what reread items (number) recorded is replaced by what was read.

    Relations between two reread items go; of the others, observations that a reread end recorded are taken out
    (recorded: array of the recording item numbers), and those with none left go too.
    """
    numbers = reread.select("number").distinct()
    ids = numbers.withColumn("_in", F.lit(True))
    h = held.join(ids.withColumnRenamed("number", "a").withColumnRenamed("_in", "_a"), "a", "left").join(ids.withColumnRenamed("number", "b").withColumnRenamed("_in", "_b"), "b", "left")
    gone = F.array_compact(F.array(F.when(F.col("_a"), F.col("a")), F.when(F.col("_b"), F.col("b"))))
    kept = h.where("_a is null or _b is null").withColumn("recorded", F.array_except("recorded", gone)).where("size(recorded) > 0").select(*held.columns)
    every = kept.unionByName(read.select(*held.columns))
    return every.groupBy("type", "a", "b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("recorded")))).alias("recorded")).select(*held.columns)


def since(rows: DataFrame, time: str, last: int, *, overlap: int = OVERLAP_SECONDS) -> DataFrame:
    """What an incremental read asks for: changed since the last one less an overlap, seconds."""
    return rows.where(F.col(time) >= last - overlap)


def must_refetch(state: DataFrame) -> DataFrame:
    """Why a snapshot can't be updated in place, the first reason that holds, or null: reason.

    state: one row of flags.
    """
    reasons = ["never_whole", "too_old", "other_repository", "other_titles", "other_bound", "unreadable_time", "no_account", "other_account", "other_links", "too_many_changes"]
    out = F.coalesce(*[F.when(F.col(r), F.lit(r)) for r in reasons])
    return state.select("*", out.alias("reason"))


def retry_seconds(attempts: DataFrame) -> DataFrame:
    """How long to wait after a failure: what the server said, else its reset time, else 5 min doubled per failure, up to 6 h."""
    backoff = F.least(F.lit(6 * 3600), F.lit(300) * F.pow(F.lit(2), F.least("failures", F.lit(12)) - 1)).cast("long")
    return attempts.withColumn("wait", F.coalesce("retry_after", F.when(F.col("reset_at") > F.col("now"), F.col("reset_at") - F.col("now")), backoff))


def items_by_kind(items: DataFrame) -> DataFrame:
    """kind, items."""
    return items.groupBy("kind").agg(F.count("*").alias("items"))


def by_newest_commit(links: DataFrame, commits: DataFrame) -> DataFrame:
    """Items by the time of their newest connecting commit, newest first, then by number: number, newest, commits. links: id, number; commits: id, time."""
    met = links.select("id", "number").distinct().join(commits.select("id", "time"), "id")
    return met.groupBy("number").agg(F.max("time").alias("newest"), F.count("*").alias("commits")).orderBy(F.desc("newest"), "number")


def code_ways(ways: DataFrame) -> DataFrame:
    """Of each item and way to code (a pull request or a commit) the best row: direct before mentioned; in the order they are shown.

    ways: number, way, kind (pull_request or commit), direct, time. Direct ways come first, pull requests before commits, newest first.
    """
    best = ways.groupBy("number", "way", "kind").agg(F.max("direct").alias("direct"), F.max("time").alias("time"))
    return best.orderBy("number", F.desc("direct"), F.col("kind") == "commit", F.desc("time"), "way")


def fetch_start(requests: DataFrame, oldest: DataFrame, *, days: int = 365) -> DataFrame:
    """Since when each repository's items are asked for, and by which rule: all columns, since (seconds; null for all), rule.

    requests: repository, every (ask for all), given (seconds or null), now. oldest: repository, time of its oldest
    commit; a row only where the history was read whole and deep enough. Else it is so many days back.
    """
    r = requests.join(oldest.select("repository", F.col("time").alias("_oldest")), "repository", "left")
    rule = F.when(F.col("every"), "all").when(F.col("given").isNotNull(), "given").when(F.col("_oldest").isNotNull(), "oldest_commit").otherwise("days")
    at = F.when(~F.col("every"), F.coalesce("given", "_oldest", F.col("now") - days * 86_400))
    return r.select(*[F.col(c) for c in requests.columns], at.alias("since"), rule.alias("rule"))


def refresh_views(status: DataFrame, snapshots: DataFrame) -> DataFrame:
    """How the last attempt of each repository bears on its snapshot: host, repository, failed, waiting.

    status: host, repository, attempt_at, error, next_retry_at, now (seconds). snapshots: host, repository, fetched_at.
    An attempt counts as failed if it has an error and began after the snapshot of the same host and repository was
    fetched; a backoff is running if there is an error and its end lies ahead. Unknown times count for neither.
    """
    s = status.join(snapshots.select("host", "repository", "fetched_at"), ["host", "repository"])
    has = F.col("error").isNotNull()
    return s.select("host", "repository", F.coalesce(has & (F.col("attempt_at") > F.col("fetched_at")), F.lit(False)).alias("failed"), F.coalesce(has & (F.col("next_retry_at") > F.col("now")), F.lit(False)).alias("waiting"))
