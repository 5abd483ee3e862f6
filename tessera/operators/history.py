"""Commits and files: order, identity through renames, files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relations import in_order
from tessera.session import settle, stored

MAX_FILES = 30


def classified(commits: DataFrame, changes: DataFrame, *, max_files: int = MAX_FILES) -> DataFrame:
    """Commits with their class, the first that fits: merge, boundary, large, counted. Size counts moves and what was left out."""
    sizes = changes.groupBy(F.col("commit").alias("id")).agg(F.count("*").alias("size"))
    c = commits.join(sizes, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)) + F.coalesce("omitted", F.lit(0)))
    return c.withColumn("class", F.when(F.size("parents") > 1, "merge").when(F.col("boundary"), "boundary").when(F.col("size") > max_files, "large").otherwise("counted"))


def tallies(classes: DataFrame) -> DataFrame:
    n = lambda k: F.sum((F.col("class") == k).cast("long")).alias(k)
    return classes.agg(F.count("*").alias("read"), n("counted"), n("large"), n("merge"), n("boundary"))


def real_changes(changes: DataFrame) -> DataFrame:
    """Without pure moves."""
    return changes.where("not (kind = 'renamed' and coalesce(similarity, 0) = 100)")


def co_changed(changes: DataFrame, counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Files that share counted commits with the targets: path, shared, own, total (commits of the targets).

    changes: commit, path after renames were followed. The commits of the targets are few beside all commits; the
    join keeps to them, and counts are partial before each shuffle.
    """
    own = settle(real_changes(changes).select("commit", "path").distinct().join(counted.select(F.col("id").alias("commit")), "commit", "left_semi"))
    hit = own.join(targets.select("path"), "path", "left_semi").select("commit").distinct()
    total = hit.agg(F.count("*").alias("total"))
    shared = own.join(hit, "commit", "left_semi").join(targets.select("path"), "path", "left_anti").groupBy("path").agg(F.count("*").alias("shared"))
    each = own.join(shared.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("own"))
    return shared.join(each, "path").crossJoin(F.broadcast(total))  # one row


def degree_order(table: DataFrame) -> DataFrame:
    """Rows in order of shared / mean(total, own), then shared, then path: place. The quotients are compared as exact integers."""
    # Quotients of counts below 10^6 that differ do so by more than 10^-12, so their floors at this scale keep the order.
    return in_order(table, [F.desc(F.expr("cast(shared as decimal(20,0)) * 1000000000000 div (total + own)")), F.desc("shared"), F.asc("path")])


def commit_files(changes: DataFrame, commits: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Files of the given commits (id), under today's names if identity (commit, path, now) is given: commit, path."""
    own = changes.join(commits.select(F.col("id").alias("commit")), "commit", "left_semi")
    if identity is None:
        return own.select("commit", "path").distinct()
    return own.join(identity, ["commit", "path"], "left").select("commit", F.coalesce("now", "path").alias("path")).distinct()


def placed(commits: DataFrame, *, bound: int = 1000) -> DataFrame:
    """Commits with their place, newest first: id, place, a number that only grows from child to parent.

    The order of pos holds wherever children come before their parents in it, as they do in a log in topological order.
    Else a parent takes the greatest place of its children and one step more where its own is not greater; that is
    carried on from commits that moved, a round for each parent on the way, and raises past `bound` rounds.
    """
    up = settle(commits.select(F.col("id").alias("child"), F.explode("parents").alias("id")).join(commits.select("id"), "id", "left_semi"))
    place = F.struct(F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("steps"))
    at = moved = settle(commits.select("id", "pos", place.alias("at")))
    for i in range(bound + 1):
        if moved.isEmpty():
            # Places and steps below 10^12, so that the number keeps the order of the three.
            scale = lambda c, n: F.col(c).cast("decimal(38,0)") * F.expr(f"cast(1e{n} as decimal(25,0))")
            return at.select("id", (scale("at.pos", 24) + scale("at.steps", 12) + F.col("pos")).cast("decimal(38,0)").alias("place"))
        if i == bound:
            raise RuntimeError(f"commits have not settled after {bound} rounds")
        later = F.struct(F.col("at.pos").alias("pos"), (F.col("at.steps") + 1).alias("steps"))
        pushed = moved.select(F.col("id").alias("child"), later.alias("_at")).join(up, "child").groupBy("id").agg(F.max("_at").alias("_at"))
        moved = settle(at.join(pushed, "id").where("_at > at").select("id", "pos", F.col("_at").alias("at")))
        at = settle(at.join(moved.select("id"), "id", "left_anti").unionByName(moved))
    raise AssertionError


def _last_before(rows: DataFrame, path: str, events: DataFrame) -> DataFrame:
    """Rows with the last event (newer commits come first) of their path before their place: at, to; both null without one.

    Rows and events are sorted together once, so a path costs as much as it has of both.
    """
    row = F.struct(*[F.col(c) for c in rows.columns])
    both = rows.select(F.col(path).alias("_path"), "place", row.alias("_row"), F.lit(None).cast(f"struct<at:{rows.schema['place'].dataType.simpleString()},to:string>").alias("_event"))
    both = both.unionByName(events.select(F.col("path").alias("_path"), "place", F.lit(None).cast(rows.schema.simpleString()).alias("_row"), F.struct(F.col("place").alias("at"), "to").alias("_event")))
    w = Window.partitionBy("_path").orderBy("place", F.col("_event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_event", F.last("_event", ignorenulls=True).over(w)).where("_row is not null")
    return found.select("_row.*", "_event.at", "_event.to")


def identities(commits: DataFrame, changes: DataFrame, *, bound: int = 64) -> DataFrame:
    """What each changed path is called today: commit, path, now.

    From the newest commit backwards a rename carries the later name to the earlier path, and an addition or a rename
    ends what its path was called; of several that carry one path in a commit the greatest new path counts. So what
    a path is called at a commit is told by the last such event of that path in newer commits, and a rename points to
    the name of its new path at that place. These pointers are resolved by doubling: a chain of n renames takes log n
    rounds. Raises if it has not settled after bound rounds.
    """
    c = settle(changes.select("commit", "path", "kind", "renamed_from").join(placed(commits).withColumnRenamed("id", "commit"), "commit"))
    ends = c.where("kind in ('added', 'renamed')").select("path", "place", F.lit(None).cast("string").alias("to"))
    carries = c.where("renamed_from is not null").select(F.col("renamed_from").alias("path"), "place", F.col("path").alias("to"))
    events = settle(ends.unionByName(carries).groupBy("path", "place").agg(F.max("to").alias("to")))
    moves = events.where("to is not null").withColumnRenamed("to", "now")
    # A move's name: its new path, or what the event before it on that path made of that.
    known = stored(_last_before(moves, "now", events).select("path", "place", "now", F.when(F.col("to").isNotNull(), F.struct(F.col("now").alias("path"), F.col("at").alias("place"))).alias("next")))
    for _ in range(bound):
        if known.where("next is not null").isEmpty():
            break
        ahead = known.select(F.struct("path", "place").alias("next"), F.col("now").alias("_now"), F.col("next").alias("_next"))
        known = stored(known.join(ahead, "next", "left").select("path", "place", F.coalesce("_now", "now").alias("now"), F.col("_next").alias("next")))
    else:
        raise RuntimeError(f"renames have not settled after {bound} rounds")
    own = _last_before(c.select("commit", "path", "place"), "path", events)
    named = known.select(F.col("path").alias("_p"), F.col("place").alias("_at"), "now")
    out = own.join(named, (F.col("path") == F.col("_p")) & (F.col("at") == F.col("_at")) & F.col("to").isNotNull(), "left")
    return out.select("commit", "path", F.coalesce("now", "path").alias("now"))


def capped(changes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most so many changes of a commit, renames first, then by path; and how many were left out: commit, omitted."""
    w = Window.partitionBy("commit").orderBy(F.col("renamed_from").isNull(), "path")
    n = changes.withColumn("_n", F.row_number().over(w))
    return n.where(F.col("_n") <= most).drop("_n"), changes.groupBy("commit").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
