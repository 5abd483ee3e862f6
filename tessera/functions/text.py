"""Times, remotes, messages and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339(seconds: Column) -> Column:
    """Seconds since the epoch as YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch(text: Column) -> Column:
    """Seconds of a strict UTC time; null for anything else."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(good, F.unix_timestamp(F.try_to_timestamp(F.when(good, text), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))


def day(text: Column) -> Column:
    return F.substring(text, 1, 10)


def minute(seconds: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def duration(text: Column) -> Column:
    """Seconds of 90s, 30m, 24h or 7d; null for anything else."""
    n = F.regexp_extract(text, r"^(\d{1,12})[smhd]$", 1)
    unit = F.substring(text, -1, 1)
    return F.when(n != "", n.cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400))


def short_id(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"(?<=://)[^/@\s]+@", "")


def remote(url: Column) -> Column:
    """Host, owner and name of an https, ssh or scp-like remote; null where it is none of these."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]+@)?([^/:]+)(?::\d+)?/|(?:[^/@\s]+@)?([^/:\s]+):)/?([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"
    part = lambda i: F.regexp_extract(url, pattern, i)
    return F.when(url.rlike(pattern), F.struct(F.lower(F.concat(part(1), part(2))).alias("host"), part(3).alias("owner"), part(4).alias("name")))


def is_ssh(url: Column) -> Column:
    return url.rlike(r"^(ssh://|git\+ssh://|[^/\s:]+@[^/\s:]+:)")


#: A word of 32 or more letters and digits that has both.
LONG_TOKEN = r"\b(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}\b"


def masked_tokens(text: Column) -> Column:
    return F.regexp_replace(text, LONG_TOKEN, "***")


def masked_paths(text: Column) -> Column:
    """Absolute paths: Unix, Windows, file URLs."""
    return F.regexp_replace(text, r"file://\S+|(?<![A-Za-z0-9_:/.<])/(?:[^\s/'\"]+/)+[^\s'\"]*|\b[A-Za-z]:\\[^\s'\"]+", "<path>")


def redacted(text: Column) -> Column:
    return masked_paths(masked_tokens(without_credentials(text)))


def failure(message: Column) -> Column:
    """The class of a failed request, by what its message says; the first that fits."""
    m = F.lower(message)
    return (
        F.when(m.contains("secondary rate limit") | m.contains("abuse detection"), "secondary")
        .when(m.contains("rate limit"), "rate_limit")
        .when(m.rlike(r"bad credentials|authentication|not logged in|http 401"), "auth")
        .when(m.rlike(r"timed? ?out|could not resolve|connection|network|http 5\d\d"), "network")
        .otherwise("other")
    )


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def taken_label(names: Column, most: int) -> Column:
    """The first names, whatever their case, and how many more there are."""
    ordered = F.array_sort(names, lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    more = F.size(names) - most
    return F.concat(F.array_join(F.slice(ordered, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


def location(file: Column, line: Column, target: Column) -> Column:
    return F.concat(file, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" -> "), target), F.lit("")))


def shell_quoted(text: Column) -> Column:
    return F.when(text.rlike(r"^[A-Za-z0-9_./:=@%+,-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def link_order(kind: Column) -> Column:
    return F.when(kind == "closes", 0).when(kind == "closed_by", 1).when(kind == "linked", 2).otherwise(3)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based character offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def is_env_name(name: Column) -> Column:
    return name.rlike(r"^[A-Z_][A-Z0-9_]*$")


def via_place(note: Column) -> Column:
    """File and line of a note `<word> via <file>:<line>`; null for other notes."""
    pattern = r"^\S+ via (.+):(\d+)$"
    return F.when(note.rlike(pattern), F.struct(F.regexp_extract(note, pattern, 1).alias("file"), F.regexp_extract(note, pattern, 2).cast("int").alias("line")))


def import_of_note(note: Column) -> Column:
    """Second word of a note that has no via place."""
    word = F.regexp_replace(F.regexp_extract(note, r"^\S+ (\S+)", 1), r"[,:]$", "")
    return F.when(~note.rlike(r"^\S+ via .+:\d+$") & (word != ""), word)


def collapsed(signature: Column, most: int = 200) -> Column:
    """A signature on one line, brackets tidied, cut at a length."""
    s = F.trim(F.regexp_replace(signature, r"\s+", " "))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"([(\[{]) ", "$1"), r",? ([)\]}])", "$1"), r",([)\]}])", "$1")
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def state_label(state: Column, closed_at: Column) -> Column:
    return F.concat(state, F.coalesce(F.concat(F.lit(" "), day(closed_at)), F.lit("")))


def http_answer(out: Column) -> Column:
    """Headers (a map, names in lower case) and body of a printed answer; all of it is body where no status line begins it.

    Without a blank line there is no body. Of a header given more than once the first value counts.
    """
    plain = F.replace(out, F.lit("\r\n"), F.lit("\n"))
    cut = F.instr(plain, "\n\n")
    head = F.when(cut > 0, F.substring(plain, F.lit(1), cut - 1)).otherwise(F.lit(""))
    pairs = F.transform(F.filter(F.slice(F.split(head, "\n"), 2, 1 << 20), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    headers = F.map_from_arrays(names, F.transform(names, lambda n: F.filter(pairs, lambda p: p["name"] == n)[0]["value"]))
    status, none = F.startswith(out, F.lit("HTTP/")), F.create_map().cast("map<string,string>")
    cut_raw = F.least(*[F.when(F.instr(out, s) > 0, F.instr(out, s) + len(s)) for s in ("\r\n\r\n", "\n\n")])
    body = F.coalesce(F.substring(out, cut_raw, F.length(out)), F.lit(""))
    return F.struct(F.when(status, headers).otherwise(none).alias("headers"), F.when(status, body).otherwise(out).alias("body"))


def error_codes(body: Column) -> Column:
    """Sorted distinct codes of the errors that a JSON answer names: each one's type, else the code of its extensions, where it is an identifier of up to 40 characters."""
    answer = F.from_json(body, "struct<errors:array<struct<type:string,extensions:struct<code:string>>>>")
    codes = F.transform(answer["errors"], lambda e: F.coalesce(e["type"], e["extensions"]["code"]))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.rlike("^[A-Za-z0-9_]{1,40}$")))), F.array().cast("array<string>"))


def rate_hints(headers: Column) -> Column:
    """What the headers say of the rate limit: retry_after, remaining, reset, each null if absent or no whole number."""
    number = lambda name: F.try_element_at(headers, F.lit(name)).try_cast("bigint")
    return F.struct(number("retry-after").alias("retry_after"), number("x-ratelimit-remaining").alias("remaining"), number("x-ratelimit-reset").alias("reset"))


def content_hash(text: Column) -> Column:
    """A hash that tells whether a text has changed since it was read."""
    return F.xxhash64(text)


#: The fields and events that a tracker's nodes give relations in, by the end that was read.
RECORDED_FROM = ("Issue.subIssues", "Issue.blockedBy", "Issue.duplicateOf", "ClosedEvent.closer")
RECORDED_TO = ("Issue.parent", "Issue.blocking", "CrossReferencedEvent", "ReferencedEvent")
RECORDED_FROM_PREFIX, RECORDED_TO_PREFIX = "PullRequest.closingIssuesReferences", "Issue.closedByPullRequestsReferences"


def recorded_by(observed: Column) -> Column:
    """The end (from, to) whose reading made an observation; null for a field that no reading has."""
    by_from = observed.isin(*RECORDED_FROM) | F.startswith(observed, F.lit(RECORDED_FROM_PREFIX))
    by_to = observed.isin(*RECORDED_TO) | F.startswith(observed, F.lit(RECORDED_TO_PREFIX))
    return F.when(by_from, "from").when(by_to, "to")


def seen_from(relation: Column) -> Column:
    """Which ends record a type of relation: both, from or to."""
    return F.when(relation.isin("sub_issue", "blocked_by", "closes", "linked"), "both").when(relation.isin("closed_by", "duplicate_of"), "from").when(relation.isin("cross_referenced", "referenced"), "to")


def range_label(s: Column) -> Column:
    """What a snapshot holds, in a sentence.

    s: struct of source, repository, issues, pull_requests, updated_since, effective_since, bound, reached_bound,
    fetched_at (seconds) and whole_at (seconds; null if no update came after the whole fetch).
    """
    counts = F.concat(s["source"], F.lit(" "), s["repository"], F.lit(", "), plural(s["issues"], "issue"), F.lit(" and "), plural(s["pull_requests"], "pull request"))
    since = F.coalesce(F.concat(F.lit(" updated since "), day(s["updated_since"])), F.lit(", every one"))
    bound = F.when(s["reached_bound"] & s["effective_since"].isNotNull(), F.concat(F.lit(" (bound of "), s["bound"].cast("string"), F.lit(" reached: updated since "), day(s["effective_since"]), F.lit(")"))).otherwise("")
    read = F.coalesce(F.concat(F.lit(", fetched whole "), minute(s["whole_at"]), F.lit(", updated "), minute(s["fetched_at"])), F.concat(F.lit(", fetched "), minute(s["fetched_at"])))
    return F.concat(counts, since, bound, read, F.lit(", as visible to the account that fetched"))


def reached_name(symbol: Column) -> Column:
    """The name by which a member is imported: its type's, without generics and module path; any other symbol's own."""
    owner = F.regexp_extract(symbol, r"^(.*)::", 1)
    owner = F.when(F.contains(symbol, F.lit("::")), owner).otherwise(F.regexp_extract(symbol, r"^(.*)\.", 1))
    bare = F.trim(F.substring_index(F.substring_index(owner, "<", 1), "::", -1))
    return F.when(F.contains(symbol, F.lit("::")) | F.contains(symbol, F.lit(".")), bare).otherwise(symbol)


def exported_names(exported_as: Column, name: Column) -> Column:
    """The names under which a statement exports a name that it takes: the renamed ones, else its own. exported_as: array of (taken, exported)."""
    renamed = F.filter(exported_as, lambda e: e["taken"] == name)
    return F.when(F.coalesce(F.size(renamed), F.lit(0)) > 0, F.flatten(F.transform(renamed, lambda e: e["exported"]))).otherwise(F.array(name))
