"""Conversations as training windows of a bounded number of tokens, in DataFrame functions alone.

The budget has three shares: for the system turn, for history, and the room for what is new. Prefix sums of the turns'
token counts place every turn in its conversation and choose turn-aligned spans: a span takes the turns that start
within one block of half the room, and none is longer than that, so a span never exceeds the room. A turn of more than
half the room is cut into pieces of as many characters as that half holds, which are placed like turns. Each window
holds the system turn (if the conversation opens with one; what is beyond its share is not repeated), as much of the
turns right before the span as `history` tokens allow, and the span: never more than the budget. Only assistant texts
of the span are under the loss mask; what is repeated is not.

Template of a turn: `<|im_start|>role\ntext<|im_end|>\n`; a piece that goes on with a turn starts with `<|im_again|>`, and
one that the turn goes on after ends with `<|im_cut|>`. Inside roles and texts a control string can't occur: each
`<`, backslashes, `|` gets one more backslash after the `<`, which undoing takes away again; a line feed in a role is
written `<|nl|>`.

Prefix sums are made in two steps, within stretches of STRETCH turn numbers and over the stretches' totals, so that
no task has to hold the texts of one long conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, SYSTEM, STRETCH = 1024, 192, 128, 32
#: The stretch of turns without a number: before all others.
NULLS = -(2**62)
START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: The same for pieces: one that is not its turn's first, and one that is not its last.
NEXT, MORE = "<|im_again|>", "<|im_cut|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def estimated_tokens(text: Column) -> Column:
    """Four for the turn's marks and one for each four characters begun."""
    return (F.lit(4) + F.ceil(F.char_length(text) / 4)).cast("long")


def characters_of(tokens: int) -> int:
    """Characters that a text of so many estimated tokens may have."""
    return 4 * (tokens - 4)


def format_conversations(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, tokens=estimated_tokens, characters=characters_of) -> DataFrame:
    """Windows: conv_id, window (place of its first new piece), n_repeated, n_new, text, mask (array of code point spans), n_tokens.

    turns has conv_id, turn, role and text; other columns play no part. Turns are ordered by turn, null first, then
    role and text; repeated rows are repeated turns. Null roles and texts are empty, a null conv_id is a conversation
    of its own. Every turn, or each piece of a long one, is new in exactly one window. An empty table gives no window.

    tokens: from a text column to its token count, at least 1. characters: how many characters surely fit in so many
    tokens; long turns are cut there. A job whose pieces have more tokens than that fails. history and system are parts
    of budget; n_tokens is never more than budget.
    """
    half = (budget - history - system) // 2
    cut, opening_cut = characters(half) if half > 0 else 0, characters(system)
    if history < 1 or cut < 1 or opening_cut < 1:
        raise ValueError("history, system and what they leave of the budget must have room for a turn")
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = F.when(tokens(F.col("text")) > half, F.greatest(F.lit(1), F.ceil(F.char_length("text") / cut))).otherwise(1).cast("long")
    t = t.withColumns({"k": parts, "stretch": F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(NULLS))})
    # All pieces but the last count as half the room.
    last = F.when(F.col("k") == 1, F.col("text")).otherwise(F.substring("text", ((F.col("k") - 1) * cut + 1).cast("int"), F.lit(cut)))
    t = t.withColumn("n", (F.col("k") - 1) * half + tokens(last))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda w, **c: {k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in c.items()}
    totals = t.groupBy("conv_id", "stretch").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), *[x.alias(k) for k, x in sums(before, n0="n", k0="k").items()])
    placed = t.withColumns(sums(within, n1="n", k1="k"))
    placed = placed.join(totals, placed.conv_id.eqNullSafe(totals.c) & (placed.stretch == totals.s))
    pieces = F.when(F.col("k") == 1, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{cut}}}"), F.lit(0)))
    placed = placed.select("conv_id", "role", "k", (F.col("k0") + F.col("k1") - F.col("k")).alias("pos0"), (F.col("n0") + F.col("n1") - F.col("n")).alias("at0"), F.posexplode(pieces).alias("i", "text"))
    placed = placed.withColumn("n", F.when(tokens(F.col("text")) > half, F.raise_error(F.lit("a piece has more tokens than half the room"))).otherwise(tokens(F.col("text"))))
    placed = placed.select("conv_id", "role", "text", "n", (F.col("pos0") + F.col("i")).alias("pos"), (F.col("at0") + F.col("i") * half).alias("at"), (F.col("i") > 0).alias("next"), (F.col("i") < F.col("k") - 1).alias("more"))
    placed = placed.withColumn("block", F.floor(F.col("at") / half))
    key, told = ["conv_id", "block"], ["pos", "role", "text", "n", "next", "more"]
    later = placed.groupBy(*key).agg(F.min("pos").alias("first"), F.min("at").alias("from")).where("first > 0")
    opens = (F.col("pos") == 0) & (F.col("role") == "system")
    short = F.substring("text", 1, opening_cut)
    whole = tokens(F.col("text")) <= system
    opened = placed.where(opens).select(F.col("conv_id").alias("c"), "pos", "role", F.when(whole, F.col("text")).otherwise(short).alias("text"), F.when(whole, F.col("n")).otherwise(tokens(short)).alias("n"), "next", (F.col("more") | ~whole).alias("more"))
    opening = later.join(opened, later.conv_id.eqNullSafe(opened.c)).select(*key, *told, F.lit(False).alias("new"))
    reach = later.select(*[F.col(k).alias(f"w_{k}") for k in key], "first", "from", F.explode(F.array_distinct(F.array(F.floor((F.col("from") - history) / history), F.floor((F.col("from") - 1) / history)))).alias("stripe"))
    past = placed.where(~opens).select("conv_id", *told, "at", F.floor(F.col("at") / history).alias("own_stripe"))
    repeated = reach.join(past, reach.w_conv_id.eqNullSafe(past.conv_id) & (reach.stripe == past.own_stripe) & (past.pos < reach["first"]) & (past["at"] >= reach["from"] - history))
    repeated = repeated.select(*[F.col(f"w_{k}").alias(k) for k in key], *told, F.lit(False).alias("new"))
    rows = placed.select(*key, *told, F.lit(True).alias("new")).unionByName(opening).unionByName(repeated)
    head = F.concat(F.when(F.col("next"), NEXT).otherwise(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    tail = F.when(F.col("more"), MORE).otherwise(END)
    pieces = rows.select(*key, "n", F.struct("pos", head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"), "new", (F.col("new") & (F.col("role") == "assistant")).alias("loss")).alias("p"))
    windows = pieces.groupBy(*key).agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list("p")).alias("p"))  # bounded by the budget
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(so_far: Column, p: Column) -> Column:
        begin = so_far["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        mask = F.when(p["loss"], F.concat(so_far["mask"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(so_far["mask"])
        return F.struct((end + F.char_length(p["tail"])).alias("at"), mask.alias("mask"))

    return windows.select(
        "conv_id",
        F.filter("p", lambda p: p["new"])[0]["pos"].alias("window"),
        F.size(F.filter("p", lambda p: ~p["new"])).alias("n_repeated"),
        F.size(F.filter("p", lambda p: p["new"])).alias("n_new"),
        F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("text"),
        F.aggregate("p", start, step, lambda x: x["mask"]).alias("mask"),
        "n_tokens",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What windows say, read back from their text and mask: conv_id, window, turns (role, \\n, text, \\n of what is new), n_turns (that end here), loss (assistant texts), formatted_chars."""
    pieces = F.filter(F.split("text", r"(?<=<\|im_(?:end|cut)\|>\n)"), lambda x: x != "")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces))

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, len(START) + 1, F.char_length(piece)), "\n", 1)
        begin = F.lit(len(START) + 2) + F.char_length(role)
        last = F.endswith(piece, F.lit(END))
        tail = F.when(last, len(END)).otherwise(len(MORE))
        text = unescape(F.substring(piece, begin, F.char_length(piece) - begin + 1 - tail))
        opens = F.when(F.startswith(piece, F.lit(START)), F.concat(unescape(F.replace(role, F.lit(LINE), F.lit("\n"))), F.lit("\n"))).otherwise("")
        return F.concat(opens, text, F.when(last, "\n").otherwise(""))

    loss = F.transform("mask", lambda m: unescape(F.substring("text", m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int"))))
    ended = F.size(F.filter(new, lambda x: F.endswith(x, F.lit(END))))
    return windows.select("conv_id", "window", ended.alias("n_turns"), F.array_join(F.transform(new, turn), "").alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("text").alias("formatted_chars"))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A hash of a conversation needs its text in one place; here it comes there by windows, put in order.
    """
    parts = read_windows(windows).groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum(F.char_length("loss")).alias("loss_chars"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("p"))
    whole = lambda k: F.sha2(F.array_join(F.transform("p", lambda x: x[k]), ""), 256)
    return parts.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), whole("turns").alias("turns_sha256"), F.col("loss_chars").cast("long").alias("loss_chars"), whole("loss").alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


_HALF = (BUDGET - HISTORY - SYSTEM) // 2
#: What op8's query returns, for DuckDB, from the turns themselves: windows as above, lengths without making texts.
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), n AS (
  SELECT *, greatest(1, CAST(ceil(length(text) / {characters_of(_HALF)}.0) AS BIGINT)) AS k,
    length({{start}} || replace(regexp_replace(role, {{marks}}, {{more}}, 'g'), chr(10), '{LINE}') || chr(10)) + {len(END)} AS frame,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq
  FROM t
), cut AS (
  SELECT *, substring(text, i * {characters_of(_HALF)} + 1, {characters_of(_HALF)}) AS piece
  FROM (SELECT *, unnest(generate_series(0, k - 1)) AS i FROM n)
), p AS (
  SELECT *, row_number() OVER w - 1 AS pos, CAST(sum(4 + CAST(ceil(length(piece) / 4.0) AS BIGINT)) OVER w AS BIGINT) - 4 - CAST(ceil(length(piece) / 4.0) AS BIGINT) AS begun,
    frame + length(regexp_replace(piece, {{marks}}, {{more}}, 'g')) AS chars,
    frame + length(regexp_replace(substring(piece, 1, {characters_of(SYSTEM)}), {{marks}}, {{more}}, 'g')) AS again_chars
  FROM cut WINDOW w AS (PARTITION BY conv_id ORDER BY seq, i)
), later AS (
  SELECT conv_id, begun // {_HALF} AS block, min(pos) AS first, min(begun) AS begins FROM p GROUP BY ALL HAVING min(pos) > 0
), again AS (
  SELECT l.conv_id, sum(CASE WHEN p.pos = 0 AND p.role = 'system' THEN again_chars ELSE chars END) AS chars FROM later l JOIN p ON p.conv_id = l.conv_id
    AND (p.pos = 0 AND p.role = 'system' OR p.pos < l.first AND p.begun >= l.begins - {HISTORY})
  GROUP BY 1
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM n GROUP BY 1
), new AS (SELECT conv_id, sum(chars) AS chars FROM p GROUP BY 1)
SELECT w.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(new.chars + coalesce(a.chars, 0) AS BIGINT) AS formatted_chars
FROM whole w JOIN new USING (conv_id) LEFT JOIN again a ON a.conv_id = w.conv_id
""".format(start=f"'{START}'", marks=r"'<(\\*)\|'", more=r"'<\\\1|'")
