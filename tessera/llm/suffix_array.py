"""Exact substring de-duplication: every byte of a LENGTH-byte string that occurs elsewhere, by suffix arrays of parts.

A suffix array of all texts would not fit a machine, so suffixes are dealt out first. Of the GRAM-byte strings in each
LENGTH-byte window the one of least hash is an anchor: equal windows have equal anchors at equal places, so two
occurrences of a repeated window meet at their anchor. Around an anchor at p, all windows that hold its string lie in
the snippet from p - REACH to p + LENGTH. Anchors whose string occurs once are dropped. Equal snippets are repeats from
end to end. Of the others, the group of one anchor string is an enhanced suffix array of its own: the snippets' right
parts in order, with common prefixes. A stack scan makes the common-prefix intervals, each a group of all occurrences
of one right extension; within an interval, the occurrences in order of their left parts tell how far each can be
extended to the left with some other one. An interval whose left extensions differ is a maximal repeat. Where left and
right extension together make LENGTH bytes or more, the occurrence is covered that far.

Before bytes are gathered, snippets that can't have a partner go: two that share LENGTH bytes around the anchor also
share, for some multiple t of GRID, the bytes from t before it on that make LENGTH - GRID in all; a snippet that shares
none of these with another is dropped. Groups of more than GROUP different snippets even so are not gathered: there,
the windows themselves are counted by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flagged, possibly_in, small_batches, written

LENGTH, GRAM = 200, 40
REACH = LENGTH - GRAM
GROUP, GRID = 50_000, 20
_STEP = 1 << 20
NONE = -(2**63)

_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * _MIX
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of a byte string, from prefix sums of byte values times powers, modulo 2^64."""

    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(Hashes._powers[0]) < n:
            Hashes._powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (_BASE, _BACK))
        self.back = Hashes._powers[1][:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * Hashes._powers[0][: n - 1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _sliding(x: np.ndarray, width: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over each window of x, from every start, with windows cut off at the end (block-wise running extremes)."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width + width, fill, x.dtype)]).reshape(-1, width)
    front = f.accumulate(blocks, axis=1).reshape(-1)
    rear = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(rear[:n], front[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of concatenated texts: text, place in it, hash of the anchor, hash of the snippet, bytes before and after the place."""
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty, empty
    hashes = Hashes(data)
    starts = np.arange(len(data) - GRAM + 1)
    h = hashes.of(starts, starts + GRAM)
    ends = edges[1:]
    over = np.unique(np.concatenate([np.arange(max(0, e - GRAM + 1), min(e, len(h))) for e in ends.tolist()]))  # strings over the edge of two texts
    h[over.astype(np.int64)] = np.iinfo(np.uint64).max
    least = _sliding(h, REACH + 1, np.minimum, np.iinfo(np.uint64).max)
    # A place is an anchor if it is the least of a window that holds it: the greatest of those windows' least. Windows
    # over the edge of two texts don't count.
    sizes = np.diff(edges)
    least[np.repeat(ends, sizes)[: len(least)] - np.arange(len(least)) < LENGTH] = 0
    greatest = _sliding(least[::-1], REACH + 1, np.maximum, 0)[::-1]
    at = np.flatnonzero((h == greatest) & (h != np.iinfo(np.uint64).max))
    text = np.searchsorted(edges, at, side="right") - 1
    first, last = edges[text], edges[text + 1]
    long = last - first >= LENGTH
    at, text, first, last = at[long], text[long], first[long], last[long]
    b, e = np.maximum(first, at - REACH), np.minimum(last, at + LENGTH)
    snippet = _mix(hashes.of(b, e) + ((at - b) * 1024 + (e - at)).astype(np.uint64))
    return text, at - first, h[at].view(np.int64), snippet.view(np.int64), at - b, e - at


def extensions(lefts: list[bytes], rights: list[bytes], groups: list | None = None) -> tuple[list[int], list[int]]:
    """How far each occurrence is covered to the left and right of its anchor: 0 where nothing reaches LENGTH.

    lefts are reversed. Different snippets of one anchor; groups, if given, gets the maximal repeats of LENGTH bytes or
    more: bytes to the left, bytes to the right, the occurrences.
    """
    n = len(rights)
    cover_l, cover_r = [0] * n, [0] * n

    def common(a: bytes, b: bytes) -> int:
        m = min(len(a), len(b))
        x = int.from_bytes(a[:m]) ^ int.from_bytes(b[:m])
        return m - (x.bit_length() + 7) // 8

    order = sorted(range(n), key=rights.__getitem__)
    prefix = [common(rights[order[i - 1]], rights[order[i]]) for i in range(1, n)]
    by_left = sorted(range(n), key=lefts.__getitem__)

    def interval(depth: int, lo: int, hi: int) -> None:
        inside = order[lo : hi + 1]
        if hi - lo + 1 < n:
            inside = sorted(inside, key=lefts.__getitem__)
        else:
            inside = by_left
        shared = [common(lefts[inside[i - 1]], lefts[inside[i]]) for i in range(1, len(inside))]
        far = [max(a, b) for a, b in zip([0, *shared], [*shared, 0], strict=True)]
        if groups is not None and min(shared) < max(shared + [REACH]):
            # Left extensions differ: runs of common left parts long enough, each a maximal repeat with all its occurrences.
            run = [inside[0]]
            for x, s in zip(inside[1:] + [None], [*shared, -1], strict=True):
                if s + depth < LENGTH:
                    if len(run) > 1:
                        groups.append((min(common(lefts[run[0]], lefts[y]) for y in run[1:]), depth, run))
                    run = []
                run.append(x)
        for x, s in zip(inside, far, strict=True):
            if s + depth >= LENGTH:
                cover_l[x] = max(cover_l[x], s)
                cover_r[x] = max(cover_r[x], depth)

    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*prefix, -1]):
        lo = i
        while stack and stack[-1][0] > depth:
            deep, lo = stack.pop()
            if deep + REACH >= LENGTH:
                interval(deep, lo, i)
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, lo))
    return cover_l, cover_r


_KEY = "d long, th long"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the key d, th of a row: rows of one key are equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(NONE)).alias("d"), F.xxhash64("text").alias("th"), "text")


def _anchors(keyed: DataFrame) -> DataFrame:
    small_batches(keyed.sparkSession)
    names = ["h", "s", "d", "th", "pos", "l", "r"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
            lo = 0
            while lo < len(sizes):
                hi, total = lo, 0
                while hi < len(sizes) and (hi == lo or total + sizes[hi] <= _STEP):
                    total += sizes[hi]
                    hi += 1
                edges = np.append(0, np.cumsum(sizes[lo:hi]))
                text, pos, h, s, left, right = anchors_of(np.frombuffer(b"".join(texts.slice(lo, hi - lo).to_pylist()), np.uint8), edges)
                if len(text):
                    at = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), batch.column("d").take(at), batch.column("th").take(at), pa.array(pos.astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], names)
                lo = hi

    return keyed.select("d", "th", "text").mapInArrow(run, f"h long, s long, {_KEY}, pos int, l short, r short")


def _snippets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of snippets: wanted has h, s, n, d, th, pos, l, r; the result h, s, n, d, th, pos, left (reversed), right."""
    asked = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("h", "s", "n", "pos", "l", "r")).alias("asked"))  # bounded by the text's length
    rows = possibly_in(keyed.select("d", "th", "text"), asked.select("d"), column="d")
    names = ["h", "s", "n", "d", "th", "pos", "left", "right", "keys"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))

    def run(batches):
        for batch in batches:
            out: dict = {x: [] for x in names}
            for d, th, text, asked in zip(*(batch.column(x).to_pylist() for x in ("d", "th")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist(), strict=True):
                for x in asked:
                    p, l, r = x["pos"], x["l"], x["r"]  # noqa: E741
                    out["left"].append(text[p - l : p][::-1])
                    out["right"].append(text[p : p + r])
                    out["keys"].append([xxhash.xxh64_intdigest(text[p - t : p + LENGTH - GRID - t], t) - (1 << 63) for t in range(0, REACH + 1, GRID) if t <= l and LENGTH - GRID - t <= r])
                    out["pos"].append(p)
                    out["d"].append(d)
                    out["th"].append(th)
                    for k in ("h", "s", "n"):
                        out[k].append(x[k])
            yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(names, types, strict=True)], names)

    # Of rows equal in text, a snippet found in one of them occurs in the other too, so n counts both.
    return rows.join(asked, ["d", "th"]).mapInArrow(run, f"h long, s long, n long, {_KEY}, pos int, left binary, right binary, keys array<long>")


def _from_groups(snippets: DataFrame) -> DataFrame:
    """Covered spans (d, th, a, b) of the snippets that occur once, by group of one anchor string."""
    names = ["d", "th", "a", "b"]

    def spans(group: list[dict], out: dict) -> None:
        if len(group) < 2:
            return
        lefts, rights = extensions([x["left"] for x in group], [x["right"] for x in group])
        for x, l, r in zip(group, lefts, rights, strict=True):  # noqa: E741
            if l + r >= LENGTH and x["n"] == 1:
                for k, v in zip(names, (x["d"], x["th"], x["pos"] - l, x["pos"] + r), strict=True):
                    out[k].append(v)

    def run(batches):
        group: list[dict] = []
        for batch in batches:
            out: dict = {x: [] for x in names}
            for row in batch.to_pylist():
                if group and group[-1]["h"] != row["h"]:
                    spans(group, out)
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(out[x], pa.int64()) for x in names], names)
        out = {x: [] for x in names}
        spans(group, out)
        yield pa.RecordBatch.from_arrays([pa.array(out[x], pa.int64()) for x in names], names)

    return snippets.repartition("h").sortWithinPartitions("h", "s").mapInArrow(run, f"{_KEY}, a long, b long")


def _from_windows(snippets: DataFrame) -> DataFrame:
    """The same for groups of very many snippets: each window of LENGTH bytes is counted by its hash and place."""
    names = ["w", "n", "d", "th", "a"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                text = row["left"][::-1] + row["right"]
                first = row["pos"] - len(row["left"])
                for k in range(len(text) - LENGTH + 1):
                    key = hashlib.blake2b(text[k : k + LENGTH], digest_size=16, key=(len(row["left"]) - k).to_bytes(2)).digest()
                    for x, v in zip(out, (key, row["n"], row["d"], row["th"], first + k), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    windows = written(snippets.mapInArrow(run, f"w binary, n long, {_KEY}, a long"), "windows")
    often = windows.groupBy("w").agg(F.count("*").alias("k")).where("k > 1")
    return windows.join(often, "w", "left_semi").where("n = 1").select("d", "th", "a", (F.col("a") + LENGTH).alias("b"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their keys, and the covered byte spans (d, th, a, b) of each key, overlapping ones too."""
    keyed = _keyed(docs)
    anchors = written(_anchors(keyed), "anchors")
    often = written(anchors.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "often")
    shared = written(possibly_in(anchors, often, column="h").join(often, "h", "left_semi"), "shared")
    counted = written(shared.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("d", "th", "pos", "l", "r")).alias("x")).select("h", "s", "n", "x.*"), "counted")
    whole = counted.where((F.col("n") > 1) & (F.col("l") + F.col("r") >= LENGTH)).select("h", "s")
    full = shared.join(whole, ["h", "s"], "left_semi").select("d", "th", (F.col("pos") - F.col("l")).cast("long").alias("a"), (F.col("pos") + F.col("r")).cast("long").alias("b"))
    groups = counted.where(F.col("l") + F.col("r") >= LENGTH).groupBy("h").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1")
    wanted = counted.where(F.col("l") + F.col("r") >= LENGTH).join(groups, "h").drop("least")
    snippets = written(_snippets(keyed, wanted.drop("size")), "snippets")
    keys = snippets.select("h", "s", F.explode("keys").alias("key"))
    met = written(keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "met")
    alive = written(possibly_in(keys, met, column="key").join(met, "key", "left_semi").select("h", "s").distinct(), "alive")
    sizes = alive.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    snippets = written(snippets.drop("keys").join(alive, ["h", "s"], "left_semi").join(sizes, "h"), "alike")
    out = full.unionByName(_from_groups(snippets.where(F.col("size") <= GROUP).drop("size")))
    if not (large := snippets.where(F.col("size") > GROUP)).isEmpty():
        out = out.unionByName(_from_windows(large.drop("size")))
    return keyed, out


def remove_repeats(docs: DataFrame, *, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text (as UTF-8), with keep_text also kept (binary).

    A byte goes if it lies in a LENGTH-byte string that starts anywhere else too, in the same text or another, in the
    input as it is. One row per input row; a null text is empty; repeated rows are copies of each other, so all that is
    LENGTH bytes or longer goes from both; other columns play no part; an empty table gives an empty one.
    """
    keyed, spans = repeated_spans(docs)
    spans = written(spans.groupBy("d", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")  # bounded by the text's length
    rows, maybe = flagged(keyed, spans.select("d"), column="d")
    clean = rows.where(f"not {maybe}").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_text else []))
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts, at, runs, end = [], 0, 0, -1
                for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                    if a > end:
                        runs += 1
                    if a > at:
                        parts.append(text[at:a])
                    at, end = max(at, b), max(end, b)
                kept = b"".join([*parts, text[at:]])
                for x, v in zip(out, (doc_id, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False)], names)

    touched = rows.where(maybe).join(spans, ["d", "th"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    return clean.unionByName(touched)
