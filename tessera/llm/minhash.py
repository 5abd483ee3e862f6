"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, in bands, verified by weighted Jaccard.

1. Document frequencies of a hashed vocabulary give each five-word shingle its weight.
2. Improved consistent weighted sampling draws BANDS * ROWS samples of each document; documents that agree in all
   samples of a band are candidates. Documents of equal words are taken together before: one stands for all.
3. In each band's bucket every document is held against the first one; weighted Jaccard decides. Links found make
   components. In a bucket whose documents are then still in more than one component, the components are held against
   each other, until a link joins them or no pair is left that the distances to the first one allow. So no link
   between two documents of a bucket is lost to the components, without all pairs of a group of copies being compared.
   Large buckets are dealt out by pairs of parts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, flagged, fresh, map_batches, own_columns, possibly_in, small_batches, texts, written
from tessera.llm.shingles import document_frequencies, levels, mix, weighted

SIMILARITY, BANDS, ROWS = 0.8, 9, 3
#: Documents of a bucket in one part; a larger bucket is gone through by pairs of parts.
PART = 1000
#: Shingles sampled at a time, to stay in the processor's cache.
_CHUNK = 1 << 15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), their inverses, and logarithms of quantiles of it, finer for small ones."""

    def quantiles(p: np.ndarray) -> np.ndarray:
        x = np.maximum(np.sqrt(2 * p), 1e-9)
        low, high = np.zeros_like(p), np.full_like(p, 40.0)
        for _ in range(60):  # 1 - (1 + x) exp(-x) = p, by Newton's steps kept within bisection
            f = -np.expm1(-x) - x * np.exp(-x) - p
            low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
            step = x - f / np.maximum(x * np.exp(-x), 1e-300)
            x = np.where((step > low) & (step < high), step, (low + high) / 2)
        return x

    r = quantiles((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
    return r, (1 / r).astype(np.float32), np.log(quantiles((np.arange(1 << 20) + 0.5) / (1 << 20))).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """A row per text and a column per sample: equal where the texts drew the same shingle at the same level. Texts without shingles give 0."""
    r_of, inverse, log_c = _tables()
    out = np.zeros((len(bounds) - 1, count), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    lo = 0
    while lo < len(full):
        hi = lo + 1
        while hi < len(full) and bounds[full[hi] + 1] - bounds[full[lo]] <= _CHUNK:
            hi += 1
        a, b = bounds[full[lo]], bounds[full[hi - 1] + 1]
        own, log_w = hashes[a:b], np.log(weights[a:b])
        starts = bounds[full[lo:hi]] - a
        sizes = np.diff(np.append(starts, b - a))
        for k in range(count):
            z = mix((own + np.uint64((k + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15))
            at = (z & np.uint64(0xFFFF)).astype(np.int32)
            beta = ((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w * inverse[at] + beta)
            value = log_c[(z >> np.uint64(44)).astype(np.int32)] - r_of[at] * (t - beta + np.float32(1))
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == np.repeat(least, sizes))
            pick = hit[np.searchsorted(hit, starts)]
            out[full[lo:hi], k] = mix(own[pick] * np.uint64(0x9E3779B97F4A7C15) + t[pick].astype(np.int64).astype(np.uint64))
        lo = hi
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), key (of the words, in order) and bands of every document with a word."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # PLACES numbers

    def make():
        from tessera.llm.shingles import numbered_words

        def run(batch: pa.RecordBatch) -> dict:
            ids, ths, keys, bands = [], [], [], []
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                own = part.column("text")
                hashes, weight, bounds, sizes = weighted(own, shared.value)
                word, at, edges = numbered_words(own)
                with_words = np.flatnonzero(sizes)
                # Two polynomial sums over the words make a key of 128 bits.
                place = np.arange(len(at), dtype=np.uint64) - np.repeat(edges[:-1], sizes).astype(np.uint64)
                both = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    x = mix(word[at] * np.uint64(salt) + mix(place * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(salt)))
                    both.append(np.add.reduceat(x, edges[with_words]) if len(with_words) else x[:0])
                drawn = samples(hashes, weight, bounds, BANDS * ROWS).reshape(-1, BANDS, ROWS)
                band = np.zeros(drawn.shape[:2], np.uint64)
                for k in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + drawn[:, :, k] + np.uint64(k + 1))
                there = pa.array(with_words)
                ids += part.column("doc_id").take(there).to_pylist()
                ths += part.column("th").take(there).to_pylist()
                keys += [a.tobytes() + b.tobytes() for a, b in zip(*both, strict=True)]
                bands += list(band.view(np.int64)[with_words])
            return {"doc_id": ids, "th": ths, "key": keys, "bands": bands}

        return run

    return map_batches(texts(docs).withColumn("th", F.xxhash64("text")), make, "doc_id long, th long, key binary, bands array<long>")


def similarities(first: pa.Array, second: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of the texts' shingles, pair by pair: sum of the lesser weights over sum of the greater."""
    (ha, wa, ba, _), (hb, wb, bb, _) = weighted(first, idf), weighted(second, idf)
    out = np.zeros(len(first))
    for i in range(len(first)):
        a, b = slice(ba[i], ba[i + 1]), slice(bb[i], bb[i + 1])
        out[i] = _jaccard(ha[a], wa[a], hb[b], wb[b])
    return out


def _jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
    both = ha[at] == hb
    least = float(np.minimum(wa[at[both]], wb[both]).sum(dtype=np.float64))
    return least / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - least)


def _grouped(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, th and key of every document with words, and key, first (doc_id and th) of what is joined to the texts of that key.

    Texts are told apart by key, not by doc_id, so that rows with one doc_id and different texts keep all their links.
    """
    docs = texts(docs).where(F.col("doc_id").isNotNull())
    idf = levels(*document_frequencies(docs))
    signed = written(signatures(docs, idf), "signatures")
    alike = signed.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.min("bands").alias("bands"))
    # A number of each distinct text, which stays once the table is written.
    reps = written(alike.withColumn("rep", F.monotonically_increasing_id()), "copies")
    dealt = reps.select("rep", F.posexplode("bands").alias("band", "h"))
    buckets = written(dealt.groupBy("band", "h").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(dealt.join(buckets, ["band", "h"]), "members")
    pairs = members.where("rep <> head").select("rep", "head").distinct()
    wanted = written(reps.select("rep", "first.doc_id", "first.th").join(members.select("rep").distinct(), "rep", "left_semi"), "wanted")
    found = possibly_in(docs, wanted.select("doc_id")).withColumn("th", F.xxhash64("text"))
    bodies = written(found.join(wanted, ["doc_id", "th"]).groupBy("rep").agg(F.min("text").alias("text")), "bodies")
    measured = written(_measured(pairs, bodies, idf), "measured")
    links = measured.where(F.col("similarity") >= similarity)
    joined = components(links.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    more = written(_between(members, measured, joined, bodies, idf, similarity), "more")
    every = links.select(F.col("rep").alias("a"), F.col("head").alias("b")).unionByName(more)
    last = components(every) if not more.isEmpty() else joined
    of_rep = written(reps.select("key", "first", "rep").join(last, F.col("rep") == F.col("node"), "left").select("key", "first", "component"), "grouped")
    firsts = of_rep.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    return signed.select("doc_id", "th", "key"), of_rep.join(firsts, "component", "left").select("key", F.coalesce("least", "first").alias("first"))


def classes(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the least doc_id that is joined to the document by a chain of near copies.

    One row per input row. A null or wordless text is in no class but its own, and so is a row with a null doc_id
    (class_id null). Rows with one doc_id are one document: where their texts differ, the copies of each are of one
    class. Other columns play no part; an empty table gives an empty one. Words are runs of letters, digits and
    underscores in lower case; texts of equal words are copies.
    """
    signed, grouped = _grouped(docs, similarity)
    rows = written(signed.join(grouped, "key").select("doc_id", F.col("first.doc_id").alias("class")), "rows")
    named = rows.groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("other"))
    # Classes that meet in one doc_id are one.
    several = named.where("class < other").select("doc_id", F.col("class").alias("a"))
    met = components(rows.join(several, "doc_id").select("a", F.col("class").alias("b")).distinct())
    of = named.join(met, F.col("class") == F.col("node"), "left").select("doc_id", F.coalesce("component", "class").alias("class"))
    return texts(docs).select("doc_id").join(of, "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each group of near copies, with all their columns, whatever their names.

    The first is that of the least doc_id (and, among texts of one doc_id, hash). Texts that have no copy stay, also
    where another row has their doc_id; of rows equal in doc_id and text one stays. Rows with a null doc_id or without
    words stay. An empty table gives an empty one.
    """
    signed, grouped = _grouped(docs, SIMILARITY)
    told = signed.groupBy("doc_id", "th", "key").agg(F.count("*").alias("rows")).join(grouped, "key")
    told = told.select("doc_id", "th", "rows", ((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.th") != F.col("th"))).alias("goes")).where("goes or rows > 1")
    told = written(told, "told")
    th, own_id, own_th, goes, row = fresh(docs, "th", "own_id", "own_th", "goes", "row")
    rows, maybe = flagged(docs, told.select("doc_id"))
    named = told.select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), F.col("goes").alias(goes))
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(th)
    touched = rows.where(maybe).select(*own_columns(docs), text)
    touched = touched.join(named, (F.col("doc_id") == F.col(own_id)) & (F.col(th) == F.col(own_th)), "left").where(F.col(goes).isNull() | ~F.col(goes))
    untouched = rows.where(f"not {maybe}").select(*own_columns(docs)).unionByName(touched.where(F.col(goes).isNull()).select(*own_columns(docs)))
    again = touched.where(F.col(goes).isNotNull()).groupBy(own_id, own_th).agg(F.first(F.struct(*own_columns(docs))).alias(row))
    return untouched.unionByName(again.select(f"{row}.*"))


def _measured(pairs: DataFrame, bodies: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs (rep, head) with their similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)  # PLACES numbers

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            parts = [similarities(batch.column("a").slice(i, 500), batch.column("b").slice(i, 500), shared.value) for i in range(0, batch.num_rows, 500)]
            return {"rep": batch.column("rep"), "head": batch.column("head"), "similarity": np.concatenate(parts)}

        return run

    a, b = bodies.select("rep", F.col("text").alias("a")), bodies.select(F.col("rep").alias("head"), F.col("text").alias("b"))
    return map_batches(pairs.join(a, "rep").join(b, "head").select("rep", "head", "a", "b"), make, "rep long, head long, similarity double")


def _between(members: DataFrame, measured: DataFrame, joined: DataFrame, bodies: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) between documents of a bucket that the head doesn't join.

    One less the weighted Jaccard is a distance, so two documents whose distances to the head differ by more than
    1 - similarity can't be linked. Only the documents of a bucket are looked at that are outside its head's component,
    and those inside that are not ruled out so.
    """
    reach = 1 - similarity + 1e-6
    of = lambda name, as_: joined.select(F.col("node").alias(name), F.col("component").alias(as_))
    rows = members.where("rep <> head").join(measured, ["rep", "head"]).join(of("rep", "c0"), "rep", "left").join(of("head", "c1"), "head", "left")
    rows = written(rows.select("band", "h", "rep", (1 - F.col("similarity")).alias("d"), F.coalesce("c0", "rep").alias("c"), F.coalesce("c1", "head").alias("ch")), "inside")
    outside = rows.where("c <> ch").groupBy("band", "h").agg(F.min("d").alias("least"))
    rows = rows.join(outside, ["band", "h"]).where((F.col("c") != F.col("ch")) | (F.col("d") >= F.col("least") - reach))
    several = rows.groupBy("band", "h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "h", "n")
    return _apart(rows.join(several, ["band", "h"]).select("band", "h", "rep", "d", "n", "c"), bodies, idf, similarity)


def _apart(rows: DataFrame, bodies: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) between components within buckets: rows are band, h, rep, d (distance to the bucket's head), n and component c."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)  # PLACES numbers
    small_batches(rows.sparkSession)
    reach = 1 - similarity + 1e-6
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # Part i meets part j in block (i, j), i <= j; a bucket of one part is one block.
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    with_text = dealt.join(bodies, "rep").select("band", "h", "i", "j", "rep", "d", "c", "text")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["c", "rep"])
        sets = []
        for lo in range(0, len(part), 1000):
            h, w, b, _ = weighted(pa.array(part["text"].iloc[lo : lo + 1000]), shared.value)
            sets += [(h[x:y], w[x:y]) for x, y in zip(b[:-1], b[1:], strict=True)]
        reps, d, groups = part["rep"].tolist(), part["d"].tolist(), {}
        for k, c in enumerate(part["c"].tolist()):
            groups.setdefault(c, []).append(k)
        links, merged = [], []
        for own in groups.values():
            # Against each group so far; those that a link reaches become one with it.
            near = []
            for g, group in enumerate(merged):
                hit = next(((x, y) for y in own for x in group if abs(d[x] - d[y]) <= reach and _jaccard(*sets[x], *sets[y]) >= similarity), None)
                if hit:
                    links.append((reps[hit[0]], reps[hit[1]]))
                    near.append(g)
            merged = [group for g, group in enumerate(merged) if g not in near] + [sum((merged[g] for g in near), []) + own]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return with_text.groupBy("band", "h", "i", "j").applyInPandas(run, "a long, b long")
