"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at token boundaries, and put in another order.

Boundaries are found with integers as long as the text: bytes.translate makes a mask with a bit for each white space
byte, `spaces & ~(spaces << 1)` leaves the bits at which a token begins, bit_count() counts them, and the place of the
k-th is found by halving the integer again and again. White space is ASCII, so the bytes of UTF-8 serve as they are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Share of texts that are rearranged, and of those the share with the suffix first, in hundredths.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Space, and what lies between tab and carriage return, as digits of a binary number.
_SPACES = bytes(49 if b == 32 or 9 <= b <= 13 else 48 for b in range(256))
_LEADS = bytes(48 if 128 <= b < 192 else 49 for b in range(256))


def boundaries(data: bytes) -> int:
    """Bit i is set where a token begins at byte i: at the start, and at white space after anything else."""
    if not data:
        return 0
    spaces = int(data[::-1].translate(_SPACES), 2)
    return spaces & ~(spaces << 1) | 1


def place(bits: int, k: int) -> int:
    """Position of the k-th set bit, from 0: the half that holds it is kept until one bit is left."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        n = low.bit_count()
        if k < n:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - n, at + half
    return at


def code_points(data: bytes) -> int:
    return int(data.translate(_LEADS), 2).bit_count() if data else 0


def rearranged(data: bytes, number: str, seed: int, rate: int, spm: int) -> tuple[int, str, bytes, int | None, int | None]:
    """n, form, output, code points of prefix and of middle, of one text."""
    bits = boundaries(data)
    n = bits.bit_count()
    digits = hashlib.sha256(f"{seed}:{number}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not data or h3 % 100 >= rate or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return n, "plain", data, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (place(bits, k) if k < n else len(data) for k in (a, b))
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if h4 % 100 < spm:
        form, out = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, out, code_points(prefix), code_points(middle)


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars of every whole text.

    One row per input row, copies too; a repeated doc_id is cut at the same ranks. A null or empty text is plain, of
    no tokens; a text of white space alone is one token. A null doc_id counts as no digits. Other columns are not read.
    """

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            data = batch.column("text").to_pylist()
            numbers = batch.column("doc_id").to_pylist()
            rows = [rearranged(t, "" if i is None else str(i), seed, rate, spm) for t, i in zip(data, numbers, strict=True)]
            n, form, out, p, m = (list(x) for x in zip(*rows, strict=True))
            return {"doc_id": batch.column("doc_id"), "n": n, "form": form, "output": pa.array(out, pa.binary()), "prefix_chars": p, "middle_chars": m}

        return run

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    out = map_batches(rows, make, "doc_id long, n long, form string, output binary, prefix_chars long, middle_chars long")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text again. The markers are in no rearranged text and no two of them overlap, so each is found where it was put."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda mark: F.substring_index(output, mark, -1)
    middle = after(m)
    psm = F.concat(F.substring_index(F.substring_index(output, s, 1), p, -1), middle, F.substring_index(after(s), m, 1))
    spm = F.concat(F.substring_index(after(p), m, 1), middle, F.substring_index(F.substring_index(output, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(formed: DataFrame) -> DataFrame:
    """What fill_in_middle returns, with digests in place of the texts: of the output, and of what is read back from it."""
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


#: The same by lists of tokens.
ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), ranked AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM cut
), parts AS (
  SELECT doc_id, t, n, coalesce(array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], ''), '') AS p,
         coalesce(array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], ''), '') AS m,
         coalesce(array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], ''), '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
