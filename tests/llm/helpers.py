"""Fixtures' shapes that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

#: Nulls, empty texts, repeated rows, ties, odd characters, a long text.
ODD = [
    (None, "a null id with some words in it"),
    (1, None),
    (2, ""),
    (3, "   \n\t\n"),
    (4, "one two three four five six"),
    (4, "one two three four five six"),
    (5, "One two, three four five six!"),
    (6, "…—́\x00\x1c\x85 <|endoftext|> 世界 😀 ΑΣ İ"),
    (7, "word " * 30_000),
    (8, "x" * 30_000),
    (9, "12 3.4 5,6"),
]


def odd(spark, **more):
    """The odd rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + ", h long, key string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(rnd: random.Random, n: int) -> str:
    syllables = ["an", "er", "th", "ou", "ti", "on", "re", "st", "ing", "ed", "é", "ü"]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))
