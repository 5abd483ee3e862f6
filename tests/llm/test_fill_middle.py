"""Fill-in-the-middle against the definition, token by token."""

import hashlib
import random
import re

from tessera.llm import fill_middle as fim

from .helpers import empty, odd, words

_TOKEN = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def slow(number, text, rate=50):
    tokens = _TOKEN.findall(text)
    assert "".join(tokens) == text
    n, h = len(tokens), hashlib.sha256(f"42:{number}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_places_of_bits():
    rnd = random.Random(1)
    for _ in range(300):
        bits = rnd.getrandbits(rnd.randint(1, 400)) | 1 << rnd.randint(0, 400)
        at = [i for i in range(bits.bit_length()) if bits >> i & 1]
        assert [fim.place(bits, k) for k in range(len(at))] == at


def test_by_the_definition():
    rnd = random.Random(2)
    pieces = ["a", "é", "世界", "😀", " ", "\t", "\n", "\x0b\x0c\r", "\x1c", "\x85", "\xa0", "<P", ">", "<", "<S", "M>", "<M>", "word"]
    forms = set()
    for k in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14)))
        got = fim.rearranged(text.encode(), str(k), 42, 90, 80)
        want = slow(k, text, 90)
        assert got[:2] + (got[2].decode(),) + got[3:] == want
        forms.add(want[1])
    assert forms == {"plain", "psm", "spm"}


def test_texts_come_back(spark):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choice(["<", "P", ">", "S>", "<M", " ", "é", "\n"]) for _ in range(rnd.randint(0, 9)))) for k in range(600)]
    rows += [(1000 + k, words(rnd, rnd.randint(1, 60))) for k in range(200)] + [(5000, "w " * 300_000), (5001, "é" * 200_000), (5002, " " * 1000)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("again", fim.restored()).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and all(r.again == texts[r.doc_id] for r in got)
    assert all((r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == slow(r.doc_id, texts[r.doc_id]) for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_and_empty_tables(spark):
    got = fim.digest(fim.fill_in_middle(odd(spark))).collect()
    assert len(got) == odd(spark).count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].n == 0 and by[i].form == "plain" for i in (1, 2)) and by[3].n == 1 and by[7].n == 30_001
    assert by[1].output_sha256 == hashlib.sha256(b"").hexdigest()
    assert fim.digest(fim.fill_in_middle(empty(spark))).collect() == []
