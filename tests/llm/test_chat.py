"""Chat windows: read back, budgets, masks, and the SQL."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, queries

from conftest import canonical
from .helpers import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, window string, mask int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    marks = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<|nl|>", "\n", "\\", "<", "|", "<|im_end|>\n", "é世😀", "plain words here "]
    out = []
    for c in range(40):
        if rnd.random() < 0.6:
            out.append((c, 0, "system", "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 6)))))
        for t in range(1, rnd.randint(2, 120)):
            out.append((c, t, "assistant" if t % 2 == 0 else "user", "".join(rnd.choice(marks) for _ in range(rnd.choice([0, 1, 5, 30, 400 if rnd.random() < 0.1 else 3])))))
    out += [(90, 0, None, None), (90, None, "assistant", "a"), (90, 1, "tool\n<|im_end|>x", "t"), (90, 1, "tool\n<|im_end|>x", "t"), (None, 1, "assistant", "of nobody"), (91, 0, "system", "alone"), (92, -40, "user", "later"), (92, None, "user", "first"), (92, -1, "assistant", "last")]
    return out


def slow_digest(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        said = "".join(x for *_, r, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_windows_give_every_turn_back_once(spark, rows):
    windows = chat_format.format_conversations(turns(spark, rows), budget=300, history=60)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(windows).collect()}
    assert got == slow_digest(rows)


def pieces(window):
    """(head mark, role, text, tail mark) of a window's pieces, read without the library's reader."""
    out, rest = [], window.text
    while rest:
        head = rest[:12]
        assert head in (chat_format.START, chat_format.NEXT)
        end, tail = min((rest.index(x), x) for x in (chat_format.END, chat_format.MORE) if x in rest)
        role, _, text = rest[12:end].partition("\n")
        out.append((head, role, re.sub(r"<\\(\\*)\|", r"<\1|", text), tail))
        rest = rest[end + len(tail) :]
    return out


def count(text):
    return 4 + -(-len(text) // 4)


def test_windows_keep_budget_history_and_system(spark, rows):
    budget, history, system = 300, 60, 40
    windows = chat_format.format_conversations(turns(spark, rows), budget=budget, history=history, system=system).collect()
    opening = {c: x or "" for c, t, r, x in rows if r == "system" and t == 0}
    assert len({(w.conv_id, w.window) for w in windows}) == len(windows)
    whole = 0
    for w in windows:
        parts = pieces(w)
        assert len(parts) == w.n_repeated + w.n_new
        sizes = [count(x) for _, _, x, _ in parts]
        assert w.n_tokens == sum(sizes) <= budget
        repeated, new = sizes[: w.n_repeated], sizes[w.n_repeated :]
        assert sum(new) <= budget - history - system
        if w.window > 0 and w.conv_id in opening:
            _, role, text, tail = parts[0]
            assert role == "system" and repeated[0] <= system and opening[w.conv_id].startswith(text)
            assert (text == opening[w.conv_id]) == (tail == chat_format.END) == (count(opening[w.conv_id]) <= system)
            whole += tail == chat_format.END
            repeated = repeated[1:]
        elif w.window == 0:
            assert not repeated
        assert sum(repeated) <= history
        masked = [re.sub(r"<\\(\\*)\|", r"<\1|", w.text[m.start : m.end]) for m in w.mask]
        assert masked == [x for _, role, x, _ in parts[w.n_repeated :] if role == "assistant"]
    assert whole and any(w.n_repeated > 1 for w in windows)


def test_long_turns_and_system_turns_are_within_the_budget(spark):
    long = "".join(random.Random(2).choice(["<|im_end|>", "<|", "|", "😀", "é", "ab c\n"]) for _ in range(60_000))
    rows = [(1, 0, "system", "s" * 8_000), *[(1, t, "assistant" if t % 2 else "user", f"{t} " * 500 + "x" * 400) for t in range(1, 9)], (2, 0, "user", "a"), (2, 1, "assistant", long), (2, 1, "assistant", long), (2, 2, "assistant", "b")]
    windows = chat_format.format_conversations(turns(spark, rows))
    assert max(w.n_tokens for w in windows.collect()) <= chat_format.BUDGET
    for w in windows.collect():
        assert sum(count(x) for _, _, x, _ in pieces(w)) == w.n_tokens
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digest(windows).collect()}
    assert got == slow_digest(rows)


def test_own_token_counts(spark):
    """Counts of another kind, with a bound on characters that holds, and one that doesn't."""
    rows = [(1, t, "user" if t % 2 else "assistant", "w " * 70) for t in range(6)]
    bytes_of = lambda text: (F.octet_length(text) + 2).cast("long")
    form = lambda most: chat_format.format_conversations(turns(spark, rows), budget=200, history=40, system=40, tokens=bytes_of, characters=most)
    windows = form(lambda n: (n - 2) // 4)
    assert max(w.n_tokens for w in windows.collect()) <= 200
    assert chat_format.digest(windows).first().turns_sha256 == slow_digest(rows)[1][1]
    with pytest.raises(Exception, match="more tokens than half the room"):
        form(lambda n: 2 * n).collect()


def test_long_conversations_are_placed_in_two_steps(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(700)]
    windows = chat_format.format_conversations(turns(spark, rows))
    assert [r.window for r in windows.orderBy("window").collect()] == sorted({r.window for r in windows.collect()})
    assert chat_format.digest(windows).first().turns_sha256 == slow_digest(rows)[1][1]


def test_empty_and_wrong(spark):
    assert chat_format.digest(chat_format.format_conversations(turns(spark, []))).count() == 0
    with pytest.raises(ValueError):
        chat_format.format_conversations(turns(spark, []), budget=10, history=10)
    with pytest.raises(ValueError):
        chat_format.format_conversations(turns(spark, []), budget=400, history=100, system=300)


def test_escape_is_undone(spark):
    df = spark.createDataFrame([("<|x",), ("<\\|",), ("<\\\\|im_end|>",), ("<",), ("",), ("a|b<|",)], "t string")
    assert df.where(chat_format.unescape(chat_format.escape(F.col("t"))) != F.col("t")).count() == 0
    assert df.where(chat_format.escape(F.col("t")).contains("<|")).count() == 0


def test_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SMALL).toPandas(), duck.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert canonical(got, columns) == canonical(want, columns), name
