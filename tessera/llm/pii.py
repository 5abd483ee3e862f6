"""Personal data and secrets: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find what has a fixed form (e-mail, IP, card, phone). The random field labels the tokens of each line as
outside, or first or further token of a secret (keys, passwords, access tokens: strings that no word looks like). Its
features are the shape of a token and of its neighbours; it is trained from a small labelled table and decoded by
Viterbi in numpy. A token's emission scores depend on three shapes alone, so they are looked up by shape; and a line in
which every token prefers "outside" by more than transitions could make up for is all outside, without decoding.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import map_batches, texts

#: Kinds in the order of their spans; the first four are those of the patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", "B", "I")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match can't start within a run of digits whose start gave none; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VOWELS = re.compile(r"[AEIOUYaeiouyÀ-ÖØ-öø-ÿ\d\W_]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\n")


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the e-mail pattern, found from the @ outwards in linear time."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            after = m.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", max(at + 1, after))
    return out


def patterns(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind that the patterns find, code points, end exclusive."""
    found = {k: [] for k in KINDS}
    found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


def shape(token: str) -> tuple[str, ...]:
    """Features of a token: its runs of character classes, its length, its mixture."""
    runs, last, changes = [], "", 0
    for c in token:
        kind = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if kind != last:
            runs.append(kind)
            changes += 1
            last = kind
    size = min(6, len(token).bit_length())
    letters, digits = any(c.isalpha() for c in token), any(c.isdigit() for c in token)
    mixed = letters and digits
    hexed = mixed and all(c in "0123456789abcdef" for c in token)
    rough = max(map(len, _VOWELS.split(token)))
    odd = sum(c in "JKQXZWV" for c in token) * 4 // max(1, len(token))
    return (f"rough={min(rough, 7)},{size},{runs[0]}", f"odd={odd},{size},{min(rough, 5)}", f"runs={''.join(runs[:4])}", f"size={size}", f"mixed={mixed},{size}", f"hex={hexed},{size}", f"changes={min(changes, 8)},{size}", f"upper={mixed and not any(c.islower() for c in token)},{size}")


def labelled(spark: SparkSession, *, sentences: int = 720, seed: int = 7) -> DataFrame:
    """The small labelled table (sentence, pos, token, label) that the field is trained from, made by rule."""
    rnd = random.Random(seed)
    hexes, base32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    syllables = "the an er ou ti on re st ing ed ion le que de la ung sch ein ar os ció é ü ñ".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice([1, 2, 2, 3, 4, 6, 9])))
    of = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    rows = []
    for i in range(sentences):
        text: list[tuple[str, str]] = [(w.capitalize() if rnd.random() < 0.15 else w.upper() if rnd.random() < 0.15 and len(w) < 24 else w, "O") for w in (word() for _ in range(rnd.randint(2, 9)))]
        kind, at = i % 9, rnd.randint(0, len(text))
        if kind == 0:
            put = [("AKIA" + of(base32 if rnd.random() < 0.7 else base32[:26], 16), "B")]
        elif kind == 1:
            put = [(rnd.choice(["password", "passwd", "pwd", "secret"]), "O"), (rnd.choice("=:"), "O"), (of(hexes, rnd.choice([12, 16, 18, 20, 24])), "B")]
        elif kind == 2:
            put = [(rnd.choice(["token", "api_key", "secret"]).split("_")[0], "O"), ("=", "O"), ('"', "O"), (of(hexes, rnd.choice([32, 40, 40, 64])), "B"), ('"', "O")]
        elif kind == 3:
            put = [("ghp", "O"), ("_", "O"), (of("ABCDEFGHJKLMNPabcdefghjkmnp23456789", 18), "B"), ("_", "I"), (of("ABCDEFGHJKLMNPabcdefghjkmnp23456789", 18), "I")]
        elif kind == 4:
            put = [(of("0123456789", n), "O") for n in (4, 4, 4, 4)] if rnd.random() < 0.5 else [(of("123456789", rnd.choice([1, 2, 4, 10, 16])), "O")]
        elif kind == 5:
            put = [(x, "O") for x in _TOKEN.findall(f"{word()}.{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.example.com")]
        elif kind == 6:
            put = [(x, "O") for x in _TOKEN.findall(f"+{rnd.randint(1, 9)} ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}")]
        elif kind == 7:
            put = [(x, "O") for x in _TOKEN.findall(rnd.choice([f"v{rnd.randint(1, 9)}.{rnd.randint(0, 9)}", f"{rnd.randint(1, 31)}th", "mp3", "H2O", f"{rnd.randint(1, 255)}.{rnd.randint(1, 255)}.1.7", "4x4", "B2B", "2nd", f"#{rnd.randint(1, 99)}", "| a | b |", "https://www.example.org/page1.html"]))]
        else:
            put = [(rnd.choice([".", ",", "—", "|", "donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism"]), "O")]
        text[at:at] = put
        rows += [(i, k, t, y) for k, (t, y) in enumerate(text)]
    return spark.createDataFrame(rows, "sentence long, pos int, token string, label string")


@dataclass
class Field:
    """weights: per feature of the token itself, the one before and the one after, a row per feature, a column per label."""

    features: dict[str, int]
    weights: np.ndarray  # 3 x features x labels
    moves: np.ndarray  # from label, to label
    start: np.ndarray

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Of every token by place (itself, before, after) and label."""
        out = np.zeros((len(tokens), 3, len(LABELS)))
        for i, t in enumerate(tokens):
            at = [k for x in shape(t) if (k := self.features.get(x)) is not None]
            out[i] = self.weights[:, at].sum(1)
        return out


def train(table: DataFrame, *, rounds: int = 200, l2: float = 0.02) -> Field:
    """Maximise the penalised likelihood of a labelled table (sentence, pos, token, label), which must be small: it is read by the driver."""
    rows = table.select("sentence", "pos", "token", "label").toPandas().sort_values(["sentence", "pos"])
    groups = [(list(g["token"]), [LABELS.index(y) for y in g["label"]]) for _, g in rows.groupby("sentence")]
    features: dict[str, int] = {}
    for tokens, _ in groups:
        for t in tokens:
            for x in shape(t):
                features.setdefault(x, len(features))
    n, longest, k = len(groups), max(len(t) for t, _ in groups), len(LABELS)
    pad = len(features)
    width = len(shape("a"))
    ids = np.full((n, longest + 2, width), pad)
    gold, inside = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (tokens, labels) in enumerate(groups):
        for j, t in enumerate(tokens):
            ids[i, j + 1] = [features[x] for x in shape(t)]
        gold[i, : len(labels)], inside[i, : len(labels)] = labels, True
    sides = [ids[:, 1:-1], ids[:, :-2], ids[:, 2:]]
    theta = {"w": np.zeros((3, pad + 1, k)), "m": np.zeros((k, k)), "s": np.zeros(k)}
    first, second = {x: np.zeros_like(v) for x, v in theta.items()}, {x: np.zeros_like(v) for x, v in theta.items()}
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for step in range(1, rounds + 1):
        theta["w"][:, pad] = 0
        score = sum(theta["w"][s][sides[s]].sum(2) for s in range(3))
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = score[:, 0] + theta["s"]
        for t in range(1, longest):
            alpha[:, t] = np.where(inside[:, t, None], score[:, t] + lse(alpha[:, t - 1, :, None] + theta["m"], 1), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(inside[:, t + 1, None], lse(theta["m"] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        edge = np.exp(alpha[:, :-1, :, None] + theta["m"] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        diff = (np.eye(k)[gold] * inside[..., None]) - node
        grad = {"w": np.zeros_like(theta["w"]), "m": -edge.sum((0, 1)), "s": diff[:, 0].sum(0)}
        np.add.at(grad["m"], (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
        for s in range(3):
            np.add.at(grad["w"][s], sides[s], diff[:, :, None, :])
        for x in theta:
            g = grad[x] / n - l2 / n * theta[x]
            first[x] = 0.9 * first[x] + 0.1 * g
            second[x] = 0.99 * second[x] + 0.01 * g * g
            theta[x] = theta[x] + 0.15 * first[x] / (1 - 0.9**step) / (np.sqrt(second[x] / (1 - 0.99**step)) + 1e-9)
    return Field(features, theta["w"][:, :pad], theta["m"], theta["s"])


def viterbi(scores: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels of one sequence; ties go to the earlier label."""
    best, back = scores[0] + start, np.zeros(scores.shape, int)
    for t in range(1, len(scores)):
        ways = best[:, None] + moves
        back[t] = ways.argmax(0)
        best = ways.max(0) + scores[t]
    out = np.zeros(len(scores), int)
    out[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


class Decoder:
    """Labels tokens of whole texts; emission scores are kept by distinct token shape, shape ids by distinct token."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.known: dict[str, int] = {"\n": 0}
        self.shapes: dict[tuple, int] = {("\n",): 0}
        self.table = np.zeros((1024, 3, len(LABELS)))
        self.slack = 2 * max(0.0, float(max(field.moves.max(), field.start.max()) - min(field.moves[0, 0], field.start[0])))

    def _ids(self, tokens: list[str]) -> list[int]:
        known = self.known
        try:
            return list(map(known.__getitem__, tokens))
        except KeyError:
            pass
        if len(known) > 400_000:
            known.clear()
            known["\n"] = 0
        for t in tokens:
            if t not in known:
                key = shape(t)
                i = self.shapes.setdefault(key, len(self.shapes))
                if i == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                if i == len(self.shapes) - 1:
                    self.table[i] = self.field.emissions([t])[0]
                known[t] = i
        return list(map(known.__getitem__, tokens))

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """Spans of the tokens labelled as secrets, by line."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        ids = np.array(self._ids(tokens))
        self_, before, after = self.table[:, 0], self.table[:, 1], self.table[:, 2]
        score = self_[ids]
        score[1:] += before[ids[:-1]]
        score[:-1] += after[ids[1:]]
        doubtful = (score[:, 0] - score[:, 1:].max(1) <= self.slack) & (ids > 0)
        if not doubtful.any():
            return []
        ends = np.append(np.flatnonzero(ids == 0), len(ids))
        spans: list[tuple[int, int]] = []
        places: list[tuple[int, int]] = []
        for line in np.unique(np.searchsorted(ends, np.flatnonzero(doubtful))):
            a, b = (int(ends[line - 1]) + 1 if line else 0), int(ends[line])
            labels = viterbi(score[a:b], self.field.moves, self.field.start)
            hits = np.flatnonzero(labels)
            if len(hits):
                places = places or [m.span() for m in _TOKEN.finditer(text)]
                for i in hits.tolist():
                    start, end = places[a + i]
                    if labels[i] == 2 and i and labels[i - 1] and spans and spans[-1][1] == start:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((start, end))
        return spans


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found[k]))


def find_personal_data(docs: DataFrame, field: Field, *, keep_lists: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret of every whole text.

    One row per input row; a null text is an empty one and has no spans; other columns play no part. Spans of the
    random field that touch one of the patterns are left out, the patterns' spans all stay. The four counts and
    base_sha256 are of the patterns' spans, `spans` lists all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the labelled table

    def make():
        decoder = Decoder(shared.value)

        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret")}
            for text in batch.column("text").to_pylist():
                found = patterns(text)
                base = [x for k in KINDS[:4] for x in found[k]]
                found["secret"] = [x for x in decoder.secrets(text) if not any(x[0] < b and a < x[1] for a, b in base)]
                for k in KINDS:
                    out[f"n_{k}"].append(len(found[k]))
                out["base_sha256"].append(hashlib.sha256(joined(found, KINDS[:4]).encode()).hexdigest())
                out["spans"].append(joined(found))
            return out | {"doc_id": batch.column("doc_id")}

        return run

    return map_batches(texts(docs), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long")
