"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns are exact and linear in the text. The field labels words by what they look like (which
kinds of characters, how many digits and dots, first and last character, length) and what their
neighbours look like, so it also finds values that no pattern fits: ids, numbers in other notations,
values that run into each other. What it takes for a card number must pass the check digit too. It is trained on the small table ``LABELLED`` by gradient ascent
on the conditional likelihood and decoded by Viterbi for many sequences at once in numpy. A span of
the field counts if it overlaps no span of a pattern.

In the table every word without a digit or ``@`` is unlabelled, so only stretches around words that
have one are decoded, with ``CONTEXT`` words to either side; whatever lies outside has no label.

Nulls and other cases: null and empty texts have no spans; repeated rows are answered alike; null
ids are passed on; empty tables give empty results; very long texts are read whole; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LABELS = ("none", "email", "ip", "card", "phone", "id")
BASE = ("email", "ip", "card", "phone")
CONTEXT = 2
LONGEST = 512  # words of a sequence; a longer stretch is decoded in parts
MARGIN = 32  # words at the inner ends of a part whose labels are left to the next one

#: Fixed values, written by hand: one text a row, spans in double brackets with their label.
LABELLED = (
    "write to [[email|anna.smith@mail.example.org]] before noon on 12 May",
    "contact [[email|j_doe99@corp.example]] or [[email|sales@shop.example.com]] today",
    "the and of [[email|thont.24@mail4.example.com]] than ortion",
    "EMAIL [[email|BOB@EXAMPLE.COM]]!! now",
    "mail me at [[email|x.y+tag@sub.domain.example]]### or call",
    "server [[ip|10.0.12.254]] answered in 35 ms",
    "from [[ip|192.168.1.77]] to [[ip|8.8.4.4]] port 443",
    "the [[ip|106.158.249.239]] and of",
    "host [[ip|172.16.0.1]]*** was down for 3 hours",
    "IP [[ip|240.56.125.154]]!! IS",
    "card [[card|4150940616143001]] expires 09/27",
    "paid with [[card|5927 2430 7427 3351]] in full",
    "number [[card|4080-2508-2178-7625]] was used twice",
    "of [[card|6126142746547109]] the and",
    "CARD [[card|0054994038693466]]!! OF",
    "call [[phone|+1 (509) 555-6973]] after 6 pm",
    "phone [[phone|+44 20 7946 0958]] or write",
    "reach us on [[phone|+49-30-901820]] daily",
    "the [[phone|+1 (826) 555-4081]] [[ip|190.137.223.204]] of",
    "mobile [[phone|+15095556973]] is new",
    "fax [[phone|+33 1 42 68 53 00]] please",
    "old line [[phone|(509) 555-6973]] still works",
    "dial [[phone|509-555-0199]] for help",
    "id [[id|078-05-1120]] was issued in 1988",
    "holder [[id|219-09-9999]] signed on page 4",
    "ssn [[id|457-55-5462]]### stays",
    "iban [[id|DE89370400440532013000]] at the bank",
    "account [[id|GB29NWBK60161331926819]] closed",
    "Licensed under the Apache License, Version 2.0. in 2004",
    "released version 1.4.2 on 2021-03-15 with 27 fixes",
    "it costs $19.99 or 25% less than 2,499.00 in total",
    "at 10:45 the 3rd train left with 120 people",
    "chapter 7 pages 12-18 and 301-315 of 2nd edition",
    "token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\" of the",
    "key ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e### was set",
    "sha 08813ad77930c5f691325605b62c9dfd1b407297 and of",
    "the year 1999 and 1,000,000 others or 3.14159 times",
    "room B12 on floor 3 seats 40 people",
    "score 3-2 after 90 minutes and 5 cards",
    "from 1914-1918 and 1939-1945 in total",
    "follow @someone and #topic2 or c@t",
    "build 20240131 passed 1532 tests in 12.5 s",
    "a b c d the and of with 1 2 3 4 5",
    "die ung keit 2.0. und ach 12. ein",
    "x=1 y=22 z=333 and f(4)",
    "order 48213 has 3 items for 7.50 each",
)

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Each starts at a digit run's start and is possessive: no start and no shorter match is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and _luhn(digits)


def emails(text: str):
    """Leftmost, not overlapping: an ``@`` with a local part before it and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), in order."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if _card(m[0]):
            spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# ---- word shapes -------------------------------------------------------------------------------

KINDS = 8  # lower, upper, digit, @, dot, hyphen, plus and brackets, other
SIZES = (256, 9, 36, 8, 5, 256, 256, 9, 9)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
FEATURES = int(sum(SIZES))
DIGITS = np.array([0, 1, 2, 3, 4] + [5] * 5 + [6] * 4 + [7] * 6)
LENGTHS = np.array([0, 0, 1, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5, 6])


def _kind(c: str) -> int:
    if c.isdigit():
        return 2
    if c.isalpha():
        return 1 if c.isupper() else 0
    return {"@": 3, ".": 4, "-": 5, "+": 6, "(": 6, ")": 6}.get(c, 7)


def shape(word: str) -> tuple[int, ...]:
    """Kinds of characters, digits, first and last kind, length, dots."""
    kinds = [_kind(c) for c in word]
    mask = 0
    for k in kinds:
        mask |= 1 << k
    digits, dots = kinds.count(2), kinds.count(4)
    tail = kinds[-1] if len(kinds) else 0
    return (
        mask,
        int(DIGITS[digits]) if digits < len(DIGITS) else 8,
        min(kinds[0], 5) * 6 + min(tail, 5) if kinds else 0,
        int(LENGTHS[len(word)]) if len(word) < len(LENGTHS) else 7,
        min(dots, 4),
    )


def features(words: list[str]) -> np.ndarray:
    """Feature numbers of each word: its own shape, and kinds and digits of both neighbours."""
    own = np.array([shape(w) for w in words], dtype=np.int64).reshape(len(words), 5)
    edge = np.zeros((1, 5), np.int64)
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    return np.hstack([own, before[:, :1], after[:, :1], before[:, 1:2], after[:, 1:2]]) + OFFSETS


def parse_labelled(row: str) -> tuple[list[str], list[int]]:
    """Words and labels of a row of the labelled table; a span of several words labels each."""
    words, labels, at = [], [], 0
    for m in re.finditer(r"\[\[(\w+)\|(.*?)\]\](\S*)", row):
        plain = row[at : m.start()].split()
        words += plain
        labels += [0] * len(plain)
        own = (m[2] + m[3]).split()
        words += own
        labels += [LABELS.index(m[1])] * len(own)
        at = m.end()
    rest = row[at:].split()
    return words + rest, labels + [0] * len(rest)


class Field:
    """Weights of features by label, and of a label after a label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def trained(cls, table, steps: int = 300, rate: float = 0.3, ridge: float = 0.01) -> Field:
        """Gradient ascent with per-weight step sizes on the penalised conditional log-likelihood."""
        n = len(LABELS)
        rows = [(features(w), np.array(y)) for w, y in map(parse_labelled, table) if w]
        field = cls(np.zeros((FEATURES, n)), np.zeros((n, n)))
        seen_w, seen_m = np.full((FEATURES, n), 1e-6), np.full((n, n), 1e-6)
        for _ in range(steps):
            grad_w, grad_m = -ridge * field.weights, -ridge * field.moves
            for x, y in rows:
                p, pairs = field.marginals(x)
                p[np.arange(len(y)), y] -= 1.0
                np.add.at(grad_w, x, -p[:, None, :])
                grad_m -= pairs
                np.add.at(grad_m, (y[:-1], y[1:]), 1.0)
            seen_w += grad_w**2
            seen_m += grad_m**2
            field.weights += rate * grad_w / np.sqrt(seen_w)
            field.moves += rate * grad_m / np.sqrt(seen_m)
        return field

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.weights[x].sum(axis=1)

    def marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each label at each word, and expected label pairs, by forward and backward sums."""
        s, m = self.scores(x), self.moves
        n = len(s)
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[0] = s[0]
        for t in range(1, n):
            forward[t] = s[t] + np.logaddexp.reduce(forward[t - 1][:, None] + m, axis=0)
        for t in range(n - 2, -1, -1):
            backward[t] = np.logaddexp.reduce(m + (s[t + 1] + backward[t + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(forward[-1])
        pairs = np.zeros_like(m)
        for t in range(1, n):
            pairs += np.exp(forward[t - 1][:, None] + m + (s[t] + backward[t])[None, :] - total)
        return np.exp(forward + backward - total), pairs

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many sequences at once, padded within batches of like length."""
        out: list[np.ndarray | None] = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for a in range(0, len(order), 256):
            group = order[a : a + 256]
            lengths = np.array([len(sequences[i]) for i in group])
            b, t_max, n = len(group), int(lengths.max()), len(LABELS)
            s = np.zeros((b, t_max, n))
            for j, i in enumerate(group):
                s[j, : lengths[j]] = self.scores(sequences[i])
            best, back = s[:, 0], np.zeros((b, t_max, n), np.int8)
            for t in range(1, t_max):
                paths = best[:, :, None] + self.moves[None]
                back[:, t] = paths.argmax(axis=1)
                moved = paths.max(axis=1) + s[:, t]
                best = np.where((t < lengths)[:, None], moved, best)
            label = best.argmax(axis=1)
            labels = np.zeros((b, t_max), np.int8)
            for t in range(t_max - 1, -1, -1):
                inside = t < lengths
                labels[:, t] = np.where(inside, label, 0)
                label = np.where(inside & (t > 0), back[np.arange(b), t, label], label)
            for j, i in enumerate(group):
                out[i] = labels[j, : lengths[j]]
        return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Word spans around words that hold a digit or ``@``, with their context; each word once."""
    words = [m.span() for m in WORD.finditer(text)]
    telling = [k for k, (a, b) in enumerate(words) if TELLING.search(text, a, b)]
    found, at = [], 0
    while at < len(telling):
        first, last = telling[at], telling[at]
        while at + 1 < len(telling) and telling[at + 1] - last <= 2 * CONTEXT:
            at += 1
            last = telling[at]
        found.append(words[max(0, first - CONTEXT) : last + CONTEXT + 1])
        at += 1
    return found


def parts_of(size: int) -> list[tuple[int, int, int, int]]:
    """Parts of a stretch (start, end) and which of their words keep their labels (from, to): each word once, with its
    neighbours and ``MARGIN`` words to either side, where the stretch goes on, in the same part."""
    starts = range(0, max(1, size - 2 * MARGIN), LONGEST - 2 * MARGIN)
    ends = [min(a + LONGEST, size) for a in starts]
    return [(a, b, a + MARGIN if a else 0, b - MARGIN if b < size else b) for a, b in zip(starts, ends)]


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without signs around the value."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    return start, end


def _field_spans(text: str, stretch, labels) -> list[tuple[int, int, int]]:
    spans, k = [], 0
    while k < len(stretch):
        label, first = int(labels[k]), k
        while k + 1 < len(stretch) and labels[k + 1] == label and label in (3, 4):  # only these run over several words
            k += 1
        if label:
            start, end = _trimmed(text, stretch[first][0], stretch[k][1])
            value = text[start:end]
            if TELLING.search(value) and (label != 3 or _card(value)) and (label != 4 or 7 <= len(_digits(value)) <= 15):
                spans.append((start, label - 1, end))
        k += 1
    return spans


def find(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """Per text: spans of the patterns, and all spans; (start, place of the kind, end) in order."""
    base = [base_spans(t) if t and TELLING.search(t) else [] for t in texts]
    whole = [(i, s) for i, t in enumerate(texts) if t and TELLING.search(t) for s in stretches(t)]
    parts = [(k, *cut) for k, (_, s) in enumerate(whole) for cut in parts_of(len(s))]
    decoded = field.decode([features([texts[whole[k][0]][a:b] for a, b in whole[k][1][start:end]]) for k, start, end, _, _ in parts])
    labels: list[list[np.ndarray]] = [[] for _ in whole]
    for (k, start, _, kept, to), own in zip(parts, decoded):
        labels[k].append(own[kept - start : to - start])
    more: list[list] = [[] for _ in texts]
    for (i, s), own in zip(whole, labels):
        more[i] += _field_spans(texts[i], s, np.concatenate(own))
    out = []
    for own, found in zip(base, more):
        extra, k, reach = [], 0, 0
        for a, place, b in sorted(found):
            while k < len(own) and own[k][0] < b:
                reach = max(reach, own[k][2])
                k += 1
            if reach <= a:
                extra.append((a, place, b))
        out.append((own, sorted(own + extra)))
    return out


def _written(spans) -> str:
    return ",".join(f"{LABELS[place + 1]}:{a}:{b}" for a, place, b in spans)


def train(spark: SparkSession, labelled: DataFrame | None = None, most: int = 10_000) -> Field:
    """Train on a table with a column ``labelled`` (at most ``most`` rows of it), or on the table above."""
    rows = [r["labelled"] for r in labelled.orderBy("labelled").limit(most).collect()] if labelled is not None else LABELLED
    return Field.trained([r for r in rows if r])


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id, counts of the patterns' kinds, ``base`` and ``spans`` as kind:start:end lists."""
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base", "spans"]

    def answer(batches):
        for b in batches:
            for part in (b.slice(k, 500) for k in range(0, b.num_rows, 500)):
                found = find(part.column("text").to_pylist(), field)
                counts = [pa.array([sum(p == k for _, p, _ in own) for own, _ in found], pa.int64()) for k in range(len(BASE))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array([_written(own) for own, _ in found], pa.string()), pa.array([_written(every) for _, every in found], pa.string())],
                    names,
                )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    return docs.select("doc_id", "text").mapInArrow(answer, schema)
