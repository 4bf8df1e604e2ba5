"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, letters of other scripts that look Latin, full-width forms,
digits and signs that stand for letters, invisible characters dropped, all else a space. Accents
stay, as they tell words apart. The lexicon holds word beginnings, each weighted by the log of how
much more often it occurs in toxic than in other training texts; exception phrases are entries of
weight 0 that win over the shorter entry they contain. Per word the longest entry counts. The sum of
weights, also in relation to the text's length, goes into a logistic function fitted on training rows.

Lexicon and function are learned from at most about ``LEARN_ROWS`` labelled rows, drawn by a hash of
the id; word counts of that sample are made and combined on the executors. The driver receives the
lexicon (``ENTRIES`` at most) and five numbers per sampled row.

Nulls and other cases: null texts are empty; texts without words score what a text without matches
scores; rows without a label or a text teach nothing; several labels of one id count as the highest;
without any toxic or any other labelled row all scores are the share of toxic rows (0 if there are
no labels); repeated rows score alike; empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chirrup.llm.common import held_out
from chirrup.session import materialise

LEARN_ROWS = 30_000
ENTRIES = 2000
SHORTEST, LONGEST = 3, 12
LEAST_COUNT, LEAST_WEIGHT = 8, 1.5
STEPS = 400
COUNTED = 100_000  # distinct words that a task holds before it passes them on

#: Phrases in which an entry is not meant.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "class clown", "circus clown", "sore loser", "pond scum")

#: Look-alikes of Latin letters in other scripts.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
AROUND = "!|#%&*.,;:?\"'()[]{}<>-_"
INVISIBLE = "​‌‍⁠﻿­"


class _Folding(dict):
    """Translation by code point, worked out when a character is first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        elif 0xFF01 <= code <= 0xFF5E:  # full-width
            out = self[ord(chr(code - 0xFEE0).lower())]
        else:
            out = LOOK_ALIKES.get(c) or (c if c.isalpha() else " ")
        self[code] = out
        return out


FOLDING = _Folding()
SIGNS = {ord(k): v for k, v in SUBSTITUTES.items() if not k.isdigit()}
DIGITS = {ord(k): v for k, v in SUBSTITUTES.items() if k.isdigit()}


def folded(text: str | None) -> list[str]:
    """Words after folding. A sign or digit stands for a letter only within a word that has one."""
    words = []
    for w in (text or "").lower().split():
        if w.isalpha() and w.isascii():
            words.append(w)
            continue
        core = w.strip(AROUND).rstrip(AROUND + "$@")
        if len(core) - len(core.lstrip("$@")) > 1:  # decoration; a single one stands for a letter
            core = core.lstrip(AROUND + "$@")
        if any(c.isalpha() for c in core) and not core.isalpha():
            core = core.translate(SIGNS).translate(DIGITS)
        words += core.translate(FOLDING).split()
    return words


def _beginnings(word: str):
    return (word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))


@dataclass
class Model:
    entries: dict[str, float]
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(features), self.prior)
        z = (features - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Matcher:
    """The automaton over `` word word``; entries begin with the space before a word."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in entries.items():
            self.automaton.add_word(f" {entry}", weight)
        for phrase in EXCEPTIONS if entries else ():
            self.automaton.add_word(f" {phrase}", 0.0)
        self.automaton.make_automaton()
        self.any = bool(entries)

    def features(self, text: str | None) -> tuple[float, ...]:
        words = folded(text)
        n = len(words)
        total = highest = 0.0
        hits = 0
        if self.any and n:
            for _, weight in self.automaton.iter_long(" " + " ".join(words)):
                total += weight
                hits += weight > 0
                highest = max(highest, weight)
        return total / max(n, 1), total / max(n, 1) ** 0.5, np.log1p(total), highest, np.log1p(n), hits / max(n, 1)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic, fit) of labelled rows outside the held-out fold; ``fit`` marks those for the function."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = materialise(known, "toxic-labels")
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < min(1.0, rows / max(n, 1)) * (1 << 20))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    fit = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(3)) == 0
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic", fit.alias("fit"))  # rows: see LEARN_ROWS


def _parts(batch: pa.RecordBatch, rows: int = 256):
    """A batch in parts whose texts are few enough to be held as Python strings."""
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def _count(batches):
    schema = pa.schema([("word", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64())])
    counts: Counter = Counter()

    def flushed():
        words, toxic = zip(*counts) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.bool_()), pa.array(counts.values(), pa.int64())], schema=schema)

    for b in batches:
        for part in _parts(b):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                counts.update((w[:LONGEST], toxic) for w in folded(text))
            if len(counts) > COUNTED:
                yield flushed()
                counts.clear()
    yield flushed()


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = LEARN_ROWS, entries: int = ENTRIES) -> Model:
    sample = materialise(_sample(docs, labels, rows), "toxic-sample")
    words = sample.where("NOT fit").select("text", "toxic").mapInArrow(_count, "word string, toxic boolean, n long")
    words = materialise(words.groupBy("word").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("o")), "toxic-words")
    totals = words.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).first()
    n_t, n_o = (totals["t"] or 0) + 1, (totals["o"] or 0) + 1
    cut = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    begun = words.where(F.length("word") >= SHORTEST).select(F.explode(cut).alias("entry"), "t", "o").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    weight = F.log((F.col("t") + 0.5) / n_t) - F.log((F.col("o") + 0.5) / n_o)
    found = (
        begun.withColumn("weight", weight)
        .where((F.col("t") >= LEAST_COUNT) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc(F.col("weight") * F.sqrt("t")), "entry")
        .limit(entries)  # the size of the lexicon
        .collect()
    )
    lexicon: dict[str, float] = {}
    for r in sorted(found, key=lambda r: (len(r["entry"]), r["entry"])):
        shorter = max((lexicon[b] for b in _beginnings(r["entry"]) if b in lexicon), default=None)
        if shorter is None or r["weight"] > shorter + 0.7:  # a longer beginning must say more
            lexicon[r["entry"]] = r["weight"]

    def features(batches):
        matcher = Matcher(lexicon)
        for b in batches:
            for part in _parts(b):
                f = np.array([matcher.features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in f.T], part.column("toxic")], [*"abcdef", "toxic"])

    fitted = sample.where("fit").select("text", "toxic").mapInArrow(features, "a double, b double, c double, d double, e double, f double, toxic boolean").toPandas()
    y = fitted["toxic"].to_numpy(bool)
    x = fitted[list("abcdef")].to_numpy(float)
    if not len(y) or y.all() or not y.any():
        return Model(lexicon, np.zeros(6), np.ones(6), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    return Model(lexicon, centre, scale, _logistic((x - centre) / scale, y), float(y.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on the logistic loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def score(batches):
        matcher = Matcher(model.entries)
        for b in batches:
            for part in _parts(b):
                p = model.scores(np.array([matcher.features(t) for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype("int32"))], ["doc_id", "held_out", "score", "predicted"]
                )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
