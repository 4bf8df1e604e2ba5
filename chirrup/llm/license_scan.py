"""Licences that texts name or hold, by ordered signature rules over their words.

1. A text becomes its words, lower-case, between single spaces: ASCII letters and digits and all
   characters beyond ASCII make words, everything else parts them.
2. A rule's pattern runs only on texts that hold its keyword. It is matched on whole words, leftmost
   and not overlapping.
3. Detections of all rules are ordered by priority, then length, then place, then rule. One that
   lies within a better one's interval is suppressed; those that merely overlap stay. (Containment is
   transitive, so it does not matter whether the better one was itself suppressed.)
4. The base phrases are counted beside the rules; their labels stay whatever the rules find.
   The score is the weight of the strongest detection that stays, a base phrase counting 0.8.

Nulls and other cases: null and empty texts have no words, no labels and score 0; each row is
scanned by itself, so repeated rows and null ids give a row each; equal detections of two rules keep
the earlier rule's label; bytes that are not UTF-8 are parts of words; very long texts are read
whole; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chirrup.llm.license_rules import BASE, RULES, Rule

BASE_WEIGHT = 80
#: Upper-case ASCII to lower case, and what is neither letter nor digit in ASCII to a space.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
FOUND = "array<struct<label:string,rule:int,priority:int,first:long,last:long>>"


def words_of(text: bytes) -> bytes:
    """The words of ``text`` between single spaces, with one before and behind."""
    words = text.translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def by_keyword(rules: tuple[Rule, ...]) -> dict[bytes, list[tuple[Rule, re.Pattern]]]:
    gates: dict[bytes, list[tuple[Rule, re.Pattern]]] = {}
    for r in rules:
        gates.setdefault(r.keyword.encode(), []).append((r, re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )")))
    return gates


def settled(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (priority, first, last, rule) those that lie within no better one, by place."""
    kept: list[tuple[int, int, int, int]] = []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d[1], d[2], d[3]))


def detections(words: bytes, gates) -> list[tuple[int, int, int, int]]:
    """(priority, first byte, end byte, rule) of what the rules find and do not suppress."""
    found = [(r.priority, *m.span(), r.number) for keyword, rules in gates.items() if keyword in words for r, p in rules for m in p.finditer(words)]
    return settled(found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id, n_words, base (label and start of each place, by phrase and place), found (label, rule, priority, first and last word)."""
    base_kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
    found_kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        gates = by_keyword(rules)
        phrases = [(re.compile(b"(?<= )(?=" + p.encode() + b" )"), label) for p, label in BASE]
        for batch in batches:
            n, base, found = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py() or b"")
                n.append(max(words.count(b" ") - 1, 0))
                at = lambda byte: words.count(b" ", 0, byte) - 1  # noqa: B023, E731
                base.append([{"label": label, "first": at(m.start())} for p, label in phrases for m in p.finditer(words)])
                found.append([{"label": rules[k].label, "rule": k, "priority": p, "first": at(a), "last": at(b)} for p, a, b, k in detections(words, gates)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, base_kind), pa.array(found, found_kind)], ["doc_id", "n_words", "base", "found"])

    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_words long, base array<struct<label:string,first:long>>, found {FOUND}")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the detections."""
    places = F.col("base.first")
    weight = F.greatest(F.coalesce(F.array_max("found.priority"), F.lit(0)), F.when(F.size("base") > 0, BASE_WEIGHT).otherwise(0))
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _joined(F.col("base.label")).alias("base_labels"),
        _joined(F.concat("base.label", "found.label")).alias("labels"),
        (weight / 100.0).alias("score"),
        "found",
    )
