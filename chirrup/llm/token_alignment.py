"""Tokens of two tokenizers aligned on the bytes of each text.

Both tokenizers read space + text. Where a token of either ends at the same byte, the text is cut;
what lies between two cuts is a *group* of tokens of both, and the two tokens that end at a cut are
*linked*. How often an id pair is linked is counted over all texts.

1. A text is parted before every single space between characters that are no white space. A
   byte-level token never goes across such a place, nor does a piece, unless the vocabulary has one
   with white space after something else (looked up on loading; such texts then stay whole). So a
   part's tokens do not depend on its neighbours, and a task encodes each distinct part once, many
   of them joined by spaces at a time.
2. The tokenizers' own spans are coarse cuts: character offsets of one, byte offsets of the pieces in
   the parsed text of the other. A span that does not hold just its token's bytes (a character in
   several tokens, byte pieces, the added space) is refined by the token's decoded bytes, and all
   tokens together must give the text back.
3. Pairs are counted inside each text, then over all. A text's sums come from a join of its distinct
   pairs with the counts: the most frequent ones by broadcast up to a size, rarer ones by a shuffle.

Nulls and other cases: texts that are null, empty, not UTF-8, or that either tokenizer does not give
back byte for byte, have no tokens; each row is aligned by itself, whatever its id, so repeated rows
and null ids count every time; empty tables give empty results; very long texts are read whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from array import array
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chirrup.llm import common
from chirrup.session import materialise

FOLDER = "/opt/tokenizers"
PARTING = re.compile(r"(?<=\S) (?=\S)")
SLICE = 1 << 20  # characters of whole texts that are worked on at a time
JOINED = 1 << 16  # characters of parts that are encoded at a time
KEPT_PARTS = 250_000  # of distinct parts in a task's memory
PAIR_BYTES = 32  # of a pair's count in a broadcast


@dataclass(frozen=True)
class Vocabularies:
    """The contents of the two files; they go to the executors with the job."""

    byte_level: bytes
    pieces: bytes

    @staticmethod
    def read(folder: str = FOLDER, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> Vocabularies:
        return Vocabularies((Path(folder) / byte_level).read_bytes(), (Path(folder) / pieces).read_bytes())


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Parts:
    """Aligned parts by number: tokens of both (-1: the bytes differ), groups as text, and links."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.first, self.n_links, self.links, self.uses = (array("q") for _ in range(6))

    def add(self, parts: list[str], groups: list[str], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, links: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.groups), len(self.groups) + len(parts))))
        self.groups += groups
        first = len(self.links) + np.cumsum(n_links) - n_links
        for column, values in ((self.n_a, n_a), (self.n_b, n_b), (self.first, first), (self.n_links, n_links), (self.links, links), (self.uses, np.zeros(len(parts)))):
            column.frombytes(np.ascontiguousarray(values, np.int64).tobytes())

    def add_bad(self, part: str) -> None:
        self.add([part], [""], np.array([-1]), np.array([-1]), np.array([0]), np.zeros(0, np.int64))

    def used(self, number: np.ndarray) -> None:
        np.frombuffer(self.uses, np.int64)[:] += np.bincount(number, minlength=len(self.uses))

    def repeated(self, most: int) -> Parts:
        """The parts that were used more than once, ``most`` of them, the most used ones."""
        uses, n_a, n_b, first, n_links, links = (np.array(x, np.int64) for x in (self.uses, self.n_a, self.n_b, self.first, self.n_links, self.links))
        kept = np.sort(np.argsort(-uses, kind="stable")[: min(most, np.count_nonzero(uses > 1))])
        counts, names, out = n_links[kept], list(self.number), Parts()
        at = np.repeat(first[kept] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        out.add([names[i] for i in kept], [self.groups[i] for i in kept], n_a[kept], n_b[kept], counts, links[at])
        return out


class Aligner:
    """Both tokenizers in one task, with the parts that it has seen."""

    def __init__(self, files: Vocabularies):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=files.pieces)
        of = byte_characters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else b""
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        rules = json.loads(files.byte_level)
        splits = (rules["pre_tokenizer"] or {}).get("type") == "ByteLevel" and rules["pre_tokenizer"].get("use_regex", True) and not rules["normalizer"]
        self.parted = splits and not any(re.search("[^▁]▁", p) for p in pieces)
        self.parts = Parts()
        # ids as text with what follows them: a comma inside a group's half, a bar after its A tokens, a semicolon after its B tokens
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.shown = [f"{i}{after}" for n, last in ((self.n_a, "|"), (self.n_b, ";")) for after in (",", last) for i in range(n)]
        self.shown_sizes = np.fromiter(map(len, self.shown), np.int64, len(self.shown))

    def split(self, text: str) -> list[str]:
        return PARTING.split(text) if self.parted else [text]

    def see(self, parts: set[str]) -> None:
        """Aligns those of ``parts`` that are not among ``self.parts``; when there are too many, forgets those used once."""
        if len(self.parts.groups) > KEPT_PARTS:
            self.parts = self.parts.repeated(KEPT_PARTS // 2)
        waiting: list[list[str]] = []
        size = JOINED
        for part in parts - self.parts.number.keys():
            if "▁" in part:  # comes back as a space
                self.parts.add_bad(part)
                continue
            if not self.parted or part[0].isspace() or part[-1].isspace():  # a text's beginning or end: not to be joined
                waiting.append([part])
                size = JOINED
                continue
            if size + len(part) > JOINED:
                waiting.append([])
                size = 0
            waiting[-1].append(part)
            size += len(part) + 1
        while waiting:
            some, waiting = waiting[:2], waiting[2:]
            texts = [" ".join(parts) for parts in some]
            encoded = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
            for parts, text, x, y in zip(some, texts, encoded, self.b.encode(texts, return_type="proto", num_threads=1)):
                if self._add(parts, text, x, y):
                    continue
                if len(parts) == 1:
                    self.parts.add_bad(parts[0])
                else:  # the part whose bytes differ is in one of the halves
                    waiting += [parts[: len(parts) // 2], parts[len(parts) // 2 :]]

    def _add(self, parts: list[str], text: str, x, y) -> bool:
        data = (" " + text).encode()
        a_ids, found = x.ids, list(y.pieces)
        b_ids = [p.id for p in found]
        a_array, b_array = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        b_spans = np.array([[p.begin for p in found], [p.end for p in found]], np.int64).T + 1
        spans = np.fromiter(chain.from_iterable(x.offsets), np.int64, 2 * len(a_ids)).reshape(-1, 2)
        if not text.isascii():
            spans = byte_places(" " + text)[spans]
        a_ends = _ends(spans, [self.a_bytes[i] for i in a_ids], data)
        b_ends = _ends(b_spans, [self.b_bytes[i] for i in b_ids], data)
        if a_ends is None or b_ends is None:
            return False
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        i, j = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        links = a_array[i] << 32 | b_array[j]
        shown, starts = self._shown(a_array, b_array, i, j)
        ends = np.cumsum([1 + len(part.encode()) for part in parts])
        upto = np.searchsorted(cuts, ends) + 1
        if (cuts[upto - 1] != ends).any():
            raise ValueError("tokens go across a single space between words")
        at = starts[np.concatenate([[0], upto])].tolist()
        of_parts = [shown[first : end - 1] for first, end in zip(at, at[1:])]
        tokens = lambda place: np.diff(place[upto - 1] + 1, prepend=0)
        self.parts.add(parts, of_parts, tokens(i), tokens(j), np.diff(upto, prepend=0), links)
        return True

    def _shown(self, a_ids: np.ndarray, b_ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[str, np.ndarray]:
        """All groups as text, each with a semicolon behind it, and where each starts, and the last ends; ``i``, ``j``: their last tokens."""
        a_sizes, b_sizes = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        of_a, of_b = a_ids.copy(), b_ids + 2 * self.n_a
        of_a[i] += self.n_a
        of_b[j] += self.n_b
        codes = np.empty(len(of_a) + len(of_b), np.int64)
        codes[np.arange(len(of_a)) + np.repeat(j + 1 - b_sizes, a_sizes)] = of_a  # behind the B tokens of earlier groups
        codes[np.arange(len(of_b)) + np.repeat(i + 1, b_sizes)] = of_b
        upto = np.cumsum(self.shown_sizes[codes])
        return "".join(map(self.shown.__getitem__, codes.tolist())), np.concatenate([[0], upto[i + j + 1]])


def byte_places(text: str) -> np.ndarray:
    """Where each character of ``text``, and its end, lies in UTF-8."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])


def _ends(spans: np.ndarray, tokens: list[bytes], data: bytes) -> np.ndarray | None:
    """The byte at which each token ends, None if the tokens' bytes are not ``data``.

    A span that holds just the token's bytes is taken as it is; else the token's own bytes tell its end.
    """
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if b"".join(tokens) != data or not sizes.all():
        return None
    ends = np.cumsum(sizes)
    coarse = (spans[:, 0] == ends - sizes) & (spans[:, 1] == ends)
    return np.where(coarse, spans[:, 1], ends)


def _of_texts(aligner: Aligner, parts: list[list[str]]):
    """Columns n_a, n_b, n_groups, groups, pairs, times of texts given as their parts."""
    n = len(parts)
    aligner.see({p for text in parts for p in text})
    known = aligner.parts
    numbers = [list(map(known.number.__getitem__, text)) for text in parts]
    sizes = np.array([len(p) for p in parts])
    number, text_of_part = np.fromiter(chain.from_iterable(numbers), np.int64, sizes.sum()), np.repeat(np.arange(n), sizes)
    known.used(number)
    column = lambda a: np.frombuffer(a, np.int64) if len(a) else np.zeros(0, np.int64)
    n_a, n_b, first, n_links, links = map(column, (known.n_a, known.n_b, known.first, known.n_links, known.links))
    fine = np.bincount(text_of_part[n_a[number] >= 0], minlength=n) == sizes
    keep = fine[text_of_part]
    number, text_of_part = number[keep], text_of_part[keep]
    total = lambda values: np.bincount(text_of_part, values[number], minlength=n).astype(np.int64)
    counts = n_links[number]
    at = np.repeat(first[number] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    text, pair = np.repeat(text_of_part, counts), links[at]
    order = np.lexsort((pair, text))
    text, pair = text[order], pair[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(text) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=n))]).astype(np.int32)
    groups = [";".join(map(known.groups.__getitem__, text)) if good else "" for text, good in zip(numbers, fine)]
    lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
    return [pa.array(total(n_a)), pa.array(total(n_b)), pa.array(total(n_links)), pa.array(groups, pa.string()), lists(pair[new]), lists(np.diff([*new, len(text)]))]


def aligned(docs: DataFrame, files: Vocabularies, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``), pairs (a << 32 | b, distinct) and times."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]

    def texts(column):
        for value in column:
            try:
                yield value.as_py().decode() if value.is_valid else ""
            except UnicodeDecodeError:
                yield ""

    def run(batches):
        aligner = Aligner(files)
        for batch in batches:
            ids, first, waiting, size = batch.column(0), 0, [], 0
            for k, text in enumerate(texts(batch.column(1))):
                waiting.append(aligner.split(text) if text else [])
                size += len(text)
                if size >= SLICE or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(waiting)), *_of_texts(aligner, waiting)], names)
                    first, waiting, size = k + 1, [], 0

    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of rows (pair, times): n over all rows, and whether no pair with that B id has a larger n."""
    counts = materialise(links.groupBy("pair").agg(F.sum("times").alias("n")), "align-counts")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row per id of a vocabulary
    return counts.join(F.broadcast(best), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame, rows: int) -> int:
    """The least count (a power of two) from which on at most ``rows`` pairs have at least that count."""
    level = F.floor(F.log2("n")).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # 64 rows at most
    total, least = 0, 64
    for r in by_level:
        total += r["k"]
        if total > rows:
            break
        least = r["level"]
    return 1 << min(least, 62)


def alignment(docs: DataFrame, files: Vocabularies, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = aligned(docs, files, id_column, text_column)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times"), "align-rows")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times").withColumnRenamed("pairs", "pair")
    counts = materialise(pair_counts(links.select("pair", "times")), "align-pairs")
    least = _frequent_from(counts, common.BROADCAST_BYTES // PAIR_BYTES)
    looked = links.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    if least > 1:
        rare = looked.where(F.col("n").isNull()).select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair")
        looked = looked.where(F.col("n").isNotNull()).unionByName(rare)
    sums = looked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
