"""Vectors as codes: each of sixteen parts by the nearest of at most 64 entries of its codebook.

The nearest entry is found by slices and bit masks. The entries' coordinates are sorted in each
dimension, and behind every prefix of the sorted row stands the mask of its entries (64 bits). The
entries within a radius in one dimension are the difference of two prefix masks; masks of all
dimensions ANDed give the entries in a box around the part. If the best of them is no farther than
the radius, no entry outside the box can be nearer or as near; else the box is taken again as wide as
the best one found, or twice as wide where it was empty. A codebook's first radius is the mean
distance of its entries from their nearest other.

A round of learning is one pass: tasks add up the parts of each entry, and the driver gets 64 sums per
component, whatever the number of vectors. All arithmetic is on integers, so results do not depend on
the order of rows.

Nulls and other cases: rows whose vector is null, empty, or holds null or non-finite components are
dropped, as are rows whose vector is not as long as that of the smallest kept id. Lengths that sixteen does
not divide are filled up with zeros. Ids sort nulls last; ties of ids by their vectors. Components beyond ±2^26 after
scaling count as that. Repeated rows count each time. Empty tables give empty results. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chirrup.llm.common import sized_side
from chirrup.session import materialise

PARTS, ENTRIES, SCALE, ROUNDS = 16, 64, 256, 2
LIMIT = 1 << 26
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def whole(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integers(values: np.ndarray, rows: int) -> np.ndarray:
    """floor(SCALE * x) of ``rows`` vectors of one length, filled up to a multiple of PARTS components."""
    x = np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64).reshape(rows, -1)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


class SliceIndex:
    """The entries of one part's codebook, sorted in every dimension, with masks of the prefixes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        self.prefix = np.concatenate([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, axis=0)])
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        apart[apart == 0] = apart.max() if len(entries) > 1 else 0  # of equal entries the first is taken
        self.radius = max(1, int(np.sqrt(apart.min(axis=1).astype(np.float64)).mean()))

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each row of ``x`` in every dimension."""
        mask = np.full(len(x), ALL)
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            mask &= self.prefix[high, j] ^ self.prefix[low, j]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry to each row (ties: the lowest) and its squared distance."""
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(left):
            mask = self.candidates(x[left], radius)
            bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, e = np.nonzero(bits)
            d = ((x[left[row]] - self.entries[e]) ** 2).sum(axis=1)
            found, first = np.unique(row, return_index=True)
            best = np.minimum.reduceat(d, first) if len(row) else d
            is_best = d == np.repeat(best, np.diff([*first, len(row)]))
            lowest, where = np.unique(row[is_best], return_index=True)
            entry[left[lowest]], distance[left[lowest]] = e[is_best][where], best
            sure = np.zeros(len(left), bool)
            sure[found] = best <= radius[found] ** 2
            radius = radius * 2
            radius[found] = np.sqrt(best.astype(np.float64)).astype(np.int64) + 1
            left, radius = left[~sure], radius[~sure]
        return entry, distance


@dataclass(frozen=True)
class Codebooks:
    """Per part the entries, as (PARTS, entries, components of a part)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    """Integer vectors of a column of lists of one length."""
    return integers(column.flatten().to_numpy(zero_copy_only=False), len(column))


def kept(rows: DataFrame, id_column: str, vector_column: str, label_column: str) -> tuple[DataFrame, np.ndarray | None]:
    """Rows (id, label, vector) that have a code, and the first ENTRIES of them as integers; None if there are none."""
    rows = rows.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector")).where(whole(F.col("vector")))
    by_id = (F.col("vec_id").asc_nulls_last(), F.col("vector"))
    first = rows.orderBy(*by_id).limit(1).select(F.size("vector").alias("n")).first()
    if first is None:
        return rows, None
    rows = rows.where(F.size("vector") == first["n"])
    seeds = rows.orderBy(*by_id).limit(ENTRIES).collect()  # ENTRIES rows at most
    return rows, integers(np.array([r["vector"] for r in seeds]).ravel(), len(seeds))


def learn(rows: DataFrame, seeds: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``rows`` (vector), started with ``seeds``: in each round an entry moves to the mean of its parts, rounded down."""
    books = seeds.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        moved = rows.select("vector").mapInArrow(_sums(books), "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        flat = books.ravel()
        for r in moved.collect():  # a row per component of the codebooks
            flat[r["at"]] = r["total"] // r["n"]
        books = flat.reshape(books.shape)
    return Codebooks(books)


def _sums(books: np.ndarray):
    """A task's sums and counts of each entry's parts, per component of the codebooks."""

    def run(batches):
        indexes = [SliceIndex(b) for b in books]
        totals, counts = np.zeros_like(books), np.zeros_like(books)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0)).reshape(batch.num_rows, PARTS, -1)
            for p, index in enumerate(indexes):
                entry, _ = index.nearest(x[:, p])
                np.add.at(totals[p], entry, x[:, p])
                counts[p] += np.bincount(entry, minlength=books.shape[1])[:, None]
        used = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals.ravel()[used]), pa.array(counts.ravel()[used])], ["at", "total", "n"])

    return run


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Per row of ``rows`` (vec_id, label, vector): vec_id, label, code (two hex digits a part), error."""

    def run(batches):
        indexes = [SliceIndex(b) for b in books.entries if len(b)]  # without entries there are no rows
        digits = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), "S2")
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(2)).reshape(n, PARTS, -1)
            code, error = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
            for p, index in enumerate(indexes):
                code[:, p], distance = index.nearest(x[:, p])
                error += distance
            text = np.ascontiguousarray(digits[code]).view(f"S{2 * PARTS}").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text.astype(str)), pa.array(error)], ["vec_id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def codes(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    rows, seeds = kept(rows, id_column, vector_column, label_column)
    books = learn(rows, seeds) if seeds is not None else Codebooks(np.zeros((PARTS, 0, 1), np.int64))
    coded = materialise(encode(rows, books), "vector-codes")
    by_label = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "vector-labels")
    joined = coded.join(sized_side(by_label, 48), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
