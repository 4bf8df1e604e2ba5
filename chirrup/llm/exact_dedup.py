"""Exact deduplication over a sharded cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its normalised form. The index is cut into shards by digest; a
shard holds a cuckoo filter and the digests it was built from, with the number of live copies of
each and the row that stays. Per digest that arrives, the filter is asked first: a miss is new and
is inserted; a hit is verified against the stored digests of its bucket, so false positives of the
filter never join texts. A full filter is rebuilt with twice the buckets from the stored digests.
Deletion lowers the count; at zero the digest leaves the store and its fingerprint the filter.

Copies are combined per Arrow batch before they are shuffled, so a text with a third of all rows
reaches its shard as a few rows. Shards are streamed: a task holds one shard, whose size is bounded
by ``SHARD_KEYS`` on average. An epoch of the index is a Parquet table in the shared folder.

Nulls and other cases: a null text is an empty one; null ids count as larger than all others; rows
that repeat an id and a text are copies of each other and exactly one stays; deletions of texts that
are not live do nothing; when the row that stays is deleted while copies live, its id goes on naming
the group; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chirrup.llm.common import SPACES, complete_parts, new_names, sized_side, text_of
from chirrup.session import materialise, new_path

SHARD_KEYS = 1 << 16
SLOTS, KICKS, FIRST_BUCKETS = 4, 200, 1 << 8
EVENT = "shard int, kind int, digest binary, doc_id long, row long, n long, buckets int, cells binary"
STORED, FILTER, INSERT, DELETE = 1, 0, 2, 3
LAST = (1 << 63) - 1


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; a fingerprint lies in one of two buckets."""

    def __init__(self, buckets: int = FIRST_BUCKETS, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = np.frombuffer(cells, np.uint16).copy() if cells else np.zeros(buckets * SLOTS, np.uint16)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") % 0xFFFF + 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _slot(self, bucket: int, mark: int) -> int:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if self.cells[i] == mark:
                return i
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def add(self, digest: bytes) -> bool:
        """False if no place was found; the filter is then to be rebuilt larger."""
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if (i := self._slot(bucket, 0)) >= 0:
                self.cells[i] = mark
                return True
        bucket = b
        for kick in range(KICKS):
            i = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.cells[i] = int(self.cells[i]), mark
            bucket = self._other(bucket, mark)
            if (free := self._slot(bucket, 0)) >= 0:
                self.cells[free] = mark
                return True
        return False

    def remove(self, digest: bytes) -> None:
        mark, a, b = self._places(digest)
        i = self._slot(a, mark)
        self.cells[i if i >= 0 else self._slot(b, mark)] = 0


class Shard:
    """A filter with the digests behind it, kept by bucket: {digest: [keep_id, keep_row, copies]}."""

    def __init__(self):
        self.filter, self.stored = None, {}

    def _bucket(self, digest: bytes) -> dict:
        return self.stored.setdefault(digest[10:13], {})

    def _digests(self):
        return (d for bucket in self.stored.values() for d in bucket)

    def _rebuild(self, buckets: int) -> None:
        while True:
            self.filter = CuckooFilter(buckets)
            if all(self.filter.add(d) for d in self._digests()):
                return
            buckets *= 2

    def load(self, digest: bytes, keep_id: int, keep_row: int, n: int) -> None:
        self._bucket(digest)[digest] = [keep_id, keep_row, n]

    def ready(self) -> None:
        if self.filter is None:
            self._rebuild(FIRST_BUCKETS)

    def find(self, digest: bytes):
        """The stored entry of a live digest: the filter first, then the bucket's content."""
        return self._bucket(digest).get(digest) if digest in self.filter else None

    def insert(self, digest: bytes, doc_id: int, row: int, n: int) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[:2] = min((entry[0], entry[1]), (doc_id, row))
            entry[2] += n
            return
        self.load(digest, doc_id, row, n)
        if not self.filter.add(digest):
            self._rebuild(2 * self.filter.buckets)

    def delete(self, digest: bytes, n: int) -> None:
        entry = self.find(digest)
        if entry is None:
            return
        entry[2] -= n
        if entry[2] <= 0:
            del self._bucket(digest)[digest]
            self.filter.remove(digest)

    def rows(self, shard: int) -> Iterator[tuple]:
        yield shard, FILTER, None, None, None, None, self.filter.buckets, self.filter.cells.tobytes()
        for bucket in self.stored.values():
            for digest, (keep_id, keep_row, n) in bucket.items():
                yield shard, STORED, digest, keep_id, keep_row, n, None, None


def _combine(kind: int, shards: int):
    """Per Arrow batch: one row for each digest, with its first row and the number of rows."""

    def combine(batches):
        for pdf in batches:
            pdf = pdf.sort_values(["doc_id", "row"])
            grouped = pdf.groupby("digest", sort=False)
            first = grouped.first()
            digests = list(first.index)
            yield pd.DataFrame(
                {
                    "shard": pd.array([int.from_bytes(d[13:21], "little") % shards for d in digests], dtype="Int32"),
                    "kind": pd.array([kind] * len(digests), dtype="Int32"),
                    "digest": digests,
                    "doc_id": first["doc_id"].to_numpy(),
                    "row": first["row"].to_numpy(),
                    "n": grouped.size().to_numpy(),
                    "buckets": pd.array([None] * len(digests), dtype="Int32"),
                    "cells": [None] * len(digests),
                }
            )

    return combine


def _update(batches):
    """Streams the events of shards, one shard after the other, and gives each shard's new rows."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in EVENT.split(", ")])

    def frame(rows):
        columns = zip(*rows) if rows else [[]] * len(schema.names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def closed(shard, number):
        shard.ready()
        buffer = []
        for row in shard.rows(number):
            buffer.append(row)
            if len(buffer) == 10_000:
                yield frame(buffer)
                buffer = []
        yield frame(buffer)

    shard, number, loading = None, None, True
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in schema.names]
        for s, kind, digest, doc_id, row, n, buckets, cells in zip(*columns):
            if s != number:
                if shard is not None:
                    yield from closed(shard, number)
                shard, number, loading = Shard(), s, True
            if kind == FILTER:
                shard.filter = CuckooFilter(buckets, cells)
            elif kind == STORED:
                shard.load(digest, doc_id, row, n)
            else:
                if loading:
                    shard.ready()
                    loading = False
                if kind == INSERT:
                    shard.insert(digest, doc_id, row, n)
                else:
                    shard.delete(digest, n)
    if shard is not None:
        yield from closed(shard, number)


def _dealt_anew(shards: int):
    """Stored digests as insertions into another number of shards; their filters are built again from these."""

    def deal(batches):
        for pdf in batches:
            pdf = pdf[pdf["kind"] == STORED]
            number = [int.from_bytes(bytes(d)[13:21], "little") % shards for d in pdf["digest"]]
            yield pdf.assign(shard=pd.array(number, dtype="Int32"), kind=pd.array([INSERT] * len(pdf), dtype="Int32"))

    return deal


class DigestIndex:
    """The index as a sequence of epochs below ``path``; ``state`` is the newest finished epoch, or None.

    An index opened on a path goes on from what was finished there, whoever wrote it. The number of shards
    grows with the digests: when they would pass SHARD_KEYS a shard, all are dealt anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 1):
        self.spark, self.path, self.shards = spark, path or new_path(spark, "digest-index"), shards
        done, _ = complete_parts(spark, self.path, "epoch")
        self.state = spark.read.schema(EVENT).parquet(done[-1]) if done else None
        if done:
            self.shards = int(done[-1].rpartition("=")[2])

    def apply(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
        """Insert and delete rows (digest, doc_id, row; deletions after insertions); gives the live digests."""
        parts = [x for x in ((INSERT, inserts), (DELETE, deletes)) if x[1] is not None]
        stored = self.state.where(F.col("kind") == STORED).count() if self.state is not None else 0
        least = -(-(stored + (inserts.count() if inserts is not None else 0)) // SHARD_KEYS)
        events, shards = self.state, self.shards
        if self.state is None:
            shards = max(least, shards, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        elif least > shards:
            shards = 2 * least
            events = self.state.mapInPandas(_dealt_anew(shards), EVENT)
        for kind, rows in parts:
            own = rows.select("digest", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "row")
            own = own.mapInPandas(_combine(kind, shards), EVENT)
            events = own if events is None else events.unionByName(own)
        keys = ["shard", "kind", "digest", "doc_id", "row"]
        state = events.repartition(shards, "shard").sortWithinPartitions(*keys).mapInArrow(_update, EVENT)
        path = f"{self.path}/epoch={complete_parts(self.spark, self.path, 'epoch')[1]}.shards={shards}"
        state.write.parquet(path)
        self.shards, self.state = shards, self.spark.read.schema(EVENT).parquet(path)
        return self.live()

    def live(self) -> DataFrame:
        return self.state.where(F.col("kind") == STORED).select(
            "digest", F.nullif("doc_id", F.lit(LAST)).alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")
        )


def digest(column: str = "text") -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text_of(column), SPACES, " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, row): written once, so that ``row`` tells repeated rows apart for good."""
    return materialise(docs.select(digest().alias("digest"), "doc_id", F.monotonically_increasing_id().alias("row")), "digests")


def decisions(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs)
    live = (index or DigestIndex(docs.sparkSession)).apply(inserts=rows)
    return rows.join(live, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only what goes is listed and, if its counted size allows, sent to where the texts are. Rows that
    repeat an id and a text can't be told apart by that list: of these, one is picked by number.
    """
    chosen = materialise(decisions(docs), "dedup-decisions")
    own, id_, number = new_names(docs, 3)
    row = [F.unhex("text_sha256").alias(own), F.coalesce("doc_id", F.lit(LAST)).alias(id_)]
    same = (digest() == F.col(own)) & (F.coalesce("doc_id", F.lit(LAST)) == F.col(id_))
    others = chosen.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*row)
    again = chosen.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).select(*row).distinct()
    gone = sized_side(materialise(others.unionByName(again), "dedup-gone"), 64)
    once = docs.join(gone, same, "left_anti")
    nth = F.row_number().over(Window.partitionBy(digest(), "doc_id").orderBy(F.lit(1)))
    again = sized_side(materialise(again, "dedup-again"), 64)
    repeated = docs.join(again, same, "left_semi").withColumn(number, nth).where(F.col(number) == 1).select(*docs.columns)
    return once.unionByName(repeated)
