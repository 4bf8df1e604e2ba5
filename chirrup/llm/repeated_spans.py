"""Removal of byte strings that occurred before, found on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes over it starts earlier too: in a document with a smaller
id, or earlier in the same one. Every such string (*window*) is looked at.

1. Copies of whole texts are set aside by digest: only the first can hold anything that stays.
2. Each window belongs to its smallest hashed ``GRAM`` bytes, leftmost if equal. Equal windows have
   equal grams, so they meet under one key; consecutive windows mostly share theirs and travel as a
   *run*. A run whose bytes equal those of an earlier run is marked as a whole. Runs that share their
   key with no other are done.
3. What is left are runs under one key with different bytes. Each is split at its gram into windows
   that reach far to the left and far to the right of it, and meets the others again by the longer
   piece all windows of a half have in common; halves alone under their key are done.
4. The remaining bytes are laid out in blocks, a key within one block. A block's suffixes are sorted
   and give its Burrows-Wheeler transform. From it alone the common prefixes of neighbouring suffixes
   follow by increasing value: an interval of suffixes that share n bytes, extended backwards by one
   symbol, yields intervals that share n + 1, so a boundary at n sets boundaries at n + 1, breadth
   first. At ``LENGTH`` the expansion stops: suffixes no boundary parts share a window. All but the
   first window of such an interval are marked.
5. A key with more bytes than a block takes is settled by 128-bit hashes of its windows instead,
   grouped by Spark, so no key can fill a task.

Nulls and other cases: a null text is empty; null ids are larger than all others; documents that
repeat an id are told apart by a digest of their text, which also orders them; rows equal in id and
text are copies, the first of which stays; texts shorter than ``LENGTH`` keep everything; empty tables
give empty results; very long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chirrup.llm import bytewise
from chirrup.llm.common import sized_side, text_of
from chirrup.session import materialise

LENGTH = 100
GRAM = 24
REACH = 38  # a window reaches far left if its gram starts that far inside
BLOCK = 1 << 20  # bytes
WHOLE_KEY = 8 << 20  # bytes of one key that a block may grow to
LAST = (1 << 63) - 1
SEPARATOR = 0xFF  # in no UTF-8 text
U64 = np.uint64

# a place: 16 bits of the text's digest, 33 of the start, 7 of the number of windows, 7 of the gram's offset


def packed(start, windows, offset):
    return (start << 14) | (windows << 7) | offset


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same smallest gram: (text, start, windows, offset of the gram, gram's hash, hash of all bytes)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(U64), none.view(U64)
    sums = bytewise.prefix_sums(bytewise.byte_values(data))
    at = np.arange(n - GRAM + 1)
    grams = bytewise.range_hash(sums, at, at + GRAM)
    least, index, width, wanted = grams, at, 1, LENGTH - GRAM + 1
    while width < wanted:
        step = min(width, wanted - width)
        later = least[step:] < least[:-step]
        least, index = np.where(later, least[step:], least[:-step]), np.where(later, index[step:], index[:-step])
        width += step
    start = np.arange(len(index))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = offsets[text + 1] - start >= LENGTH
    new = np.ones(len(start), bool)
    new[1:] = (index[1:] != index[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    count = np.diff([*first, len(start)])
    first, count = first[inside[first]], count[inside[first]]
    gram = index[first]
    return text[first], first - offsets[text[first]], count, gram - first, grams[gram], bytewise.range_hash(sums, first, first + count + LENGTH - 1)


def _describe(batches):
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("at", pa.int64())])
    for b in batches:
        ids = b.column("id").to_numpy()
        for row, _, data, offsets in bytewise.slices(pa.array(_restored(b.column("text")), pa.large_binary())):
            text, start, count, offset, key, content = runs(data, offsets)
            text = text + row
            arrays = [key.view(np.int64), content.view(np.int64), ids[text], packed(start, count, offset)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=schema)


def _by_key(batches, names, most: int):
    """Arrays of whole keys from rows sorted by ``key``; a key with more than ``most`` rows comes in parts.

    Also gives whether the first key of the arrays goes on from the arrays before.
    """
    held, parted = None, None  # the key that has come in part
    for b in batches:
        part = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield [x[:cut] for x in held], parted is not None and held[0][0] == parted
            parted, held = None, [x[cut:] for x in held]
        if len(held[0]) > most:
            yield held, parted is not None and held[0][0] == parted
            parted, held = held[0][0], [x[:0] for x in held]
    if held is not None and len(held[0]):
        yield held, parted is not None and held[0][0] == parted


def _settle(batches):
    """Of runs sorted by (key, content, id, at): copies of a run (marks), and firsts of keys with several contents."""
    schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("open", pa.bool_())])
    before, several = None, False  # of a key that comes in parts: its last row, and whether more than one content came
    waiting = None
    for (key, content, ids, at), goes_on in _by_key(batches, ["key", "content", "id", "at"], 500_000):
        same_key = np.concatenate([[goes_on], key[1:] == key[:-1]])
        same_content = same_key.copy()
        same_content[1:] &= content[1:] == content[:-1]
        same_row = same_content.copy()
        same_row[1:] &= (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
        if goes_on:
            same_content[0] = content[0] == before[0]
            same_row[0] = before == (content[0], ids[0], at[0])
        first = ~same_content
        group = np.cumsum(~same_key) - (0 if goes_on else 1)
        contents = np.bincount(group, weights=first)
        if goes_on and (several or contents[0] > 0):
            if waiting is not None and contents[0] > 0:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*waiting, True)], schema=schema)
                waiting = None
            several = True
            contents[0] = 2
        open_ = first & (contents[group] >= 2)
        marked = same_content & ~same_row
        pick = open_ | marked
        yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array(at[pick]), pa.array(key[pick]), pa.array(open_[pick])], schema=schema)
        before = (content[-1], ids[-1], at[-1])
        if not (goes_on and len(contents) == 1):
            several = contents[-1] >= 2
            tail = np.flatnonzero(group == group[-1])[0]
            waiting = None if several else (ids[tail], at[tail], key[tail])


def _halves(batches):
    """Bytes of the asked runs, split at the gram: (key, content, id, at, bytes), one row per half."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
    for b in batches:
        ids, asked = b.column("id").to_numpy(), b.column("asked")
        for row, end, data, offsets in bytewise.slices(pa.array(_restored(b.column("text")), pa.large_binary())):
            raw, sums = data.tobytes(), bytewise.prefix_sums(bytewise.byte_values(data))
            out: list[list] = [[], [], [], [], []]
            places = [np.asarray(asked[i].values.to_numpy(), np.int64) for i in range(row, end)]
            count = np.array([len(p) for p in places])
            at = np.concatenate(places)
            base, owner = np.repeat(offsets[:-1], count), np.repeat(np.arange(row, end), count)
            start, windows, offset = at >> 14, (at >> 7) & 127, at & 127
            left = np.clip(offset - REACH + 1, 0, windows)  # windows whose gram starts at REACH or later
            for side, a, n, lo, hi in ((0, start, left, offset - REACH, offset + GRAM), (1, start + left, windows - left, offset, offset + LENGTH - REACH)):
                some = np.flatnonzero(n > 0)
                a, n, o, i = a[some], n[some], base[some], owner[some]
                key = bytewise.range_hash(sums, o + start[some] + lo[some], o + start[some] + hi[some]) ^ U64(side)
                content = bytewise.range_hash(sums, o + a, o + a + n + LENGTH - 1)
                out[0].append(key.view(np.int64))
                out[1].append(content.view(np.int64))
                out[2].append(ids[i])
                out[3].append(packed(a, n, 0))
                out[4] += [raw[x : x + m] for x, m in zip((o + a).tolist(), (n + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in out[:4]], pa.array(out[4], pa.binary())], schema=schema)


# ---- the transform -----------------------------------------------------------------------------


def sorted_suffixes(data: np.ndarray) -> np.ndarray:
    """Suffixes in order of at least their first 128 bytes, wrapping around, by prefix doubling."""
    n = len(data)
    key = data.astype(U64)
    for k in (1, 2, 4):
        key = (key << U64(8 * k)) | np.roll(key, -k)
    depth = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], (ranked[1:] != ranked[:-1])]).cumsum()
        if depth >= 128 or new[-1] == n - 1:
            return order
        rank = np.empty(n, U64)
        rank[order] = new.astype(U64)
        key = (rank << U64(32)) | np.roll(rank, -(depth % n))
        depth *= 2


def boundaries(transform: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares fewer than ``length`` bytes with the one before it in order.

    Works on the transform alone. ``back[k]`` is the place of the suffix that begins one symbol later
    than the k-th; an interval's boundaries at level n, seen through it, are those at level n + 1.
    """
    back = np.argsort(transform, kind="stable")
    symbols = transform[back]
    parted = np.ones(len(transform), bool)
    parted[1:] = symbols[1:] != symbols[:-1]
    open_ = np.flatnonzero(~parted)
    low, high = back[open_ - 1], back[open_]
    for _ in range(1, length):
        interval = np.cumsum(parted, dtype=np.int32)
        set_now = interval[low] != interval[high]
        if not set_now.any():
            break  # what is left repeats for ever
        parted[open_[set_now]] = True
        rest = ~set_now
        open_, low, high = open_[rest], low[rest], high[rest]
    return parted


def repeats(segments: list[bytes], order: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that occurs before, in a block of segments.

    ``order`` ranks the segments' documents; a document's segments are ordered by ``start``.
    """
    separator = bytes([SEPARATOR])
    data = np.frombuffer(separator.join(segments) + separator, np.uint8)
    length = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    suffixes = sorted_suffixes(data)
    parted = boundaries(data[suffixes - 1], LENGTH)
    interval = np.cumsum(parted)
    several = np.zeros(len(data), bool)  # intervals with more than one suffix
    several[1:] = ~parted[1:]
    several[:-1] |= ~parted[1:]
    suffixes, interval = suffixes[several], interval[several]
    segment = np.searchsorted(begin, suffixes, "right") - 1
    window = suffixes - begin[segment]
    inside = window < windows[segment]
    segment, window, interval = segment[inside], window[inside], interval[inside]
    first = np.lexsort((start[segment] + window, order[segment], interval))
    segment, window, interval = segment[first], window[first], interval[first]
    again = np.concatenate([[False], interval[1:] == interval[:-1]])
    return segment[again], window[again]


def _expand(batches):
    """Marks within blocks of halves sorted by (key, content, id, at), and windows of keys too large for a block."""
    schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def rows(ids, at, high=None, low=None):
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), none if high is None else pa.array(high), none if low is None else pa.array(low)], schema=schema)

    def block(held):
        ids = np.array([r[2] for r in held], np.int64)
        at = np.array([r[3] for r in held], np.int64)
        start, windows = at >> 14, (at >> 7) & 127
        segment, window = repeats([r[4] for r in held], ids, start, windows)
        by = np.lexsort((window, segment))
        segment, window = segment[by], window[by]
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff([*first, len(segment)])
        s = segment[first]
        return rows(ids[s], packed(start[s] + window[first], count, 0))

    def windows_of(held):
        """All windows of these halves with two hashes each."""
        for key, content, id_, at, raw in held:
            data = np.frombuffer(raw, np.uint8)
            n = (at >> 7) & 127
            places = np.arange(n)
            high = bytewise.range_hash(bytewise.prefix_sums(bytewise.byte_values(data)), places, places + LENGTH)
            other = bytewise.byte_values(data ^ np.uint8(0x55)) * U64(0xD6E8FEB86659FD93)
            low = bytewise.range_hash(bytewise.prefix_sums(other), places, places + LENGTH)
            yield np.full(n, id_), packed((at >> 14) + places, 1, 0), high.view(np.int64), low.view(np.int64)

    def spill(halves):
        parts = list(windows_of(halves))
        return rows(*[np.concatenate(x) for x in zip(*parts)])

    held, size = [], 0  # halves of the block to come
    own, own_size, key, before, large = [], 0, None, None, False  # of the key at hand, one per content
    copies: list[tuple[int, int]] = []
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("key", "content", "id", "at", "bytes")]):
            if row[0] != key:
                if large and own:
                    yield spill(own)
                elif len(own) > 1:
                    held, size = held + own, size + own_size
                if size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
                own, own_size, key, before, large = [], 0, row[0], None, False
            if before is not None and row[1] == before[1]:
                if row[2:4] != before[2:4]:
                    copies.append(row[2:4])
                continue
            before = row
            own.append(row)
            own_size += len(row[4])
            if own_size > (BLOCK if large else WHOLE_KEY):
                yield spill(own)
                own, own_size, large = [], 0, True
        if copies:
            yield rows(*zip(*copies))
            copies = []
    if large and own:
        yield spill(own)
    elif len(own) > 1:
        held += own
    if held:
        yield block(held)


def _squeezed(batches):
    """Texts as zstandard frames, so that shuffles move fewer bytes; of rows equal in id and text the task's first."""
    import zstandard

    squeeze, seen = zstandard.ZstdCompressor(level=3), set()
    for b in batches:
        texts, rows = [], []
        for k, (key, text) in enumerate(zip(zip(b.column("id").to_pylist(), b.column("digest").to_pylist()), b.column("text"))):
            if key in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(key)
            rows.append(k)
            texts.append(squeeze.compress(text.as_py()))
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "digest")], pa.array(texts, pa.binary())], ["id", "digest", "text"])


def _restored(column) -> list[bytes]:
    import zstandard

    restore = zstandard.ZstdDecompressor()
    return [restore.decompress(x) for x in column.to_pylist()]


def _cut(batches):
    """Removes the marked windows' bytes: (id, n_removed, n_spans, kept_sha256)."""
    schema = pa.schema([("id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for b in batches:
        out = []
        for id_, raw, marks in zip(b.column("id").to_pylist(), _restored(b.column("text")), b.column("marks")):
            at = marks.values.to_numpy()
            start, windows = at >> 14, (at >> 7) & 127
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + windows + LENGTH - 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((id_, int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def removed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = text_of()
    own = [F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest")]
    rows = materialise(docs.select("doc_id", *own, F.octet_length(text).cast("long").alias("n_bytes")), "spans-rows")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.first("n_bytes").alias("n_bytes"))
    # a text's number orders the texts as their documents: sorted ranges, numbered in place, written once
    ordered = firsts.repartitionByRange("first", "digest").sortWithinPartitions("first", "digest")
    firsts = materialise(ordered.select("digest", "first", "n_bytes", F.monotonically_increasing_id().alias("number")), "spans-firsts")
    long_ones = firsts.where(F.col("n_bytes") >= LENGTH).select("digest", F.col("first").alias("id"), "number")
    squeezed = docs.select(*own, text.cast("binary").alias("text")).where(F.octet_length("text") >= LENGTH).mapInArrow(_squeezed, "id long, digest binary, text binary")
    texts = materialise(squeezed.join(long_ones, ["id", "digest"]).select(F.col("number").alias("id"), "text"), "spans-texts")

    described = texts.mapInArrow(_describe, "key long, content long, id long, at long")
    settled = described.repartition("key").sortWithinPartitions("key", "content", "id", "at").mapInArrow(_settle, "id long, at long, key long, open boolean")
    settled = materialise(settled, "spans-runs")

    asked = settled.where("open").groupBy("id").agg(F.collect_list("at").alias("asked"))  # as many as a text has runs
    halves = texts.join(asked.hint("shuffle_hash"), "id").select("id", "asked", "text").mapInArrow(_halves, "key long, content long, id long, at long, bytes binary")
    found = halves.repartition("key").sortWithinPartitions("key", "content", "id", "at").mapInArrow(_expand, "id long, at long, high long, low long")
    found = materialise(found, "spans-found")

    windows = found.where("high IS NOT NULL")
    earliest = windows.groupBy("high", "low").agg(F.min(F.struct("id", "at")).alias("first"))
    late = windows.join(earliest, ["high", "low"]).where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    marks = settled.where("NOT open").select("id", "at").union(found.where("high IS NULL").select("id", "at")).union(late.select("id", "at"))
    marks = marks.groupBy("id").agg(F.collect_list("at").alias("marks"))
    cut = texts.join(marks.hint("shuffle_hash"), "id").select("id", "text", "marks").mapInArrow(_cut, "id long, n_removed long, n_spans long, kept_sha256 string")
    cut = cut.dropDuplicates(["id"]).withColumnRenamed("id", "number")  # rows equal in id and text were cut alike

    nth = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(1)))
    every = rows.withColumn("nth", nth).join(firsts.select("digest", "first", "number"), "digest").join(cut, "number", "left")
    copy, long_enough = (F.col("id") > F.col("first")) | (F.col("nth") > 1), F.col("n_bytes") >= LENGTH
    return every.select(
        "doc_id",
        "n_bytes",
        F.when(copy & long_enough, F.col("n_bytes")).when(copy, 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy & long_enough, 1).when(copy, 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy & long_enough, F.sha2(F.lit(""), 256))
        .when(copy | F.col("kept_sha256").isNull(), F.lower(F.hex("digest")))
        .otherwise(F.col("kept_sha256"))
        .alias("kept_sha256"),
    )
