"""Documents linked by the Jaccard similarity of their word shingles, and what these links connect.

Two documents link when 4 |A & B| >= 3 |A | B| over their sets of distinct five-word shingles.
Documents with the same set are one *unit*; all work is on units.

1. Frequent words, and shingles that very many documents share, are counted in sketches of fixed size.
2. All shingles have one order: widely shared ones last, before that those of rarer words first,
   then by hash. Any one order would do; in this one few units share a key by chance. Units that link share one of
   the first n - ceil(3n/4) + 1 shingles of either (their *keys*), so units are dealt out by these.
   Where two units share a key, their sizes and the key's places in both tell whether it can be the
   first that a linking pair shares; units without such a partner leave.
3. The shingles of a unit are counted by hash group, which makes the unit a point. Per key an R-tree
   over the points of its units is searched: a node's corner of coordinate maxima, and then a point
   itself, bounds the overlap by the sum of the smaller coordinates. What can reach the needed
   overlap is a candidate.
4. Candidates are verified on the full sets. Links join components. A pair within a component need
   not be looked at, so a first round takes few keys and one candidate per unit and key, which joins
   nearly all near copies at about one verification each. Then all keys are searched for pairs
   between components; those with more candidates than asked for are searched again with a higher
   limit, the last time without one, so no link between components is lost. Of many copies that lie
   about the threshold, each links with one of a few others almost surely: they are one component
   before the round that would propose all their pairs.

Nulls and other cases: texts without words have the empty set, link with nothing and are components
of their own; null ids are smaller than none: they never name a component unless all ids in it are
null; copies and repeated rows are in one component; empty tables give empty results; very long
texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chirrup.llm import bytewise
from chirrup.llm.common import new_names, sized_side, text_of
from chirrup.llm.components import components
from chirrup.session import materialise

WIDTH = 5
SKETCH = 1 << 20  # buckets of shingles
WORD_SKETCH = 1 << 16  # buckets of words
LEAF = 32
FIRST_KEYS = 4  # of each unit, in the first round
ROUNDS = (2, 8, 32, None)  # candidates per unit and key in the rounds over all keys; the last has no limit
LAST = (1 << 63) - 1


def needed_prefix(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def linked(overlap, n_a, n_b):
    """4 * overlap >= 3 * (n_a + n_b - overlap)."""
    return 7 * overlap >= 3 * (n_a + n_b)


def set_key(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


# ---- frequent shingles -------------------------------------------------------------------------


def _sketch(batches):
    """A task's counts of shingles and, behind them, of words by bucket.

    Of shingles only buckets well above the task's mean are passed on.
    """
    counts, words = np.zeros(SKETCH, np.int64), np.zeros(WORD_SKETCH, np.int64)
    for b in batches:
        for _, _, data, offsets in bytewise.slices(b.column(0)):
            for s in bytewise.shingle_sets(data, offsets, WIDTH):
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            words += np.bincount(bytewise.word_buckets(bytewise.word_hashes(data, offsets)[0], WORD_SKETCH), minlength=WORD_SKETCH)
    heavy, common = np.flatnonzero(counts >= 16 + 2 * counts.mean()), np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([heavy, SKETCH + common])), pa.array(np.concatenate([counts[heavy], words[common]]))], ["bucket", "n"])


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of widely shared shingles, their level (log2 of the count), and a weight per bucket of words.

    The driver receives SKETCH + WORD_SKETCH numbers at most.
    """
    rows = docs.select(text_of().alias("text")).mapInArrow(_sketch, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = rows.where((F.col("bucket") >= SKETCH) | (F.col("n") >= 64)).toPandas().sort_values("bucket")
    bucket, level = rows["bucket"].to_numpy(np.int64), np.log2(rows["n"].to_numpy(np.float64) + 1)
    word = bucket >= SKETCH
    weights = np.zeros(WORD_SKETCH, np.float32)
    weights[bucket[word] - SKETCH] = level[word]
    return bucket[~word], level[~word].astype(np.int8), weights


# ---- units -------------------------------------------------------------------------------------


def group_counts(shingles: np.ndarray) -> bytes:
    """Shingles counted by their leading bits, in about as many groups as shingles (a power of two).

    Counts take two bits; what they hold above three is added up in the four bytes before them.
    """
    bits = max(4, round(np.log2(max(len(shingles), 1))))
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    low = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    packed = low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6
    return np.uint32(np.maximum(counts - 3, 0).sum()).tobytes() + packed.astype(np.uint8).tobytes()


def point_of(stored: bytes) -> tuple[np.ndarray, int]:
    """Counts up to three of each group, and what is above."""
    packed = np.frombuffer(stored, np.uint8, offset=4)
    return np.stack([packed >> shift & 3 for shift in (0, 2, 4, 6)], axis=1).ravel(), int(np.frombuffer(stored, np.uint32, 1)[0])


def units(docs: DataFrame) -> DataFrame:
    """Per row doc_id, tag (of the text), n (shingles), unit; where the set is new to the task also its keys and point."""
    buckets, levels, weights = frequent(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("unit", pa.int64()), ("sigs", pa.list_(pa.int64())), ("point", pa.binary())])

    def describe(batches):
        level = np.zeros(SKETCH, np.int8)
        level[buckets] = levels
        seen: set[int] = set()
        for b in batches:
            ids, tags = b.column("doc_id"), b.column("tag")
            for first, end, data, offsets in bytewise.slices(b.column("text")):
                out = ([], [], [], [])
                for s, words in bytewise.shingle_sets(data, offsets, WIDTH, weights):
                    key = set_key(s)
                    new = len(s) > 0 and key not in seen
                    if new:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(key)
                        order = np.lexsort((s, words, level[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))
                        sigs, point = s[order[: needed_prefix(len(s))]].view(np.int64), group_counts(s)
                    for column, value in zip(out, (len(s), key, sigs if new else None, point if new else None)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([ids.slice(first, end - first), tags.slice(first, end - first), *[pa.array(c, schema.field(i + 2).type) for i, c in enumerate(out)]], schema=schema)

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tag"), text_of().alias("text"))
    return materialise(rows.mapInArrow(describe, "doc_id long, tag long, n long, unit long, sigs array<long>, point binary"), "jaccard-units")


def _whole_keys(batches):
    """Tables of whole keys from rows sorted by ``sig``."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b])
        table = table if rest is None else pa.concat_tables([rest, table])
        s = table.column("sig").to_numpy()
        cut = int(np.searchsorted(s, s[-1])) if len(s) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs_within(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (later, earlier) of all pairs within each of several short runs of rows."""
    place = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
    later = np.repeat(np.repeat(starts, lengths) + place, place)
    earlier = later - np.repeat(place, place) + (np.concatenate([np.arange(k) for k in place]) if len(place) else place)
    return later, earlier


def _has_partner(size: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of the units of one key: which pass the bound of sizes and places with another of them.

    x and y pass if 7 * min(after) >= 3 * (size x + size y), that is if neither is larger than the
    partner that the other's place leaves room for. The two largest rooms among the units up to
    each size tell whether one of them, other than x, has room for x.
    """
    room = 7 * after // 3 - size
    order = np.argsort(size, kind="stable")
    rooms = room[order]
    best = np.maximum.accumulate(rooms)
    # the second largest so far: what a new value leaves below the largest one before it
    second = np.maximum.accumulate(np.concatenate([[np.iinfo(np.int64).min], np.minimum(rooms[1:], best[:-1])]))
    upto = np.searchsorted(size[order], room, side="right") - 1
    at = np.maximum(upto, 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = (rank <= upto) & (room >= best[at])
    return (upto >= 0) & (np.where(own, second[at], best[at]) >= size)


def _plausible(batches):
    """Of rows (sig, unit, at, label) sorted by sig and unit: those with a partner that may link with them.

    ``at`` holds the set's size and the place of the key in it. If the key is the first that a pair
    shares, what comes before it in either set is in that set alone, which bounds the overlap; a
    pair that links passes at its first common key. Long runs of rows must hold more than one
    component, and are looked at without pairs.
    """
    for table in _whole_keys(batches):
        s, u, at, label = (table.column(c).to_numpy() for c in ("sig", "unit", "at", "label"))
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (u[1:] != u[:-1])
        s, u, at, label = s[new], u[new], at[new], label[new]
        size, after = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)  # after: this key and what follows it
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        lengths = np.diff([*starts, len(s)])
        keep = np.zeros(len(s), bool)
        small = (lengths > 1) & (lengths <= LEAF)
        x, y = _pairs_within(starts[small], lengths[small])
        ok = (label[x] != label[y]) & (7 * np.minimum(after[x], after[y]) >= 3 * (size[x] + size[y]))
        keep[x[ok]] = keep[y[ok]] = True
        large = lengths > LEAF
        if large.any():
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            for a, m in zip(starts[large & mixed], lengths[large & mixed]):
                keep[a : a + m] = _has_partner(size[a : a + m], after[a : a + m])
        yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(u[keep]), pa.array(at[keep])], ["sig", "unit", "at"])


# ---- candidates --------------------------------------------------------------------------------


def folded(point: np.ndarray, size: int) -> np.ndarray:
    """A point in fewer groups: neighbouring groups together."""
    return point if len(point) == size else np.minimum(point.reshape(size, -1).sum(axis=1), 255).astype(np.uint8)  # of two groups: 6 at most


class Tree:
    """An R-tree of two levels over points of one dimension, packed in order of units."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray, after: np.ndarray, points: np.ndarray, above: np.ndarray, labels: np.ndarray):
        self.index, self.sizes, self.after, self.points, self.above, self.labels = index, sizes, after, points, above, labels
        self.starts = starts = np.arange(0, len(index), LEAF)
        self.top, self.top_above = np.maximum.reduceat(points, starts, axis=0), np.maximum.reduceat(above, starts)
        self.low, self.high = np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts)
        self.one = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)

    def search(self, point: np.ndarray, above: int, n: int, after: int, label: int, before: int) -> Iterator[np.ndarray]:
        """Indices, below ``before`` and ascending, of units of other components that may link."""
        near = (4 * self.high >= 3 * n) & (3 * self.low <= 4 * n) & ~((self.one[0] == label) & (self.one[1] == label))
        leaves = np.flatnonzero(near & (self.index[self.starts] < before))
        a, width = 0, 1
        while a < len(leaves):
            some = leaves[a : a + width]
            a, width = a + width, min(2 * width, 256)
            bound = np.minimum(self.top[some], point).sum(axis=1, dtype=np.int64) + np.minimum(self.top_above[some], above)
            some = some[7 * bound >= 3 * (n + self.low[some])]
            rows = (self.starts[some][:, None] + np.arange(LEAF)).ravel()
            rows = rows[rows < len(self.index)]
            rows = rows[(self.index[rows] < before) & (self.labels[rows] != label) & (7 * np.minimum(self.after[rows], after) >= 3 * (n + self.sizes[rows]))]
            if len(rows):
                bound = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64) + np.minimum(self.above[rows], above)
                rows = rows[7 * bound >= 3 * (n + self.sizes[rows])]
                if len(rows):
                    yield self.index[rows]


def search_posting(sizes: np.ndarray, after: np.ndarray, points: list[np.ndarray], above: np.ndarray, labels: np.ndarray, most: int | None) -> tuple[list[tuple[int, int]], bool]:
    """Candidates (later, earlier index) among many units of one key, by an R-tree per dimension.

    At most ``most`` for each unit; also tells whether that left any out.
    """
    if (labels == labels[0]).all():
        return [], False
    dims = np.array([len(x) for x in points])
    trees: dict[tuple[int, int], Tree | None] = {}

    def tree(dim: int, size: int) -> Tree | None:
        """Over the units with ``dim`` groups, folded to ``size``."""
        if (dim, size) not in trees:
            own = np.flatnonzero(dims == dim)
            trees[dim, size] = Tree(own, sizes[own], after[own], np.stack([folded(points[i], size) for i in own]), above[own], labels[own]) if len(own) else None
        return trees[dim, size]

    pairs, more = [], False
    for i in range(1, len(points)):
        left = most if most is not None else len(points)
        for dim in (dims[i] // 2, dims[i], dims[i] * 2):
            size = int(min(dim, dims[i]))
            t = tree(int(dim), size)
            for found in t.search(folded(points[i], size), int(above[i]), int(sizes[i]), int(after[i]), int(labels[i]), i) if t is not None else ():
                pairs += [(i, int(j)) for j in found[:left]]
                more |= len(found) > left
                left -= min(left, len(found))
                if not left:  # there may be more
                    more = True
                    break
            if not left:
                break
    return pairs, more


def search_small(
    starts: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, after: np.ndarray, points: list[np.ndarray], above: np.ndarray, labels: np.ndarray, most: int | None
):
    """The same for many keys with up to a leaf of units each, all at once: (later, earlier, key left out)."""
    later, earlier = _pairs_within(starts, lengths)
    ok = (labels[later] != labels[earlier]) & (7 * np.minimum(after[later], after[earlier]) >= 3 * (sizes[later] + sizes[earlier]))
    later, earlier = later[ok], earlier[ok]
    dims = np.array([len(x) for x in points], dtype=np.int64)
    good = np.zeros(len(later), bool)
    for dim in np.unique(np.minimum(dims[later], dims[earlier])) if len(later) else ():
        mine = np.flatnonzero(np.minimum(dims[later], dims[earlier]) == dim)
        used, at = np.unique(np.concatenate([later[mine], earlier[mine]]), return_inverse=True)
        matrix = np.stack([folded(points[i], int(dim)) for i in used])
        x, y = at[: len(mine)], at[len(mine) :]
        step = max(1, (1 << 24) // int(dim))
        for a in range(0, len(mine), step):
            part = slice(a, a + step)
            i, j = later[mine[part]], earlier[mine[part]]
            bound = np.minimum(matrix[x[part]], matrix[y[part]]).sum(axis=1, dtype=np.int64) + np.minimum(above[i], above[j])
            good[mine[part]] = 7 * bound >= 3 * (sizes[i] + sizes[j])
    later, earlier = later[good], earlier[good]
    if most is None or not len(later):
        return later, earlier, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
    rank = np.arange(len(later)) - np.repeat(first, np.diff([*first, len(later)]))
    return later[rank < most], earlier[rank < most], later[rank >= most]


def _candidates(most: int | None):
    """Of rows sorted by (sig, unit): candidate pairs, and keys for which pairs were left out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("again", pa.int64())])

    def run(batches):
        for table in _whole_keys(batches):
            yield emit(table)

    def emit(table):
        s, u = table.column("sig").to_numpy(), table.column("unit").to_numpy()
        at, label = table.column("at").to_numpy(), table.column("label").to_numpy()
        n, after = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
        points, above = zip(*[point_of(x) for x in table.column("point").to_pylist()])
        above = np.array(above, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        lengths = np.diff([*starts, len(s)])
        small = lengths <= LEAF
        x, y, out = search_small(starts[small], lengths[small], n, after, points, above, label, most)
        again = set(s[out].tolist())
        pairs = set(zip(u[y].tolist(), u[x].tolist()))
        for a, m in zip(starts[~small], lengths[~small]):
            found, more = search_posting(n[a : a + m], after[a : a + m], points[a : a + m], above[a : a + m], label[a : a + m], most)
            pairs.update((int(u[a + j]), int(u[a + i])) for i, j in found)
            if more:
                again.add(int(s[a]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs] + [None] * len(again), pa.int64()),
                pa.array([p[1] for p in pairs] + [None] * len(again), pa.int64()),
                pa.array([None] * len(pairs) + list(again), pa.int64()),
            ],
            schema=schema,
        )

    return run


def _once(batches):
    """Of rows (unit, text), the first of each unit in this task: rows that repeat id and text are not moved again and again."""
    seen: set[int] = set()
    for b in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        new = np.zeros(b.num_rows, bool)
        for k, unit in enumerate(b.column(0).to_pylist()):
            new[k] = unit not in seen
            seen.add(unit)
        yield b.filter(pa.array(new))


def verify(pairs: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, linked) for pairs of units, from the full sets of one text each.

    The texts of a pair meet at its first unit, dealt out by the second in eight parts, so that a
    unit in very many pairs is spread; a task holds one set and the one compared with it.
    """
    wanted = pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct()
    first = sized_side(materialise(distinct.select("unit", "at.at", "at.tag").join(wanted, "unit", "left_semi"), "jaccard-wanted"), 32)
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.xxhash64(text_of()).alias("tag"), text_of().alias("text"))
    texts = texts.join(first, ["at", "tag"]).select("unit", "text").mapInArrow(_once, "unit long, text string")
    texts = materialise(texts, "jaccard-texts")
    part = F.pmod(F.xxhash64("b"), F.lit(8))
    dealt = pairs.select("a", "b", part.alias("part"))
    left = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("unit", "a"), "a").select("a", "part", F.col("a").alias("unit"), F.lit(0).alias("side"), "text")
    right = dealt.join(texts.withColumnRenamed("unit", "b"), "b").select("a", "part", F.col("b").alias("unit"), F.lit(1).alias("side"), "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def compare(batches):
        key, own, done = None, None, None
        for b in batches:
            out = []
            text = b.column(b.schema.get_field_index("text"))
            sets = [s for _, _, data, offsets in bytewise.slices(text) for s in bytewise.shingle_sets(data, offsets, WIDTH)]
            for a, part_, unit, side, s in zip(*[b.column(c).to_pylist() for c in ("a", "part", "unit", "side")], sets):
                if key != (a, part_):
                    key, own, done = (a, part_), None, None
                if set_key(s) != unit:  # another row with this id
                    continue
                if side == 0:
                    own = s
                elif unit != done and own is not None:
                    done = unit
                    overlap = len(np.intersect1d(own, s, assume_unique=True))
                    out.append((a, unit, bool(linked(overlap, len(own), len(s)))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    rows = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "side", "unit")
    return rows.mapInArrow(compare, "a long, b long, linked boolean")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with the label of each unit's component, its own number where it has no links yet."""
    if labels is None:
        return rows.withColumn("label", F.col("unit"))
    return rows.join(sized_side(labels, 24), "unit", "left").withColumn("label", F.coalesce("label", "unit"))


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("sig").sortWithinPartitions("sig", "unit")


def unit_components(docs: DataFrame, described: DataFrame) -> DataFrame | None:
    """(unit, label) of units that link with others; None if there are none."""
    new = described.where(F.col("sigs").isNotNull())
    at = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("at"), "tag")).alias("at")
    distinct = described.where("n > 0").groupBy("unit").agg(F.first("n").alias("n"), F.first("point", ignorenulls=True).alias("point"), at)
    distinct = materialise(distinct, "jaccard-distinct")
    place = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at")
    rows_of = lambda keys: new.select("unit", "n", F.posexplode(keys).alias("pos", "sig")).select("sig", "unit", place)
    checked = labels = None

    def search(shared: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        """One round: links of new candidates join ``checked`` and ``labels``; gives what to search again."""
        nonlocal checked, labels
        plausible = materialise(_by_key(_labelled(shared, labels)).mapInArrow(_plausible, "sig long, unit long, at long"), "jaccard-shared")
        # by a shuffle at every size: the points are as many as the units
        rows = _labelled(plausible.join(distinct.select("unit", "point").hint("merge"), "unit"), labels)
        found = _by_key(rows.select("sig", "unit", "at", "point", "label")).mapInArrow(_candidates(most), "a long, b long, again long")
        found = materialise(found.distinct(), "jaccard-found")
        pairs = found.where("a IS NOT NULL").select("a", "b")
        pairs = pairs if checked is None else materialise(pairs.join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not pairs.isEmpty():
            verified = materialise(verify(pairs, docs, distinct), "jaccard-links")
            checked = verified if checked is None else checked.unionByName(verified)
            labels = components(checked.where("linked")).select(F.col("vertex").alias("unit"), F.col("component").alias("label"))
            labels = materialise(labels, "jaccard-labels")
        return plausible, found.where("again IS NOT NULL").select(F.col("again").alias("sig"))

    search(rows_of(F.slice("sigs", 1, FIRST_KEYS)), 1)
    shared = rows_of(F.col("sigs"))
    for most in ROUNDS:
        plausible, again = search(shared, most)
        if again.isEmpty():
            break
        shared = plausible.join(again, "sig", "left_semi")
    return labels


def _with_first(docs: DataFrame) -> DataFrame:
    """Per row doc_id, tag, n and ``first``: (id, tag) of the first row of its component; null for empty sets."""
    described = units(docs)
    labels = unit_components(docs, described)
    row = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "tag")
    own = described.where("n > 0").groupBy("unit").agg(F.min(row).alias("first"))
    if labels is not None:
        own = own.join(labels, "unit", "left")
        whole = own.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("first").alias("whole"))
        own = own.join(whole, "label", "left").withColumn("first", F.coalesce("whole", "first"))
    return described.select("doc_id", "tag", "n", "unit").join(own.select("unit", "first"), "unit", "left").drop("unit")


def linked_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    component = F.when(F.col("n") > 0, F.nullif("first.id", F.lit(LAST))).otherwise(F.col("doc_id"))
    return _with_first(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not the first of their component, with all their columns.

    Rows equal in id and text are one document here. What goes is less than what stays, so only the
    list of what goes is moved, if its counted size allows.
    """
    rows = _with_first(docs).where((F.col("n") > 0) & ((F.coalesce("doc_id", F.lit(LAST)) != F.col("first.id")) | (F.col("tag") != F.col("first.tag"))))
    id_, tag = new_names(docs, 2)
    gone = sized_side(materialise(rows.select(F.coalesce("doc_id", F.lit(LAST)).alias(id_), F.col("tag").alias(tag)), "jaccard-gone"), 24)
    return docs.join(gone, (F.coalesce("doc_id", F.lit(LAST)) == F.col(id_)) & (F.xxhash64(text_of()) == F.col(tag)), "left_anti")
