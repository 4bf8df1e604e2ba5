"""Codes of vectors against brute force in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from chirrup.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code string, _label string, error string"


def rows(spark, given):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in given], SCHEMA)


def brute(given):
    """By the definition: every entry compared with every part, all in Python integers."""
    keep = [(i, v, label) for i, v, label in given if v and all(x is not None and math.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    keep = [r for r in keep if len(r[1]) == len(keep[0][1])]
    ints = []
    for _, v, _ in keep:
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        ints.append(x + [0] * (-len(x) % 16))
    w = len(ints[0]) // 16 if ints else 0
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[part(x, p) for x in ints[:64]] for p in range(16)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(part(x, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(2):
        took = [[nearest(p, x)[1] for x in ints] for p in range(16)]
        for p in range(16):
            for e in range(len(books[p])):
                mine = [part(x, p) for x, t in zip(ints, took[p]) if t == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [[nearest(p, x) for p in range(16)] for x in ints]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, label), e in zip(keep, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (i, _, label), f, err in zip(keep, final, errors)]


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("dims,n,spread", [(64, 150, 0.2), (16, 90, 3.0), (40, 70, 0.01)])
def test_equals_brute_force(spark, dims, n, spread):
    """Also for lengths that 16 does not divide, and for codebooks with many equal entries."""
    rng = np.random.default_rng(dims)
    given = [(i, [float(x) for x in rng.normal(0, spread, dims).astype(np.float32)], i % 3 or None) for i in range(n)]
    assert got(vc.codes(rows(spark, given))) == sorted(brute(given), key=repr)


def test_rows_without_a_code_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.normal(0, 0.2, 32).astype(np.float32)] for _ in range(6)]
    given = [(1, v[0], 1), (1, v[1], 1), (1, v[1], 1), (None, v[2], None), (None, v[3], None), (4, None, 1), (5, [], 1), (6, v[4][:16], 1)]
    given += [(7, [None, *v[4][1:]], 1), (8, [float("nan"), *v[4][1:]], 1), (9, [float("inf"), *v[4][1:]], 2), (10, [-float("inf"), *v[4][1:]], 2), (11, [1e30, *v[4][1:]], 2)]
    got_rows = got(vc.codes(rows(spark, given)))
    assert [r[0] for r in sorted(got_rows, key=lambda r: (r[0] is None, r[0] or 0))] == [1, 1, 1, 11, None, None]
    fine = [(*r[:1], *r[1:]) for r in given if r[0] != 11]
    assert got(vc.codes(rows(spark, fine))) == sorted(brute(fine), key=repr)


def test_empty_table(spark):
    out = vc.codes(rows(spark, [(1, None, 1)]))
    assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_masks_of_a_box():
    entries = np.array([[0, 0], [5, 5], [5, -5], [100, 100]])
    index = vc.SliceIndex(entries)
    x, radius = np.array([[1, 1], [5, 0], [50, 50]]), np.array([4, 5, 49])
    wanted = [sum(1 << e for e, c in enumerate(entries) if np.abs(c - p).max() <= r) for p, r in zip(x, radius)]
    assert index.candidates(x, radius).tolist() == wanted


def test_nearest_is_exact_far_outside_and_between():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (64, 4))
    x = np.concatenate([rng.integers(-60, 60, (500, 4)), rng.integers(-(10**6), 10**6, (100, 4)), entries])
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    entry, distance = vc.SliceIndex(entries).nearest(x)
    assert (distance == d.min(axis=1)).all() and (entry == d.argmin(axis=1)).all()
