import collections
import random
import re

import numpy as np

from chirrup.llm import bytewise, components, jaccard_join as jj
from helpers_llm import documents, real

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for h in s:
            index[h].append(k)
    for k, (_, s) in enumerate(sets):
        shared = collections.Counter(o for h in s for o in index[h] if o < k)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o][1]) - n):
                parent[max(root(k), root(o))] = min(root(k), root(o))
    least = {}
    for k, (i, _) in enumerate(sets):
        ids = least.setdefault(root(k), [])
        ids += [i] if i is not None else []
    return sorted(((i, len(s), min(least[root(k)], default=None) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def result(df):
    return sorted((tuple(r) for r in jj.linked_documents(df).collect()), key=repr)


def test_words_and_shingles_by_bytes():
    import pyarrow as pa

    texts = ["", None, "a", "A b\tC", "a b c d e", "A B  c d e f", "é É ﬀ a b c", " x ", "a b c d e"]
    sets = [s for _, _, d, o in bytewise.slices(pa.array(texts), 8) for s in bytewise.shingle_sets(d, o)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[4] == sets[8]).all() and len(np.intersect1d(sets[4], sets[5])) == 1


def near_copies(n, words, edits, seed=0):
    random.seed(seed)
    base = [f"w{random.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[random.randrange(words)] = f"e{random.randrange(10**6)}"
        yield " ".join(own)


def test_given_documents_against_brute_force(spark):
    rows = [(r[0], r[1]) for r in real("documents")]
    assert result(documents(spark, rows)) == brute(rows)


def test_large_group_of_near_copies_and_ties(spark):
    rows = list(enumerate([*near_copies(150, 80, 1), *near_copies(60, 120, 4, 1), *near_copies(80, 40, 2, 2)]))
    exact = " ".join(f"t{i}" for i in range(11))  # 7 shingles; cut by one word 6 of 7 stay
    rows += [(1000, exact), (1001, " ".join(exact.split()[:-1])), (1002, " ".join(exact.split()[:-2])), (1003, exact.upper())]
    assert result(documents(spark, rows)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (None, "one two"), (None, None), (7, long), (8, long + " more"), (7, long), (9, "a a a a a a a a a")]
    assert result(documents(spark, rows)) == brute(rows)
    assert result(documents(spark, [])) == []
    docs = documents(spark, rows)
    left = jj.first_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((repr(r["doc_id"]), len(r["text"] or "")) for r in left.collect()) == sorted(
        [("1", 0), ("2", 0), ("3", 2), ("None", 0), ("4", 3), ("6", 7), ("7", len(long)), ("7", len(long)), ("9", 17)]
    )


def test_search_leaves_nothing_out():
    """Candidates of both searches are a superset of what links, and within the bound."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.02, 0.1, 0.4]), rng.integers(0, 1 << 63, 300, dtype=np.uint64), base)[: rng.integers(200, 300)]) for _ in range(90)]
    sizes, labels = np.array([len(s) for s in sets]), np.arange(90)
    points, above = zip(*[jj.point_of(jj.group_counts(s)) for s in sets])
    above = np.array(above)
    for s, p, a in zip(sets, points, above):
        assert p.sum() + a == len(s)
    want = {(i, j) for i in range(90) for j in range(i) if jj.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j])}
    tree, more = jj.search_posting(sizes, sizes, points, above, labels, None)
    small = jj.search_small(np.array([0]), np.array([90]), sizes, sizes, points, above, labels, None)
    assert want and want <= set(tree) and set(tree) == set(zip(small[0].tolist(), small[1].tolist())) and not more
    few, more = jj.search_posting(sizes, sizes, points, above, labels, 1)
    assert more and len(few) == len({i for i, _ in tree})


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (100, 100)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_texts_without_ids_meet_once(spark, monkeypatch):
    """Rows with one id are told apart by their text, so that the texts written grow with the documents."""
    texts = list(near_copies(150, 60, 2))
    rows = [(None, t) for t in texts] + [(3, t) for t in texts[:40]] + [(None, texts[0])] * 50
    written = {}
    real_write = jj.materialise

    def counted(df, label="rows"):
        out = real_write(df, label)
        written[label] = written.get(label, 0) + (out.count() if label == "jaccard-texts" else 0)
        return out

    monkeypatch.setattr(jj, "materialise", counted)
    got = jj.linked_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows) and written["jaccard-texts"] <= 3 * len(rows)
    assert {r["n_shingles"] for r in got} == {len(shingles(t)) for t in texts}


def test_names_of_inner_columns(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, text, "x", "y")], "doc_id long, text string, _gone string, _tag string")
    assert [tuple(r) for r in jj.first_of_each(docs).collect()] == [(1, text, "x", "y")]


def test_partners_by_rooms_equal_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(500):
        size = rng.integers(1, 60, rng.integers(2, 40))
        after = size - np.array([rng.integers(0, jj.needed_prefix(n)) for n in size])
        passes = 7 * np.minimum(after[:, None], after) >= 3 * (size[:, None] + size)
        np.fill_diagonal(passes, False)
        assert (jj._has_partner(size, after) == passes.any(axis=1)).all()


def test_many_copies_about_the_threshold(spark):
    """Copies of one text with words changed at random: some pairs link, most nearly do, none is lost."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, 2, replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    assert result(documents(spark, rows)) == brute(rows)
