import collections
import random
import re

from chirrup.llm import mixing
from helpers_llm import documents, real


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is above a cap is shared anew among the rest until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        m = r["_mix"]
        assert m["source_size"] == sizes[r["source"]] and abs(m["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert m["size"] == size(r["text"]) and 0 <= m["taken"] <= 2 * m["size"] and m["taken"] == m["copies"] * m["size"]
        taken[r["source"]] += m["taken"]
        largest[r["source"]] = max(largest[r["source"]], m["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


def test_given_documents(spark):
    rows = [r[:4] for r in real("documents", "sf0.01")]
    docs = documents(spark, rows)
    got = mixing.mixed(docs).collect()
    check(rows, got)
    again = {r["doc_id"]: r["_mix"] for r in mixing.mixed(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["_mix"] for r in got}


def test_hot_source_null_source_and_edges(spark):
    random.seed(7)
    rows = [(i, "w " * random.randrange(0, 60), None, random.choice(["hot"] * 6 + ["b", "c", "", None, "Ä", "d"])) for i in range(900)]
    rows += [(1000, None, None, "empty"), (1001, "", None, "empty"), (None, "one two", None, "b"), (1002, "v " * 50_000, None, "hot"), (5, rows[5][1], None, rows[5][3])]
    docs = documents(spark, rows)
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "_mix"]
    check(rows, got.collect())
    assert mixing.mixed(documents(spark, [])).collect() == []
    nothing = mixing.mixed(documents(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [r["_mix"]["taken"] for r in nothing] == [0, 0]


def test_relative_probabilities_change_who_is_taken(spark):
    rows = [(i, "w " * 10, None, ["a", "b", "c"][i % 3]) for i in range(3000)]
    docs = documents(spark, rows)
    odds = mixing.F.when(mixing.F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)
    got = [r for r in mixing.mixed(docs, relative=odds).collect() if r["source"] == "c"]
    even = sum(r["_mix"]["copies"] for r in got if r["doc_id"] % 2 == 0)
    odd = sum(r["_mix"]["copies"] for r in got if r["doc_id"] % 2)
    assert even > 1.25 * odd
    check(rows, mixing.mixed(docs, relative=odds).collect())


def test_rows_without_id_are_drawn_one_by_one(spark):
    rows = [(None, f"w{i} " * 10, None, ["a", "b", "c"][i % 3]) for i in range(900)]
    check(rows, mixing.mixed(documents(spark, rows)).collect())


def test_inclusion_rates_are_the_probabilities(spark):
    """Many sources with the same sizes are as many draws of one design, large enough for the border document to weigh little."""
    sizes, draws = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89] * 40, 50
    rows = [(d * 1000 + i, "w " * n, None, f"s{d}") for d in range(draws) for i, n in enumerate(sizes)]
    got = mixing.mixed(documents(spark, rows), weights=(1,), share=0.7).collect()
    want, certain = 0.7 * sum(sizes), 0
    while True:  # sizes by rising length: the shortest ones become certain first
        c = (want - sum(s for s in sizes if s <= certain)) / sum(s**0.5 for s in sizes if s > certain)
        more = [s for s in sizes if s > certain and c / s**0.5 >= 1]
        if not more:
            break
        certain = max(more)
    assert 0 < certain < max(sizes)
    taken = collections.Counter()
    for r in got:
        taken[r["_mix"]["size"]] += r["_mix"]["copies"]
    for s in set(sizes):
        p = 1.0 if s <= certain else c / s**0.5
        rate = taken[s] / (draws * sizes.count(s))
        assert rate == 1.0 if p == 1.0 else abs(rate - p) < 0.03, (s, p, rate)


def test_rows_without_id_agree_with_the_sql(spark, tmp_path):
    import duckdb
    from chirrup.llm import queries

    random.seed(3)
    rows = [(None if i % 3 else i, f"w{i % 50} " * (i % 17), None, random.choice(["a", "a", "a", "b", None])) for i in range(600)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op9_mixing(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP9})").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4], r[4:])
    same = lambda a, b: all(abs(x - y) < 1e-6 if isinstance(x, float) else x == y for x, y in zip(a, b))
    mine, theirs = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want), key=key)
    assert len(mine) == len(theirs) == len(rows) and all(same(a, b) for a, b in zip(mine, theirs))
