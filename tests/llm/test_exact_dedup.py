import hashlib
import random
import re

from chirrup.llm import exact_dedup
from helpers_llm import documents


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_filter_inserts_finds_and_deletes_up_to_overflow():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    shard = exact_dedup.Shard()
    shard.ready()
    for i, d in enumerate(digests):
        shard.insert(d, i, i, 1)
    assert shard.filter.buckets > exact_dedup.FIRST_BUCKETS  # it was rebuilt larger
    assert all(d in shard.filter for d in digests)
    for d in digests[::2]:
        shard.delete(d, 1)
    assert all(shard.find(d) is None for d in digests[::2]) and all(shard.find(d) for d in digests[1::2])
    shard.insert(digests[0], 7, 7, 2)
    assert shard.find(digests[0]) == [7, 7, 2]


def test_decisions_match_brute_force(spark):
    random.seed(1)
    texts = [None, "", " ", "a b", "a  b", "a\tb\n", " a b", "A b", "é", "x" * 300_000, "x" * 300_000 + " "]
    rows = [(random.choice([None, *range(40)]), random.choice(texts)) for _ in range(300)]
    got = [tuple(r) for r in exact_dedup.decisions(documents(spark, rows)).collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        mine = [g for g in got if g[4] == sha]
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(map(repr, (g[0] for g in mine))) == sorted(map(repr, ids))
        assert {(g[1], g[2]) for g in mine} == {(least, len(ids))}
        assert [g[0] for g in mine if g[3]] == [least]


def test_index_lives_through_epochs(spark):
    index = exact_dedup.DigestIndex(spark, shards=3)
    first = exact_dedup.digests(documents(spark, [(1, "a"), (2, "b"), (3, "a")]))
    more = exact_dedup.digests(documents(spark, [(0, "b"), (9, "c")]))
    index.apply(inserts=first)
    live = index.apply(inserts=more, deletes=exact_dedup.digests(documents(spark, [(1, "a"), (3, "a"), (5, "gone")])))
    assert sorted((r["keep_id"], r["group_size"]) for r in live.collect()) == [(0, 2), (9, 1)]


def test_empty_table_and_kept_rows(spark):
    empty = documents(spark, [])
    assert exact_dedup.decisions(empty).collect() == [] and exact_dedup.kept(empty).collect() == []
    docs = documents(spark, [(1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "c"), (None, "c"), (None, None)])
    left = exact_dedup.kept(docs)
    assert left.columns == docs.columns
    assert rows_of(left.select("doc_id", "text")) == sorted([(1, "a"), (1, "b"), (None, "c"), (None, None)], key=repr)


def test_an_index_is_opened_again_and_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 10)
    rows = lambda a, b: exact_dedup.digests(spark.createDataFrame([(i, f"text {i}") for i in range(a, b)], "doc_id long, text string"))
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path)
    first.apply(inserts=rows(0, 20))
    second = exact_dedup.DigestIndex(spark, path)
    assert second.shards == first.shards and second.live().count() == 20
    second.apply(inserts=rows(10, 200))
    assert second.shards > first.shards
    third = exact_dedup.DigestIndex(spark, path)
    third.apply(deletes=rows(0, 5))
    live = {r["keep_id"]: r["group_size"] for r in third.live().collect()}
    assert live == {i: 2 if 10 <= i < 20 else 1 for i in range(5, 200)}


def test_columns_with_names_of_inner_ones(spark):
    schema = "doc_id long, text string, _n int, _dd string, _di int, _own0 string, _OWN1 string"
    docs = spark.createDataFrame([(1, "a", 77, "x", 5, "y", "z"), (1, "a", 77, "x", 5, "y", "z"), (2, "a", 1, "x", 5, "y", "z")], schema)
    assert [tuple(r) for r in exact_dedup.kept(docs).collect()] == [(1, "a", 77, "x", 5, "y", "z")]
