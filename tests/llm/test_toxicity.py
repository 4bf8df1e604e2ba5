import numpy as np

from chirrup.llm import toxicity as tx
from helpers_llm import documents, real


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    y = np.asarray(y, bool)
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_held_out_labels(spark):
    rows = [r[:4] for r in real("documents", "sf0.1")]
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in real("labels", "sf0.1") if r[2] is not None], "doc_id long, toxic long")
    docs = documents(spark, rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in tx.scores(docs, tx.learn(docs, labels)).collect() if r["held_out"] and r["doc_id"] in truth]
    y = [truth[r["doc_id"]] for r in got]
    assert auc(y, [r["score"] for r in got]) > 0.93
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_folding():
    assert tx.folded("IDI0T 1diot іdіоt ｉdiot $cum l​oser tr@sh! scum!!") == ["idiot", "idiot", "idiot", "idiot", "scum", "loser", "trash", "scum"]
    assert tx.folded("in 2024 1.5 réêou the### a-b") == ["in", "réêou", "the", "a", "b"]
    assert tx.folded(None) == [] and tx.folded("123 !!") == []


def test_longest_entry_and_exceptions():
    m = tx.Matcher({"trash": 5.0, "trashy": 7.0, "clown": 4.0})
    assert m.features("take the trash can out")[3] == 0.0
    assert m.features("trashy stuff")[3] == 7.0 and m.features("such trash")[3] == 5.0
    assert m.features("a class clown")[3] == 4.0 or m.features("class clown")[3] == 0.0
    assert m.features("untrash")[3] == 0.0
    assert m.features("trash " + "word " * 99)[0] < m.features("trash word")[0]


def test_edges(spark):
    texts = [(i, ("nice words here " if i % 3 else "awful vile words ") * 5) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic long")
    docs = documents(spark, [*texts, (200, None), (201, ""), (None, "awful vile"), (200, None), (202, "awful " * 100_000)])
    model = tx.learn(docs, labels)
    got = tx.scores(docs, model).collect()
    assert len(got) == 95 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[202] == 1 and by[200] == by[201] == 0 and by[1] == 0 and by[0] == 1
    empty = tx.learn(docs, labels.where("false"))
    assert {r["score"] for r in tx.scores(docs, empty).collect()} == {0.0}
    assert tx.scores(documents(spark, []), model).collect() == []
