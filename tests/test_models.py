import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from chirrup.constants import SENTIMENTS
from chirrup.operators import features, labelled, modelling as mo, topics

WORDS = {"Negative": "awful broken refund terrible", "Neutral": "monday report table notes", "Positive": "lovely bright great smile"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(90):
        label = SENTIMENTS[i % 3]
        own, other = WORDS[label].split(), WORDS[SENTIMENTS[(i + 1) % 3]].split()
        text = " ".join([own[i % 4], own[(i // 3) % 4], own[(i // 5) % 4], other[(i // 7) % 4] if i % 5 == 0 else "filler"])
        rows.append((i, text, label, "t" + str(i % 2)))
    return spark.createDataFrame(rows, "text_id int, post_text string, sentiment_label string, topic_category string")


SPECS = [
    mo.Spec("dummy", "dummy", None),
    mo.Spec("nb_word", "nb", "word", ({"alpha": 0.5},)),
    mo.Spec("logreg_union", "logreg", "union", ({"C": 1.0, "class_weight": "balanced"},), 20),
]


def test_bake_off_beats_the_dummy(docs):
    result = mo.bake_off(docs, "post_text", "sentiment_label", SENTIMENTS, specs=SPECS, folds=3)
    table = {r.spec: r for r in result.table.collect()}
    assert result.winner.name != "dummy" and result.margin >= 0
    assert table[result.winner.name].cv_mean > table["dummy"].cv_mean + 0.05
    assert all(len(r.cv_folds) == 3 and r.cv_mean == pytest.approx(np.mean(r.cv_folds)) for r in table.values())
    assert sorted(r.place for r in table.values()) == [1, 2, 3]


def test_ladder_and_weights(spark, docs):
    assert [len(s.grid) for s in mo.ladder()] == [1, 3, 8, 8, 8, 8]
    weights = {r.sentiment_label: r.weight for r in mo.class_weights(docs.where("text_id < 60 or sentiment_label = 'Neutral'"), "sentiment_label").collect()}
    assert weights["Neutral"] == pytest.approx(70 / (3 * 30)) and weights["Positive"] == pytest.approx(70 / (3 * 20))


@pytest.mark.parametrize("spec", [
    mo.Spec("svc_word", "svc", "word", ({"C": 1.0, "class_weight": None},), 10), SPECS[1], SPECS[2],
], ids=lambda s: s.name)
def test_train_save_load_score(spark, docs, tmp_path, spec):
    model = mo.train_classifier(docs, "post_text", "sentiment_label", SENTIMENTS, spec, spec.grid[0], task="sentiment")
    scored = model.transform(docs)
    probs = [f"prob_sentiment_{c}" for c in SENTIMENTS]
    right, off = scored.agg(F.avg((F.col("pred_sentiment") == F.col("sentiment_label")).cast("int")), F.max(F.abs(sum(map(F.col, probs)) - 1))).first()
    assert right > 0.8 and off < 1e-3
    model.save(spark, str(tmp_path))
    again = mo.TextClassifier.load(spark, str(tmp_path)).transform(docs)
    assert again.exceptAll(scored).count() == 0


def test_vectors_equal_the_relational_weights(spark, docs):
    rows = mo.with_terms(docs, "post_text", ("word",))
    fitted = mo.TextFeatures.fit(rows, ("word",))
    vocabulary = fitted.arms["word"][0].vocabulary
    by_vector = {}
    for r in fitted.transform(rows).select("text_id", "features").collect():
        by_vector.update({(r.text_id, vocabulary[i]): w for i, w in zip(r.features.indices, r.features.values)})
    counts = features.term_counts(rows, "text_id", F.col("word_terms"))
    by_table = {(r.text_id, r.term): r.weight for r in features.tfidf(counts, "text_id").collect()}
    assert by_vector.keys() == by_table.keys()
    assert all(by_vector[k] == pytest.approx(by_table[k]) for k in by_table)


def test_sparse_vectors_and_limit(spark):
    cells = spark.createDataFrame([(1, 4, 2.0), (1, 0, 1.0), (2, 3, 5.0)], "d int, idx int, weight double")
    got = {r.d: r.features for r in features.sparse_vectors(cells, "d", 6).collect()}
    assert got == {1: SparseVector(6, {0: 1.0, 4: 2.0}), 2: SparseVector(6, {3: 5.0})}


def test_filters_above_the_text_steps_stay_small(docs):
    """A filter on a derived column is substituted through all steps: their size must not explode."""
    import time

    from chirrup.functions import social_text as st
    from chirrup.operators import evaluation as ev

    text = docs.select("text_id", "post_text", "topic_category")
    rows = st.normalise_corpus(text, "post_text", attributes=True)
    spec = mo.Spec("nb_word", "nb", "word", ({"alpha": 1.0},))
    labels = sorted(r[0] for r in docs.select("topic_category").distinct().collect())
    model = mo.train_classifier(docs, "post_text", "topic_category", labels, spec, {"alpha": 1.0}, task="topic")
    scored = model.transform(text).select(F.col("topic_category").alias("true"), F.col("pred_topic").alias("pred"))
    for plan in (rows.where("n_tokens > 5"), rows.select("text_id", F.explode("tokens").alias("t")), ev.confusion(scored, labels)):
        began = time.time()
        plan._jdf.queryExecution().optimizedPlan()
        assert time.time() - began < 4  # 2 s on an idle machine


def test_split_and_folds(docs):
    split = labelled.stratified_split(docs)
    counts = {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"test": 18, "train": 72}
    assert split.select("text_id").distinct().count() == 90
    per = [r.n for r in split.where("split = 'test'").groupBy("stratum").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 6 and max(per) - min(per) <= 1
    sizes = [r.n for r in labelled.with_folds(docs, "sentiment_label", 5).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sizes == [18] * 5


def test_audit_refuses(spark, docs):
    labelled.require_clean(docs)
    with pytest.raises(ValueError):
        labelled.require_clean(docs.union(docs.limit(1)))
    with pytest.raises(ValueError):
        labelled.require_clean(docs.drop("post_text"))


def test_topics(spark):
    themes = ["apple pear plum cherry", "motor wheel brake clutch"]
    rows = [(i, " ".join([themes[i % 2]] * 2 + [themes[i % 2].split()[i % 4]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "id int, text string")
    counts, model = topics.count_vectors(docs, "text")
    cells = topics.materialise(topics.sparse_cells(counts, "id"))
    fit = topics.factorise(cells, len(model.vocabulary), 2, iterations=40)
    found = {r.id: r.topic for r in fit.topics(cells, "id").collect()}
    assert len({found[i] for i in range(0, 40, 2)}) == 1 and found[0] != found[1]
    x = np.zeros((40, len(model.vocabulary)))
    for r in counts.collect():
        x[r.id, r.counts.indices] = r.counts.values
    assert fit.error < 0.4 * np.linalg.norm(x)
    assert set(fit.words(model.vocabulary, 4)["T0"]) in [set(t.split()) for t in themes]
    assert topics.lda_words(topics.lda(counts, 2, iterations=5), model.vocabulary, 3).count() == 2


def test_learning_curve(docs):
    curve = mo.learning_curve(docs, "post_text", "sentiment_label", SENTIMENTS, SPECS[1], SPECS[1].grid[0], fractions=(0.3, 1.0), folds=2).collect()
    assert curve[0].train_size < curve[1].train_size and curve[1].valid_mean > 0.5


def test_registered_bake_off_searches_the_whole_ladder(monkeypatch):
    from types import SimpleNamespace

    from registry import models

    seen = {}

    def stub(*args, specs=None, folds=mo.FOLDS, **more):
        seen.update(specs=specs, folds=folds)
        return SimpleNamespace(table=SimpleNamespace(drop=lambda *names: None))

    monkeypatch.setattr(mo, "bake_off", stub)
    models._bake_off(SimpleNamespace(labelled_text=None))
    assert seen["specs"] == mo.ladder() and seen["folds"] == 5
    assert [(s.kind, len(s.grid), s.iterations) for s in seen["specs"][2:]] == [("logreg", 8, 2000), ("svc", 8, 5000), ("logreg", 8, 3000), ("svc", 8, 5000)]


def test_factorisation_lays_out_slices_and_gives_back_blocks(spark, monkeypatch):
    """Before: a whole batch's terms and several copies of all terms' sums lay in memory at once."""
    cells = spark.createDataFrame([(d, [d % 5, 5 + d % 3], [1.0 + d % 2, 2.0]) for d in range(30)], "id int, i array<int>, v array<double>").coalesce(1)
    whole = topics.factorise(cells, 8, 2, iterations=4)
    monkeypatch.setattr(topics, "SLICE", 7)
    monkeypatch.setattr(topics, "BLOCK", 3)
    parts = list(topics._sliced(iter([cells.toPandas()])))
    assert [len(p) for p in parts] == [7, 7, 7, 7, 2]
    sliced = topics.factorise(cells, 8, 2, iterations=4)
    assert np.allclose(whole.h, sliced.h) and whole.error == pytest.approx(sliced.error)
