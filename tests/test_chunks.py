"""Documents in chunks: the same counts, weights and models however many chunks there are."""

import math

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from chirrup.functions import social_text as st
from chirrup.operators import chunks, features, modelling as mo
from chirrup.streaming import sweeps

TEXTS = ["red sun red", "blue sea", "red sea sky", "blue sky", "sun", "", "sea sea blue sky"]


@pytest.fixture(params=[1, 1000])
def docs(spark, request, monkeypatch):
    monkeypatch.setattr(chunks.dealt, "__defaults__", (request.param,))
    rows = [(i, t.split(), ["a", "b"][i % 2]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (0, ["sky"], "a"), (None, ["sea"], "b")], "id long, words array<string>, label string")


def expected(parts):
    """Term frequencies by key, rows of one key being one document."""
    out = {}
    for i, t in [*enumerate(TEXTS), (0, "sky"), (None, "sea")]:
        for x in parts(t.split()):
            out[i, x] = out.get((i, x), 0) + 1
    return out


def neighbours(ws):
    return [*ws, *map(" ".join, zip(ws, ws[1:]))]


@pytest.mark.parametrize("kind", ["words", "pairs", "parts"])
def test_counts_and_weights(docs, kind):
    more = {"words": {}, "pairs": {"pairs": True}, "parts": {"parts": st.grams_of}}[kind]
    own = {"words": list, "pairs": neighbours, "parts": lambda ws: [g for w in ws for g in st.grams_of(w)]}[kind]
    counts, tf = features.term_counts(docs, "id", F.col("words"), **more), expected(own)
    assert {(r.id, r.term): r.tf for r in counts.cells().collect()} == tf
    df = {}
    for _, x in tf:
        df[x] = df.get(x, 0) + 1
    n = len({i for i, _ in tf if i is not None})
    raw = {k: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[k[1]])) + 1) for k, c in tf.items() if df[k[1]] > 1 and k[0] is not None}
    norm = {i: math.sqrt(sum(w * w for (j, _), w in raw.items() if j == i)) for i, _ in raw}
    got = {(r.id, r.term): r.weight for r in features.tfidf(counts, "id").collect()}
    assert got == {k: pytest.approx(w / norm[k[0]]) for k, w in raw.items()}


def test_grams_of_a_word(spark):
    words = ["a", "ab", "abc", "abcd", "a<b>9", "<empty>"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", st.char_ngrams(F.col("w")).alias("g")).collect()
    assert all(sorted(r.g) == sorted(st.grams_of(r.w)) for r in rows) and len(rows) == len(words)


def test_naive_bayes_holds_nothing_of_the_vocabulary(spark, docs, monkeypatch):
    """The same probabilities as Spark's, without a vocabulary or weights on the driver (before: CountVectorizer, NaiveBayes)."""
    posts = docs.select(F.coalesce("id", F.lit(9)).alias("text_id"), F.array_join("words", " ").alias("post_text"), F.col("label").alias("topic_category"))
    posts = mo.materialise(posts)
    rows = mo.with_terms(posts, "post_text", ("word",)).withColumn("y", mo.label_index("topic_category", "ab"))
    space = mo.TextFeatures.fit(rows, ("word",))
    old = NaiveBayes(labelCol="y", smoothing=0.5).fit(space.transform(rows)).transform(space.transform(rows))
    old = sorted((r.post_text, round(r.probability[0], 4), round(r.probability[1], 4)) for r in old.collect())

    def refused(*args, **more):
        raise AssertionError("a vocabulary on the driver")

    monkeypatch.setattr(mo.TextFeatures, "fit", refused)
    spec = mo.Spec("nb_word", "nb", "word", ({"alpha": 0.5},))
    model = mo.train_classifier(posts, "post_text", "topic_category", "ab", spec, {"alpha": 0.5}, task="topic")
    new = sorted((r.post_text, r.prob_topic_a, r.prob_topic_b) for r in model.transform(posts).collect())
    assert new == [(t, pytest.approx(a, abs=1.01e-4), pytest.approx(b, abs=1.01e-4)) for t, a, b in old]
    with pytest.raises(ValueError):
        mo.train_classifier(posts, "post_text", "topic_category", "a", spec, {"alpha": 0.5}, task="topic")


def test_totals_of_hours_are_summed_in_tasks_of_their_own(spark, tmp_path, monkeypatch):
    """One task once held the aggregation of every shuffle partition at a time."""
    from pyspark.sql import DataFrame

    def refused(self, n):
        raise AssertionError("tasks of an aggregation merged into one")

    rows = spark.createDataFrame([(f"r{i}", f"2024-01-0{1 + i % 3} 05:00:00") for i in range(12)], "record_id string, created_at string")
    landed = [f.name for f in sweeps.EVENT_SCHEMA]
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in landed if c in rows.columns]).write.json(f"{tmp_path}/in")
    monkeypatch.setattr(DataFrame, "coalesce", refused)
    sweeps.monitor(sweeps.deduplicated(sweeps.read_landing(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert sorted(r.n for r in sweeps.hourly_totals(spark, f"{tmp_path}/out", 0).collect()) == [4, 4, 4]
