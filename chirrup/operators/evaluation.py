"""Evaluation of classifiers and clusterings from counted tables.

Predictions are reduced to confusion counts, value histograms or sums first; every metric
is a formula over those few rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chirrup.functions import metrics as m
from chirrup.operators.ranking import average_ranks, exact_quantiles, grouped_histogram
from chirrup.session import materialise

EPSILON = 2.220446049250313e-16  # double precision


def confusion(df: DataFrame, labels: Sequence[str], by: Sequence[str] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    """Counts for every pair of labels, absent pairs as 0, with the row-normalised share."""
    counts = df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*map(F.lit, labels))
    # a group carries its whole grid: labels squared
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
    grid = groups.withColumn("true", F.explode(names)).withColumn("pred", F.explode(names))
    full = grid.join(counts, [*by, "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = Window.partitionBy(*by, "true")
    return full.withColumn("row_share", m.ratio(F.col("n"), F.sum("n").over(row)))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where a division has no meaning."""
    ends = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("hit")),
                F.struct(
                    F.col("pred").alias("label"),
                    F.lit(0).cast("long").alias("t"),
                    F.col("n").alias("p"),
                    F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
                ),
            )
        ),
    )
    sums = ends.groupBy(*by, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        *by,
        "label",
        zero(m.ratio(F.col("hit"), F.col("p"))).alias("precision"),
        zero(m.ratio(F.col("hit"), F.col("t"))).alias("recall"),
        zero(m.ratio(2 * F.col("hit"), F.col("t") + F.col("p"))).alias("f1"),
        F.col("t").alias("support"),
    )


def summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1 (macro, weighted, micro), Matthews correlation and n."""
    if not by:
        return summary(cells.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    classes = per_class(cells, by)
    f1 = classes.groupBy(*by).agg(
        F.avg("f1").alias("f1_macro"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)).alias("f1_weighted"),
    )
    ends = cells.groupBy(*by, "true").agg(F.sum("n").alias("t"))
    preds = cells.groupBy(*by, F.col("pred").alias("true")).agg(F.sum("n").alias("p"))
    products = ends.join(preds, [*by, "true"]).groupBy(*by).agg(
        F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"),
        F.sum(F.col("t").cast("double") * F.col("t")).alias("tt"),
        F.sum(F.col("p").cast("double") * F.col("p")).alias("pp"),
    )
    totals = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit")
    )
    n, hit = F.col("n").cast("double"), F.col("hit").cast("double")
    spread = F.sqrt((n * n - F.col("tt")) * (n * n - F.col("pp")))
    mcc = F.coalesce(F.try_divide(hit * n - F.col("tp"), spread), F.lit(0.0))
    accuracy = F.try_divide(hit, n)
    return totals.join(f1, list(by)).join(products, list(by)).select(
        *by,
        accuracy.alias("accuracy"),
        "f1_macro",
        "f1_weighted",
        accuracy.alias("f1_micro"),
        mcc.alias("mcc"),
        "n",
    )


# ------------------------------------------------------------------------------ probabilities
def one_vs_rest(df: DataFrame, labels: Sequence[str], true: str = "true", prefix: str = "prob_") -> DataFrame:
    """(label, p, y): each row once per class, with its probability and whether it is of that class."""
    return df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("label"),
                        F.col(f"{prefix}{c}").alias("p"),
                        (F.col(true) == c).cast("long").alias("y"),
                    )
                    for c in labels
                ]
            )
        )
    )


def _score_histogram(ovr: DataFrame) -> DataFrame:
    return grouped_histogram(ovr, ["label"], "p", {"n": F.count(F.lit(1)), "pos": F.sum("y")})


def auc_per_class(ovr: DataFrame) -> DataFrame:
    """Area under the ROC curve from mid-ranks; NULL for a class that is absent or alone."""
    ranked = average_ranks(_score_histogram(ovr))
    sums = ranked.groupBy("label").agg(
        F.sum(F.col("pos") * F.col("avg_rank")).alias("r"), F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    return sums.select("label", F.try_divide(F.col("r") - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def roc_auc_macro(ovr: DataFrame) -> DataFrame:
    """Mean of the class areas; NULL as soon as one is missing."""
    return auc_per_class(ovr).agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc_ovr"))


def roc_points(ovr: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score, and the origin."""
    hist = _score_histogram(ovr)
    above_n = F.col("n_all") - F.col("n_cum") + F.col("n")
    above_pos = F.col("pos_all") - F.col("pos_cum") + F.col("pos")
    points = hist.select(
        "label",
        F.col("p").alias("threshold"),
        F.round(m.ratio(above_n - above_pos, F.col("n_all") - F.col("pos_all")), 4).alias("fpr"),
        F.round(m.ratio(above_pos, F.col("pos_all")), 4).alias("tpr"),
    )
    origin = ovr.select("label").distinct().select(
        "label", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def log_loss(df: DataFrame, labels: Sequence[str], true: str = "true", prefix: str = "prob_") -> DataFrame:
    p = F.coalesce(*[F.when(F.col(true) == c, F.col(f"{prefix}{c}")) for c in labels])
    return df.agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON)))).alias("log_loss"))


def brier(ovr: DataFrame) -> DataFrame:
    return ovr.groupBy("label").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def reliability(ovr: DataFrame, bins: int = 10) -> DataFrame:
    """Mean predicted against observed share in equal, right-closed bins; empty bins are left out."""
    place = sum(((F.col("p") > i * (1 / bins)).cast("long") for i in range(1, bins)), F.lit(0).cast("long"))
    return ovr.groupBy("label", place.alias("bin")).agg(
        F.avg("p").alias("prob_pred"), F.avg("y").alias("prob_true"), F.count(F.lit(1)).alias("n")
    )


# ------------------------------------------------------------------------------ comparisons
@F.pandas_udf(T.DoubleType())
def binomial_two_sided(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided binomial p at one half; terms are added from the largest down."""

    def p_value(x: int, y: int) -> float:
        n, k = x + y, min(x, y)
        if n == 0 or x == y:
            return 1.0
        log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        total, ratio = 0.0, 1.0
        for i in range(k, -1, -1):
            total += ratio
            if i == 0 or ratio < total * 1e-17:
                break
            ratio *= i / (n - i + 1)
        return min(1.0, 2 * math.exp(log_term) * total)

    return pd.Series([p_value(int(x), int(y)) for x, y in zip(b, c)])


def mcnemar(df: DataFrame, true: str = "true", first: str = "pred", second: str = "pred_b") -> DataFrame:
    """Rows only the first model gets right, rows only the second does, and the exact p."""
    a, b = F.col(first) == F.col(true), F.col(second) == F.col(true)
    counts = df.agg(m.count_where(a & ~b).alias("b_a_right_b_wrong"), m.count_where(~a & b).alias("c_a_wrong_b_right"))
    p = binomial_two_sided("b_a_right_b_wrong", "c_a_wrong_b_right")
    return counts.withColumn("p_value", p).withColumn("significant_05", F.col("p_value") < 0.05)


def error_samples(df: DataFrame, text: str = "clean", *, per_cell: int = 3, max_chars: int = 220) -> DataFrame:
    """The first few misclassified rows of each confusion cell, by id."""
    from chirrup.functions.strings import shorten

    order = Window.partitionBy("true", "pred").orderBy("text_id")
    return (
        df.where(F.col("true") != F.col("pred"))
        .withColumn("i", F.row_number().over(order))
        .where(F.col("i") <= per_cell)
        .select("text_id", "true", "pred", shorten(F.col(text), max_chars).alias("text"))
    )


LENGTH_BANDS = ("short", "medium", "long", "very_long")


def slices(df: DataFrame) -> Column:
    """Names of the slices a row belongs to, from ``band`` and the attribute columns."""
    yes_no = [
        F.when(F.col(c), f"{name}_yes").otherwise(f"{name}_no")
        for c, name in (("has_negation", "negation"), ("has_emoji", "emoji"), ("has_url", "url"))
    ]
    return F.array(F.lit("overall"), F.concat(F.lit("len_"), F.col("band")), *yes_no)


def slice_metrics(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Accuracy and macro-F1 overall, by token-length quartile and by attribute.

    Quartiles that coincide leave one band ``all``.
    """
    df = materialise(df.select("true", "pred", "n_tokens", "has_negation", "has_emoji", "has_url"))
    cuts = exact_quantiles(df, [], "n_tokens", [0.0, 0.25, 0.5, 0.75, 1.0]).select("q").scalar()
    e = F.col("edges")
    above = sum(((F.col("n_tokens") > e[i]).cast("int") for i in (1, 2, 3)), F.lit(0))
    banded = df.withColumn("edges", cuts).withColumn(
        "band",
        F.when(F.size(F.array_distinct(e)) < 5, "all").otherwise(F.array(*map(F.lit, LENGTH_BANDS))[above]),
    )
    rows = banded.select("true", "pred", F.explode(slices(banded)).alias("slice"))
    scored = summary(confusion(rows, labels, ["slice"]), ["slice"])
    return scored.select("slice", "n", F.round("accuracy", 4).alias("accuracy"), F.round("f1_macro", 4).alias("f1_macro"))


def slice_deltas(by_slice: DataFrame) -> DataFrame:
    """Accuracy with minus without each attribute, and the spread over the length bands."""
    value = lambda s, c: F.max(F.when(F.col("slice") == s, F.col(c)))
    names = ("negation", "emoji", "url")
    is_len = F.col("slice").startswith("len_")
    row = by_slice.agg(
        *[value(f"{a}_yes", "accuracy").alias(f"{a}_y") for a in names],
        *[value(f"{a}_no", "accuracy").alias(f"{a}_n") for a in names],
        F.min(F.when(is_len, F.col("accuracy"))).alias("low"),
        F.max(F.when(is_len, F.col("accuracy"))).alias("high"),
    )
    entries = [(a, F.col(f"{a}_y"), F.col(f"{a}_n")) for a in names] + [("length", F.col("high"), F.col("low"))]
    rows = [
        F.struct(
            F.lit(a).alias("contrast"), x.alias("first"), y.alias("second"), F.round(x - y, 4).alias("delta")
        )
        for a, x, y in entries
    ]
    return row.select(F.inline(F.array(*rows)))


def length_extremes(by_slice: DataFrame) -> DataFrame:
    lens = by_slice.where(F.col("slice").startswith("len_"))
    key = F.struct("accuracy", "slice")
    return lens.agg(F.min_by("slice", key).alias("worst"), F.max_by("slice", key).alias("best"))


def top_confusions(cells: DataFrame, top: int = 4) -> DataFrame:
    return (
        cells.where(F.col("true") != F.col("pred"))
        .select("true", "pred", "n")
        .orderBy(F.desc("n"), F.desc("true"), F.desc("pred"))
        .limit(top)
    )


def stored_equals(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Metric by metric: stored value, recomputed value, agreement."""
    return stored.select("metric", F.col("value").alias("stored")).join(
        recomputed.select("metric", F.col("value").alias("recomputed")), "metric", "full"
    ).withColumn("agrees", F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) < tolerance, F.lit(False)))


# ------------------------------------------------------------------------------ clustering
def agreement(df: DataFrame, true: str, cluster: str) -> DataFrame:
    """NMI (arithmetic), adjusted Rand index, homogeneity and completeness, from the contingency."""
    cells = df.groupBy(true, cluster).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").cast("double").alias("n")).scalar()

    def margins(column: str) -> DataFrame:
        sums = cells.groupBy(column).agg(F.sum("n").cast("double").alias("n")).withColumn("all", total)
        return sums.agg(
            F.sum(-(F.col("n") / F.col("all")) * F.log(F.col("n") / F.col("all"))).alias("h"),
            F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        )

    t, c = margins(true), margins(cluster)
    n = F.col("n").cast("double")
    row = (
        cells.withColumn("all", total)
        .agg(
            F.sum(-(n / F.col("all")) * F.log(n / F.col("all"))).alias("joint"),
            F.sum(n * (n - 1) / 2).alias("pairs"),
            F.first("all").alias("all"),
        )
        .withColumns(
            {
                "ht": t.select("h").scalar(),
                "hc": c.select("h").scalar(),
                "pt": t.select("pairs").scalar(),
                "pc": c.select("pairs").scalar(),
            }
        )
    )
    ht, hc = F.col("ht"), F.col("hc")
    mutual = F.greatest(ht + hc - F.col("joint"), F.lit(0.0))
    expected = F.try_divide(F.col("pt") * F.col("pc"), F.col("all") * (F.col("all") - 1) / 2)
    one = lambda x: F.coalesce(x, F.lit(1.0))
    return row.select(
        one(F.try_divide(2 * mutual, ht + hc)).alias("nmi"),
        one(F.try_divide(F.col("pairs") - expected, (F.col("pt") + F.col("pc")) / 2 - expected)).alias("ari"),
        one(F.try_divide(mutual, ht)).alias("homogeneity"),
        one(F.try_divide(mutual, hc)).alias("completeness"),
    )


def contingency(df: DataFrame, true: str, cluster: str) -> DataFrame:
    return df.groupBy(true, cluster).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------ texts
def length_histogram(df: DataFrame, length: str, by: str, *, edges: int = 40) -> DataFrame:
    """Equal-width bins from 0 to the longest text; the last bin is closed."""
    longest = df.agg(F.max(length).cast("double").alias("x")).scalar()
    bins = edges - 1
    width = F.try_divide(F.col("top"), F.lit(float(bins)))
    return (
        df.withColumn("top", longest)
        .withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col(length), width)), F.lit(bins - 1)), F.lit(0)).cast("long"))
        .groupBy(by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def example_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first text (lowest key) that exercises each path of the normaliser."""
    cases = {
        "URLs / mentions / hashtags": F.col("has_url") | F.col("has_mention") | F.col("has_hashtag"),
        "negation": F.col("has_negation"),
        "emoji / elongation": F.col("has_emoji") | F.col("has_elong"),
        "ordinary post": F.col("n_tokens").between(8, 25),
    }
    firsts = df.agg(
        *[F.min_by(F.struct(F.col(key).alias("key"), F.col(text).alias("text")), F.when(c, F.col(key))).alias(f"c{i}") for i, c in enumerate(cases.values())]
    )
    rows = [F.struct(F.lit(n).alias("example"), F.col(f"c{i}.key").alias(key), F.col(f"c{i}.text").alias("text")) for i, n in enumerate(cases)]
    return firsts.select(F.inline(F.array(*rows))).where(F.col(key).isNotNull())
