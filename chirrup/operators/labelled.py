"""Audit, hold-outs, profile and split of labelled text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chirrup.constants import SEED, SENTIMENTS, TEST_SHARE
from chirrup.functions import metrics as m
from chirrup.functions.social_text import DECODED, with_base_clean
from chirrup.functions.strings import strip
from chirrup.operators.ranking import exact_quantiles, number_within
from chirrup.session import materialise

COLUMNS = ("text_id", "post_text", "sentiment_label", "topic_category")


def text_digest(column: str = "post_text") -> Column:
    """Stands for a text of any length as a grouping key."""
    return F.sha2(F.col(column), 256)


def audit(df: DataFrame, sentiments=SENTIMENTS) -> DataFrame:
    """Violation counts: blank or repeated ids, unknown sentiment, blank topic."""
    blank = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    repeated = df.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    row = df.agg(
        m.count_where(blank("text_id")).alias("blank text_id"),
        m.count_where(~F.coalesce(F.col("sentiment_label").isin(*sentiments), F.lit(False))).alias("unexpected sentiment_label"),
        m.count_where(blank("topic_category")).alias("blank topic_category"),
    ).withColumn("repeated text_id", repeated.agg(F.count(F.lit(1)).alias("n")).scalar())
    return row.unpivot([], row.columns, "problem", "rows")


def require_clean(df: DataFrame, sentiments=SENTIMENTS) -> None:
    """Refuse a data set the audit finds fault with."""
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    found = [f"{r.problem}: {r.rows}" for r in audit(df, sentiments).where("rows > 0").collect()]
    if found:
        raise ValueError("; ".join(found))


@dataclass
class Holdouts:
    modelled: DataFrame
    empty: DataFrame
    duplicates: DataFrame
    counts: DataFrame


def hold_out(df: DataFrame) -> Holdouts:
    """Empty texts and exact repeats (same text and labels, lowest id kept) are set aside."""
    rows = materialise(with_base_clean(df, "post_text").drop(DECODED).withColumn("digest", text_digest()))
    empty = rows.where(F.col("clean") == "")
    full = rows.where(F.col("clean") != "")
    firsts = full.groupBy("digest", "sentiment_label", "topic_category").agg(F.min("text_id").alias("text_id"))
    modelled = full.join(firsts.select("text_id"), "text_id", "left_semi")
    repeats = full.join(firsts.select("text_id"), "text_id", "left_anti")
    count = lambda d: d.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = rows.agg(F.count(F.lit(1)).alias("n_raw")).select(
        "n_raw", count(empty).alias("n_empty"), count(repeats).alias("n_duplicate"), count(modelled).alias("n_modelled")
    ).withColumn("closes", F.col("n_raw") - F.col("n_empty") - F.col("n_duplicate") == F.col("n_modelled"))
    return Holdouts(modelled, empty, repeats, counts)


def conflicting_texts(modelled: DataFrame) -> DataFrame:
    """How many texts carry more than one label of either kind."""
    differs = lambda c: F.min(c) != F.max(c)
    groups = modelled.groupBy(text_digest().alias("digest")).agg(
        (differs("sentiment_label") | differs("topic_category")).alias("conflict")
    )
    return groups.agg(m.count_where(F.col("conflict")).alias("conflicting_texts"))


def label_counts(df: DataFrame) -> DataFrame:
    return (
        df.select("sentiment_label", "topic_category")
        .unpivot([], ["sentiment_label", "topic_category"], "task", "label")
        .groupBy("task", "label")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def length_profile(modelled: DataFrame) -> DataFrame:
    """Characters of the cleaned text."""
    sized = modelled.select(F.length("clean").cast("long").alias("chars"))
    median = exact_quantiles(sized, [], "chars", [0.5]).select(F.col("q")[0].alias("m")).scalar()
    return sized.agg(
        F.min("chars").alias("min"), F.round(F.avg("chars"), 1).alias("mean"), F.max("chars").alias("max")
    ).withColumn("p50", median)


def stratified_split(
    df: DataFrame, *, test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Adds ``split`` ('train' / 'test') with each sentiment x topic stratum in proportion.

    Falls back to sentiment alone when a stratum has fewer than two rows. The test size is
    ``ceil(share * n)``; strata get the floor of their part and the largest remainders one
    more. Within a stratum, rows go by a seeded hash of the id.
    """
    both = F.concat_ws("||", "sentiment_label", "topic_category")
    smallest = df.groupBy(both.alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    rows = df.withColumn(
        "stratum", F.when(smallest.scalar() >= 2, both).otherwise(F.col("sentiment_label"))
    ).withColumn("_h", F.xxhash64(F.lit(seed), F.col("text_id")))
    numbered = materialise(number_within(rows, ["stratum"], ["_h", "text_id"], "_rn", "_size"))
    quotas = _largest_remainders(numbered.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), test_share)
    return (
        numbered.join(quotas.select("stratum", "quota"), "stratum")
        .withColumn("split", F.when(F.col("_rn") <= F.col("quota"), "test").otherwise("train"))
        .drop("_h", "_rn", "_size", "quota")
    )


def _largest_remainders(strata: DataFrame, share: float) -> DataFrame:
    """Test rows per stratum; a row per label combination, hence the plain windows."""
    from pyspark.sql import Window

    whole = Window.partitionBy()
    exact = F.col("n") * F.ceil(F.sum("n").over(whole) * F.lit(share)) / F.sum("n").over(whole)
    parts = strata.withColumn("exact", exact).withColumn("quota", F.floor("exact"))
    left = F.ceil(F.sum("n").over(whole) * F.lit(share)) - F.sum("quota").over(whole)
    order = Window.orderBy(F.desc(F.col("exact") - F.col("quota")), "stratum")
    return parts.withColumn("left", left).withColumn("place", F.row_number().over(order)).withColumn(
        "quota", (F.col("quota") + (F.col("place") <= F.col("left")).cast("long")).cast("long")
    )


def split_manifest(split: DataFrame) -> DataFrame:
    """Rows per split and label, and the overlap of ids, which must be zero."""
    overlap = (
        split.groupBy("text_id").agg(F.count_distinct("split").alias("s")).agg(m.count_where(F.col("s") > 1).alias("n"))
    )
    return (
        split.select("split", "sentiment_label", "topic_category")
        .unpivot(["split"], ["sentiment_label", "topic_category"], "task", "label")
        .groupBy("split", "task", "label")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("id_overlap", overlap.scalar())
    )


def with_folds(df: DataFrame, label: str, folds: int, *, seed: int = SEED, key: str = "text_id") -> DataFrame:
    """Stratified folds ``fold`` 0..k-1; never more than the smallest class has rows, at least two."""
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    k = max(2, min(folds, smallest))
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    numbered = number_within(hashed, [label], ["_h", key], "_rn")
    return numbered.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn")
