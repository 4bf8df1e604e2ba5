"""Derived relations the analyses share: enriched posts, totals per grain, tags, raw defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chirrup.constants import MISSING_WORDS_UPPER
from chirrup.functions import metrics as m

HASHTAG = "#([A-Za-z][A-Za-z0-9_]*)"
MENTION = "@([A-Za-z][A-Za-z0-9_]*)"


def enriched(posts: DataFrame) -> DataFrame:
    return posts.withColumns(
        {
            "engagement": m.engagement(),
            "amplify_ratio": m.amplify_ratio(),
            "partial_metrics": m.partial_metrics(),
        }
    )


def monthly(posts: DataFrame) -> DataFrame:
    """Per month; ``approx_reach`` averages the first known of the three counts."""
    return (
        posts.withColumn("engagement", m.engagement())
        .groupBy("post_month")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.avg(F.coalesce("likes", "shares", "comments")).alias("approx_reach"),
            F.sum("engagement").alias("total_engagement"),
            F.avg("engagement").alias("mean_engagement"),
            F.sum("likes_restored").alias("repaired_like_rows"),
        )
    )


def posting_users(posts: DataFrame) -> DataFrame:
    """User-grain sums straight from the posts.

    Every analysis that joins users aggregates here first: the sums combine map-side, so a
    user with a third of all posts reaches the join as one row per task.
    """
    e = m.engagement()
    return posts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum(e).alias("total_engagement"),
        F.sum(e.cast("double") * e).alias("sum_squares"),
        F.max(F.coalesce(F.col("shares") > F.col("likes"), F.lit(False))).alias("over_shared"),
    ).withColumn("avg_engagement", F.col("total_engagement") / F.col("n_posts"))


def user_totals(posts: DataFrame, users: DataFrame) -> DataFrame:
    per_user = posting_users(posts).drop("sum_squares", "over_shared")
    return per_user.join(users.select("user_id", "location", "language", "follower_count"), "user_id").select(
        "user_id",
        "location",
        "language",
        "follower_count",
        "n_posts",
        "total_engagement",
        "avg_engagement",
        F.col("avg_engagement").alias("eng_per_post"),
    )


def location_totals(posts: DataFrame, users: DataFrame) -> DataFrame:
    return (
        user_totals(posts, users)
        .groupBy("location")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.sum("n_posts").alias("n_posts"),
            F.sum("total_engagement").alias("total_engagement"),
        )
        .withColumn("avg_engagement_per_post", F.col("total_engagement") / F.col("n_posts"))
    )


def platform_totals(posts: DataFrame) -> DataFrame:
    """Averages that read a missing count as zero; every label is kept, the unspecified one too."""
    def zero(name: str) -> Column:
        return F.avg(F.coalesce(F.col(name), F.lit(0)))

    return (
        posts.withColumn("engagement", m.engagement())
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("n_posts"),
            F.avg("engagement").alias("avg_engagement"),
            F.sum("engagement").alias("total_engagement"),
            zero("likes").alias("avg_likes"),
            zero("shares").alias("avg_shares"),
            zero("comments").alias("avg_comments"),
            F.count("likes").alias("rows_with_likes"),
        )
    )


# ---------------------------------------------------------------------- text-born relations
def hashtags(text: Column) -> Column:
    """Distinct hashtags of a text, without the sign, case kept."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1)))


def mentions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)))


def post_tags(posts: DataFrame, text: str = "text_content") -> DataFrame:
    return posts.select("post_id", F.explode(hashtags(F.col(text))).alias("tag"))


# ---------------------------------------------------------------------- raw defects
def _missing_word(column: str) -> Column:
    folded = F.translate(F.coalesce(F.col(column), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.upper(F.trim(folded)).isin(*MISSING_WORDS_UPPER)


def _number_or_zero(column: str) -> Column:
    """Leading number of a string, junk reading as zero."""
    return F.coalesce(F.trim(F.col(column)).try_cast("double"), F.lit(0.0))


def anomaly_scan(raw: DataFrame) -> DataFrame:
    """The four corruption signatures, one flag each, on unrepaired rows."""
    flag = lambda c: c.cast("long")
    return raw.select(
        "row_no",
        "post_id",
        flag(_number_or_zero("likes") < 0).alias("is_negative_likes"),
        flag(_missing_word("platform")).alias("is_missing_platform"),
        flag(_missing_word("text_content")).alias("is_missing_text"),
        F.coalesce(flag(F.col("text_content").rlike("(?i)&amp;|&lt;|&gt;|<div|<br")), F.lit(0)).alias(
            "is_html_markup"
        ),
        F.trim("likes").alias("raw_likes"),
        F.trim("platform").alias("raw_platform"),
        F.col("text_content").alias("raw_text"),
    )


def post_anomalies(scan: DataFrame) -> DataFrame:
    """One row per (post, defect) with the first matching piece of evidence."""
    text = F.lower("raw_text")
    markup = F.lit("contains <br>")
    for sign in ("<div", "&gt;", "&lt;", "&amp;"):
        label = "contains <div>" if sign == "<div" else f"contains {sign}"
        markup = F.when(text.contains(sign), label).otherwise(markup)
    found = [
        ("is_negative_likes", "NEGATIVE_LIKES", F.concat(F.lit("raw likes = "), F.col("raw_likes"))),
        (
            "is_missing_platform",
            "MISSING_PLATFORM",
            F.when(F.coalesce(F.col("raw_platform"), F.lit("")) == "", "platform is blank").otherwise(
                F.concat(F.lit("platform = "), F.col("raw_platform"))
            ),
        ),
        ("is_missing_text", "MISSING_TEXT", F.lit("text_content is blank or the NULL token")),
        ("is_html_markup", "HTML_ENTITY_OR_TAG", markup),
    ]
    rows = F.array(
        *[
            F.when(F.col(flag) == 1, F.struct(F.lit(kind).alias("anomaly_type"), proof.alias("evidence")))
            for flag, kind, proof in found
        ]
    )
    return (
        scan.select("post_id", F.explode(F.array_compact(rows)).alias("d"))
        .groupBy("post_id", F.col("d.anomaly_type").alias("anomaly_type"))
        .agg(F.min("d.evidence").alias("evidence"))
    )
