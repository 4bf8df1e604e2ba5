"""Expectations: counts of rows that break a rule Spark itself does not enforce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chirrup.constants import ANOMALY_TYPES, PLATFORMS
from chirrup.functions import metrics as m


KEY_PARTS = 256  # nearly every key is a row of its own, so a task's table of them has that share of the rows


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; counted in a fixed number of parts, which are never merged into a few."""
    return df.select(*columns).repartition(KEY_PARTS, *columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def unique(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    extra = duplicates(df, columns).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("violations"))
    return extra.select(F.lit(name).alias("expectation"), "violations")


def foreign_key(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows whose key the parent lacks; counted per key before the join."""
    counted = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = counted.join(parent.select(key).distinct(), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(name).alias("expectation"), "violations")


def predicates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows for which a rule is false or unknown, all rules in one pass."""
    broken = [m.count_where(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    rows = [F.struct(F.lit(n).alias("expectation"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)]
    return df.agg(*broken).select(F.inline(F.array(*rows)))


def one_of(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isin(*allowed)


def at_least_zero_or_null(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) >= 0)


def some_metric_known() -> Column:
    return F.coalesce(*[F.col(c) for c in m.METRICS]).isNotNull()


def post_rules(platforms: Sequence[str] = PLATFORMS) -> dict[str, Column]:
    return {
        "platform is known": one_of("platform", platforms),
        **{f"{c} is set": F.col(c).isNotNull() for c in ("post_id", "user_id", "posted_at", "post_month")},
        **{f"{c} >= 0 or NULL": at_least_zero_or_null(c) for c in m.METRICS},
        "likes_restored is 0 or 1": F.col("likes_restored").isin(0, 1),
        "some metric is known": some_metric_known(),
    }


def table_expectations(
    posts: DataFrame, users: DataFrame, tags: DataFrame, anomalies: DataFrame, *, platforms: Sequence[str] = PLATFORMS
) -> DataFrame:
    """Keys, references, enumerations, ranges and the row rule of the analysis tables."""
    parts = [
        unique(posts, ["post_id"], "posts: post_id is unique"),
        unique(users, ["user_id"], "users: user_id is unique"),
        unique(tags, ["post_id", "tag"], "post_tags: (post_id, tag) is unique"),
        unique(anomalies, ["post_id", "anomaly_type"], "anomalies: (post_id, anomaly_type) is unique"),
        foreign_key(posts, users, "user_id", "posts: user_id refers to users"),
        foreign_key(tags, posts, "post_id", "post_tags: post_id refers to posts"),
        predicates(posts, post_rules(platforms)),
        predicates(users, {"follower_count >= 0": F.col("follower_count") >= 0}),
        predicates(anomalies, {"anomaly_type is known": one_of("anomaly_type", ANOMALY_TYPES)}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hour_rules() -> dict[str, Column]:
    return {"hour is 0..23": F.col("post_hour").between(0, 23), "has_time is 0 or 1": F.col("has_time").isin(0, 1)}


def compare_claims(claimed: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Published values next to recomputed ones, and whether they agree."""
    joined = claimed.select(*keys, F.col(value).alias("claimed")).join(
        actual.select(*keys, F.col(value).alias("recomputed")), list(keys), "full"
    )
    return joined.withColumn(
        "agrees", F.coalesce(F.abs(F.col("claimed") - F.col("recomputed")) <= tolerance, F.lit(False))
    )


def publish_claims(stats: DataFrame, key: str, decimals: dict[str, int], path: str) -> None:
    """Write figures as they are published: text (key, claim, published), rounded to each one's decimals."""
    claims = [
        F.struct(F.lit(n).alias("claim"), F.format_string(f"%.{d}f", F.col(n).cast("double")).alias("published"))
        for n, d in decimals.items()
    ]
    stats.select(key, F.inline(F.array(*claims))).write.option("header", True).csv(path)


def read_claims(spark: SparkSession, key: str, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(f"{key} string, claim string, published string").csv(path)


def check_claims(claims: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Published figures next to the recomputed ones: (key, claim, claimed, recomputed, agrees).

    They agree within half a unit of the last digit that was published. A claim whose figure no longer exists
    or isn't a number disagrees, and so does a figure of a claimed kind that nothing was published for.
    """
    names = [c for c in stats.columns if c != key]
    figures = [F.struct(F.lit(n).alias("claim"), F.col(n).cast("double").alias("recomputed")) for n in names]
    now = stats.select(F.col(key).alias("k"), F.inline(F.array(*figures))).withColumnRenamed("claim", "c")
    kinds = claims.select(F.col("claim").alias("c")).distinct()
    now = now.join(kinds, "c", "left_semi")
    both = claims.join(now, F.col(key).eqNullSafe(F.col("k")) & (F.col("claim") == F.col("c")), "full")
    digits = F.length(F.regexp_extract("published", r"\.([0-9]+)$", 1))
    claimed = F.expr("try_cast(published as double)")
    near = F.abs(claimed - F.col("recomputed")) <= 0.5 * F.pow(F.lit(10.0), -digits) + 1e-9
    return both.select(
        F.when(F.col("claim").isNull(), F.col("k")).otherwise(F.col(key)).alias(key),
        F.coalesce("claim", "c").alias("claim"),
        claimed.alias("claimed"),
        "recomputed",
        F.coalesce(near, F.lit(False)).alias("agrees"),
    )
