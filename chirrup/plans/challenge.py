"""Second set of named analyses: popularity, cohorts, users, platforms, anomalies.

Thresholds are keyword arguments; their defaults are the published readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chirrup.constants import ANOMALY_TYPES, SAYS, UNSPECIFIED
from chirrup.functions import metrics as m
from chirrup.operators import relations as rel
from chirrup.operators.ranking import global_row_number, ntile_of


def all_rows():
    """One window over everything: only ever over aggregated rows."""
    return Window.partitionBy()


def _labelled() -> Column:
    return F.col("platform") != UNSPECIFIED


def _rank(by: Column) -> Column:
    return m.long(F.rank().over(Window.orderBy(by)))


def _with_engagement(posts: DataFrame) -> DataFrame:
    return posts.withColumn("engagement", m.engagement())


def _z(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """Two-sample z from population variances."""
    return F.try_divide(mean_a - mean_b, F.sqrt(F.greatest(var_a, F.lit(0.0)) / n_a + F.greatest(var_b, F.lit(0.0)) / n_b))


def _eligibility(gap_text: str) -> Column:
    return F.when(F.col("platform") == UNSPECIFIED, gap_text).otherwise(SAYS["platform"])


# ------------------------------------------------------------------------------ easy
def top_platform(posts: DataFrame) -> DataFrame:
    return (
        posts.where(_labelled())
        .groupBy("platform")
        .agg(F.count(F.lit(1)).alias("n_posts"))
        .orderBy(F.desc("n_posts"), "platform")
        .limit(1)
    )


def platform_uniformity(posts: DataFrame, *, critical: float = 9.488, df: int = 4) -> DataFrame:
    """Chi-square of the labelled platforms against an even split."""
    counts = posts.where(_labelled()).groupBy("platform").agg(F.count(F.lit(1)).alias("n_posts"))
    expected = F.avg("n_posts").over(all_rows())
    terms = counts.select(
        "platform",
        "n_posts",
        F.sum("n_posts").over(all_rows()).alias("all"),
        expected.alias("expected"),
        (F.pow(F.col("n_posts") - expected, 2) / expected).alias("term"),
    ).withColumn("total", F.sum("term").over(all_rows()))
    return terms.select(
        "platform",
        "n_posts",
        F.round(m.percent(F.col("n_posts"), F.col("all")), 2).alias("pct_share"),
        F.round("expected", 1).alias("expected_if_uniform"),
        F.round("term", 4).alias("chi2_term"),
        F.round("total", 4).alias("chi2_total"),
        F.lit(df).alias("df"),
        F.when(F.col("total") > critical, SAYS["uniform_no"]).otherwise(SAYS["uniform_yes"]).alias("verdict_at_5pct"),
    ).orderBy(F.desc("n_posts"), "platform")


def _comparable(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("likes").isNotNull()).select(
        "post_id", "user_id", "platform", "likes", "shares", "comments", m.engagement().alias("total_engagement")
    )


def top_posts(posts: DataFrame, *, top: int = 10) -> DataFrame:
    return _comparable(posts).orderBy(F.desc("total_engagement"), "post_id").limit(top)


def top_posts_margin(posts: DataFrame, *, place: int = 10, closeness: float = 0.99) -> DataFrame:
    """How thin the cut at the tenth place is."""
    total = F.col("total_engagement")
    ranked = _comparable(posts).select("post_id", "total_engagement")
    cut = ranked.orderBy(F.desc("total_engagement"), "post_id").offset(place - 1).limit(1)
    nth = cut.select("total_engagement").scalar()
    return (
        ranked.withColumn("nth", nth)
        .agg(
            F.count(F.lit(1)).alias("comparable_posts"),
            F.max(total).alias("best_engagement"),
            F.first("nth").alias("tenth_place_engagement"),
            m.count_where(total >= closeness * F.col("nth")).alias("posts_within_1pct_of_cut"),
        )
        .withColumn(
            "best_over_tenth_pct",
            F.round(m.percent(F.col("best_engagement"), F.col("tenth_place_engagement")) - 100.0, 2),
        )
        .where(F.col("tenth_place_engagement").isNotNull())
    )


def platform_averages(posts: DataFrame) -> DataFrame:
    """Means that skip missing counts; rank over all labels, the unspecified one marked."""
    table = (
        _with_engagement(posts)
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("n_posts"),
            F.count("likes").alias("rows_with_likes"),
            *[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in m.METRICS],
            F.avg("engagement").alias("mean"),
        )
    )
    return table.select(
        "platform",
        "n_posts",
        "rows_with_likes",
        *[f"avg_{c}" for c in m.METRICS],
        F.round("mean", 1).alias("avg_total_engagement"),
        _rank(F.desc("mean")).alias("engagement_rank"),
        _eligibility(SAYS["gap"]).alias("eligibility"),
    ).orderBy(F.desc("avg_total_engagement"))


def platform_winner_test(posts: DataFrame, *, critical: float = 1.96) -> DataFrame:
    """Is the best platform's mean distinguishable from the runner-up's?"""
    stats = (
        _with_engagement(posts)
        .where(_labelled())
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("engagement").alias("mean"),
            F.var_pop("engagement").alias("var"),
        )
        .withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "platform")))
    )

    def of(place: int) -> Column:
        return F.max(F.when(F.col("place") == place, F.struct("platform", "mean", "var", "n")))

    pair = stats.where(F.col("place") <= 2).agg(of(1).alias("w"), of(2).alias("r")).where(F.col("r").isNotNull())
    gap = F.col("w.mean") - F.col("r.mean")
    z = _z(F.col("w.mean"), F.col("w.var"), F.col("w.n"), F.col("r.mean"), F.col("r.var"), F.col("r.n"))
    return pair.select(
        F.col("w.platform").alias("winner"),
        F.round("w.mean", 1).alias("winner_avg_engagement"),
        F.col("r.platform").alias("runner_up"),
        F.round("r.mean", 1).alias("runner_up_avg_engagement"),
        F.round(gap, 1).alias("absolute_gap"),
        F.round(m.percent(gap, F.col("r.mean")), 2).alias("gap_pct"),
        F.round(z, 3).alias("z_stat"),
        F.when(F.abs(z) > critical, SAYS["sig"]).otherwise(SAYS["not_sig_rank"]).alias("verdict"),
    )


def _shared_unliked(shares_over: int, likes_under: int) -> Column:
    return (F.col("shares") > shares_over) & (F.col("likes") < likes_under)


def shared_but_unliked(posts: DataFrame, *, shares_over: int = 1500, likes_under: int = 500) -> DataFrame:
    return (
        posts.where(_shared_unliked(shares_over, likes_under))
        .select("post_id", "platform", *m.METRICS)
        .orderBy(F.desc("shares"), "post_id")
    )


def shared_but_unliked_rate(posts: DataFrame, *, shares_over: int = 1500, likes_under: int = 500) -> DataFrame:
    return (
        posts.groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("n_posts"),
            m.count_where(_shared_unliked(shares_over, likes_under)).alias("flagged_posts"),
        )
        .withColumn("pct_of_platform", F.round(m.percent(F.col("flagged_posts"), F.col("n_posts")), 2))
        .orderBy(F.desc("pct_of_platform"), "platform")
    )


def large_audiences(users: DataFrame, *, over: int = 40_000) -> DataFrame:
    return (
        users.where(F.col("follower_count") > over)
        .select("user_id", "location", "language", "follower_count")
        .orderBy(F.desc("follower_count"), "user_id")
    )


# ------------------------------------------------------------------------------ medium
def location_engagement(posts: DataFrame, users: DataFrame) -> DataFrame:
    return (
        rel.location_totals(posts, users)
        .select("location", "n_posts", "total_engagement", _rank(F.desc("total_engagement")).alias("engagement_rank"))
        .orderBy(F.desc("total_engagement"), "location")
    )


def location_rank_shift(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Rank by total against rank by mean: large locations lead only by size."""
    ranked = rel.location_totals(posts, users).withColumns(
        {
            "rank_by_total": _rank(F.desc("total_engagement")),
            "rank_by_avg_per_post": _rank(F.desc("avg_engagement_per_post")),
        }
    )
    return ranked.select(
        "location",
        "n_posts",
        "total_engagement",
        F.round("avg_engagement_per_post", 1).alias("avg_engagement_per_post"),
        "rank_by_total",
        "rank_by_avg_per_post",
        (F.col("rank_by_total") - F.col("rank_by_avg_per_post")).alias("rank_shift"),
    ).orderBy("rank_by_total", "location")


def _cohorts(posts: DataFrame, users: DataFrame, cut: int) -> DataFrame:
    """Sums of the two follower cohorts, from user-grain sums."""
    n, s, ss = F.sum("n_posts"), F.sum("total_engagement"), F.sum("sum_squares")
    return (
        rel.posting_users(posts)
        .join(users.select("user_id", "follower_count"), "user_id")
        .groupBy((F.col("follower_count") >= cut).alias("high"))
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            n.alias("n"),
            s.alias("total"),
            (s / n).alias("mean"),
            F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0)).alias("var"),
        )
    )


def follower_cohorts(posts: DataFrame, users: DataFrame, *, cut: int = 25_000) -> DataFrame:
    return (
        _cohorts(posts, users, cut)
        .select(
            F.when(F.col("high"), SAYS["cohort_high"]).otherwise(SAYS["cohort_low"]).alias("cohort"),
            "n_users",
            F.col("n").alias("n_posts"),
            F.round("mean", 2).alias("avg_engagement_per_post"),
            F.col("total").alias("total_engagement"),
            F.round(F.sqrt("var"), 1).alias("sd_engagement"),
        )
        .orderBy(F.desc("avg_engagement_per_post"))
    )


def follower_cohort_test(
    posts: DataFrame, users: DataFrame, *, cut: int = 25_000, critical: float = 1.96
) -> DataFrame:
    side = lambda high: F.max(F.when(F.col("high") == high, F.struct("mean", "var", "n")))
    pair = (
        _cohorts(posts, users, cut)
        .agg(side(True).alias("h"), side(False).alias("l"))
        .where(F.col("h").isNotNull() & F.col("l").isNotNull())
    )
    gap = F.col("h.mean") - F.col("l.mean")
    z = _z(F.col("h.mean"), F.col("h.var"), F.col("h.n"), F.col("l.mean"), F.col("l.var"), F.col("l.n"))
    return pair.select(
        F.round("l.mean", 2).alias("low_follower_avg"),
        F.round("h.mean", 2).alias("high_follower_avg"),
        F.round(gap, 2).alias("difference"),
        F.round(m.percent(gap, F.col("l.mean")), 2).alias("difference_pct"),
        F.round(z, 3).alias("z_stat"),
        F.when(F.abs(z) > critical, SAYS["sig"]).otherwise(SAYS["not_sig_followers"]).alias("verdict"),
    )


def most_active_users(posts: DataFrame, users: DataFrame, *, top: int = 10) -> DataFrame:
    return (
        rel.user_totals(posts, users)
        .select("user_id", "follower_count", "location", "n_posts", "total_engagement")
        .orderBy(F.desc("n_posts"), F.desc("total_engagement"), "user_id")
        .limit(top)
    )


def active_users_tie_band(posts: DataFrame, *, place: int = 10) -> DataFrame:
    counts = posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_posts"))
    cut = counts.orderBy(F.desc("n_posts"), "user_id").offset(place - 1).limit(1).select("n_posts").scalar()
    # few distinct post counts: aggregate the users to those first
    sizes = counts.groupBy("n_posts").agg(F.count(F.lit(1)).alias("users")).withColumn("cut", cut)
    return (
        sizes.agg(
            F.max("n_posts").alias("busiest_user_posts"),
            F.min("n_posts").alias("quietest_user_posts"),
            F.first("cut").alias("tenth_place_posts"),
            F.sum(F.when(F.col("n_posts") == F.col("cut"), F.col("users"))).alias("users_tied_at_the_cut"),
            F.count(F.lit(1)).alias("distinct_post_counts"),
        )
        .where(F.col("tenth_place_posts").isNotNull())
    )


def _per_user_platform(posts: DataFrame) -> DataFrame:
    """Labelled posts summed per (user, platform) before any join with users."""
    return (
        posts.where(_labelled())
        .groupBy("user_id", "platform")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(m.engagement()).alias("total"))
    )


def platforms_of_large_users(posts: DataFrame, users: DataFrame, *, at_least: int = 30_000) -> DataFrame:
    eligible = users.where(F.col("follower_count") >= at_least).select("user_id")
    n, mean = F.sum("n"), F.sum("total") / F.sum("n")
    return (
        _per_user_platform(posts)
        .join(eligible, "user_id", "left_semi")
        .groupBy("platform")
        .agg(n.alias("n_posts"), mean.alias("mean"))
        .select(
            "platform",
            "n_posts",
            F.round("mean", 1).alias("avg_engagement_per_post"),
            _rank(F.desc("mean")).alias("rank_within_cohort"),
        )
        .orderBy(F.desc("avg_engagement_per_post"))
    )


def platform_winner_ladder(
    posts: DataFrame, users: DataFrame, *, thresholds: Sequence[int] = (25_000, 30_000, 35_000, 40_000, 45_000)
) -> DataFrame:
    """Best platform at each follower threshold; a user counts on every rung it reaches."""
    rungs = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("follower_count") >= t)
    reached = (
        users.where(F.col("follower_count") >= min(thresholds))
        .select("user_id", F.explode(rungs).alias("follower_threshold"))
    )
    best = Window.partitionBy("follower_threshold").orderBy(F.desc("mean"), "platform")
    return (
        _per_user_platform(posts)
        .join(reached, "user_id")
        .groupBy("follower_threshold", "platform")
        .agg(F.sum("n").alias("n_posts"), (F.sum("total") / F.sum("n")).alias("mean"))
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select(
            "follower_threshold",
            F.col("platform").alias("winning_platform"),
            "n_posts",
            F.round("mean", 1).alias("avg_engagement_per_post"),
        )
        .orderBy("follower_threshold")
    )


def suspicious_posts(posts: DataFrame, *, top: int = 20) -> DataFrame:
    """Posts shared more often than liked and commented on together."""
    reactions = F.col("likes") + F.coalesce(F.col("comments"), F.lit(0))
    return (
        posts.where(F.col("likes").isNotNull() & (F.col("shares") > reactions))
        .select(
            "post_id",
            "user_id",
            "platform",
            *m.METRICS,
            (F.col("shares") - reactions).alias("excess_shares"),
            F.round(m.ratio(F.col("shares"), reactions), 2).alias("share_to_reaction_ratio"),
        )
        .orderBy(F.desc("excess_shares"), "post_id")
        .limit(top)
    )


def suspicious_counts(posts: DataFrame) -> DataFrame:
    """Strict and loose reading of the rule above, and what only blanks explain."""
    loose = F.col("shares") > F.coalesce(F.col("likes"), F.lit(0)) + F.coalesce(F.col("comments"), F.lit(0))
    known = F.col("likes").isNotNull()
    counts = posts.agg(
        m.count_where(loose & known).alias("strict_definition"),
        m.count_where(loose).alias("likes_read_as_zero"),
        m.count_where(loose & ~known).alias("anomalies_created_by_blanks"),
    )
    gap = F.col("likes_read_as_zero") - F.col("strict_definition")
    return counts.select(
        "*",
        gap.alias("arithmetic_gap"),
        F.round(m.percent(F.col("anomalies_created_by_blanks"), F.col("likes_read_as_zero")), 2).alias(
            "pct_of_loose_that_is_missing_data"
        ),
        F.when(gap == F.col("anomalies_created_by_blanks"), SAYS["blanks_all"])
        .otherwise(SAYS["blanks_not"])
        .alias("reconciliation"),
    )


# ------------------------------------------------------------------------------ hard
def _overall_mean(per_user: DataFrame) -> Column:
    """Mean engagement per post over all users, as a scalar subquery."""
    return per_user.agg((F.sum("total_engagement") / F.sum("n_posts")).alias("mean")).scalar()


def exceptional_users(posts: DataFrame, users: DataFrame, *, multiple: float = 2.0) -> DataFrame:
    per_user = rel.posting_users(posts)
    return (
        per_user.where(F.col("avg_engagement") > multiple * _overall_mean(per_user))
        .join(users.select("user_id", "location", "follower_count"), "user_id")
        .select("user_id", "location", "follower_count", "n_posts", F.round("avg_engagement", 2).alias("avg_engagement"))
        .orderBy(F.desc("avg_engagement"), "user_id")
    )


def exceptional_users_proof(posts: DataFrame, *, multiple: float = 2.0) -> DataFrame:
    """Why the list above holds what it holds: the best user's multiple of the baseline."""
    per_user = rel.posting_users(posts)
    best = per_user.orderBy(F.desc("avg_engagement"), "user_id").limit(1)
    row = per_user.withColumn("base", _overall_mean(per_user)).agg(
        F.first("base").alias("base"),
        F.count(F.lit(1)).alias("users_examined"),
        F.max("avg_engagement").alias("top"),
        m.count_where(F.col("avg_engagement") > multiple * F.col("base")).alias("qualifying_users"),
    )
    return row.select(
        F.round("base", 2).alias("overall_avg_per_post"),
        F.round(multiple * F.col("base"), 2).alias("threshold_2x"),
        "users_examined",
        F.round("top", 2).alias("highest_user_avg"),
        best.select("user_id").scalar().alias("highest_avg_user"),
        F.round(F.try_divide(F.col("top"), F.col("base")), 3).alias("highest_avg_as_multiple_of_baseline"),
        "qualifying_users",
        F.when(F.col("top") > multiple * F.col("base"), SAYS["h1_reachable"])
        .otherwise(SAYS["h1_empty"])
        .alias("verdict"),
    )


def exceptional_users_ladder(
    posts: DataFrame, *, factors: Sequence[float] = (1.25, 1.5, 1.75, 2.0)
) -> DataFrame:
    """Users above each multiple of the baseline; rungs nobody reaches stay with zero."""
    per_user = rel.posting_users(posts)
    base = F.col("base")
    counts = per_user.withColumn("base", _overall_mean(per_user)).agg(
        F.first("base").alias("base"),
        *[m.count_where(F.col("avg_engagement") > f * base).alias(f"n{i}") for i, f in enumerate(factors)],
    )
    rungs = F.array(
        *[
            F.struct(
                F.lit(f"{f:.2f}x").alias("multiple"),
                F.round(f * base, 2).alias("threshold"),
                F.col(f"n{i}").alias("users_qualifying"),
            )
            for i, f in enumerate(factors)
        ]
    )
    return counts.select(F.inline(rungs))


def _podium(posts: DataFrame, users: DataFrame, places: int) -> DataFrame:
    """First ``places`` users per location; the group limit prunes before the shuffle."""
    order = Window.partitionBy("location").orderBy(F.desc("total_engagement"), F.desc("n_posts"), "user_id")
    return (
        rel.user_totals(posts, users)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= places)
    )


def location_podium(posts: DataFrame, users: DataFrame, *, places: int = 3) -> DataFrame:
    return (
        _podium(posts, users, places)
        .select(
            "location",
            m.long(F.col("place")).alias("rank_in_location"),
            "user_id",
            "follower_count",
            "n_posts",
            "total_engagement",
        )
        .orderBy("location", "rank_in_location")
    )


def podium_margins(posts: DataFrame, users: DataFrame, *, top: int = 8) -> DataFrame:
    """Where third and fourth place are closest."""
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("total_engagement")))
    return (
        _podium(posts, users, 4)
        .groupBy("location")
        .agg(at(3).alias("third_place"), at(4).alias("fourth_place"))
        .withColumn("absolute_margin", F.col("third_place") - F.col("fourth_place"))
        .withColumn("margin_pct", F.round(m.percent(F.col("absolute_margin"), F.col("fourth_place")), 2))
        .orderBy(F.asc_nulls_first("margin_pct"), "location")
        .limit(top)
    )


def _platform_means(posts: DataFrame) -> DataFrame:
    """A row per platform label; Catalyst broadcasts it when its size allows."""
    return (
        _with_engagement(posts)
        .groupBy("platform")
        .agg(F.count(F.lit(1)).alias("platform_posts"), F.avg("engagement").alias("platform_mean"))
    )


def above_platform_average(posts: DataFrame, *, multiple: float = 2.0) -> DataFrame:
    means = _platform_means(posts)
    return (
        _with_engagement(posts)
        .where(_labelled())
        .join(means, "platform")
        .where(F.col("engagement") >= multiple * F.col("platform_mean"))
        .select(
            "post_id",
            "user_id",
            "platform",
            *m.METRICS,
            F.round("platform_mean", 1).alias("platform_avg_engagement"),
            F.col("engagement").alias("post_engagement"),
            F.round(F.col("engagement") / F.col("platform_mean"), 3).alias("multiple_of_platform_avg"),
        )
        .orderBy(F.desc("multiple_of_platform_avg"), "post_id")
    )


def above_platform_average_rate(posts: DataFrame, *, multiple: float = 2.0) -> DataFrame:
    means = _platform_means(posts)
    hits = (
        _with_engagement(posts)
        .join(means, "platform")
        .groupBy("platform")
        .agg(m.count_where(F.col("engagement") >= multiple * F.col("platform_mean")).alias("hits"))
    )
    return (
        means.join(hits, "platform", "left")
        .select(
            "platform",
            F.col("platform_posts").alias("n_posts"),
            F.round("platform_mean", 1).alias("platform_avg_engagement"),
            F.round(multiple * F.col("platform_mean"), 1).alias("exceptional_threshold"),
            F.coalesce("hits", F.lit(0)).alias("exceptional_posts"),
            F.round(m.percent(F.coalesce("hits", F.lit(0)), F.col("platform_posts")), 2).alias("pct_of_platform"),
            _eligibility(SAYS["gap_h3"]).alias("eligibility"),
        )
        .orderBy(F.desc("pct_of_platform"), "platform")
    )


def _ranked_users(posts: DataFrame) -> DataFrame:
    """Posting users numbered by total engagement, best first."""
    per_user = rel.posting_users(posts).select("user_id", "n_posts", "total_engagement", "avg_engagement")
    numbered = global_row_number(per_user, [F.desc("total_engagement"), "user_id"], "rn", "n_all")
    return numbered.withColumn("engagement_decile", ntile_of(F.col("rn"), F.col("n_all"), 10))


def small_audience_high_engagement(posts: DataFrame, users: DataFrame, *, followers_under: int = 5_000) -> DataFrame:
    """Users in the top engagement decile with few followers."""
    top = _ranked_users(posts).where("engagement_decile = 1")
    floor = top.agg(F.min("total_engagement").alias("f")).scalar()
    return (
        top.join(users.where(F.col("follower_count") < followers_under), "user_id")
        .select(
            "user_id",
            "location",
            "follower_count",
            "n_posts",
            "total_engagement",
            F.round("avg_engagement", 2).alias("avg_engagement_per_post"),
            "engagement_decile",
            floor.alias("top_decile_floor_engagement"),
        )
        .orderBy(F.desc("total_engagement"), "user_id")
    )


def decile_definitions(
    posts: DataFrame, users: DataFrame, *, followers_under: int = 5_000, share: float = 0.10
) -> DataFrame:
    """Does a bucket cut and an explicit percentile cut select the same users?"""
    ranked = _ranked_users(posts)
    in_bucket, in_share = F.col("engagement_decile") == 1, F.col("rn") <= F.col("n_all") * share
    small = (
        ranked.where(in_bucket | in_share)
        .join(users.where(F.col("follower_count") < followers_under).select("user_id"), "user_id", "left_semi")
        .agg(m.count_where(in_bucket).alias("via_ntile_10_buckets"), m.count_where(in_share).alias("via_explicit_percentile"))
    )
    floor = ranked.where(in_share).agg(F.min("total_engagement").alias("f")).scalar()
    return small.select(
        floor.alias("top_decile_floor_engagement"),
        "*",
        F.when(F.col("via_ntile_10_buckets") == F.col("via_explicit_percentile"), SAYS["ntile_agree"])
        .otherwise(SAYS["ntile_differ"])
        .alias("robustness"),
    )


def corrupt_posts(anomalies: DataFrame) -> DataFrame:
    """Each corrupt post with its defects in a fixed order."""
    has = {t: F.bool_or(F.col("anomaly_type") == t).alias(t) for t in ANOMALY_TYPES}
    names = F.array(*[F.when(F.col(t), F.lit(t)) for t in ANOMALY_TYPES])
    return (
        anomalies.groupBy("post_id")
        .agg(F.count(F.lit(1)).alias("n_anomalies"), *has.values())
        .select("post_id", "n_anomalies", F.array_join(F.array_compact(names), " ").alias("anomaly_types"))
        .orderBy(F.desc("n_anomalies"), "post_id")
    )


def anomaly_families(scan: DataFrame) -> DataFrame:
    """Per defect: intake rows, distinct posts, and the rows that were replays."""
    flags = {
        "NEGATIVE_LIKES": "is_negative_likes",
        "MISSING_PLATFORM": "is_missing_platform",
        "MISSING_TEXT": "is_missing_text",
        "HTML_ENTITY_OR_TAG": "is_html_markup",
    }
    # one pass per post, then one over posts: replays of a post meet here
    per_post = scan.groupBy("post_id").agg(*[F.sum(c).alias(c) for c in flags.values()])
    sums = per_post.agg(
        *[F.sum(c).alias(f"{t}_rows") for t, c in flags.items()],
        *[m.count_where(F.col(c) > 0).alias(f"{t}_posts") for t, c in flags.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("anomaly_type"),
                F.coalesce(F.col(f"{t}_rows"), F.lit(0)).alias("intake_rows"),
                F.col(f"{t}_posts").alias("distinct_posts"),
            )
            for t in flags
        ]
    )
    return (
        sums.select(F.inline(rows))
        .withColumn("replay_rows_removed", F.col("intake_rows") - F.col("distinct_posts"))
        .orderBy(F.desc("intake_rows"))
    )


def most_corrupt_posts(anomalies: DataFrame) -> DataFrame:
    listed = corrupt_posts(anomalies)
    worst = listed.agg(F.max("n_anomalies").alias("n")).scalar()
    return listed.where(F.col("n_anomalies") == worst).orderBy("post_id")


def suspicious_influencers(posts: DataFrame, users: DataFrame, *, followers_under: int = 10_000) -> DataFrame:
    """Few followers, above-average engagement, and at least one post shared more than liked."""
    per_user = rel.posting_users(posts)
    return (
        per_user.where(F.col("over_shared") & (F.col("avg_engagement") > _overall_mean(per_user)))
        .join(users.where(F.col("follower_count") < followers_under), "user_id")
        .select(
            "location",
            "follower_count",
            "n_posts",
            F.round("avg_engagement", 2).alias("avg_engagement_per_post"),
            "total_engagement",
            "user_id",
        )
    )


def suspicious_influencers_ranked(posts: DataFrame, users: DataFrame, *, followers_under: int = 10_000) -> DataFrame:
    """The list above with RANK by total: the lowest row number among equal totals."""
    found = suspicious_influencers(posts, users, followers_under=followers_under)
    numbered = global_row_number(found, [F.desc("total_engagement"), "user_id"], "rn")
    ranks = numbered.groupBy("total_engagement").agg(F.min("rn").alias("engagement_rank"))
    return (
        numbered.join(ranks, "total_engagement")
        .select(
            "location",
            "follower_count",
            "n_posts",
            "avg_engagement_per_post",
            "total_engagement",
            "engagement_rank",
            "user_id",
        )
        .orderBy(F.desc("total_engagement"), "user_id")
    )


def suspicious_funnel(posts: DataFrame, users: DataFrame, *, followers_under: int = 10_000) -> DataFrame:
    """How many users pass each condition alone, and all three."""
    per_user = rel.posting_users(posts)
    c1 = F.coalesce(F.col("follower_count") < followers_under, F.lit(False))
    c2 = F.coalesce(F.col("avg_engagement") > F.col("base"), F.lit(False))
    c3 = F.coalesce(F.col("over_shared"), F.lit(False))
    return (
        users.select("user_id", "follower_count", F.lit(True).alias("known"))
        .join(per_user.select("user_id", "avg_engagement", "over_shared"), "user_id", "full")
        .withColumn("base", _overall_mean(per_user))
        .agg(
            m.count_where(F.col("known")).alias("all_users"),
            m.count_where(c1).alias("c1_fewer_than_10k_followers"),
            m.count_where(c2).alias("c2_above_overall_avg"),
            m.count_where(c3).alias("c3_has_over_shared_post"),
            m.count_where(c1 & c2 & c3).alias("all_three_conditions"),
        )
    )
