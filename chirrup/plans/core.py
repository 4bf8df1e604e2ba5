"""First set of named analyses: trend, grouping, anomaly, correlation, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from chirrup.constants import SAYS, UNSPECIFIED, WINDOW_END, WINDOW_START
from chirrup.functions import metrics as m
from chirrup.operators import relations as rel
from chirrup.operators.ranking import global_ntile


def all_rows():
    """One window over everything: only ever over aggregated rows."""
    return Window.partitionBy()


def monthly_momentum(posts: DataFrame) -> DataFrame:
    """Posts per month, change against the month before, z-score (population SD) and volume rank."""
    by_month = Window.orderBy("post_month")
    prev = F.lag("posts").over(by_month)
    sd = F.stddev_pop("posts").over(all_rows())
    return rel.monthly(posts).select(
        "post_month",
        "posts",
        prev.alias("prev_month"),
        F.round(m.percent(F.col("posts") - prev, prev), 2).alias("mom_pct"),
        F.round("mean_engagement", 1).alias("mean_engagement"),
        F.round(F.try_divide(F.col("posts") - F.avg("posts").over(all_rows()), sd), 2).alias("z_volume"),
        m.long(F.rank().over(Window.orderBy(F.desc("posts")))).alias("volume_rank"),
    ).orderBy("post_month")


def turning_points(posts: DataFrame) -> DataFrame:
    """Centred three-month mean; a month where its direction flips is a peak or a trough."""
    calendar = Window.orderBy("post_month")
    smooth = rel.monthly(posts).select(
        "post_month", "posts", F.avg("posts").over(calendar.rowsBetween(-1, 1)).alias("ma3")
    )
    came = F.signum(F.col("ma3") - F.lag("ma3").over(calendar))
    goes = F.signum(F.lead("ma3").over(calendar) - F.col("ma3"))
    return (
        smooth.withColumns({"came": came, "goes": goes})
        .select(
            "post_month",
            "posts",
            F.round("ma3", 1).alias("ma3"),
            F.when((F.col("came") > 0) & (F.col("goes") < 0), "PEAK")
            .when((F.col("came") < 0) & (F.col("goes") > 0), "TROUGH")
            .otherwise("--")
            .alias("inflection"),
        )
        .orderBy("post_month")
    )


def platform_league(posts: DataFrame) -> DataFrame:
    """Volume, share, missing likes and means per platform; the unspecified bucket is marked."""
    table = (
        posts.withColumn("engagement", m.engagement())
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            m.count_where(F.col("likes").isNull()).alias("likes_missing"),
            *[F.round(F.avg(c), 1).alias(f"mean_{c}") for c in ("engagement", "shares", "comments")],
        )
    )
    return table.select(
        "platform",
        "posts",
        F.round(m.percent(F.col("posts"), F.sum("posts").over(all_rows())), 2).alias("share_pct"),
        "likes_missing",
        F.round(m.percent(F.col("likes_missing"), F.col("posts")), 2).alias("likes_missing_pct"),
        "mean_engagement",
        "mean_shares",
        "mean_comments",
        m.long(F.col("platform") != UNSPECIFIED).alias("in_rate_comparison"),
    ).orderBy(F.desc("posts"), "platform")


def amplified_posts(posts: DataFrame, *, threshold: float = 3.0) -> DataFrame:
    """How many posts are shared and discussed far more than liked, among those with likes."""
    hit = F.col("amplify_ratio") > threshold
    return (
        rel.enriched(posts)
        .where(F.col("likes") > 0)
        .agg(
            m.count_where(hit).alias("anomalous_posts"),
            F.count(F.lit(1)).alias("comparable_posts"),
            F.avg(F.when(hit, F.col("amplify_ratio"))).alias("mean_ratio"),
            F.max(F.when(hit, F.col("amplify_ratio"))).alias("worst_ratio"),
        )
        .select(
            "anomalous_posts",
            "comparable_posts",
            F.round(m.percent(F.col("anomalous_posts"), F.col("comparable_posts")), 2).alias("pct_of_comparable"),
            F.round("mean_ratio", 2).alias("mean_ratio"),
            F.round("worst_ratio", 1).alias("worst_ratio"),
        )
    )


def amplification_attribution(
    posts: DataFrame, users: DataFrame, *, threshold: float = 3.0, band: tuple[float, float] = (0.8, 1.25)
) -> DataFrame:
    """Is the amplification anomaly carried by few authors? Observed tail against a Poisson tail."""
    hits = (
        rel.enriched(posts)
        .where((F.col("likes") > 0) & (F.col("amplify_ratio") > threshold))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    per_user = users.select("user_id").join(hits, "user_id", "left").select(
        F.coalesce("hits", F.lit(0)).alias("hits")
    )
    seen = per_user.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.sum("hits").alias("n_anom"),
        m.count_where(F.col("hits") >= 3).alias("obs_ge3"),
        m.count_where(F.col("hits") >= 4).alias("obs_ge4"),
        F.max("hits").alias("busiest_author"),
    ).withColumn("rate", m.ratio(F.col("n_anom"), F.col("n_users")))
    n, rate = F.col("n_users"), F.col("rate")

    def upper_tail(k: int):
        """n_users * P(X >= k) for a Poisson variable."""
        terms, factorial = F.lit(1.0), 1
        for i in range(1, k):
            factorial *= i
            terms = terms + F.pow(rate, F.lit(float(i))) / F.lit(float(factorial))
        return n - n * F.exp(-rate) * terms

    seen = seen.withColumns({"exp3": upper_tail(3), "exp4": upper_tail(4)})
    within = F.col("obs_ge3").between(band[0] * F.col("exp3"), band[1] * F.col("exp3"))
    return seen.select(
        "n_users",
        "n_anom",
        F.round("rate", 4).alias("poisson_lambda"),
        "obs_ge3",
        F.round("exp3", 1).alias("expected_ge3_by_chance"),
        "obs_ge4",
        F.round("exp4", 1).alias("expected_ge4_by_chance"),
        "busiest_author",
        F.round(F.try_divide(F.col("obs_ge3").cast("double"), F.col("exp3")), 3).alias("observed_over_expected"),
        F.when(within, SAYS["ring_no"]).otherwise(SAYS["ring_yes"]).alias("verdict"),
    )


def midnight_illusion(posts: DataFrame) -> DataFrame:
    """Hour profile of all rows and of rows with a clock; their difference is a format artefact."""
    hours = posts.groupBy("post_hour").agg(
        F.count(F.lit(1)).alias("rows_naive"), F.sum("has_time").alias("rows_with_real_time")
    )

    def share(name: str):
        return F.round(m.percent(F.col(name), F.sum(name).over(all_rows())), 2)

    return hours.select(
        "post_hour",
        "rows_naive",
        share("rows_naive").alias("pct_naive"),
        "rows_with_real_time",
        share("rows_with_real_time").alias("pct_valid"),
        (F.col("rows_naive") - F.col("rows_with_real_time")).alias("artefact_rows"),
    ).orderBy(F.desc("artefact_rows"), "post_hour")


def rfm_segments(posts: DataFrame) -> DataFrame:
    """Recency / frequency / monetary quintiles of the authors, named and counted."""
    base = posts.groupBy("user_id").agg(
        F.max(F.unix_timestamp("posted_at")).alias("last_post"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(m.engagement()).alias("monetary"),
    )
    newest = posts.agg(F.max(F.unix_timestamp("posted_at")).alias("t")).scalar()
    scored = base.select(
        "user_id",
        F.floor((newest - F.col("last_post")) / 86400).cast("long").alias("recency_days"),
        "frequency",
        "monetary",
    )
    scored = global_ntile(scored, 5, [F.desc("recency_days"), "user_id"], "r")
    scored = global_ntile(scored, 5, ["frequency", "user_id"], "f")
    scored = global_ntile(scored, 5, ["monetary", "user_id"], "mon")
    r, f, mon = F.col("r"), F.col("f"), F.col("mon")
    segment = (
        F.when((r >= 4) & (f >= 4) & (mon >= 4), "champions")
        .when((r >= 4) & (f <= 2), "new_and_promising")
        .when((r <= 2) & (f >= 4), "drifting_regulars")
        .when((r <= 2) & (mon <= 2), "lapsed_low_value")
        .otherwise("mid_value")
    )
    return (
        scored.groupBy(segment.alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.round(F.avg("frequency"), 2).alias("avg_posts"),
            F.round(F.avg("monetary"), 1).alias("avg_total_engagement"),
            F.round(F.avg("recency_days"), 0).alias("avg_days_since_last_post"),
        )
        .select(
            "segment",
            "users",
            F.round(m.percent(F.col("users"), F.sum("users").over(all_rows())), 2).alias("share_pct"),
            "avg_posts",
            "avg_total_engagement",
            "avg_days_since_last_post",
        )
        .orderBy(F.desc("users"), "segment")
    )


def follower_correlation(posts: DataFrame, users: DataFrame, *, material: float = 0.1) -> DataFrame:
    """Pearson r of follower count and a user's mean engagement."""
    return (
        rel.user_totals(posts, users)
        .agg(F.count(F.lit(1)).alias("users"), F.corr("follower_count", "avg_engagement").alias("r"))
        .select(
            "users",
            F.round("r", 4).alias("pearson_r"),
            F.round(F.col("r") * F.col("r") * 100, 2).alias("r_squared_pct"),
            F.when(F.abs("r") < material, SAYS["corr_no"]).otherwise(SAYS["corr_yes"]).alias("verdict"),
        )
    )


def follower_quintiles(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts in five equal bands of their author's followers (ties broken by post)."""
    rows = posts.select("user_id", "post_id", m.engagement().alias("engagement")).join(
        users.select("user_id", "follower_count"), "user_id"
    )
    banded = global_ntile(
        rows.select("post_id", "follower_count", "engagement"), 5, ["follower_count", "post_id"], "quintile"
    )
    q = F.col("quintile")
    return (
        banded.groupBy("quintile")
        .agg(
            F.min("follower_count").alias("min_followers"),
            F.max("follower_count").alias("max_followers"),
            F.count(F.lit(1)).alias("posts"),
            F.round(F.avg("engagement"), 1).alias("mean_engagement"),
        )
        .select(
            "quintile",
            F.when(q == 1, "1 (fewest)").when(q == 5, "5 (most)").otherwise(q.cast("string")).alias("follower_band"),
            "min_followers",
            "max_followers",
            "posts",
            "mean_engagement",
        )
        .orderBy("quintile")
    )


def hashtag_momentum(posts: DataFrame, tags: DataFrame, *, top: int = 8) -> DataFrame:
    """Share of each month's posts carrying a tag: first and last month, change, best single gain."""
    totals = posts.groupBy("post_month").agg(F.count(F.lit(1)).alias("month_posts"))
    ends = posts.agg(F.min("post_month").alias("first"), F.max("post_month").alias("last"))
    share = (
        tags.join(posts.select("post_id", "post_month"), "post_id")
        .groupBy("tag", "post_month")
        .agg(F.count(F.lit(1)).alias("posts"))
        .join(totals, "post_month")
        .withColumn("pct", F.round(m.percent(F.col("posts"), F.col("month_posts")), 2))
    )
    # a tag has at most one row per month here
    gain = F.col("pct") - F.lag("pct").over(Window.partitionBy("tag").orderBy("post_month"))

    def in_month(edge: str):
        return F.max(F.when(F.col("post_month") == ends.select(edge).scalar(), F.col("pct")))

    return (
        share.withColumn("gain", gain)
        .groupBy("tag")
        .agg(
            in_month("last").alias("pct_final_month"),
            in_month("first").alias("pct_first_month"),
            F.max("gain").alias("best_single_month_gain_pp"),
        )
        .select(
            "tag",
            "pct_final_month",
            "pct_first_month",
            F.round(F.col("pct_final_month") - F.col("pct_first_month"), 2).alias("pp_change"),
            F.round("best_single_month_gain_pp", 2).alias("best_single_month_gain_pp"),
        )
        .orderBy(F.desc_nulls_last("pp_change"), "tag")
        .limit(top)
    )


def posting_streaks(posts: DataFrame) -> DataFrame:
    """Runs of consecutive posting days per user, by length.

    Posts of one user and day collapse map-side, so a user contributes at most one row per
    calendar day to the window.
    """
    days = posts.select("user_id", F.unix_date("post_date").alias("day")).distinct()
    run = F.col("day") - F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    return (
        days.withColumn("run", run)
        .groupBy("user_id", "run")
        .agg(F.count(F.lit(1)).alias("streak_len"))
        .groupBy("streak_len")
        .agg(
            F.count(F.lit(1)).alias("streaks"),
            F.round(F.avg("streak_len"), 1).alias("avg_days_in_streak"),
            F.max("streak_len").alias("max_days_in_streak"),
        )
        .orderBy("streak_len")
    )


def integrity_gate(
    posts: DataFrame, users: DataFrame, *, start: str = WINDOW_START, end: str = WINDOW_END
) -> DataFrame:
    """Five violation counts; all zero on a restored data set."""
    by_user_day = posts.groupBy("user_id", F.to_date("posted_at").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_user = by_user_day.groupBy("user_id").agg(F.sum("n").alias("n"))
    zero = F.lit(0)
    scan = posts.agg(
        (F.count(F.lit(1)) - F.count_distinct("post_id")).alias("duplicate post_id"),
        m.count_where(F.least(*[F.coalesce(F.col(c), zero) for c in m.METRICS]) < 0).alias("negative engagement"),
        m.count_where(
            (F.col("posted_at") < F.lit(start).cast("timestamp"))
            | (F.col("posted_at") >= F.lit(end).cast("timestamp"))
        ).alias("timestamps outside window"),
    )

    def row(name: str, counted: DataFrame) -> DataFrame:
        return counted.select(F.lit(name).alias("check_name"), F.coalesce(F.col("n"), zero).cast("long").alias("violations"))

    orphans = per_user.join(users.select("user_id"), "user_id", "left_anti").agg(F.sum("n").alias("n"))
    early = (
        by_user_day.join(users.select("user_id", "account_created"), "user_id")
        .where(F.col("day") < F.col("account_created"))
        .agg(F.sum("n").alias("n"))
    )
    scanned = scan.unpivot([], scan.columns, "check_name", "violations")
    return scanned.unionByName(row("orphan user_id", orphans)).unionByName(row("post before signup", early))
