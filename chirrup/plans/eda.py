"""Exploratory statistics over posts, users, tags and text; one function per table or summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chirrup.constants import LEXICON, UNSPECIFIED
from chirrup.functions import metrics as m
from chirrup.functions.strings import strip
from chirrup.operators.ranking import exact_quantiles, global_row_number
from chirrup.operators.relations import hashtags


def all_rows():
    """One window over everything: only ever over aggregated rows."""
    return Window.partitionBy()


def with_engagement(posts: DataFrame) -> DataFrame:
    """Engagement that is NULL only where no count is known."""
    return posts.withColumn("engagement", m.engagement_or_null())


def best(name: str, by: str, first: Column, lowest: bool = False) -> Column:
    """``name`` of the row with the largest (or smallest) ``by``; ties go to the smallest ``first``."""
    size = -F.col(by) if lowest else F.col(by)
    return F.max_by(name, F.when(F.col(by).isNotNull(), F.struct(size, -first)))


# ------------------------------------------------------------------------------ time
def monthly_trend(posts: DataFrame) -> DataFrame:
    table = (
        with_engagement(posts)
        .groupBy("post_month")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.avg("likes").alias("mean_likes"),
            F.avg("engagement").alias("mean_engagement"),
        )
    )
    prev = F.lag("posts").over(Window.orderBy("post_month"))
    return table.withColumn("momentum", F.try_divide((F.col("posts") - prev).cast("double"), prev.cast("double")))


def trend_summary(posts: DataFrame) -> DataFrame:
    days = posts.agg(F.min("post_date").alias("first"), F.max("post_date").alias("last"))
    numbered = monthly_trend(posts).withColumn("i", F.row_number().over(Window.orderBy("post_month")))
    i = F.col("i")
    row = numbered.agg(
        F.count(F.lit(1)).alias("months_covered"),
        best("post_month", "posts", i).alias("peak_month"),
        F.max("posts").alias("peak_posts"),
        best("post_month", "posts", i, lowest=True).alias("trough_month"),
        F.min("posts").alias("trough_posts"),
        F.round(F.corr("posts", "mean_engagement"), 3).alias("corr_volume_engagement"),
        best("post_month", "momentum", i).alias("biggest_jump_month"),
        F.round(F.max("momentum") * 100, 1).alias("biggest_jump_pct"),
        best("post_month", "momentum", i, lowest=True).alias("biggest_drop_month"),
        F.round(F.min("momentum") * 100, 1).alias("biggest_drop_pct"),
    )
    return row.select(
        "*",
        F.round(m.percent(F.col("peak_posts") - F.col("trough_posts"), F.col("trough_posts")), 1).alias("swing_pct"),
        days.select("first").scalar().alias("window_start"),
        days.select("last").scalar().alias("window_end"),
    )


def hour_profile(posts: DataFrame) -> DataFrame:
    """All 24 hours: counts and shares of all rows and of rows with a clock."""
    timed = F.col("timestamp_format").isin("iso8601", "epoch_seconds")
    counted = posts.groupBy("post_hour").agg(
        F.count(F.lit(1)).alias("naive"), m.count_where(timed).alias("valid")
    )
    hours = posts.sparkSession.range(24).select(F.col("id").alias("post_hour"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        hours.join(counted, "post_hour", "left")
        .select("post_hour", zero("naive"), zero("valid"))
        .select(
            "*",
            m.percent(F.col("naive"), F.sum("naive").over(all_rows())).alias("naive_pct"),
            m.percent(F.col("valid"), F.sum("valid").over(all_rows())).alias("valid_pct"),
        )
    )


def hour_summary(posts: DataFrame) -> DataFrame:
    h = F.col("post_hour")
    at_midnight = lambda c: F.max(F.when(h == 0, F.col(c)))
    date_only = posts.agg(
        m.count_where((h == 0) & (F.col("timestamp_format") == "dayfirst_dmy")).alias("n")
    ).scalar()
    return (
        hour_profile(posts)
        .agg(
            best("post_hour", "valid", h).alias("peak_hour"),
            best("post_hour", "valid", h, lowest=True).alias("trough_hour"),
            F.round(F.max("valid_pct"), 2).alias("peak_hour_pct"),
            F.round(F.min("valid_pct"), 2).alias("trough_hour_pct"),
            F.round(F.try_divide(F.max("valid_pct"), F.min("valid_pct")), 3).alias("hour_spread_ratio"),
            F.sum("valid").alias("timebearing_n"),
            at_midnight("naive").alias("midnight_naive_rows"),
            F.round(F.max("naive_pct"), 2).alias("midnight_naive_pct"),
            F.round(at_midnight("valid_pct"), 2).alias("midnight_valid_pct"),
        )
        .withColumn("midnight_from_dateonly_format", date_only)
    )


def weekday_engagement(posts: DataFrame) -> DataFrame:
    return with_engagement(posts).groupBy("weekday").agg(F.avg("engagement").alias("mean_engagement"))


def weekend_lift(posts: DataFrame) -> DataFrame:
    means = with_engagement(posts).agg(
        F.avg(F.when(F.col("is_weekend"), F.col("engagement"))).alias("we"),
        F.avg(F.when(~F.col("is_weekend"), F.col("engagement"))).alias("wd"),
    )
    return means.select(
        F.round("we", 1).alias("weekend_mean_engagement"),
        F.round("wd", 1).alias("weekday_mean_engagement"),
        F.round((F.try_divide("we", "wd") - 1) * 100, 2).alias("weekend_lift_pct"),
    )


# ------------------------------------------------------------------------------ platform
def platform_table(posts: DataFrame) -> DataFrame:
    return posts.groupBy("platform").agg(
        F.count(F.lit(1)).alias("posts"),
        *[F.avg(c).alias(f"mean_{c}") for c in m.METRICS],
        m.count_where(F.col("likes").isNull()).alias("missing_likes"),
        F.round(m.percent(m.count_where(F.col("likes").isNull()), F.count(F.lit(1))), 2).alias("missing_like_rate_pct"),
    )


def platform_summary(posts: DataFrame) -> DataFrame:
    lost = F.col("platform") == UNSPECIFIED
    known = F.when(~lost, F.col("mean_likes"))
    return platform_table(posts).agg(
        F.round(m.percent(F.coalesce(F.sum(F.when(lost, F.col("posts"))), F.lit(0)), F.sum("posts")), 2).alias(
            "unspecified_share_pct"
        ),
        F.round(m.percent(F.max(known) - F.min(known), F.avg(known)), 1).alias("spread_mean_likes_pct"),
    )


# ------------------------------------------------------------------------------ hashtags
def _tag_sets(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", F.array_sort(hashtags(F.coalesce("text_content", F.lit("")))).alias("tags"))


def hashtag_counts(posts: DataFrame) -> DataFrame:
    """Posts per hashtag and their share of all posts; a post counts a tag once."""
    total = posts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        _tag_sets(posts)
        .select(F.explode("tags").alias("hashtag"))
        .groupBy("hashtag")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("hashtag", "n", m.percent(F.col("n"), total).alias("posts_pct"))
        .orderBy(F.desc("n"), "hashtag")
    )


def hashtag_summary(posts: DataFrame) -> DataFrame:
    distinct = hashtag_counts(posts).agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.size("tags")
    return _tag_sets(posts).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("total_mentions"),
        F.round(F.avg(size), 3).alias("avg_tags_per_post"),
        m.count_where(size == 0).alias("posts_with_no_tag"),
    ).withColumn("distinct", distinct)


def hashtag_pairs(posts: DataFrame, *, top: int = 12) -> DataFrame:
    """Unordered pairs of tags within a post; pairs are formed inside the row, from its own tags."""
    tags = F.col("tags")
    # what follows each tag in the sorted set
    pairs = F.flatten(
        F.transform(
            tags,
            lambda a, i: F.transform(
                F.slice(tags, i + 2, F.size(tags)), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b"))
            ),
        )
    )
    return (
        _tag_sets(posts)
        .where(F.size("tags") > 1)
        .select(F.inline(pairs))
        .groupBy("tag_a", "tag_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "tag_a", "tag_b")
        .limit(top)
    )


# ------------------------------------------------------------------------------ sentiment
def with_sentiment(posts: DataFrame, lexicon: dict[str, int] = LEXICON) -> DataFrame:
    """Sum of the weights of all phrases a text contains, and the label of its sign."""
    text = F.lower("text_content")
    score = F.lit(0.0)
    for phrase, weight in lexicon.items():
        if weight:
            score = score + F.when(text.contains(phrase), float(weight)).otherwise(0.0)
    score = F.when(F.length("text_content") > 0, score)
    return posts.withColumn("sentiment", score).withColumn(
        "sentiment_label",
        F.when(F.col("sentiment") < 0, "negative").when(F.col("sentiment") > 0, "positive").otherwise("neutral"),
    )


LABELS = ("negative", "neutral", "positive")


def sentiment_by_month(posts: DataFrame, lexicon: dict[str, int] = LEXICON) -> DataFrame:
    """Share of each label in each month."""
    counts = with_sentiment(posts, lexicon).groupBy("post_month").pivot("sentiment_label", list(LABELS)).count()
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in LABELS), F.lit(0))
    return counts.select("post_month", *[m.percent(F.coalesce(F.col(c), F.lit(0)), total).alias(c) for c in LABELS])


def sentiment_quartiles(posts: DataFrame, lexicon: dict[str, int] = LEXICON) -> DataFrame:
    q = exact_quantiles(with_sentiment(posts, lexicon), ["platform"], "sentiment", [0.25, 0.5, 0.75])
    return q.select("platform", *[F.col("q")[i].alias(name) for i, name in enumerate(("q25", "q50", "q75"))])


def sentiment_table(posts: DataFrame, lexicon: dict[str, int] = LEXICON) -> DataFrame:
    table = (
        with_sentiment(with_engagement(posts), lexicon)
        .groupBy("sentiment_label")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.round(F.avg("likes"), 1).alias("mean_likes"),
            F.round(F.avg("engagement"), 1).alias("mean_engagement"),
        )
    )
    return table.withColumn("pct", F.round(m.percent(F.col("posts"), F.sum("posts").over(all_rows())), 2))


def sentiment_correlation(posts: DataFrame, lexicon: dict[str, int] = LEXICON) -> DataFrame:
    return with_sentiment(with_engagement(posts), lexicon).agg(
        F.round(F.corr("sentiment", "likes"), 4).alias("corr_sentiment_likes"),
        F.round(F.corr("sentiment", "engagement"), 4).alias("corr_sentiment_engagement"),
    )


# ------------------------------------------------------------------------------ geography
def country_table(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts and mean engagement per country; sums per user go into the join."""
    per_user = with_engagement(posts).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("engagement").alias("total"), F.count("engagement").alias("known")
    )
    return (
        per_user.join(users.select("user_id", "country"), "user_id", "left")
        .where(F.col("country").isNotNull())
        .groupBy("country")
        .agg(F.sum("n").alias("posts"), m.ratio(F.sum("total"), F.sum("known")).alias("mean_engagement"))
    )


def ranked_countries(posts: DataFrame, users: DataFrame, *, min_posts: int = 40, top: int = 10) -> DataFrame:
    return (
        country_table(posts, users)
        .where(F.col("posts") >= min_posts)
        .orderBy(F.desc("mean_engagement"), "country")
        .limit(top)
    )


def country_summary(posts: DataFrame, users: DataFrame) -> DataFrame:
    return country_table(posts, users).agg(
        F.count(F.lit(1)).alias("countries"),
        F.max_by("country", "mean_engagement").alias("best_country"),
        F.round(F.max("mean_engagement"), 1).alias("best_country_engagement"),
        F.round(F.try_divide(F.max("mean_engagement"), F.min("mean_engagement")), 3).alias("spread_ratio"),
    )


# ------------------------------------------------------------------------------ users
def user_features(posts: DataFrame, users: DataFrame) -> DataFrame:
    per_user = with_engagement(posts).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("posts"),
        F.coalesce(F.sum("engagement"), F.lit(0)).alias("total_eng"),
        F.avg("engagement").alias("mean_eng"),
        F.avg("likes").alias("mean_likes"),
    )
    start = posts.agg(F.min("post_date").alias("d")).scalar()
    columns = ["user_id", "follower_count", "country", "language", "account_created"]
    return per_user.join(users.select(*columns), "user_id", "left").select(
        "*",
        m.ratio(F.col("total_eng"), F.col("follower_count")).alias("engagement_rate"),
        F.date_diff(start, "account_created").cast("long").alias("age_days_at_start"),
    )


def follower_bands(features: DataFrame, *, bands: int = 5) -> DataFrame:
    """Quantile bands of follower count, right-closed, equal edges merged; mean engagement in each."""
    cuts = exact_quantiles(features, [], "follower_count", [i / bands for i in range(bands + 1)])
    edges = F.col("edges")
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return (
        features.where(F.col("follower_count").isNotNull())
        .select("follower_count", "mean_eng", cuts.select(F.array_distinct("q").alias("edges")).scalar().alias("edges"))
        .withColumn("band", F.size(F.filter(inner, lambda e: e < F.col("follower_count"))).cast("long"))
        .groupBy("band")
        .agg(
            F.first(F.get(edges, F.col("band").cast("int"))).alias("over"),
            F.first(F.get(edges, F.col("band").cast("int") + 1)).alias("up_to"),
            F.count(F.lit(1)).alias("users"),
            F.avg("mean_eng").alias("mean_engagement"),
        )
        .orderBy("band")
    )


def user_correlations(features: DataFrame) -> DataFrame:
    return features.agg(
        F.round(F.corr("follower_count", "mean_eng"), 4).alias("corr_followers_engagement"),
        F.round(F.corr("posts", "mean_eng"), 4).alias("corr_activity_engagement"),
    )


def user_segments(features: DataFrame) -> DataFrame:
    """Four overlapping segments cut at quantiles of activity and yield."""
    activity = exact_quantiles(features, [], "posts", [0.25, 0.5, 0.9]).select("q").scalar()
    yield_ = exact_quantiles(features, [], "mean_eng", [0.5, 0.75]).select("q").scalar()
    n, e = F.col("posts"), F.col("mean_eng")
    a, y = F.col("activity"), F.col("yield")
    segments = {
        "power_creator": (n >= a[2]) & (e >= y[1]),
        "high_volume_low_yield": (n >= a[2]) & (e < y[0]),
        "quiet_performer": (n <= a[0]) & (e >= y[1]),
        "casual": (n <= a[1]) & (e < y[0]),
    }
    sums = features.select("posts", "mean_eng", activity.alias("activity"), yield_.alias("yield")).agg(
        F.count(F.lit(1)).alias("all"),
        *[m.count_where(c).alias(f"{s}_n") for s, c in segments.items()],
        *[F.avg(F.when(c, n)).alias(f"{s}_p") for s, c in segments.items()],
        *[F.avg(F.when(c, e)).alias(f"{s}_e") for s, c in segments.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("segment"),
                F.col(f"{s}_n").alias("users"),
                F.round(m.percent(F.col(f"{s}_n"), F.col("all")), 1).alias("share_pct"),
                F.round(f"{s}_p", 2).alias("mean_posts"),
                F.round(f"{s}_e", 1).alias("mean_engagement"),
            )
            for s in segments
        ]
    )
    return sums.select(F.inline(rows))


def posts_per_user(features: DataFrame, *, head: float = 0.1) -> DataFrame:
    """Distribution of posts per user and the engagement share of the most engaged tenth."""
    q = exact_quantiles(features, [], "posts", [0.25, 0.5, 0.75]).select("q").scalar()
    ranked = global_row_number(features.select("user_id", "total_eng"), [F.desc("total_eng"), "user_id"], "rn", "n")
    share = ranked.agg(
        m.percent(
            F.sum(F.when(F.col("rn") <= F.floor(F.col("n") * head), F.col("total_eng"))), F.sum("total_eng")
        ).alias("x")
    ).scalar()
    row = features.agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("posts"), 2).alias("mean"),
        F.round(F.stddev_samp("posts"), 2).alias("std"),
        F.min("posts").alias("min"),
        F.max("posts").alias("max"),
    ).withColumn("q", q)
    return row.select(
        "count", "mean", "std", "min", "max",
        *[F.round(F.col("q")[i], 2).alias(name) for i, name in enumerate(("q25", "q50", "q75"))],
        F.round(share, 1).alias("top10_share_pct"),
    )


# ------------------------------------------------------------------------------ defects and bias
def anomaly_inventory(raw: DataFrame, posts: DataFrame, users: DataFrame) -> DataFrame:
    """Twelve labelled counts of what was wrong with the intake, and what was done about it."""
    columns = [c for c in raw.columns if c != "row_no"]
    rows = raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    blank = lambda c: strip(F.col(c)).isin("", "NULL")
    text = F.col("text_content")
    negative = F.col("likes").rlike("^-[0-9]")
    counted = [
        ("exact duplicate rows (outage replay)", None, "replays dropped"),
        ("negative likes (sign flip on export)", negative, "magnitudes restored"),
        ("likes serialised as float strings ('-1205.0')", negative, "cast to nullable integer"),
        ("blank / 'NULL' likes", blank("likes"), "left NULL (no imputation)"),
        ("blank / 'NULL' platform", blank("platform"), "bucketed 'Unspecified'"),
        ("blank or 'NULL' text body", blank("text_content"), "held out"),
        ("trailing '<br>' / '<div>' markup", text.rlike("<br>|<div>"), "markup stripped, text kept"),
        ("trailing '&amp;' entity", text.contains("&amp;"), "entity unescaped, tail trimmed"),
        ("double-encoded UTF-8 tail (C3 A9)", text.contains("Ã"), "round trip repaired, mark trimmed"),
        ("triple-format timestamps", F.col("timestamp").rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), "parsed by format, flagged"),
    ]
    sums = rows.agg(
        (F.sum("copies") - F.count(F.lit(1))).alias("c0"),
        *[F.sum(F.when(c, F.col("copies")).otherwise(0)).alias(f"c{i}") for i, (_, c, _) in enumerate(counted) if i],
    )
    by_day = posts.groupBy("user_id", "post_date").agg(F.count(F.lit(1)).alias("n"))
    joined = by_day.join(users.select("user_id", "account_created", F.lit(True).alias("known")), "user_id", "left").agg(
        F.coalesce(F.sum(F.when(F.col("post_date") < F.col("account_created"), F.col("n"))), F.lit(0)).alias("early"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan"),
    )
    entries = [(name, F.coalesce(F.col(f"c{i}"), F.lit(0)), done) for i, (name, _, done) in enumerate(counted)]
    entries += [
        ("users posting before account creation", joined.select("early").scalar(), "kept, counted"),
        ("posts referencing an unknown user_id", joined.select("orphan").scalar(), "kept, flagged"),
    ]
    return sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("anomaly"), c.cast("long").alias("raw_count"), F.lit(d).alias("resolved_to"))
                    for n, c, d in entries
                ]
            )
        )
    )


def ratio_signals(posts: DataFrame, *, threshold: float = 3.0) -> DataFrame:
    likes = F.col("likes")
    silent = likes.isNull() | (likes == 0)
    loud = (likes > 0) & (m.ratio(F.col("shares") + F.col("comments"), likes) > threshold)
    # a hash of the body keeps the shuffle small; the length guards it
    body = F.lower(strip(F.col("text_content")))
    repeated = (
        posts.where(F.col("text_content").isNotNull())
        .groupBy("user_id", F.sha2(body, 256).alias("body"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(m.count_where(F.col("n") > 1).alias("n"))
        .scalar()
    )
    return posts.agg(
        m.count_where(silent).alias("posts_with_zero_or_missing_likes"),
        F.round(F.avg(F.when(silent, F.col("shares"))), 1).alias("their_mean_shares"),
        m.count_where(loud).alias("high_share_low_like_posts"),
        F.round(m.percent(m.count_where(loud), F.count(F.lit(1))), 2).alias("high_share_low_like_pct"),
    ).withColumn("repeat_content_users", repeated)


def format_bias(posts: DataFrame) -> DataFrame:
    """Do the intake formats differ in engagement? They should not."""
    return (
        with_engagement(posts)
        .groupBy("timestamp_format")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("likes"), 1).alias("mean_likes"),
            F.round(F.avg("shares"), 1).alias("mean_shares"),
            F.round(F.avg("engagement"), 1).alias("mean_engagement"),
        )
    )


def post_features(posts: DataFrame, lexicon: dict[str, int] = LEXICON) -> DataFrame:
    """Posts with engagement, hashtags and sentiment, as written out for later stages."""
    tagged = with_engagement(posts).withColumn(
        "hashtags", F.array_join(F.array_sort(hashtags(F.coalesce("text_content", F.lit("")))), "|")
    )
    return with_sentiment(tagged, lexicon)
