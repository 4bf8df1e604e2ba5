"""Registered queries over the exploratory statistics, each with its SQL."""

from pyspark.sql import functions as F

from chirrup.plans import eda
from registry.core import on
from registry.relations_sql import POSTS, RAW, TEXTS, TIMED, USERS, sql

# phrases that occur in the test documents, in place of the English default
LEXICON = {"tion": 1, "que": 2, "the ": -1, "und": -2, "ment": 1, "schen": 0}

QUERIES = {
    "A1_monthly_trend": on(lambda s: eda.monthly_trend(s.posts)),
    "A1_trend_summary": on(lambda s: eda.trend_summary(s.posts)),
    "A2_platform_table": on(lambda s: eda.platform_table(s.posts)),
    "A2_platform_summary": on(lambda s: eda.platform_summary(s.posts)),
    "A3_hour_profile": on(lambda s: eda.hour_profile(s.timed_posts)),
    "A3_hour_summary": on(lambda s: eda.hour_summary(s.timed_posts)),
    "A4_weekday_engagement": on(lambda s: eda.weekday_engagement(s.posts)),
    "A4_weekend_lift": on(lambda s: eda.weekend_lift(s.posts)),
    "A5_hashtag_counts": on(lambda s: eda.hashtag_counts(s.text_posts)),
    "A5_hashtag_summary": on(lambda s: eda.hashtag_summary(s.text_posts)),
    "A6_hashtag_pairs": on(lambda s: eda.hashtag_pairs(s.text_posts)),
    "A7_sentiment": on(lambda s: eda.with_sentiment(s.text_posts, LEXICON).select("post_id", "sentiment", "sentiment_label")),
    "A8_sentiment_by_month": on(lambda s: eda.sentiment_by_month(s.text_posts, LEXICON)),
    "A9_sentiment_quartiles": on(lambda s: eda.sentiment_quartiles(s.text_posts, LEXICON)),
    "A10_sentiment_table": on(lambda s: eda.sentiment_table(s.text_posts, LEXICON)),
    "A10_sentiment_correlation": on(lambda s: eda.sentiment_correlation(s.text_posts, LEXICON)),
    "A11_country_table": on(lambda s: eda.country_table(s.posts, s.users)),
    "A11_ranked_countries": on(lambda s: eda.ranked_countries(s.posts, s.users)),
    "A11_country_summary": on(lambda s: eda.country_summary(s.posts, s.users)),
    "A12_user_features": on(lambda s: eda.user_features(s.posts, s.users)),
    "A13_follower_bands": on(lambda s: eda.follower_bands(eda.user_features(s.posts, s.users))),
    "A14_user_correlations": on(lambda s: eda.user_correlations(eda.user_features(s.posts, s.users))),
    "A15_user_segments": on(lambda s: eda.user_segments(eda.user_features(s.posts, s.users))),
    "A16_posts_per_user": on(lambda s: eda.posts_per_user(eda.user_features(s.posts, s.users))),
    "A17_anomaly_inventory": on(lambda s: eda.anomaly_inventory(s.raw_posts, s.posts, s.users).drop("resolved_to")),
    "A18_ratio_signals": on(lambda s: eda.ratio_signals(s.text_posts)),
    "A19_format_bias": on(lambda s: eda.format_bias(s.posts)),
    "A20_post_features": on(
        lambda s: eda.post_features(s.text_posts, LEXICON).select("post_id", "engagement", "hashtags", "sentiment", "sentiment_label")
    ),
}

TREND = """, t AS (SELECT post_month, count(*) AS posts, avg(likes) AS mean_likes, avg(eng_null) AS mean_engagement FROM rich GROUP BY 1),
  tm AS (SELECT *, (posts - lag(posts) OVER (ORDER BY post_month))::DOUBLE / lag(posts) OVER (ORDER BY post_month) AS momentum FROM t)"""
HOURS = """, h AS (SELECT x AS post_hour, count(post_id) AS naive, count(*) FILTER (timestamp_format = 'iso8601') AS valid
   FROM range(24) r(x) LEFT JOIN timed ON post_hour = x GROUP BY x),
  hp AS (SELECT *, 100.0::DOUBLE * naive / sum(naive) OVER () AS naive_pct, 100.0::DOUBLE * valid / sum(valid) OVER () AS valid_pct FROM h)"""
TAGSETS = """, g AS (SELECT post_id, list_sort(list_distinct(regexp_extract_all(text_content, '#([A-Za-z][A-Za-z0-9_]*)', 1))) AS tags FROM texts)"""
SENTI = ", s0 AS (SELECT *, " + " + ".join(
    f"CASE WHEN contains(lower(text_content), '{p}') THEN {w}.0::DOUBLE ELSE 0 END" for p, w in LEXICON.items()
) + """ AS sentiment FROM texts),
  s AS (SELECT *, CASE sign(sentiment) WHEN -1 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS sentiment_label FROM s0)"""
COUNTRY = """, c AS (SELECT country, count(*) AS posts, avg(eng_null) AS mean_engagement FROM rich JOIN users USING (user_id) GROUP BY 1)"""
FEATURES = """, f AS (SELECT user_id, count(*) AS posts, CAST(sum(coalesce(eng_null, 0)) AS BIGINT) AS total_eng, avg(eng_null) AS mean_eng, avg(likes) AS mean_likes,
   any_value(follower_count) AS follower_count, any_value(country) AS country, any_value(language) AS language, any_value(account_created) AS account_created
   FROM rich LEFT JOIN users USING (user_id) GROUP BY user_id)"""


def _segment(name, condition):
    return f"""SELECT '{name}' AS segment, count(*) FILTER ({condition}) AS users, round(100.0::DOUBLE * count(*) FILTER ({condition}) / count(*), 1) AS share_pct,
      round(avg(posts) FILTER ({condition}), 2) AS mean_posts, round(avg(mean_eng) FILTER ({condition}), 1) AS mean_engagement FROM f, q"""


def _inventory():
    neg = "regexp_matches(likes, '^-[0-9]')"
    blank = lambda c: f"trim({c}, ' ' || chr(9) || chr(10) || chr(13)) IN ('', 'NULL')"
    marks = [
        ("negative likes (sign flip on export)", neg), ("likes serialised as float strings (''-1205.0'')", neg),
        ("blank / ''NULL'' likes", blank("likes")), ("blank / ''NULL'' platform", blank("platform")),
        ("blank or ''NULL'' text body", blank("text_content")), ("trailing ''<br>'' / ''<div>'' markup", "regexp_matches(text_content, '<br>|<div>')"),
        ("trailing ''&amp;'' entity", "contains(text_content, '&amp;')"), ("double-encoded UTF-8 tail (C3 A9)", "contains(text_content, 'Ã')"),
        ("triple-format timestamps", "regexp_full_match(\"timestamp\", '[0-9]{2}-[0-9]{2}-[0-9]{4}')"),
    ]
    return """ SELECT 'exact duplicate rows (outage replay)' AS anomaly, (SELECT count(*) FROM raw_posts)
          - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE row_no FROM raw_posts)) AS raw_count""" + "".join(
        f"\n UNION ALL SELECT '{n}', count(*) FILTER ({c}) FROM raw_posts" for n, c in marks
    ) + """
      UNION ALL SELECT 'users posting before account creation', count(*) FROM posts JOIN users USING (user_id) WHERE post_date < account_created
      UNION ALL SELECT 'posts referencing an unknown user_id', count(*) FROM posts ANTI JOIN users USING (user_id)"""


ORACLE = {
    "A1_monthly_trend": sql(POSTS, body=TREND + " SELECT * FROM tm"),
    "A1_trend_summary": sql(POSTS, body=TREND + """
      SELECT count(*) AS months_covered, (SELECT min(post_date) FROM posts) AS window_start, (SELECT max(post_date) FROM posts) AS window_end,
             (SELECT post_month FROM t ORDER BY posts DESC, 1 LIMIT 1) AS peak_month, max(posts) AS peak_posts,
             (SELECT post_month FROM t ORDER BY posts, 1 LIMIT 1) AS trough_month, min(posts) AS trough_posts,
             round(100.0::DOUBLE * (max(posts) - min(posts)) / min(posts), 1) AS swing_pct, round(corr(posts, mean_engagement), 3) AS corr_volume_engagement,
             (SELECT post_month FROM tm ORDER BY momentum DESC NULLS LAST, 1 LIMIT 1) AS biggest_jump_month, round(100 * max(momentum), 1) AS biggest_jump_pct,
             (SELECT post_month FROM tm ORDER BY momentum NULLS LAST, 1 LIMIT 1) AS biggest_drop_month, round(100 * min(momentum), 1) AS biggest_drop_pct FROM tm"""),
    "A2_platform_table": sql(POSTS, body="""
      SELECT platform, count(*) AS posts, avg(likes) AS mean_likes, avg(shares) AS mean_shares, avg(comments) AS mean_comments,
             count(*) - count(likes) AS missing_likes, round(100.0::DOUBLE * (count(*) - count(likes)) / count(*), 2) AS missing_like_rate_pct
      FROM posts GROUP BY platform"""),
    "A2_platform_summary": sql(POSTS, body="""
      , p AS (SELECT platform, avg(likes) AS l FROM posts WHERE platform <> 'Unspecified' GROUP BY 1)
      SELECT round(100.0::DOUBLE * (SELECT count(*) FROM posts WHERE platform = 'Unspecified') / (SELECT count(*) FROM posts), 2) AS unspecified_share_pct,
             round(100 * (max(l) - min(l)) / avg(l), 1) AS spread_mean_likes_pct FROM p"""),
    "A3_hour_profile": sql(TIMED, body=HOURS + " SELECT * FROM hp"),
    "A3_hour_summary": sql(TIMED, body=HOURS + """
      SELECT (SELECT post_hour FROM hp ORDER BY valid DESC, 1 LIMIT 1) AS peak_hour, (SELECT post_hour FROM hp ORDER BY valid, 1 LIMIT 1) AS trough_hour,
             round(max(valid_pct), 2) AS peak_hour_pct, round(min(valid_pct), 2) AS trough_hour_pct, round(max(valid_pct) / min(valid_pct), 3) AS hour_spread_ratio,
             CAST(sum(valid) AS BIGINT) AS timebearing_n, max(naive) FILTER (post_hour = 0) AS midnight_naive_rows, round(max(naive_pct), 2) AS midnight_naive_pct,
             round(max(valid_pct) FILTER (post_hour = 0), 2) AS midnight_valid_pct,
             (SELECT count(*) FROM timed WHERE post_hour = 0 AND timestamp_format = 'dayfirst_dmy') AS midnight_from_dateonly_format FROM hp"""),
    "A4_weekday_engagement": sql(POSTS, body=" SELECT weekday, avg(eng_null) AS mean_engagement FROM rich GROUP BY weekday"),
    "A4_weekend_lift": sql(POSTS, body="""
      SELECT round(avg(eng_null) FILTER (is_weekend), 1) AS weekend_mean_engagement, round(avg(eng_null) FILTER (NOT is_weekend), 1) AS weekday_mean_engagement,
             round(100 * (avg(eng_null) FILTER (is_weekend) / avg(eng_null) FILTER (NOT is_weekend) - 1), 2) AS weekend_lift_pct FROM rich"""),
    "A5_hashtag_counts": sql(TEXTS, body=TAGSETS + """
      SELECT hashtag, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM texts) AS posts_pct FROM (SELECT unnest(tags) AS hashtag FROM g) GROUP BY 1"""),
    "A5_hashtag_summary": sql(TEXTS, body=TAGSETS + """
      SELECT CAST(sum(len(tags)) AS BIGINT) AS total_mentions, round(avg(len(tags)), 3) AS avg_tags_per_post, count(*) FILTER (len(tags) = 0) AS posts_with_no_tag,
             (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM g)) AS "distinct" FROM g"""),
    "A6_hashtag_pairs": sql(TEXTS, body=TAGSETS + """
      , e AS (SELECT post_id, unnest(tags) AS t FROM g)
      SELECT a.t AS tag_a, b.t AS tag_b, count(*) AS n FROM e a JOIN e b ON a.post_id = b.post_id AND a.t < b.t GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 12"""),
    "A7_sentiment": sql(TEXTS, body=SENTI + " SELECT post_id, sentiment, sentiment_label FROM s"),
    "A8_sentiment_by_month": sql(TEXTS, body=SENTI + """
      SELECT post_month, 100.0::DOUBLE * count(*) FILTER (sentiment < 0) / count(*) AS negative, 100.0::DOUBLE * count(*) FILTER (sentiment = 0) / count(*) AS neutral,
             100.0::DOUBLE * count(*) FILTER (sentiment > 0) / count(*) AS positive FROM s GROUP BY post_month"""),
    "A9_sentiment_quartiles": sql(TEXTS, body=SENTI + """
      SELECT platform, quantile_cont(sentiment, 0.25) AS q25, quantile_cont(sentiment, 0.5) AS q50, quantile_cont(sentiment, 0.75) AS q75 FROM s GROUP BY platform"""),
    "A10_sentiment_table": sql(TEXTS, body=SENTI + """
      SELECT sentiment_label, count(*) AS posts, round(avg(likes), 1) AS mean_likes, round(avg(eng), 1) AS mean_engagement,
             round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM s), 2) AS pct FROM s GROUP BY sentiment_label"""),
    "A10_sentiment_correlation": sql(TEXTS, body=SENTI + """
      SELECT round(corr(sentiment, likes), 4) AS corr_sentiment_likes, round(corr(sentiment, eng), 4) AS corr_sentiment_engagement FROM s"""),
    "A11_country_table": sql(POSTS, USERS, body=COUNTRY + " SELECT * FROM c"),
    "A11_ranked_countries": sql(POSTS, USERS, body=COUNTRY + " SELECT * FROM c WHERE posts >= 40 ORDER BY mean_engagement DESC LIMIT 10"),
    "A11_country_summary": sql(POSTS, USERS, body=COUNTRY + """
      SELECT count(*) AS countries, arg_max(country, mean_engagement) AS best_country, round(max(mean_engagement), 1) AS best_country_engagement,
             round(max(mean_engagement) / min(mean_engagement), 3) AS spread_ratio FROM c"""),
    "A12_user_features": sql(POSTS, USERS, body=FEATURES + """
      SELECT *, CASE WHEN follower_count > 0 THEN total_eng::DOUBLE / follower_count END AS engagement_rate,
             date_diff('day', account_created, (SELECT min(post_date) FROM posts)) AS age_days_at_start FROM f"""),
    "A13_follower_bands": sql(POSTS, USERS, body=FEATURES + """
      , q AS (SELECT list_distinct(quantile_cont(follower_count::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS d FROM f), e AS (SELECT list_sort(d) AS e FROM q),
      b AS (SELECT mean_eng, e, len(list_filter(e[2:len(e) - 1], lambda x: x < follower_count)) AS band FROM f, e WHERE follower_count IS NOT NULL)
      SELECT band, any_value(e[band + 1]) AS over, any_value(e[band + 2]) AS up_to, count(*) AS users, avg(mean_eng) AS mean_engagement FROM b GROUP BY band"""),
    "A14_user_correlations": sql(POSTS, USERS, body=FEATURES + """
      SELECT round(corr(follower_count, mean_eng), 4) AS corr_followers_engagement, round(corr(posts, mean_eng), 4) AS corr_activity_engagement FROM f"""),
    "A15_user_segments": sql(POSTS, USERS, body=FEATURES + """
      , q AS (SELECT quantile_cont(posts, 0.25) AS p25, quantile_cont(posts, 0.5) AS p50, quantile_cont(posts, 0.9) AS p90,
                     quantile_cont(mean_eng, 0.5) AS e50, quantile_cont(mean_eng, 0.75) AS e75 FROM f) """
      + "\n UNION ALL ".join([
          _segment("power_creator", "posts >= p90 AND mean_eng >= e75"), _segment("high_volume_low_yield", "posts >= p90 AND mean_eng < e50"),
          _segment("quiet_performer", "posts <= p25 AND mean_eng >= e75"), _segment("casual", "posts <= p50 AND mean_eng < e50")])),
    "A16_posts_per_user": sql(POSTS, USERS, body=FEATURES + """
      SELECT count(*) AS "count", round(avg(posts), 2) AS mean, round(stddev_samp(posts), 2) AS std, min(posts) AS min, max(posts) AS max,
             round(quantile_cont(posts, 0.25), 2) AS q25, round(quantile_cont(posts, 0.5), 2) AS q50, round(quantile_cont(posts, 0.75), 2) AS q75,
             round(100.0::DOUBLE * list_sum(list(total_eng ORDER BY total_eng DESC)[1:CAST(floor(count(*) * 0.1) AS BIGINT)]) / sum(total_eng), 1) AS top10_share_pct FROM f"""),
    "A17_anomaly_inventory": sql(POSTS, USERS, RAW, body=_inventory()),
    "A18_ratio_signals": sql(TEXTS, body="""
      SELECT count(*) FILTER (likes IS NULL OR likes = 0) AS posts_with_zero_or_missing_likes, round(avg(shares) FILTER (likes IS NULL OR likes = 0), 1) AS their_mean_shares,
             count(*) FILTER (likes > 0 AND (shares + comments)::DOUBLE / nullif(likes, 0) > 3) AS high_share_low_like_posts,
             round(100.0::DOUBLE * count(*) FILTER (likes > 0 AND (shares + comments)::DOUBLE / nullif(likes, 0) > 3) / count(*), 2) AS high_share_low_like_pct,
             (SELECT count(*) FROM (SELECT 1 FROM texts GROUP BY user_id, lower(trim(text_content, ' ' || chr(9) || chr(10) || chr(13))) HAVING count(*) > 1)) AS repeat_content_users FROM texts"""),
    "A19_format_bias": sql(POSTS, body="""
      SELECT timestamp_format, count(*) AS n, round(avg(likes), 1) AS mean_likes, round(avg(shares), 1) AS mean_shares, round(avg(eng_null), 1) AS mean_engagement
      FROM rich GROUP BY timestamp_format"""),
    "A20_post_features": sql(TEXTS, body=SENTI + TAGSETS + """
      SELECT post_id, eng AS engagement, array_to_string(tags, '|') AS hashtags, sentiment, sentiment_label FROM s JOIN g USING (post_id)"""),
}
