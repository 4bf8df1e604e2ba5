"""Registered queries over the relations and the first set of analyses, each with its SQL."""

from chirrup.operators import relations as rel
from chirrup.plans import core
from chirrup.sources.star_adapter import StarSchema
from registry.relations_sql import POSTS, RAW, TAGS, TEXTS, TIMED, USERS, sql

WINDOW = {"start": "1995-06-01", "end": "2000-06-01"}


def on(build):
    """Turn a function of the adapter into a (spark, folder) query."""
    return lambda spark, folder: build(StarSchema(spark, folder))


QUERIES = {
    "V1_posts_enriched": on(
        lambda s: rel.enriched(s.posts).select("post_id", "engagement", "amplify_ratio", "partial_metrics")
    ),
    "V2_monthly": on(lambda s: rel.monthly(s.posts)),
    "V3_user_totals": on(lambda s: rel.user_totals(s.posts, s.users)),
    "V4_location_totals": on(lambda s: rel.location_totals(s.posts, s.users)),
    "V5_platform_totals": on(lambda s: rel.platform_totals(s.posts)),
    "V6_raw_anomaly_scan": on(lambda s: rel.anomaly_scan(s.raw_posts)),
    "V7_raw_post_anomalies": on(lambda s: rel.post_anomalies(rel.anomaly_scan(s.raw_posts))),
    "V8_post_tags": on(lambda s: rel.post_tags(s.text_posts)),
    "V9_mentions": on(
        lambda s: s.table("documents").select("doc_id", rel.F.size(rel.mentions(rel.F.col("text"))).cast("long").alias("n_mentions"))
    ),
    "Q1_monthly_momentum": on(lambda s: core.monthly_momentum(s.posts)),
    "Q2_turning_points": on(lambda s: core.turning_points(s.posts)),
    "Q3_platform_league": on(lambda s: core.platform_league(s.posts)),
    "Q4_amplified_posts": on(lambda s: core.amplified_posts(s.posts)),
    "Q5_amplification_attribution": on(lambda s: core.amplification_attribution(s.posts, s.users)),
    "Q6_midnight_illusion": on(lambda s: core.midnight_illusion(s.timed_posts)),
    "Q7_rfm_segments": on(lambda s: core.rfm_segments(s.posts)),
    "Q8_follower_correlation": on(lambda s: core.follower_correlation(s.posts, s.users)),
    "Q9_follower_quintiles": on(lambda s: core.follower_quintiles(s.posts, s.users)),
    "Q10_hashtag_momentum": on(lambda s: core.hashtag_momentum(s.posts, s.post_tags)),
    "Q11_posting_streaks": on(lambda s: core.posting_streaks(s.posts)),
    "Q12_integrity_gate": on(lambda s: core.integrity_gate(s.posts, s.users, **WINDOW)),
}

MONTHS = """, months AS (SELECT post_month, count(*) AS posts, avg(eng) AS mean_engagement FROM rich GROUP BY 1)"""

SCAN = """, scan AS (
  SELECT row_no, post_id, CAST(coalesce(TRY_CAST(trim(likes) AS DOUBLE), 0) < 0 AS BIGINT) AS is_negative_likes,
         CAST(upper(trim(regexp_replace(platform, '[\\t\\n\\r\\f\\v]', ' ', 'g'))) IN ('', 'NULL', 'NONE', 'NAN', 'N/A', 'NA') AS BIGINT) AS is_missing_platform,
         CAST(upper(trim(regexp_replace(text_content, '[\\t\\n\\r\\f\\v]', ' ', 'g'))) IN ('', 'NULL', 'NONE', 'NAN', 'N/A', 'NA') AS BIGINT) AS is_missing_text,
         CAST(regexp_matches(text_content, '&amp;|&lt;|&gt;|<div|<br', 'i') AS BIGINT) AS is_html_markup,
         trim(likes) AS raw_likes, trim(platform) AS raw_platform, text_content AS raw_text FROM raw_posts)"""

DEFECTS = """, defects AS (
  SELECT DISTINCT post_id, unnest(list_filter([
      CASE WHEN is_negative_likes = 1 THEN {'t': 'NEGATIVE_LIKES', 'e': 'raw likes = ' || raw_likes} END,
      CASE WHEN is_missing_platform = 1 THEN {'t': 'MISSING_PLATFORM', 'e': CASE raw_platform WHEN '' THEN 'platform is blank' ELSE 'platform = ' || raw_platform END} END,
      CASE WHEN is_missing_text = 1 THEN {'t': 'MISSING_TEXT', 'e': 'text_content is blank or the NULL token'} END,
      CASE WHEN is_html_markup = 1 THEN {'t': 'HTML_ENTITY_OR_TAG', 'e': 'contains ' || CASE WHEN raw_text ILIKE '%&amp;%' THEN '&amp;'
           WHEN raw_text ILIKE '%&lt;%' THEN '&lt;' WHEN raw_text ILIKE '%&gt;%' THEN '&gt;'
           WHEN raw_text ILIKE '%<div%' THEN '<div>' ELSE '<br>' END} END], lambda x: x IS NOT NULL)) AS d FROM scan),
  anomalies AS (SELECT post_id, d.t AS anomaly_type, d.e AS evidence FROM defects)"""

ORACLE = {
    "V1_posts_enriched": sql(POSTS, body="""
      SELECT post_id, eng AS engagement, amp AS amplify_ratio,
             CAST(likes IS NULL OR shares IS NULL OR comments IS NULL AS BIGINT) AS partial_metrics FROM rich"""),
    "V2_monthly": sql(POSTS, body="""
      SELECT post_month, count(*) AS posts, avg(coalesce(likes, shares, comments)) AS approx_reach,
             CAST(sum(eng) AS BIGINT) AS total_engagement, avg(eng) AS mean_engagement,
             CAST(sum(likes_restored) AS BIGINT) AS repaired_like_rows FROM rich GROUP BY ALL"""),
    "V3_user_totals": sql(POSTS, USERS, body="""
      SELECT user_id, any_value(location) AS location, any_value(language) AS language,
             any_value(follower_count) AS follower_count, count(*) AS n_posts, CAST(sum(eng) AS BIGINT) AS total_engagement,
             avg(eng) AS avg_engagement, avg(eng) AS eng_per_post FROM rich JOIN users USING (user_id) GROUP BY user_id"""),
    "V4_location_totals": sql(POSTS, USERS, body="""
      SELECT location, count(DISTINCT user_id) AS n_users, count(*) AS n_posts, CAST(sum(eng) AS BIGINT) AS total_engagement,
             avg(eng) AS avg_engagement_per_post FROM rich JOIN users USING (user_id) GROUP BY location"""),
    "V5_platform_totals": sql(POSTS, body="""
      SELECT platform, count(*) AS n_posts, avg(eng) AS avg_engagement, CAST(sum(eng) AS BIGINT) AS total_engagement,
             avg(coalesce(likes, 0)) AS avg_likes, avg(coalesce(shares, 0)) AS avg_shares,
             avg(coalesce(comments, 0)) AS avg_comments, count(likes) AS rows_with_likes FROM rich GROUP BY platform"""),
    "V6_raw_anomaly_scan": sql(POSTS, RAW, body=SCAN + " SELECT * FROM scan"),
    "V7_raw_post_anomalies": sql(POSTS, RAW, body=SCAN + DEFECTS + " SELECT * FROM anomalies"),
    "V8_post_tags": sql(TEXTS, body="""
      SELECT DISTINCT post_id, unnest(regexp_extract_all(text_content, '#([A-Za-z][A-Za-z0-9_]*)', 1)) AS tag FROM texts"""),
    "V9_mentions": """
      SELECT doc_id, len(list_distinct(regexp_extract_all(text, '@([A-Za-z][A-Za-z0-9_]*)', 1))) AS n_mentions FROM documents""",
    "Q1_monthly_momentum": sql(POSTS, body=MONTHS + """
      SELECT post_month, posts, lag(posts) OVER w AS prev_month,
             round(100.0::DOUBLE * (posts - lag(posts) OVER w) / lag(posts) OVER w, 2) AS mom_pct,
             round(mean_engagement, 1) AS mean_engagement,
             round((posts - avg(posts) OVER ()) / nullif(stddev_pop(posts) OVER (), 0), 2) AS z_volume,
             (SELECT count(*) + 1 FROM months o WHERE o.posts > months.posts) AS volume_rank
      FROM months WINDOW w AS (ORDER BY post_month)"""),
    "Q2_turning_points": sql(POSTS, body=MONTHS + """
      , s AS (SELECT a.post_month, any_value(a.posts) AS posts, avg(b.posts) AS ma3
              FROM (SELECT *, row_number() OVER (ORDER BY post_month) AS i FROM months) a
              JOIN (SELECT posts, row_number() OVER (ORDER BY post_month) AS i FROM months) b ON abs(a.i - b.i) <= 1
              GROUP BY a.post_month)
      SELECT post_month, posts, round(ma3, 1) AS ma3,
             CASE WHEN ma3 > lag(ma3) OVER w AND ma3 > lead(ma3) OVER w THEN 'PEAK'
                  WHEN ma3 < lag(ma3) OVER w AND ma3 < lead(ma3) OVER w THEN 'TROUGH' ELSE '--' END AS inflection
      FROM s WINDOW w AS (ORDER BY post_month)"""),
    "Q3_platform_league": sql(POSTS, body="""
      SELECT platform, count(*) AS posts, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM rich), 2) AS share_pct,
             count(*) - count(likes) AS likes_missing,
             round(100.0::DOUBLE * (count(*) - count(likes)) / count(*), 2) AS likes_missing_pct,
             round(avg(eng), 1) AS mean_engagement, round(avg(shares), 1) AS mean_shares,
             round(avg(comments), 1) AS mean_comments, CAST(platform <> 'Unspecified' AS BIGINT) AS in_rate_comparison
      FROM rich GROUP BY platform"""),
    "Q4_amplified_posts": sql(POSTS, body="""
      SELECT count(*) FILTER (amp > 3) AS anomalous_posts, count(*) AS comparable_posts,
             round(100.0::DOUBLE * count(*) FILTER (amp > 3) / count(*), 2) AS pct_of_comparable,
             round(avg(amp) FILTER (amp > 3), 2) AS mean_ratio, round(max(amp) FILTER (amp > 3), 1) AS worst_ratio
      FROM rich WHERE likes > 0"""),
    "Q5_amplification_attribution": sql(POSTS, USERS, body="""
      , c AS (SELECT user_id, count(post_id) AS a FROM users LEFT JOIN
                (SELECT user_id, post_id FROM rich WHERE amp > 3) USING (user_id) GROUP BY user_id),
      t AS (SELECT count(*) AS n, sum(a) AS k, sum(a) / count(*)::DOUBLE AS l, count(*) FILTER (a >= 3) AS o3,
                   count(*) FILTER (a >= 4) AS o4, max(a) AS top FROM c),
      e AS (SELECT *, n * (1 - exp(-l) * (1 + l + l * l / 2)) AS e3,
                   n * (1 - exp(-l) * (1 + l + l * l / 2 + l * l * l / 6)) AS e4 FROM t)
      SELECT n AS n_users, CAST(k AS BIGINT) AS n_anom, round(l, 4) AS poisson_lambda, o3 AS obs_ge3,
             round(e3, 1) AS expected_ge3_by_chance, o4 AS obs_ge4, round(e4, 1) AS expected_ge4_by_chance,
             top AS busiest_author, round(o3 / e3, 3) AS observed_over_expected,
             CASE WHEN o3 >= 0.8 * e3 AND o3 <= 1.25 * e3
                  THEN 'DIFFUSE -- indistinguishable from random scatter, NOT a coordinated ring'
                  ELSE 'CONCENTRATED -- attribution is warranted' END AS verdict FROM e"""),
    "Q6_midnight_illusion": sql(TIMED, body="""
      SELECT post_hour, count(*) AS rows_naive, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM timed), 2) AS pct_naive,
             CAST(sum(has_time) AS BIGINT) AS rows_with_real_time,
             round(100.0::DOUBLE * sum(has_time) / (SELECT sum(has_time) FROM timed), 2) AS pct_valid,
             count(*) FILTER (has_time = 0) AS artefact_rows FROM timed GROUP BY post_hour"""),
    "Q7_rfm_segments": sql(POSTS, body="""
      , b AS (SELECT user_id, date_diff('day', max(posted_at), (SELECT max(posted_at) FROM rich)) AS rec,
                     count(*) AS freq, sum(eng) AS mon FROM rich GROUP BY user_id),
      t AS (SELECT *, ntile(5) OVER (ORDER BY rec DESC, user_id) AS r, ntile(5) OVER (ORDER BY freq, user_id) AS f,
                   ntile(5) OVER (ORDER BY mon, user_id) AS m FROM b),
      g AS (SELECT *, CASE WHEN least(r, f, m) >= 4 THEN 'champions' WHEN r >= 4 AND f <= 2 THEN 'new_and_promising'
                           WHEN r <= 2 AND f >= 4 THEN 'drifting_regulars' WHEN greatest(r, m) <= 2 THEN 'lapsed_low_value'
                           ELSE 'mid_value' END AS segment FROM t)
      SELECT segment, count(*) AS users, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM g), 2) AS share_pct,
             round(avg(freq), 2) AS avg_posts, round(avg(mon), 1) AS avg_total_engagement,
             round(avg(rec), 0) AS avg_days_since_last_post FROM g GROUP BY segment"""),
    "Q8_follower_correlation": sql(POSTS, USERS, body="""
      , u AS (SELECT user_id, avg(eng) AS e, any_value(follower_count) AS f FROM rich JOIN users USING (user_id) GROUP BY 1),
      c AS (SELECT count(*) AS n, corr(f, e) AS r FROM u)
      SELECT n AS users, round(r, 4) AS pearson_r, round(100 * r * r, 2) AS r_squared_pct,
             CASE WHEN abs(r) < 0.1 THEN 'no material relationship' ELSE 'relationship worth modelling' END AS verdict FROM c"""),
    "Q9_follower_quintiles": sql(POSTS, USERS, body="""
      SELECT CAST(q AS BIGINT) AS quintile, CASE q WHEN 1 THEN '1 (fewest)' WHEN 5 THEN '5 (most)' ELSE CAST(q AS VARCHAR) END AS follower_band,
             min(follower_count) AS min_followers, max(follower_count) AS max_followers, count(*) AS posts,
             round(avg(eng), 1) AS mean_engagement
      FROM (SELECT follower_count, eng, ntile(5) OVER (ORDER BY follower_count, post_id) AS q
            FROM rich JOIN users USING (user_id)) GROUP BY q"""),
    "Q10_hashtag_momentum": sql(POSTS, TAGS, body="""
      , n AS (SELECT tag, post_month, round(100.0::DOUBLE * count(*) / any_value(t.c), 2) AS pct
              FROM post_tags JOIN posts USING (post_id)
              JOIN (SELECT post_month, count(*) AS c FROM posts GROUP BY 1) t USING (post_month) GROUP BY tag, post_month),
      d AS (SELECT *, pct - lag(pct) OVER (PARTITION BY tag ORDER BY post_month) AS gain FROM n),
      x AS (SELECT tag, max(pct) FILTER (post_month = (SELECT max(post_month) FROM posts)) AS z,
                   max(pct) FILTER (post_month = (SELECT min(post_month) FROM posts)) AS a, max(gain) AS g FROM d GROUP BY tag)
      SELECT tag, z AS pct_final_month, a AS pct_first_month, round(z - a, 2) AS pp_change,
             round(g, 2) AS best_single_month_gain_pp FROM x ORDER BY pp_change DESC NULLS LAST, tag LIMIT 8"""),
    "Q11_posting_streaks": sql(POSTS, body="""
      , d AS (SELECT DISTINCT user_id, post_date FROM posts),
      s AS (SELECT *, coalesce(post_date - lag(post_date) OVER w <> 1, true) AS fresh FROM d
            WINDOW w AS (PARTITION BY user_id ORDER BY post_date)),
      r AS (SELECT user_id, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY post_date) AS run FROM s),
      l AS (SELECT count(*) AS streak_len FROM r GROUP BY user_id, run)
      SELECT streak_len, count(*) AS streaks, round(avg(streak_len), 1) AS avg_days_in_streak,
             max(streak_len) AS max_days_in_streak FROM l GROUP BY streak_len"""),
    "Q12_integrity_gate": sql(POSTS, USERS, body="""
      SELECT 'duplicate post_id' AS check_name, count(*) - count(DISTINCT post_id) AS violations FROM posts
      UNION ALL SELECT 'orphan user_id', count(*) FROM posts ANTI JOIN users USING (user_id)
      UNION ALL SELECT 'negative engagement', count(*) FROM posts WHERE likes < 0 OR shares < 0 OR comments < 0
      UNION ALL SELECT 'post before signup', count(*) FROM posts JOIN users USING (user_id) WHERE posted_at < account_created
      UNION ALL SELECT 'timestamps outside window', count(*) FROM posts
                WHERE NOT (posted_at >= TIMESTAMP '1995-06-01' AND posted_at < TIMESTAMP '2000-06-01')"""),
}
