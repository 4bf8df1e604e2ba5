"""Registered queries over the second set of analyses, each with its SQL."""

from chirrup.operators import relations as rel
from chirrup.plans import challenge as ch
from registry.core import DEFECTS, SCAN, on
from registry.relations_sql import POSTS, RAW, USERS, sql


def _anomalies(s):
    return rel.post_anomalies(rel.anomaly_scan(s.raw_posts))


QUERIES = {
    "E1_top_platform": on(lambda s: ch.top_platform(s.posts)),
    "E1b_platform_uniformity": on(lambda s: ch.platform_uniformity(s.posts)),
    "E2_top_posts": on(lambda s: ch.top_posts(s.posts)),
    "E2b_top_posts_margin": on(lambda s: ch.top_posts_margin(s.posts)),
    "E3_platform_averages": on(lambda s: ch.platform_averages(s.posts)),
    "E3b_platform_winner_test": on(lambda s: ch.platform_winner_test(s.posts)),
    "E4_shared_but_unliked": on(lambda s: ch.shared_but_unliked(s.posts, shares_over=900)),
    "E4b_shared_but_unliked_rate": on(lambda s: ch.shared_but_unliked_rate(s.posts, shares_over=900)),
    "E5_large_audiences": on(lambda s: ch.large_audiences(s.users)),
    "M1_location_engagement": on(lambda s: ch.location_engagement(s.posts, s.users)),
    "M1b_location_rank_shift": on(lambda s: ch.location_rank_shift(s.posts, s.users)),
    "M2_follower_cohorts": on(lambda s: ch.follower_cohorts(s.posts, s.users)),
    "M2b_follower_cohort_test": on(lambda s: ch.follower_cohort_test(s.posts, s.users)),
    "M3_most_active_users": on(lambda s: ch.most_active_users(s.posts, s.users)),
    "M3b_active_users_tie_band": on(lambda s: ch.active_users_tie_band(s.posts)),
    "M4_platforms_of_large_users": on(lambda s: ch.platforms_of_large_users(s.posts, s.users)),
    "M4b_platform_winner_ladder": on(lambda s: ch.platform_winner_ladder(s.posts, s.users)),
    "M5_suspicious_posts": on(lambda s: ch.suspicious_posts(s.posts)),
    "M5b_suspicious_counts": on(lambda s: ch.suspicious_counts(s.posts)),
    "H1_exceptional_users": on(lambda s: ch.exceptional_users(s.posts, s.users)),
    "H1_exceptional_users_at_125": on(lambda s: ch.exceptional_users(s.posts, s.users, multiple=1.25)),
    "H1b_exceptional_users_proof": on(lambda s: ch.exceptional_users_proof(s.posts)),
    "H1c_exceptional_users_ladder": on(lambda s: ch.exceptional_users_ladder(s.posts)),
    "H2_location_podium": on(lambda s: ch.location_podium(s.posts, s.users)),
    "H2b_podium_margins": on(lambda s: ch.podium_margins(s.posts, s.users)),
    "H3_above_platform_average": on(lambda s: ch.above_platform_average(s.posts)),
    "H3b_above_platform_average_rate": on(lambda s: ch.above_platform_average_rate(s.posts)),
    "H4_small_audience_high_engagement": on(lambda s: ch.small_audience_high_engagement(s.posts, s.users)),
    "H4b_decile_definitions": on(lambda s: ch.decile_definitions(s.posts, s.users)),
    "H5_corrupt_posts": on(lambda s: ch.corrupt_posts(_anomalies(s))),
    "H5b_anomaly_families": on(lambda s: ch.anomaly_families(rel.anomaly_scan(s.raw_posts))),
    "H5c_most_corrupt_posts": on(lambda s: ch.most_corrupt_posts(_anomalies(s))),
    "H6_suspicious_influencers": on(lambda s: ch.suspicious_influencers_ranked(s.posts, s.users)),
    "H6b_suspicious_funnel": on(lambda s: ch.suspicious_funnel(s.posts, s.users)),
}

USER = """, u AS (SELECT user_id, count(*) AS n, sum(eng) AS total, avg(eng) AS mean,
                   coalesce(bool_or(shares > likes), false) AS over FROM rich GROUP BY user_id)"""
JOINED = ", j AS (SELECT u.*, location, follower_count FROM u JOIN users USING (user_id))"
LABELS = """, LISTED AS (SELECT post_id, count(*) AS n_anomalies,
  trim(concat_ws(' ', CASE WHEN bool_or(anomaly_type = 'NEGATIVE_LIKES') THEN 'NEGATIVE_LIKES' END,
     CASE WHEN bool_or(anomaly_type = 'MISSING_PLATFORM') THEN 'MISSING_PLATFORM' END,
     CASE WHEN bool_or(anomaly_type = 'MISSING_TEXT') THEN 'MISSING_TEXT' END,
     CASE WHEN bool_or(anomaly_type = 'HTML_ENTITY_OR_TAG') THEN 'HTML_ENTITY_OR_TAG' END)) AS anomaly_types
  FROM anomalies GROUP BY post_id)"""


def _exceptional(multiple):
    return sql(POSTS, USERS, body=USER + JOINED + f"""
      SELECT user_id, location, follower_count, n AS n_posts, round(mean, 2) AS avg_engagement
      FROM j WHERE mean > {multiple}::DOUBLE * (SELECT avg(eng) FROM rich)""")


ORACLE = {
    "E1_top_platform": sql(POSTS, body="""
      SELECT platform, count(*) AS n_posts FROM posts WHERE platform <> 'Unspecified' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""),
    "E1b_platform_uniformity": sql(POSTS, body="""
      , c AS (SELECT platform, count(*) AS n FROM posts WHERE platform <> 'Unspecified' GROUP BY 1),
      e AS (SELECT sum(n)::DOUBLE AS t, sum(n) / count(*)::DOUBLE AS x, sum(n * n::DOUBLE) / (sum(n) / count(*)::DOUBLE) - sum(n) AS chi FROM c)
      SELECT platform, n AS n_posts, round(100 * n / t, 2) AS pct_share, round(x, 1) AS expected_if_uniform,
             round((n - x) ** 2 / x, 4) AS chi2_term, round(chi, 4) AS chi2_total, 4 AS df,
             CASE WHEN chi > 9.488 THEN 'field is NOT uniform -- the leader is genuinely ahead'
                  ELSE 'field is flat -- the leader is ahead only by noise' END AS verdict_at_5pct FROM c, e"""),
    "E2_top_posts": sql(POSTS, body="""
      SELECT post_id, user_id, platform, likes, shares, comments, eng AS total_engagement FROM rich
      WHERE likes IS NOT NULL ORDER BY eng DESC, post_id LIMIT 10"""),
    "E2b_top_posts_margin": sql(POSTS, body="""
      , k AS (SELECT eng, row_number() OVER (ORDER BY eng DESC, post_id) AS i FROM rich WHERE likes IS NOT NULL),
      t AS (SELECT max(eng) FILTER (i = 10) AS cut FROM k)
      SELECT count(*) AS comparable_posts, max(eng) AS best_engagement, any_value(cut) AS tenth_place_engagement,
             count(*) FILTER (eng >= 0.99::DOUBLE * cut) AS posts_within_1pct_of_cut,
             round(100.0::DOUBLE * max(eng) / any_value(cut) - 100, 2) AS best_over_tenth_pct FROM k, t"""),
    "E3_platform_averages": sql(POSTS, body="""
      SELECT platform, count(*) AS n_posts, count(likes) AS rows_with_likes, round(avg(likes), 1) AS avg_likes,
             round(avg(shares), 1) AS avg_shares, round(avg(comments), 1) AS avg_comments,
             round(avg(eng), 1) AS avg_total_engagement, rank() OVER (ORDER BY avg(eng) DESC) AS engagement_rank,
             CASE platform WHEN 'Unspecified' THEN 'DATA GAP -- not a platform, not eligible to win'
                  ELSE 'labelled platform' END AS eligibility FROM rich GROUP BY platform"""),
    "E3b_platform_winner_test": sql(POSTS, body="""
      , p AS (SELECT platform, count(*) AS n, avg(eng) AS m, var_pop(eng) AS v,
                     row_number() OVER (ORDER BY avg(eng) DESC, platform) AS i
              FROM rich WHERE platform <> 'Unspecified' GROUP BY platform),
      t AS (SELECT a.platform AS pa, b.platform AS pb, a.m AS ma, b.m AS mb,
                   (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS z FROM p a JOIN p b ON a.i = 1 AND b.i = 2)
      SELECT pa AS winner, round(ma, 1) AS winner_avg_engagement, pb AS runner_up, round(mb, 1) AS runner_up_avg_engagement,
             round(ma - mb, 1) AS absolute_gap, round(100 * (ma - mb) / mb, 2) AS gap_pct, round(z, 3) AS z_stat,
             CASE WHEN abs(z) > 1.96 THEN 'SIGNIFICANT at 5%'
                  ELSE 'NOT significant at 5% -- the ranking is a coin toss' END AS verdict FROM t"""),
    "E4_shared_but_unliked": sql(POSTS, body="""
      SELECT post_id, platform, likes, shares, comments FROM posts WHERE shares > 900 AND likes < 500"""),
    "E4b_shared_but_unliked_rate": sql(POSTS, body="""
      SELECT platform, count(*) AS n_posts, count(*) FILTER (shares > 900 AND likes < 500) AS flagged_posts,
             round(100.0::DOUBLE * count(*) FILTER (shares > 900 AND likes < 500) / count(*), 2) AS pct_of_platform
      FROM posts GROUP BY platform"""),
    "E5_large_audiences": sql(USERS, body="""
      SELECT user_id, location, language, follower_count FROM users WHERE follower_count > 40000"""),
    "M1_location_engagement": sql(POSTS, USERS, body="""
      SELECT location, count(*) AS n_posts, CAST(sum(eng) AS BIGINT) AS total_engagement,
             rank() OVER (ORDER BY sum(eng) DESC) AS engagement_rank FROM rich JOIN users USING (user_id) GROUP BY location"""),
    "M1b_location_rank_shift": sql(POSTS, USERS, body="""
      , l AS (SELECT location, count(*) AS n, CAST(sum(eng) AS BIGINT) AS t, avg(eng) AS a,
                     rank() OVER (ORDER BY sum(eng) DESC) AS rt, rank() OVER (ORDER BY avg(eng) DESC) AS ra
              FROM rich JOIN users USING (user_id) GROUP BY location)
      SELECT location, n AS n_posts, t AS total_engagement, round(a, 1) AS avg_engagement_per_post,
             rt AS rank_by_total, ra AS rank_by_avg_per_post, rt - ra AS rank_shift FROM l"""),
    "M2_follower_cohorts": sql(POSTS, USERS, body="""
      SELECT CASE WHEN follower_count >= 25000 THEN 'HIGH (>= 25k followers)' ELSE 'LOW (< 25k followers)' END AS cohort,
             count(DISTINCT user_id) AS n_users, count(*) AS n_posts, round(avg(eng), 2) AS avg_engagement_per_post,
             CAST(sum(eng) AS BIGINT) AS total_engagement, round(stddev_pop(eng), 1) AS sd_engagement
      FROM rich JOIN users USING (user_id) GROUP BY 1"""),
    "M2b_follower_cohort_test": sql(POSTS, USERS, body="""
      , g AS (SELECT avg(eng) FILTER (follower_count >= 25000) AS mh, avg(eng) FILTER (follower_count < 25000) AS ml,
                     var_pop(eng) FILTER (follower_count >= 25000) / count(*) FILTER (follower_count >= 25000)
                     + var_pop(eng) FILTER (follower_count < 25000) / count(*) FILTER (follower_count < 25000) AS v
              FROM rich JOIN users USING (user_id))
      SELECT round(ml, 2) AS low_follower_avg, round(mh, 2) AS high_follower_avg, round(mh - ml, 2) AS difference,
             round(100 * (mh - ml) / ml, 2) AS difference_pct, round((mh - ml) / sqrt(v), 3) AS z_stat,
             CASE WHEN abs((mh - ml) / sqrt(v)) > 1.96 THEN 'SIGNIFICANT at 5%'
                  ELSE 'NOT significant at 5% -- follower count does not predict engagement here' END AS verdict FROM g"""),
    "M3_most_active_users": sql(POSTS, USERS, body=USER + JOINED + """
      SELECT user_id, follower_count, location, n AS n_posts, CAST(total AS BIGINT) AS total_engagement
      FROM j ORDER BY n DESC, total DESC, user_id LIMIT 10"""),
    "M3b_active_users_tie_band": sql(POSTS, body=USER + """
      , c AS (SELECT list(n ORDER BY n DESC)[10] AS cut FROM u)
      SELECT max(n) AS busiest_user_posts, min(n) AS quietest_user_posts, any_value(cut) AS tenth_place_posts,
             count(*) FILTER (n = cut) AS users_tied_at_the_cut, count(DISTINCT n) AS distinct_post_counts FROM u, c"""),
    "M4_platforms_of_large_users": sql(POSTS, USERS, body="""
      SELECT platform, count(*) AS n_posts, round(avg(eng), 1) AS avg_engagement_per_post,
             rank() OVER (ORDER BY avg(eng) DESC) AS rank_within_cohort
      FROM rich WHERE platform <> 'Unspecified' AND user_id IN (SELECT user_id FROM users WHERE follower_count >= 30000)
      GROUP BY platform"""),
    "M4b_platform_winner_ladder": sql(POSTS, USERS, body="""
      SELECT t AS follower_threshold, platform AS winning_platform, count(*) AS n_posts, round(avg(eng), 1) AS avg_engagement_per_post
      FROM (SELECT unnest([25000, 30000, 35000, 40000, 45000]) AS t) JOIN users ON follower_count >= t
      JOIN rich USING (user_id) WHERE platform <> 'Unspecified' GROUP BY t, platform
      QUALIFY row_number() OVER (PARTITION BY t ORDER BY avg(eng) DESC, platform) = 1"""),
    "M5_suspicious_posts": sql(POSTS, body="""
      SELECT post_id, user_id, platform, likes, shares, comments, shares - likes - coalesce(comments, 0) AS excess_shares,
             round(shares::DOUBLE / nullif(likes + coalesce(comments, 0), 0), 2) AS share_to_reaction_ratio
      FROM posts WHERE shares - likes - coalesce(comments, 0) > 0 ORDER BY excess_shares DESC, post_id LIMIT 20"""),
    "M5b_suspicious_counts": sql(POSTS, body="""
      , f AS (SELECT likes IS NULL AS blank FROM posts WHERE shares > coalesce(likes, 0) + coalesce(comments, 0))
      SELECT count(*) FILTER (NOT blank) AS strict_definition, count(*) AS likes_read_as_zero,
             count(*) FILTER (blank) AS anomalies_created_by_blanks, count(*) - count(*) FILTER (NOT blank) AS arithmetic_gap,
             round(100.0::DOUBLE * count(*) FILTER (blank) / nullif(count(*), 0), 2) AS pct_of_loose_that_is_missing_data,
             'every extra row in the loose reading is a missing like count' AS reconciliation FROM f"""),
    "H1_exceptional_users": _exceptional("2.0"),
    "H1_exceptional_users_at_125": _exceptional("1.25"),
    "H1b_exceptional_users_proof": sql(POSTS, body=USER + """
      , b AS (SELECT avg(eng) AS base FROM rich)
      SELECT round(any_value(base), 2) AS overall_avg_per_post, round(2 * any_value(base), 2) AS threshold_2x,
             count(*) AS users_examined, round(max(mean), 2) AS highest_user_avg,
             (SELECT user_id FROM u ORDER BY mean DESC, user_id LIMIT 1) AS highest_avg_user,
             round(max(mean) / any_value(base), 3) AS highest_avg_as_multiple_of_baseline,
             count(*) FILTER (mean > 2 * base) AS qualifying_users,
             CASE WHEN count(*) FILTER (mean > 2 * base) > 0 THEN 'threshold is reachable -- empty result would be a bug'
                  ELSE 'EMPTY BY ARITHMETIC -- no user reaches 2x, so H1 returning 0 rows is the answer' END AS verdict FROM u, b"""),
    "H1c_exceptional_users_ladder": sql(POSTS, body=USER + """
      , b AS (SELECT avg(eng) AS base FROM rich), r(f, multiple) AS (VALUES (1.25::DOUBLE, '1.25x'), (1.5, '1.50x'), (1.75, '1.75x'), (2.0, '2.00x'))
      SELECT multiple, round(f * base, 2) AS threshold, (SELECT count(*) FROM u WHERE mean > f * base) AS users_qualifying FROM r, b"""),
    "H2_location_podium": sql(POSTS, USERS, body=USER + JOINED + """
      SELECT location, row_number() OVER w AS rank_in_location, user_id, follower_count, n AS n_posts,
             CAST(total AS BIGINT) AS total_engagement FROM j
      WINDOW w AS (PARTITION BY location ORDER BY total DESC, n DESC, user_id) QUALIFY row_number() OVER w <= 3"""),
    "H2b_podium_margins": sql(POSTS, USERS, body=USER + JOINED + """
      , t AS (SELECT location, list(CAST(total AS BIGINT) ORDER BY total DESC) AS l FROM j GROUP BY location)
      SELECT location, l[3] AS third_place, l[4] AS fourth_place, l[3] - l[4] AS absolute_margin,
             round(100.0::DOUBLE * (l[3] - l[4]) / l[4], 2) AS margin_pct FROM t ORDER BY margin_pct NULLS FIRST, location LIMIT 8"""),
    "H3_above_platform_average": sql(POSTS, body="""
      , a AS (SELECT *, avg(eng) OVER (PARTITION BY platform) AS m FROM rich WHERE platform <> 'Unspecified')
      SELECT post_id, user_id, platform, likes, shares, comments, round(m, 1) AS platform_avg_engagement,
             eng AS post_engagement, round(eng / m, 3) AS multiple_of_platform_avg FROM a WHERE eng >= 2 * m"""),
    "H3b_above_platform_average_rate": sql(POSTS, body="""
      , a AS (SELECT platform, eng, avg(eng) OVER (PARTITION BY platform) AS m FROM rich)
      SELECT platform, count(*) AS n_posts, round(any_value(m), 1) AS platform_avg_engagement,
             round(2 * any_value(m), 1) AS exceptional_threshold, count(*) FILTER (eng >= 2 * m) AS exceptional_posts,
             round(100.0::DOUBLE * count(*) FILTER (eng >= 2 * m) / count(*), 2) AS pct_of_platform,
             CASE platform WHEN 'Unspecified' THEN 'DATA GAP -- excluded from the H3 answer' ELSE 'labelled platform' END AS eligibility
      FROM a GROUP BY platform"""),
    "H4_small_audience_high_engagement": sql(POSTS, USERS, body=USER + """
      , d AS (SELECT *, ntile(10) OVER (ORDER BY total DESC, user_id) AS decile FROM u)
      SELECT user_id, location, follower_count, n AS n_posts, CAST(total AS BIGINT) AS total_engagement,
             round(mean, 2) AS avg_engagement_per_post, decile AS engagement_decile,
             (SELECT CAST(min(total) AS BIGINT) FROM d WHERE decile = 1) AS top_decile_floor_engagement
      FROM d JOIN users USING (user_id) WHERE decile = 1 AND follower_count < 5000"""),
    "H4b_decile_definitions": sql(POSTS, USERS, body=USER + """
      , d AS (SELECT user_id, total, ntile(10) OVER (ORDER BY total DESC, user_id) = 1 AS a,
                     row_number() OVER (ORDER BY total DESC, user_id) <= 0.10::DOUBLE * count(*) OVER () AS b FROM u),
      c AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM d JOIN users USING (user_id) WHERE follower_count < 5000)
      SELECT (SELECT CAST(min(total) AS BIGINT) FROM d WHERE b) AS top_decile_floor_engagement, na AS via_ntile_10_buckets,
             nb AS via_explicit_percentile,
             CASE WHEN na = nb THEN 'the two definitions AGREE -- the answer is not an artefact of NTILE'
                  ELSE 'the definitions DISAGREE -- report the boundary as unstable' END AS robustness FROM c"""),
    "H5_corrupt_posts": sql(POSTS, RAW, body=SCAN + DEFECTS + LABELS + " SELECT * FROM LISTED"),
    "H5b_anomaly_families": sql(POSTS, RAW, body=SCAN + """
      , f AS (SELECT post_id, unnest([{'t': 'NEGATIVE_LIKES', 'x': is_negative_likes}, {'t': 'MISSING_PLATFORM', 'x': is_missing_platform},
                {'t': 'MISSING_TEXT', 'x': is_missing_text}, {'t': 'HTML_ENTITY_OR_TAG', 'x': is_html_markup}]) AS d FROM scan)
      SELECT d.t AS anomaly_type, count(*) FILTER (d.x = 1) AS intake_rows, count(DISTINCT post_id) FILTER (d.x = 1) AS distinct_posts,
             count(*) FILTER (d.x = 1) - count(DISTINCT post_id) FILTER (d.x = 1) AS replay_rows_removed FROM f GROUP BY 1"""),
    "H5c_most_corrupt_posts": sql(POSTS, RAW, body=SCAN + DEFECTS + LABELS + """
      SELECT * FROM LISTED WHERE n_anomalies = (SELECT max(n_anomalies) FROM LISTED)"""),
    "H6_suspicious_influencers": sql(POSTS, USERS, body=USER + JOINED + """
      SELECT location, follower_count, n AS n_posts, round(mean, 2) AS avg_engagement_per_post,
             CAST(total AS BIGINT) AS total_engagement, rank() OVER (ORDER BY total DESC) AS engagement_rank, user_id
      FROM j WHERE follower_count < 10000 AND over AND mean > (SELECT avg(eng) FROM rich)"""),
    "H6b_suspicious_funnel": sql(POSTS, USERS, body=USER + JOINED + """
      , b AS (SELECT avg(eng) AS base FROM rich)
      SELECT (SELECT count(*) FROM users) AS all_users, (SELECT count(*) FROM users WHERE follower_count < 10000) AS c1_fewer_than_10k_followers,
             (SELECT count(*) FROM u WHERE mean > base) AS c2_above_overall_avg, (SELECT count(*) FROM u WHERE over) AS c3_has_over_shared_post,
             (SELECT count(*) FROM j WHERE follower_count < 10000 AND over AND mean > base) AS all_three_conditions FROM b"""),
}
