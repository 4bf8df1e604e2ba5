"""Registered queries over the intake repair and the expectations, each with its SQL."""

from pyspark.sql import functions as F

from chirrup.operators import intake, quality
from chirrup.operators import relations as rel
from chirrup.session import new_path
from registry.core import DEFECTS, SCAN, on
from registry.relations_sql import POSTS, RAW, RAW_USERS, TAGS, TEXTS, TIMED, USERS, sql

WINDOW = {"start": "1995-06-01", "end": "2000-06-01"}
PLATFORMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def _repair(s):
    return intake.repair_posts(s.raw_posts, **WINDOW)


def _deduplicated(s):
    blank = intake.normalise_missing(s.raw_posts.select(*intake.RAW_COLUMNS), intake.RAW_COLUMNS)
    return intake.collapse_replays(blank, intake.RAW_COLUMNS)


def _text_hits(s):
    return intake.repair_text(_deduplicated(s).select("post_id", "text_content"))


def _document_repair(s):
    k = F.col("doc_id")
    broken = s.table("documents").select(
        k.alias("post_id"),
        F.concat(
            F.when(k % 3 == 0, "<p>").otherwise(" "),
            F.col("text"),
            F.when(k % 5 == 0, " &lt;br&gt;,").when(k % 5 == 1, "&quot;  &amp;").otherwise(",,"),
        ).alias("text_content"),
    )
    return intake.repair_text(broken)


def _expectations(s):
    anomalies = rel.post_anomalies(rel.anomaly_scan(s.raw_posts))
    rules = quality.table_expectations(s.posts, s.users, s.post_tags, anomalies, platforms=PLATFORMS)
    return rules.unionByName(quality.predicates(s.timed_posts, quality.hour_rules()))


def _claims(s):
    claimed = s.posts.groupBy("platform").agg(F.count("likes").cast("double").alias("value"))
    actual = s.posts.groupBy("platform").agg(F.sum(F.col("likes").isNotNull().cast("double")).alias("value"))
    return quality.compare_claims(claimed, actual, ["platform"], "value")


PUBLISHED = {"n_posts": 0, "avg_engagement": 2, "avg_likes": 1, "total_engagement": 0}


def _published_claims(s):
    """Figures published as a file while the later posts were not yet known, held against the whole table."""
    path = new_path(s.spark, "claims")
    known = s.posts.where((F.col("posted_at") < F.lit("1997-01-01").cast("timestamp")) | (F.col("platform") != "2-HIGH"))
    quality.publish_claims(rel.platform_totals(known), "platform", PUBLISHED, path)
    return quality.check_claims(quality.read_claims(s.spark, "platform", path), rel.platform_totals(s.posts), "platform")


CLEAN = (
    "post_id", "user_id", "platform", "text_content", "timestamp", "likes", "shares", "comments", "timestamp_format",
    "flag_ambiguous_date_format", "post_date", "post_month", "post_hour", "weekday", "is_weekend", "flag_likes_sign_restored",
)

QUERIES = {
    "C1_C2_deduplicated": on(_deduplicated),
    "C3_text_repair": on(lambda s: _text_hits(s)),
    "C3_text_repair_documents": on(_document_repair),
    "C5_C9_analysis_posts": on(lambda s: _repair(s).analysis.select(*CLEAN)),
    "C7_dayfirst_proof": on(lambda s: intake.dayfirst_proof(s.raw_posts)),
    "C10_users": on(lambda s: intake.repair_users(s.raw_users)),
    "C11_held_out": on(lambda s: _repair(s).held_out.select("post_id", "likes", "timestamp", "held_out_reason")),
    "C12_integrity_checks": on(lambda s: intake.integrity_checks(_repair(s).repaired, intake.repair_users(s.raw_users), **WINDOW)),
    "C12_user_record_exists": on(
        lambda s: intake.with_user_record(_repair(s).repaired, intake.repair_users(s.raw_users).where("follower_count is not null"))
        .groupBy("user_record_exists").agg(F.count(F.lit(1)).alias("posts"))
    ),
    "C13_repair_log": on(lambda s: _repair(s).log.drop("justification")),
    "C14_raw_facts": on(lambda s: intake.raw_facts(s.raw_posts)),
    "C15_column_profile": on(lambda s: intake.column_profile(s.raw_posts, intake.RAW_COLUMNS)),
    "C16_residual_sweep": on(lambda s: intake.residual_sweep(_repair(s).analysis)),
    "C17_reconciliation": on(lambda s: _repair(s).counts),
    "C18_residual_missingness": on(lambda s: intake.residual_missingness(_repair(s).repaired)),
    "C19_before_and_after": on(lambda s: intake.before_and_after(s.raw_posts, _repair(s).repaired)),
    "K1_K6_expectations": on(_expectations),
    "K7_claims": on(_claims),
    "K7_published_claims": on(_published_claims),
}

WS = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
TOKENS = "('', 'NULL', 'null', 'None', 'NaN', 'nan', 'N/A', 'NA', 'n/a')"
LOWER_TOKENS = "('', 'null', 'none', 'nan', 'n/a', 'na')"


def strip(x):
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def present(x):
    return f"CASE WHEN {strip(x)} NOT IN {TOKENS} THEN {x} END"


COLS = ("post_id", "user_id", "platform", "text_content", '"timestamp"', "likes", "shares", "comments")
SINGLE = ", single AS (SELECT " + ", ".join(f"{present(c)} AS {c}" for c in COLS) + ", count(*) AS copies FROM raw_posts GROUP BY ALL)"


def repair(source):
    """CTE ``fixed``: rows of ``source`` with the repaired text ``clean`` and the hit counters."""
    return f"""
      , r1 AS (SELECT *, coalesce(regexp_matches(text_content, '&#|&amp;|&lt;|&gt;|&quot;'), false) AS ent FROM {source}),
      r2 AS (SELECT *, CASE WHEN ent THEN replace(replace(replace(replace(text_content, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')
                       ELSE text_content END AS s FROM r1),
      r3 AS (SELECT *, {strip('s')} AS core FROM r2),
      r4 AS (SELECT *, regexp_replace(core, '</?(?:br|div|p|span)\\s*/?>', '', 'gi') AS bare FROM r3),
      r5 AS (SELECT *, regexp_replace(bare, '[{WS}&,]+$', '') AS body FROM r4),
      r6 AS (SELECT *, substr(bare, len(body) + 1) AS tail,
             CASE WHEN regexp_matches(body, '[\\x{{c2}}-\\x{{f3}}][\\x{{80}}-\\x{{bf}}]') AND NOT regexp_matches(body, '[^\\x{{0}}-\\x{{ff}}]')
                  THEN nullif(try(decode(from_hex(array_to_string(list_transform(string_split(body, ''), lambda c: printf('%02x', unicode(c))), '')))), body) END AS un
             FROM r5),
      r7 AS (SELECT *, CASE WHEN un LIKE '%é' THEN {strip("left(un, len(un) - 1)")} ELSE coalesce(un, body) END AS txt FROM r6),
      fixed AS (SELECT *, CASE WHEN lower(txt) IN {LOWER_TOKENS} THEN NULL WHEN txt LIKE '%  %' THEN regexp_replace(txt, '[ \\t]{{2,}}', ' ', 'g') ELSE txt END AS clean,
             CAST(un IS NOT NULL AS BIGINT) AS hit_mojibake, CAST(coalesce(un LIKE '%é', false) AS BIGINT) AS hit_mojibake_tail,
             CAST(ent AS BIGINT) AS hit_html_entity, CAST(coalesce(bare <> core, false) AS BIGINT) AS hit_html_tag,
             coalesce(len(tail) - len(replace(tail, '&', '')), 0) AS hit_stray_amp, coalesce(len(tail) - len(replace(tail, ',', '')), 0) AS hit_trailing_comma,
             CAST(coalesce(txt LIKE '%  %' AND lower(txt) NOT IN {LOWER_TOKENS}, false) AS BIGINT) AS hit_double_space, CAST(coalesce(core <> s, false) AS BIGINT) AS hit_padded,
             CAST(coalesce(lower(txt) IN {LOWER_TOKENS}, false) AS BIGINT) AS hit_sentinel_string FROM r7)"""


HITS = "hit_mojibake, hit_mojibake_tail, hit_html_entity, hit_html_tag, hit_stray_amp, hit_trailing_comma, hit_double_space, hit_padded, hit_sentinel_string"

REPAIRED = SINGLE + repair("single") + f"""
  , stamped AS (SELECT *, {strip('"timestamp"')} AS ts FROM fixed),
  typed AS (SELECT *, CASE WHEN ts IS NULL OR lower(ts) IN {LOWER_TOKENS} THEN 'missing'
              WHEN regexp_full_match(ts, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 'iso8601'
              WHEN regexp_full_match(ts, '\\d{{10}}') THEN 'epoch_seconds'
              WHEN regexp_full_match(ts, '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN 'dayfirst_dmy' ELSE 'unparsed' END AS fmt,
              CAST(TRY_CAST(likes AS DOUBLE) AS BIGINT) AS nl FROM stamped),
  repaired AS (SELECT post_id, user_id, CASE lower({strip('platform')}) WHEN 'x' THEN 'Twitter' WHEN 'insta' THEN 'Instagram' WHEN 'youtube' THEN 'YouTube'
                 WHEN 'fb' THEN 'Facebook' ELSE coalesce({strip('platform')}, 'Unspecified') END AS platform, clean AS text_content,
              CASE fmt WHEN 'iso8601' THEN strptime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 'epoch_seconds' THEN make_timestamp(CAST(ts AS BIGINT) * 1000000)
                 WHEN 'dayfirst_dmy' THEN strptime(ts, '%d-%m-%Y') END AS "timestamp", abs(nl) AS likes,
              TRY_CAST(shares AS BIGINT) AS shares, TRY_CAST(comments AS BIGINT) AS comments, fmt AS timestamp_format,
              fmt = 'dayfirst_dmy' AS flag_ambiguous_date_format, coalesce(nl < 0, false) AS flag_likes_sign_restored, copies,
              platform IS NULL AS no_platform, {HITS} FROM typed)"""

FIX_USERS = f""", fixed_users AS (
  SELECT user_id, location, lower({strip(present('language'))}) AS language,
         CAST(TRY_CAST({present('account_created')} AS DATE) AS DATE) AS account_created,
         CASE WHEN CAST(follower_count AS BIGINT) >= 0 THEN CAST(follower_count AS BIGINT) END AS follower_count,
         split_part(location, ',', 1) AS city,
         replace(replace(trim(substr(location, strpos(location, ',') + 1)), 'UK', 'United Kingdom'), 'USA', 'United States') AS country
  FROM raw_users)"""


def log_rows():
    rows = [("textual_NULL -> real NULL", c.strip('"'), f"max((SELECT count(*) FROM raw_posts WHERE {strip(c)} IN {TOKENS}))") for c in COLS]
    rows.append(("drop exact duplicate row", "*", "sum(copies) - count(*)"))
    names = {
        "mojibake": "repair double-encoded UTF-8", "mojibake_tail": "strip decoded mojibake tail mark",
        "html_entity": "unescape HTML entities", "html_tag": "strip injected HTML tags", "stray_amp": "drop stray trailing ''&''",
        "trailing_comma": "drop orphaned trailing '',''", "double_space": "collapse repeated spaces", "padded": "trim whitespace",
        "sentinel_string": "missing-value word -> missing",
    }
    rows += [(a, "text_content", f"sum(hit_{h})") for h, a in names.items()]
    rows.append(("unify platform spelling; missing -> ''Unspecified''", "platform", "count(*) FILTER (no_platform)"))
    rows += [(f"parse timestamp from ''{f}''", "timestamp", f"count(*) FILTER (timestamp_format = '{f}')") for f in ("iso8601", "epoch_seconds", "dayfirst_dmy", "missing", "unparsed")]
    rows += [
        ("flag day-first dates (flag_ambiguous_date_format)", "timestamp", "count(*) FILTER (flag_ambiguous_date_format)"),
        ("timestamps outside declared event window", "timestamp", "count(*) FILTER (\"timestamp\" < TIMESTAMP '1995-06-01' OR \"timestamp\" >= TIMESTAMP '2000-06-01')"),
        ("restore sign-flipped likes with abs()", "likes", "count(*) FILTER (flag_likes_sign_restored)"),
        *[(f"cast {c} -> nullable integer", c, "count(*)") for c in ("likes", "shares", "comments")],
        ("missing engagement left NULL (no imputation)", "likes", "count(*) - count(likes)"),
        ("empty text_content after full repair", "text_content", "count(*) - count(text_content)"),
        ("empty-text rows held out of the analysis table", "text_content", "count(*) - count(text_content)"),
    ]
    return "\n UNION ALL ".join(
        f"""SELECT '{a}' AS action, 'posts' AS "table", '{c}' AS "column", CAST({x} AS BIGINT) AS rows_affected FROM repaired""" for a, c, x in rows
    )


def _sweep():
    t = "text_content"
    marks = {
        "HTML entities left": f"regexp_matches({t}, '&amp;|&lt;|&gt;|&#')", "HTML tags left": f"regexp_matches({t}, '<[a-zA-Z/]')",
        "double-encoding left": f"{t} LIKE '%Ã©%'", "any non-ASCII left": f"regexp_matches({t}, '[^\\x00-\\x7F]')",
        "trailing ''&'' or '',''": f"regexp_matches({t}, '[&,]\\s*$')", "double spaces": f"{t} LIKE '%  %'",
        "sentinel-as-content": f"lower(trim({t})) IN {LOWER_TOKENS}", "negative likes": "likes < 0", "unparsed timestamps": '"timestamp" IS NULL',
    }
    return "\n UNION ALL ".join(f"SELECT '{n}' AS marker, count(*) FILTER ({x}) AS \"rows\" FROM repaired WHERE text_content IS NOT NULL" for n, x in marks.items())


def _profile():
    return "\n UNION ALL ".join(
        f"""SELECT '{c.strip('"')}' AS "column", count(*) FILTER ({strip(c)} = '') AS blank, count(*) FILTER ({strip(c)} = 'NULL') AS null_word,
            count(DISTINCT {c}) AS "unique", count(*) FILTER (NOT regexp_full_match({strip(c)}, '-?\\d+(\\.\\d+)?')) AS non_numeric FROM raw_posts"""
        for c in COLS
    )


def _rules(table, rules):
    return "".join(f"\n UNION ALL SELECT '{n}', count(*) FILTER (NOT coalesce({x}, false)) FROM {table}" for n, x in rules.items())


ORACLE = {
    "C1_C2_deduplicated": sql(POSTS, RAW, body=SINGLE + " SELECT * FROM single"),
    "C3_text_repair": sql(POSTS, RAW, body=SINGLE + repair("single") + f" SELECT post_id, clean AS text_content, {HITS} FROM fixed"),
    "C3_text_repair_documents": "WITH broken AS (SELECT doc_id AS post_id, CASE WHEN doc_id % 3 = 0 THEN '<p>' ELSE ' ' END || text || CASE doc_id % 5 WHEN 0 THEN ' &lt;br&gt;,' WHEN 1 THEN '&quot;  &amp;' ELSE ',,' END AS text_content FROM documents)"
    + repair("broken") + f" SELECT post_id, clean AS text_content, {HITS} FROM fixed",
    "C5_C9_analysis_posts": sql(POSTS, RAW, body=REPAIRED + """
      SELECT post_id, user_id, platform, text_content, "timestamp", likes, shares, comments, timestamp_format, flag_ambiguous_date_format,
             CAST("timestamp" AS DATE) AS post_date, strftime("timestamp", '%Y-%m') AS post_month, hour("timestamp") AS post_hour,
             dayname("timestamp") AS weekday, isodow("timestamp") > 5 AS is_weekend, flag_likes_sign_restored
      FROM repaired WHERE text_content IS NOT NULL"""),
    "C7_dayfirst_proof": sql(POSTS, RAW, body="""
      SELECT count(*) AS dmy_rows, count(*) FILTER (CAST(left("timestamp", 2) AS INT) > 12) AS first_field_over_12,
             count(*) FILTER (CAST(substr("timestamp", 4, 2) AS INT) > 12) AS second_field_over_12
      FROM raw_posts WHERE regexp_full_match("timestamp", '\\d\\d-\\d\\d-\\d{4}')"""),
    "C10_users": sql(RAW_USERS, body=FIX_USERS + " SELECT * FROM fixed_users"),
    "C11_held_out": sql(POSTS, RAW, body=REPAIRED + """
      SELECT post_id, likes, "timestamp", 'empty_text_content' AS held_out_reason FROM repaired WHERE text_content IS NULL"""),
    "C12_integrity_checks": sql(POSTS, RAW, RAW_USERS, body=REPAIRED + FIX_USERS + """
      SELECT (SELECT count(*) FROM repaired ANTI JOIN fixed_users USING (user_id)) AS orphan_posts, count(*) - count(DISTINCT post_id) AS dup_post_id,
             count(*) FILTER (likes < 0) AS negative_likes_after,
             count(*) FILTER ("timestamp" < TIMESTAMP '1995-06-01' OR "timestamp" >= TIMESTAMP '2000-06-01') AS out_of_window,
             count(*) FILTER ("timestamp" > TIMESTAMP '2100-01-01') AS future_timestamps, count(*) - count(text_content) AS empty_text_after,
             (SELECT count(*) - count(DISTINCT user_id) FROM fixed_users) AS dup_user_id,
             (SELECT count(*) FROM fixed_users ANTI JOIN repaired USING (user_id)) AS users_never_posting FROM repaired"""),
    "C12_user_record_exists": sql(POSTS, RAW, RAW_USERS, body=REPAIRED + FIX_USERS + """
      SELECT user_id IN (SELECT user_id FROM fixed_users WHERE follower_count IS NOT NULL) AS user_record_exists, count(*) AS posts FROM repaired GROUP BY 1"""),
    "C13_repair_log": sql(POSTS, RAW, body=REPAIRED + ", l AS (" + log_rows() + ") SELECT * FROM l WHERE rows_affected > 0"),
    "C14_raw_facts": sql(POSTS, RAW, body=f"""
      , x AS (SELECT *, TRY_CAST(likes AS DOUBLE) AS v, regexp_full_match("timestamp", '\\d\\d-\\d\\d-\\d{{4}}') AS dmy,
                     count(*) OVER (PARTITION BY post_id) AS ids FROM raw_posts)
      SELECT count(*) AS raw_rows, count(*) - count(DISTINCT ({", ".join(COLS)})) AS raw_dup_rows, count(*) FILTER (dmy) AS dayfirst_rows_raw,
             count(*) FILTER (dmy AND TRY_CAST(left("timestamp", 2) AS INT) > 12) AS dayfirst_gt12_first,
             count(*) FILTER (dmy AND TRY_CAST(substr("timestamp", 4, 2) AS INT) > 12) AS dayfirst_gt12_second,
             count(*) FILTER (dmy AND TRY_CAST(left("timestamp", 2) AS INT) <= 12) AS dayfirst_ambiguous,
             count(*) FILTER (v < 0) AS neg_likes_rows, max(-v) FILTER (v < 0) AS neg_max_abs, max(v) FILTER (v > 0) AS pos_max,
             count(*) FILTER (text_content LIKE '%Ã©%') AS mojibake_rows_raw, count(*) FILTER (likes LIKE '%.%') AS float_serialised_likes,
             count(*) FILTER (text_content LIKE '%&amp;%') AS entities_raw, count(*) FILTER (regexp_matches(text_content, '<br>|<div>')) AS tags_raw,
             count(*) FILTER (ids > 1) AS raw_dup_postid_rows, count(DISTINCT post_id) FILTER (ids > 1) AS raw_dup_postid_ids,
             quantile_cont(-v, 0.5) FILTER (v < 0) AS neg_median_abs, quantile_cont(v, 0.5) FILTER (v > 0) AS pos_median FROM x"""),
    "C15_column_profile": sql(POSTS, RAW, body=" " + _profile()),
    "C16_residual_sweep": sql(POSTS, RAW, body=REPAIRED + " " + _sweep()),
    "C17_reconciliation": sql(POSTS, RAW, body=REPAIRED + """
      SELECT (SELECT count(*) FROM raw_posts) AS raw_rows, (SELECT count(*) FROM raw_posts) - count(*) AS replay_rows,
             count(*) - count(text_content) AS held_out_rows, count(text_content) AS analysis_rows, true AS closes FROM repaired"""),
    "C18_residual_missingness": sql(POSTS, RAW, body=REPAIRED + "".join(
        f"""{' UNION ALL ' if i else ' '} SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM repaired"""
        for i, c in enumerate(("text_content", "likes", "platform")))),
    "C19_before_and_after": sql(POSTS, RAW, body=REPAIRED + """
      SELECT DISTINCT post_id, a.text_content AS before, r.text_content AS after, len(a.text_content) - coalesce(len(r.text_content), 0) AS chars_changed
      FROM raw_posts a JOIN repaired r USING (post_id) WHERE a.text_content LIKE '%&amp;%'"""),
    "K1_K6_expectations": sql(POSTS, USERS, TAGS, RAW, TIMED, body=SCAN + DEFECTS + """
      SELECT 'posts: post_id is unique' AS expectation, count(*) - count(DISTINCT post_id) AS violations FROM posts
      UNION ALL SELECT 'users: user_id is unique', count(*) - count(DISTINCT user_id) FROM users
      UNION ALL SELECT 'post_tags: (post_id, tag) is unique', count(*) - count(DISTINCT (post_id, tag)) FROM post_tags
      UNION ALL SELECT 'anomalies: (post_id, anomaly_type) is unique', count(*) - count(DISTINCT (post_id, anomaly_type)) FROM anomalies
      UNION ALL SELECT 'posts: user_id refers to users', count(*) FROM posts ANTI JOIN users USING (user_id)
      UNION ALL SELECT 'post_tags: post_id refers to posts', count(*) FROM post_tags ANTI JOIN posts USING (post_id)"""
      + _rules("posts", {
          "platform is known": "platform IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')",
          **{f"{c} is set": f"{c} IS NOT NULL" for c in ("post_id", "user_id", "posted_at", "post_month")},
          **{f"{c} >= 0 or NULL": f"{c} IS NULL OR {c} >= 0" for c in ("likes", "shares", "comments")},
          "likes_restored is 0 or 1": "likes_restored IN (0, 1)", "some metric is known": "coalesce(likes, shares, comments) IS NOT NULL"})
      + _rules("users", {"follower_count >= 0": "follower_count >= 0"})
      + _rules("anomalies", {"anomaly_type is known": "anomaly_type IN ('NEGATIVE_LIKES', 'MISSING_PLATFORM', 'MISSING_TEXT', 'HTML_ENTITY_OR_TAG')"})
      + _rules("timed", {"hour is 0..23": "post_hour BETWEEN 0 AND 23", "has_time is 0 or 1": "has_time IN (0, 1)"})),
    "K7_claims": sql(POSTS, body="""
      SELECT platform, count(likes)::DOUBLE AS claimed, count(likes)::DOUBLE AS recomputed, true AS agrees FROM posts GROUP BY platform"""),
    "K7_published_claims": sql(POSTS, body="".join([
        """, figures AS (SELECT platform, count(*)::DOUBLE AS n_posts, avg(coalesce(likes, 0) + coalesce(shares, 0) + coalesce(comments, 0)) AS avg_engagement,
        avg(coalesce(likes, 0)) AS avg_likes, sum(coalesce(likes, 0) + coalesce(shares, 0) + coalesce(comments, 0))::DOUBLE AS total_engagement,""",
        """ known FROM (SELECT *, true AS known FROM posts WHERE posted_at < TIMESTAMP '1997-01-01' OR platform <> '2-HIGH'
          UNION ALL SELECT *, false FROM posts) GROUP BY platform, known)""",
        ", pairs AS (" + " UNION ALL ".join(
            f"""SELECT platform, '{n}' AS claim, round(any_value({n}) FILTER (known), {d}) AS claimed, any_value({n}) FILTER (NOT known) AS recomputed,
            {0.5 * 10.0 ** -d:.6f} AS half FROM figures GROUP BY platform""" for n, d in PUBLISHED.items()
        ) + ") SELECT platform, claim, claimed, recomputed, coalesce(abs(claimed - recomputed) <= half + 1e-9, false) AS agrees FROM pairs",
    ])),
}
