"""The adapter's relations once more, as DuckDB CTEs: the oracle builds them on its own."""

POSTS = """
posts AS (
  SELECT o.o_orderkey AS post_id, o.o_custkey AS user_id,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'Unspecified'
              ELSE o.o_orderpriority END AS platform,
         o.o_orderdate AS posted_at, CAST(o.o_orderdate AS DATE) AS post_date,
         strftime(o.o_orderdate, '%Y-%m') AS post_month, dayname(o.o_orderdate) AS weekday,
         isodow(o.o_orderdate) >= 6 AS is_weekend,
         CASE o.o_orderkey % 3 WHEN 0 THEN 'iso8601' WHEN 1 THEN 'epoch_seconds'
              ELSE 'dayfirst_dmy' END AS timestamp_format,
         CASE WHEN o.o_orderkey % 7 <> 0 THEN CAST(floor(o.o_totalprice / 100) AS BIGINT) END AS likes,
         CAST(floor(4 * l.q) AS BIGINT) AS shares, CAST(50 * l.n AS BIGINT) AS comments,
         CAST(o.o_orderkey % 23 = 0 AS BIGINT) AS likes_restored
  FROM orders o LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n
                           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey),
rich AS (
  SELECT *, coalesce(likes, 0) + coalesce(shares, 0) + coalesce(comments, 0) AS eng,
         CASE WHEN coalesce(likes, shares, comments) IS NOT NULL
              THEN coalesce(likes, 0) + coalesce(shares, 0) + coalesce(comments, 0) END AS eng_null,
         CASE WHEN likes > 0 THEN CAST(coalesce(shares, 0) + coalesce(comments, 0) AS DOUBLE) / likes END AS amp
  FROM posts)"""

USERS = """
users AS (
  SELECT c_custkey AS user_id, n_name || ', ' || r_name AS location, n_name AS city, r_name AS country,
         lower(c_mktsegment) AS language, CAST(floor(greatest(c_acctbal, 0.0) * 5) AS BIGINT) AS follower_count,
         DATE '1994-06-01' + CAST(c_custkey % 400 AS INTEGER) AS account_created
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TAGS = """
post_tags AS (
  SELECT DISTINCT l_orderkey AS post_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"""

TIMED = """
timed AS (
  SELECT event_id AS post_id, user_id, event_type AS platform, ts AS posted_at,
         CAST(event_type <> 'error' AS BIGINT) AS has_time,
         CASE WHEN event_type <> 'error' THEN hour(ts) ELSE 0 END AS post_hour,
         CASE WHEN event_type <> 'error' THEN 'iso8601' ELSE 'dayfirst_dmy' END AS timestamp_format
  FROM events)"""

TEXTS = """
texts AS (
  SELECT *, coalesce(likes, 0) + shares + comments AS eng FROM (
    SELECT doc_id AS post_id, doc_id % 97 AS user_id, source AS platform,
           text || ' #' || lang || ' #' || source || CASE WHEN doc_id % 3 = 0 THEN ' #Long_Read #en' ELSE '' END AS text_content,
           DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER) AS post_date,
           strftime(DATE '2024-01-01' + CAST(doc_id % 360 AS INTEGER), '%Y-%m') AS post_month,
           CASE WHEN doc_id % 7 <> 0 THEN n_chars % 5001 END AS likes,
           (n_chars * 7) % 5001 AS shares, (n_chars * 3) % 601 AS comments
    FROM documents))"""

RAW = """
raw_posts AS (
  SELECT 'P' || post_id AS post_id, 'U' || user_id AS user_id,
         CASE platform WHEN '1-URGENT' THEN ' x ' WHEN '2-HIGH' THEN 'insta' WHEN '3-MEDIUM' THEN 'YouTube'
              WHEN '5-LOW' THEN 'fb' ELSE CASE WHEN k % 2 = 0 THEN '' ELSE 'NULL' END END AS platform,
         CASE k % 19
           WHEN 0 THEN CASE WHEN copy = 1 THEN 'null' ELSE '' END
           WHEN 1 THEN 'NULL' WHEN 2 THEN 'NULL' || chr(10) || chr(10) WHEN 3 THEN 'NULL&amp;'
           WHEN 4 THEN body || '&amp;' WHEN 5 THEN '<div>' || body || ',&amp;<br>' WHEN 6 THEN body || 'Ã©'
           WHEN 7 THEN body || ',<br>' WHEN 8 THEN '  ' || body || ' ' WHEN 9 THEN replace(body, ' ', '  ')
           WHEN 10 THEN 'a &lt;br&gt; ' || body WHEN 11 THEN 'NULLÃ©' WHEN 12 THEN '日本 ' || body || ' Ã©'
           ELSE body END AS text_content,
         CASE k % 3 WHEN 0 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN CAST(CAST(epoch(moment) AS BIGINT) AS VARCHAR)
              ELSE strftime(moment, '%d-%m-%Y') END AS "timestamp",
         CASE WHEN likes IS NULL THEN CASE WHEN k % 2 = 0 THEN '' ELSE 'NULL' END
              WHEN k % 11 = 0 THEN '-' || likes || '.0' ELSE CAST(likes AS VARCHAR) END AS likes,
         coalesce(CAST(shares AS VARCHAR), '') AS shares, coalesce(CAST(comments AS VARCHAR), '') AS comments,
         k * 2 + copy + 1 AS row_no
  FROM (SELECT *, post_id AS k, posted_at + to_hours(CAST(post_id % 24 AS INTEGER)) AS moment,
               'Loving it, order ' || post_id || ' can''t wait #Tag' || (post_id % 9) || ' #Deal' AS body,
               unnest(CASE WHEN post_id % 31 = 0 THEN [0, 1] ELSE [0] END) AS copy
        FROM posts))"""

RAW_USERS = """
raw_users AS (
  SELECT 'U' || c_custkey AS user_id,
         n_name || ', ' || CASE r_name WHEN 'EUROPE' THEN 'UK' WHEN 'AMERICA' THEN 'USA' ELSE r_name END AS location,
         CASE WHEN c_custkey % 29 = 0 THEN 'NULL' ELSE ' ' || c_mktsegment END AS language,
         CASE WHEN c_custkey % 37 = 0 THEN 'n/a'
              ELSE strftime(DATE '1994-06-01' + CAST(c_custkey % 400 AS INTEGER), '%Y-%m-%d') END AS account_created,
         CAST(CAST(floor(c_acctbal * 5) AS BIGINT) AS VARCHAR) AS follower_count
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LABELLED = """
labelled AS (
  SELECT doc_id AS text_id, text AS post_text,
         CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment_label,
         lang AS topic_category
  FROM documents JOIN labels USING (doc_id))"""

SCORED = """
scored AS (
  SELECT *, CASE WHEN p_neg = greatest(p_neg, p_neu, p_pos) THEN 'Negative'
                 WHEN p_neu = greatest(p_neg, p_neu, p_pos) THEN 'Neutral' ELSE 'Positive' END AS pred
  FROM (SELECT text_id, post_text, truth, pred_b, CAST(a AS DOUBLE) / (a + b + c) AS p_neg,
               CAST(b AS DOUBLE) / (a + b + c) AS p_neu, CAST(c AS DOUBLE) / (a + b + c) AS p_pos
        FROM (SELECT doc_id AS text_id, text AS post_text,
                     CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS truth,
                     CASE doc_id % 3 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS pred_b,
                     1 + (doc_id * 37 + 11 * n_chars) % 41 AS a, 1 + (doc_id * 53 + 7) % 29 AS b,
                     1 + (doc_id * 11 + n_chars) % 61 AS c
              FROM documents JOIN labels USING (doc_id)))),
classes(label, place) AS (VALUES ('Negative', 0), ('Neutral', 1), ('Positive', 2)),
per_class AS (
  SELECT s.text_id, s.truth, s.pred, c.label,
         CASE c.label WHEN 'Negative' THEN p_neg WHEN 'Neutral' THEN p_neu ELSE p_pos END AS p,
         CAST(s.truth = c.label AS BIGINT) AS y
  FROM scored s CROSS JOIN classes c)"""

EVENT_LOG = """
event_log AS (
  SELECT src || ':' || event_id AS record_id, src AS source, 'user' || user_id AS author,
         CASE WHEN event_id % 5 <> 0 THEN 'Event ' || event_type END AS title,
         CASE WHEN event_id % 4 <> 0 THEN 'value ' || CAST(floor(value) AS BIGINT) ||
              CASE WHEN event_id % 6 = 0 THEN ' हॉकी' ELSE '' END END AS text,
         'https://example.org/e/' || event_id AS url, 'en' AS lang,
         CASE WHEN event_id % 101 <> 0 THEN date_trunc('second', ts) END AS created_at,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_days(CAST(1 + copy AS INTEGER)) AS collected_at,
         k AS reblogs, k * 2 AS favourites, k % 7 AS replies,
         strftime(CAST(ts AS DATE) + CAST(1 + copy AS INTEGER), '%Y%m%d') AS sweep_id, 'live' AS sweep_mode,
         CASE WHEN user_id % 5 = 0 THEN 'global' ELSE 'india' END AS scope,
         (event_id * 37) % 1000 / 1000.0::DOUBLE AS p_pos, (event_id * 53) % 500 / 1000.0::DOUBLE AS p_neg
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CASE event_type WHEN 'view' THEN 'mastodon' WHEN 'click' THEN 'gnews' WHEN 'purchase' THEN 'bing'
                    WHEN 'signup' THEN 'feed_ht_sports' ELSE 'hn' END AS src,
               unnest(CASE WHEN event_id % 13 = 0 THEN [0, 1] ELSE [0] END) AS copy
        FROM events)),
corpus AS (
  SELECT *, ts_ist, date_trunc('hour', ts_ist) AS hour_ist, CAST(ts_ist AS DATE) AS date_ist,
         CASE WHEN source = 'mastodon' THEN 'social' WHEN source IN ('gnews', 'bing') THEN 'news'
              WHEN source = 'feed_ht_sports' THEN 'publisher' ELSE 'other' END AS kind,
         trim(coalesce(title, '') || '. ' || coalesce(text, ''), '. ') AS text_full,
         CASE WHEN ts_ist >= TIMESTAMP '2024-01-15' THEN 'live' ELSE 'retro' END AS arc
  FROM (SELECT *, created_at + INTERVAL 330 MINUTE AS ts_ist FROM event_log
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY collected_at, sweep_id) = 1))"""


def sql(*relations: str, body: str) -> str:
    """``WITH`` the relations named, then the body (which may go on with further CTEs)."""
    return "WITH " + ",".join(relations) + body
