"""Registered queries over sources, live monitoring and streaming, each with its SQL."""

import uuid

from pyspark.sql import functions as F

from chirrup.plans import eda, live
from chirrup.session import shared_folder
from chirrup.sources import files, payloads
from chirrup.streaming import sweeps
from registry.core import on
from registry.eda import LEXICON
from registry.eda import ORACLE as EDA_SQL
from registry.intake import WS
from registry.relations_sql import EVENT_LOG, LABELLED, POSTS, RAW, TEXTS, USERS, sql

WINDOW = {"start": "2024-01-03 00:00:00", "end": "2024-01-28 20:30:00", "split": "2024-01-15 00:00:00"}
CONTRASTS = [
    live.Contrast("day 5", "2024-01-05 00:00:00", "2024-01-05 10:30:00", "2024-01-05 13:30:00", "2024-01-05 23:54:00"),
    live.Contrast("day 10", "2024-01-08 00:00:00", "2024-01-10 10:30:00", "2024-01-10 10:30:00", "2024-01-20 00:00:00"),
    live.Contrast("nobody", "2023-01-08 00:00:00", "2023-01-10 10:30:00", "2024-01-10 10:30:00", "2024-01-20 00:00:00"),
]
SWEEP_DAYS = ("20240111", "20240121")
TRIGGERS = live.around_triggers([("t1", "2024-01-07 12:00:00"), ("t2", "2024-01-21 06:00:00")], before="36h", after="48h")
ENTITIES = {"clicks": "click", "views or purchases": "view|purchase", "Hockey": "hockey|हॉकी", "value of one": r"value 1\b", "never": "zzz+"}


def scratch(spark, name):
    return f"{shared_folder(spark)}/chirrup-{name}-{uuid.uuid4().hex}"


def _log(s):
    return s.event_log.drop("prob_sentiment_Positive", "prob_sentiment_Negative").withColumn("arc", F.lit(None).cast("string"))


def _corpus(s):
    return live.corpus(s.event_log, split=WINDOW["split"])


def _landed(s):
    folder = scratch(s.spark, "landing")
    files.append_events(_log(s), folder)
    return folder


def _round_trip(s):
    return files.read_events(s.spark, _landed(s)).select(
        "record_id", "sweep_id", "created_at", F.col("engagement")["reblogs"].alias("reblogs")
    )


def _split_tables(s):
    folder = scratch(s.spark, "bundle")
    return files.bundle({"posts": s.posts, "users": s.users, "tags": s.post_tags}, folder)


def _feature_tables(s):
    """Folder with both feature tables written out."""
    folder = scratch(s.spark, "features")
    files.write_features(eda.post_features(s.text_posts, LEXICON), eda.user_features(s.posts, s.users), folder)
    return folder


def _features_written(s):
    posts = s.spark.read.parquet(f"{_feature_tables(s)}/posts_with_features")
    return posts.groupBy("post_month").agg(F.count(F.lit(1)).alias("posts"), F.sum("likes").alias("likes"))


def _written_posts(s):
    posts = s.spark.read.parquet(f"{_feature_tables(s)}/posts_with_features")
    return posts.select("post_id", "engagement", "hashtags", "sentiment", "sentiment_label")


def _written_users(s):
    return s.spark.read.parquet(f"{_feature_tables(s)}/user_features")


def _raw_csv(s):
    """The raw strings written as CSV and read back untouched, with their file position."""
    folder = scratch(s.spark, "raw")
    s.raw_posts.select(*files.RAW_POSTS).write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    rows = files.with_row_no(files.read_raw_posts(s.spark, folder))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.max("row_no").alias("last_row_no"), F.count_distinct("row_no").alias("row_nos"),
        F.count_if(F.col("text_content") == "").alias("blank_texts"), F.count_if(F.col("text_content") == "NULL\n\n").alias("broken_words"),
        F.sum(F.length("text_content")).alias("characters"),
    )


def _manual(s):
    k = F.col("event_id")
    reactions = s.table("events").select(
        F.when(k % 10 == 0, F.concat(F.lit("ag_"), k.cast("string"))).otherwise(
            F.shiftleft(F.unix_millis(F.col("ts").cast("timestamp")) + (k % 7) * 60000 - 1288834974657, 22).cast("string")
        ).alias("post_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("event_type").alias("statement"), k.cast("string").alias("likes"), F.lit("1").alias("reposts"),
        F.lit("x").alias("replies"), F.lit("3").alias("views"), F.lit("https://x.com/p").alias("post_url"),
    )
    return live.authentic(files.manual_reactions(reactions, scope="global"))


def _timeline(s):
    status = F.struct(
        F.col("event_id").cast("string").alias("id"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("acct")).alias("account"),
        F.concat(F.lit("<p>"), F.col("event_type"), F.lit("<br/>done</p>")).alias("content"), F.lit("en").alias("language"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), (F.col("event_id") % 9).alias("reblogs_count"),
    )
    return payloads.timeline(s.table("events").select(F.to_json(F.array(status)).alias("payload")))


def _stories(s):
    hit = F.struct(
        F.when(F.col("event_id") % 8 != 0, F.col("event_id").cast("string")).alias("objectID"), F.col("event_type").alias("title"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise("https://e.org/x").alias("url"), F.lit("<i>a</i> b").alias("comment_text"),
        F.unix_timestamp("ts").alias("created_at_i"), (F.col("event_id") % 4).alias("points"),
    )
    return payloads.stories(s.table("events").select(F.to_json(F.struct(F.array(hit).alias("hits"))).alias("payload")))


def _articles(s):
    art = F.struct(F.col("url"), F.concat(F.lit("<b>Page</b> "), F.col("page_id").cast("string")).alias("title"), F.lit("e.org").alias("domain"), F.lit("20260920T103000Z").alias("seendate"))
    return payloads.articles(s.pages.select(F.to_json(F.struct(F.array(art).alias("articles"))).alias("payload")))


def _dated_articles(s):
    """Stamps of every minute, and missing, worded and impossible ones."""
    part = lambda n, shift: F.lpad((F.col("page_id") % n + shift).cast("string"), 2, "0")
    stamp = F.concat(F.lit("2026"), part(12, 1), part(28, 1), F.lit("T"), part(24, 0), part(60, 0), F.lit("00Z"))
    stamp = F.when(F.col("page_id") % 7 == 0, "some day").when(F.col("page_id") % 13 == 0, "20261301T990000Z").when(F.col("page_id") % 11 != 0, stamp)
    art = F.struct(F.col("url"), F.col("page_id").cast("string").alias("title"), F.lit("e.org").alias("domain"), stamp.alias("seendate"))
    rows = payloads.articles(s.pages.select(F.to_json(F.struct(F.array(art).alias("articles"))).alias("payload")))
    return rows.select("record_id", "title", "created_at")


def _items(s):
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    topic = F.when(F.col("page_id") % 2 == 0, "India women win the TROPHY").otherwise("weather")
    number = lambda n: (F.col("page_id") % n).cast("string")
    stamp = F.concat(F.lit("Mon, "), (F.col("page_id") % 28 + 1).cast("string"), F.lit(" Sep 2026 "), F.lpad(number(24), 2, "0"), F.lit(":30:00 GMT"))
    stamp = F.when(F.col("page_id") % 7 == 0, "some day in September").otherwise(stamp)
    return s.pages.select(
        F.concat(F.lit("feed"), (F.col("page_id") % 3).cast("string")).alias("feed"), F.col("page_id").alias("position"),
        F.concat(
            F.lit("<item><guid>"), url, F.lit("</guid><link>"), url, F.lit("</link><title>"), topic,
            F.lit("</title><description>&lt;b&gt;day&lt;/b&gt; "), F.col("page_id").cast("string"),
            F.lit("</description><pubDate>"), stamp, F.lit("</pubDate><source>The Paper</source></item>"),
        ).alias("item"),
    )


SHORT = ("record_id", "source", "author", "title", "text", "url", "created_at")


def _embeds(s):
    block = F.concat(
        F.lit('<div class="tweet" data-tweet-id="'), F.col("event_id").cast("string"), F.lit('" data-screen-name="a'), F.col("user_id").cast("string"),
        F.lit('" data-created-at="'), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit('"><div><div><p class="tweet-text" x>one<br/>two &amp; '),
        F.col("event_type"), F.lit("</p></div> </div> </div>"),
    )
    pages = s.table("events").select(F.lit("acct").alias("account"), F.concat(F.lit("<html>"), block, block, F.lit("</html>")).alias("html"))
    return payloads.embeds(pages).select(*SHORT)


def _stream_log(s):
    """W1-W3: landed files to a deduplicated, windowed, arc-tagged log."""
    out, mark = scratch(s.spark, "log"), scratch(s.spark, "mark")
    stream = sweeps.deduplicated(sweeps.read_landing(s.spark, _landed(s)))
    sweeps.write_log(live.tagged(stream.drop("arc"), **WINDOW), out, mark).awaitTermination()
    return s.spark.read.parquet(out).select("record_id", "source", "created_at", "arc")


def _stream_counts(s):
    out, mark = scratch(s.spark, "counts"), scratch(s.spark, "mark")
    stream = sweeps.deduplicated(sweeps.read_landing(s.spark, _landed(s)))
    sweeps.write_counts(sweeps.hourly_counts(stream), out, mark).awaitTermination()
    return sweeps.current_counts(s.spark, out)


def _stream_monitor(s):
    out, mark = scratch(s.spark, "monitor"), scratch(s.spark, "mark")
    stream = sweeps.deduplicated(sweeps.read_landing(s.spark, _landed(s)))
    sweeps.monitor(stream, out, mark, z=1.5).awaitTermination()
    last = s.spark.read.parquet(f"{out}/sweeps").agg(F.max("batch")).scalar()
    return s.spark.read.parquet(f"{out}/spikes").where(F.col("sweep") == last).drop("sweep")


def _stream_sweeps(s):
    out, mark = scratch(s.spark, "monitor"), scratch(s.spark, "mark")
    stream = sweeps.deduplicated(sweeps.read_landing(s.spark, _landed(s)))
    sweeps.monitor(stream, out, mark).awaitTermination()
    return s.spark.read.parquet(f"{out}/sweeps").agg(F.sum("new_records").alias("new_records"))


def _sweep_rows(s):
    """Three sweeps land one after another, by days of collection; a row of new records for each."""
    landing, out, mark = (scratch(s.spark, n) for n in ("landing", "monitor", "mark"))
    log, edges = _log(s), ("", *SWEEP_DAYS, "z")
    for low, high in zip(edges, edges[1:]):
        files.append_events(log.where((F.col("sweep_id") >= low) & (F.col("sweep_id") < high)), landing)
        sweeps.monitor(sweeps.deduplicated(sweeps.read_landing(s.spark, landing)), out, mark).awaitTermination()
    return s.spark.read.parquet(f"{out}/sweeps").select("batch", "new_records")


def _outcomes(s):
    """Every fetch that brought records, and as many that a site refused or that broke off."""
    records, good = files.first_per_record(s.event_log), live.fetch_outcomes(s.event_log)
    code = F.when(F.substring("sweep_id", -1, 1).cast("int") % 2 == 0, "429").otherwise("timeout")
    failed = good.withColumns({"http": code, "records": F.lit(0).cast("long")})
    return live.outcome_table(live.sweep_summary(records, good.unionByName(failed)))


def _labelled_csv(s):
    """S3: labelled text as CSV with white space around its cells, read back stripped."""
    folder = scratch(s.spark, "labelled")
    padded = [F.concat(F.lit("  "), F.col(c).cast("string"), F.lit("\t")).alias(c) for c in files.LABELLED]
    files.write_strings(s.labelled_text.select(*padded), folder)
    rows = files.read_labelled(s.spark, folder)
    return rows.select(F.col("text_id").cast("long").alias("text_id"), "sentiment_label", "topic_category", F.md5("post_text").alias("text_md5"))


def _split_parts(s):
    """S4: a split written by part; only the part asked for is read."""
    folder = scratch(s.spark, "split")
    part = F.when(F.col("text_id") % 5 == 0, "test").otherwise("train")
    files.write_split(s.labelled_text.withColumn("split", part), folder)
    test = files.read_split(s.spark, folder, "test")
    return test.select("text_id", "sentiment_label", "topic_category", "split")


def _intake_files(s):
    """S8: what the intake leaves, read back from its files: analysis rows by month, and held-out bodies."""
    from chirrup.operators import intake

    folder = scratch(s.spark, "intake")
    files.write_intake(intake.repair_posts(s.raw_posts), s.users, folder)
    spark = s.spark
    posts = spark.read.parquet(f"{folder}/posts").groupBy(F.col("post_month").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    as_json = spark.read.json(f"{folder}/posts_json").agg(F.lit("json").alias("part"), F.count(F.lit(1)).alias("rows"))
    users = spark.read.parquet(f"{folder}/users").agg(F.lit("users").alias("part"), F.count(F.lit(1)).alias("rows"))
    held = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/held_out")
    held = held.agg(F.lit("held out").alias("part"), F.count(F.lit(1)).alias("rows"))
    return posts.unionByName(as_json).unionByName(users).unionByName(held)


def _source_registry(s):
    """S12: a registry of sources as CSV; a count that is no number is unknown."""
    folder = scratch(s.spark, "registry")
    k = F.col("page_id")
    known = F.when(k % 4 == 0, "many").otherwise(k.cast("string"))
    columns = {
        "platform": F.lit("web"), "source_id": k.cast("string"), "source_url": F.col("url"), "source_title_or_caption": F.lit('a "quoted" title,\nin two lines'),
        "author_or_channel": F.lit(" spaced "), "sport": F.lit("hockey"), "event_name": F.lit("final"), "source_timestamp": F.lit("2026-09-20"), "records_collected": known,
    }
    files.write_strings(s.pages.select(*[c.alias(n) for n, c in columns.items()]), folder)
    return files.read_source_registry(s.spark, folder)


def _sweep_log(s):
    records = files.first_per_record(s.event_log)
    log = live.sweep_summary(records, live.fetch_outcomes(s.event_log))
    return log.select("sweep_id", "mode", "at", "new_records", F.size("outcomes").cast("long").alias("fetches"))


def _equal(s):
    return live.equal_slices(_corpus(s), "scope", "record_id").groupBy("scope").agg(F.count(F.lit(1)).alias("records"))


def _new(s):
    log = s.event_log
    return live.new_records(log.where("sweep_id > '20240115'"), log.where("sweep_id <= '20240115'")).select("record_id", "sweep_id")


QUERIES = {
    "S1_S2_raw_strings": on(_raw_csv),
    "S5_S6_event_log": on(_round_trip),
    "S7_flat_export": on(lambda s: files.flat_export(_log(s)).drop("arc")),
    "S9_bundle": on(_split_tables),
    "S10_analysis_posts": on(lambda s: files.analysis_posts(_repaired(s)).select("post_id", "posted_at", "has_time", "likes_restored", "date_flagged", "is_weekend")),
    "S11_L16_manual_reactions": on(lambda s: _manual(s).select("record_id", "author", "text", "created_at", F.col("engagement")["likes"].alias("likes"), F.col("engagement")["replies"].alias("replies"))),
    "S14_timeline": on(lambda s: _timeline(s).select(*SHORT, F.col("engagement")["reblogs"].alias("reblogs"))),
    "S14_stories": on(lambda s: _stories(s).select(*SHORT, F.col("engagement")["points"].alias("points"))),
    "S14_articles": on(lambda s: _articles(s).select(*SHORT)),
    "S14_dated_articles": on(_dated_articles),
    "S15_feed": on(lambda s: payloads.feed_records(_items(s), source="gnews", key="guid").select(*SHORT)),
    "S16_topic_feed": on(lambda s: payloads.feed_records(_items(s), source="feed", keywords=payloads.TOPIC_KEYWORDS).select(*SHORT)),
    "S17_embeds": on(_embeds),
    "S18_url_keys": on(lambda s: s.pages.select("page_id", payloads.url_key(F.col("url")).alias("key"))),
    "A20_written_features": on(_features_written),
    "A20_written_post_features": on(_written_posts),
    "A20_written_user_features": on(_written_users),
    "L1_new_records": on(_new),
    "L2_L3_window_and_arc": on(lambda s: live.tagged(files.first_per_record(s.event_log), **WINDOW).select("record_id", "arc")),
    "L4_scope": on(lambda s: live.with_scope(s.event_log, "global").groupBy("source", "scope").agg(F.count(F.lit(1)).alias("records"))),
    "L5_sweep_log": on(_sweep_log),
    "L6_outcomes": on(_outcomes),
    "L7_corpus": on(lambda s: _corpus(s).select("record_id", "text_full", "ts_local", "hour_local", "date_local", "kind", "is_hindi", "arc")),
    "L9_breakdown": on(lambda s: live.breakdown(_corpus(s))),
    "L9_corpus_facts": on(lambda s: live.corpus_facts(_corpus(s))),
    "L9_top_events": on(lambda s: live.top_events(_corpus(s), source="mastodon", column="author")),
    "L9_scope_by_arc": on(lambda s: live.scope_by_arc(_corpus(s))),
    "L10_hourly_volume": on(lambda s: live.hourly_volume(_corpus(s), ["kind"])),
    "L11_spikes": on(lambda s: live.spikes(live.hourly_volume(_corpus(s)), z=1.5)),
    "L11_volume_level": on(lambda s: live.volume_level(live.hourly_volume(_corpus(s)))),
    "L12_hourly_sentiment": on(lambda s: live.hourly_sentiment(_corpus(s))),
    "L12_kind_sentiment": on(lambda s: live.kind_sentiment(_corpus(s))),
    "L13_shift_tests": on(lambda s: live.shift_tests(_corpus(s).where("kind = 'social'"), CONTRASTS).drop("mannwhitney_p")),
    "L14_entity_counts": on(lambda s: live.entity_counts(_corpus(s), ENTITIES)),
    "L14_entity_days": on(lambda s: live.entity_days(_corpus(s), ENTITIES)),
    "L15_daily_arcs": on(lambda s: live.daily_arcs(_corpus(s))),
    "L17_equal_slices": on(_equal),
    "L13_shift_p_values": on(lambda s: live.shift_tests(_corpus(s).where("kind = 'social'"), CONTRASTS).select("contrast", "mannwhitney_p")),
    "L18_trigger_p_values": on(lambda s: live.shift_tests(_corpus(s), TRIGGERS).select("contrast", "mannwhitney_p")),
    "L18_trigger_contrasts": on(lambda s: live.shift_tests(_corpus(s), TRIGGERS).drop("mannwhitney_p")),
    "W1_W3_stream_log": on(_stream_log),
    "W4_stream_hourly_counts": on(_stream_counts),
    "S3_labelled_csv": on(_labelled_csv),
    "S4_split_parts": on(_split_parts),
    "S8_intake_files": on(_intake_files),
    "S12_source_registry": on(_source_registry),
    "W5_stream_spikes": on(_stream_monitor),
    "W7_stream_sweep_log": on(_stream_sweeps),
    "W7_sweep_rows": on(_sweep_rows),
}


def _repaired(s):
    from chirrup.operators.intake import repair_posts

    return repair_posts(s.raw_posts).analysis


# ------------------------------------------------------------------------------ SQL
KEY = """left(sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})), 12) || '5' || substr(sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})), 14, 3)"""
HOURLY = ", h AS (SELECT hour_ist AS hour_local, count(*) AS n FROM corpus WHERE hour_ist IS NOT NULL GROUP BY 1)"
SPIKES = HOURLY + """, z AS (SELECT *, (n - avg(n) OVER ()) / nullif(stddev_samp(n) OVER (), 0) AS z FROM h)
  SELECT hour_local, n AS "count", round(z, 2) AS z FROM z WHERE z >= 1.5"""


def _shift(rows, contrasts):
    arms = " UNION ALL ".join(
        f"""SELECT '{c.label}' AS contrast, ts_ist < TIMESTAMP '{c.pre_end}' AND ts_ist >= TIMESTAMP '{c.pre_start}' AS pre, p_pos AS v FROM {rows}
        WHERE (ts_ist >= TIMESTAMP '{c.pre_start}' AND ts_ist < TIMESTAMP '{c.pre_end}') OR (ts_ist >= TIMESTAMP '{c.post_start}' AND ts_ist < TIMESTAMP '{c.post_end}')"""
        for c in contrasts
    )
    return f""", src AS (SELECT * FROM corpus), soc AS (SELECT * FROM corpus WHERE kind = 'social'), a AS ({arms}),
      r AS (SELECT *, rank() OVER (PARTITION BY contrast ORDER BY v) + (count(*) OVER (PARTITION BY contrast, v) - 1) / 2.0::DOUBLE AS rk FROM a)
      SELECT contrast, count(*) FILTER (pre) AS n_pre, count(*) FILTER (NOT pre) AS n_post, round(avg(v) FILTER (pre), 3) AS mean_pre, round(avg(v) FILTER (NOT pre), 3) AS mean_post,
             round(avg(v) FILTER (NOT pre) - avg(v) FILTER (pre), 3) AS delta, sum(rk) FILTER (pre) - count(*) FILTER (pre) * (count(*) FILTER (pre) + 1) / 2.0::DOUBLE AS u
      FROM r GROUP BY contrast HAVING count(*) FILTER (pre) >= 5 AND count(*) FILTER (NOT pre) >= 5"""


def _shift_p(rows, contrasts):
    """Two-sided normal form with tie and continuity terms; the integral of the density by Simpson's rule."""
    ranked = _shift(rows, contrasts)
    return ranked[: ranked.index("SELECT contrast, count(*)")].rstrip() + """,
      g AS (SELECT *, count(*) OVER (PARTITION BY contrast, v) AS t FROM r),
      m AS (SELECT contrast, count(*) FILTER (pre)::DOUBLE AS a, count(*) FILTER (NOT pre)::DOUBLE AS b, sum(t * t - 1.0::DOUBLE) AS ties,
                   sum(rk) FILTER (pre) - count(*) FILTER (pre) * (count(*) FILTER (pre) + 1) / 2.0::DOUBLE AS u FROM g GROUP BY contrast),
      n AS (SELECT *, sqrt(a * b / 12 * ((a + b + 1) - ties / ((a + b) * (a + b - 1)))) AS spread FROM m WHERE a >= 5 AND b >= 5),
      z AS (SELECT contrast, CASE WHEN spread = 0 THEN 0.0::DOUBLE ELSE least(greatest((greatest(u, a * b - u) - a * b / 2 - 0.5) / spread, 0), 10) END AS z FROM n)
      SELECT contrast, round(abs(1 - 2 * z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 2000) * (z * i / 2000) / 2)))), 4) AS mannwhitney_p
      FROM z"""


HITS = ", hits AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(text, '')) AS low FROM corpus), m AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS entity, date_ist FROM hits WHERE regexp_matches(low, '{p}')" for n, p in ENTITIES.items()
) + ")"
FEED_URL = "url"

STAMP = "CASE WHEN page_id % 7 <> 0 THEN make_timestamp(2026, 9, page_id % 28 + 1, page_id % 24, 30, 0) END"

ORACLE = {
    "S1_S2_raw_strings": sql(POSTS, RAW, body="""
      SELECT count(*) AS "rows", count(*) AS last_row_no, count(*) AS row_nos, count(*) FILTER (text_content = '') AS blank_texts,
             count(*) FILTER (text_content = 'NULL' || chr(10) || chr(10)) AS broken_words, CAST(sum(len(text_content)) AS BIGINT) AS characters FROM raw_posts"""),
    "S5_S6_event_log": sql(EVENT_LOG, body=" SELECT record_id, sweep_id, created_at, reblogs FROM event_log"),
    "S7_flat_export": sql(EVENT_LOG, body="""
      SELECT record_id, source, author, title, text, url, lang, created_at, collected_at, scope, reblogs AS engagement_reblogs, favourites AS engagement_favourites,
             replies AS engagement_replies, CAST(NULL AS BIGINT) AS engagement_points, CAST(NULL AS BIGINT) AS engagement_comments, sweep_id, sweep_mode FROM corpus"""),
    "S9_bundle": """SELECT 'posts' AS "table", count(*) AS "rows" FROM orders UNION ALL SELECT 'users', count(*) FROM customer
      UNION ALL SELECT 'tags', count(*) FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "S11_L16_manual_reactions": """
      SELECT 'x_manual:' || (((epoch_us(ts) // 1000 + (event_id % 7) * 60000 - 1288834974657)::HUGEINT * 4194304)::BIGINT) AS record_id, 'u' || user_id AS author, event_type AS text,
             date_trunc('second', ts) AS created_at, event_id AS likes, CAST(NULL AS BIGINT) AS replies
      FROM events WHERE event_id % 10 <> 0 AND epoch_us(ts) // 1000 + (event_id % 7) * 60000 - epoch_ms(date_trunc('second', ts)) <= 300000""",
    "S14_timeline": """SELECT 'mastodon:' || event_id AS record_id, 'mastodon' AS source, 'u' || user_id AS author, CAST(NULL AS VARCHAR) AS title, event_type || ' done' AS text,
      CAST(NULL AS VARCHAR) AS url, date_trunc('second', ts) AS created_at, event_id % 9 AS reblogs FROM events""",
    "S14_stories": """SELECT 'hn:' || event_id AS record_id, 'hn' AS source, CAST(NULL AS VARCHAR) AS author, event_type AS title, 'a b' AS text,
      CASE WHEN event_id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || event_id ELSE 'https://e.org/x' END AS url, date_trunc('second', ts) AS created_at, event_id % 4 AS points
      FROM events WHERE event_id % 8 <> 0""",
    "S14_articles": f"""SELECT 'gdelt:' || {KEY.format("url")} AS record_id, 'gdelt' AS source, 'e.org' AS author, 'Page ' || page_id AS title, CAST(NULL AS VARCHAR) AS text, url,
      TIMESTAMP '2026-09-20 10:30:00' AS created_at FROM pages""",
    "S14_dated_articles": f"""SELECT 'gdelt:' || {KEY.format("url")} AS record_id, page_id::VARCHAR AS title,
      CASE WHEN page_id % 7 = 0 OR page_id % 13 = 0 OR page_id % 11 = 0 THEN NULL
           ELSE make_timestamp(2026, page_id % 12 + 1, page_id % 28 + 1, page_id % 24, page_id % 60, 0) END AS created_at FROM pages""",
    "S15_feed": f"""SELECT 'gnews:' || {KEY.format("url")} AS record_id, 'gnews' AS source, 'The Paper' AS author, CASE WHEN page_id % 2 = 0 THEN 'India women win the TROPHY' ELSE 'weather' END AS title,
      'day ' || page_id AS text, url, {STAMP} AS created_at FROM pages""",
    "S16_topic_feed": f"""SELECT 'feed_feed' || page_id % 3 || ':' || {KEY.format("url")} AS record_id, 'feed_feed' || page_id % 3 AS source, 'feed' || page_id % 3 AS author, 'India women win the TROPHY' AS title,
      'day ' || page_id AS text, url, {STAMP} AS created_at FROM pages WHERE page_id % 2 = 0""",
    "S17_embeds": """SELECT 'xsynd:' || event_id AS record_id, 'xsynd' AS source, 'a' || user_id AS author, CAST(NULL AS VARCHAR) AS title, 'one two & ' || event_type AS text,
      'https://x.com/acct/status/' || event_id AS url, date_trunc('second', ts) AS created_at FROM events, range(2)""",
    "S18_url_keys": f"SELECT page_id, {KEY.format('url')} AS key FROM pages",
    "A20_written_post_features": EDA_SQL["A20_post_features"],
    "A20_written_user_features": EDA_SQL["A12_user_features"],
    "A20_written_features": sql(TEXTS, body=" SELECT post_month, count(*) AS posts, CAST(sum(likes) AS BIGINT) AS likes FROM texts GROUP BY 1"),
    "L1_new_records": sql(EVENT_LOG, body="""
      SELECT record_id, min(sweep_id) AS sweep_id FROM event_log GROUP BY 1 HAVING min(sweep_id) > '20240115'"""),
    "L2_L3_window_and_arc": sql(EVENT_LOG, body="""
      SELECT record_id, CASE WHEN ts_ist >= TIMESTAMP '2024-01-15' THEN 'live' ELSE 'retro' END AS arc FROM corpus
      WHERE ts_ist >= TIMESTAMP '2024-01-03 00:00:00' AND ts_ist <= TIMESTAMP '2024-01-28 20:30:00'"""),
    "L4_scope": sql(EVENT_LOG, body=" SELECT source, 'global' AS scope, count(*) AS records FROM event_log GROUP BY 1"),
    "L5_sweep_log": sql(EVENT_LOG, body="""
      SELECT sweep_id, any_value(r.mode) AS mode, any_value(r.at_) AS at, any_value(r.n) AS new_records, count(DISTINCT source) AS fetches
      FROM event_log LEFT JOIN (SELECT sweep_id, any_value(sweep_mode) AS mode, max(collected_at) AS at_, count(*) AS n FROM corpus GROUP BY 1) r USING (sweep_id) GROUP BY sweep_id"""),
    "L6_outcomes": sql(EVENT_LOG, body="""
      SELECT source, count(DISTINCT sweep_id) AS http_200, count(DISTINCT sweep_id) FILTER (right(sweep_id, 1)::INT % 2 = 0) AS http_429,
        count(DISTINCT sweep_id) FILTER (right(sweep_id, 1)::INT % 2 = 1) AS other FROM event_log GROUP BY 1"""),
    "L7_corpus": sql(EVENT_LOG, body="""
      SELECT record_id, text_full, ts_ist AS ts_local, hour_ist AS hour_local, date_ist AS date_local, kind, text_full LIKE '%हॉकी%' AS is_hindi,
             CASE WHEN ts_ist IS NOT NULL THEN arc END AS arc FROM corpus"""),
    "L9_breakdown": sql(EVENT_LOG, body="""
      , d AS (SELECT unnest([{'k': 'source', 'v': source}, {'k': 'arc', 'v': CASE WHEN ts_ist IS NOT NULL THEN arc END}, {'k': 'kind', 'v': kind}, {'k': 'scope', 'v': scope}]) AS x FROM corpus)
      SELECT x.k AS dimension, x.v AS "value", count(*) AS records FROM d WHERE x.v IS NOT NULL GROUP BY ALL"""),
    "L9_corpus_facts": sql(EVENT_LOG, body="""
      SELECT count(*) AS n_records, count(*) FILTER (text_full LIKE '%हॉकी%') AS n_hindi, min(date_ist) AS first_day, max(date_ist) AS last_day FROM corpus"""),
    "L9_top_events": sql(EVENT_LOG, body=" SELECT author, count(*) AS records FROM corpus WHERE source = 'mastodon' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"),
    "L9_scope_by_arc": sql(EVENT_LOG, body="""
      SELECT scope, count(*) FILTER (ts_ist < TIMESTAMP '2024-01-15') AS retro, count(*) FILTER (ts_ist >= TIMESTAMP '2024-01-15') AS live FROM corpus GROUP BY 1"""),
    "L10_hourly_volume": sql(EVENT_LOG, body=" SELECT hour_ist AS hour_local, kind, count(*) AS n FROM corpus WHERE hour_ist IS NOT NULL GROUP BY ALL"),
    "L11_spikes": sql(EVENT_LOG, body=SPIKES),
    "L11_volume_level": sql(EVENT_LOG, body=HOURLY + " SELECT avg(n) AS mean, stddev_samp(n) AS sd FROM h"),
    "L12_hourly_sentiment": sql(EVENT_LOG, body="""
      SELECT kind, hour_ist AS hour_local, avg(p_pos) AS mean_positive, avg(p_neg) AS mean_negative FROM corpus WHERE hour_ist IS NOT NULL GROUP BY ALL"""),
    "L12_kind_sentiment": sql(EVENT_LOG, body="""
      SELECT kind, count(*) AS records, round(avg(p_pos), 3) AS mean_positive, round(avg(p_neg), 3) AS mean_negative FROM corpus GROUP BY 1"""),
    "L13_shift_p_values": sql(EVENT_LOG, body=_shift_p("soc", CONTRASTS)),
    "L18_trigger_p_values": sql(EVENT_LOG, body=_shift_p("src", TRIGGERS)),
    "L13_shift_tests": sql(EVENT_LOG, body=_shift("soc", CONTRASTS)),
    "L14_entity_counts": sql(EVENT_LOG, body=HITS + f" SELECT e AS entity, count(entity) AS mentions FROM (SELECT unnest({list(ENTITIES)}) AS e) LEFT JOIN m ON entity = e GROUP BY 1"),
    "L14_entity_days": sql(EVENT_LOG, body=HITS + " SELECT entity, date_ist AS date_local, count(*) AS mentions FROM m GROUP BY ALL"),
    "L15_daily_arcs": sql(EVENT_LOG, body="""
      SELECT date_ist AS date_local, count(*) FILTER (arc = 'retro') AS retro, count(*) FILTER (arc = 'live') AS live FROM corpus WHERE date_ist IS NOT NULL GROUP BY 1"""),
    "L17_equal_slices": sql(EVENT_LOG, body="""
      , c AS (SELECT scope, count(*) AS n FROM corpus GROUP BY 1) SELECT scope, (SELECT min(n) FROM c) AS records FROM c"""),
    "L18_trigger_contrasts": sql(EVENT_LOG, body=_shift("src", TRIGGERS)),
    "W1_W3_stream_log": sql(EVENT_LOG, body="""
      SELECT record_id, source, created_at, CASE WHEN ts_ist >= TIMESTAMP '2024-01-15' THEN 'live' ELSE 'retro' END AS arc FROM corpus
      WHERE ts_ist >= TIMESTAMP '2024-01-03 00:00:00' AND ts_ist <= TIMESTAMP '2024-01-28 20:30:00'"""),
    "W4_stream_hourly_counts": sql(EVENT_LOG, body=" SELECT date_trunc('hour', created_at) AS hour, kind, count(*) AS n FROM corpus WHERE created_at IS NOT NULL GROUP BY ALL"),
    "S3_labelled_csv": sql(LABELLED, body=f"""
      SELECT text_id, sentiment_label, topic_category, md5(regexp_replace(post_text, '^[{WS}]+|[{WS}]+$', '', 'g')) AS text_md5 FROM labelled"""),
    "S4_split_parts": sql(LABELLED, body=" SELECT text_id, sentiment_label, topic_category, 'test' AS split FROM labelled WHERE text_id % 5 = 0"),
    "S12_source_registry": """SELECT 'web' AS platform, page_id::VARCHAR AS source_id, url AS source_url, 'a "quoted" title,' || chr(10) || 'in two lines' AS source_title_or_caption,
      ' spaced ' AS author_or_channel, 'hockey' AS sport, 'final' AS event_name, '2026-09-20' AS source_timestamp, CASE WHEN page_id % 4 <> 0 THEN page_id END AS records_collected FROM pages""",
    "W5_stream_spikes": sql(EVENT_LOG, body=SPIKES),
    "W7_sweep_rows": sql(EVENT_LOG, body=f"""
      , f AS (SELECT record_id, min(CASE WHEN sweep_id < '{SWEEP_DAYS[0]}' THEN 0 WHEN sweep_id < '{SWEEP_DAYS[1]}' THEN 1 ELSE 2 END) AS batch FROM event_log GROUP BY 1)
      SELECT batch, count(*) AS new_records FROM f GROUP BY 1"""),
    "W7_stream_sweep_log": sql(EVENT_LOG, body=" SELECT count(*) AS new_records FROM corpus"),
}


def _s10():
    from registry.intake import REPAIRED

    return sql(POSTS, RAW, body=REPAIRED + """
      SELECT post_id, "timestamp" AS posted_at, CAST(timestamp_format IN ('iso8601', 'epoch_seconds') AS BIGINT) AS has_time, CAST(flag_likes_sign_restored AS BIGINT) AS likes_restored,
             CAST(flag_ambiguous_date_format AS BIGINT) AS date_flagged, CAST(isodow("timestamp") > 5 AS BIGINT) AS is_weekend FROM repaired WHERE text_content IS NOT NULL""")


def _s8():
    from registry.intake import REPAIRED

    return sql(POSTS, RAW, USERS, body=REPAIRED + """
      SELECT strftime("timestamp", '%Y-%m') AS part, count(*) AS "rows" FROM repaired WHERE text_content IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'json', count(text_content) FROM repaired UNION ALL SELECT 'users', (SELECT count(*) FROM users)
      UNION ALL SELECT 'held out', count(*) - count(text_content) FROM repaired""")


ORACLE["S10_analysis_posts"] = _s10()
ORACLE["S8_intake_files"] = _s8()
