"""Posts, users, tags, raw intake, labelled text and event log, read from a star schema.

The analyses take social-media relations; these functions derive them from order /
customer / event / document tables, column by column, so that every analysis can run on
any data set of that shape and at any scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chirrup.constants import UNSPECIFIED


def _pick(column: Column, pairs: dict, default: Column) -> Column:
    """CASE column WHEN key THEN value ... ELSE default."""
    out = None
    for key, value in pairs.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out.otherwise(default)


FRAGMENTS = (
    " I can't love this sooo much :) https://t.co/x",
    " @User_1 not a good day :-( #Sad",
    " it\\u2019s &amp;lt;fine&amp;gt; &amp; ok",
    " never again 😀 www.example.org",
    " They won't... we'll see, he'd say \"no\"",
)


@dataclass
class StarSchema:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------ posts and users
    @cached_property
    def posts(self) -> DataFrame:
        """One post per order; its lines give shares and comments."""
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.floor(4 * F.sum("l_quantity")).cast("long").alias("shares"),
                (50 * F.count(F.lit(1))).alias("comments"),
            )
        )
        orders = self.table("orders")
        key, at = F.col("o_orderkey"), F.col("o_orderdate")
        return orders.join(lines, key == F.col("l_orderkey"), "left").select(
            key.alias("post_id"),
            F.col("o_custkey").alias("user_id"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", UNSPECIFIED)
            .otherwise(F.col("o_orderpriority"))
            .alias("platform"),
            at.cast("timestamp").alias("posted_at"),
            F.to_date(at).alias("post_date"),
            F.date_format(at, "yyyy-MM").alias("post_month"),
            F.date_format(at, "EEEE").alias("weekday"),
            (F.weekday(at) >= 5).alias("is_weekend"),
            _pick(
                key % 3,
                {0: F.lit("iso8601"), 1: F.lit("epoch_seconds")},
                F.lit("dayfirst_dmy"),
            ).alias("timestamp_format"),
            F.when(key % 7 != 0, F.floor(F.col("o_totalprice") / 100)).cast("long").alias("likes"),
            "shares",
            "comments",
            (key % 23 == 0).cast("long").alias("likes_restored"),
        )

    @cached_property
    def users(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("user_id"),
                F.concat_ws(", ", "n_name", "r_name").alias("location"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("country"),
                F.lower("c_mktsegment").alias("language"),
                F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 5)
                .cast("long")
                .alias("follower_count"),
                F.date_add(
                    F.lit("1994-06-01").cast("date"), (F.col("c_custkey") % 400).cast("int")
                ).alias("account_created"),
            )
        )

    @cached_property
    def post_tags(self) -> DataFrame:
        """Distinct (post, brand of an ordered part)."""
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("post_id"), F.col("p_brand").alias("tag"))
            .distinct()
        )

    @cached_property
    def timed_posts(self) -> DataFrame:
        """Events as posts; one event type carries no clock and falls on midnight."""
        kind, at = F.col("event_type"), F.col("ts")
        timed = kind != "error"
        return self.table("events").select(
            F.col("event_id").alias("post_id"),
            "user_id",
            kind.alias("platform"),
            at.alias("posted_at"),
            timed.cast("long").alias("has_time"),
            F.when(timed, F.hour(at)).otherwise(0).cast("long").alias("post_hour"),
            F.when(timed, "iso8601").otherwise("dayfirst_dmy").alias("timestamp_format"),
        )

    @cached_property
    def text_posts(self) -> DataFrame:
        """Documents as posts with hashtags; counts follow from the length."""
        key, size = F.col("doc_id"), F.col("n_chars")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 360).cast("int"))
        return self.table("documents").select(
            key.alias("post_id"),
            (key % 97).alias("user_id"),
            F.col("source").alias("platform"),
            F.concat(
                F.col("text"),
                F.lit(" #"),
                F.col("lang"),
                F.lit(" #"),
                F.col("source"),
                F.when(key % 3 == 0, " #Long_Read #en").otherwise(""),
            ).alias("text_content"),
            day.alias("post_date"),
            F.date_format(day, "yyyy-MM").alias("post_month"),
            F.when(key % 7 != 0, size % 5001).cast("long").alias("likes"),
            ((size * 7) % 5001).cast("long").alias("shares"),
            ((size * 3) % 601).cast("long").alias("comments"),
        )

    # ------------------------------------------------------------------ raw intake
    @cached_property
    def raw_posts(self) -> DataFrame:
        """The posts written back as strings, with the defects of a broken export planted."""
        k = F.col("post_id")
        body = F.concat(
            F.lit("Loving it, order "),
            k.cast("string"),
            F.lit(" can't wait #Tag"),
            (k % 9).cast("string"),
            F.lit(" #Deal"),
        )
        text = _pick(
            k % 19,
            {
                0: F.lit(""),
                1: F.lit("NULL"),
                2: F.lit("NULL\n\n"),
                3: F.lit("NULL&amp;"),
                4: F.concat(body, F.lit("&amp;")),
                5: F.concat(F.lit("<div>"), body, F.lit(",&amp;<br>")),
                6: F.concat(body, F.lit("Ã©")),
                7: F.concat(body, F.lit(",<br>")),
                8: F.concat(F.lit("  "), body, F.lit(" ")),
                9: F.replace(body, F.lit(" "), F.lit("  ")),
                10: F.concat(F.lit("a &lt;br&gt; "), body),
                11: F.lit("NULLÃ©"),
                12: F.concat(F.lit("日本 "), body, F.lit(" Ã©")),
            },
            body,
        )
        at = F.timestamp_seconds(F.unix_timestamp("posted_at") + (k % 24) * 3600)
        likes = F.when(
            F.col("likes").isNull(), F.when(k % 2 == 0, "").otherwise("NULL")
        ).when(k % 11 == 0, F.concat(F.lit("-"), F.col("likes").cast("string"), F.lit(".0"))).otherwise(
            F.col("likes").cast("string")
        )
        platform = _pick(
            F.col("platform"),
            {
                "1-URGENT": F.lit(" x "),
                "2-HIGH": F.lit("insta"),
                "3-MEDIUM": F.lit("YouTube"),
                "5-LOW": F.lit("fb"),
            },
            F.when(k % 2 == 0, "").otherwise("NULL"),
        )
        once = self.posts.select(
            k.alias("k"),
            F.concat(F.lit("P"), k.cast("string")).alias("post_id"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
            platform.alias("platform"),
            text.alias("text_content"),
            _pick(
                k % 3,
                {
                    0: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
                    1: F.unix_timestamp(at).cast("string"),
                },
                F.date_format(at, "dd-MM-yyyy"),
            ).alias("timestamp"),
            likes.alias("likes"),
            F.coalesce(F.col("shares").cast("string"), F.lit("")).alias("shares"),
            F.coalesce(F.col("comments").cast("string"), F.lit("")).alias("comments"),
        )
        # the retry loop replayed some rows; one of the copies spells a blank differently
        copies = F.when(F.col("k") % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            once.withColumn("copy", F.explode(copies))
            .withColumn(
                "text_content",
                F.when((F.col("copy") == 1) & (F.col("text_content") == ""), "null").otherwise(
                    F.col("text_content")
                ),
            )
            .withColumn("row_no", F.col("k") * 2 + F.col("copy") + 1)
            .drop("k", "copy")
        )

    @cached_property
    def raw_users(self) -> DataFrame:
        k = F.col("c_custkey")
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.concat(F.lit("U"), k.cast("string")).alias("user_id"),
                F.concat(
                    F.col("n_name"),
                    F.lit(", "),
                    _pick(
                        F.col("r_name"),
                        {"EUROPE": F.lit("UK"), "AMERICA": F.lit("USA")},
                        F.col("r_name"),
                    ),
                ).alias("location"),
                F.when(k % 29 == 0, "NULL")
                .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
                .alias("language"),
                F.when(k % 37 == 0, "n/a")
                .otherwise(
                    F.date_format(
                        F.date_add(F.lit("1994-06-01").cast("date"), (k % 400).cast("int")),
                        "yyyy-MM-dd",
                    )
                )
                .alias("account_created"),
                F.floor(F.col("c_acctbal") * 5).cast("long").cast("string").alias("follower_count"),
            )
        )

    # ------------------------------------------------------------------ labelled text
    @cached_property
    def labelled_text(self) -> DataFrame:
        return (
            self.table("documents")
            .join(self.table("labels"), "doc_id")
            .select(
                F.col("doc_id").alias("text_id"),
                F.col("text").alias("post_text"),
                F.when(F.col("toxic") == 1, "Negative")
                .when(F.col("quality") == 1, "Positive")
                .otherwise("Neutral")
                .alias("sentiment_label"),
                F.col("lang").alias("topic_category"),
            )
        )

    @cached_property
    def scored_text(self) -> DataFrame:
        """Labelled rows with two sets of class probabilities derived from length and key."""
        base = self.table("documents").join(self.table("labels"), "doc_id")
        k = F.col("doc_id")
        w = {
            "Negative": 1 + (k * 37 + 11 * F.col("n_chars")) % 41,
            "Neutral": 1 + (k * 53 + 7) % 29,
            "Positive": 1 + (k * 11 + F.col("n_chars")) % 61,
        }
        total = sum(w.values(), F.lit(0)).cast("double")
        probs = {c: x / total for c, x in w.items()}
        best = F.greatest(*probs.values())
        return base.select(
            k.alias("text_id"),
            F.col("text").alias("post_text"),
            F.when(F.col("toxic") == 1, "Negative")
            .when(F.col("quality") == 1, "Positive")
            .otherwise("Neutral")
            .alias("true"),
            F.when(probs["Negative"] == best, "Negative")
            .when(probs["Neutral"] == best, "Neutral")
            .otherwise("Positive")
            .alias("pred"),
            _pick(k % 3, {0: F.lit("Negative"), 1: F.lit("Neutral")}, F.lit("Positive")).alias("pred_b"),
            *[p.alias(f"prob_{c}") for c, p in probs.items()],
        )

    @cached_property
    def social_text(self) -> DataFrame:
        """Documents with social-media fragments appended, whole texts kept."""
        return self.table("documents").select(
            "doc_id",
            F.concat(
                F.col("text"), _pick(F.col("doc_id") % 6, {i: F.lit(f) for i, f in enumerate(FRAGMENTS)}, F.lit(""))
            ).alias("text"),
        )

    # ------------------------------------------------------------------ event log
    @cached_property
    def event_log(self) -> DataFrame:
        """Events as collected records; some are collected again by a later sweep."""
        k = F.col("event_id")
        count = F.get_json_object("props", "$.k").cast("long")
        copies = F.when(k % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        source = _pick(
            F.col("event_type"),
            {
                "view": F.lit("mastodon"),
                "click": F.lit("gnews"),
                "purchase": F.lit("bing"),
                "signup": F.lit("feed_ht_sports"),
            },
            F.lit("hn"),
        )
        day = F.to_date("ts")
        return (
            self.table("events")
            .withColumn("copy", F.explode(copies))
            .select(
                F.concat(source, F.lit(":"), k.cast("string")).alias("record_id"),
                source.alias("source"),
                F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
                F.when(k % 5 != 0, F.concat(F.lit("Event "), F.col("event_type"))).alias("title"),
                F.when(
                    k % 4 != 0,
                    F.concat(
                        F.lit("value "),
                        F.floor("value").cast("long").cast("string"),
                        F.when(k % 6 == 0, " हॉकी").otherwise(""),
                    ),
                ).alias("text"),
                F.concat(F.lit("https://example.org/e/"), k.cast("string")).alias("url"),
                F.lit("en").alias("lang"),
                F.when(k % 101 != 0, F.date_trunc("second", "ts")).alias("created_at"),
                F.timestamp_seconds(
                    F.unix_timestamp(day.cast("timestamp")) + 86400 * (1 + F.col("copy"))
                ).alias("collected_at"),
                F.create_map(
                    F.lit("reblogs"), count, F.lit("favourites"), count * 2, F.lit("replies"), count % 7
                ).alias("engagement"),
                F.date_format(
                    F.timestamp_seconds(
                        F.unix_timestamp(day.cast("timestamp")) + 86400 * (1 + F.col("copy"))
                    ),
                    "yyyyMMdd",
                ).alias("sweep_id"),
                F.lit("live").alias("sweep_mode"),
                F.when(F.col("user_id") % 5 == 0, "global").otherwise("india").alias("scope"),
                ((k * 37) % 1000 / F.lit(1000.0)).alias("prob_sentiment_Positive"),
                ((k * 53) % 500 / F.lit(1000.0)).alias("prob_sentiment_Negative"),
            )
        )

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")
