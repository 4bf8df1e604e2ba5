"""Landed payloads (JSON timelines, story searches, article lists, feeds, embeds) to one record layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chirrup.constants import TOPIC_KEYWORDS
from chirrup.functions.strings import strip, strip_embed, strip_tags, url_key



def _layout(source: Column, key: Column, **fields: Column) -> list[Column]:
    null = F.lit(None).cast("string")
    empty = F.create_map().cast(T.MapType(T.StringType(), T.LongType()))
    defaults = {
        "author": null,
        "title": null,
        "text": null,
        "url": null,
        "lang": null,
        "created_at": F.lit(None).cast("timestamp"),
        "engagement": empty,
        "scope": F.lit("india"),
    }
    return [
        F.concat(source, F.lit(":"), key).alias("record_id"),
        source.alias("source"),
        *[fields.get(name, default).alias(name) for name, default in defaults.items()],
    ]


def _counts(pairs: dict[str, Column]) -> Column:
    parts = [x for name, c in pairs.items() for x in (F.lit(name), F.coalesce(c, F.lit(0).cast("long")))]
    return F.create_map(*parts)


TIMELINE = (
    "array<struct<id:string, url:string, content:string, language:string, created_at:string, account:struct<acct:string>, "
    "reblogs_count:bigint, favourites_count:bigint, replies_count:bigint>>"
)
STORIES = (
    "hits array<struct<objectID:string, author:string, title:string, story_text:string, comment_text:string, "
    "url:string, created_at_i:bigint, points:bigint, num_comments:bigint>>"
)
ARTICLES = "articles array<struct<url:string, title:string, domain:string, seendate:string>>"
ITEM = "guid string, link string, title string, description string, pubDate string, source string"


def timeline(payloads: DataFrame, column: str = "payload", source: str = "mastodon") -> DataFrame:
    """Status timelines: one JSON array of statuses per payload."""
    s = F.col("s")
    rows = payloads.select(F.explode(F.from_json(column, TIMELINE)).alias("s"))
    return rows.select(
        *_layout(
            F.lit(source),
            s["id"],
            author=s["account"]["acct"],
            text=strip_tags(s["content"]),
            url=s["url"],
            lang=s["language"],
            created_at=F.date_trunc("second", F.to_timestamp(s["created_at"])),
            engagement=_counts(
                {"reblogs": s["reblogs_count"], "favourites": s["favourites_count"], "replies": s["replies_count"]}
            ),
        )
    )


def stories(payloads: DataFrame, column: str = "payload", source: str = "hn") -> DataFrame:
    """Story searches; a hit without an id is dropped, one without a link points to its discussion."""
    h = F.col("h")
    rows = payloads.select(F.explode(F.from_json(column, STORIES)["hits"]).alias("h")).where(
        F.coalesce(h["objectID"], F.lit("")) != ""
    )
    filled = lambda c: F.when(c != "", c)
    return rows.select(
        *_layout(
            F.lit(source),
            h["objectID"],
            author=h["author"],
            title=h["title"],
            text=strip_tags(F.coalesce(filled(h["story_text"]), h["comment_text"])),
            url=F.coalesce(filled(h["url"]), F.concat(F.lit("https://news.ycombinator.com/item?id="), h["objectID"])),
            created_at=F.timestamp_seconds(h["created_at_i"]),
            engagement=_counts({"points": h["points"], "comments": h["num_comments"]}),
        )
    )


def articles(payloads: DataFrame, column: str = "payload", source: str = "gdelt") -> DataFrame:
    """Article lists; the key comes from the link, the time from a compact stamp to the minute."""
    a = F.col("a")
    rows = payloads.select(F.explode(F.from_json(column, ARTICLES)["articles"]).alias("a"))
    minute = F.concat(F.substring(a["seendate"], 1, 8), F.substring(a["seendate"], 10, 4))
    return rows.select(
        *_layout(
            F.lit(source),
            url_key(a["url"]),
            author=a["domain"],
            title=strip_tags(a["title"]),
            url=a["url"],
            created_at=F.try_to_timestamp(minute, F.lit("yyyyMMddHHmm")),
        )
    )


def feed_items(df: DataFrame, column: str = "item") -> DataFrame:
    """Parsed <item> elements next to the other columns of the row."""
    return df.withColumn("i", F.from_xml(column, ITEM, {"rowTag": "item"}))


def published(text: Column) -> Column:
    """RFC 822 date to a UTC timestamp; NULL when it does not parse."""
    zoned = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", "")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss zzz")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))
    )


def on_topic(text: Column, keywords=TOPIC_KEYWORDS) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for word in keywords:
        found = found | low.contains(word)
    return found


def feed_records(
    items: DataFrame,
    *,
    source: str,
    key: str = "link",
    column: str = "item",
    feed: str = "feed",
    keywords=None,
) -> DataFrame:
    """Feed items as records, keyed by ``guid`` or ``link``; ``keywords`` keeps a broad feed on topic.

    Every item that has landed is read.
    """
    i = F.col("i")
    parsed = feed_items(items, column).withColumn("_item", i)
    raw_key = F.coalesce(i["guid"], i["link"]) if key == "guid" else i["link"]
    parsed = parsed.withColumn("_key", strip(raw_key)).where(F.coalesce(F.col("_key"), F.lit("")) != "")
    if keywords is not None:
        blob = F.concat_ws(" ", strip_tags(i["title"]), strip_tags(i["description"]))
        parsed = parsed.where(on_topic(blob, keywords))
    name = F.lit(source) if keywords is None else F.concat(F.lit(f"{source}_"), F.col(feed))
    author = F.col(feed) if keywords is not None else F.nullif(strip(i["source"]), F.lit(""))
    return parsed.select(
        *_layout(
            name,
            url_key(F.col("_key")),
            author=author,
            title=strip_tags(i["title"]),
            text=strip_tags(i["description"]),
            url=i["link"] if key == "guid" else F.col("_key"),
            created_at=published(i["pubDate"]),
        )
    )


BLOCK = r'(?s)(<div class="tweet".*?</div>\s*</div>\s*</div>)'


def embeds(pages: DataFrame, *, html: str = "html", account: str = "account", source: str = "xsynd") -> DataFrame:
    """Repeated embed blocks of an HTML page: id, author, epoch time and text of each."""
    b = F.col("b")
    blocks = pages.select(account, F.explode(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))).alias("b"))
    found = lambda pattern: F.nullif(F.regexp_extract(b, pattern, 1), F.lit(""))
    rows = blocks.select(
        account,
        found(r'data-tweet-id="(\d+)"').alias("id"),
        F.coalesce(found(r'data-screen-name="([^"]+)"'), F.col(account)).alias("author"),
        found(r'data-created-at="(\d+)"').try_cast("bigint").alias("ms"),
        found(r'(?s)<p class="tweet-text"[^>]*>(.*?)</p>').alias("body"),
    ).where(F.col("id").isNotNull())
    body = rows.withColumn("text", strip_embed(F.col("body")))
    return body.select(
        *_layout(
            F.lit(source),
            F.col("id"),
            author=F.col("author"),
            text=F.col("text"),
            url=F.concat(F.lit("https://x.com/"), F.col(account), F.lit("/status/"), F.col("id")),
            lang=F.lit("en"),
            created_at=F.date_trunc("second", F.timestamp_millis(F.when(F.col("ms") > 0, F.col("ms")))),
        )
    )
