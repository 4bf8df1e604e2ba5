"""Repair of a corrupted export: missing words, replays, text, platform, time, counts, users.

``repair_posts`` is one lazy plan over the raw strings. Replays are collapsed by one
grouping that also keeps how often a row came, so that the counts of the repair log refer
to the raw rows without a second scan. The repaired rows are written once because the
analysis table, the held-out table, the log and the checks all read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chirrup.constants import MISSING_TOKENS, PLATFORM_ALIASES, UNSPECIFIED, WINDOW_END, WINDOW_START
from chirrup.functions import metrics as m
from chirrup.functions.strings import SPACES, contains_any, strip, unescape_html
from chirrup.operators.ranking import exact_quantiles
from chirrup.session import materialise

RAW_COLUMNS = ("post_id", "user_id", "platform", "text_content", "timestamp", "likes", "shares", "comments")
SENTINELS = tuple(sorted({t.lower() for t in MISSING_TOKENS}))
TEXT_HITS = (
    "mojibake", "mojibake_tail", "html_entity", "html_tag", "stray_amp", "trailing_comma",
    "double_space", "padded", "sentinel_string",
)
_TAG = r"(?i)</?(?:br|div|p|span)\s*/?>"


def is_missing_word(column: Column) -> Column:
    return strip(F.coalesce(column, F.lit(""))).isin(*MISSING_TOKENS)


def normalise_missing(df: DataFrame, columns) -> DataFrame:
    """Missing-value words become NULL; other values stay as they arrived."""
    return df.withColumns({c: F.when(~is_missing_word(F.col(c)), F.col(c)) for c in columns})


def collapse_replays(df: DataFrame, columns) -> DataFrame:
    """Rows equal in every column become one, with the number of ``copies``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))


def identity_collisions(df: DataFrame, key: str = "post_id") -> DataFrame:
    """Keys that still belong to more than one row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


# ------------------------------------------------------------------------------ text body
def _strip_tags_fully(text: Column) -> Column:
    """struct(text, passes): injected tags removed, again if a removal formed a new one.

    A pass removes at least one ``<``, so their number bounds the passes; nearly every text
    is done after the first.
    """
    once = F.regexp_replace(text, _TAG, "")
    start = F.struct(once.alias("text"), (once != text).cast("long").alias("passes"))
    more = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(once) - F.length(F.replace(once, F.lit("<"))), F.lit(1))),
        start,
        lambda acc, _: F.when(
            acc["text"].rlike(_TAG),
            F.struct(
                F.regexp_replace(acc["text"], _TAG, "").alias("text"), (acc["passes"] + 1).alias("passes")
            ),
        ).otherwise(acc),
    )
    return F.when(once.rlike(_TAG), more).otherwise(start)


def _latin1_reversed(text: Column) -> Column:
    """UTF-8 read as Latin-1, turned back; NULL where that is not what happened."""
    suspicious = text.rlike(r"[\xc2-\xf3][\x80-\xbf]") & ~text.rlike(r"[^\x00-\xff]")
    raw = F.encode(F.when(suspicious, text), "ISO-8859-1")
    valid = F.when(F.is_valid_utf8(raw.cast("string")), raw)
    decoded = F.decode(valid, "UTF-8")
    return F.when(~decoded.contains("\ufffd") & (decoded != text), decoded)


def repair_text(df: DataFrame, source: str = "text_content", target: str = "text_content") -> DataFrame:
    """Layered repair of a text column; also adds one hit counter per repair (``hit_*``).

    The order matters: entities hide tags, tags hide trailing marks, and only a fully
    peeled body shows whether it is a missing-value word. Every step is a column of its
    own, so that it is computed once.
    """
    hit = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    t = F.col
    steps = df.withColumn("_s", t(source))
    steps = steps.withColumn("_ent", contains_any(t("_s"), ("&#", "&amp;", "&lt;", "&gt;", "&quot;")))
    steps = steps.withColumn("_s", F.when(t("_ent"), unescape_html(F.when(t("_ent"), t("_s")))).otherwise(t("_s")))
    steps = steps.withColumn("_core", strip(t("_s")))
    steps = steps.withColumn("_pad", t("_core") != t("_s"))
    steps = steps.withColumn("_tags", _strip_tags_fully(t("_core")))
    steps = steps.withColumn("_body", F.rtrim(t("_tags.text"), F.lit(SPACES + "&,")))
    steps = steps.withColumn("_tail", F.substring(t("_tags.text"), F.length("_body") + 1, F.length("_tags.text")))
    steps = steps.withColumn("_fixed", _latin1_reversed(t("_body")))
    steps = steps.withColumn("_mtail", t("_fixed").endswith("é"))
    steps = steps.withColumn(
        "_text",
        F.when(t("_mtail"), strip(F.regexp_replace("_fixed", "é$", ""))).otherwise(F.coalesce("_fixed", "_body")),
    )
    steps = steps.withColumn("_word", F.lower("_text").isin(*SENTINELS))
    steps = steps.withColumn("_gaps", t("_text").contains("  ") & ~t("_word"))
    out = steps.withColumns(
        {
            target: F.when(t("_word"), F.lit(None).cast("string"))
            .when(t("_gaps"), F.regexp_replace("_text", "[ \\t]{2,}", " "))
            .otherwise(t("_text")),
            "hit_mojibake": hit(t("_fixed").isNotNull()),
            "hit_mojibake_tail": hit(t("_mtail")),
            "hit_html_entity": hit(t("_ent")),
            "hit_html_tag": hit(t("_tags.passes")),
            "hit_stray_amp": hit(F.length("_tail") - F.length(F.replace(t("_tail"), F.lit("&")))),
            "hit_trailing_comma": hit(F.length("_tail") - F.length(F.replace(t("_tail"), F.lit(",")))),
            "hit_double_space": hit(t("_gaps")),
            "hit_padded": hit(t("_pad")),
            "hit_sentinel_string": hit(t("_word")),
        }
    )
    return out.drop("_s", "_ent", "_core", "_pad", "_tags", "_body", "_tail", "_fixed", "_mtail", "_text", "_word", "_gaps")


# ------------------------------------------------------------------------------ other columns
def canonical_platform(raw: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in PLATFORM_ALIASES.items() for x in pair])
    name = strip(raw)
    return F.coalesce(F.try_element_at(aliases, F.lower(name)), name, F.lit(UNSPECIFIED))


def timestamp_format(raw: Column) -> Column:
    """Which of the intake formats a value is written in."""
    s = strip(raw)
    return (
        F.when(F.coalesce(F.lower(s), F.lit("")).isin(*SENTINELS), "missing")
        .when(
            s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$")
            & F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(),
            "iso8601",
        )
        .when(s.rlike("^[0-9]{10}$"), "epoch_seconds")
        .when(
            s.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$") & F.try_to_timestamp(s, F.lit("dd-MM-yyyy")).isNotNull(),
            "dayfirst_dmy",
        )
        .otherwise("unparsed")
    )


def parsed_timestamp(raw: Column, fmt: Column) -> Column:
    s = strip(raw)
    return (
        F.when(fmt == "iso8601", F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
        .when(fmt == "epoch_seconds", F.timestamp_seconds(s.try_cast("bigint")))
        .when(fmt == "dayfirst_dmy", F.try_to_timestamp(s, F.lit("dd-MM-yyyy")))
    )


def normalise_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    fmt = df.withColumn("timestamp_format", timestamp_format(F.col(column)))
    ts = fmt.withColumn(column, parsed_timestamp(F.col(column), F.col("timestamp_format")))
    at = F.col(column)
    return ts.withColumns(
        {
            "flag_ambiguous_date_format": F.col("timestamp_format") == "dayfirst_dmy",
            "post_date": F.to_date(at),
            "post_month": F.date_format(at, "yyyy-MM"),
            "post_hour": F.hour(at).cast("long"),
            "weekday": F.date_format(at, "EEEE"),
            "is_weekend": F.weekday(at) >= 5,
        }
    )


def number(raw: Column) -> Column:
    return raw.try_cast("double").try_cast("bigint")


def normalise_engagement(df: DataFrame, *, restore_sign: bool = True) -> DataFrame:
    """Counts become nullable integers; a negative like count is a lost sign, or NULL if not restored."""
    likes = number(F.col("likes"))
    negative = F.coalesce(likes < 0, F.lit(False))
    return df.withColumns(
        {
            "flag_likes_sign_restored": negative if restore_sign else F.lit(False),
            "_negative": negative,
            "likes": F.when(~negative, likes).otherwise(F.abs(likes) if restore_sign else F.lit(None)),
            "shares": number(F.col("shares")),
            "comments": number(F.col("comments")),
        }
    )


def repair_users(raw: DataFrame) -> DataFrame:
    users = normalise_missing(raw, raw.columns)
    followers = number(F.col("follower_count"))
    country = strip(F.get(F.split("location", ",", 2), F.lit(1)))
    return users.withColumns(
        {
            "account_created": F.try_to_date(strip(F.col("account_created")), "yyyy-MM-dd"),
            "follower_count": F.when(followers >= 0, followers),
            "language": strip(F.lower("language")),
            "city": strip(F.get(F.split("location", ",", 2), F.lit(0))),
            "country": F.replace(
                F.replace(country, F.lit("UK"), F.lit("United Kingdom")), F.lit("USA"), F.lit("United States")
            ),
        }
    )


# ------------------------------------------------------------------------------ the whole job
@dataclass
class Intake:
    repaired: DataFrame
    analysis: DataFrame
    held_out: DataFrame
    log: DataFrame
    counts: DataFrame


def dayfirst_proof(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Of the dd-mm-yyyy rows: how many first and second fields cannot be a month."""
    s = F.col(column)
    rows = df.where(s.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$"))
    return rows.agg(
        F.count(F.lit(1)).alias("dmy_rows"),
        m.count_where(F.substring(s, 1, 2).cast("int") > 12).alias("first_field_over_12"),
        m.count_where(F.substring(s, 4, 2).cast("int") > 12).alias("second_field_over_12"),
    )


def repair_posts(
    raw: DataFrame, *, restore_sign: bool = True, start: str = WINDOW_START, end: str = WINDOW_END
) -> Intake:
    blank = normalise_missing(raw.select(*RAW_COLUMNS), RAW_COLUMNS)
    single = collapse_replays(blank, RAW_COLUMNS)
    missing = [F.col(c).isNull().cast("long").alias(f"null_{c}") for c in RAW_COLUMNS]
    rows = repair_text(single.select("*", *missing))
    rows = rows.withColumn("_no_platform", F.col("platform").isNull())
    rows = rows.withColumn("platform", canonical_platform(F.col("platform")))
    rows = normalise_engagement(normalise_time(rows), restore_sign=restore_sign)
    repaired = materialise(rows)
    keep = F.col("text_content").isNotNull()
    internal = ["copies", "_negative", "_no_platform"] + [c for c in repaired.columns if c.startswith(("hit_", "null_"))]
    return Intake(
        repaired=repaired.drop(*internal),
        analysis=repaired.where(keep).drop(*internal),
        held_out=repaired.where(~keep).drop(*internal).withColumn("held_out_reason", F.lit("empty_text_content")),
        log=repair_log(repaired, restore_sign=restore_sign, start=start, end=end),
        counts=reconciliation(repaired),
    )


ACTIONS = {  # hit counter -> action, reason
    "mojibake": ("repair double-encoded UTF-8", "bytes decoded with the wrong charset, turned back when valid"),
    "mojibake_tail": ("strip decoded mojibake tail mark", "a mark the broken writer appended"),
    "html_entity": ("unescape HTML entities", "entities left by the writer"),
    "html_tag": ("strip injected HTML tags", "markup injected by the renderer"),
    "stray_amp": ("drop stray trailing '&'", "left over once the entity was decoded"),
    "trailing_comma": ("drop orphaned trailing ','", "separator left by a removed tag or entity"),
    "double_space": ("collapse repeated spaces", "repeated spaces between words"),
    "padded": ("trim whitespace", "white space around the value"),
    "sentinel_string": ("missing-value word -> missing", "a body that only says it is missing"),
}


def repair_log(repaired: DataFrame, *, restore_sign: bool, start: str, end: str) -> DataFrame:
    """(action, table, column, rows_affected, justification), actions without effect left out."""
    n = F.count(F.lit(1))
    entries: list[tuple[str, str, Column, str]] = []
    for c in RAW_COLUMNS:
        entries.append(
            ("textual_NULL -> real NULL", c, F.sum(F.col(f"null_{c}") * F.col("copies")), "a word that means missing")
        )
    entries.append(("drop exact duplicate row", "*", F.sum("copies") - n, "replays equal in every field"))
    for h in TEXT_HITS:
        action, why = ACTIONS[h]
        entries.append((action, "text_content", F.sum(f"hit_{h}"), why))
    entries.append(
        (
            f"unify platform spelling; missing -> '{UNSPECIFIED}'",
            "platform",
            m.count_where(F.col("_no_platform")),
            "a lost label is shown as such, not guessed",
        )
    )
    for fmt in ("missing", "iso8601", "epoch_seconds", "dayfirst_dmy", "unparsed"):
        entries.append(
            (f"parse timestamp from '{fmt}'", "timestamp", m.count_where(F.col("timestamp_format") == fmt), "one type for all formats")
        )
    entries += [
        (
            "flag day-first dates (flag_ambiguous_date_format)",
            "timestamp",
            m.count_where(F.col("flag_ambiguous_date_format")),
            "read day first, because some first fields exceed 12 and no second one does",
        ),
        (
            "timestamps outside declared event window",
            "timestamp",
            m.count_where(
                (F.col("timestamp") < F.lit(start).cast("timestamp")) | (F.col("timestamp") >= F.lit(end).cast("timestamp"))
            ),
            "kept, not trimmed",
        ),
        (
            "restore sign-flipped likes with abs()" if restore_sign else "null out negative likes",
            "likes",
            m.count_where(F.col("_negative")),
            "magnitudes mirror the positive values",
        ),
        *[(f"cast {c} -> nullable integer", c, n, "NULL stays distinct from 0") for c in m.METRICS],
        (
            "missing engagement left NULL (no imputation)",
            "likes",
            m.count_where(F.col("likes").isNull()),
            "a missing count stays missing",
        ),
        (
            "empty text_content after full repair",
            "text_content",
            m.count_where(F.col("text_content").isNull()),
            "no body left to analyse",
        ),
        (
            "empty-text rows held out of the analysis table",
            "text_content",
            m.count_where(F.col("text_content").isNull()),
            "kept in the held-out table",
        ),
    ]
    sums = repaired.agg(*[e[2].alias(f"e{i}") for i, e in enumerate(entries)])
    rows = F.array(
        *[
            F.struct(
                F.lit(action).alias("action"),
                F.lit("posts").alias("table"),
                F.lit(column).alias("column"),
                F.coalesce(F.col(f"e{i}"), F.lit(0)).cast("long").alias("rows_affected"),
                F.lit(why).alias("justification"),
            )
            for i, (action, column, _, why) in enumerate(entries)
        ]
    )
    return sums.select(F.inline(rows)).where("rows_affected > 0").orderBy(F.desc("rows_affected"), "action", "column")


def reconciliation(repaired: DataFrame) -> DataFrame:
    """raw - replays - held out = analysis, and whether it closes."""
    counts = repaired.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count(F.lit(1))).alias("replay_rows"),
        m.count_where(F.col("text_content").isNull()).alias("held_out_rows"),
        m.count_where(F.col("text_content").isNotNull()).alias("analysis_rows"),
    )
    return counts.withColumn(
        "closes",
        F.col("raw_rows") - F.col("replay_rows") - F.col("held_out_rows") == F.col("analysis_rows"),
    )


# ------------------------------------------------------------------------------ checks and profiles
def integrity_checks(posts: DataFrame, users: DataFrame, *, start: str = WINDOW_START, end: str = WINDOW_END) -> DataFrame:
    """One row of violation counts for the repaired tables."""
    per_user = posts.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    known = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    orphans = per_user.join(known, "user_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    silent = users.join(per_user, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    dup_users = users.agg((F.count("user_id") - F.count_distinct("user_id")).alias("n")).scalar()
    at = F.col("timestamp")
    return posts.agg(
        (F.count("post_id") - F.count_distinct("post_id")).alias("dup_post_id"),
        m.count_where(F.col("likes") < 0).alias("negative_likes_after"),
        m.count_where((at < F.lit(start).cast("timestamp")) | (at >= F.lit(end).cast("timestamp"))).alias("out_of_window"),
        m.count_where(at > F.current_timestamp()).alias("future_timestamps"),
        m.count_where(F.col("text_content").isNull()).alias("empty_text_after"),
    ).select(
        orphans.alias("orphan_posts"),
        "*",
        dup_users.alias("dup_user_id"),
        silent.alias("users_never_posting"),
    )


def with_user_record(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Adds whether the author is in the users table."""
    known = users.select("user_id", F.lit(True).alias("_known")).where(F.col("user_id").isNotNull()).distinct()
    return (
        posts.join(known, "user_id", "left")
        .withColumn("user_record_exists", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def raw_facts(raw: DataFrame) -> DataFrame:
    """What the raw rows look like before any repair, in one row."""
    rows = collapse_replays(raw, RAW_COLUMNS)
    ids = rows.groupBy("post_id").agg(F.sum("copies").alias("n"))
    dups = ids.agg(
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("raw_dup_postid_rows"),
        m.count_where(F.col("n") > 1).alias("raw_dup_postid_ids"),
    )
    likes = F.when(~F.col("likes").isin("", "NULL"), F.col("likes").try_cast("double"))
    text, stamp, n = F.col("text_content"), strip(F.col("timestamp")), F.col("copies")
    dmy = stamp.rlike("^[0-9]{2}-[0-9]{2}-[0-9]{4}$")

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    first = F.substring(stamp, 1, 2).try_cast("int")
    second = F.substring(stamp, 4, 2).try_cast("int")
    facts = rows.agg(
        F.sum("copies").alias("raw_rows"),
        (F.sum("copies") - F.count(F.lit(1))).alias("raw_dup_rows"),
        rows_where(dmy).alias("dayfirst_rows_raw"),
        rows_where(dmy & (first > 12)).alias("dayfirst_gt12_first"),
        rows_where(dmy & (second > 12)).alias("dayfirst_gt12_second"),
        rows_where(dmy & (first <= 12)).alias("dayfirst_ambiguous"),
        rows_where(likes < 0).alias("neg_likes_rows"),
        F.max(F.when(likes < 0, F.abs(likes))).alias("neg_max_abs"),
        F.max(F.when(likes > 0, likes)).alias("pos_max"),
        rows_where(text.contains("Ã©")).alias("mojibake_rows_raw"),
        rows_where(F.col("likes").contains(".")).alias("float_serialised_likes"),
        rows_where(text.contains("&amp;")).alias("entities_raw"),
        rows_where(text.rlike("<br>|<div>")).alias("tags_raw"),
    )
    signed = raw.select((likes < 0).alias("negative"), F.abs(likes).alias("size")).where("size > 0")
    medians = exact_quantiles(signed, ["negative"], "size", [0.5]).select("negative", F.col("q")[0].alias("median"))
    pick = lambda neg: medians.agg(F.max(F.when(F.col("negative") == neg, F.col("median"))).alias("x")).scalar()
    return facts.select(
        "*",
        dups.select("raw_dup_postid_rows").scalar().alias("raw_dup_postid_rows"),
        dups.select("raw_dup_postid_ids").scalar().alias("raw_dup_postid_ids"),
        pick(True).alias("neg_median_abs"),
        pick(False).alias("pos_median"),
    )


def column_profile(df: DataFrame, columns) -> DataFrame:
    """Blank, NULL-word, distinct and non-numeric counts per column.

    Columns are stacked and counted per value first, so a value holding a third of a
    column is combined before the shuffle.
    """
    values = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("s", strip(F.col("value")))
    )
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return values.groupBy("column").agg(
        some(F.col("s") == "").alias("blank"),
        some(F.col("s") == "NULL").alias("null_word"),
        F.count("value").alias("unique"),
        some(~F.col("s").rlike(r"^-?[0-9]+(\.[0-9]+)?$")).alias("non_numeric"),
    )


def residual_sweep(posts: DataFrame) -> DataFrame:
    """Nine corruption markers that must be gone after the repair."""
    t = F.col("text_content")
    checks = {
        "HTML entities left": t.rlike("&amp;|&lt;|&gt;|&#"),
        "HTML tags left": t.rlike("<[a-zA-Z/]"),
        "double-encoding left": t.contains("Ã©"),
        "any non-ASCII left": t.rlike(r"[^\x00-\x7F]"),
        "trailing '&' or ','": t.rlike(r"[&,]\s*$"),
        "double spaces": t.contains("  "),
        "sentinel-as-content": F.lower(strip(t)).isin(*SENTINELS),
        "negative likes": F.col("likes") < 0,
        "unparsed timestamps": F.col("timestamp").isNull(),
    }
    sums = posts.agg(*[m.count_where(c).alias(name) for name, c in checks.items()])
    return sums.unpivot([], sums.columns, "marker", "rows")


def residual_missingness(posts: DataFrame, columns=("text_content", "likes", "platform")) -> DataFrame:
    sums = posts.agg(
        F.count(F.lit(1)).alias("_n"), *[m.count_where(F.col(c).isNull()).alias(c) for c in columns]
    )
    return sums.unpivot(["_n"], list(columns), "column", "missing").select(
        "column",
        "missing",
        F.round(m.percent(F.col("missing"), F.greatest(F.col("_n"), F.lit(1))), 2).alias("missing_pct"),
    )


def before_and_after(raw: DataFrame, repaired: DataFrame, marker: str = "&amp;") -> DataFrame:
    """Raw and repaired text of the rows holding ``marker``, with the characters removed."""
    before = raw.where(F.col("text_content").contains(marker)).select("post_id", F.col("text_content").alias("before")).distinct()
    after = repaired.select("post_id", F.col("text_content").alias("after"))
    return before.join(after, "post_id").withColumn(
        "chars_changed", (F.length("before") - F.length(F.coalesce("after", F.lit("")))).cast("long")
    )
