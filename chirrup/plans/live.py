"""Monitoring of an arriving event log: corpus, volume, spikes, shifts, entities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chirrup.constants import (
    ARC_SPLIT, DISPLAY_ZONE, ENTITIES, KINDS, LIVE_WINDOW_END, LIVE_WINDOW_START, SEED, SHIFT_MIN_ROWS, SNOWFLAKE_EPOCH_MS, SPIKE_Z,
)
from chirrup.functions import metrics as m
from chirrup.functions.strings import has_devanagari
from chirrup.operators.ranking import average_ranks, grouped_histogram, number_within
from chirrup.session import materialise
from chirrup.sources.files import first_per_record

POSITIVE, NEGATIVE = "prob_sentiment_Positive", "prob_sentiment_Negative"


# ------------------------------------------------------------------------------ ingest
def local_time(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def in_window(start: str = LIVE_WINDOW_START, end: str = LIVE_WINDOW_END, zone: str = DISPLAY_ZONE) -> Column:
    """Closed interval on the creation time; rows without one are out."""
    local = local_time(F.col("created_at"), zone)
    return F.coalesce(local.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), F.lit(False))


def arc(split: str = ARC_SPLIT, zone: str = DISPLAY_ZONE) -> Column:
    at = local_time(F.col("created_at"), zone)
    return F.when(at >= F.lit(split).cast("timestamp"), "live").when(at.isNotNull(), "retro")


def tagged(df: DataFrame, *, start: str = LIVE_WINDOW_START, end: str = LIVE_WINDOW_END, split: str = ARC_SPLIT) -> DataFrame:
    """Rows of the window with their arc; works on a stream as well."""
    return df.where(in_window(start, end)).withColumn("arc", arc(split))


def with_scope(df: DataFrame, scope: str) -> DataFrame:
    return df.withColumn("scope", F.lit(scope))


def new_records(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records of a sweep the corpus does not hold yet, each once."""
    return first_per_record(batch).join(corpus.select("record_id").distinct(), "record_id", "left_anti")


def sweep_summary(records: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One log row per sweep: new records and the outcome of every fetch."""
    fresh = records.groupBy("sweep_id").agg(
        F.first("sweep_mode").alias("mode"), F.max("collected_at").alias("at"), F.count(F.lit(1)).alias("new_records")
    )
    # a sweep has one outcome per query sent
    tried = outcomes.groupBy("sweep_id").agg(
        F.sort_array(F.collect_list(F.struct("source", "term", "http", "records"))).alias("outcomes")
    )
    return fresh.join(tried, "sweep_id", "full")


def fetch_outcomes(records: DataFrame) -> DataFrame:
    """Outcome rows of sweeps whose fetches all succeeded: records per source and sweep."""
    return records.groupBy("sweep_id", "source").agg(F.count(F.lit(1)).alias("records")).select(
        "sweep_id", "source", F.col("source").alias("term"), F.lit("200").alias("http"), "records"
    )


def outcome_table(sweeps: DataFrame, codes: Sequence[str] = ("200", "429")) -> DataFrame:
    """Fetches per source and status code; other outcomes under ``other``."""
    rows = sweeps.select(F.inline("outcomes"))
    return rows.groupBy("source").agg(
        *[m.count_where(F.col("http") == c).alias(f"http_{c}") for c in codes],
        m.count_where(~F.col("http").isin(*codes)).alias("other"),
    )


# ------------------------------------------------------------------------------ corpus
def kind(source: Column, kinds: dict[str, tuple] = KINDS) -> Column:
    out = F.lit("other")
    for name, members in reversed(kinds.items()):
        out = F.when(source.isin(*members), name).otherwise(out)
    return out


def corpus(events: DataFrame, *, zone: str = DISPLAY_ZONE, split: str = ARC_SPLIT) -> DataFrame:
    """One row per record with the derived columns every statistic below uses."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    local = local_time(F.col("created_at"), zone)
    text = F.btrim(F.concat(blank("title"), F.lit(". "), blank("text")), F.lit(". "))
    return first_per_record(events).withColumns(
        {
            "text_full": text,
            "ts_local": local,
            "hour_local": F.date_trunc("hour", local),
            "date_local": F.to_date(local),
            "kind": kind(F.col("source")),
            "is_hindi": has_devanagari(text),
            "arc": arc(split, zone),
        }
    )


def breakdown(df: DataFrame, columns: Sequence[str] = ("source", "arc", "kind", "scope")) -> DataFrame:
    """Counts per value of each column, from one pass over the combinations."""
    cells = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return (
        cells.unpivot(["n"], list(columns), "dimension", "value")
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("records"))
        .where(F.col("value").isNotNull())
    )


def corpus_facts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        m.count_where(F.col("is_hindi")).alias("n_hindi"),
        F.min("date_local").alias("first_day"),
        F.max("date_local").alias("last_day"),
    )


def top_events(df: DataFrame, *, source: str, column: str = "event_name", top: int = 12) -> DataFrame:
    return (
        df.where((F.col("source") == source) & F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), column)
        .limit(top)
    )


def scope_by_arc(df: DataFrame) -> DataFrame:
    return df.groupBy("scope").pivot("arc", ["retro", "live"]).agg(F.count(F.lit(1))).fillna(0, ["retro", "live"])


def daily_arcs(df: DataFrame) -> DataFrame:
    return df.where(F.col("date_local").isNotNull()).groupBy("date_local").pivot("arc", ["retro", "live"]).agg(
        F.count(F.lit(1))
    ).fillna(0, ["retro", "live"])


# ------------------------------------------------------------------------------ volume
def hourly_volume(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records per hour, only hours that have any."""
    return df.where(F.col("hour_local").isNotNull()).groupBy("hour_local", *by).agg(F.count(F.lit(1)).alias("n"))


def volume_level(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))


def spikes(hourly: DataFrame, *, z: float = SPIKE_Z) -> DataFrame:
    """Hours whose volume lies z sample deviations above the mean; none when all are equal."""
    level = volume_level(hourly)
    score = F.try_divide(F.col("n") - level.select("mean").scalar(), level.select("sd").scalar())
    return (
        hourly.withColumn("z", score)
        .where(F.col("z") >= z)
        .select("hour_local", F.col("n").alias("count"), F.round("z", 2).alias("z"))
    )


def hourly_sentiment(df: DataFrame) -> DataFrame:
    return df.where(F.col("hour_local").isNotNull()).groupBy("kind", "hour_local").agg(
        F.avg(POSITIVE).alias("mean_positive"), F.avg(NEGATIVE).alias("mean_negative")
    )


def kind_sentiment(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.avg(POSITIVE), 3).alias("mean_positive"),
        F.round(F.avg(NEGATIVE), 3).alias("mean_negative"),
    )


# ------------------------------------------------------------------------------ shifts
@dataclass(frozen=True)
class Contrast:
    """Two half-open windows of local time."""

    label: str
    pre_start: str
    pre_end: str
    post_start: str
    post_end: str


def _exact_tail(u: float, small: int, large: int) -> float:
    """P(U >= u) without ties: partitions counted by the Gaussian binomial's coefficients."""
    ways = np.zeros(small * large + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        top = large + i
        if top < len(ways):
            ways[top:] -= ways[:-top].copy()
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    return float(ways[int(math.ceil(u)):].sum() / math.comb(small + large, small))


def _rank_sum_p(u: float, a: int, b: int, ties: float, exact: bool = False) -> float:
    big, n = max(u, a * b - u), a + b
    if exact:
        if ties:
            raise ValueError("the exact distribution is that of samples without ties")
        return min(1.0, 2 * _exact_tail(big, min(a, b), max(a, b)))
    spread = math.sqrt(a * b / 12.0 * ((n + 1) - ties / (n * (n - 1.0))))
    if spread == 0:
        return 1.0
    z = (big - a * b / 2.0 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2)))


def rank_sum_p(u: Column | str, a: Column | str, b: Column | str, ties: Column | str, *, exact: bool = False) -> Column:
    """Two-sided Mann-Whitney p by the normal form with tie and continuity terms.

    ``exact`` asks for the distribution itself: for few rows without ties, its table has a * b cells.
    """

    @F.pandas_udf(T.DoubleType())
    def p(u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([_rank_sum_p(*row, exact) for row in zip(u, a.astype(int), b.astype(int), ties)], dtype="float64")

    return p(u, a, b, ties)


def rank_sums(df: DataFrame, by: Sequence[str], side: str, value: str) -> DataFrame:
    """Sizes, means, U of the first sample (``side`` true) and tie term, per group.

    Ranks come from the histogram of values, so no group has to be sorted in one task.
    """
    first = F.col(side).cast("long")
    hist = average_ranks(grouped_histogram(df, by, value, {"n": F.count(F.lit(1)), "pre": F.sum(first)}))
    n, pre, v = F.col("n").cast("double"), F.col("pre"), F.col(value)
    sums = hist.groupBy(*by).agg(
        F.sum("pre").alias("n_pre"),
        F.sum(F.col("n") - pre).alias("n_post"),
        m.ratio(F.sum(v * pre), F.sum("pre")).alias("mean_pre"),
        m.ratio(F.sum(v * (F.col("n") - pre)), F.sum(F.col("n") - pre)).alias("mean_post"),
        F.sum(pre * F.col("avg_rank")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
    )
    return sums.withColumn("u", F.col("rank_sum") - F.col("n_pre") * (F.col("n_pre") + 1) / F.lit(2.0)).drop("rank_sum")


def in_contrasts(df: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """Rows of each contrast with the side they fall on; a row may serve several contrasts."""
    at = F.col("ts_local")
    within = lambda a, b: (at >= F.lit(a).cast("timestamp")) & (at < F.lit(b).cast("timestamp"))
    sides = [
        F.when(within(c.pre_start, c.pre_end), F.struct(F.lit(c.label).alias("contrast"), F.lit(True).alias("pre"))).when(
            within(c.post_start, c.post_end), F.struct(F.lit(c.label).alias("contrast"), F.lit(False).alias("pre"))
        )
        for c in contrasts
    ]
    return df.withColumn("_side", F.explode(F.array_compact(F.array(*sides)))).select("*", "_side.*").drop("_side")


def shift_tests(
    df: DataFrame, contrasts: Sequence[Contrast], *, value: str = POSITIVE, min_rows: int = SHIFT_MIN_ROWS
) -> DataFrame:
    """Did the value move across each boundary? All contrasts in one pass; small ones are left out."""
    sums = rank_sums(in_contrasts(df, contrasts).where(F.col(value).isNotNull()), ["contrast"], "pre", value)
    enough = sums.where((F.col("n_pre") >= min_rows) & (F.col("n_post") >= min_rows))
    return enough.select(
        "contrast",
        "n_pre",
        "n_post",
        F.round("mean_pre", 3).alias("mean_pre"),
        F.round("mean_post", 3).alias("mean_post"),
        F.round(F.col("mean_post") - F.col("mean_pre"), 3).alias("delta"),
        "u",
        F.round(rank_sum_p("u", "n_pre", "n_post", "ties"), 4).alias("mannwhitney_p"),
    )


def around_triggers(triggers: Sequence[tuple[str, str]], *, before: str, after: str) -> list[Contrast]:
    """Contrasts from a calendar of (label, local time): a stretch before and one after each."""
    out = []
    for label, at in triggers:
        t = pd.Timestamp(at)
        out.append(Contrast(label, str(t - pd.Timedelta(before)), str(t), str(t), str(t + pd.Timedelta(after))))
    return out


# ------------------------------------------------------------------------------ entities
def mentions_of(df: DataFrame, entities: dict[str, str] = ENTITIES) -> DataFrame:
    """One row per (record, entity whose pattern its lower-cased text holds); one scan for all patterns."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    hits = F.array_compact(F.array(*[F.when(F.col("_low").rlike(p), F.lit(n)) for n, p in entities.items()]))
    return df.withColumn("_low", text).withColumn("entity", F.explode(hits)).drop("_low")


def entity_counts(df: DataFrame, entities: dict[str, str] = ENTITIES) -> DataFrame:
    """Mentions per entity, those never mentioned with 0."""
    counted = mentions_of(df, entities).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, entities))).alias("entity"))
    return names.join(counted, "entity", "left").fillna(0, ["mentions"]).orderBy(F.desc("mentions"), "entity")


def entity_days(df: DataFrame, entities: dict[str, str] = ENTITIES) -> DataFrame:
    return mentions_of(df, entities).groupBy("entity", "date_local").agg(F.count(F.lit(1)).alias("mentions"))


# ------------------------------------------------------------------------------ provenance and fairness
def snowflake_time(post_id: Column) -> Column:
    return F.timestamp_millis(F.shiftright(post_id.try_cast("bigint"), 22) + SNOWFLAKE_EPOCH_MS)


def authentic(df: DataFrame, *, post_id: str = "post_id", stated: str = "created_at", tolerance_s: int = 300) -> DataFrame:
    """Rows whose id decodes to within the tolerance of the stated time; other ids are dropped."""
    numeric = F.col(post_id).rlike("^[0-9]+$")
    gap = F.abs(F.unix_millis(snowflake_time(F.col(post_id))) - F.unix_millis(F.col(stated)))
    return df.where(numeric & (gap <= tolerance_s * 1000))


def equal_slices(df: DataFrame, by: str, key: str, *, seed: int = SEED) -> DataFrame:
    """Every slice cut to the size of the smallest, by a seeded hash: the comparison's own rule."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    numbered = materialise(number_within(hashed, [by], ["_h", key], "_i", "_n"))
    least = numbered.agg(F.min("_n").alias("n")).scalar()
    return numbered.where(F.col("_i") <= least).drop("_h", "_i", "_n")
