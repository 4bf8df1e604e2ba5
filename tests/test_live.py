import itertools
import math

import pytest
from pyspark.sql import functions as F

from chirrup.operators import evaluation as ev
from chirrup.plans import live
from chirrup.sources import files


def samples(spark, groups):
    return spark.createDataFrame([(g, side, float(v)) for g, a, b in groups for side, vs in ((True, a), (False, b)) for v in vs], "g string, pre boolean, v double")


def test_rank_sum_exact_branch(spark):
    df = samples(spark, [("x", range(1, 6), range(6, 11))])
    r = live.rank_sums(df, ["g"], "pre", "v").withColumn("p", live.rank_sum_p("u", "n_pre", "n_post", "ties", exact=True)).first()
    assert r.u == 0 and r.p == pytest.approx(2 / 252)


@pytest.mark.parametrize("a,b", [([1, 4, 6], [2, 3, 5, 7]), ([9, 8, 1, 2], [3, 4, 5, 6, 7])])
def test_rank_sum_exact_by_enumeration(a, b):
    u = sum((x > y) for x in a for y in b)
    big = max(u, len(a) * len(b) - u)
    everything = list(a) + list(b)
    hits = total = 0
    for pick in itertools.combinations(everything, len(a)):
        rest = [y for y in everything if y not in pick]
        hits += sum((x > y) for x in pick for y in rest) >= big
        total += 1
    assert live._rank_sum_p(u, len(a), len(b), 0, exact=True) == pytest.approx(min(1, 2 * hits / total))


def test_rank_sum_ties_use_the_normal_form(spark):
    a, b = [1, 1, 2, 2, 3] * 4, [2, 3, 3, 4, 4] * 4
    r = live.rank_sums(samples(spark, [("t", a, b)]), ["g"], "pre", "v").withColumn("p", live.rank_sum_p("u", "n_pre", "n_post", "ties")).first()
    n, m = len(a), len(b)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(c**3 - c for c in (sum(v == w for w in a + b) for v in sorted(set(a + b))))
    sd = math.sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1))))
    assert r.u == u and r.p == pytest.approx(math.erfc((max(u, n * m - u) - n * m / 2 - 0.5) / sd / math.sqrt(2)))


def test_mcnemar(spark):
    rows = [("a", "a", "b")] + [("a", "b", "a")] * 6 + [("a", "a", "a")] * 3
    r = ev.mcnemar(spark.createDataFrame(rows, "true string, pred string, pred_b string")).first()
    assert (r.b_a_right_b_wrong, r.c_a_wrong_b_right) == (1, 6) and r.p_value == pytest.approx(0.125)


@pytest.mark.parametrize("counts,found", [([10] * 9 + [100], 1), ([7] * 10, 0)])
def test_spikes(spark, counts, found):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "hour_local int, n bigint")
    out = live.spikes(df).collect()
    assert len(out) == found and (not found or out[0].z == 2.85)


def test_window_is_closed_and_split_is_live(spark):
    # display zone is five and a half hours ahead
    times = ["2026-09-12 18:30:00", "2026-09-12 18:29:59", "2026-09-22 15:00:00", "2026-09-22 15:00:01", None, "2026-09-19 18:30:00", "2026-09-19 18:29:59"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").select("i", F.to_timestamp("t").alias("created_at"))
    assert {r.i: r.arc for r in live.tagged(df).collect()} == {0: "retro", 2: "live", 5: "live", 6: "retro"}


def test_shift_windows(spark):
    rows = [("2024-01-01 09:00:00", 0.1)] * 4 + [("2024-01-01 10:00:00", 0.9)] * 9 + [("2024-01-01 11:00:00", 0.5)]
    df = spark.createDataFrame(rows, "t string, p double").select(F.to_timestamp("t").alias("ts_local"), F.col("p").alias(live.POSITIVE))
    c = live.Contrast("x", "2024-01-01 09:00:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00", "2024-01-01 11:00:00")
    assert live.shift_tests(df, [c]).count() == 0  # four rows before
    r = live.shift_tests(df.union(df.limit(1)), [c]).first()
    assert (r.n_pre, r.n_post, r.delta) == (5, 9, 0.8)


def test_authenticity_gate(spark):
    rows = [("2102292694378987723", "2026-09-22 07:03:31"), ("2102292694378987723", "2026-09-22 07:20:00"), ("ag_1", "2026-09-22 07:03:31")]
    df = spark.createDataFrame(rows, "post_id string, t string").select("post_id", F.to_timestamp("t").alias("created_at"))
    assert live.authentic(df).count() == 1


def test_first_copy_wins(spark):
    rows = [("a", "2", "late"), ("a", "1", "first"), ("b", "1", "only")]
    df = spark.createDataFrame(rows, "record_id string, sweep_id string, text string").withColumn("collected_at", F.col("sweep_id").cast("int"))
    assert {r.record_id: r.text for r in files.first_per_record(df).collect()} == {"a": "first", "b": "only"}
    assert [r.record_id for r in live.new_records(df, df.where("record_id = 'a'")).collect()] == ["b"]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    from chirrup.sources.star_adapter import StarSchema
    from chirrup.streaming import sweeps
    from compare import SMALL

    log = StarSchema(spark, SMALL).event_log.drop("prob_sentiment_Positive", "prob_sentiment_Negative").withColumn("arc", F.lit(None).cast("string"))
    landing = str(tmp_path / "landing")
    for part in range(3):
        files.append_events(log.where(F.pmod(F.xxhash64("record_id", "sweep_id"), F.lit(3)) == part).coalesce(1), landing)
    stream = sweeps.deduplicated(sweeps.read_landing(spark, landing, files_per_batch=1))
    query = sweeps.write_counts(sweeps.hourly_counts(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    streamed = {(r.hour, r.kind): r.n for r in sweeps.current_counts(spark, str(tmp_path / "out")).collect()}
    batch = files.first_per_record(log).where("created_at is not null").groupBy(F.date_trunc("hour", "created_at").alias("hour"), live.kind(F.col("source")).alias("kind")).count()
    assert streamed == {(r.hour, r.kind): r["count"] for r in batch.collect()}


def test_monitor_reads_no_more_as_batches_add_up(spark, tmp_path):
    """Totals after many sweeps are those of the whole log, late records and null stamps included."""
    from chirrup.sources.star_adapter import StarSchema
    from chirrup.streaming import sweeps
    from compare import SMALL

    log = StarSchema(spark, SMALL).event_log.drop("prob_sentiment_Positive", "prob_sentiment_Negative").withColumn("arc", F.lit(None).cast("string"))
    log = log.withColumn("created_at", F.when(F.pmod(F.xxhash64("record_id"), F.lit(7)) > 0, F.col("created_at")))
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    batches = 12
    for part in range(batches):
        files.append_events(log.where(F.pmod(F.xxhash64("record_id", "sweep_id"), F.lit(batches)) == part).coalesce(1), landing)
    stream = sweeps.deduplicated(sweeps.read_landing(spark, landing, files_per_batch=1))
    sweeps.monitor(stream, out, str(tmp_path / "mark"), z=1.5).awaitTermination()
    last = spark.read.parquet(f"{out}/sweeps").agg(F.max("batch")).first()[0]
    assert last >= batches - 1
    hour = F.date_trunc("hour", live.local_time(F.col("created_at"))).alias("hour_local")
    hourly = files.first_per_record(log).where("created_at is not null").groupBy(hour).agg(F.count(F.lit(1)).alias("n"))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(sweeps.hourly_totals(spark, out, last).select("hour_local", "n")) == as_set(hourly)
    assert as_set(spark.read.parquet(f"{out}/spikes/sweep={last}")) == as_set(live.spikes(hourly, z=1.5))
    read = [len(sweeps.hourly_totals(spark, out, b).inputFiles()) for b in range(last + 1)]
    assert max(read) == read[0] == 1


def test_watermarked_dedup_runs(spark, tmp_path):
    from chirrup.sources.star_adapter import StarSchema
    from chirrup.streaming import sweeps
    from compare import SMALL

    log = StarSchema(spark, SMALL).event_log.drop("prob_sentiment_Positive", "prob_sentiment_Negative").withColumn("arc", F.lit(None).cast("string"))
    files.append_events(log.coalesce(1), str(tmp_path / "landing"))
    stream = sweeps.deduplicated(sweeps.read_landing(spark, str(tmp_path / "landing")), lateness="60 days")
    sweeps.write_log(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == kept.select("record_id").distinct().count() > 0


def test_written_values_can_differ_from_recomputed_ones(spark, tmp_path):
    from compare import SMALL
    from registry import learning
    from registry.core import on

    def spoilt(s):
        spark.createDataFrame([("accuracy", 0.5), ("f1_macro", -1.0)], "metric string, value double").write.parquet(f"file://{tmp_path}/metrics")
        return f"file://{tmp_path}/metrics"

    assert not any(r["agrees"] for r in on(lambda s: learning._stored(s, spoilt))(spark, SMALL).collect())
    assert all(r["agrees"] for r in on(learning._stored)(spark, SMALL).collect())


def test_both_feature_tables_are_written(spark):
    from compare import SMALL
    from registry import monitoring
    from registry.core import on

    columns = []

    def look(s):
        folder = monitoring._feature_tables(s)
        columns.extend(set(spark.read.parquet(f"{folder}/{t}").columns) for t in ("posts_with_features", "user_features"))
        return s.posts

    on(look)(spark, SMALL)
    assert {"post_id", "text_content", "engagement", "hashtags", "sentiment", "sentiment_label"} <= columns[0]
    assert {"user_id", "posts", "total_eng", "mean_eng", "engagement_rate", "age_days_at_start"} <= columns[1]
