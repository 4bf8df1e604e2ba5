"""Exact global ranks without gathering the rows into one task.

``ROW_NUMBER() OVER (ORDER BY ...)`` without a partition clause moves every row to a
single task. Here the rows are range-partitioned on a *total* order, numbered inside
their range, and shifted by the number of rows in the ranges before theirs. The ranges
are written to the shared folder once: their bounds are sampled, so the offsets and the
rows must come from the same run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chirrup.session import materialise

_SLICE, _POS = "_slice", "_pos"
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the partition above these bits


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` cut into ordered ranges, with the range (``_slice``) and the place in it (``_pos``)."""
    keys = _columns(order)
    return materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SLICE, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(_ROW_BITS) + 1)
    )


def _offsets(ranged: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per range: what the earlier ranges hold (``<name>_before``) and what all hold (``<name>_all``).

    One row per range, that is per shuffle partition, hence small enough to broadcast.
    """
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sums = ranged.groupBy(_SLICE).agg(*[agg.alias(name) for name, agg in totals.items()])
    return sums.select(
        _SLICE,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in totals],
        *[F.sum(n).over(everything).alias(f"{n}_all") for n in totals],
    )


def global_row_number(
    df: DataFrame, order: Sequence[Column | str], name: str = "rn", total: str | None = None
) -> DataFrame:
    """Number all rows 1..n along ``order`` (which must be total); ``total`` also adds n."""
    ranged = in_ranges(df, order)
    offsets = _offsets(ranged, {"n": F.count(F.lit(1))})
    out = ranged.join(F.broadcast(offsets), _SLICE).withColumn(name, F.col("n_before") + F.col(_POS))
    if total:
        out = out.withColumn(total, F.col("n_all"))
    return out.select(*df.columns, name, *([total] if total else []))


def ntile_of(rn: Column, n: Column, buckets: int) -> Column:
    """SQL's NTILE from a row number: the first ``n mod k`` buckets get one row more."""
    size = F.floor(n / buckets)
    extra = n % buckets
    wide = extra * (size + 1)
    return F.when(rn <= wide, F.ceil(rn / (size + 1))).otherwise(
        extra + F.ceil((rn - wide) / F.greatest(size, F.lit(1)))
    ).cast("long")


def global_ntile(
    df: DataFrame, buckets: int, order: Sequence[Column | str], name: str = "bucket"
) -> DataFrame:
    numbered = global_row_number(df, order, "_rn", "_n")
    return numbered.withColumn(name, ntile_of(F.col("_rn"), F.col("_n"), buckets)).drop("_rn", "_n")


def running_totals(
    df: DataFrame, order: Sequence[Column | str], sums: Sequence[str]
) -> DataFrame:
    """Inclusive running sums ``<column>_cum`` along a total order, and grand totals ``<column>_all``."""
    ranged = in_ranges(df, order)
    offsets = _offsets(ranged, {s: F.sum(s) for s in sums})
    inside = (
        Window.partitionBy(_SLICE).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = ranged.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    out = out.join(F.broadcast(offsets), _SLICE)
    return out.select(
        *df.columns,
        *[(F.col(f"{s}_before") + F.col(f"_in_{s}")).alias(f"{s}_cum") for s in sums],
        *[F.col(f"{s}_all") for s in sums],
    )


def grouped_histogram(
    df: DataFrame, by: Sequence[str], value: str, counts: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values of each group with their row counts, running within the group.

    Adds ``n`` (rows with this value), ``n_cum`` (rows up to and including it) and
    ``n_all`` (rows of the group). Groups may be of any size: the running sum is taken
    over all groups at once and the group's own start is subtracted.
    """
    counts = counts or {"n": F.count(F.lit(1))}
    names = list(counts)
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[c.alias(n) for n, c in counts.items()])
    )
    if not by:
        return running_totals(hist, [value], names)
    ranged = in_ranges(hist, [*by, value])
    inside = Window.partitionBy(_SLICE, *by).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.select("*", *[F.sum(n).over(inside).alias(f"_in_{n}") for n in names])
    joined = _with_group_parts(run, by, _group_parts(ranged, by, {n: F.sum(n) for n in names}))
    return joined.select(
        *by,
        value,
        *names,
        *[(F.col(f"{n}_before") + F.col(f"_in_{n}")).alias(f"{n}_cum") for n in names],
        *[F.col(f"{n}_all") for n in names],
    )


def _group_parts(ranged: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per range and group: where the group starts in the range, what of it earlier ranges hold, and its whole.

    As many rows as ranges and groups together, whatever the size of a group.
    """
    along = Window.partitionBy(*by).orderBy(_SLICE)
    earlier, whole = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = ranged.groupBy(_SLICE, *by).agg(F.min(_POS).alias("_first"), *[agg.alias(f"_t_{n}") for n, agg in totals.items()])
    return sums.select(
        F.col(_SLICE).alias("_of"),
        *[F.col(b).alias(f"_by_{b}") for b in by],
        "_first",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"{n}_before") for n in totals],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in totals],
    )


def _with_group_parts(rows: DataFrame, by: Sequence[str], parts: DataFrame) -> DataFrame:
    """Joins on range and group: a hot group is spread over its ranges."""
    same = F.col(_SLICE) == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return rows.join(parts, same)


def average_ranks(hist: DataFrame, count: str = "n") -> DataFrame:
    """Mid-rank of each distinct value, from a histogram with running counts."""
    return hist.withColumn(
        "avg_rank", F.col(f"{count}_cum") - (F.col(count).cast("double") - 1.0) / 2.0
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per group, array ``q``.

    Works on value histograms, so that neither a huge group nor a wide value domain has
    to fit into the memory of one task.
    """
    hist = grouped_histogram(df, by, value)
    probes = F.array(*[F.lit(float(p)) for p in probabilities])
    place = F.transform(
        probes,
        lambda p: F.struct(
            p.alias("p"),
            F.floor(p * (F.col("n_all") - 1)).alias("lo"),
            (p * (F.col("n_all") - 1) - F.floor(p * (F.col("n_all") - 1))).alias("part"),
        ),
    )
    start = F.col("n_cum") - F.col("n")
    touched = (
        hist.withColumn("_probe", F.explode(place))
        .withColumn("_low", (F.col("_probe.lo") >= start) & (F.col("_probe.lo") < F.col("n_cum")))
        .withColumn(
            "_high",
            (F.col("_probe.part") > 0)
            & (F.col("_probe.lo") + 1 >= start)
            & (F.col("_probe.lo") + 1 < F.col("n_cum")),
        )
        .where(F.col("_low") | F.col("_high"))
    )
    picked = touched.groupBy(*by, F.col("_probe.p").alias("p"), F.col("_probe.part").alias("part")).agg(
        F.max(F.when(F.col("_low"), F.col(value).cast("double"))).alias("lo"),
        F.max(F.when(F.col("_high"), F.col(value).cast("double"))).alias("hi"),
    )
    exact = picked.withColumn(
        "v", F.col("lo") + F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)) * F.col("part")
    )
    # as many rows per group as there are probabilities
    rows = exact.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("_pv"))
    return rows.select(*by, F.transform("_pv", lambda s: s["v"]).alias("q"))


def number_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rn", total: str | None = None
) -> DataFrame:
    """Row number inside each group, for groups too large for one task.

    Rows are cut into ranges over (group, order) and written once; a row's number is its place
    in its group's part of the range, after what earlier ranges hold of the group.
    """
    ranged = in_ranges(df, [*by, *order])
    out = _with_group_parts(ranged, by, _group_parts(ranged, by, {"_n": F.count(F.lit(1))}))
    out = out.withColumn(name, F.col("_n_before") + F.col(_POS) - F.col("_first") + 1)
    if total:
        out = out.withColumn(total, F.col("_n_all"))
    return out.select(*df.columns, name, *([total] if total else []))
