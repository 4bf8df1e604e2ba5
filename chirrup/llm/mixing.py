"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source gets a target number of words. A document's expected copies are target / size of its
source: the whole part is allocated to every document, the rest is sampled with unequal inclusion
probabilities ``p = min(1, c * x)``. ``x`` is one over the root of the document's size, so that the
words expected of a document grow with the root of its size and a few long ones do not fill a
source's share; ``relative`` gives another ``x``. ``c`` is the number, one per source, for which
the words expected of the sample are the words asked for; documents that reach ``p = 1`` are
certain and come first. The others are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of id and seed, and taken in that order until
the words asked for are reached; the document on the border is taken if that comes nearer. So the
sample has a fixed size in words; rates of inclusion are ``p`` up to the share of the border document.

Nothing is gathered per source. ``c`` comes from words summed by (source, x): in the order of
falling ``x`` the certain ones are a beginning, found by two running sums. Distinct sizes number at
most the root of twice a source's words; a ``relative`` of the caller is rounded to some sixty
steps per doubling. Ranks are cut into ``BINS`` equal parts of (0, 1); words are summed by (source,
bin), the bin in which a source's target falls is found from these sums, and only rows of that one
bin are put in order. The outcome is one threshold per source, which every document is compared
with where it stands: texts are never shuffled.

Nulls and other cases: a null text has size 0; a null source is a source of its own, last in the
order; rows without id draw by their text; repeated rows share one random number and are taken or
left together; sources without words have target 0; empty tables give empty results; other columns are
carried along by ``mixed`` and may have any name not starting with ``_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chirrup.llm.common import WORDS, sized_side, text_of
from chirrup.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BINS = 4096
SEED = "mix-1"


def words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORDS)).cast("long")


def uniform(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the seed and the id only, or on the text where the id is null."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null|"), F.md5(text_of().cast("binary"))))
    digest = F.md5(F.concat_ws("|", F.lit(seed), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight, none above ``most`` times its source's size.

    The windows run over one row per source. In the order of cap / weight the sources that stop at
    their cap come first; the level at the first one that does not holds for the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    full = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = full.withColumn("at", level).withColumn("rank", F.row_number().over(by_level))
    open_ = F.when(F.col("cap") / F.col("w") > F.col("at"), F.struct("rank", "at"))
    return levelled.withColumn("level", F.min(open_).over(everything)["at"]).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target")
    )


def _propensity(size: Column, relative: Column | None) -> Column:
    """What inclusion probabilities are proportional to, up to 1."""
    if relative is None:
        return 1.0 / F.sqrt(F.greatest(size, F.lit(1)).cast("double"))
    return F.pow(F.lit(2.0), F.round(F.log2(relative) * 64) / 64)


def _rank(u: Column, x: Column, c: Column) -> Column:
    """Random odds over inclusion odds, brought into 0 (certain) to 1 (never)."""
    p = F.least(F.lit(1.0), x * c)
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def scales(levels: DataFrame, aims: DataFrame) -> DataFrame:
    """(s, c): ``c`` of each source, from the words of each (source, x) and the words the sample is to have.

    With the ``x`` above taken for certain, ``c`` is what is left of the aim over the sum of words
    times ``x`` of the others; the largest ``x`` that stays below 1 by it ends the certain ones.
    """
    aim = sized_side(aims.select(F.col("source").alias("s"), "rest"), 64)
    falling, rising = Window.partitionBy("source").orderBy(F.desc("x")), Window.partitionBy("source").orderBy("x")
    upto = levels.join(aim, F.col("source").eqNullSafe(F.col("s"))).select(
        "s",
        "x",
        (F.col("rest") - (F.sum("words").over(falling) - F.col("words"))).alias("left"),
        F.sum(F.col("words") * F.col("x")).over(rising).alias("others"),
    )
    scaled = upto.withColumn("c", F.coalesce(F.try_divide("left", "others"), F.lit(0.0)))
    return scaled.where(F.col("x") * F.col("c") < 1).groupBy("s").agg(F.max_by("c", "x").alias("c"))


def thresholds(docs: DataFrame, *, relative: Column | None = None, seed: str = SEED, **shares) -> DataFrame:
    """One row per source: its size and target, the whole copies, ``c``, and the last rank that the sample takes.

    ``relative`` (positive; default: one over the root of the size) is what a document's inclusion
    probability is proportional to within its source.
    """
    rows = materialise(
        docs.select(
            "source",
            F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"),
            words().alias("size"),
            uniform("doc_id", seed).alias("u"),
            (relative if relative is not None else F.lit(1.0)).alias("relative"),
        ).withColumn("x", _propensity(F.col("size"), F.col("relative") if relative is not None else None)).drop("relative"),
        "mix-rows",
    )
    levels = materialise(rows.groupBy("source", "x").agg(F.sum("size").alias("words")), "mix-levels")
    aims = targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    aims = aims.withColumn("whole", F.floor(F.try_divide("target", "source_size"))).fillna({"whole": 0})
    aims = materialise(aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-aims")
    scale = materialise(scales(levels, aims), "mix-scales")
    ranked = rows.join(sized_side(scale, 64), F.col("source").eqNullSafe(F.col("s")), "left")
    rows = ranked.select("source", "id", "size", _rank(F.col("u"), F.col("x"), F.coalesce("c", F.lit(0.0))).alias("v"))
    rows = rows.withColumn("bin", F.floor(F.col("v") * BINS).cast("int"))
    sums = materialise(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    aim = sized_side(aims.select(F.col("source").alias("s"), "rest"), 64)
    running = Window.partitionBy("source").orderBy("bin")  # at most BINS + 1 rows
    cut = (
        sums.join(aim, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("upto", F.sum("words").over(running))
        .where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("c"))
        .select(F.col("source").alias("s"), F.col("c.bin").alias("cut"), "c.before", "c.rest")
    )
    cut = materialise(cut, "mix-cuts")
    inside = rows.join(sized_side(cut, 64), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut")))
    so_far = Window.partitionBy("source").orderBy("v", "id", "size").rowsBetween(Window.unboundedPreceding, 0)  # rows of one bin
    last = (
        inside.withColumn("upto", F.col("before") + F.sum("size").over(so_far))
        .where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max(F.struct("v", "id", "size")).alias("last"))
        .select(F.col("source").alias("s2"), "last")
    )
    return (
        aims.join(cut.select("s", "cut"), F.col("source").eqNullSafe(F.col("s")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("s2")), "left")
        .join(scale.select(F.col("s").alias("s3"), "c"), F.col("source").eqNullSafe(F.col("s3")), "left")
        .select(
            "source", "source_size", "target", F.col("whole").cast("int").alias("whole"),
            F.coalesce("c", F.lit(0.0)).alias("c"), F.coalesce("cut", F.lit(0)).alias("cut"), "last",
        )
    )


def mixed(docs: DataFrame, *, relative: Column | None = None, seed: str = SEED, **shares) -> DataFrame:
    """``docs`` (doc_id, text, source and more) with ``_mix``: size, source_size, target, copies, taken."""
    found = materialise(
        thresholds(docs, relative=relative, seed=seed, **shares).select(
            F.col("source").alias("_mix_source"), F.struct("source_size", "target", "whole", "c", "cut", "last").alias("_mix_aim")
        ),
        "mix-thresholds",
    )
    rows = docs.withColumn("_mix_size", words()).withColumn("_mix_x", _propensity(F.col("_mix_size"), relative))
    rows = rows.withColumn("_mix_u", uniform("doc_id", seed))
    rows = rows.join(sized_side(found, 128), F.col("source").eqNullSafe(F.col("_mix_source")), "left")
    rows = rows.withColumn("_mix_v", _rank(F.col("_mix_u"), F.col("_mix_x"), F.col("_mix_aim.c")))
    aim, bin_ = F.col("_mix_aim"), F.floor(F.col("_mix_v") * BINS)
    own = F.struct(F.col("_mix_v").alias("v"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.col("_mix_size").alias("size"))
    more = (bin_ < aim["cut"]) | ((bin_ == aim["cut"]) & F.coalesce(own <= aim["last"], F.lit(False)))
    rows = rows.withColumn("_mix_copies", aim["whole"] + F.when(more, 1).otherwise(0))
    return rows.select(
        *docs.columns,
        F.struct(
            F.col("_mix_size").alias("size"),
            aim["source_size"].alias("source_size"),
            aim["target"].alias("target"),
            F.col("_mix_copies").alias("copies"),
            (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"),
        ).alias("_mix"),
    )
