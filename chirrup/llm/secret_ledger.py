"""Secret scans with an incremental ledger of blobs (DataFrame functions only).

Every version of every path is content-addressed; equal contents are one blob. The ledger says
which rule versions have seen which blob. A scan takes one row per blob, looks up what is still
unseen, applies just those rules, and appends the outcome; findings are then joined back to all
paths and versions that hold the blob. So a second scan of an unchanged history reads no content
by any pattern, and a new rule version reads each blob once.

Positions are found without Python: splitting a text at a pattern gives the pieces between matches,
extracting gives the matches; the lengths of both, in turn, give where each match starts.

Nulls and other cases: null content is the empty blob; repeated rows and copies share a blob, their
findings are returned for each row; null ids are paths like any other; empty tables give empty
results; columns other than the key and the content are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chirrup.llm.common import complete_parts, text_of
from chirrup.session import materialise, new_path


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are leftmost and do not overlap, and what they must fulfil.

    ``part`` and ``least``: a match counts if that group has so many characters. ``hint`` is a
    pattern that every text with a match fulfils, cheaper to try.
    """

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 0
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the contract, in the order in which kinds are listed.
BASE = (
    Rule(
        "assign",
        1,
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        part=2,
        least=6,
        hint=r"(?i)(?:passw|secret|token|api_?key)",
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),  # as long a run as there is: no shorter match can start inside
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: What the library adds to the base kinds.
MORE = (Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),)
RULES = BASE + MORE

FOUND = "array<struct<rule:string,at:long,until:long>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


def _matches(text: Column, rule: Rule) -> Column:
    """Spans of one rule: code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part)) if rule.least else whole
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    steps = F.arrays_zip(
        between.alias("gap"), F.transform(whole, lambda x: F.length(x).cast("long")).alias("len"), F.transform(part, lambda x: F.length(x).cast("long")).alias("own")
    )
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast(FOUND).alias("spans"))

    def step(acc, s):
        at = acc["end"] + s["gap"]
        until = at + F.coalesce(s["len"], F.lit(0))
        span = F.array(F.struct(F.lit(rule.name).alias("rule"), at.alias("at"), until.alias("until")))
        good = s["len"].isNotNull() & (s["own"] >= rule.least)
        return F.struct(until.alias("end"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, start, step)["spans"]


def blob_of(content: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(content), 256))


class Ledger:
    """Scanned (blob, rule version) pairs with their findings, appended to a folder of Parquet."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "secret-ledger")

    def table(self) -> DataFrame:
        """All finished batches, whoever wrote them."""
        done, _ = complete_parts(self.spark, self.path, "batch")
        return self.spark.read.schema(LEDGER).parquet(*done) if done else self.spark.createDataFrame([], LEDGER)

    def append(self, scanned: DataFrame) -> DataFrame:
        """Writes a batch and gives it back; one that fails is left out and its number not used again."""
        path = f"{self.path}/batch={complete_parts(self.spark, self.path, 'batch')[1]}"
        scanned.write.parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path)


def scan(history: DataFrame, key: str, content: str, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger has not seen of ``history``; returns the number of blobs read.

    Of each blob the row with the smallest key is read. Only keys and addresses are grouped; the
    contents meet the list of rows to be read by key and address, which no hot blob can skew.
    """
    seen = ledger.table().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
    rows = history.select(F.xxhash64(key).alias("_row"), blob_of(content).alias("_blob"))
    blobs = rows.groupBy("_blob").agg(F.min("_row").alias("_first"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    todo = (
        blobs.join(seen, F.col("_blob") == F.col("blob"), "left")
        .withColumn("_todo", F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>"))))
        .where(F.size("_todo") > 0)
        .select(F.col("_blob").alias("_b"), "_first", "_todo")
    )
    texts = history.select(F.xxhash64(key).alias("_row"), blob_of(content).alias("_blob"), text_of(content).alias("_text"))
    texts = texts.join(todo.hint("shuffle_hash"), (F.col("_row") == F.col("_first")) & (F.col("_blob") == F.col("_b")))
    texts = texts.dropDuplicates(["_row", "_blob"])  # rows that repeat key and content lie together after the join
    none = F.array().cast(FOUND)
    found = [
        F.when(F.array_contains("_todo", r.name) & F.col("_text").rlike(r.hint or r.pattern), _matches(F.col("_text"), r)).otherwise(none) for r in rules
    ]
    scanned = texts.select(F.col("_blob").alias("blob"), F.col("_todo").alias("rules"), F.concat(*found).alias("found"))
    return ledger.append(scanned).count()


def findings(history: DataFrame, key: str, content: str, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``history`` as (key, ``_blob``, ``found``): spans of the current rule versions.

    Most blobs hold nothing, so only those with findings are joined; the join has plain keys, and AQE
    splits a blob that very many paths hold.
    """
    names = [r.name for r in rules]
    hits = (
        ledger.table()
        .where(F.size("found") > 0)
        .select("blob", F.explode("found").alias("f"))
        .where(F.col("f.rule").isin(names))
        .distinct()  # two scans at a time may have read one blob
        .groupBy("blob")
        .agg(F.collect_list("f").alias("found"))
    )
    rows = history.select(key, blob_of(content).alias("_blob"))
    joined = rows.join(materialise(hits, "secret-hits"), F.col("_blob") == F.col("blob"), "left")
    return joined.select(key, "_blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def in_order(found: Column, kinds: tuple[str, ...]) -> Column:
    """Spans of these kinds as ``kind:start:end``, by start, then kind as listed, comma-joined."""
    places = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    kind = lambda s: F.substring_index(s["rule"], "@", 1)
    keyed = F.transform(
        F.filter(found, lambda s: kind(s).isin(*kinds)),
        lambda s: F.struct(s["at"].alias("at"), F.element_at(places, kind(s)).alias("place"), s["until"].alias("until"), kind(s).alias("kind")),
    )
    texts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string")))
    return F.array_join(texts, ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: F.substring_index(s["rule"], "@", 1) == kind)).cast("long")
