"""Readers and writers with fixed schemas: nothing is inferred, nothing is coerced on read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chirrup.functions import metrics as m
from chirrup.functions.strings import strip
from chirrup.operators.ranking import global_row_number

RAW_POSTS = ("post_id", "user_id", "platform", "text_content", "timestamp", "likes", "shares", "comments")
RAW_USERS = ("user_id", "location", "language", "account_created", "follower_count")
LABELLED = ("text_id", "post_text", "sentiment_label", "topic_category")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("engagement", T.MapType(T.StringType(), T.LongType())),
        T.StructField("sweep_id", T.StringType()),
        T.StructField("sweep_mode", T.StringType()),
        T.StructField("arc", T.StringType()),
        T.StructField("scope", T.StringType()),
    ]
)
SWEEP_SCHEMA = T.StructType(
    [
        T.StructField("sweep_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("new_records", T.LongType()),
        T.StructField(
            "outcomes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source", T.StringType()),
                        T.StructField("term", T.StringType()),
                        T.StructField("http", T.StringType()),  # a status code or an error name
                        T.StructField("records", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)


def _strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_strings(spark: SparkSession, path: str, columns) -> DataFrame:
    """CSV as pure strings: a blank stays a blank, 'NULL' stays a word, quotes may span lines."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    if set(header) != set(columns):
        raise ValueError(f"expected the columns {list(columns)}, found {header}")
    rows = (
        spark.read.schema(_strings(header))
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return rows.fillna("").select(*columns)


def write_strings(df: DataFrame, path: str) -> None:
    """CSV that ``read_strings`` reads back cell by cell: quotes doubled, white space kept."""
    plain = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**plain).csv(path)


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    return read_strings(spark, path, RAW_POSTS)


def read_raw_users(spark: SparkSession, path: str) -> DataFrame:
    return read_strings(spark, path, RAW_USERS)


def with_row_no(df: DataFrame, name: str = "row_no") -> DataFrame:
    """1-based position in file order; an identifier, never an analytic key."""
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    return global_row_number(placed, ["_file", "_block", "_id"], name).select(name, *df.columns)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled text with exactly the four expected columns, every cell stripped."""
    rows = read_strings(spark, path, LABELLED)
    return rows.select(*[strip(F.col(c)).alias(c) for c in LABELLED])


def write_split(split: DataFrame, path: str) -> None:
    split.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part only: the other one's files are pruned."""
    return spark.read.parquet(path).where(F.col("split") == part)


# ------------------------------------------------------------------------------ event log
def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.select(*[f.name for f in EVENT_SCHEMA]).write.mode("append").json(path)


def first_per_record(df: DataFrame, key: str = "record_id") -> DataFrame:
    """The earliest collected copy of each record; copies combine map-side."""
    columns = [c for c in df.columns if c != key]
    earliest = F.min_by(F.struct(*columns), F.struct("collected_at", "sweep_id"))
    return df.groupBy(key).agg(earliest.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


ENGAGEMENT_KEYS = ("reblogs", "favourites", "replies", "points", "comments")


def flat_export(events: DataFrame) -> DataFrame:
    """One row per record with the engagement map spread over columns."""
    e = F.col("engagement")
    return first_per_record(events).select(
        "record_id", "source", "author", "title", "text", "url", "lang", "created_at", "collected_at", "arc", "scope",
        *[F.try_element_at(e, F.lit(k)).alias(f"engagement_{k}") for k in ENGAGEMENT_KEYS],
        "sweep_id", "sweep_mode",
    )


# ------------------------------------------------------------------------------ deliverables
def write_intake(intake, users: DataFrame, folder: str) -> None:
    """Analysis posts as Parquet (by month) and JSON, users, held-out rows and repair log as CSV."""
    intake.analysis.write.mode("overwrite").partitionBy("post_month").parquet(f"{folder}/posts")
    intake.analysis.write.mode("overwrite").json(f"{folder}/posts_json")
    users.write.mode("overwrite").parquet(f"{folder}/users")
    write_strings(intake.held_out, f"{folder}/held_out")
    write_strings(intake.log, f"{folder}/repair_log")


def bundle(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes all tables side by side and returns their row counts, read from what was written."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    counts = [
        spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name in tables
    ]
    return reduce(DataFrame.unionByName, counts)


def write_features(posts: DataFrame, users: DataFrame, folder: str) -> None:
    posts.write.mode("overwrite").partitionBy("post_month").parquet(f"{folder}/posts_with_features")
    users.write.mode("overwrite").parquet(f"{folder}/user_features")


# ------------------------------------------------------------------------------ loading
def analysis_posts(clean: DataFrame) -> DataFrame:
    """Repaired posts under the names of the analysis tables, with the clock guard ``has_time``."""
    return clean.select(
        "post_id",
        "user_id",
        "platform",
        "text_content",
        F.col("timestamp").alias("posted_at"),
        "post_date",
        "post_month",
        "post_hour",
        "weekday",
        F.col("is_weekend").cast("long").alias("is_weekend"),
        F.col("timestamp_format").isin("iso8601", "epoch_seconds").cast("long").alias("has_time"),
        "likes",
        "shares",
        "comments",
        F.col("flag_likes_sign_restored").cast("long").alias("likes_restored"),
        F.col("flag_ambiguous_date_format").cast("long").alias("date_flagged"),
    )


def require_known_users(posts: DataFrame, users: DataFrame) -> None:
    orphans = posts.select("user_id").distinct().join(users.select("user_id"), "user_id", "left_anti").count()
    if orphans:
        raise ValueError(f"posts refer to {orphans} unknown users")


# ------------------------------------------------------------------------------ manual collections
def manual_reactions(df: DataFrame, *, scope: str, source: str = "x_manual") -> DataFrame:
    """Hand-collected reactions in the event-log layout, counts kept in the engagement map."""
    keys = ("likes", "reposts", "replies", "views")
    return df.select(
        F.concat(F.lit(f"{source}:"), F.col("post_id").cast("string")).alias("record_id"),
        F.lit(source).alias("source"),
        F.col("username").alias("author"),
        F.lit(None).cast("string").alias("title"),
        F.col("statement").alias("text"),
        F.col("post_url").alias("url"),
        F.lit("en").alias("lang"),
        F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.map_from_arrays(
            F.array(*map(F.lit, keys)), F.array(*[F.col(k).try_cast("bigint") for k in keys])
        ).alias("engagement"),
        F.lit(scope).alias("scope"),
        F.col("post_id").cast("string").alias("post_id"),
    )


def merge_collections(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_source_registry(spark: SparkSession, path: str) -> DataFrame:
    columns = (
        "platform", "source_id", "source_url", "source_title_or_caption", "author_or_channel", "sport", "event_name",
        "source_timestamp", "records_collected",
    )
    rows = read_strings(spark, path, columns)
    return rows.withColumn("records_collected", F.col("records_collected").try_cast("bigint"))


def column_counts(df: DataFrame) -> DataFrame:
    """Rows and non-null values per column of a written table."""
    sums = df.agg(F.count(F.lit(1)).alias("_rows"), *[m.count_where(F.col(c).isNotNull()).alias(c) for c in df.columns])
    return sums.unpivot(["_rows"], df.columns, "column", "known").withColumnRenamed("_rows", "rows")
