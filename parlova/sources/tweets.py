"""Reading the raw message table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlova.functions.ids import normalize_flag, parse_created_at
from parlova.schemas import TWEET_COLUMNS, validate_columns


def normalize_tweets(df: DataFrame) -> DataFrame:
    """Check columns, make ``inbound`` boolean, add ``created_at_parsed``.

    ``ingest_seq`` (row order, used by keep-first and keep-last rules) is kept
    if present and taken from the read order otherwise.
    """
    validate_columns(df, TWEET_COLUMNS)
    if "ingest_seq" not in df.columns:
        df = df.withColumn("ingest_seq", F.monotonically_increasing_id())
    return df.withColumns(
        {
            "inbound": normalize_flag(F.col("inbound")),
            "created_at_parsed": parse_created_at(F.col("created_at")),
        }
    )


def read_tweets_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan a CSV file, folder or glob, every column as text, by the names in the header.

    Columns may be in any order and more than the required ones; a missing one raises
    ``SchemaError`` before anything is read. All files of a folder share one header, which
    the reader checks. ``ingest_seq`` numbers rows by file name and then as they stand in the
    file, however Spark packs files into tasks.

    Quoted line breaks force multiLine, which reads one file per task; convert
    to Parquet once with ``sources.tables.write_table`` before repeated use.
    Unlike a single-file reader, a folder is read whole. An empty field is null;
    words such as NA or nan stay text.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    # Without schema inference only the header is looked at: all columns are text.
    header = spark.read.options(**options, inferSchema=False).csv(path)
    validate_columns(header, TWEET_COLUMNS)
    rows = spark.read.schema(header.schema).options(**options, enforceSchema=False, mode="FAILFAST").csv(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    # One row per file: its place in the order of names. A file is one task, in which the
    # row numbers ascend.
    files = placed.select("_file").distinct()
    numbered = files.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("bigint").alias("_number"))
    within = F.col("_row").bitwiseAND(F.lit(2**33 - 1))
    return (
        placed.join(F.broadcast(numbered), "_file")
        .withColumn("ingest_seq", F.shiftleft(F.col("_number"), 33) + within)
        .drop("_file", "_row", "_number")
    )


def write_tweets_csv(df: DataFrame, path: str) -> str:
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def bad_timestamp_count(tweets: DataFrame) -> DataFrame:
    return tweets.agg(F.count_if(F.col("created_at_parsed").isNull()).alias("n_bad_timestamps"))


def limited(df: DataFrame, order_cols: list[str], n: int) -> DataFrame:
    """Row-capped load in a stated order."""
    return df.orderBy(*order_cols).limit(n)
