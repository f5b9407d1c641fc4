"""Change logs on storage: Parquet tables, JSON wire frames and JDBC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hlc as clocks
from ..functions import values

SCHEMA = f"space string, tbl string, row_id string, kind string, column string, value string, payload map<string,string>, cl_flag int, reason string, hlc {clocks.TYPE}"


def aligned(changes: DataFrame) -> DataFrame:
    """A log with all columns of ``SCHEMA``; missing ones are null."""
    have = set(changes.columns)
    wanted = [part.strip() for part in ("space string", "tbl string", "row_id string", "kind string", "column string", "value string", "payload map<string,string>", "cl_flag int", "reason string", f"hlc {clocks.TYPE}")]
    pairs = [w.split(" ", 1) for w in wanted]
    return changes.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in pairs])


def append(changes: DataFrame, path: str, batch_id: int) -> None:
    """Adds a batch to a log, partitioned by space and table so that scans prune; a batch written twice replaces itself."""
    spark = changes.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    rows = aligned(changes).withColumn("batch_id", F.lit(batch_id).cast("long"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("batch_id", "space", "tbl").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, batch_id long").parquet(path)


def encoded(changes: DataFrame, measure: Callable[[Column], Column] = values.utf16_length) -> DataFrame:
    """Wire frames: each change as JSON with its payload measure, by default in UTF-16 units."""
    text = F.to_json(F.struct(*changes.columns))
    return changes.withColumn("frame", text).withColumn("frame_chars", measure(F.col("frame")))


def decoded(frames: DataFrame, column: str = "frame") -> DataFrame:
    return frames.select(F.from_json(column, SCHEMA).alias("change")).select("change.*")


def table(spark: SparkSession, url: str, name: str, *, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A domain table over JDBC in parallel ranges of a numeric key."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)


def save_table(rows: DataFrame, url: str, name: str, *, mode: str = "append", batch_rows: int = 10_000, **options: str) -> None:
    """Writes a domain table over JDBC (S10), one connection and transaction per partition, in batches of rows."""
    rows.write.mode(mode).option("batchsize", batch_rows).jdbc(url, name, properties=options)


def raw(spark: SparkSession, text: str, **parameters: object) -> DataFrame:
    """A raw query with named parameters, never by pasting text."""
    return spark.sql(text, args=parameters)


