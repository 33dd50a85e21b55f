"""Readers and writers: feed trees, timetable files, streams of messages, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stopwise.sources.feeds import MESSAGE_DDL, alerts, trip_updates, vehicle_positions

# Timetable files and the columns that are read from each (all as text).
TIMETABLE = {
    "agency": ("agency_id", "agency_name"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"),
    "trips": ("trip_id", "route_id", "service_id", "direction_id", "trip_headsign", "shape_id", "wheelchair_accessible", "bikes_allowed"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station", "platform_code", "wheelchair_boarding"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type", "drop_off_type"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date"),
    "shapes": ("shape_id", "shape_dist_traveled"),
    "transfers": ("from_stop_id", "to_stop_id"),
}


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Visible entries of one folder (not below it), through the file system the path belongs to."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(e.getPath().toString() for e in fs.listStatus(root) if e.getPath().getName()[0] not in "._")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def evenly_spaced(items: Sequence[str], n: int | None) -> list[str]:
    """At most ``n`` of the sorted items, spread over the whole list (first and last included)."""
    items = sorted(items)
    if n is None or n >= len(items):
        return items
    if n == 1:
        return [items[0]]
    return [items[int(i * (len(items) - 1) / (n - 1))] for i in range(n)]


def _parquet(spark: SparkSession, schema: StructType | str | None = None):
    """Reader of all parquet files below a folder; without a declared schema Spark's job merges those of the files."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)


def read_parquet_files(spark: SparkSession, folder: str, max_files: int | None = None, schema: StructType | str | None = None) -> DataFrame | None:
    """All parquet files below a folder, or an evenly spaced choice of at most ``max_files`` of them; columns are matched by name.

    With a ``schema`` no footer is opened before the job, a column that a file lacks is null there, and others stay out.
    Without files: None, or an empty table of the schema.  The choice is made from the paths of Spark's own file index.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], schema) if schema is not None else None
    if max_files is None and schema is not None:
        return _parquet(spark, schema).parquet(folder)
    # One declared column: the index is enough to know the paths, no footer is read.
    index = _parquet(spark, schema if schema is not None else "_none int").parquet(folder)
    paths = index.inputFiles() if max_files is not None else index.inputFiles()[:1]
    if not paths:
        return index if schema is not None else None
    return _parquet(spark, schema).parquet(*(evenly_spaced(paths, max_files) if max_files is not None else [folder]))


def feed_kind(path_name):
    """Feed a file belongs to, from its name; vehicle positions by default."""
    name = F.lower(path_name)
    return (F.when(name.contains("vehicle") | name.contains("position"), "vehicle_positions")
            .when(name.contains("trip") | name.contains("update"), "trip_updates")
            .when(name.contains("alert"), "alerts").otherwise("vehicle_positions"))


def file_name(path):
    """Name that a user gave a file: of a table that Spark wrote it is the folder's, not the part's or the partition's."""
    return F.regexp_extract(path, r"([^/]*?)(?:/[^/=]+=[^/]*)*(?:/part-[^/]*)?$", 1)


def feed_schemas(spark: SparkSession) -> dict[str, StructType]:
    """Columns of the flat feed tables, as the flattening of messages gives them."""
    none = spark.createDataFrame([], MESSAGE_DDL)
    return {"vehicle_positions": vehicle_positions(none).schema, "trip_updates": trip_updates(none).schema, "alerts": alerts(none).schema}


def read_feed_tree(spark: SparkSession, folder: str, schemas: dict[str, StructType | str] | None = None) -> dict[str, DataFrame]:
    """Three feed tables from a tree of parquet files, routed by file name inside the plan.

    Each table is a scan of the tree under its declared schema (``schemas`` replaces the flat feed schemas) with a filter on the
    file's own path, which Spark applies to its file index: files of other feeds are not opened.  Feeds without rows are left out.
    """
    if not exists(spark, folder):
        return {}
    tables = {kind: _parquet(spark, schema).parquet(folder).filter(feed_kind(file_name(F.col("_metadata.file_path"))) == kind)
              for kind, schema in (feed_schemas(spark) | (schemas or {})).items()}
    return {kind: table for kind, table in tables.items() if not table.isEmpty()}


def read_three_feeds(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Exactly three parquet folders or files, bound by name order to vehicle positions, trip updates and alerts.

    Only the folder itself is listed, and schemas are the flat feed schemas.
    """
    tops = _entries(spark, folder)
    if len(tops) != 3:
        raise FileNotFoundError(f"three feeds are needed in {folder}, found {len(tops)}")
    return {kind: _parquet(spark, schema).parquet(top) for (kind, schema), top in zip(feed_schemas(spark).items(), tops)}


def read_timetable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Timetable text files as all-text tables; a missing file gives an empty table, extra columns stay out."""
    tables = {}
    for name, wanted in TIMETABLE.items():
        empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted))
        path = f"{folder.rstrip('/')}/{name}.txt"
        if not exists(spark, path):
            tables[name] = empty
            continue
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        raw = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
        tables[name] = raw.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    return tables


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Decoded feed messages from JSON files."""
    return spark.read.schema(MESSAGE_DDL).json(path)


def write_result(df: DataFrame, path: str, kind: str = "json") -> None:
    """Metrics or ranked tables as JSON, CSV with header, or parquet."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def write_by_day(df: DataFrame, path: str, time: str = "feed_timestamp") -> None:
    """Parquet partitioned by service day, so later day filters read only their folders."""
    df.withColumn("service_date", F.to_date(time)).repartition("service_date", F.pmod(F.xxhash64(time), F.lit(32))).write.mode(
        "overwrite").partitionBy("service_date").parquet(path)
