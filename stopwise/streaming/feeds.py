"""Streaming sources, windows, scoring and sinks on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.session import checkpoint_root
from stopwise.sources.feeds import MESSAGE_DDL

LATE = "10 minutes"


def file_feed(spark: SparkSession, path: str, schema, kind: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Feed files as a stream; the schema is declared, the batch size bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(path)


def kafka_feed(spark: SparkSession, servers: str, topic: str, group: str = "stopwise", offsets: str = "latest", per_trigger: int = 1000) -> DataFrame:
    """Decoded feed messages from a topic, as JSON values (needs the Kafka connector on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("groupIdPrefix", group).option("startingOffsets", offsets).option("maxOffsetsPerTrigger", per_trigger).load())
    return raw.select(F.from_json(F.col("value").cast("string"), MESSAGE_DDL).alias("m")).select("m.*")


def dedup(stream: DataFrame, keys: tuple[str, ...] = ("entity_id", "retrieved_at"), time: str = "retrieved_at", late: str = LATE) -> DataFrame:
    """First row per key; the watermark bounds the state, later rows are dropped and counted by Spark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def snapshots(stream: DataFrame, time: str = "feed_timestamp", width: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Tumbling route snapshots.  The first step aggregates per (window, route, salt), the second merges the salts, so
    one busy route is spread over tasks."""
    salted = stream.withWatermark(time, late).groupBy(
        F.window(time, width), "route_id", F.pmod(F.xxhash64("trip_id", time), F.lit(16)).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.count("delay_sec").alias("c"), F.sum("delay_sec").alias("s"), F.max("delay_sec").alias("m"))
    return salted.groupBy(F.window(F.window_time("window"), width), "route_id").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("c")).alias("route_delay_mean"), F.max("m").alias("route_delay_max")).select(
        F.col("window.start").alias("window_start"), "route_id", "n", "route_delay_mean", "route_delay_max")


def lookback(stream: DataFrame, time: str = "feed_timestamp", width: str = "60 minutes", slide: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Sliding look-back statistics per stop."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), "stop_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delay_sec").alias("mean_delay"), F.max("delay_sec").alias("max_delay")).select(
        F.col("window.start").alias("window_start"), "stop_id", "n", "mean_delay", "max_delay")


def sessions(stream: DataFrame, time: str = "feed_timestamp", gap: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Activity sessions of each vehicle, closed after a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), "vehicle_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean_speed")).select(
        F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "vehicle_id", "n", "mean_speed")


def event_features(stream: DataFrame, time: str = "feed_timestamp") -> DataFrame:
    """Per-event model inputs: delay, speed, hour, weekday and rush hour."""
    h = F.hour(time)
    return stream.withColumns({
        "delay": F.coalesce("delay_sec", F.lit(0.0)), "velocity": F.coalesce("speed", F.lit(0.0)), "hour": h, "weekday": F.weekday(time),
        "is_rush": (h.between(7, 9) | h.between(16, 19)).cast("int")})


def score_stream(stream: DataFrame, model) -> DataFrame:
    """Probability, decision and severity of each event from a fitted pipeline."""
    from stopwise.functions.alerts import prediction_severity
    from stopwise.ml.models import score

    scored = score(model, event_features(stream)).withColumnRenamed("score", "disruption_probability")
    return prediction_severity(scored)


def prediction_stats(scored: DataFrame, time: str = "feed_timestamp", width: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Rolling statistics of the predictions per window."""
    p = F.col("disruption_probability")
    return scored.withWatermark(time, late).groupBy(F.window(time, width)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg((p > 0.5).cast("double")).alias("disruption_rate")).select(
        F.col("window.start").alias("window_start"), "n", "mean_probability", "disruption_rate")


def run_to_files(stream: DataFrame, path: str, mode: str = "append", name: str | None = None):
    """Process everything available now into parquet files, exactly once through the checkpoint; returns the query."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_stream").trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    query = writer.format("parquet").option("path", f"{path}/data").start()
    query.awaitTermination()
    return query


def run_to_sink(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None):
    """Hand everything available now to a sink, batch by batch; a later call with the same checkpoint goes on; returns the query."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()
    return query


def table_sink(path: str, name: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes batch n of query ``name`` to its own folder.  A batch that comes again after a failure overwrites
    its folder, so no row is written twice; ``read_sink`` reads all batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/query={name}/batch={batch_id}")

    return write


def read_sink(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/query={name}").drop("query", "batch")


PROGRESS = "batch bigint, rows_in bigint, rows_late bigint, state_rows bigint, watermark string"


def progress_rows(query) -> DataFrame:
    """Per micro-batch of a finished or running query: rows read, rows dropped as later than the watermark, rows of state.

    Spark keeps the newest ``spark.sql.streaming.numRecentProgressUpdates`` batches; ``save_progress`` collects them in a table.
    A windowed aggregate counts its late rows after the partial aggregation, a de-duplication each row.
    """
    rows = []
    for p in query.recentProgress:
        state = p["stateOperators"] or []
        rows.append((p["batchId"], p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in state), sum(o["numRowsTotal"] for o in state),
                     (p["eventTime"] or {}).get("watermark")))
    return SparkSession.active().createDataFrame(rows, PROGRESS)


def save_progress(query, path: str) -> DataFrame:
    """Add the progress of a query to the table at ``path``, one folder per batch, and read the table back."""
    spark = SparkSession.active()
    progress_rows(query).withColumn("of", F.col("batch")).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("of").parquet(path)
    return spark.read.schema(PROGRESS).parquet(path)


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over the data there is and read its output back as a table (for replays and tests)."""
    import uuid

    spark = stream.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    run_to_files(stream, path, mode)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Hand each micro-batch to a sink function."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def publish_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "route_id"):
    """Publish rows as JSON to a topic."""
    out = stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
