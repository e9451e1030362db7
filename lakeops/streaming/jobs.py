"""Structured Streaming jobs. Each runs what has arrived and stops; a checkpoint resumes it.

Every job appends to files, so results are never gathered on the driver and a
repeated batch is not written twice. Windowed jobs publish a window once the
watermark has passed its end; windows that are still open are read from the
stream's own state, so both together equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.session import small_frame


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(out: DataFrame, path: str, checkpoint: str, progress: str | None = None) -> dict:
    """Process everything that has arrived, wait, and return the last progress report.

    ``progress`` names a table that gets one row per batch: see :func:`batch_progress`.
    """
    q = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(path))
    batches, done = {}, False
    while not done:
        # only the newest reports are kept by the query, so they are fetched while it runs
        done = q.awaitTermination(0.5)
        batches.update({p["batchId"]: dict(p) for p in q.recentProgress})
    if progress is not None and batches:
        batch_progress(out.sparkSession, batches).write.mode("append").parquet(progress)
    return dict(q.lastProgress or {})


PROGRESS = "query_id string, batch_id bigint, input_rows bigint, dropped_rows bigint, state_rows bigint"


def batch_progress(spark: SparkSession, batches: dict[int, dict]) -> DataFrame:
    """One row per batch: rows read, rows that came too late for the watermark, rows of state after it."""
    def total(report: dict, name: str) -> int:
        return sum(op.get(name, 0) for op in report.get("stateOperators", []))

    rows = [(str(b["id"]), k, b["numInputRows"], total(b, "numRowsDroppedByWatermark"), total(b, "numRowsTotal")) for k, b in sorted(batches.items())]
    return small_frame(spark, rows, PROGRESS)


def ingest_files(arrivals: DataFrame, target: str, checkpoint: str) -> None:
    """Copy everything that has arrived in a file stream to ``target``, each file once.

    A batch writes its own folder and replaces it whole. A run that dies between a batch's data and its commit
    repeats that batch under the same id with the same files, so rows are neither lost nor written twice.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/_batch_id={batch_id}")

    q = arrivals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_ingested_files(spark: SparkSession, target: str, schema) -> DataFrame:
    """Rows of all batches; a folder that a dying run left half written has no part files yet."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").parquet(target)


def ingest_runs(runs: DataFrame, delay: str) -> DataFrame:
    """Run feed without repeats: a job instance passes once within ``delay`` of event time."""
    return runs.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["job_instance_id"])


def open_windows(spark: SparkSession, checkpoint: str, counts: str) -> DataFrame:
    """Windows a stream still holds in its state: ``window``, the other grouping columns, and ``counts``.

    Reads the state store of the last committed batch in as many tasks as it has partitions. ``counts`` names the
    aggregates in the order of the job, as a struct type.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value").cast(counts).alias("_v")).select("*", "_v.*").drop("_v")


def _published_and_open(published: DataFrame, still_open: DataFrame) -> DataFrame:
    return published.withColumn("final", F.lit(True)).unionByName(still_open.withColumn("final", F.lit(False)))


def call_rate(calls: DataFrame, delay: str, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """Calls per tenant in sliding windows; published once the watermark has passed a window's end."""
    counted = calls.withWatermark("call_ts", delay).groupBy(F.window("call_ts", window, slide), "tenant").agg(
        F.count(F.lit(1)).alias("calls"))
    return _rate_columns(counted)


def _rate_columns(counted: DataFrame) -> DataFrame:
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tenant", "calls")


def all_call_rates(spark: SparkSession, published: str, checkpoint: str) -> DataFrame:
    """Every window of :func:`call_rate` so far: published ones (``final``) and those still open."""
    still_open = _rate_columns(open_windows(spark, checkpoint, "struct<calls: bigint>"))
    return _published_and_open(spark.read.schema(still_open.schema).parquet(published), still_open)


def run_health(runs: DataFrame, delay: str, window: str = "1 day") -> DataFrame:
    """Runs, successes and failures per item and day; published once the watermark has passed the day's end."""
    counted = runs.withWatermark("start_time", delay).groupBy(F.window("start_time", window), "item_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(S.status_in("status", K.SUCCESS)).alias("success_count"),
        F.count_if(S.status_in("status", K.FAILURE_METRICS)).alias("failure_count"))
    return _health_columns(counted)


def _health_columns(counted: DataFrame) -> DataFrame:
    # the window's end stays in the plan: the append mode asks for the whole window column
    return counted.select(F.col("window.start").alias("day"), F.col("window.end").alias("_end"), "item_id", "runs",
                          "success_count", "failure_count").drop("_end")


def all_run_health(spark: SparkSession, published: str, checkpoint: str) -> DataFrame:
    """Every day of :func:`run_health` so far: published ones (``final``) and those still open."""
    still_open = _health_columns(open_windows(spark, checkpoint, "struct<runs: bigint, success_count: bigint, failure_count: bigint>"))
    return _published_and_open(spark.read.schema(still_open.schema).parquet(published), still_open)
