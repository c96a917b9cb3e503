"""Job progress: percent per event, the latest state per job, the changes a listener sees; as batches and as a stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.runtime import shared_folder

# Stages of a conversion with the percent they span, and the short names that feeds use for them.
STAGES = {
    "detection": (5, 10), "text_extraction": (10, 25), "structure_analysis": (25, 40), "routing": (40, 45), "asset_extraction": (45, 55), "vision_processing": (55, 70),
    "synthesis": (70, 75), "schema_inference": (75, 85), "entity_extraction": (85, 90), "chunk_generation": (90, 93), "generation": (93, 100),
}
ALIASES = {"extraction": "text_extraction", "structure": "structure_analysis", "vision": "vision_processing", "schema": "schema_inference", "entities": "entity_extraction", "chunks": "chunk_generation", "output": "generation"}
TERMINAL = ("completed", "failed")


def percent() -> Column:
    """Progress of an event: its stage's span, as far as current of total; a finished job has 100; null for a stage that
    isn't known."""
    spans = STAGES | {k: STAGES[v] for k, v in ALIASES.items()}
    bound = lambda i: F.create_map(*[F.lit(x) for k, v in spans.items() for x in (k, v[i])])[F.col("stage")]
    share = F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("current", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))
    within = F.floor(bound(0) + (bound(1) - bound(0)) * share).cast("int")
    return F.when(F.col("status") == "completed", 100).otherwise(within)


_ORDER = ("ts", "received_at", "current", "stage", "status")


def events(raw: DataFrame) -> DataFrame:
    """Distinct events with `progress`. Rows without job or time are left out."""
    rows = raw.select("job_id", "ts", "stage", "current", "total", "status", "received_at").where("job_id is not null and ts is not null").distinct()
    return rows.withColumn("progress", percent())


def latest(raw: DataFrame) -> DataFrame:
    """job_id, status, stage, progress of each job: of its last event by time (then arrival, current, stage, status; nulls
    first); the last progress that is known. One aggregate, so jobs of many events are pre-aggregated."""
    key = F.struct(*[F.col(c) for c in _ORDER])
    known = F.when(F.col("progress").isNotNull(), key)
    out = events(raw).groupBy("job_id").agg(F.max_by("status", key).alias("status"), F.max_by("stage", key).alias("stage"), F.max_by("progress", known).alias("progress"), F.count("*").alias("n_events"))
    return out


def changes(raw: DataFrame) -> DataFrame:
    """The events that a listener is sent: progress differs from the last one, or the job has ended. A job's own events
    are sorted; they are few."""
    order = W.partitionBy("job_id").orderBy(*[F.col(c).asc_nulls_first() for c in _ORDER])
    rows = events(raw).where("progress is not null").withColumn("before", F.lag("progress").over(order))
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col("progress")) | F.col("status").isin(*TERMINAL)).select("job_id", "ts", "status", "stage", "progress")


def duration(raw: DataFrame) -> DataFrame:
    """Jobs and mean seconds from first to last event, by final status."""
    span = events(raw).groupBy("job_id").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return latest(raw).join(span, "job_id").groupBy("status").agg(F.count("*").alias("n_jobs"), F.round(F.avg(F.col("us") / 1_000_000), 3).alias("mean_seconds"))


def stream(spark: SparkSession, folder: str, schema, late: str = "1 hour") -> DataFrame:
    """The latest state per job of a folder that event files drop into, in update mode: arrivals later than `late` after
    the newest time are dropped, repeats within that time count once."""
    raw = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    once = raw.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "ts", "stage", "current", "total", "status", "received_at"])
    rows = once.withColumn("progress", percent())
    key = F.struct("ts", "received_at", "current", "stage", "status")
    known = F.when(F.col("progress").isNotNull(), key)  # the last progress that is known, as in latest()
    return rows.groupBy("job_id").agg(F.max_by("status", key).alias("status"), F.max_by("stage", key).alias("stage"), F.max_by("progress", known).alias("progress"), F.count("*").alias("n_events"))


CHANGE = "job_id string, ts timestamp, status string, stage string, progress int"


def change_stream(spark: SparkSession, folder: str, schema, late: str = "1 hour") -> DataFrame:
    """changes() as a stream, in append mode: of each job's events, in the order of their arrival in batches and within a
    batch by time, those that a listener is sent. A job's state is the progress it was last sent; it is forgotten once the
    job has ended, so states are as many as there are open jobs."""
    raw = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).where("job_id is not null and ts is not null")
    once = raw.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "ts", "stage", "current", "total", "status", "received_at"])
    rows = once.withColumn("progress", percent()).where("progress is not null").select("job_id", "ts", "received_at", "current", "stage", "status", "progress")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(list(_ORDER), na_position="first", kind="stable")
        out, ended = [], False
        for ts, status, stage, progress in zip(pdf["ts"], pdf["status"], pdf["stage"], pdf["progress"].tolist()):
            ended = status in TERMINAL
            if last is None or progress != last or ended:
                out.append((key[0], ts, status, stage, int(progress)))
            last = progress
        if ended and state.exists:
            state.remove()
        elif not ended:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=["job_id", "ts", "status", "stage", "progress"])

    return rows.groupBy("job_id").applyInPandasWithState(step, CHANGE, "last int", "append", "NoTimeout")


def windows(spark: SparkSession, folder: str, schema, late: str = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Events per stage and window of time, in append mode."""
    raw = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return raw.withWatermark("ts", late).groupBy(F.window("ts", size), "stage").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, path: str, late: str = "36500 days") -> DataFrame:
    """The latest state per job by stream(), run over the files at `path` until none is left, as a table of its last state.
    The state is written to the shared folder and read from there; a large `late` drops nothing."""
    schema = "job_id string, status string, stage string, progress int, n_events bigint"
    rows = _run(stream(spark, path, spark.read.parquet(path).schema, late), schema, "update")
    return rows.groupBy("job_id").agg(*[F.max_by(c, "batch").alias(c) for c in ("status", "stage", "progress", "n_events")])


def drained_changes(spark: SparkSession, path: str, late: str = "36500 days") -> DataFrame:
    """change_stream() over the files at `path` until none is left, as a table."""
    return _run(change_stream(spark, path, spark.read.parquet(path).schema, late), CHANGE, "append").drop("batch")


def _run(streamed: DataFrame, schema: str, mode: str) -> DataFrame:
    """What a stream gives until nothing is left, with the number of its `batch`, from files in the shared folder."""
    spark = streamed.sparkSession
    target = shared_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/out/n={number}")

    streamed.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch int").option("recursiveFileLookup", "true").parquet(f"{target}/out")


def statuses(states: DataFrame) -> DataFrame:
    """states with what a client may do: `can_cancel` while a job waits or runs, `has_result` once it is completed, `open`
    unless it has ended."""
    ended = F.col("status").isin(*TERMINAL)
    return states.withColumns({"open": ~F.coalesce(ended, F.lit(False)), "can_cancel": ~F.coalesce(ended, F.lit(False)), "has_result": F.coalesce(F.col("status") == "completed", F.lit(False))})
