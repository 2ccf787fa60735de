"""Structured Streaming forms: a ledger appended to once, counters of home days, states of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions.periods import HOME_ZONE
from lexloom.operators import cdc
from lexloom.tables import path_of, shared_folder

#: When the day of a zone begins in UTC; only zones whose offset is the same all year.
OFFSETS = {"UTC": "0 seconds", "Asia/Colombo": "18 hours 30 minutes", "Asia/Kolkata": "18 hours 30 minutes", "Asia/Tokyo": "15 hours"}
#: How long a late event is waited for.
LATE = "1 day"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, be it one file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path, system = path_of(spark, f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if system.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def once(events: DataFrame, idem: str, at: str, late: str = LATE) -> DataFrame:
    """Events whose key was not seen within the time that late ones are waited for."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([idem])


def daily_counts(events: DataFrame, at: str, by: str, late: str = LATE, zone: str = HOME_ZONE) -> DataFrame:
    """Counts of each home day: tumbling windows that begin at the zone's midnight, closed when the watermark has passed them."""
    if zone not in OFFSETS:
        raise ValueError(f"days of a zone whose offset changes are no windows of one length: {zone}")
    offset = OFFSETS[zone]
    window = F.window(at, "1 day", "1 day", offset)
    return events.withWatermark(at, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("events"), F.sum("value").alias("cost")).select(F.from_utc_timestamp(F.col("w.start"), zone).cast("date").alias("day"), by, "events", "cost")


def newest_states(events: DataFrame, key: str, state: str, at: str) -> DataFrame:
    """The newest state of each key as it changes; what is older than the state held is dropped, whatever the order of arrival."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        newest, name = held.get if held.exists else (-1, None)
        before = newest
        for frame in frames:
            # Of equal times the greatest state counts, whatever the order of arrival.
            top = frame[frame["at_us"] == frame["at_us"].max()]
            moment, state = int(top["at_us"].iloc[0]), top["state"].dropna().max() if top["state"].notna().any() else None
            if (moment, state or "") > (newest, name or ""):
                newest, name = moment, state
        if newest != before:
            held.update((newest, name))
            yield pd.DataFrame({key: [keys[0]], "state": [name], "at_us": [newest]})

    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(state).alias("state"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"))
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, at_us long", "at_us long, state string", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and return what it wrote; append through files, update through their last batch by key."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def claims_of(events: DataFrame, key: str, at: str, stale: str, late: str = LATE) -> DataFrame:
    """(key, start, end, events): runs of work on a key; one ends when nothing was heard for the time after which a claim is stale."""
    window = F.session_window(at, stale)
    return events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def keep_snapshot(stream: DataFrame, name: str, key: list[str], order: list[str], batches: int | None = None) -> DataFrame:
    """The snapshot that a stream of rows leaves: each micro-batch is upserted into the one before by the same change detection as a batch.

    A snapshot is a folder of its own, written whole before the next batch reads it, so that a batch that is run again after a
    failure starts from the same one. What doesn't change in a batch isn't counted as a change.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/snapshot-{name}-{uuid.uuid4().hex}"

    def write(rows: DataFrame, epoch: int) -> None:
        path, system = path_of(spark, f"{base}/{epoch - 1}")
        own = cdc.last_of(rows, key, order)
        after = cdc.upsert(spark.read.schema(rows.schema).parquet(f"{base}/{epoch - 1}"), own, key, order) if system.exists(path) else own
        after.write.mode("overwrite").parquet(f"{base}/{epoch}")

    query = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else -1
    path, system = path_of(spark, f"{base}/{last}")
    while last >= 0 and not system.exists(path):
        last -= 1
        path, system = path_of(spark, f"{base}/{last}")
    return spark.read.parquet(f"{base}/{last}") if last >= 0 else spark.createDataFrame([], stream.schema)
