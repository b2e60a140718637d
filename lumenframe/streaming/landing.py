"""Streams over landing folders. Per-image operators are stateless, so they run on a stream as they are."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def stream_tables(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def activity(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their total value per type and window; rows later than the watermark are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def cycles(acquisitions: DataFrame, patient: str = "user_id", time: str = "ts", gap: str = "10 days", late: str = "30 days") -> DataFrame:
    """Treatment cycles as session windows: a new one starts `gap` or more after the patient's last acquisition."""
    return acquisitions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(patient, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(patient, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class CycleNumbers(StatefulProcessor):
    """Per patient: days that wait for the watermark, the last day that was numbered and its cycle. A day is numbered when nothing earlier can come any more."""

    def __init__(self, gap_days: int) -> None:
        self.gap = gap_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day date", "n long")
        self.last = handle.getValueState("last", "day date, cycle int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for day, n in batch.groupby("day").size().items():
                held = (day,)
                if self.waiting.containsKey(held):
                    n += self.waiting.getValue(held)[0]
                else:
                    end = datetime.datetime.combine(day + datetime.timedelta(days=1), datetime.time(), datetime.timezone.utc)
                    self.handle.registerTimer(int(end.timestamp() * 1000))
                self.waiting.updateValue(held, (int(n),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, datetime.timezone.utc).date()
        due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] < now)
        last, cycle = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for day, n in due:
            cycle += last is None or (day - last).days >= self.gap
            last = day
            out.append((key[0], day, cycle, n))
            self.waiting.removeKey((day,))
        if out:
            self.last.update((last, cycle))
            yield pd.DataFrame(out, columns=["patient", "day", "cycle", "n"])

    def close(self) -> None:
        pass


def numbered_cycles(acquisitions: DataFrame, patient: str = "user_id", time: str = "ts", gap_days: int = 10, late: str = "30 days") -> DataFrame:
    """inventory.assign_cycles on a stream: (patient, day, cycle, n), a row per patient and day with acquisitions, once the watermark has passed the day.

    Numbers are those of the batch form over all rows that come in time, whatever their order; rows later than `late` are left out. State per patient is the days within
    `late` and one number. Days are those of UTC. Needs the RocksDB state store, which this sets for the session.
    """
    acquisitions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = acquisitions.schema[patient].dataType.simpleString()
    rows = acquisitions.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.col(patient).alias("patient"), F.col(time), F.to_date(time).alias("day"))
    return rows.groupBy("patient").transformWithStateInPandas(CycleNumbers(gap_days), f"patient {kind}, day date, cycle int, n long", "append", "eventTime")
