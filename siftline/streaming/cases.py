"""Evidence over streams: M1 and M2 keep no state, so they run on a stream as they are; M3 and M4 recompute the cases touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.functions.dates import DEFAULT_ZONE
from siftline.operators.checks import check
from siftline.operators.extract import extract
from siftline.operators.ingest import ingest
from siftline.operators.timeline import build_timeline
from siftline.sources.raw import RAW, OcrEngine, tesseract, upsert
from siftline.storage import settle


def read_raw(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of raw rows from JSON Lines files as they arrive."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files).json(path)


def records_stream(raw: DataFrame, ocr: OcrEngine = tesseract) -> DataFrame:
    return extract(ingest(raw, ocr))


def update_cases(records: DataFrame, store: str, sink: Callable[[DataFrame, DataFrame], None], checkpoint: str, zone: str = DEFAULT_ZONE, available_now: bool = True) -> StreamingQuery:
    """For each micro-batch: upserts its records into the store (Parquet by case) and hands the touched cases' events and issues to `sink`.

    The store is written case by case before the sink sees it; a batch that is run again gives the same store.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            touched = batch.select("case_id").distinct()
            try:
                old = spark.read.schema(batch.schema).parquet(store).join(touched, "case_id", "left_semi")
                merged = upsert(old.select(*batch.columns), batch)
            except Exception as e:  # the first batch finds no store
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                merged = upsert(batch.limit(0), batch)
            # on disk before the partitions it was read from are replaced: a lost executor can't lose it
            merged = settle(merged.select(*batch.columns))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(store)
            events = settle(build_timeline(merged, zone)[0])
            sink(events, check(events)[0])
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(records: DataFrame, time_col: str = "received_at", delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Evidence by type in windows of arrival time; what arrives later than `delay` is left out."""
    return records.withWatermark(time_col, delay).groupBy(F.window(time_col, width), "evidence_type").agg(F.count(F.lit(1)).alias("n"))
