"""Documents that arrive as JSON lines: each doc_id is taken once, the first time it's seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import DOCUMENT


def stream_documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    s = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", max_files).json(path)
    return s.where("doc_id is not null and text is not null")


def append_new(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch is joined against the table's ids and what's new is appended. A batch that runs again writes nothing twice:
    its own folder is overwritten."""

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        first = F.min_by(F.struct("text", "url", "metadata"), "_at").alias("d")  # as the batch's files come
        new = batch.withColumn("_at", F.monotonically_increasing_id()).groupBy("doc_id").agg(first).select("doc_id", "d.*")
        try:
            old = spark.read.parquet(table).where(F.col("batch") != n)
            new = new.join(old.select("doc_id"), "doc_id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{table}/batch={n}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window, late ones up to the watermark counted; for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(
        F.col("w.start").alias("start"), "event_type", "n", "value")
