"""Calls that arrive one after another: a stream of transcript lines merged into the store batch by batch.

Lines arrive late and twice. The new lines of each micro-batch are appended to the line table, however late they
are; the calls it touches are ingested again as a whole, which adds no facts for lines seen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom import schemas, store
from factloom.plans.ingest import ingest

LINES = schemas.TURNS + ", received_at timestamp"


def stream_lines(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", most_files).parquet(folder)


def arrivals(lines: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Lines per call and window of arrival."""
    return lines.withWatermark("received_at", late).groupBy(F.window("received_at", window), "source_id").agg(F.count("*").alias("n_lines"))


def run(spark: SparkSession, folder: str, calls: DataFrame, root: str, checkpoint_dir: str, model=None) -> StreamingQuery:
    """Starts the stream over what is there; the query ends when it is done."""
    seen = f"{root}/lines"

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        new = batch.dropDuplicates(["source_id", "line_no"])
        fs, path = store._fs(spark, seen)
        if fs.exists(path):
            new = new.join(spark.read.schema(LINES).parquet(seen), ["source_id", "line_no"], "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(seen)
        touched = batch.select("source_id").distinct()
        lines = spark.read.schema(LINES).parquet(seen).join(touched, "source_id", "left_semi").dropDuplicates(["source_id", "line_no"])
        ingest(spark, lines, calls, root, model)

    return stream_lines(spark, folder).writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).foreachBatch(merge).start()
