"""A sink of micro-batches with a ledger: replays write nothing twice, attempts are counted, bad rows become dead letters, counts come from the writing pass.

A sink is a folder: report/batch=<n>/ok=<true or false> with the rows, and ledger/batch=<n>, a row that is written last. Readers take only batches that the ledger
knows, so that what a failed attempt left behind is never seen.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Attempts of a batch, and seconds before the second one; each further wait is twice as long.
ATTEMPTS, BACKOFF_S = 3, 1.0
LEDGER = "batch long, attempts int, ingested long, failed long, seconds double"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def observed(report: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """report (ok, ...) with counts that are taken while it is written: ingested, failed and, where there is a column `text`, the texts that went to an embedding."""
    seen = Observation(name)
    more = [F.count_if(F.col("ok") & (F.col("text") != "")).alias("embedded")] if "text" in report.columns else []
    return report.observe(seen, F.count_if("ok").alias("ingested"), F.count_if(~F.col("ok")).alias("failed"), *more), seen


class Sink:
    """prepare turns a batch into its report: the rows with ok and error. wait is called between attempts, with seconds."""

    def __init__(self, folder: str, prepare: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, backoff: float = BACKOFF_S, wait: Callable[[float], None] = time.sleep):
        self.folder, self.prepare, self.attempts, self.backoff, self.wait = folder, prepare, attempts, backoff, wait

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch. A batch that the ledger has is left alone; one that fails as often as allowed fails the stream, which replays it later."""
        spark = batch.sparkSession
        if _exists(spark, f"{self.folder}/ledger/batch={number}/_SUCCESS"):
            return
        for attempt in range(1, self.attempts + 1):
            try:
                began = time.monotonic()
                counts = self._write(batch, number)
                break
            except Exception:
                if attempt == self.attempts:
                    raise
                self.wait(self.backoff * 2 ** (attempt - 1))
        row = [(attempt, counts["ingested"], counts["failed"], time.monotonic() - began)]
        spark.createDataFrame(row, "attempts int, ingested long, failed long, seconds double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={number}")

    def _write(self, batch: DataFrame, number: int) -> dict:
        """One pass: rows by whether they are ok, counted while they are written."""
        report, seen = observed(self.prepare(batch), f"batch-{number}-{time.monotonic_ns()}")
        report.write.mode("overwrite").partitionBy("ok").parquet(f"{self.folder}/report/batch={number}")
        return seen.get


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A row per batch that was written: batch, attempts, ingested, failed, seconds."""
    if not _exists(spark, f"{folder}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")


def _known(spark: SparkSession, folder: str, ok: bool) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/report").where(F.col("ok") == ok)
    return rows.join(F.broadcast(ledger(spark, folder).select("batch")), "batch", "left_semi").drop("ok")  # a row per batch


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """The ingested rows of all batches in the ledger, with their batch."""
    return _known(spark, folder, True).drop("error")


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that failed, with error and batch."""
    return _known(spark, folder, False)


def retry(spark: SparkSession, sink: Sink, number: int, mend: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Sends the dead letters of one batch through the sink once more, mended, as batch -number - 1; a second call writes nothing."""
    sink(mend(dead_letters(spark, sink.folder).where(F.col("batch") == number).drop("batch", "error")), -number - 1)
