"""The log source and the sink with a ledger, with failures between."""

import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from ontoloom.sources.log_source import SCHEMA, log_source
from ontoloom.streaming import sink


@dataclass
class FileClient:
    """A log service in a folder: rows.json with all rows, now with the service's time; a file named fail makes pages fail."""

    folder: str

    def _rows(self):
        with open(f"{self.folder}/rows.json") as f:
            return json.load(f)

    def now_ms(self):
        with open(f"{self.folder}/now") as f:
            return int(f.read())

    def groups(self):
        return sorted({r["group"] for r in self._rows()})

    def page(self, group, after_ms, until_ms, pattern, token, limit):
        import os

        found = [r for r in self._rows() if r["group"] == group and after_ms < r["timestamp"] <= until_ms and (not pattern or pattern in r["message"])]
        start = int(token or 0)
        if start and os.path.exists(f"{self.folder}/fail"):
            raise OSError("the service is away")
        rows = [{k: r[k] for k in ("log_stream", "timestamp", "message")} | ({"event_id": r["event_id"]} if "event_id" in r else {}) for r in found[start : start + limit]]
        return rows, str(start + limit) if start + limit < len(found) else None


def rows_until(now, n=400):
    return [{"group": f"g{k % 3}", "log_stream": f"s{k % 2}", "timestamp": 1000 * k, "message": f"m{k}", **({"event_id": f"e{k}"} if k % 5 else {})} for k in range(n) if 1000 * k <= now]


def test_source_replays_and_looks_back(spark, tmp_path):
    """Three polls, the second of which fails in its second page first: no row is lost, none is read twice, and the first poll looks back 300 seconds."""
    service, out, checkpoint = tmp_path / "service", str(tmp_path / "out"), str(tmp_path / "cp")
    service.mkdir()
    spark.dataSource.register(log_source(FileClient(str(service)), "test_logs"))

    def poll(now):
        (service / "rows.json").write_text(json.dumps(rows_until(now)))
        (service / "now").write_text(str(now))
        stream = spark.readStream.format("test_logs").option("page", 7).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    poll(310_000)
    (service / "fail").touch()
    with pytest.raises(Exception, match="away"):
        poll(350_000)
    (service / "fail").unlink()
    poll(350_000)
    poll(390_000)
    got = spark.read.schema(SCHEMA).parquet(out).collect()
    want = [r for r in rows_until(390_000) if r["timestamp"] > 10_000]
    assert sorted((r.log_group, r.timestamp, r.message) for r in got) == sorted((r["group"], r["timestamp"], r["message"]) for r in want)
    assert {r.event_id for r in got if r.timestamp == 15_000} == {"s1-15000"} and {r.event_id for r in got if r.timestamp == 16_000} == {"e16"}


def prepared(batch):
    error = F.when(F.col("v") % 7 == 3, F.lit("bad value"))
    return batch.withColumn("error", error).withColumn("ok", error.isNull()).withColumn("text", F.when(F.col("v") % 2 == 0, "x").otherwise(""))


def test_sink_replays_attempts_and_dead_letters(spark, tmp_path):
    folder, waits, calls = str(tmp_path / "sink"), [], []

    def failing(batch):
        calls.append(len(calls))
        if len(calls) in (2, 3):
            return prepared(batch).withColumn("v", F.raise_error(F.lit("no luck")).cast("long"))
        return prepared(batch)

    s = sink.Sink(folder, failing, wait=waits.append)
    one, two = spark.range(0, 20).select(F.col("id").alias("v")), spark.range(20, 50).select(F.col("id").alias("v"))
    s(one, 0)
    s(two, 1)  # fails twice, then works
    s(one, 0)  # a replay
    s(two, 1)
    assert len(calls) == 4 and waits == [1.0, 2.0]
    good, bad = [v for v in range(50) if v % 7 != 3], [v for v in range(50) if v % 7 == 3]
    assert sorted(r.v for r in sink.rows(spark, folder).collect()) == good
    assert sorted(r.v for r in sink.dead_letters(spark, folder).collect()) == bad
    book = {r.batch: (r.attempts, r.ingested, r.failed) for r in sink.ledger(spark, folder).collect()}
    assert book == {0: (1, len([v for v in good if v < 20]), len([v for v in bad if v < 20])), 1: (3, len([v for v in good if v >= 20]), len([v for v in bad if v >= 20]))}
    mend = lambda rows: rows.select((F.col("v") * 7).alias("v"))
    for _ in range(2):
        sink.retry(spark, s, 0, mend)
    assert sorted(r.v for r in sink.rows(spark, folder).where("batch < 0").collect()) == [7 * v for v in bad if v < 20]


def test_sink_gives_up(spark, tmp_path):
    """What a failed attempt wrote is never read."""
    folder = str(tmp_path / "sink")
    s = sink.Sink(folder, lambda b: prepared(b).withColumn("v", F.raise_error(F.lit("never")).cast("long")), attempts=2, wait=lambda x: None)
    with pytest.raises(Exception, match="never"):
        s(spark.range(5).select(F.col("id").alias("v")), 4)
    assert sink.ledger(spark, folder).count() == 0
    sink.Sink(folder, prepared)(spark.range(5).select(F.col("id").alias("v")), 5)
    assert {r.batch for r in sink.rows(spark, folder).collect()} == {5}


def test_sink_in_a_stream(spark, tmp_path):
    """Counts of the writing pass equal those of a second one, over all micro-batches."""
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("v")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))
    folder = str(tmp_path / "sink")
    q = stream.writeStream.foreachBatch(sink.Sink(folder, prepared)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    counts = sink.ledger(spark, folder).agg(F.count("*"), F.sum("ingested"), F.sum("failed")).first()
    assert tuple(counts) == (3, sink.rows(spark, folder).count(), sink.dead_letters(spark, folder).count())


def test_observed_counts(spark):
    report, seen = sink.observed(prepared(spark.range(100).select(F.col("id").alias("v"))), "once")
    report.write.format("noop").mode("overwrite").save()
    plain = prepared(spark.range(100).select(F.col("id").alias("v")))
    assert seen.get == {"ingested": plain.where("ok").count(), "failed": plain.where("NOT ok").count(), "embedded": plain.where("ok AND text <> ''").count()}


def test_stream_forms(spark, tmp_path):
    """Replays within the watermark, windowed counts and ingestion over micro-batches."""
    from ontoloom.streaming import traces

    base = spark.range(40).select(F.concat(F.lit("l"), (F.col("id") % 25).cast("string")).alias("log_id"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.when(F.col("id") % 4 == 0, "error").otherwise("view").alias("event_type"))
    for k in range(2):
        base.where(f"unix_seconds(ts) div 20 between {20 * k} and {20 * k + 19}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p*"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return spark.table(name).collect()

    assert sorted(r.log_id for r in run(traces.without_replays(stream), "once")) == sorted(f"l{k}" for k in range(25))
    done = run(traces.windowed_counts(stream, "2 minutes", "1 minute"), "counted")
    want = base.groupBy((F.unix_seconds("ts") / 120).cast("int").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()
    got = {(int(r.start.timestamp()) // 120, r.event_type): r.n for r in done}
    assert got and got.items() <= {(r.w, r.event_type): r.n for r in want}.items() and len(got) >= len(want) - 4
    q = traces.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ingest"), 0)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
