"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two scans. The first counts hashed byte trigrams of all documents and of the trusted ones, per task, and
Spark sums the counts per bucket. The second scores every document with the two smoothed multinomials:
the mean over its trigrams of log p_target - log p_raw. Only the table of buckets, of fixed size, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import documents, slices
from ontoloom.llm.textstats import TextStats, base_failed, text_stats

BUCKET_BITS = 16
#: Added to the count of each bucket in both multinomials.
SMOOTHING = 1.0
#: Documents with a lower mean log-likelihood ratio are rejected.
THRESHOLD = -0.15

STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def buckets_of(data: np.ndarray) -> np.ndarray:
    """The bucket of the byte trigram that starts at each position (the last two have none)."""
    x = data.astype(np.uint32)
    trigram = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((trigram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def is_trusted(s: TextStats, data: bytes) -> bool:
    """The trusted target: documents that pass strict forms of the base rules; few symbols, capitals and repeats, words of ordinary length."""
    if s.n_words < 50 or s.n_dup_lines or 10 * s.n_repeat_words > s.n_words or 100 * s.n_symbols > s.n_words:
        return False
    if not 2 * s.n_words <= s.word_chars <= 12 * s.n_words:
        return False
    x = np.frombuffer(data, np.uint8)
    return 10 * int(((x >= 65) & (x <= 90)).sum()) <= len(x)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for _, texts in slices(batches):
        data = [x.encode() for x in texts]
        trusted = [is_trusted(text_stats(t, x), x) for t, x in zip(texts, data)]
        for into, chosen in ((raw, data), (target, [x for x, t in zip(data, trusted) if t])):
            long = [x for x in chosen if len(x) > 2]
            if long:
                found = buckets_of(np.frombuffer(b"".join(long), np.uint8))
                inner = np.ones(len(found), bool)
                ends = np.cumsum([len(x) for x in long])[:-1]
                inner[ends - 1] = inner[ends - 2] = False  # trigrams across two documents
                into += np.bincount(found[inner], minlength=len(into))
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "raw": raw[used], "target": target[used]})


def log_ratios(docs: DataFrame) -> np.ndarray:
    """log p_target - log p_raw for each bucket; zeros if there is no trusted document."""
    counts = docs.select("text").mapInArrow(_counter, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(1 << BUCKET_BITS, SMOOTHING), np.full(1 << BUCKET_BITS, SMOOTHING)
    for row in counts.collect():  # 2 ** BUCKET_BITS rows at most
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if target.sum() == SMOOTHING * len(target):
        return np.zeros(len(raw), np.float32)
    return (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)


def judged(docs: DataFrame, threshold: float = THRESHOLD, into: str = "quality") -> DataFrame:
    """docs with one column more, a struct of the base counts, base_failed, llr and kept; only the texts go through Python."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs))  # 256 kB

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ratios.value
        for column in columns:
            done = [_scores(texts, table, threshold) for _, texts in slices([pa.record_batch([column], ["text"])])]
            yield pa.concat_arrays(done) if done else pa.array([], _RESULT)

    fields = "".join(f"{c}: bigint, " for c in STAT_COLUMNS)
    return docs.withColumn(into, F.arrow_udf(score, f"struct<{fields}base_failed: boolean, llr: double, kept: boolean>")("text"))


_RESULT = pa.struct([*((c, pa.int64()) for c in STAT_COLUMNS), ("base_failed", pa.bool_()), ("llr", pa.float64()), ("kept", pa.bool_())])


def _scores(texts: list[str], table: np.ndarray, threshold: float) -> pa.StructArray:
    data = [x.encode() for x in texts]
    llr, sizes = np.zeros(len(data)), np.array([len(x) for x in data])
    if sizes.sum() > 2:
        sums = np.concatenate([[0.0], np.cumsum(table[buckets_of(np.frombuffer(b"".join(data), np.uint8))], dtype=np.float64), [0.0, 0.0]])
        ends, many = np.cumsum(sizes), sizes > 2
        first, last = (ends - sizes)[many], (ends - 2)[many]
        llr[many] = (sums[last] - sums[first]) / (sizes[many] - 2)
    llr = np.round(llr, 6)
    stats = [text_stats(t, d) for t, d in zip(texts, data)]
    failed = np.array([base_failed(s) for s in stats], bool)
    counts = [pa.array([s[k] for s in stats], pa.int64()) for k in range(len(STAT_COLUMNS))]
    return pa.StructArray.from_arrays([*counts, pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))], fields=list(_RESULT))


def quality_rules(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, llr, kept.

    docs needs doc_id and text; other columns are ignored. kept is false for base_failed, else whether llr reaches the
    threshold. Null and empty texts have counts of 0, llr 0.0 and fail the base rules; texts of fewer than three bytes
    have llr 0.0. Repeated rows count and stay as often as they are there. Null ids stay null. An empty table gives
    an empty result. Without any trusted document every llr is 0.0 and the base rules alone decide.
    """
    return judged(docs.select("doc_id", "text"), threshold).select("doc_id", "quality.*")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the quality rules keep, with all their columns; docs needs text. Odd rows: see quality_rules."""
    into = "quality"
    while into in docs.columns:
        into += "_"
    return judged(docs, threshold, into).where(f"{into}.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
