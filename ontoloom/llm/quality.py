"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One scan turns texts into a few statistics; all else works on that narrow table. Training uses a bounded sample of the
labelled rows (MAX_TRAIN), the folds 0, 1 and 3 of crc32(doc_id) mod 4: folds 0 and 1 fit the
ridge scores by normal equations that are summed per partition, fold 3 fits the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, documents, in_fold, slices
from ontoloom.llm.textstats import text_stats

#: Labelled rows used at most, about (a hash threshold picks them).
MAX_TRAIN = 30_000
FOURIER = 256
RIDGE = 1e-3
TASKS = 16

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?;:,", "bang": b"!", "bar": b"|", "mark": b"#*$%&<>=_~^@/\\{}[]()", "line": b"\n", "high": bytes(range(128, 256))}
_MEMBER = np.stack([np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in _CLASSES.values()], axis=1).astype(np.float64)
N_FEATURES = len(_CLASSES) + 9


def statistics(text: str, data: bytes) -> list[float]:
    """The numbers a score depends on; all zero for an empty text."""
    if not data:
        return [0.0] * N_FEATURES
    s = text_stats(text, data)
    words, lines = data.split(), data.split(b"\n")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    used = share[share > 0]
    n = max(1, s.n_words)
    return [
        *(np.sqrt(share @ _MEMBER)).tolist(),
        float(np.log1p(s.n_words)),
        s.word_chars / n,
        s.n_symbols / n,
        s.n_dup_lines / len(lines),
        s.n_repeat_words / n,
        len(set(words)) / n,
        float(np.log1p(len(data) / len(lines))),
        float(-(used * np.log(used)).sum()),
        sum(x[:1].isupper() for x in words) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        rows = [statistics(x, x.encode()) for x in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(rows, pa.list_(pa.float64()))})


def labelled(rows: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """rows (doc_id, ...) with y and fold, for labelled ids outside fold 2. Null labels don't count; of repeated ones the largest does.

    Of more than about `most` ids, those with the smallest hashes are taken.
    """
    marks = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).withColumn("fold", in_fold(F.col("doc_id"))).where(F.col("fold") != 2)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"), F.first("fold").alias("fold"))
    share = min(1.0, most / max(1, marks.count()))
    marks = Saved(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "marks")
    return rows.join(marks.sized(), "doc_id")


class Fourier:
    """cos(w x + b) for standardised x: an approximation of a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))], axis=1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on score (pool adjacent violators), smoothed towards its mean by one pseudo-row a block."""
    order = np.argsort(score, kind="stable")
    prior = float(y.mean())
    blocks: list[list[float]] = []  # sum, weight, first score, last score
    for s, v in zip(score[order], y[order]):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    value = [(b[0] + prior) / (b[1] + 1) for b in blocks]
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    return knots, np.maximum.accumulate(np.repeat(value, 2))


def fit(train: DataFrame) -> tuple[Fourier, np.ndarray, tuple[np.ndarray, np.ndarray]] | None:
    """The feature map, ridge coefficients and calibration knots for rows (doc_id, x, y, fold), or None without rows of both labels; ids spread copies over the tasks."""
    train = Saved(train.select("doc_id", "x", "y", "fold").repartition(TASKS, "doc_id"), "train").df
    moments = train.select("y", F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("y").alias("low"), F.max("y").alias("high")).orderBy("k").collect()
    if not moments or moments[0]["low"] == moments[0]["high"]:
        return None
    mean, scale = np.array([r["m"] for r in moments]), np.array([r["s"] or 0.0 for r in moments])
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0), float(np.sqrt(N_FEATURES)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FOURIER + N_FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(np.array(batch.column("x").to_pylist()))
            y = np.array(batch.column("y").to_pylist(), float)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_pydict({"k": np.arange(size), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = train.where(F.col("fold") != 3).mapInArrow(sums, "k long, row array<double>")
    summed = parts.groupBy("k").agg(F.collect_list("row").alias("rows"))  # a row per partition, TASKS at most
    summed = summed.select("k", F.aggregate(F.slice("rows", 2, TASKS), F.element_at("rows", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("row"))
    gram = np.array([r["row"] for r in summed.orderBy("k").collect()])
    n = gram[-1, -2]
    if n == 0:
        return None
    a = gram[:, :-1] + RIDGE * n * np.diag([*[1.0] * (len(gram) - 1), 1e-9])
    beta = np.linalg.solve(a, gram[:, -1])
    held = train.where(F.col("fold") == 3).select("x", "y").toPandas()  # a quarter of the bounded sample
    if held["y"].nunique() < 2:
        held = train.select("x", "y").toPandas()
    score = fourier(np.array(held["x"].tolist())) @ beta
    return fourier, beta, isotonic(score, held["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, most: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. held_out: crc32(doc_id as text) mod 4 is
    2; such rows are never learned from. score is the calibrated probability of label 1, predicted 1 from cutoff on.

    Null and empty texts are scored by their statistics, which are zero. Repeated rows get equal scores; repeated labels count once. A null id is
    not held out and has no label. Without labels of both kinds every score is 0.5. Empty tables give an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    measured = Saved(docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {id_type}, x array<double>"), "statistics").df
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled(measured, labels, "quality", most)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(len(batch), 0.5)
            if model.value and len(batch):
                fourier, beta, (knots, values) = model.value
                found = np.interp(fourier(np.array(batch.column("x").to_pylist())) @ beta, knots, values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(found, 6))], names=["doc_id", "score"])

    scored = measured.mapInArrow(score, f"doc_id {id_type}, score double")
    return scored.select("doc_id", (F.col("doc_id").isNotNull() & (in_fold(F.col("doc_id")) == 2)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
