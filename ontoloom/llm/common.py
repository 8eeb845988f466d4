"""What the training-data operators share: intermediate tables, sized broadcasts, words."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Parquet size of a side that is broadcast (several times as much in memory); a larger side is joined by a shuffle.
BROADCAST_BYTES = 3 << 20

#: A word, in the contracts of the operators: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Shuffle files are removed once the query that wrote them is over.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, else an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ontoloom-")
        context.setCheckpointDir(found)
    return found


#: What goes to a Python worker at once, in bytes; both sides hold a batch as a whole.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(5 << 20)}


class Saved:
    """A table written to the shared folder and read again: it cuts the lineage and has a known size."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/ontoloom/{name}-{uuid.uuid4().hex}"
        wanted = {CLEAN_UP: "true"} | BATCH_BYTES
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            df.write.parquet(self.path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def bytes(self) -> int:
        path, fs = self._fs()
        return fs.getContentSummary(path).getLength()

    def delete(self) -> None:
        path, fs = self._fs()
        fs.delete(path, True)

    def sized(self) -> DataFrame:
        """The table, marked for broadcast if it is small enough; for the smaller side of a join."""
        return F.broadcast(self.df) if self.bytes() <= BROADCAST_BYTES else self.df


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: the fold of a labelled row. A null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in parts whose texts have `most` bytes together, or are single, with the texts (null: empty); only one part is in Python at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in chunks(sizes, most):
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in part.column(column).to_pylist()]
    give_back()


def give_back() -> None:
    """Memory that isn't in use goes back to the system, as a Python worker outlives its task and the stages share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(sizes: list[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to most at most, or single larger ones."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def worker_state() -> types.ModuleType:
    """A namespace that lives as long as the Python worker, for caches that later tasks can use."""
    return sys.modules.setdefault("_ontoloom_worker_state", types.ModuleType("_ontoloom_worker_state"))


def words_of(data: bytes) -> list[bytes]:
    """WORD matches of a UTF-8 text: bytes.split() splits at exactly the same six characters."""
    return data.split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

