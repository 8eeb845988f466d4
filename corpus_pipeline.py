"""From raw documents to encoded token ids: five stages, each over all that the one before it kept.

Each stage takes documents (doc_id long, text, lang, source, n_chars), ignores other columns, and works on empty tables. Ids
needn't be unique: rows are decided by their own texts where that matters, see the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm.common import Saved
from ontoloom.llm.decontam import without_leaks
from ontoloom.llm.mixing import mix, repeat_by_copies
from ontoloom.llm.neardup import keep_one
from ontoloom.llm.ngram_rules import keep_good
from ontoloom.llm.token_io import encode_corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts fail them; repeated rows are kept or dropped alike; null ids stay."""
    return keep_good(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8). Texts without words have no duplicates; of repeated rows one stays."""
    return keep_one(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts and items match nothing; repeated rows stay or go alike."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken. Null texts have no words; a null source is one of its own; repeated rows share their copies' fate."""
    return repeat_by_copies(mix(docs, keep=tuple(COLUMNS)))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus, read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts have the end id only; each repeated row is written."""
    return encode_corpus(docs)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: None of the first and last stages has an SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = Saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            last.delete()
        docs, last = now.df, now
    out = STAGES[-1][1](spark, docs, sf_dir)  # has written the corpus, and reads it only
    if last is not None:
        last.delete()
    return out
