"""Benchmark decontamination by pigeonhole edit matching.

Each test item is cut into one piece more than its error budget, so that any occurrence within the budget has at least
one piece unchanged. An Aho-Corasick automaton finds all pieces in one pass over a document, and Myers' bit-parallel
distance verifies the item around each hit. Items are broadcast in blocks of bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ontoloom.llm.common import Saved, documents, slices, worker_state

#: Errors allowed per character of an item.
ERROR_RATE = 0.05
#: Characters of the items that are matched in one scan.
BLOCK_CHARS = 4_000_000
#: Items with fewer characters after normalisation must begin and end at word borders.
MIN_CHARS = 40

TOKEN = re.compile(r"[^\W_]+")
#: Letters of scripts without spaces between words: Thai to Burmese, Khmer, kana, Han. There is a border on both sides of each.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    """Letters and digits, lower-cased, words joined by single spaces."""
    return " ".join(TOKEN.findall((text or "").lower()))


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length that cover the item."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(errors, end) of the best occurrence of the whole pattern in text, or None if it has more than most errors."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best = (len(pattern), 0)
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(diagonal | plus), plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        # The first row stays zero, as an occurrence may start anywhere.
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best[0]:
            best = (score, k + 1)
    return best if best[0] <= most else None


def is_border(text: str, k: int) -> bool:
    """Whether a word of the normalised text may begin or end before its k-th character."""
    return k <= 0 or k >= len(text) or " " in text[k - 1 : k + 1] or UNSPACED.search(text, k - 1, k + 1) is not None


def distance(a: str, b: str) -> int:
    """Edits between two whole strings."""
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def bordered(item: str, text: str, start: int, most: int) -> int | None:
    """The fewest errors of an occurrence that begins within most characters of start, between borders; None if it has more than most."""
    begins = [a for a in range(max(0, start - most), min(len(text), start + most) + 1) if is_border(text, a)]
    spans = [(a, b) for a in begins for b in range(a + max(1, len(item) - most), min(len(text), a + len(item) + most) + 1) if is_border(text, b)]
    best = min((distance(item, text[a:b]) for a, b in spans), default=most + 1)
    return best if best <= most else None


class Matcher:
    """Finds the items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int = MIN_CHARS):
        import ahocorasick

        self.short = short
        self.items = [(i, x, int(len(x) * rate)) for i, x in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, x, errors) in enumerate(self.items):
            for offset, piece in pieces_of(x, errors):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.empty = not at

    @classmethod
    def cached(cls, items: Broadcast, name: str, rate: float, short: int) -> Matcher:
        """The matcher of a block of items; a worker keeps the last one for its next task."""
        state = worker_state().__dict__
        if state.get("matcher", ("",))[0] != name:
            state["matcher"] = name, cls(items.value, rate, short)
        return state["matcher"][1]

    def find(self, text: str, first: bool = False) -> list[tuple[int, int]]:
        """(item_id, errors) of the items within their budgets in a normalised text, with the fewest errors of each; with first, one is enough."""
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        if self.empty:
            return []
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                if found.get(n) == 0:
                    continue
                _, item, errors = self.items[n]
                start = end + 1 - size - offset  # of the item, if there were no insertions or deletions
                short = len(item) < self.short
                if start >= 0 and text.startswith(item, start) and (not short or is_border(text, start) and is_border(text, start + len(item))):
                    found[n] = 0
                    if first:
                        return [(self.items[n][0], 0)]
                    continue
                if errors == 0 or (n, start) in tried:
                    continue
                tried.add((n, start))
                window = text[max(0, start - errors) : start + len(item) + errors]
                hit = myers(item, window, errors) if len(window) >= len(item) - errors else None
                if hit and short:
                    least = bordered(item, text, start, errors)
                    hit = None if least is None else (least, 0)
                if hit and hit[0] < found.get(n, errors + 1):
                    found[n] = hit[0]
                    if first:
                        return [(self.items[n][0], hit[0])]
        return sorted((self.items[n][0], e) for n, e in found.items())


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of about BLOCK_CHARS; null ids and texts without a letter or digit are left out, of a repeated id each text is kept."""
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).distinct().collect()
        found = sorted({(r["item_id"], x) for r in rows if (x := normalise(r["text"]))})
        if found:
            yield found


def leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, short: int = MIN_CHARS) -> DataFrame:
    """Pairs (doc_id, item_id, errors): the item occurs in the document's normalised text with at most rate * length edits.

    docs needs doc_id and text, items item_id and text; other columns are ignored. Null and empty texts match nothing. A repeated
    document gives its pairs once for each row, an item id with several texts once for each of them. Rows with null
    doc_id match like others. Empty tables give an empty result. Whole texts are searched. Items of fewer than `short` characters have the same
    budget (none below 1 / rate characters) and must stand between word borders; with 0 no item must.
    """
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType.simpleString()
    ids = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type}, errors int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = Matcher.cached(shared, name, rate, short)
            for batch, texts in slices(batches):
                rows = [(k, *hit) for k, x in enumerate(texts) if x for hit in matcher.find(normalise(x))]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), pa.array([r[1] for r in rows], ids), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "item_id", "errors"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(match, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, short: int = MIN_CHARS) -> DataFrame:
    """docs without the rows in which any item occurs, by the rules of leaks(); same columns.

    Null and empty texts stay; repeated rows stay or go alike; empty tables of either kind take nothing away. With several blocks of items the rows
    that a block leaves are written before the next one, so that a task has one Python worker with one automaton.
    """
    last = saved = None
    for block in item_blocks(items):
        if last is not None:
            before, saved = saved, Saved(_cleaned(docs if saved is None else saved.df, last, rate, short), "clean")
            if before is not None:
                before.delete()
        last = block
    rest = docs if saved is None else saved.df
    return rest if last is None else _cleaned(rest, last, rate, short)


def _cleaned(docs: DataFrame, block: list[tuple[int, str]], rate: float, short: int) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.cached(shared, name, rate, short)
        for batch, texts in slices(batches):
            yield batch.filter(pa.array([not x or not matcher.find(normalise(x), first=True) for x in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
