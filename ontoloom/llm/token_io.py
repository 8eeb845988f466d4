"""Token-ID output: canonical length-limited Huffman coding of token ids, in independent blocks.

A corpus folder holds two Parquet tables.
codebook: (id, length), a canonical code: codes are given out in the order of (length, id).
blocks: (block, n_docs, n_tokens, doc_ids, doc_tokens, offsets, payload), in ascending order of doc_id over the files. A block
holds whole documents. offsets has the bits of each run of GROUP tokens; their running sum says where a run
starts, so that all runs of a block are decoded side by side, one token of each at a time, by one table.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, documents, shared_dir, slices, worker_state

#: Longest code, in bits; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Tokens between two checkpoints.
GROUP = 128
#: Tokens from which on a block is full.
BLOCK_TOKENS = 1 << 16
#: Pieces that are encoded in one string.
TOGETHER = 64
#: Pieces whose ids a worker remembers, the first that it meets.
MEMO = 300_000
#: Closing marks: characters that are neither letters, digits nor white space.
MARKS = ".,;:!?%$&*#|"
#: White space other than spaces and line ends, in the widest sense.
BLANKS = r"\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts. Byte-level BPE never merges over the borders of its pre-tokens, so that each distinct piece of many texts is encoded once.

    A text is cut before each space and each line end; if no other white space follows there, a piece begins a pre-token. Closing
    marks after a letter or digit are a pre-token too, so the piece is parted there. The distinct pieces go to the tokenizer joined,
    many at a time; as each begins with its only space or line end, the ids that begin with one part them again. Texts with odd
    pieces go to the tokenizer as they are: two white-space characters in a row, other white space, added tokens like <|endoftext|>.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([rf"(?s)^\n?$|^[{BLANKS}]|.[\n{BLANKS}]", *added])
        self.odd_head = "|".join([rf"[ \n{BLANKS}]", *added])
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        # How byte-level vocabularies write a space and a line end.
        self.begins[[k for token, k in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))

    @classmethod
    def cached(cls, path: str) -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = worker_state().__dict__.setdefault("encoders", {})
        if path not in known:
            known[path] = cls(path)
        return known[path]

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for k in range(0, len(texts), 64):
            for e in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False):
                yield e.ids

    def _together(self, pieces: pa.Array) -> pa.ListArray:
        """The ids of pieces, which all begin with their only space or line end."""
        texts = pieces.to_pylist()
        ids = [np.array(x, np.uint32) for x in self._encode(["".join(texts[a : a + TOGETHER]) for a in range(0, len(texts), TOGETHER)])]
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        return pa.ListArray.from_arrays(np.append(np.flatnonzero(self.begins[flat]), len(flat)).astype(np.int32), flat)

    def _pieces(self, pieces: pa.Array) -> pa.ListArray:
        """_together for distinct pieces, of which some are known from texts before."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        ids, every = self._together(new), self.known_ids
        is_new = np.asarray(pc.is_null(at))
        where = np.where(is_new, len(self.known) + np.cumsum(is_new) - 1, pc.fill_null(at, 0).to_numpy())
        every = pa.concat_arrays([every, ids])
        if len(self.known) < MEMO:
            self.known, self.known_ids = pa.concat_arrays([self.known, new]), every
        return every.take(pa.array(where))

    def _texts(self, texts: list[str]) -> pa.ListArray:
        """The ids of texts one by one."""
        return pa.array(self._encode(texts), pa.list_(pa.uint32()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers of the machine's order (little-endian)."""
        if not texts:
            return []
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        pieces = cut.flatten().dictionary_encode()
        which, first, words = pieces.indices.to_numpy(), cut.offsets.to_numpy(), pieces.dictionary
        odd = pc.match_substring_regex(words, self.odd)
        stems = pc.utf8_rtrim(words, characters=MARKS)
        parted = pc.and_(pc.match_substring_regex(stems, r"[\pL\pN]$"), pc.not_equal(pc.binary_length(stems), pc.binary_length(words)))
        stems = pc.if_else(parted, stems, words)
        tails = pc.struct_field(pc.extract_regex(pc.if_else(parted, words, ""), f"(?P<tail>[{re.escape(MARKS)}]*)$"), "tail")
        tails = pa.concat_arrays([tails, pa.array([""])]).dictionary_encode()
        stems = pc.if_else(odd, "x", stems)  # in a text that is encoded as it is
        stems = pc.if_else(pc.starts_with(stems, "\n"), stems, pc.binary_join_element_wise(" ", stems, "")).dictionary_encode()
        heads = words.take(pieces.indices.take(pa.array(first[:-1])))  # no space before them
        # A list of ids for each stem, each tail and each head; a piece is one of the first two and one of the tails.
        lists = pa.concat_arrays([self._pieces(stems.dictionary), self._texts(tails.dictionary.to_pylist()), self._texts(heads.to_pylist())])
        sizes = pc.list_value_length(lists).to_numpy()
        n, tail_of = len(stems.dictionary), tails.indices.to_numpy()
        both = np.empty((len(which), 2), np.int32)
        both[:, 0], both[:, 1] = stems.indices.to_numpy()[which], n + tail_of[which]
        both[first[:-1]] = np.stack([n + len(tails.dictionary) + np.arange(len(heads)), np.full(len(heads), n + tail_of[-1])], axis=1)
        flat = lists.take(pa.array(both.ravel())).flatten().to_numpy().tobytes()
        ends = 4 * np.append(0, np.cumsum(sizes[both].sum(axis=1)))[first]
        out = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        is_odd = odd.to_numpy(zero_copy_only=False)[which]
        is_odd[first[:-1]] = pc.match_substring_regex(heads, self.odd_head).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(np.logical_or.reduceat(is_odd, first[:-1])).tolist()
        for k, x in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = np.array(x, np.uint32).tobytes()
        return out


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids, used, counts), the ids packed for the intermediate table; one row of many has the ids that these use and their counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, end, squeeze = Encoder.cached(path), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=1).compress
        for batch, texts in slices(batches, most=2 << 20):
            ids = [x + end for x in encoder.encode(texts)]
            total = np.bincount(np.frombuffer(b"".join(ids), np.uint32))
            used, empty = np.flatnonzero(total), [None] * (len(ids) - 1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array([squeeze(_planes(x)) for x in ids], pa.binary()),
                "used": pa.array([used, *empty], pa.list_(pa.int32())), "counts": pa.array([total[used], *empty], pa.list_(pa.int64())),
            })

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, used array<int>, counts array<long>")


def _planes(ids: bytes) -> bytes:
    """The bytes of 32-bit integers by significance, which compress better."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return raw.reshape(4, -1).T.copy().view("<u4").ravel()


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits for positive counts, by package-merge."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    while 1 << most < n:
        most += 1
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    merged, levels = weights, []
    for _ in range(most - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)  # which entries of the level are single symbols
        merged = both[place]
    # Of the last level the first 2n - 2 entries count; each package among them stands for two of the level before.
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        symbols = int(single[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes for ids with given lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(ids) else 1
        steps = np.int64(1) << (self.bits - self.lengths)
        self.first = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(ids) else np.zeros(0, np.int64)
        self.steps = steps
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids], self.length[self.ids] = self.first >> (self.bits - self.lengths), self.lengths

    def encode(self, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the tokens, and how many each group of GROUP tokens has."""
        lengths = self.length[tokens]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        words = int(ends[-1] + 31) // 32 + 2
        shifted = self.code[tokens] << (64 - lengths - (starts & 31)).astype(np.uint64)
        high, low = (shifted >> np.uint64(32)).astype(np.float64), (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64)
        # Bits of different tokens don't overlap, so sums below 2 ** 32 are unions, and exact.
        place = starts >> 5
        out = np.bincount(place, high, words) + np.bincount(place + 1, low, words)
        marks = ends[GROUP - 1 :: GROUP] if len(ends) % GROUP == 0 else np.append(ends[GROUP - 1 :: GROUP], ends[-1])
        return out.astype(">u4").tobytes(), np.diff(marks, prepend=0).astype(np.int32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        symbols, lengths = np.repeat(self.ids, self.steps), np.repeat(self.lengths, self.steps)
        spare = (1 << self.bits) - len(symbols)
        return np.append(symbols, np.zeros(spare, np.uint32)), np.append(lengths, np.ones(spare, np.int64))

    def decode(self, payload: bytes, offsets: np.ndarray, n_tokens: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The tokens of a block. Any group can be decoded alone; here each step reads one token of every group."""
        symbols, lengths = tables
        stream = np.frombuffer(payload, ">u4").astype(np.uint64)
        pairs = (stream[:-1] << np.uint64(32)) | stream[1:]
        at = np.concatenate([[0], np.cumsum(offsets)[:-1]]).astype(np.int64)
        out = np.zeros((GROUP, len(at)), np.uint32)
        rest = n_tokens - GROUP * (len(at) - 1)
        mask, down = np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(GROUP):
            if k == rest:  # the last group is over
                at = at[:-1]
            window = (pairs[at >> 5] >> (down - (at & 31)).astype(np.uint64)) & mask
            out[k, : len(at)] = symbols[window]
            at = at + lengths[window]
        return out.T.ravel()[:n_tokens]


def write_corpus(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Tokenizes docs and writes codebook and blocks to the folder, documents in ascending doc_id order, nulls first."""
    tokens = Saved(tokenized(docs, tokenizer or default_tokenizer(), end_id), "tokens")
    counts = tokens.df.select(F.explode(F.arrays_zip("used", "counts")).alias("c")).groupBy(F.col("c.used").alias("id")).agg(F.sum("c.counts").alias("n"))
    counts = sorted(map(tuple, counts.collect()))  # at most the vocabulary
    ids, n = np.array([x for x, _ in counts], np.int64), np.array([x for _, x in counts], np.int64)
    lengths = code_lengths(n)
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(x)) for i, x in zip(ids, lengths)], "id long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part, block = Codebook(*shared.value), TaskContext.get().partitionId(), 0

        def full(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [_unpacked(packed) for _, packed in rows]
            payload, offsets = book.encode(np.concatenate(arrays))
            sizes = [len(x) for x in arrays]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": pa.array([len(rows)], pa.int32()), "n_tokens": pa.array([sum(sizes)], pa.int64()),
                "doc_ids": pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), "doc_tokens": pa.array([sizes], pa.list_(pa.int64())),
                "offsets": pa.array([offsets.tobytes()], pa.binary()), "payload": pa.array([payload], pa.binary()),
            })

        rows, total = [], 0
        for batch in batches:
            for doc_id, size, packed in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids")):
                rows.append((doc_id, packed.as_py()))
                total += size
                if total >= BLOCK_TOKENS:
                    yield full(rows)
                    rows, total, block = [], 0, block + 1
        if rows:
            yield full(rows)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.df.drop("used", "counts").withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    ordered.mapInArrow(pack, "part int, block int, n_docs int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, offsets binary, payload binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    tokens.delete()


def read_corpus(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a corpus folder: doc_id, start, n_tokens, ids_crc32, and ids with with_ids. Blocks are decoded independently."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    codes = spark.read.parquet(f"{folder}/codebook").collect()  # at most the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in codes], np.int64), np.array([r["length"] for r in codes], np.int64)))
    # Parts are ranges of doc_id, so where a part starts follows from the sizes of those before it: a row per part.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    bases = {r["part"]: r["base"] for r in sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")).collect()}
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = Saved(blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("before")), "places")
    based = spark.sparkContext.broadcast(bases)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(*shared.value)
        tables = book.tables()
        for batch in batches:
            for row in batch.to_pylist():
                tokens = book.decode(row["payload"], np.frombuffer(row["offsets"], np.int32), row["n_tokens"], tables)
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                each = [tokens[a:b].astype("<u4") for a, b in zip(starts, ends)]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts + (row["before"] + based.value[row["part"]]), pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.tolist() for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.join(places.sized(), ["part", "block"]).mapInArrow(unpack, schema)


def encode_corpus(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text) as a corpus folder and reads it back: doc_id, start, n_tokens, ids_crc32.

    Null texts are empty and have the end id only. Rows with equal ids are all written, ordered by length and content; null ids come first
    and stay null. Other columns are ignored. An empty table gives an empty corpus and result.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ontoloom/corpus-{uuid.uuid4().hex}"
    write_corpus(docs, folder, tokenizer)
    return read_corpus(spark, folder)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(documents(spark, sf_dir))
