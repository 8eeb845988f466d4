"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often each pair of ids does in the corpus.

Texts are cut where a space or line end follows a character that isn't white space. Neither tokenizer's tokens cross such a place: the
byte-level one begins a pre-token there, and no piece of the other has a space or line end after another character. So each distinct unit is
encoded and aligned once, and a text is a sequence of units. A pair (a, b) is one int64, a * 2 ** 32 + b. Tasks count the
distinct keys of what they read with np.unique; the partial counts are sorted by ranges, and equal neighbours are summed into sorted count
shards, files in the shared folder. A second pass maps the shards into memory and finds its keys' counts by np.searchsorted.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, documents, give_back, shared_dir, slices, worker_state

#: Bytes of text that are aligned together; one longer text is alone.
SLICE = 2 << 20
#: Units, and bytes of them, that a worker remembers, the first that it meets.
MEMO, MEMO_BYTES = 400_000, 24 << 20
#: Units that are encoded in one string.
TOGETHER = 64
#: Distinct keys that a task holds before it emits their counts.
HELD = 1 << 19
#: How SentencePiece writes a space.
SPACE = "▁"

#: ASCII characters that some tokenizer takes for white space.
_BLANK = np.zeros(256, bool)
_BLANK[[0, *range(9, 14), *range(28, 33)]] = True


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Units(NamedTuple):
    """What units have, side by side: tokens of both kinds, the keys of their links, their groups as text, each with a closing ";". Not ok: the tokens' bytes aren't the unit's."""

    n_a: np.ndarray
    n_b: np.ndarray
    keys: pa.ListArray
    groups: pa.BinaryArray
    ok: np.ndarray

    @classmethod
    def none(cls, n: int) -> Units:
        zeros = np.zeros(n, np.int64)
        return cls(zeros, zeros, pa.array([[]] * n, pa.list_(pa.int64())), pa.array([b""] * n, pa.binary()), np.zeros(n, bool))

    def __add__(self, other: Units) -> Units:
        return Units(*[pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y]) for x, y in zip(self, other)])

    def take(self, at: np.ndarray) -> Units:
        return Units(*[x.take(pa.array(at)) if isinstance(x, pa.Array) else x[at] for x in self])


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = pa.array(_byte_level(self.a.get_vocab()), pa.binary())
        self.bytes_b = pa.array([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)], pa.binary())
        self.sizes = [pc.binary_length(x).to_numpy().astype(np.int64) for x in (self.bytes_a, self.bytes_b)]
        #: Decimal ids with what can follow them.
        self.written = pa.array([b"%d%s" % (k, mark) for mark in (b",", b"|", b";") for k in range(len(self.bytes_a) + len(pieces))], pa.binary())
        #: A piece with a space or line end after something else, or a tokenizer that doesn't add a space, would forbid cutting.
        self.cuttable = not any(x[k] in f"{SPACE} \n" and x[k - 1] not in f"{SPACE} " for x in pieces for k in range(1, len(x))) and self.b.encode("\n") == [self.b.piece_to_id(SPACE), self.b.piece_to_id("<0x0A>")]
        self.lone = self.b.piece_to_id(SPACE)
        self.known, self.of_known = pa.array([], pa.binary()), Units.none(0)

    @classmethod
    def cached(cls, *paths: str) -> Aligner:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = worker_state().__dict__.setdefault("aligners", {})
        if paths not in known:
            known[paths] = cls(*paths)
        return known[paths]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that begin with a space or a line end; only a space is what the second tokenizer adds itself."""
        a, b = [], []
        for k in range(0, len(texts), 64):
            part = texts[k : k + 64]
            for x in self.a.encode_batch_fast(part, add_special_tokens=False):
                a += x.ids
            for x, ids in zip(part, self.b.encode([x.removeprefix(" ") for x in part], num_threads=1)):
                # The added space before a line end stands alone, as no piece has both. A lone space leaves the empty text, which isn't given one.
                b += [self.lone] if x == " " else ids[1:] if x[0] == "\n" else ids
        return np.array(a, np.int64), np.array(b, np.int64)

    def _aligned(self, units: list[str], together: int = TOGETHER) -> Units:
        """The alignment of units. Many are encoded in one string; where bytes or borders don't agree, halves are tried, down to single units."""
        sizes = np.fromiter((len(x.encode()) for x in units), np.int64, len(units))
        ids = self._encoded(["".join(units[k : k + together]) for k in range(0, len(units), together)])
        data, borders = np.frombuffer("".join(units).encode(), np.uint8), np.cumsum(sizes)
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids)]
        marks = [np.zeros(len(data) + 1, bool) for _ in ids]
        fits = all(len(x) and x[-1] == len(data) for x in ends)
        for mark, end in zip(marks, ends):
            if fits:
                mark[end] = True
        fits = fits and all(mark[borders].all() for mark in marks) and all(_spelt(spelling, x, data) for spelling, x in zip((self.bytes_a, self.bytes_b), ids))
        if not fits:
            if len(units) == 1:
                return Units.none(1)
            half = len(units) // 2
            return self._aligned(units[:half], max(1, together // 2)) + self._aligned(units[half:], max(1, together // 2))
        common = np.flatnonzero(marks[0] & marks[1])
        group = [np.searchsorted(common, end) for end in ends]
        last = [np.flatnonzero(np.append(x[1:] != x[:-1], True)) for x in group]
        starts = [np.append(0, x[:-1] + 1) for x in last]
        # In the text a group's tokens of the first kind come before those of the second.
        n = len(self.bytes_a) + len(self.bytes_b)
        codes, where = [x.copy() for x in ids], [np.arange(len(ids[0])) + starts[1][group[0]], np.arange(len(ids[1])) + (last[0] + 1)[group[1]]]
        for k in (0, 1):
            codes[k][last[k]] += n * (k + 1)
        every = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):
            every[where[k]] = codes[k]
        text = self.written.take(pa.array(every))
        unit_of = np.searchsorted(borders, common)  # of each group
        per_unit = np.append(0, np.cumsum(np.bincount(unit_of, minlength=len(units))))
        tokens = [np.append(-1, last[k])[per_unit] + 1 for k in (0, 1)]  # where the units' tokens begin, and end at last
        offsets = _offsets(text)[tokens[0] + tokens[1]]
        keys = ids[0][last[0]] << 32 | ids[1][last[1]]
        return Units(
            np.diff(tokens[0]), np.diff(tokens[1]), pa.ListArray.from_arrays(pa.array(per_unit.astype(np.int32)), pa.array(keys)),
            pa.BinaryArray.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(offsets.astype(np.int32)), text.buffers()[2]]), np.ones(len(units), bool),
        )

    def whole(self, text: str) -> Units:
        """The alignment of space+text without cutting it."""
        return self._aligned([" " + text]) if text else Units.none(1)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
        """Where each text's units start, which they are, and the distinct units. Empty texts have none."""
        data = b"".join([b" " + x.encode() if x else b"" for x in texts])
        sizes = np.array([len(x.encode()) + 1 if x else 0 for x in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), pa.array([], pa.binary())
        cut = np.zeros(len(raw) + 1, bool)
        if self.cuttable:
            gap = (raw[1:] == 32) | (raw[1:] == 10)
            cut[1:-1] = gap & ~_BLANK[raw[:-1]] & (raw[:-1] < 128)
            wide = np.flatnonzero(gap & (raw[:-1] >= 128)) + 1
            # After a letter beyond ASCII, too: other white space and the space's own sign begin with C2, E1, E2 or E3.
            lead2, lead3 = raw[wide - 2], raw[np.maximum(wide - 3, 0)]
            cut[wide[(lead2 >= 0xC3) & (lead2 < 0xE0) | (lead3 >= 0xE4) & (lead3 < 0xF0)]] = True
        cut[starts[sizes > 0]] = True
        cut[-1] = True
        at = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary()).dictionary_encode()
        first = np.searchsorted(at[:-1], starts)  # an empty text starts where the next one does
        return np.append(first, len(at) - 1), pieces.indices.to_numpy().astype(np.int64), pieces.dictionary

    def _units(self, words: pa.BinaryArray) -> Units:
        """The alignment of distinct units, of which some are known from texts before."""
        at = pc.index_in(words, value_set=self.known)
        is_new = np.asarray(pc.is_null(at))
        new = words.filter(pa.array(is_new))
        texts = [x.decode() for x in new.to_pylist()]
        every = self.of_known
        for k in range(0, len(texts), 1 << 14):
            every = every + self._aligned(texts[k : k + (1 << 14)])
        where = np.where(is_new, len(self.known) + np.cumsum(is_new) - 1, pc.fill_null(at, 0).to_numpy())
        if len(self.known) < MEMO and self.known.nbytes < MEMO_BYTES:
            self.known, self.of_known = pa.concat_arrays([self.known, new]), every
        return every.take(where)

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Units]:
        """Where each text's units start, which they are, and the units. A text with a unit that isn't what its tokens spell is one unit as a whole, and has none if it isn't either."""
        first, which, words = self.cut(texts)
        units = self._units(words)
        if units.ok.all():
            return first, which, units
        parts, n, more = [], len(units.ok), []
        for k in range(len(texts)):
            own = which[first[k] : first[k + 1]]
            if not units.ok[own].all():
                own, whole = own[:0], self.whole(texts[k])
                if whole.ok[0]:
                    own = np.array([n + len(more)])
                    more.append(whole)
            parts.append(own)
        for whole in more:
            units = units + whole
        return np.append(0, np.cumsum([len(x) for x in parts])), np.concatenate(parts).astype(np.int64), units


def _offsets(array: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)


def _spelt(spelling: pa.BinaryArray, ids: np.ndarray, data: np.ndarray) -> bool:
    """Whether the bytes of the ids are the data; both have as many."""
    return np.array_equal(np.frombuffer(spelling.take(pa.array(ids)).buffers()[2], np.uint8)[: len(data)], data)


def _byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each token of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes, in order, for the characters from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums between the places in first."""
    return np.diff(np.append(0, np.cumsum(values))[first])


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n."""
    each, place = np.unique(keys, return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, place, n)
    return each, total


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Slices of documents: (ids, numbers, hashes) a document, its units packed, the units' keys packed; and rows with partial counts (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        aligner, squeeze = Aligner.cached(path_a, path_b), zstandard.ZstdCompressor(level=1).compress
        held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def row(**columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([columns.get(f.name)], f.type) for f in SLICES], schema=SLICES)

        for batch, texts in slices(batches, most=SLICE):
            first, which, units = aligner.align(texts)
            keys, starts = units.keys.flatten().to_numpy(), units.keys.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            groups = units.groups.take(pa.array(which))
            ends, joined = _offsets(groups)[first].tolist(), memoryview(groups.buffers()[2] or b"")
            hashes = [hashlib.sha256(joined[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:])]
            yield row(
                doc_ids=batch.column("doc_id").to_pylist(), n_a=_sums(units.n_a[which], first), n_b=_sums(units.n_b[which], first), hashes=hashes,
                first=first.astype("<i8").tobytes(), which=squeeze(which.astype("<i4").tobytes()), starts=starts.astype("<i8").tobytes(), keys=squeeze(keys.astype("<i8").tobytes()),
            )
            times = np.bincount(which, minlength=len(units.ok))
            held = counted(np.concatenate([held[0], keys]), np.concatenate([held[1], np.repeat(times, np.diff(starts))]))
            if len(held[0]) > HELD:
                yield row(key=held[0], n=held[1])
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(held[0]):
            yield row(key=held[0], n=held[1])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_ids array<long>, n_a array<long>, n_b array<long>, hashes array<string>, first binary, which binary, starts binary, keys binary, key array<long>, n array<long>")


SLICES = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("hashes", pa.list_(pa.string())), *[(x, pa.binary()) for x in ("first", "which", "starts", "keys")], ("key", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


class Shards:
    """Sorted count shards: of each a file with its keys and a file with their counts, all in ascending ranges of keys."""

    def __init__(self, spark: SparkSession, counts: DataFrame, folder: str):
        """counts: partial counts (key, n). Each range of keys becomes a shard; the manifest's rows name the files of the attempts that succeeded."""
        uri = folder if urlparse(folder).scheme else f"file://{os.path.abspath(folder)}"

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            name, n, ends, best = f"shard-{uuid.uuid4().hex}", 0, [], {}
            rest: tuple[np.ndarray, np.ndarray] | None = None
            keys_out = n_out = None

            def put(keys: np.ndarray, total: np.ndarray) -> None:
                keys_out.write(keys.astype("<i8").tobytes())
                n_out.write(total.astype("<i8").tobytes())
                at, top = counted_most(keys & 0xFFFFFFFF, total)
                for b, most in zip(at.tolist(), top.tolist()):
                    best[b] = max(best.get(b, 0), most)

            for batch in batches:
                if not len(batch):
                    continue
                if rest is None:
                    store.create_dir(path, recursive=True)
                    keys_out, n_out = (store.open_output_stream(f"{path}/{name}.{x}") for x in ("keys", "n"))
                    rest, ends = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [batch.column("key")[0].as_py()]
                keys, total = np.append(rest[0], batch.column("key").to_numpy()), np.append(rest[1], batch.column("n").to_numpy())
                begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, total = keys[begins], np.add.reduceat(total, begins)
                put(keys[:-1], total[:-1])
                n, rest = n + len(keys) - 1, (keys[-1:], total[-1:])
            if rest is not None:
                put(*rest)
                keys_out.close()
                n_out.close()
                yield pa.RecordBatch.from_pydict({"name": [name], "low": pa.array(ends, pa.int64()), "high": pa.array(rest[0]), "n": pa.array([n + 1], pa.int64()), "b": pa.array([list(best)], pa.list_(pa.int64())), "most": pa.array([list(best.values())], pa.list_(pa.int64()))})

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = counts.repartitionByRange(parts, "key").sortWithinPartitions("key")
        manifest = Saved(ordered.mapInArrow(write, "name string, low long, high long, n long, b array<long>, most array<long>"), "shards")
        self.files = [(r["name"], r["low"], r["high"], r["n"]) for r in manifest.df.select("name", "low", "high", "n").orderBy("low").collect()]  # a row per shard
        most = manifest.df.select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most").alias("most")).collect()  # the second vocabulary
        manifest.delete()
        self.best = np.zeros(max((r["b"] for r in most), default=-1) + 1, np.int64)
        self.best[[r["b"] for r in most]] = [r["most"] for r in most]
        self.place = urlparse(uri).path if uri.startswith("file:") else None
        if self.place is None:  # a store that can't be mapped: executors fetch the files from it
            for name, *_ in self.files:
                for x in ("keys", "n"):
                    spark.sparkContext.addFile(f"{uri}/{name}.{x}")

    def __getstate__(self) -> dict:
        return {"files": self.files, "place": self.place, "best": self.best}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys in ascending order, each of which is in a shard."""
        out = np.zeros(len(keys), np.int64)
        mapped = worker_state().__dict__.setdefault("shards", {})
        for name, low, high, n in self.files:
            a, b = np.searchsorted(keys, low), np.searchsorted(keys, high, "right")
            if a < b:
                if name not in mapped:
                    if len(mapped) > 4096:
                        mapped.clear()
                    mapped[name] = [np.memmap(os.path.join(self.place, f"{name}.{x}") if self.place else SparkFiles.get(f"{name}.{x}"), "<i8", "r", shape=(n,)) for x in ("keys", "n")]
                where, total = mapped[name]
                out[a:b] = total[np.searchsorted(where, keys[a:b])]
        return out


def counted_most(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the largest n of each."""
    at = np.lexsort((n, keys))
    last = np.flatnonzero(np.append(keys[at][1:] != keys[at][:-1], True)) if len(keys) else at
    return keys[at][last], n[at][last]


class Alignment:
    """An aligned corpus: its slices as a table, its pair counts as shards."""

    def __init__(self, docs: DataFrame, path_a: str | None = None, path_b: str | None = None):
        defaults = default_tokenizers()
        spark = docs.sparkSession
        self.slices = Saved(aligned(docs, path_a or defaults[0], path_b or defaults[1]), "aligned")
        partial = self.slices.df.where("key IS NOT NULL").select(F.explode(F.arrays_zip("key", "n")).alias("x")).select("x.key", "x.n")
        self.shards = Shards(spark, partial, f"{shared_dir(spark)}/ontoloom/pair-counts-{uuid.uuid4().hex}")
        self.spark = spark

    def pairs(self) -> DataFrame:
        """(a, b, n): how often tokens a and b end together."""
        keys = self.slices.df.where("key IS NOT NULL").select(F.explode(F.arrays_zip("key", "n")).alias("x")).groupBy("x.key").agg(F.sum("x.n").alias("n")).where("n > 0")  # units of texts that were aligned anew have 0
        return keys.select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
        shared = self.spark.sparkContext.broadcast(self.shards)  # the second vocabulary's counts, and a row per shard

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            expand, shards = zstandard.ZstdDecompressor().decompress, shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    first, which = np.frombuffer(row["first"], "<i8"), np.frombuffer(expand(row["which"]), "<i4")
                    starts, keys = np.frombuffer(row["starts"], "<i8"), np.frombuffer(expand(row["keys"]), "<i8")
                    each, place = np.unique(keys, return_inverse=True)
                    n = shards.counts(each)
                    best = n == shards.best[each & 0xFFFFFFFF]
                    per_unit = [_sums(x[place].astype(np.int64), starts) for x in (best, n)]
                    links = _sums(np.diff(starts)[which], first)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_a": pa.array(row["n_a"], pa.int64()), "n_b": pa.array(row["n_b"], pa.int64()), "n_groups": pa.array(links), "n_links": pa.array(links),
                        "n_best": pa.array(_sums(per_unit[0][which], first)), "count_sum": pa.array(_sums(per_unit[1][which], first)), "groups_sha256": pa.array(row["hashes"], pa.string()),
                    })

        return self.slices.df.where("doc_ids IS NOT NULL").drop("key", "n").mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs (doc_id, text): byte-level tokens beside SentencePiece's.

    A text that is null or empty, or isn't what the tokens' bytes spell (the sign U+2581 reads as a space), has no tokens: zeros and ''.
    A group ends where tokens of both end, so it has one link, that of its last two tokens. Repeated rows count again; null ids stay null;
    other columns are ignored; an empty table gives no row. A very long text is aligned as a whole in one task.
    """
    return Alignment(docs, path_a, path_b).documents()


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))
