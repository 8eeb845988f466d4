"""Suffix-array dedup: longest-previous-factor arrays over groups of passages that share a gram.

A global suffix array doesn't fit a task. But two equal strings of L bytes have the same anchor: the gram of L / 2 bytes with the
smallest hash, the leftmost of equals, at the same distance. So only the surroundings of grams that occur more than once are sorted:
1. One scan finds the anchors of each text, with the starts that each stands for; exact copies count as one text.
2. For anchors that occur twice or more, a second scan cuts their contexts: the bytes before and after the gram that strings with this
   anchor cover. Equal contexts are counted, not repeated; they are told apart by 128-bit digests of their bytes.
3. The contexts of one gram form a group. A suffix array of several groups, in which the gram is one symbol, gives the previous and next
   smaller positions in suffix order, and the common prefixes with these are the longest previous factors; the mirror image of
   positions gives the longest later ones. A start with a factor of L bytes is repeated.
4. A group of more than SORT_SYMBOLS is parted: its contexts are cut at ranges of distances from the anchor, and what the strings of one
   range have in common becomes the gram by which they are grouped anew. So any number of contexts of one gram spreads over all
   tasks; in the last step a range is a single distance, and all contexts of a group are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, documents, slices
from ontoloom.llm.neardup import _mix

#: Starts that are searched for anchors at a time.
SEGMENT_BITS = 18
#: Symbols of contexts that are sorted at a time, 2 ** 21 - 1 at most.
SORT_SYMBOLS = 1 << 19
#: Distances from the anchor that contexts of large groups are cut at, step by step.
RANGES = (24, 1)


class RollingHash:
    """Hashes of all substrings of one length, by differences of a running polynomial."""

    def __init__(self):
        self.values = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
        self.base = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, size: int) -> np.ndarray:
        n = len(data)
        if n < size:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(m - 1, b)]).cumprod(dtype=np.uint64) for b in (self.base, self.inverse))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=run[1:])
        return _mix((run[size:] - run[:-size]) * self.down[: n - size + 1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each window, from running minima of blocks of the window's size in both directions."""
    n = len(x)
    padded = np.full(-(-n // size) * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - size + 1], forward[size - 1 : n])


def anchors(text: bytes, length: int, rolling: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, low, high, hash) of the anchors of all strings of `length` bytes; an anchor stands for the starts low to high.

    At the end of a segment the starts of an anchor may be parted; what is compared are starts, so that nothing is lost.
    """
    gram, step = length // 2, 1 << SEGMENT_BITS
    window, mask = length - gram + 1, np.uint64((1 << (SEGMENT_BITS + 1)) - 1)
    data, parts = np.frombuffer(text, np.uint8), []
    for base in range(0, len(text) - length + 1, step):
        h = rolling.of(data[base : base + step + length - 1], gram)
        key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # of equal grams, the leftmost
        place = (sliding_min(key, window) & mask).astype(np.int64)
        low = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        high = np.append(low[1:] - 1, len(place) - 1)
        parts.append((place[low] + base, low + base, high + base, h[place[low]].view(np.int64)))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _dense(keys: np.ndarray, n: int) -> np.ndarray:
    """Ranks of pairs of ranks below 2 ** 21, equal for equal pairs; sorts pair and place in one integer."""
    packed = (keys << np.uint64(21)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    place = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
    packed >>= np.uint64(21)
    step = np.zeros(n, np.uint32)
    step[1:] = packed[1:] != packed[:-1]
    out = np.empty(n, np.uint32)
    out[place] = np.cumsum(step, dtype=np.uint32)
    return out


def _smaller_before(x: np.ndarray) -> np.ndarray:
    """For each index, the nearest one before it with a smaller value, or -1: jumps over stretches that are known to be larger."""
    jump = np.arange(-1, len(x) - 1)
    open_ = np.arange(len(x))
    while len(open_):
        to = jump[open_]
        open_ = open_[(to >= 0) & (x[to] > x[open_])]
        jump[open_] = jump[jump[open_]]
    return jump


def longest_factors(symbols: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(previous, later) for sorted starts: the lengths, `most` at most, of the longest factors from there that also begin at an earlier or a later start.

    The suffix array is made by doubling prefixes up to `most` symbols. The longest previous factor of a position is the common prefix with the
    previous or next smaller position in suffix order; common prefixes are read from the ranks of the doublings.
    """
    n = len(symbols) + most
    padded = np.zeros(n, np.uint64)
    padded[: len(symbols)] = symbols.astype(np.uint64) + 1
    rank, have, levels = _dense(padded, n), 1, []
    while have < most:
        levels.append((have, rank))
        more = min(have, most - have)
        second = np.append(rank[more:], np.zeros(more, np.uint32)).astype(np.uint64)
        rank = _dense((rank.astype(np.uint64) << np.uint64(21)) | second, n)
        have += more

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, full, length = a.copy(), b.copy(), rank[a] == rank[b], np.zeros(len(a), np.int64)
        for k, ranks in reversed(levels):
            same = np.where(ranks[a] == ranks[b], k, 0)
            a, b, length = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1), length + same
        return np.where(full, most, np.minimum(length, most))

    order = np.argsort(rank[starts], kind="stable")
    suffixes = starts[order]
    out = []
    for at in (suffixes, -suffixes):
        best = np.zeros(len(starts), np.int64)
        for found, reverse in ((_smaller_before(at), False), (_smaller_before(at[::-1]), True)):
            if reverse:
                found = np.where(found >= 0, len(at) - 1 - found, -1)[::-1]
            hit = np.flatnonzero(found >= 0)
            best[hit] = np.maximum(best[hit], common(suffixes[hit], suffixes[found[hit]]))
        lengths = np.empty(len(starts), np.int64)
        lengths[order] = best
        out.append(lengths)
    return out[0], out[1]


def spans_of(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Maximal runs covered by strings of `length` bytes at sorted starts."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist()


def merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digest(key: bytes, left: bytes, right: bytes) -> bytes:
    return hashlib.md5(b"%d " % len(left) + key + left + right).digest()


def _cutter(length: int):
    """Contexts of the wanted anchors of each text; those that a text repeats are one row with several offsets."""
    gram = length // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            for k, text in enumerate(texts):
                data, at, rows = text.encode(), batch.column("at")[k].as_py(), {}
                doc_id, uid = batch.column("doc_id").slice(k, 1), batch.column("uid")[k].as_py()
                for a in at:
                    place, low = a["place"], a["low"]
                    key = hashlib.md5(data[place : place + gram]).digest()
                    left, right = data[low:place], data[place + gram : a["high"] + length]
                    rows.setdefault(_digest(key, left, right), (key, left, right, []))[3].append(low)
                parts = [(i, key, left, right, sorted(lows)[b : b + 4096]) for i, (key, left, right, lows) in rows.items() for b in range(0, len(lows), 4096)]
                for b in range(0, len(parts), 2048):
                    ids, keys, lefts, rights, lows = zip(*parts[b : b + 2048])
                    n = len(ids)
                    yield pa.RecordBatch.from_pydict({
                        "owner": pa.array([uid] * n, pa.int64()), "offsets": pa.array(lows, pa.list_(pa.int32())), "doc_id": doc_id.take(pa.array([0] * n)), "uid": pa.array([uid] * n, pa.int64()),
                        "at": pa.array([x[0] for x in lows], pa.int32()), "id": pa.array(ids, pa.binary()), "key": pa.array(keys, pa.binary()), "left": pa.array(lefts, pa.binary()), "right": pa.array(rights, pa.binary()),
                    })

    return cut


def _parter(length: int, core: int, width: int):
    """Cuts contexts at ranges of `width` distances from the anchor; the strings of a range have length - width + 1 bytes in common."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, len(batch), 1024):
                rows = []
                piece = batch.slice(b, 1024)
                for k, (i, key, left, right) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("id", "key", "left", "right")))):
                    far, near = len(left), length - core - len(right)  # distances of the first and the last start
                    for j in range(near // width, far // width + 1):
                        first, last = min(j * width + width - 1, far), max(j * width, near)
                        low = min(j * width, length - core + 1 - width)  # the last range is filled up to the same width
                        high = low + width - 1
                        tail, head = left[far - low :], right[: length - core - high]
                        new = left[far - first : far - low], right[length - core - high : length - core - last]
                        key_ = hashlib.md5(b"%d %d " % (j, len(tail)) + key + tail + head).digest()
                        rows.append((k, i, far - first, key_, _digest(key_, *new), *new))
                source, owner, offset, keys, ids, lefts, rights = zip(*rows)
                of = pa.array(source)
                yield pa.RecordBatch.from_pydict({
                    "owner": pa.array(owner, pa.binary()), "offsets": pa.array([[x] for x in offset], pa.list_(pa.int32())), "doc_id": piece.column("doc_id").take(of), "uid": piece.column("uid").take(of),
                    "at": pa.array([a + x for a, x in zip(piece.column("at").take(of).to_pylist(), offset)], pa.int32()), "id": pa.array(ids, pa.binary()), "key": pa.array(keys, pa.binary()),
                    "left": pa.array(lefts, pa.binary()), "right": pa.array(rights, pa.binary()),
                })

    return part


def _sorter(length: int, core: int, keep: str, most: int):
    """Rows come sorted by key and order. Whole groups are sorted together, `most` symbols at a time."""
    span = length - core + 1  # symbols of a string, of which the gram is one

    def done(groups: list[list[tuple]]) -> pa.RecordBatch:
        rows = [r for g in groups for r in g]
        left, right = (np.array([len(r[k]) for r in rows]) for k in (1, 2))
        ends = np.cumsum(left + right + 2)
        begin = ends - left - right - 2
        symbols = np.frombuffer(b"".join(x for _, a, b in rows for x in (a, b"\0", b, b"\0")), np.uint8).astype(np.int32)
        symbols[begin + left] = 256 + np.repeat(np.arange(len(groups)), [len(g) for g in groups])  # the gram
        symbols[ends - 1] = 256 + len(groups) + np.arange(len(rows))  # nothing matches across a context's end
        many = left + right + 2 - span
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(begin, many) + inner
        previous, later = longest_factors(symbols, starts, span)
        hit = previous >= span if keep == "first" else np.maximum(previous, later) >= span
        owner, inner = np.repeat(np.arange(len(rows)), many)[hit], inner[hit]
        cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
        out = [(r[0], *spans_of(inner[cuts[k] : cuts[k + 1]], length)) for k, r in enumerate(rows) if cuts[k] < cuts[k + 1]]
        ids, a, b = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.binary()), "starts": pa.array(a, pa.list_(pa.int64())), "ends": pa.array(b, pa.list_(pa.int64()))})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        group: list[tuple] = []
        size = total = 0
        last = None
        for batch in batches:
            for b in range(0, len(batch), 1024):
                piece = batch.slice(b, 1024)
                for key, *row in zip(*(piece.column(c).to_pylist() for c in ("key", "id", "left", "right"))):
                    if key != last and group:
                        if held and total + size > most:
                            yield done(held)
                            held, total = [], 0
                        held.append(group)
                        total += size
                        group, size = [], 0
                    last = key
                    group.append(tuple(row))
                    size += len(row[1]) + len(row[2]) + 2
        for part in ([*held, group],) if total + size <= most else (held, [group]):
            if part and part[-1]:
                yield done(part)

    return sort


def _located(pieces: DataFrame, owner_type: str, length: int, core: int, ranges: tuple[int, ...], keep: str, most: int) -> DataFrame:
    """(owner, ranges): what is repeated in the contexts of pieces, by their owner. pieces: owner, offsets, doc_id, uid, at, id, key, left, right."""
    saved = Saved(pieces, "contexts")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "at")
    kinds = saved.df.groupBy("id").agg(F.sum(F.size("offsets")).alias("n"), F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("key", "left", "right")])
    kinds = Saved(kinds.withColumn("size", (F.octet_length("left") + F.octet_length("right") + core).cast("long")), "kinds")
    places = Saved(saved.df.select("id", "owner", "offsets", order.alias("order")), "places")
    saved.delete()
    groups = Saved(kinds.df.groupBy("key").agg(F.count("*").alias("many"), F.sum(F.col("size") + 2 - core).alias("symbols")).where("many > 1"), "groups")
    fitting = Saved(groups.df.where(F.col("symbols") <= most).select("key"), "fitting")
    large = Saved(groups.df.where(F.col("symbols") > most).select("key"), "large")
    groups.delete()
    columns = ("id", "key", "left", "right", "first")
    several = kinds.df.join(fitting.sized(), "key").select(*columns)
    found = Saved(several.repartition("key").sortWithinPartitions("key", "first").select(*columns[:4]).mapInArrow(_sorter(length, core, keep, most), "id binary, starts array<long>, ends array<long>"), "found")
    ranged = found.df.select("id", F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")).alias("ranges"))
    if ranges and not large.df.isEmpty():
        rest = kinds.df.join(large.sized(), "key", "left_semi").select("id", "key", "left", "right", "first.doc_id", "first.uid", "first.at")
        wide = min(ranges[0], length - core + 1)
        cut = rest.mapInArrow(_parter(length, core, wide), _SCHEMA.format(owner="binary", doc_id=kinds.df.schema["first"].dataType["doc_id"].dataType.simpleString()))
        inner = _located(cut, "binary", length, length - wide + 1, ranges[1:], keep, most)
        ranged = ranged.unionByName(inner.withColumnRenamed("owner", "id"))
    marks = kinds.df.select("id", "n", "first", "size").join(ranged, "id", "left").where((F.col("n") > 1) | F.col("ranges").isNotNull())
    marks = Saved(marks, "marks")
    for x in (kinds, found, fitting, large):
        x.delete()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")))
    own = F.coalesce("ranges", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    if keep == "first":  # only the first place of a context has an earlier copy in other contexts at most
        chosen = lambda k: F.when((F.col("order") == F.col("first")) & (k == 0), own).otherwise(whole)
    else:
        chosen = lambda k: F.when(F.col("n") > 1, whole).otherwise(own)
    moved = F.flatten(F.transform("offsets", lambda x, k: F.transform(chosen(k), lambda r: F.struct((r["a"] + x).alias("a"), (r["b"] + x).alias("b")))))
    out = Saved(places.df.join(marks.sized(), "id").select("owner", moved.alias("ranges")).groupBy("owner").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    marks.delete()
    places.delete()
    return out.df


_SCHEMA = "owner {owner}, offsets array<int>, doc_id {doc_id}, uid long, at int, id binary, key binary, left binary, right binary"


def repeated_spans(docs: DataFrame, length: int = 400, keep: str = "none", most: int = SORT_SYMBOLS) -> Saved:
    """(digest, doc_id, copies, n_bytes, ranges): for each text with repeats, by its MD5 digest, the byte ranges covered by strings of `length` bytes that start anywhere else too.

    With keep="first", the ranges of strings with an earlier start: smaller doc_id (nulls last), then smaller position. copies: how many rows
    have the text; doc_id: the smallest of theirs. A text that several rows have is repeated as a whole, if it is long enough.
    """
    texts = docs.select("doc_id", "text").where(F.octet_length("text") >= length).withColumn("digest", F.unhex(F.md5("text")))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, uid = RollingHash(), TaskContext.get().partitionId() << 36
        for batch, part in slices(batches):
            data = [x.encode() for x in part]
            found = [anchors(x, length, rolling) for x in data]
            lists = {c: pa.array([f[k] for f in found], pa.list_(pa.int64() if c == "hashes" else pa.int32())) for k, c in enumerate(("places", "lows", "highs", "hashes"))}
            yield pa.RecordBatch.from_pydict({"digest": batch.column("digest"), "doc_id": batch.column("doc_id"), "uid": np.arange(uid, uid + len(data)), "n_bytes": pa.array([len(x) for x in data], pa.int64())} | lists)
            uid += len(data)

    scanned = Saved(texts.mapInArrow(find, f"digest binary, doc_id {id_type}, uid long, n_bytes long, places array<int>, lows array<int>, highs array<int>, hashes array<long>"), "anchors")
    known = scanned.df.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("r"), F.first("n_bytes").alias("n_bytes"))
    distinct = Saved(known.select("digest", "copies", "r.doc_id", "r.uid", "n_bytes"), "texts")
    # One row of each text goes on; the arrays of the others are left out without moving them, if these are few.
    copied = Saved(distinct.df.where("copies > 1").select("digest", F.col("uid").alias("kept")), "copied")
    others = Saved(scanned.df.select("digest", "uid").join(copied.sized(), "digest").where(F.col("uid") != F.col("kept")).select("uid"), "others")
    chosen = scanned.df.join(others.sized(), "uid", "left_anti")
    hashes = Saved(chosen.select("uid", F.explode(F.arrays_zip("places", "lows", "highs", "hashes")).alias("a")).select("uid", F.col("a.places").alias("place"), F.col("a.lows").alias("low"), F.col("a.highs").alias("high"), F.col("a.hashes").alias("hash")), "placed")
    for x in (scanned, copied, others):
        x.delete()
    shared = Saved(hashes.df.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")
    wanted = hashes.df.join(shared.sized(), "hash").groupBy("uid").agg(F.collect_list(F.struct("place", "low", "high")).alias("at"))
    wanted = Saved(distinct.df.select("uid", "digest", "doc_id").join(wanted, "uid"), "wanted")
    hashes.delete()
    shared.delete()
    # By id as well as digest, so that the copies of a frequent text are not gathered.
    side = wanted.sized().select("uid", "at", F.col("digest").alias("d"), F.col("doc_id").alias("i"))
    sources = texts.join(side, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "uid", "text", "at")
    cut = sources.mapInArrow(_cutter(length), _SCHEMA.format(owner="long", doc_id=id_type))
    by_text = _located(cut, "long", length, length // 2, RANGES, keep, most).withColumnRenamed("owner", "uid")
    wanted.delete()
    spans = distinct.df.join(by_text, "uid", "left").where((F.col("copies") > 1) | F.col("ranges").isNotNull())
    out = Saved(spans.select("digest", "doc_id", "copies", "n_bytes", "ranges"), "spans")
    distinct.delete()
    return out


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "none", most: int = SORT_SYMBOLS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (array of start, end), kept (the bytes that are left).

    docs needs doc_id and text; other columns are ignored. A byte goes if it lies in a string of `length` bytes that also starts anywhere
    else in any document, itself included; matches don't cross documents, overlaps count, and all copies go, the first too. With
    keep="first" the first copy stays: of equal strings the one in the smallest doc_id (nulls last), then at the smallest position.

    Null and empty texts have 0 bytes and no spans, as have all texts of fewer than `length` bytes. Null ids stay null. A repeated row is a copy
    of its text, so every copy goes; with keep="first", rows with the same id and text count as one document and stay alike. An
    empty table gives an empty result. most: symbols that are sorted at a time.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    spans = repeated_spans(docs, length, keep, most)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b")))
    again = F.col("copies") > 1
    if keep == "first":
        again &= ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    marked = text.join(spans.sized().withColumnRenamed("doc_id", "first_id"), "digest", "left")
    joined = marked.select("doc_id", "text", F.when(again, everything).otherwise(F.col("ranges")).alias("ranges"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches):
            data = [x.encode() for x in part]
            cuts = [merged([(r["a"], r["b"]) for r in x]) if x else [] for x in batch.column("ranges").to_pylist()]
            kept = [b"".join([x[a:b] for a, b in zip([0, *[b for _, b in c]], [*[a for a, _ in c], len(x)])]) if c else x for x, c in zip(data, cuts)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(x) for x in data], pa.int64()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in c] for c in cuts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
            })

    return joined.mapInArrow(strip, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return done.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
