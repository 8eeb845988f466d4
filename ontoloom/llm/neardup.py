"""MinHash near-duplicates with circulant permutations, banding and exact Jaccard verification.

1. One scan gives each row a class (digest of its word sequence), the size of its shingle set and its band keys.
   Exact copies share a class and go on as one node.
2. Nodes with a band key in common form a bucket. In each round every member of a bucket is compared with one hub,
   not with all others; links found merge components, and only buckets that still hold several components go on.
3. What stays after the hub rounds meets by its rarest shingles, which is exact and parts the members of a large bucket that
   have just a passage in common; pairs from different components are compared, so that no link is lost.
4. Pairs are confirmed on full sets of 64-bit shingle hashes, which depend on the bytes and the order of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, chunks, documents, slices
from ontoloom.llm.components import connected_components

#: Rows and bands: a pair with a Jaccard similarity of 0.8 shares no band with a probability of 5e-6.
BAND_ROWS, BANDS = 6, 40
#: Positions that the second permutation runs over.
DOMAIN_BITS = 20
#: Rounds in which the members of a bucket meet a hub only.
HUB_ROUNDS = 2
#: 64-bit words that mark a set: bit k is the parity of the shingles whose hash begins with k. Two sets differ in at least as many shingles as bits.
MARKS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the constants are those of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the word shingles of normalised texts. A word's hash comes from a polynomial over its bytes, a shingle's from a chain of mixes over its words' hashes.

    Differences of such a polynomial vanish for some pairs of long words (a Thue-Morse word and its complement), so longer words are hashed by BLAKE2b.
    """

    #: Bytes up to which a word goes through the polynomial; the differences above need more than a thousand.
    SHORT = 64

    def __init__(self, words: int):
        self.words = words
        self.values = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            m = 1 << (n - 1).bit_length()
            self._up, self._down = (np.concatenate([[np.uint64(1)], np.full(m - 1, b)]).cumprod(dtype=np.uint64) for b in (self.base, self.inverse))

    def hashes(self, text: bytes) -> np.ndarray:
        """Of a text whose words are joined by single spaces; the whole sequence if it has fewer words. Not distinct, in order."""
        if not text:
            return np.zeros(0, np.uint64)
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        self._powers(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self._up[:n], out=run[1:])
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [n]])
        each = _mix((run[ends] - run[starts]) * self._down[starts])
        for k in np.flatnonzero(ends - starts > self.SHORT).tolist():
            each[k] = int.from_bytes(hashlib.blake2b(text[starts[k] : ends[k]], digest_size=8).digest(), "little")
        size = min(self.words, len(each))
        n = len(each) - size + 1
        out = each[:n]
        for k in range(1, size):
            out = _mix(out * self.base + each[k : n + k])
        return out


class CirculantMinHash:
    """Signature coordinate k is the minimum of pi(sigma(x) + k): two permutations, the second one shifted in a circle.

    The values of all coordinates for one element lie side by side in pi, so that a signature is a minimum over
    slices of one table.
    """

    def __init__(self, coordinates: int, seed: int = 7):
        size = 1 << DOMAIN_BITS
        rng = np.random.default_rng(seed)
        self.sigma = rng.permutation(size).astype(np.uint32)
        pi = rng.permutation(size).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coordinates - 1]]), coordinates)
        self.coordinates = coordinates

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.sigma[(hashes >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)]
        low = np.full(self.coordinates, np.uint32(0xFFFFFFFF))
        for k in range(0, len(places), 2048):
            np.minimum(low, self.slices[places[k : k + 2048]].min(axis=0), out=low)
        return low


def normalise(text: str | None) -> bytes:
    """Words in the sense of the contracts, A-Z lower-cased, joined by single spaces."""
    return b" ".join((text or "").encode().lower().split())


def _class_of(text: bytes) -> tuple[int, int]:
    digest = hashlib.md5(text).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signer(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(words), CirculantMinHash(BANDS * BAND_ROWS)
        factors = np.random.default_rng(3).integers(0, 1 << 63, (BANDS, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
        uid = TaskContext.get().partitionId() << 36
        last: dict[bytes, tuple] = {}
        for batch, texts in slices(batches):
            rows = []
            for text in map(normalise, texts):
                c1, c2 = _class_of(text)
                if (c1, c2) not in last:
                    if len(last) > 5000:
                        last.clear()
                    hashes = np.unique(shingler.hashes(text))
                    keys = None
                    if len(hashes):
                        sig = minhash.signature(hashes).reshape(BANDS, BAND_ROWS)
                        keys = _mix((sig.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    last[c1, c2] = len(hashes), keys
                rows.append((c1, c2, *last[c1, c2]))
            c1, c2, n, keys = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "uid": np.arange(uid, uid + len(rows)), "c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64()),
                "n_shingles": pa.array(n, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64())),
            })
            uid += len(rows)

    return sign


def _set_maker(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for a, b in chunks([len(x or b"") for x in batch.column("words").to_pylist()], 2 << 20):
                part = batch.slice(a, b - a)
                sets = [np.unique(shingler.hashes(x)).tobytes() for x in part.column("words").to_pylist()]
                parity = [np.packbits((np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * MARKS) & 1).astype(np.uint8)).view(np.int64) for x in sets]
                marks = {f"m{k}": pa.array([x[k] for x in parity], pa.int64()) for k in range(MARKS)}
                yield pa.RecordBatch.from_pydict({"uid": part.column("uid"), "shingles": pa.array(sets, pa.binary())} | marks)

    return make


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        words = [normalise(x) for x in texts]
        both = [_class_of(x) for x in words]
        yield pa.RecordBatch.from_pydict({"c1": pa.array([x for x, _ in both], pa.int64()), "c2": pa.array([x for _, x in both], pa.int64()), "words": pa.array(words, pa.binary())})


def _comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            linked = []
            for k in range(len(batch)):
                a, b = np.frombuffer(left[k].as_buffer(), np.uint64), np.frombuffer(right[k].as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")  # merges two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return compare


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Two texts are linked if their sets of
    words-word shingles have 100 * intersection >= percent * union; component_id is the smallest doc_id that
    can be reached, kept is doc_id = component_id.

    Null and empty texts and texts without words have empty sets, are linked with nothing and are kept. Null doc_ids take part
    with their texts but are never a component's id, unless it has no other: then component_id is null and kept true. Repeated
    rows each give a row, with equal results. An empty table gives an empty result.
    """
    return grouped_rows(docs, words, percent).drop("text_hash", "component")


def grouped_rows(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """near_duplicates with two columns more: text_hash (xxhash64 of the text), and component, an internal id, null for rows without partner."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = Saved(source.mapInArrow(_signer(words), f"doc_id {id_type}, text_hash long, uid long, c1 long, c2 long, n_shingles long, bands array<long>"), "signed").df
    classes = signed.where(F.col("n_shingles") > 0).groupBy("c1", "c2").agg(F.min(F.struct("uid", "n_shingles", "bands")).alias("r"))
    classes = Saved(classes.select("c1", "c2", "r.*"), "classes").df
    banded = classes.select("uid", "n_shingles", F.explode("bands").alias("key"))
    shared = Saved(banded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key"), "shared")
    members = Saved(banded.join(shared.sized(), "key"), "members")
    shared.delete()

    nodes = Saved(classes.join(members.df.select("uid").distinct(), "uid", "left_semi").select("uid", "c1", "c2"), "nodes")
    found = docs.select("text").mapInArrow(_classes, "c1 long, c2 long, words binary").join(nodes.sized(), ["c1", "c2"])
    sets = Saved(found.groupBy("uid").agg(F.first("words").alias("words")).mapInArrow(_set_maker(words), "uid long, shingles binary" + "".join(f", m{k} long" for k in range(MARKS))), "sets")
    nodes.delete()

    def confirmed(pairs: DataFrame) -> Saved:
        """Of pairs (a, b), those whose sets are similar enough."""
        left = sets.sized().select(F.col("uid").alias("a"), F.col("shingles").alias("sa"))
        right = sets.sized().select(F.col("uid").alias("b"), F.col("shingles").alias("sb"))
        return Saved(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(_comparer(percent), "a long, b long"), "links")

    def alike(x: str, y: str):
        """Sizes that allow the similarity."""
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    edges: DataFrame | None = None
    active, held = members.df.withColumn("comp", F.col("uid")), None
    for turn in range(HUB_ROUNDS):
        order = F.col("uid") if turn == 0 else F.xxhash64(F.lit(turn), F.col("uid"))
        hubs = active.groupBy("key").agg(F.min(F.struct(order.alias("o"), "uid", "n_shingles", "comp")).alias("hub"))
        pairs = active.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & alike("n_shingles", "hub.n_shingles"))
        pairs = pairs.select(F.least("uid", "hub.uid").alias("a"), F.greatest("uid", "hub.uid").alias("b")).distinct()
        new = confirmed(pairs).df
        edges = new if edges is None else edges.unionByName(new)
        comps = Saved(connected_components(edges), "comps")
        if held:
            held.delete()
        held = _still_open(members.df, comps)
        active = held.df
        if active.isEmpty():
            break
    else:
        rare = Saved(_by_rare_shingles(active.select("uid", "n_shingles").distinct(), sets, percent), "rare")
        keyed = _still_open(rare.df, comps)
        rare.delete()
        joined = keyed.df.join(sets.sized().drop("shingles"), "uid")
        other = joined.select("key", *[F.col(f"m{k}").alias(f"o{k}") for k in range(MARKS)], F.col("uid").alias("b"), F.col("n_shingles").alias("nb"), F.col("comp").alias("cb"), F.col("place").alias("pb"), F.col("before").alias("bb"))
        left = F.least(F.col("n_shingles") - F.col("place"), F.col("nb") - F.col("pb"))
        sizes, apart = F.col("n_shingles") + F.col("nb"), sum((F.bit_count(F.col(f"m{k}").bitwiseXOR(F.col(f"o{k}"))) for k in range(MARKS)), F.lit(0))
        pairs = joined.join(other, "key").where((F.col("uid") < F.col("b")) & (F.col("comp") != F.col("cb")) & ((100 + percent) * left >= percent * (F.col("n_shingles") + F.col("nb"))) & ~F.arrays_overlap("before", "bb") & ((100 + percent) * (sizes - apart) >= 2 * percent * sizes))
        new = confirmed(pairs.select(F.col("uid").alias("a"), "b").distinct()).df
        comps = Saved(connected_components(edges.unionByName(new)), "comps")
        keyed.delete()
    for x in (held, members, sets):
        x.delete()

    # From nodes to classes to rows. The id of a component is the smallest doc_id of its rows.
    of_class = classes.join(comps.sized(), classes["uid"] == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "uid").alias("component"))
    ids = signed.where(F.col("n_shingles") > 0).groupBy("c1", "c2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    of_class = of_class.join(ids, ["c1", "c2"])
    lows = of_class.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("size"))
    grouped = Saved(of_class.join(lows, "component").where(F.col("size") > 1).select("c1", "c2", "component", "component_id"), "grouped")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "c1", "c2")
    joined = rows.join(grouped.sized(), ["c1", "c2"], "left")
    component = F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "component")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, n, packed in zip(batch.column("uid").to_pylist(), batch.column("n_shingles").to_pylist(), batch.column("shingles")):
            values = np.frombuffer(packed.as_buffer(), np.int64)
            yield pa.RecordBatch.from_pydict({"uid": np.full(len(values), uid), "n_shingles": np.full(len(values), n), "key": values})


#: Sizes of sets are put in bands, each so many times the one before.
SIZE_STEP = 1.06
#: Of the shingles before a key's, so many are kept to leave out pairs that met there already.
EARLIER = 64


def _by_rare_shingles(nodes: DataFrame, sets: Saved, percent: int) -> DataFrame:
    """(key, uid, n_shingles, place, before): the shingles by which a node can meet a similar one, and their places in the node's order.

    Sets of sizes n and m with the wanted similarity have at least percent * (n + m) / (100 + percent) shingles in common. So if all
    shingles are put in one order, the first common one has at least so many from its place on, in either set. In the
    order of their frequency among the nodes the rare ones come first; a node whose first shingles are all its own
    meets none. As the bound depends on both sizes, a key is a shingle with two bands of sizes, the node's own and
    its partner's, and the node is listed there only if the shingle comes early enough for such a partner.
    """
    tokens = Saved(nodes.join(sets.sized(), "uid").mapInArrow(_tokens, "uid long, n_shingles long, key long"), "tokens").df
    known = Saved(tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "known")
    common = tokens.join(known.sized(), "key").groupBy("uid", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("t"))
    early = f"(n_shingles - least(n_shingles, (n_shingles * {percent} + 99) div 100) + 1)"  # for the smallest partner
    placed = common.withColumn("own", F.col("n_shingles") - F.size("t")).where(f"own < {early}")
    placed = placed.select("uid", "n_shingles", "own", F.col("t.key").alias("key"), F.posexplode(F.expr(f"slice(t, 1, cast({early} - own as int))")).alias("k", "t"))
    placed = placed.withColumn("before", F.expr(f"slice(key, greatest(1, k + 1 - {EARLIER}), least(k, {EARLIER}))"))
    band = F.floor(F.log("n_shingles") / F.log(F.lit(SIZE_STEP))).cast("int")
    reach = int(np.ceil(np.log(100 / percent) / np.log(SIZE_STEP)))
    placed = placed.select("uid", "n_shingles", F.col("t.key").alias("token"), (F.col("own") + F.col("k")).alias("place"), band.alias("band"), "before")
    met = placed.withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach))).where("other >= 0")
    smallest = F.pow(F.lit(SIZE_STEP), F.col("other")) * 0.999999
    met = met.where((100 + percent) * (F.col("n_shingles") - F.col("place")) >= percent * (F.col("n_shingles") + smallest))
    return met.select(F.xxhash64("token", F.least("band", "other"), F.greatest("band", "other")).alias("key"), "uid", "n_shingles", "place", "before")


def _still_open(members: DataFrame, comps: Saved) -> Saved:
    """Members of the buckets that hold more than one component."""
    labelled = members.join(comps.sized(), members["uid"] == F.col("node"), "left").select(*members.columns, F.coalesce("component", "uid").alias("comp"))
    labelled = Saved(labelled, "labelled")
    open_keys = Saved(labelled.df.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where(F.col("low") != F.col("high")).select("key"), "open")
    out = Saved(labelled.df.join(open_keys.sized(), "key", "left_semi"), "active")
    labelled.delete()
    open_keys.delete()
    return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates, with all columns: of each component one row, of those with its smallest id.

    docs needs doc_id and text. Each row is decided by its own text: rows that share an id but not a component don't affect each other.
    Of rows with the smallest id the one with the smallest hash of its text stays, and of rows that repeat id and text any one.
    Components without any id keep one row as well. Null and empty texts and texts without words stay, as often as they are
    there. An empty table gives an empty result.
    """
    found = Saved(grouped_rows(docs, words, percent).where(F.col("component").isNotNull()).select("component", "doc_id", "text_hash", "kept"), "found")
    first = Saved(found.df.where("kept").groupBy("component", "doc_id").agg(F.min("text_hash").alias("text_hash")), "first")
    rows = found.df.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    chosen = first.sized().select(F.col("component").alias("c"), F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))
    rows = rows.join(chosen, (F.col("component") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("t")), "left")
    dropped = Saved(rows.where(F.col("c").isNull()).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")), "dropped")
    repeated = Saved(rows.where(F.col("c").isNotNull() & (F.col("rows") > 1)).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("t")), "repeated")
    found.delete()
    first.delete()
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("t"))
    left = docs.join(dropped.sized(), same, "left_anti")
    if repeated.df.isEmpty():
        return left
    return left.join(repeated.sized(), same, "left_anti").unionByName(left.join(repeated.sized(), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4)
