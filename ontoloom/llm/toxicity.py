"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse.

The lexicon is what the labelled training rows teach: words that stand in many different contexts of toxic documents and
hardly in others. The Levenshtein automata of all terms run along one trie;
the product is made deterministic once and run over all words of a batch at a time, a table lookup per character. Words that stand near
terms in rows that aren't toxic are cues of a report, learned from the same rows; quotation marks tell one, too.
Each hit is weighed by its surroundings; a logistic model of the sums gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, documents, in_fold, slices
from ontoloom.llm.quality import labelled

MAX_TRAIN = 30_000
#: A learned term stands in so many different contexts of toxic training documents, and so much more often than in others.
MIN_CONTEXTS, MIN_RATIO = 4, 25.0
#: Terms of fewer characters are matched exactly.
FUZZY_FROM = 5
#: Words on either side that are searched for a cue.
WINDOW = 4
#: A learned cue stands near so many terms, in different contexts, of training documents that aren't toxic, and so much more often there than near terms of toxic ones.
MIN_CUE_CONTEXTS, MIN_CUE_RATIO = 4, 8.0
QUOTES = "\"“”„«»"


class LevenshteinTrie:
    """A deterministic automaton for all words within one edit of a term: states are sets of (trie node, errors)."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        children: list[dict[str, int]] = [{}]
        end: list[bool] = [False]
        depth_ok: list[bool] = [False]  # below this node lies a term that may have an error
        for term in self.terms:
            node = 0
            for c in term:
                if len(term) >= FUZZY_FROM:
                    depth_ok[node] = True
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    end.append(False)
                    depth_ok.append(False)
                node = children[node][c]
            end[node] = True
            depth_ok[node] |= len(term) >= FUZZY_FROM
        letters = sorted({c for t in self.terms for c in t})
        self.classes = {c: k + 1 for k, c in enumerate(letters)}  # 0: any other character

        def closed(states: set[tuple[int, int]]) -> frozenset:
            """With deletions: an edge of the trie taken without a character."""
            out = set(states)
            for node, errors in states:
                if errors == 0 and depth_ok[node]:
                    out |= {(to, 1) for to in children[node].values() if depth_ok[to]}
            return frozenset(out)

        def step(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for node, errors in states:
                if c in children[node]:
                    out.add((children[node][c], errors))
                if errors == 0 and depth_ok[node]:
                    out.add((node, 1))  # insertion
                    out |= {(to, 1) for x, to in children[node].items() if x != c and depth_ok[to]}  # substitution
            return closed(out)

        start = closed({(0, 0)})
        number, rows, todo = {frozenset(): 0, start: 1}, {0: [0] * (len(letters) + 1)}, [start]
        while todo:
            states = todo.pop()
            row = []
            for c in [None, *letters]:
                to = step(states, c)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows[number[states]] = row
        self.table = np.array([rows[k] for k in range(len(number))], np.int32)
        #: Errors of the best term that ends in a state, 9 for none.
        self.errors = np.full(len(number), 9, np.int8)
        for states, k in number.items():
            found = [e for node, e in states if end[node] and (e == 0 or depth_ok[node])]
            if found:
                self.errors[k] = min(found)
        self.longest = max(map(len, self.terms), default=0) + 1

    def distances(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For words given by places in an array of character classes: 0, 1, or 9 for more than one error."""
        out = np.full(len(starts), 9, np.int8)
        alive = np.flatnonzero(sizes <= self.longest)
        state = np.ones(len(alive), np.int32)
        for k in range(self.longest + 1):
            over = sizes[alive] == k
            out[alive[over]] = self.errors[state[over]]
            alive, state = alive[~over], state[~over]
            if not len(alive):
                break
            state = self.table[state, codes[starts[alive] + k]]
            live = state > 0
            alive, state = alive[live], state[live]
        return out


_LETTER = np.array([chr(c).isalnum() for c in range(0x3000)], bool)


def hit_features(texts: list[str], trie: LevenshteinTrie, classes: np.ndarray, cues: frozenset[str] = frozenset()) -> np.ndarray:
    """Per text: exact hits used, exact hits quoted or reported, near hits used, largest number of hits in a stretch of 20 words, log(1 + words).

    Quoted: an odd number of quotation marks before it on its line, and one after it. Reported: one of the WINDOW words on either side is one of the cues.
    """
    lowered = [x.lower() for x in texts]
    joined = "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points >= 0x3000) | _LETTER[np.minimum(points, 0x2FFF)]
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edges = np.concatenate([[0], edges]) if letter[0] else edges
    starts, ends = edges[0::2], edges[1::2]
    codes = classes[np.minimum(points, len(classes) - 1)]
    found = trie.distances(codes, starts, ends - starts)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in lowered]), starts, side="right")
    out = np.zeros((len(texts), 5))
    out[:, 4] = np.log1p(np.bincount(owner, minlength=len(texts)))
    hits = np.flatnonzero(found <= 1)
    if not len(hits):
        return out
    marks = np.concatenate([[0], np.cumsum(np.isin(points, [ord(c) for c in QUOTES]))])  # quotation marks before each place
    lines = np.concatenate([[-1], np.flatnonzero(points == 10)])
    line = np.searchsorted(lines, starts[hits])
    before, after = marks[starts[hits]] - marks[lines[line - 1] + 1], marks[lines[line]] - marks[ends[hits]]
    aside = (before % 2 == 1) & (after > 0)
    for k in [*range(-WINDOW, 0), *range(1, WINDOW + 1)] if cues else []:
        near = np.clip(hits + k, 0, len(starts) - 1)
        same = owner[near] == owner[hits]
        aside[same] |= [joined[a:b] in cues for a, b in zip(starts[near[same]].tolist(), ends[near[same]].tolist())]
    exact = found[hits] == 0
    for k, chosen in enumerate((exact & ~aside, exact & aside, ~exact & ~aside)):
        out[:, k] = np.bincount(owner[hits[chosen]], minlength=len(texts))
    used = hits[exact & ~aside]
    together = np.minimum(np.searchsorted(used, used + 20), np.searchsorted(owner[used], owner[used], side="right")) - np.arange(len(used))
    np.maximum.at(out[:, 3], owner[used], together)
    return out


def learn_terms(train: DataFrame) -> list[str]:
    """Terms for rows (text, y): different contexts in toxic rows against occurrences in others, by a smoothed ratio of rates."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), 0)
    rows = train.select("y", words.alias("w"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.sum(F.size("w")).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return []
    # A context is the word with its neighbours: copies of a document have it once, however many there are.
    near = rows.where("y = 1").select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), F.col("w")).alias("p"), F.col("w").alias("w"), F.concat(F.slice("w", 2, 1_000_000_000), F.array(F.lit(""))).alias("f"))).alias("c")).where(F.col("c.w").isNotNull())
    toxic = near.select("c.w", F.xxhash64("c.p", "c.w", "c.f").alias("c")).distinct().groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS)
    toxic = Saved(toxic, "toxic-words")
    clean = rows.where("y = 0").select(F.explode("w").alias("w")).join(toxic.sized().select("w"), "w", "left_semi").groupBy("w").agg(F.count("*").alias("m"))
    rate = ((F.col("n") + 0.5) / totals[1]) / ((F.coalesce("m", F.lit(0)) + 0.5) / totals[0])
    found = toxic.df.join(clean, "w", "left").withColumn("rate", rate).where(F.col("rate") >= MIN_RATIO).select("w").collect()  # from a bounded number of training rows
    return sorted(r["w"] for r in found)


def learn_cues(train: DataFrame, terms: list[str]) -> frozenset[str]:
    """Words that tell reports from abuse: the WINDOW words on either side of a term, in rows (text, y) that aren't toxic against toxic ones, by a smoothed ratio of rates.

    Each context, a term with its neighbours, counts once for each label, so that copies of a document teach what one does.
    """
    if not terms:
        return frozenset()
    words = train.select("y", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w"))
    places = words.select("y", "w", F.posexplode("w").alias("k", "term")).where(F.col("term").isin(terms))  # from a bounded number of training rows
    before = F.slice("w", F.greatest(F.lit(1), F.col("k") + 1 - WINDOW), F.least(F.col("k"), F.lit(WINDOW)))
    around = F.concat(before, F.slice("w", F.col("k") + 2, WINDOW))
    contexts = places.select("y", "term", around.alias("near")).distinct()
    sizes = {r["y"]: r["n"] for r in contexts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return frozenset()
    met = contexts.select("y", F.explode(F.array_distinct("near")).alias("word")).where(~F.col("word").isin(terms)).groupBy("word").agg(F.count_if(F.col("y") == 0).alias("n"), F.count_if(F.col("y") == 1).alias("m"))
    rate = ((F.col("n") + 0.5) / sizes[0]) / ((F.col("m") + 0.5) / sizes[1])
    return frozenset(r["word"] for r in met.where((F.col("n") >= MIN_CUE_CONTEXTS) & (rate >= MIN_CUE_RATIO)).select("word").collect())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (the last one is the constant) by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(z.shape[1]), ridge * np.diag([*[1.0] * x.shape[1], 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the features used, quoted, near, densest.

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored. held_out: crc32(doc_id as text) mod 4 is 2; such rows are
    never learned from. At most about MAX_TRAIN labelled rows are. score is the probability of label 1, predicted 1 from cutoff on.

    Null and empty texts have no hits and are scored as such. Repeated rows get equal scores; repeated labels count once. A null id is not held
    out and has no label. Without labels of both kinds there is no lexicon and every score is low. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    taught = Saved(labelled(docs.select("doc_id", "text"), labels, "toxic", most), "taught")  # about `most` rows
    terms = learn_terms(taught.df)
    cues = learn_cues(taught.df, terms)
    taught.delete()
    trie = LevenshteinTrie(terms)
    classes = np.zeros(max(map(ord, trie.classes), default=0) + 2, np.int64)
    for c, k in trie.classes.items():
        classes[ord(c)] = k
    shared = spark.sparkContext.broadcast((trie, classes, cues))  # grows with the terms that about `most` rows can teach

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            x = hit_features(texts, *shared.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(x[:, k]) for k, c in enumerate(FEATURES)})

    measured = Saved(docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {id_type}, " + ", ".join(f"{c} double" for c in FEATURES)), "hits").df
    train = labelled(measured, labels, "toxic", most).select(*FEATURES, "y").toPandas()  # about `most` rows
    beta = np.array([2.0, 0.0, 0.5, 1.0, -0.5, -2.0])
    if train["y"].nunique() == 2:
        beta = logistic(shape(train[list(FEATURES)].to_numpy()), train["y"].to_numpy(float))
    cap = lambda c: F.log1p(F.col(c))
    linear = F.lit(float(beta[5])) + float(beta[0]) * cap("used") + float(beta[1]) * cap("quoted") + float(beta[2]) * cap("near") + float(beta[3]) * cap("densest") + float(beta[4]) * F.col("length")
    score = F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear)))), 6)
    held = F.col("doc_id").isNotNull() & (in_fold(F.col("doc_id")) == 2)
    return measured.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= cutoff).cast("int").alias("predicted"), "used", "quoted", "near", "densest")


FEATURES = ("used", "quoted", "near", "densest", "length")


def shape(x: np.ndarray) -> np.ndarray:
    """Counts on a log scale."""
    return np.column_stack([np.log1p(x[:, :4]), x[:, 4]])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
