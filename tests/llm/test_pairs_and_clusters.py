"""Embedding links, cross-tokenizer alignment and delta Lloyd against plain versions."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest

from ontoloom.llm import alignment, clustering, embedding_dedup

VECTORS = "vec_id long, embedding array<float>, label int, node long, n long, vector string, owner int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", 3) for i, v in rows], VECTORS)


def some_vectors(d=64, n=60):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((n, d))
    rows = [(k, x) for k, x in enumerate(base.tolist())]
    rows += [(1000 + k, (base[0] + 0.15 * rng.standard_normal(d)).tolist()) for k in range(70)]  # near copies, some links missing
    rows += [(2000 + k, (base[1] + 0.32 * rng.standard_normal(d)).tolist()) for k in range(30)]  # at the threshold
    rows += [(3000 + k, (base[2] * 2).tolist()) for k in range(25)] + [(3000, (base[2] * 2).tolist()), (7, base[3].tolist())]  # copies, repeated rows, an id twice
    return rows


ODD = [(4000, None), (4001, []), (4002, [0.0] * 64), (4003, [float("nan")] + [1.0] * 63), (4004, [None] + [1.0] * 63), (4005, [float("inf")] * 64), (4006, [1.0, 2.0, 3.0]), (4007, [1.0, 2.0, 3.1]), (None, [1.0] * 64), (4008, [1e30] * 64), (4009, [-0.0, 1.0, 0.0]), (4010, [0.0, 1.0, 0.0])]


@pytest.mark.parametrize("cell, tile", [(embedding_dedup.CELL, embedding_dedup.TILE), (20, 7)])
def test_links(spark, cell, tile):
    rows = some_vectors() + ODD
    got = embedding_dedup.link_vectors(vectors(spark, rows), cell=cell, tile=tile).collect()
    units = [None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, np.float32).astype(float) for _, v in rows]
    units = [x if x is None else x / np.linalg.norm(x) for x in units]
    n, root = len(rows), list(range(len(rows)))
    links = [[b for b in range(n) if b != a and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9] for a in range(n)]

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        return seen

    ids = [i for i, _ in rows]
    low = [min((ids[b] for b in reach(a) if ids[b] is not None), default=None) for a in root]
    want = [(ids[a], len(links[a]), low[a], ids[a] is not None and ids[a] == low[a]) for a in root]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert len({len(x) for x in links}) > 5
    assert embedding_dedup.link_vectors(vectors(spark, []), cell=cell, tile=tile).count() == 0


def test_link_recall_of_blocks(spark):
    """Every pair above the threshold meets in some block, also for odd lengths."""
    for d in (5, 24, 40):
        blocks, rng = embedding_dedup.Blocks(d, 0.9, 1), np.random.default_rng(d)
        x = embedding_dedup.unit(rng.standard_normal((300, d)))
        y = embedding_dedup.unit(x + 0.4 / np.sqrt(d) * rng.standard_normal((300, d)))
        near, rx, ry = (x * y).sum(axis=1) >= 0.9, blocks.rotated(x), blocks.rotated(y)
        meets = np.any([((rx[:, a:b] - ry[:, a:b]) ** 2).sum(axis=1) <= t for (a, b), t in zip(blocks.spans, blocks.budgets)], axis=0)
        assert near.any() and meets[near].all()


def plain_alignment(texts, path_a, path_b):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_model.encode_special_tokens = True
    spelling = alignment._byte_level(a_model.get_vocab())
    out, count = [], collections.Counter()
    for text in texts:
        groups, keys, n_a, n_b = [], [], 0, 0
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            each_a = [spelling[x] for x in a]
            each_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [b_model.id_to_piece(x)]]
            if b"".join(each_a) == b"".join(each_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in each_a]).tolist(), {e: q for q, e in enumerate(np.cumsum([len(x) for x in each_b]).tolist())}
                n_a, n_b, i, j = len(a), len(b), 0, 0
                for p, e in enumerate(ends_a):
                    if e in ends_b:
                        q = ends_b[e]
                        groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
                        keys.append((a[p], b[q]))
                        i, j = p + 1, q + 1
        count.update(keys)
        out.append((n_a, n_b, groups, keys))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, len(g), len(k), sum(count[x] == best[x[1]] for x in k), sum(count[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, k in out], count


def test_alignment(spark):
    rng = random.Random(3)
    bits = ["ka", "the", "Thing", "s", "12", "3", ".", ",", " ", " ", " ", "\n", "\t", "\r\n", "  ", "é", "ß", "漢字", "　", " ", " ", "́", "'s", "<s>", "<|endoftext|>", "\x00", "\x1c", "\u0085", "😀", "<0x0A>", "х"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " ", "\n", "▁", "a▁b", "plain text with a ▁ sign", "w" * 30_000, "the same words again", "the same words again", "the  same\n\nwords\n again "]
    docs = spark.createDataFrame([(None if k == 5 else k // 2 * 2, t, "en", 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, lang string, key long, n long").repartition(3)
    want, count = plain_alignment(texts, *alignment.default_tokenizers())
    found = alignment.Alignment(docs)
    got = [tuple(r) for r in found.documents().collect()]
    assert sorted(map(repr, got)) == sorted(repr((None if k == 5 else k // 2 * 2, *w)) for k, w in enumerate(want))
    assert {(r.a, r.b): r.n for r in found.pairs().collect()} == dict(count)
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0


def test_alignment_whole_table(spark):
    from ontoloom.llm.common import documents

    docs = documents(spark, "/root/testdata/sf0.001")
    rows = docs.select("doc_id", "text").collect()
    want, _ = plain_alignment([r.text for r in rows], *alignment.default_tokenizers())
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op12_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want)}


def plain_lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in np.array(v, np.float32)]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    by = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in by[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        owner = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, o) in zip(kept, owner) if o == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    owner, inertia = assign(), collections.Counter()
    for s, o in owner:
        inertia[o] += s
    return [(i, o, s, inertia[o], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[o])).encode()).hexdigest()) for (i, _), (s, o) in zip(kept, owner)]


@pytest.mark.parametrize("rows", [some_vectors() + ODD, some_vectors()[:9], [(k, [k % 2 + 0.0] * 64) for k in range(40)]])
def test_delta_lloyd(spark, rows):
    got = clustering.delta_lloyd(vectors(spark, rows).repartition(3), together=7).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain_lloyd(rows)))
    assert clustering.delta_lloyd(vectors(spark, [r for r in ODD if r[1] is None])).count() == 0


def test_delta_equals_full_assignment():
    rng = np.random.default_rng(2)
    x, old = rng.integers(-9, 9, (400, 6)), rng.integers(-9, 9, (12, 6))
    owner, distance = clustering.nearest(x, old)
    new = old.copy()
    new[[1, 4, 7]] += rng.integers(-3, 4, (3, 6))
    got = clustering.reassigned(x, owner, distance, new, (new != old).any(axis=1))
    want = clustering.nearest(x, new)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    sums, counts = clustering.transfers(x, owner, got[0], 12)
    assert (counts == np.bincount(got[0], minlength=12) - np.bincount(owner, minlength=12)).all()
    assert (sums.sum(axis=0) == 0).all()


@pytest.mark.parametrize("name", ["op11_embedding_near_dedup", "op13_centroid_clustering"])
def test_against_sql(spark, name):
    from ontoloom.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    df, rel = QUERIES[name](spark, folder), duck.sql(ORACLE_SQL[name])
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_words_with_vanishing_polynomials(spark):
    """A Thue-Morse word and its complement have the same polynomial modulo 2 ** 64; they are different words, and share no shingle."""
    from ontoloom.llm import neardup

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"one {word} two three four", f"one {other} two three four", f"one {word} two three four", "ab " * 30, "ba " * 30]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2, 5: 5, 6: 6}
    shingler = neardup.Shingler(4)
    assert len({int(shingler.hashes(x.encode())[0]) for x in ("a b c d", "b a c d", "a b d c", "ab c d e", "a bc d e")}) == 5


def test_blocks_of_items_in_turn(spark, monkeypatch):
    """Several blocks leave what one does; borders are a parameter."""
    from ontoloom.llm import decontam

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(k, " ".join(word() for _ in range(12))) for k in range(30)]
    docs = [(k, " ".join(word() for _ in range(20)) + (" " + items[k][1] if k < 15 else "") + " xtailx") for k in range(40)] + [(90, None), (91, ""), (92, items[0][1][3:])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (77, "tail")], "item_id long, text string")
    want = [k for k, _ in docs if 15 <= k < 92]  # 92 lacks three characters of an item, which is within its budget
    assert sorted(r.doc_id for r in decontam.without_leaks(d, i).collect()) == want
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    assert sorted(r.doc_id for r in decontam.without_leaks(d, i).collect()) == want
    assert sorted(r.doc_id for r in decontam.without_leaks(d, i, short=0).collect()) == [90, 91]
    assert decontam.without_leaks(d, i.limit(0)).count() == len(docs)
