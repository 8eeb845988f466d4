"""The training-data operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import decontam, mixing, neardup, ngram_rules, quality, substring_dedup, token_io, toxicity, urlfilter, warc
from ontoloom.llm.textstats import text_stats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, digest string, key string"
ODD = [(None, "some words here " * 30, None, None), (7, None, "en", None), (8, "", None, "b"), (9, "  \n\t ", "en", "b"), (10, "é ü 漢字   x", "en", "c"), (11, "w" * 300_000, "en", "a")]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su") for b in ("na", "to", "ve", "zi", "pu", "ga")]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 30, 120, 200]))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=110))
    for k in range(0, n, 6):
        texts[k] = texts[k] + "\n" + passage
    for k in range(1, n, 7):
        base = texts[k - 1].split(" ")
        base[len(base) // 2] = "changed"
        texts[k] = " ".join(base)
    texts[2] = texts[5] = texts[3]
    return [(k, t, "en", f"s{k % 4}") for k, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "u", "d", "k") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*corpus(), *[(None if i is None else 100 + i, *r) for i, *r in ODD], corpus()[4]]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).limit(0)


def test_near_duplicates(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)].append(i)
    want = sorted(repr((i, len(sets[k]), min(low[find(k)], default=None))) for k, (i, _) in enumerate(rows))
    got = neardup.near_duplicates(docs, 4).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(none, 4).count() == 0
    assert neardup.keep_one(docs, 4).count() < docs.count()


def test_longest_factors():
    rng = random.Random(0)
    for _ in range(40):
        n, most = rng.randrange(5, 80), rng.choice([1, 3, 7, 16])
        symbols = [rng.randrange(2) for _ in range(n)]
        starts = sorted(rng.sample(range(n), rng.randrange(1, n)))

        def common(a, b):
            k = 0
            while k < most and max(a, b) + k < n and symbols[a + k] == symbols[b + k]:
                k += 1
            return k

        previous, later = substring_dedup.longest_factors(np.array(symbols), np.array(starts), most)
        for k, i in enumerate(starts):
            assert previous[k] == max((common(i, j) for j in starts if j < i), default=0)
            assert later[k] == max((common(i, j) for j in starts if j > i), default=0)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [substring_dedup.SORT_SYMBOLS, 30])
def test_suffix_dedup(spark, docs, none, keep, most):
    """With 30 symbols all groups are parted, down to single distances."""
    periodic = frame(spark, [(300, "ab" * 700, "en", "a"), (301, "x" + "ab" * 300 + "y", "en", "a"), (302, "ab" * 200 + "c", "en", "a")])
    docs = docs.unionByName(periodic)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count, first = collections.Counter(), {}
    for i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k in range(len(x) - 399 if len(x) < 300_000 else 0):
            count[x[k : k + 400]] += 1
            first.setdefault(x[k : k + 400], (i, x, k))
    want = []
    for i, x in rows:
        if len(x) >= 300_000:  # a run of one byte
            hit = range(keep == "first", len(x) - 399)
        else:
            hit = [k for k in range(len(x) - 399) if (count[x[k : k + 400]] > 1 if keep == "none" else first[x[k : k + 400]] != (i, x, k))]
        spans = substring_dedup.merged([(k, k + 400) for k in hit])
        kept = b"".join(x[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(x)]))
        want.append(repr((i, len(x), spans, hashlib.sha256(kept).hexdigest())))
    got = substring_dedup.remove_repeats(docs, 400, keep, most).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], hashlib.sha256(r.kept).hexdigest())) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(none, 400, keep).count() == 0


def test_token_ids(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_io.default_tokenizer())
    start, want = 0, []
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_io.encode_corpus(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_io.encode_corpus(none).count() == 0


def test_pieces_equal_whole_texts():
    e = token_io.Encoder(token_io.default_tokenizer())
    texts = ["it's  a 'test'", "don't we'll, (x) 3.5% <|endoftext|> été!!", " lead", "trail ", "a\n\nb c", "über 12ab cd34", "x y z", "", "!", "a  b c", "x\u0120 \u0120w", "日本 語 x\ty z", "a\nb c\n", "\nx", "a \nb", "a\n b", "x\t y", "a\r\nb", "x\u00a0 y", "l1\nl2 w.\nl3", " ", "w.,!! (a.) b', c'.", "1, 2.5% $$ ...", "x\u3000y", "\x1c x"]
    for part in (texts, texts[:1], texts[4:5], []):
        assert e.encode(part) == [np.array(e.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab1é .,'!\n\t<|", [9, 9, 3, 3, 8, 2, 1, 1, 1, 2, 0.2, 1, 1], k=60)) for _ in range(2000)]
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("most", [4, 6, 18])
def test_codes(most):
    counts = np.array([1, 1, 2, 5, 9, 30, 100, 1000, 4, 4])
    lengths = token_io.code_lengths(counts, most)
    assert lengths.max() <= most and sum(2.0**-x for x in lengths) <= 1
    book = token_io.Codebook(np.arange(10), lengths)
    tokens = np.random.default_rng(0).choice(10, 1000, p=counts / counts.sum())
    payload, offsets = book.encode(tokens)
    assert (book.decode(payload, offsets, len(tokens), book.tables()) == tokens).all()


def test_decontamination(spark, docs, none):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew a strong potion at midnight in the old tower"
    edited = item.replace("brown", "brwn").replace("seven", "sevven")
    far = item.replace("quick brown fox", "slow white cat").replace("midnight", "noon today")
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    more = frame(spark, [(200, f"x y z {item} end", "en", "a"), (201, edited.upper(), "en", "a"), (202, far, "en", "a")])
    got = {(r.doc_id, r.item_id): r.errors for r in decontam.leaks(docs.unionByName(more), items).collect()}
    assert got == {(200, 1): 0, (201, 1): 2}
    assert decontam.without_leaks(docs.unionByName(more), items).count() == docs.count() + 1
    assert decontam.leaks(none, items).count() == 0
    rng = random.Random(1)
    for _ in range(40):
        p, t = ("".join(rng.choices("ab", k=n)) for n in (8, 20))
        rows = list(range(len(p) + 1))
        best = len(p)
        for c in t:
            new = [0]
            for k, x in enumerate(p):
                new.append(min(rows[k] + (x != c), rows[k + 1] + 1, new[k] + 1))
            rows, best = new, min(best, new[-1])
        assert decontam.myers(p, t, 8)[0] == best


def test_quality_rules(docs, none):
    for text, want in (("a b c a b c d", 6), ("a a a a", 4), ("a b c", 0), ("", 0)):
        assert text_stats(text, text.encode()).n_repeat_words == want
    assert text_stats("x\n \nx\nx", b"x\n \nx\nx").n_dup_lines == 2
    got = {r.doc_id: r for r in ngram_rules.quality_rules(docs).collect()}
    assert got[107].n_words == 0 and not got[107].kept and got[108].base_failed and got[109].n_words == 0
    raw, target = np.ones(1 << 16), np.ones(1 << 16)
    for r in docs.collect():
        x = (r.text or "").encode()
        if len(x) > 2:
            b = np.bincount(ngram_rules.buckets_of(np.frombuffer(x, np.uint8)), minlength=1 << 16)
            raw += b
            target += b * ngram_rules.is_trusted(text_stats(r.text, x), x)
    table = (np.log(target / target.sum()) - np.log(raw / raw.sum())).astype(np.float32)
    x = np.frombuffer(corpus()[0][1].encode(), np.uint8)
    assert abs(got[0].llr - table[ngram_rules.buckets_of(x)].mean()) < 1e-4
    assert ngram_rules.quality_rules(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs).collect()))
    sources = {r.source: (r.source_size, r.target) for r in rows}
    total, level = sum(s for s, _ in sources.values()), None
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    fixed = set()
    while True:
        level = (total - sum(3 * sources[s][0] for s in fixed)) / (sum(w for s, w in weight.items() if s not in fixed) or 1)
        over = {s for s, w in weight.items() if s not in fixed and w * level > 3 * sources[s][0]}
        if not over:
            break
        fixed |= over
    for s, (size, target) in sources.items():
        assert target == pytest.approx(3 * size if s in fixed else weight[s] * level)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(none).count() == 0


def test_urls(spark):
    urls = [(1, "http://A.Net"), (2, "http://x.net/"), (3, "https://example.net/en/a"), (4, "ftp://b.Example.COM/de/x?y#z"), (5, "http://q.org/fr/"), (6, None), (7, "nothing"), (8, "http://www.bad.info/p/"), (8, "http://bad.info/p.html?x"), (9, "http://good.info/p")]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in urls], "page_id long, url string, host string, path string")
    listed = spark.createDataFrame([("bad.info/p",), (None,), ("bad.info/p",)], "url_key string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.filter_urls(pages, listed).collect())
    assert got == [(1, "a.net", "", "", "allow"), (2, "x.net", "/", "net/", "block"), (3, "example.net", "/en/a", "example.net/en/", "allow"), (4, "b.example.com", "/de/x", "example.com/de/", "block"), (5, "q.org", "/fr/", "org/fr/", "allow"), (6, "", "", "", "allow"), (7, "", "", "", "allow"), (8, "bad.info", "/p.html", "", "block"), (8, "www.bad.info", "/p/", "", "block"), (9, "good.info", "/p", "", "allow")]
    assert urlfilter.filter_urls(pages.limit(0), listed).count() == 0 and urlfilter.filter_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "u", 1, "response", h(etag='"a"', server="o", date="1"), "p1"), (2, "u", 5, "response", h(etag='"b"', date="5"), "p2"), (3, "u", 3, "revisit", h(etag='W/"a"', date="3", server="c"), None),
        (4, "u", 9, "revisit", h(etag='"a"'), None), (5, "v", 9, "revisit", {}, "p"), (6, None, 9, "revisit", None, None), (7, "u", None, "revisit", {}, None), (8, "u", 5, "revisit", {}, None), (9, "u", 6, "revisit", None, "p2"), (10, "u", 7, None, None, None),
    ]
    table = spark.createDataFrame(rows, "record_id long, url_key string, ts long, kind string, headers map<string,string>, payload_digest string")
    for buckets in (1, 3, 256):
        got = {r.record_id: r for r in warc.resolve_revisits(table, buckets).collect()}
        assert {k: (r.refers_to, r.status) for k, r in got.items()} == {3: (1, "resolved"), 4: (2, "mismatch"), 5: (None, "orphan"), 6: (None, "orphan"), 7: (None, "orphan"), 8: (1, "unverified"), 9: (2, "resolved")}
        assert got[3].headers == {"etag": 'W/"a"', "server": "o", "date": "3"} and got[3].payload_digest == "p1"
    assert warc.resolve_revisits(table.limit(0)).count() == 0


def test_toxicity_automaton():
    terms = ["idiot", "scum", "clown", "moron"]
    trie = toxicity.LevenshteinTrie(terms)
    classes = np.zeros(200, np.int64)
    for c, k in trie.classes.items():
        classes[ord(c)] = k

    def edits(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for k, y in enumerate(b):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
            row = new
        return row[-1]

    rng = random.Random(2)
    words = [w for t in terms for w in [t, t[1:], t + "s", t[:2] + "x" + t[3:], t[:1] + "o" + t[1:], t[:-2]]] + ["".join(rng.choices("idotclwnmr", k=5)) for _ in range(300)]
    for w in words:
        best = min(edits(w, t) if len(t) >= 5 or w == t else 9 for t in terms)
        got = trie.distances(classes[[ord(c) for c in w]], np.array([0]), np.array([len(w)]))[0]
        assert got == (best if best <= 1 else 9), w
    x = toxicity.hit_features(["you idiot", 'they said "idiot" there', "an idoit and an idiott", ""], trie, classes)
    assert toxicity.hit_features(["they said idiot there"], trie, classes, frozenset(["said"]))[0, :2].tolist() == [0, 1]
    assert x[:, 0].tolist() == [1, 0, 0, 0] and x[:, 1].tolist() == [0, 1, 0, 0] and x[2, 2] >= 1


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, labels).collect()} == {0.5}
    assert quality.classify(none, labels).count() == toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels).count() == docs.count()
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(400):
        bad, rude = k % 4 == 0, k % 5 == 0
        w = [rng.choice(["the", "cat", "sat", "mat", "dog", "ran", "far"]) for _ in range(60)]
        if rude:
            w[rng.randrange(60)] = rng.choice(["idiot", "scum"])
        rows.append((k, " ".join(x + "%%%" if bad else x for x in w), "en", "a"))
        marks.append((k, int(not bad), int(rude)))
    data, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    for got, column in ((quality.classify(data, labels), "quality"), (toxicity.score_toxicity(data, labels), "toxic")):
        held = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]
        assert held > 0.95
        assert got.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) != F.col("held_out")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = corpus(5, 80) + [(90, "of%%% the&&& " * 60, "en", "s0"), (91, "word " * 100, "en", "s1")]
    item = " ".join(rows[8][1].split()[:40])
    frame(spark, rows).select(*p.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = p.apply_quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == p.COLUMNS and not {90, 91} & {r.doc_id for r in kept.collect()}
    one = p.drop_near_duplicates(spark, kept, str(tmp_path))
    want = {r.doc_id for r in neardup.near_duplicates(kept).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == want
    clean = p.drop_benchmark_leaks(spark, one, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if decontam.normalise(item) not in decontam.normalise(r.text)}
    mixed = p.mix_sources(spark, clean, str(tmp_path))
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {k: v for k, v in copies.items() if v}
    assert p.run(spark, str(tmp_path)).count() == sum(copies.values())


def test_hash_of_kept_bytes(spark):
    done = substring_dedup.remove_repeats(frame(spark, [(1, "ab" * 10, "en", "a")])).select(F.sha2("kept", 256)).first()[0]
    assert done == hashlib.sha256(b"ab" * 10).hexdigest()


def test_capital_share_is_of_all_words():
    text = "\n".join(["One two three four five"] * 2000)
    assert quality.statistics(text, text.encode())[-1] == pytest.approx(0.2)
    assert quality.statistics(" \n ", b" \n ")[-1] == 0


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_io.default_tokenizer())
    texts = ["end <|endoftext|> next", "a<|endoftext|>b c", "<|endoftext|>", "x  <|endoftext|>", "<|endoftext|", "plain words"]
    want = [[*t.encode(x, add_special_tokens=False).ids, token_io.END_ID] for x in texts]
    assert want[0] == [437, 220, 50256, 1306, 2]
    docs = frame(spark, [(k, x, "en", "a") for k, x in enumerate(texts)])
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_io.encode_corpus(docs).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(want)}


def test_short_items_are_searched(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "x = y_0"), (3, "cat"), (4, "法国的首都是什么"), (5, "?!")], "item_id long, text string")
    texts = ["so: WHAT is the capital of france", "what is the captal of France now", "somewhat is the capital of france", "if x=y 0, concatenate", "a cat", "请问法国的首都是什么呢", "what is the capitol in france", "what is the capital of frances"]
    docs = frame(spark, [(k, x, "en", "a") for k, x in enumerate(texts)])
    got = {(r.doc_id, r.item_id): r.errors for r in decontam.leaks(docs, items).collect()}
    assert got == {(0, 1): 0, (1, 1): 1, (3, 2): 0, (4, 3): 0, (5, 4): 0, (7, 1): 1}
    assert {r.doc_id for r in decontam.without_leaks(docs, items).collect()} == {2, 6}
