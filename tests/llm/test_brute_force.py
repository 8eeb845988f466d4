"""Whole results of the operators that SQL can't express, against plain single-threaded versions."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ontoloom.llm import decontam, mixing, neardup, ngram_rules, quality, token_io, toxicity
from tests.llm.test_llm import ODD, corpus, frame


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 4


def plain_rules(rows):
    """(doc_id, five counts, base_failed, llr, kept) of quality_rules."""
    counts = []
    for _, text in rows:
        text = text or ""
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        counts.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat)))
    bucket = lambda x, k: ((x[k] << 16 | x[k + 1] << 8 | x[k + 2]) * 2654435761 % 2**32) >> 16
    raw, target, found = [1.0] * 65536, [1.0] * 65536, []
    for (_, text), (n, chars, symbols, dup, repeat) in zip(rows, counts):
        data = (text or "").encode()
        at = [bucket(data, k) for k in range(len(data) - 2)]
        found.append(at)
        trusted = n >= 50 and not dup and 10 * repeat <= n and 100 * symbols <= n and 2 * n <= chars <= 12 * n and 10 * sum(65 <= c <= 90 for c in data) <= len(data)
        for b in at:
            raw[b] += 1
            target[b] += trusted
    total = sum(raw), sum(target)
    out = []
    for (i, _), c, at in zip(rows, counts, found):
        llr = sum(math.log(target[b] / total[1]) - math.log(raw[b] / total[0]) for b in at) / len(at) if at and total[1] > 65536 else 0.0
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((i, *c, failed, llr, not failed and llr >= ngram_rules.THRESHOLD))
    return out


def plain_near(rows, width, percent=80):
    """The component of each row (an index), None for empty sets."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) if s else None for k, s in enumerate(sets)], sets


def plain_errors(item, text):
    """The fewest edits of an occurrence of item anywhere in text."""
    row, best = list(range(len(item) + 1)), len(item)
    for c in text:
        new = [0]
        for k, x in enumerate(item):
            new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
        row, best = new, min(best, new[-1])
    return best


def plain_leaks(rows, items):
    out = set()
    for i, text in rows:
        body = decontam.normalise(text)
        for j, item in items:
            item = decontam.normalise(item)
            if body and item:
                errors = plain_errors(item, body)
                if errors <= int(len(item) * decontam.ERROR_RATE):
                    out.add((i, j, errors))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    noisy = [(200 + k, " ".join(rng.choice(["Buy", "NOW$$$", "cheap%%", "deal!"]) for _ in range(80)), "en", "s1") for k in range(6)]
    return [*corpus(9, 70), *[(None if i is None else 100 + i, *r) for i, *r in ODD[:5]], *noisy, (300, "x\ny\nx\n \n" * 30, "en", "s2"), (300, "a b c " * 60, "en", "s2")]


def test_quality_rules(spark, rows):
    want = plain_rules([r[:2] for r in rows])
    got = [tuple(r) for r in ngram_rules.quality_rules(frame(spark, rows)).collect()]
    key = lambda r: repr(r[:6])
    assert [(*r[:7], r[8]) for r in sorted(got, key=key)] == [(*r[:7], r[8]) for r in sorted(want, key=key)]
    assert all(abs(a[7] - b[7]) < 1e-5 for a, b in zip(sorted(got, key=key), sorted(want, key=key)))
    assert {r[8] for r in got} == {True, False}


def test_decontamination(spark, rows):
    rng = random.Random(2)
    texts = [(r[0], r[1]) for r in rows if r[1] and len(r[1]) < 700][:25]
    items = []
    for j, (_, text) in enumerate(texts[:8]):
        part = list(text[10:90])
        for _ in range(rng.randrange(6)):
            part[rng.randrange(len(part))] = rng.choice("abcxyz")
        items.append((j, "".join(part)))
    items = [(j, x) for j, x in items if len(decontam.normalise(x)) >= decontam.MIN_CHARS]
    docs = frame(spark, [(i, x, "en", "a") for i, x in texts])
    got = [tuple(r) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = plain_leaks(texts, items)
    assert {r[:2] for r in got} == {r[:2] for r in want} and want
    # The errors of a reported pair are those of the window around a piece, never fewer than the best.
    assert set(got) == want


def labelled_rows():
    rng = random.Random(3)
    rows, marks = [], []
    plain = ["the", "cat", "sat", "mat", "dog", "ran", "far", "said", "home"]
    for k in range(240):
        bad, rude = k % 4 == 0, k % 5 == 0
        w = [rng.choice(plain) for _ in range(40)]
        if rude:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(["idiot", "scum", "iidiot", "moron"])
        elif k % 7 == 0:
            w[20:23] = ['"you', "idiot", 'then"']
        rows.append((k, " ".join(x + "%%%" if bad and rng.random() < 0.5 else x for x in w) + "\nEnd", "en", "a"))
        marks.append((k, int(not bad), int(rude)))
    return [*rows, *rows[:3], *[(None if i is None else 1000 + i, *r) for i, *r in ODD]], [*marks, (5, None, 1), (None, 1, 1), (7, 0, 0)]


def test_quality_classifier(spark):
    rows, marks = labelled_rows()
    got = quality.classify(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    y = {}
    for i, q, _ in marks:
        if i is not None and q is not None:
            y[i] = max(q, y.get(i, 0))
    x = [quality.statistics(t or "", (t or "").encode()) for _, t, *_ in rows]
    train = [(v, y[r[0]], fold(r[0])) for v, r in zip(x, rows) if r[0] in y and fold(r[0]) != 2]
    a, b, f = np.array([t[0] for t in train]), np.array([t[1] for t in train], float), np.array([t[2] for t in train])
    scale = a.std(axis=0)
    features = quality.Fourier(a.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), math.sqrt(quality.N_FEATURES))
    z, t = features(a[f != 3]), b[f != 3]
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.diag([*[1.0] * (z.shape[1] - 1), 1e-9]), z.T @ t)
    s, v = features(a[f == 3]) @ beta, b[f == 3]
    order = np.argsort(s, kind="stable")
    s, v = s[order], v[order]
    # Isotonic regression by its formula: the largest over starts of the smallest over ends of means.
    fitted = [max(min(v[i : j + 1].mean() for j in range(k, len(v))) for i in range(k + 1)) for k in range(len(v))]
    blocks = [[k for k in range(len(v)) if fitted[k] == value] for value in sorted(set(fitted))]
    smooth = {k: (v[g].sum() + v.mean()) / (len(g) + 1) for g in blocks for k in g}
    level = np.maximum.accumulate([smooth[k] for k in range(len(v))])
    want = np.interp(features(np.array(x)) @ beta, s, level)
    want = collections.Counter((r[0], fold(r[0]) == 2 and r[0] is not None, round(w, 4)) for r, w in zip(rows, want))
    assert collections.Counter((r.doc_id, r.held_out, round(r.score, 4)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity(spark):
    rows, marks = labelled_rows()
    got = toxicity.score_toxicity(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    y = {}
    for i, _, t in marks:
        if i is not None and t is not None:
            y[i] = max(t, y.get(i, 0))
    train = [(t or "", y[i]) for i, t, *_ in rows if i in y and fold(i) != 2]
    contexts, m, total = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for text, label in train:
        w = re.findall(r"\w{3,}", text.lower().replace("_", " "))
        total[label] += len(w)
        for p, c, n in zip(["", *w], w, [*w[1:], ""]):
            if label:
                contexts[c].add((p, c, n))
            else:
                m[c] += 1
    terms = [c for c, x in contexts.items() if len(x) >= toxicity.MIN_CONTEXTS and ((len(x) + 0.5) / total[1]) / ((m[c] + 0.5) / total[0]) >= toxicity.MIN_RATIO]
    assert {"idiot", "scum"} & set(terms)
    near, size, window = {0: collections.Counter(), 1: collections.Counter()}, [set(), set()], toxicity.WINDOW
    for text, label in train:
        w = re.findall(r"[^\W_]+", text.lower())
        size[label] |= {(x, tuple(w[max(0, k - window) : k] + w[k + 1 : k + 1 + window])) for k, x in enumerate(w) if x in terms}
    for label in (0, 1):
        near[label].update(x for _, around in size[label] for x in set(around) - set(terms))
    cues = {x for x, n in near[0].items() if n >= toxicity.MIN_CUE_CONTEXTS and ((n + 0.5) / len(size[0])) / ((near[1][x] + 0.5) / len(size[1])) >= toxicity.MIN_CUE_RATIO}

    def errors(word):
        best = 9
        for term in terms:
            row = list(range(len(term) + 1))
            for x in word[:40]:
                new = [row[0] + 1]
                for k, c in enumerate(term):
                    new.append(min(row[k] + (x != c), row[k + 1] + 1, new[k] + 1))
                row = new
            e = row[-1] + max(0, len(word) - 40)
            best = min(best, e if e == 0 or (e == 1 and len(term) >= toxicity.FUZZY_FROM) else 9)
        return best

    def features(text):
        text = text.lower()
        words = [(x.start(), x.end()) for x in re.finditer(r"[^\W_]+", text)]
        out, used = [0, 0, 0, 0, math.log1p(len(words))], []
        for k, (a, b) in enumerate(words):
            e = errors(text[a:b])
            if e > 1:
                continue
            line, stop = text.rfind("\n", 0, a) + 1, (text + "\n").find("\n", b)
            before, after = sum(c in toxicity.QUOTES for c in text[line:a]), sum(c in toxicity.QUOTES for c in text[b:stop])
            around = words[max(0, k - window) : k] + words[k + 1 : k + 1 + window]
            aside = (before % 2 == 1 and after > 0) or any(text[c:d] in cues for c, d in around)
            if e == 0:
                out[1 if aside else 0] += 1
                if not aside:
                    used.append(k)
            elif not aside:
                out[2] += 1
        out[3] = max((sum(a <= b < a + 20 for b in used) for a in used), default=0)
        return out

    x = np.array([features(t or "") for _, t, *_ in rows])
    mine = [k for k, r in enumerate(rows) if r[0] in y and fold(r[0]) != 2]
    beta = toxicity.logistic(toxicity.shape(x[mine]), np.array([y[rows[k][0]] for k in mine], float))
    want = 1 / (1 + np.exp(-np.clip(toxicity.shape(x) @ beta[:-1] + beta[-1], -30, 30)))
    want = collections.Counter((r[0], *map(int, f[:4]), round(float(w), 4)) for r, f, w in zip(rows, x, want))
    assert collections.Counter((r.doc_id, int(r.used), int(r.quoted), int(r.near), int(r.densest), round(r.score, 4)) for r in got) == want


def test_cues(spark):
    """Words near terms in clean rows and hardly in toxic ones; copies of a row teach nothing more."""
    clean = [(f"item {k} she wrote idiot about number {k}", 0) for k in range(6)] + [("they reported scum once", 0)] * 9
    rude = [(f"you idiot are number {k} now", 1) for k in range(20)] + [(f"such scum wrote {k}", 1) for k in range(1)]
    train = spark.createDataFrame([*clean, *rude, (None, 0)], "text string, y int")
    assert toxicity.learn_cues(train, ["idiot", "scum"]) == {"she", "wrote", "about", "item"}
    assert toxicity.learn_cues(train, ["absent"]) == toxicity.learn_cues(train, []) == toxicity.learn_cues(train.where("y = 0"), ["idiot"]) == frozenset()


def plain_pipeline(rows, items):
    """run() of the pipeline on (doc_id, text, lang, source, n_chars)."""
    good = [r for r, q in zip(rows, plain_rules([r[:2] for r in rows])) if q[-1]]
    found, _ = plain_near([r[:2] for r in good], 5)
    first = {}
    for r, c in zip(good, found):
        first[c] = min(first.get(c, r[0]), r[0])
    one = [r for r, c in zip(good, found) if c is None or r[0] == first[c]]
    leaked = {i for i, *_ in plain_leaks([r[:2] for r in one], items)}
    documents = pd.DataFrame([r for r in one if r[0] not in leaked], columns=["doc_id", "text", "lang", "source", "n_chars"])
    db = duckdb.connect()
    db.register("documents", documents)
    copies = {i: n for i, n in db.sql(f"SELECT doc_id, copies FROM ({mixing.OP9_SQL})").fetchall()}
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(token_io.default_tokenizer()), [], 0
    for i, text in sorted(zip(documents.doc_id.tolist(), documents.text)):
        ids = [*t.encode(text, add_special_tokens=False).ids, token_io.END_ID]
        for _ in range(copies[i]):
            out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(6)
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in corpus(5, 60)]
    rows += [(90 + k, " ".join(rng.choice(["Of%%%", "THE&&&", "x#"]) for _ in range(70)), "en", "s1", 0) for k in range(4)]
    items = [(1, rows[8][1][5:140]), (2, "nothing like this stands in any of the documents of this corpus")]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    for folder, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, names).write.parquet(str(tmp_path / folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / folder / "benchmark.parquet"))
    want = plain_pipeline(rows, items)
    got = sorted(tuple(r) for r in p.run(spark, str(tmp_path / "some")).collect())
    assert got == sorted(want) and 0 < len({r[0] for r in want}) < len(rows) - 5
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_one_of_each_component_stays(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near, other = base.replace("w30 ", "z "), " ".join(f"v{k}" for k in range(60))
    rows = [(3, base), (5, near), (5, other), (None, base + " "), (None, other + " end"), (3, base), (8, ""), (8, ""), (None, None), (2, "q " * 9), (2, "q " * 9)]
    kept = neardup.keep_one(frame(spark, [(i, t, "en", "a") for i, t in rows])).select("doc_id", "text").collect()
    got = collections.Counter((r.doc_id, r.text) for r in kept)
    # 5 has a near copy of 3 and a text of its own: only the first goes.
    assert got == collections.Counter({(3, base): 1, (5, other): 1, (8, ""): 2, (None, None): 1, (2, "q " * 9): 1})


def test_recall_of_bands(spark):
    """Links found on a small table against all pairs: none may be lost."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want, _ = plain_near(rows, 4)
    low = collections.defaultdict(list)
    for (i, _), c in zip(rows, want):
        low[c].append(i)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).collect()}
    assert got == {i: i if c is None else min(low[c]) for (i, _), c in zip(rows, want)}
    assert len(set(got.values())) < len(rows)
