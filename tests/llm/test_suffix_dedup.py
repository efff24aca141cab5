import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from rallyframe.llm import common, suffix_dedup


def brute(docs):
    raw = [(t or "").encode() for _, t in docs]
    n = Counter(r[i : i + 400] for r in raw for i in range(len(r) - 399))
    out = []
    for (d, _), r in zip(docs, raw):
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - 399):
            if n[r[i : i + 400]] > 1:
                gone[i + 1 : i + 401] = True
        left = bytes(b for b, g in zip(r, gone[1:]) if not g)
        out.append((str(d), len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passage_words(docs):
    """Words in runs of over 50 that lie, as a whole, in strings of 256 bytes that another document has too."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    who = {}
    for key in set(raw):
        for i in range(len(key[1]) - 255):
            who.setdefault(key[1][i : i + 256], set()).add(key)
    out = []
    for d, r in raw:
        hit = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - 255):
            if len(who[r[i : i + 256]]) > 1:
                hit[i + 1 : i + 257] = True
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        n = [sum(a <= m.start() and m.end() <= b for m in re.finditer(rb"\S+", r)) for a, b in zip(edge[::2], edge[1::2])]
        out.append((str(d), sum(x for x in n if x > 50)))
    return sorted(out)


def words_of(df):
    return sorted((str(r.doc_id), r.n_passage_words) for r in df.collect())


def rows(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def made(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    p = text(400)
    docs = [text(n) for n in (5, 100, 300, 600)]
    docs += [text(20) + p[:k] + text(20) for k in (380, 395, 399, 400, 401, 450, 800)] + [text(30) + p[300:900] + text(3) + p[100:700]]
    docs += ["ab" * 600, "x" * 399, "x" * 400, "y" * 401, None, "", "z" * 5000 + text(100) + "z" * 3000]
    base = text(700)
    for _ in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [docs[2], docs[2]] + ["q" + base, base + "q"]
    return list(enumerate(docs))


def test_cases(spark):
    docs = made()
    docs += [docs[3], (None, docs[1][1]), (500, "short")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, lo string, text_hash string").repartition(3)
    found = suffix_dedup.deduplicated(df)
    assert rows(found) == brute(docs)
    assert words_of(found) == passage_words(docs)
    for r in found.collect():
        left = b"".join(suffix_dedup.kept(r.text.encode(), r.removed))
        assert hashlib.sha256(left).hexdigest() == r.kept_sha256
    assert rows(suffix_dedup.deduplicated(df.limit(0))) == []


def test_many_small_runs(spark):
    docs = made(8)
    suffix_dedup.RUN_BYTES, real = 3000, suffix_dedup.RUN_BYTES
    try:
        assert rows(suffix_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    finally:
        suffix_dedup.RUN_BYTES = real


def test_hot_anchors_are_split(spark):
    docs = made(9)
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(70))  # under 400 bytes
    longer = passage + " ".join(f"v{rng.randrange(999)}" for _ in range(70))
    docs += [(100 + i, f"{rng.random()} " * rng.randint(0, 20) + (passage if i % 2 else longer) + f" {rng.random()}" * rng.randint(0, 20)) for i in range(80)]
    docs += [docs[-1], (None, docs[-1][1]), (None, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    suffix_dedup.MOST, real = 5, suffix_dedup.MOST
    try:
        found = suffix_dedup.deduplicated(df)
        assert rows(found) == brute(docs)
        assert words_of(found) == passage_words(docs)
    finally:
        suffix_dedup.MOST = real


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        coded = [suffix_dedup.front_coded(r) for r in runs]
        assert [suffix_dedup.decoded(*c) for c in coded] == runs
        order, shared = suffix_dedup.merged([(r, c[0].tolist()) for r, c in zip(runs, coded)])
        got = [runs[a][i] for a, i in order]
        assert got == sorted(x for r in runs for x in r)
        assert shared == [suffix_dedup.shared_prefix(a, b, 0) for a, b in zip([b""] + got, got)]


def test_anchors_cover_every_window():
    data, off = common.flat(pa.array([t for _, t in made()]))
    a = suffix_dedup.anchors(common.prefix_hash(data), off)
    windows = {(d, s) for d, lo, hi in zip(a["doc"], a["lo"], a["hi"]) for s in range(lo, hi + 1)}
    assert windows == {(d, s) for d in range(len(off) - 1) for s in range(off[d + 1] - off[d] - 255)}


def test_table(spark):
    docs = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    found = suffix_dedup.query(spark, "/root/testdata/sf0.01").cache()
    assert rows(found) == brute(docs)
    assert words_of(found) == passage_words(docs)
