import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rallyframe.llm import common, pitman_yor

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW)) + [b"\n"]


def brute(docs):
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    c = Counter(w for (d, t), h in zip(docs, held) if not h and d is not None for w in split(t))
    n = sum(c.values())
    out = []
    for (d, t), h in zip(docs, held):
        w = split(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in w)
        out.append((str(d), h, len(w), sum(c[x] > 0 for x in w), n, f"{base:.6f}"))
    return sorted(out)


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1

COLUMNS = ("held_out", "n_tokens", "n_known", "train_tokens")


def rows(df):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS), f"{r.base_score:.6f}") for r in df.collect())


def test_tokens():
    h, n = pitman_yor.tokens(pa.array(["Ab  c AB", None, " \n", "é"]))
    assert n.tolist() == [4, 1, 1, 2] and h[0] == h[2] != h[1] and (h[[3, 4, 5, 7]] == pitman_yor.END_HASH).all()


def test_cases(spark):
    docs = [(i, t) for i, t in enumerate([None, "", " \n", "a", "A a b", "x y\tz", "word " * 50_000, "é è", "a b c a b c"] * 3)] + [(4, "twice"), (4, "twice"), (None, "a null id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    found = pitman_yor.scored(df, held())
    assert rows(found) == brute(docs)
    assert all(r.score < 0 for r in found.collect())
    assert pitman_yor.scored(df.limit(0), held()).count() == 0
    alone = pitman_yor.scored(df.where("doc_id = 4"), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isclose(alone.score, 0, abs_tol=1e-9)


def toy(n=120, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(list("abcdef"), rng.integers(1, 9), p=[0.4, 0.25, 0.15, 0.1, 0.05, 0.05]))) for i in range(n)]


def gibbs(docs, sweeps=600, burn=100, seed=1):
    """The predictive probabilities {(context, word)} of the same model by the book: every customer of every restaurant leaves its
    table and is seated again, one at a time, at both levels; and the discount."""
    rng = np.random.default_rng(seed)
    pairs = [p for _, t in docs for w in [split(t)] for p in zip([b"start", *w[:-1]], w)]
    count = Counter(pairs)
    one, two = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.95, max(0.05, one / (one + 2 * two)))
    words = sorted({w for _, w in pairs})
    v = len(words)
    top = {w: [] for w in words}  # sizes of the root's tables, by dish
    low = {}  # sizes of the tables, by context and dish
    size, total = lambda x: sum(map(sum, x)), lambda x: sum(map(len, x))

    def parent(w):
        n, t = size(top.values()), total(top.values())
        return (sum(top[w]) - d * len(top[w]) + (1 + d * t) * 0.1 / v) / (1 + n)

    def sit(tables, new):
        k = rng.choice(len(tables) + 1, p=(q := np.array([x - d for x in tables] + [new])) / q.sum())
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        return not tables[k] and tables.pop(k) == 0

    def join(u, w):
        everywhere = sum(len(x) for (c, _), x in low.items() if c == u)
        if sit(low.setdefault((u, w), []), (1 + d * everywhere) * parent(w)):
            sit(top[w], (1 + d * total(top.values())) * 0.1 / v)

    for u, w in pairs:
        join(u, w)
    mean = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(low[u, w]):
                leave(top[w])
            join(u, w)
        if sweep >= burn:
            for u in {c for c, _ in pairs}:
                own = {w: low.get((u, w), []) for w in words}
                n, t = size(own.values()), total(own.values())
                for w in words:
                    mean[u, w] += (sum(own[w]) - d * len(own[w]) + (1 + d * t) * parent(w)) / (1 + n) / (sweeps - burn)
    return mean


def test_seats_follow_the_distribution():
    rng, d, p, others = np.random.default_rng(2), 0.4, 0.2, 3.0
    tables = {}
    for _ in range(40_000):  # by the book: the seats of customers that all eat this dish, weighted by how likely that is
        t, weight = 1, 1.0
        for j in range(1, 5):
            new, stay = (1 + d * (others + t)) * p, j - d * t
            weight *= new + stay
            t += rng.random() * (new + stay) < new
        tables[t] = tables.get(t, 0) + weight
    got = pitman_yor.seat(rng, np.full(40_000, 5), np.full(40_000, p), np.full(40_000, others), d)
    for t, w in tables.items():
        assert abs(w / sum(tables.values()) - (got == t).mean()) < 0.015
    many = pitman_yor.seat(rng, np.array([1, 0, 64, 65, 400, 10**6]), np.full(6, 0.9), np.full(6, 10.0), d)
    assert many[0] == 1 and many[1] == 0 and (many[2:] >= 1).all() and many[5] > many[4]


def test_arrays_survive():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([2**64 - 1, 0, 5], np.uint64), rng.integers(0, 300, 999)):
        assert (pitman_yor.restored(pitman_yor.squeezed(x)) == x).all()
        assert (pitman_yor.risen(pitman_yor.rising(np.sort(x))) == np.sort(x)).all()


def test_scores_against_gibbs_by_the_book(spark):
    train = toy()
    want = gibbs(train, 200, 50)
    probes = [(1000 + i, f"{u} {w}".strip()) for i, (u, w) in enumerate([(u, w) for u in "abcdef" for w in "abcdef"] + [("", w) for w in "abcdef"])]
    unknown = [(2000 + i, f"{u} zzz") for i, u in enumerate("abcdef")]
    df = spark.createDataFrame(train + probes + unknown, "doc_id long, text string").repartition(3)
    for split_at in (pitman_yor.SPLIT, 40):
        found = {r.doc_id: r for r in pitman_yor.scored(df, F.col("doc_id") >= 1000, split=split_at, rounds=4, sweeps=60, with_tokens=True).collect()}
        off, chance = [], {}
        for i, text in probes:
            tokens = split(text)
            for u, w, x in zip([b"start", *tokens], tokens, found[i].token_scores):
                off.append(abs(x - math.log10(want[u, w])))
                assert math.isclose(chance.setdefault((u, w), x), x, rel_tol=1e-6)
        assert np.mean(off) < 0.04 and max(off) < 0.15  # all pairs are seated at the same time, given the level above
        for i, text in unknown:
            u = text[0].encode()
            rest = 10 ** found[i].token_scores[1]
            assert math.isclose(sum(10**x for (c, _), x in chance.items() if c == u) + rest, 1, rel_tol=1e-4)


def test_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = pitman_yor.query(spark, "/root/testdata/sf0.01").cache()
    assert rows(found) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    held = found.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.sum((F.col("score") > F.col("base_score")).cast("int")), F.count("*")).first()
    print("perplexity a token, model and base:", 10 ** (-held[0] / held[2]), 10 ** (-held[1] / held[2]), held[3], held[4])
    assert 10 ** (-held[0] / held[2]) < 0.95 * 10 ** (-held[1] / held[2])


def test_production_settings_come_as_near(spark):
    train = toy()
    want = gibbs(train, 200, 50)
    probes = [(1000 + i, f"{u} {w}") for i, (u, w) in enumerate((u, w) for u in "abcdef" for w in "abcdef")]
    df = spark.createDataFrame(train + probes, "doc_id long, text string")
    for split_at in (pitman_yor.SPLIT, 40):
        off = []
        for r in pitman_yor.scored(df, F.col("doc_id") >= 1000, split=split_at, with_tokens=True).where("doc_id >= 1000").collect():
            words = split(probes[r.doc_id - 1000][1])
            off += [abs(x - math.log10(want[pair])) for pair, x in zip(zip([b"start", *words], words), r.token_scores)]
        assert np.mean(off) < 0.04


def test_parts_grow_with_the_text(spark, monkeypatch):
    docs = [(i, f"word{i % 7} next{i % 3} " * 40) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    plain = pitman_yor.by_key
    monkeypatch.setattr(pitman_yor, "by_key", lambda rows_, key, work, parts, *more: seen.append(parts) or plain(rows_, key, work, parts, *more))
    for size in (1 << 30, 2000, 1000):
        monkeypatch.setattr(pitman_yor, "PART_BYTES", size)
        seen.append(0)
        assert rows(pitman_yor.scored(df, held())) == brute(docs)
    most = [max(x) for x in np.split(seen, np.flatnonzero(np.array(seen) == 0)) if len(x)]
    text = sum(len(t) for _, t in docs)
    assert most == [8, -(-text // 2000), -(-text // 1000)]


def test_expected_tables():
    rng, d = np.random.default_rng(4), 0.6
    drawn = []
    for _ in range(3000):
        t = 0
        for c in range(50):
            t += rng.random() * (c + pitman_yor.STRENGTH) < pitman_yor.STRENGTH + d * t
        drawn.append(t)
    assert abs(np.mean(drawn) - pitman_yor.expected_tables(50, d)) < 0.5
