import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rallyframe.llm import common, components, simhash

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs):
    fp = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    x = np.array(fp, np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3):
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if k in (a, b) else k for k in label]
    least = {}
    for k, (d, _) in zip(label, docs):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return sorted((str(d), f"{f:016x}", str(least.get(k))) for (d, _), f, k in zip(docs, fp, label))


def test_cases(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(999)}" for _ in range(400)]
    docs = [(i, t) for i, t in enumerate([None, "", " \n", "a", "a b", "A  b\tc", "a b c", "long " * 9000, " ".join(base), " ".join(base[:-1])])]
    docs += [(100 + i, " ".join(base[:k] + ["new"] + base[k:])) for i, k in enumerate(range(0, 400, 9))] + [(8, " ".join(base)), (None, "alone at last")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fp string")
    got = [(str(r.doc_id), f"{r.fp & (2**64 - 1):016x}", str(r.component_id)) for r in simhash.classes(df).collect()]
    assert sorted(got) == brute(docs)
    assert simhash.classes(df.limit(0)).count() == 0
    kept = simhash.stage(spark, df.withColumns({"kept_id": F.lit(1), "row": F.lit(2), "none": F.lit(3), "a.b": F.lit(4)}), "")
    assert kept.columns == [*df.columns, "kept_id", "row", "none", "a.b"]
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({c for _, _, c in got}) and len(set(ids)) == len(ids)


def test_stage_keeps_one_row_of_each_class(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(6)]
    docs = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, texts[4]), (9, texts[4]), (9, texts[5]), (4, texts[5]), (None, None), (None, "")]
    kept = simhash.stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    got = [tuple(r) for r in kept.collect()]
    assert sorted(map(str, (r for r in got if r[1]))) == sorted(map(str, [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[4]), (4, texts[5])]))
    assert len([r for r in got if not r[1]]) == 1


def test_large_run_is_split_exactly():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centre for k in rng.integers(0, 6, 300)]
    fp = np.unique(np.array(near, np.uint64))
    u, v = simhash.link_runs(np.zeros(len(fp), np.int64), fp)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    assert sorted(zip(*map(list, components.stars(u, v)))) == sorted(zip(*map(list, components.stars(fp[i], fp[j]))))


def test_pivots_take_a_run_apart(monkeypatch):
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    near = fp[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, near]))
    compared = []
    real = simhash.near
    monkeypatch.setattr(simhash, "near", lambda a, b, x, y: compared.append(len(a)) or real(a, b, x, y))
    u, v = simhash.link_runs(np.zeros(len(fp), np.int64), fp)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    assert sorted(zip(*map(list, components.stars(u, v)))) == sorted(zip(*map(list, components.stars(fp[i], fp[j]))))
    assert sum(compared) < len(fp) ** 2 / 8
    cells = [simhash.pivot_table(fp)[:, k] // simhash.WIDTH for k in range(3)]
    assert len(set(zip(*map(list, cells)))) > 30


def test_hot_keys_are_taken_apart(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**64, 4, dtype=np.uint64)
    fp = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for c in centre for k in rng.integers(0, 6, 250)], np.uint64))
    monkeypatch.setattr(simhash, "MOST", 20)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = simhash.links(nodes).collect()
    u, v = (np.array([r[k] for r in found], np.int64).view(np.uint64) for k in (0, 1))
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    assert sorted(zip(*map(list, components.stars(u, v)))) == sorted(zip(*map(list, components.stars(fp[i], fp[j]))))


def test_table(spark):
    got = sorted(tuple(map(str, r)) for r in simhash.query(spark, "/root/testdata/sf0.01").collect())
    docs = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    assert got == brute(docs)
