import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rallyframe.llm import common, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def rows(df):
    return sorted((str(r.doc_id), *(str(r[c]) for c in (*quality.FEATURES, "base_failed"))) for r in df.collect())


TEXTS = [None, "", " \n\t", "a", "a b c a b c a b", "x\nx\n\n x\ny\nx", "é\xa0b #*$%&|<> \x0b\x0c\r z", "same line here\nsame line here\r\nsame line here", "tail\n", "\nhead", "w " * 20000, "q", "a b", "c"]


def test_cases(spark):
    docs = list(enumerate(TEXTS)) + [(3, "a"), (None, "null id")]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id long, text string, llr double")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    want = sorted((str(i), *map(str, brute(t))) for i, t in docs)
    assert rows(quality.judged(df, labels)) == want
    assert rows(quality.judged(df, labels.limit(0))) == want
    assert quality.judged(df.limit(0), labels).count() == 0
    none = quality.judged(df, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_table(spark):
    path = "/root/testdata/sf0.1"
    docs = common.table(spark, path, "documents")
    found = quality.judged(docs, common.table(spark, path, "labels")).cache()
    want = sorted((str(r.doc_id), *map(str, brute(r.text))) for r in docs.collect())
    assert rows(found) == want
    labels = {r.doc_id: r.quality for r in common.table(spark, path, "labels").collect()}
    part = Counter((labels[r.doc_id], r.kept) for r in found.collect() if r.doc_id in labels and not r.base_failed)
    print(part)
    assert part[1, True] >= 0.98 * (part[1, True] + part[1, False])
    assert part[0, False] >= 0.85 * (part[0, True] + part[0, False])


def grams(text):
    b = (text or "").encode()
    return [(int.from_bytes(b[i : i + 4], "little") * 0x9E3779B1 % 2**32) >> (32 - quality.BITS) for i in range(len(b) - 3)]


def test_verdicts_by_hand(spark):
    path = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in common.table(spark, path, "documents").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in common.table(spark, path, "labels").collect()}
    raw, target = Counter(), Counter()
    for i, text in docs:
        g = Counter(grams(text))
        raw += g
        if labels.get(i, 0) > 0:
            target += g
    size, n, m = 1 << quality.BITS, sum(raw.values()), sum(target.values())
    chance = lambda k: (raw[k] + 0.5) / (n + 0.5 * size)
    ratio = {k: math.log((target[k] + quality.PRIOR * chance(k)) / (m + quality.PRIOR) / chance(k)) for k in raw}
    found = {r.doc_id: r for r in quality.judged(common.table(spark, path, "documents"), common.table(spark, path, "labels")).collect()}
    for i, text in docs:
        g = grams(text)
        assert math.isclose(found[i].llr, sum(ratio[k] for k in g) / max(1, len(g)), rel_tol=1e-6, abs_tol=1e-9)
    # the threshold separates the labels at least as well as any border between two of their scores, up to a bin's width
    known = [(found[i].llr, q > 0) for i, q in labels.items() if not found[i].base_failed]
    good, bad = sum(q for _, q in known), sum(not q for _, q in known)
    worth = lambda t: sum(q and s >= t for s, q in known) / good + sum(not q and s < t for s, q in known) / bad
    least = min(x.llr for x in found.values() if x.kept)
    assert worth(least) >= max(worth(s + d) for s, _ in known for d in (0, 1e-12)) - 0.02
    assert all(r.kept == (not r.base_failed and r.llr >= least) for r in found.values())


def test_threshold_on_labels_held_out(spark):
    path = "/root/testdata/sf0.1"
    labels = common.table(spark, path, "labels")
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 0"
    found = quality.judged(common.table(spark, path, "documents"), labels.where(f"NOT {held}")).join(labels.where(held), "doc_id").where("NOT base_failed")
    part = {(r.good, r.kept): r["count"] for r in found.groupBy((found.quality > 0).alias("good"), "kept").count().collect()}
    get = lambda *k: part.get(k, 0)
    print("held out: good kept", get(True, True), "of", get(True, True) + get(True, False), "bad left out", get(False, False), "of", get(False, True) + get(False, False))
    assert get(True, True) >= 0.95 * (get(True, True) + get(True, False)) and get(False, False) >= 0.8 * (get(False, True) + get(False, False))


def test_large_ids_beside_a_null(spark):
    """2 ** 53 has a label, 2 ** 53 + 1 has none: its text isn't of the target, whatever shares its batch."""
    good, other = "trusted words " * 30, "unlike others " * 30
    docs = [(2**53, good), (2**53 + 1, other), (2**62 + 1, other), (0, other)]
    labels = spark.createDataFrame([(2**53, 1), (2**62, 1)], "doc_id long, quality int")
    llr = []
    for more in ([], [(None, "")]):
        df = spark.createDataFrame([*docs, *more], "doc_id long, text string").coalesce(1)
        llr.append({r.doc_id: r.llr for r in quality.judged(df, labels).collect()})
    assert llr[0] == {k: v for k, v in llr[1].items() if k is not None}
    assert llr[0][2**53] > 0 > llr[0][2**53 + 1] == llr[0][0]


def test_all_labels_count(spark):
    """Of 60,000 labels, those whose ids have the largest hashes decide too, on the target and on the threshold."""
    ids = [r.id for r in spark.range(60_000).orderBy(F.xxhash64("id")).collect()]
    text = {i: " ".join(f"{word}{k}" for k in range(80)) for i, word in ((ids[0], "fine"), (ids[-1], "junk"))}
    docs = spark.createDataFrame([*text.items(), (-1, "")], "doc_id long, text string")

    for good, bad in ((ids[0], ids[-1]), (ids[-1], ids[0])):
        labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") == good).cast("int").alias("quality"))
        found = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
        assert found[good].llr > 0 > found[bad].llr
        assert found[good].kept and not found[bad].kept
    # each label of an id counts for the threshold, and one good label among others puts its text into the target
    twice = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[0], 1), (ids[-1], 0), (ids[-1], None)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.known_labels(twice).orderBy("good").collect()] == [(ids[-1], 0, 1), (ids[0], 2, 1)]
    found = {r.doc_id: r for r in quality.judged(docs, twice).collect()}
    assert found[ids[0]].llr > 0 and found[ids[0]].kept and not found[ids[-1]].kept


def test_only_likely_texts_meet_the_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(i, str(i)) for i in range(-2000, 2000)] + [(None, "x")], "doc_id long, text string")
    ids = spark.range(0, 4000, 40).select(F.col("id").alias("doc_id"))
    for bits, most in ((24, 60), (6, 4001)):  # the second table is nearly full
        monkeypatch.setattr(quality, "SLOT_BITS", bits)
        found = [r.doc_id for r in quality.likely(docs, ids).collect()]
        assert set(range(0, 2000, 40)) <= set(found) and len(found) <= most
    monkeypatch.setattr(quality, "SLOT_BITS", 24)
    assert quality.likely(docs, ids.limit(0)).count() == 0
