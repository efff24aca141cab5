import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rallyframe.llm import common, language


def test_trigrams():
    v, n, letters = language.trigrams(pa.array(["Ab, cd", None, "é", "12", "X"]))
    pack = lambda s: ord(s[0]) << 42 | ord(s[1]) << 21 | ord(s[2])
    assert v.tolist() == [pack("ab "), pack(" cd")]
    assert n.tolist() == [2, 0, 0, 0, 0] and letters.tolist() == [4, 0, 1, 0, 1]


def test_cases(spark):
    words = {"aa": "bana kana lana mana ", "bb": "trost prost krost frost "}
    docs = [(i, words["ab"[i % 2] * 2] * (i % 5 + 1), "ab"[i % 2] * 2) for i in range(40)]
    docs += [(100, None, "aa"), (101, "", None), (102, "123 !", "bb"), (103, "bana", None), (103, "prost", None), (None, "krost", "aa"), (104, "kana " * 30000, "aa")]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred): r for r in language.predicted(df).collect()}
    assert len(got) == len(docs)
    for i, t, lang in docs[:40]:
        assert (i, lang) in got and got[i, lang].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {k for k in got if k[0] in (100, 101, 102)} == {(100, "und"), (101, "und"), (102, "und")}
    assert (103, "aa") in got and (103, "bb") in got and (None, "bb") in got and (104, "aa") in got
    assert language.predicted(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predicted(df.withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}


def grams(text):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    spaced = re.sub(" +", " ", low + " ").lstrip(" ") if not low.startswith(" ") else " " + re.sub(" +", " ", low + " ").strip(" ") + " "
    return [spaced[i : i + 3] for i in range(len(spaced) - 2) if spaced[i + 1] != " "]


def filters_by_hand(docs):
    count = {}
    for i, text, lang in docs:
        if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            count.setdefault(lang, Counter()).update(grams(text))
    share = {x: {g: k / sum(c.values()) for g, k in c.items() if k / sum(c.values()) >= language.SHARE} for x, c in count.items()}
    most = Counter()
    for s in share.values():
        for g, v in s.items():
            most[g] = max(most[g], v)
    return {x: {g for g, v in s.items() if v >= language.NEAR * most[g]} for x, s in share.items()}


def test_verdicts_by_hand(spark):
    """The same filters as plain sets: where these decide clearly, so do the Bloom filters, with nearly the same score."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    held = filters_by_hand(rows)
    got = {r.doc_id: r for r in language.predicted(docs).collect()}
    clear = 0
    for i, text, _ in rows:
        own = grams(text)
        hits = sorted(((sum(g in s for g in own), x) for x, s in held.items()), key=lambda h: (-h[0], h[1]))
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
        elif own and hits[0][0] - hits[1][0] > 0.02 * len(own) + 3:
            clear += 1
            assert got[i].lang_pred == hits[0][1] and abs(got[i].score - hits[0][0] / len(own)) < 0.02
    assert clear > 0.9 * len(rows)


def test_many_languages_and_ties(spark, monkeypatch):
    words = ["bana kana", "trost prost", "xylo zylo", "mimi momo"]
    docs = [(i, words[i % 4], "dcba"[i % 4]) for i in range(80)] + [(i, words[0], "e") for i in range(200, 240)]
    docs += [(500, words[0], None), (501, "q", None), (502, None, None), (503, "9", None), (504, words[1], None), (504, words[1], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    told = lambda found: sorted((r.doc_id, r.lang_pred, r.score) for r in found.collect())
    one = told(language.predicted(df))
    assert dict((i, x) for i, x, _ in one)[500] == "d" and ("q" not in words) and dict((i, x) for i, x, _ in one)[501] == "a"
    monkeypatch.setattr(language, "PASS", 2)
    assert told(language.predicted(df)) == one
    extra = df.withColumns({"row": language.F.lit(1), "score": language.F.lit(2), "lang_pred": language.F.lit("x"), "a.b": language.F.lit(3), "rid": language.F.lit(4)})
    kept = language.stage(spark, extra, "")
    assert kept.columns == extra.columns and kept.count() == 80 + 40 + 3


def test_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    found = language.predicted(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").toPandas()
    wrong = found[found.lang != found.lang_pred]
    print(len(found), len(wrong), found.score.describe([0.001, 0.01, 0.05, 0.5]))
    for r in wrong.head(8).itertuples():
        print(r.doc_id, r.lang, r.lang_pred, r.score, repr(r.text[:150]))
    print(found.sort_values("score")[["doc_id", "lang", "lang_pred", "score"]].head(12))
    for r in found.sort_values("score").head(5).itertuples():
        print(repr(r.text[:200]))
    assert len(wrong) <= 0.02 * len(found)


def test_many_languages_in_bounded_memory(spark):
    """The filters of 256 languages: the driver gets masks of slots, at most one for each slot of a plane."""
    held = spark.range(256 * 2000).select((F.col("id") % 256).alias("k"), F.xxhash64("id").alias("gram"))
    masks = language.sliced(held).toArrow()
    assert len(masks) <= 4 << language.SLOT_BITS and masks.nbytes < 150_000_000
    planes = language.planes_of(256)
    rows = held.toArrow()
    language.put(planes, rows["k"].to_numpy(), rows["gram"].to_numpy())
    got = language.planes_of(256)
    got[masks["plane"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
    assert (got == planes).all()
