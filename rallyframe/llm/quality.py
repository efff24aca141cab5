"""Quality rules: base rules, and a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Both multinomials are over the hashed 4-byte n-grams of whole texts: the raw one counts every document of the corpus,
the target one every document with a label of good quality, found by a join of ids, whatever their number. The score
of a document is the mean log ratio of its n-grams, so it doesn't depend on its length; a document is kept where it
reaches the threshold. If none is given, the threshold is the one that best separates all good and bad labels.
Three scans of the texts. That for the target sends only texts to the join whose id hashes to the slot of a good label's,
in a table of `2 ** SLOT_BITS` bits (more labels fill it, and more texts are sent, but the join decides). Counts are
combined in each task before the shuffle; the driver sees that table, the `2 ** BITS` bucket weights and the counts of
`BINS` scores, and no label.

Cases: a null or wordless text has no words and fails the base rules; texts of fewer than 4 bytes score 0; repeated rows
and ids are judged one by one, and a label goes to every row with its id (an id with a good label among others is of
the target; for the threshold each of its labels counts); without good labels every document that
passes the base rules is kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME, SQL = "op5_ngram_ratio", None

BITS = 16
GRAM = 4
#: Counts, spread as the raw corpus is, that the target starts from.
PRIOR = 2_000.0
BINS = 4096
SLOT_BITS = 24
LEAST, WIDTH = -12.0, 24.0 / BINS

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of each text, one after the other, and how many each text has."""
    size = np.diff(off)
    n = np.maximum(size - GRAM + 1, 0)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), n
    x = data.astype(np.uint32)
    v = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    inside = np.ones(len(data), bool)
    for k in range(1, GRAM):  # the last three bytes of a text start no n-gram of it
        inside[np.maximum(off[1:] - k, off[:-1])[size > 0]] = False
    inside[np.repeat(size < GRAM, size)] = False
    v = v[inside[: len(v)]]
    return (v * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64), n


def by_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def base_features(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text. Lines and windows are compared by 64-bit hash."""
    docs = len(off) - 1
    start, end, count = common.words_at(data, off)
    sums = common.prefix_hash(data)
    # lines: cut at \n and at the texts' borders
    cut = np.unique(np.concatenate([off[:-1], off[1:], np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    a, b = cut[:-1], cut[1:]
    filled = np.searchsorted(start, b) > np.searchsorted(start, a)  # holds a word's start
    a, b = a[filled], b[filled]
    doc = np.searchsorted(off, a, side="right") - 1
    lines = np.unique(common.mixed(common.span_hash(sums, a, b) + doc.astype(np.uint64)), return_index=True)[1]
    dup = np.bincount(doc, minlength=docs) - np.bincount(doc[lines], minlength=docs)
    # 3-word windows
    first = np.cumsum(count) - count
    n = np.maximum(count - 2, 0)
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    h = common.span_hash(sums, start, end)
    owner = np.repeat(np.arange(docs, dtype=np.uint64), n)
    key = common.mixed(common.mixed(common.mixed(h[at] + owner) + h[at + 1]) + h[at + 2]) if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(start) + 3, bool)
    for k in range(3):
        hit[at[twice[:-1]] + k] = True
    return {
        "n_words": count.astype(np.int64),
        "word_chars": by_text(~common._SPACE[data] & ((data & 0xC0) != 0x80), off),
        "n_symbols": by_text(_SYMBOL[data], off),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": by_text(hit[: len(start)], np.concatenate([first, [len(start)]])),
    }


def known_labels(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """doc_id, good, bad: how many good and bad labels each labelled id has."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(quality_col).cast("int").alias("q")).dropna()
    return rows.groupBy("doc_id").agg(F.count_if(F.col("q") > 0).alias("good"), F.count_if(F.col("q") <= 0).alias("bad"))


def bucket_counts(docs: DataFrame, name: str) -> np.ndarray:
    """How often each bucket occurs in the texts. name: of the column of counts, so plans tell the raw from the target's."""

    def count(it):
        own = np.zeros(1 << BITS, np.int64)
        for batch in common.batches(it):
            own += np.bincount(buckets(*common.flat(batch["text"]))[0], minlength=1 << BITS)
        k = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(own[k])], ["bucket", name])

    out = np.zeros(1 << BITS)
    for k, n in docs.select("text").mapInArrow(count, f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name)).collect():  # a row for each bucket at most
        out[k] = n
    return out


def slot() -> Column:
    return F.xxhash64("doc_id").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of all rows whose id is among ids, and of some others."""
    masks = ids.select(slot().alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("mask")).toArrow()
    table = np.zeros(1 << SLOT_BITS - 6, np.int64)
    table[masks["word"].to_numpy()] = masks["mask"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sift(it):
        for batch in it:
            s = batch["slot"].to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array(shared.value[s >> 6] >> (s & 63) & 1 == 1))

    return docs.select("doc_id", "text", slot().alias("slot")).mapInArrow(sift, "doc_id long, text string")


def weights(docs: DataFrame, known: DataFrame) -> np.ndarray | None:
    """The log ratio of each bucket; None where there is no target."""
    good = known.where("good > 0").select("doc_id")
    target = bucket_counts(likely(docs, good).join(good.hint("merge"), "doc_id", "left_semi"), "target")  # ids aren't broadcast, however few
    if not target.sum():
        return None
    raw = bucket_counts(docs, "raw")
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    return np.log((target + PRIOR * p) / (target.sum() + PRIOR) / p)


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, log_ratio: np.ndarray | None) -> DataFrame:
    """doc_id, the base features and llr of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def score(it):
        for batch in common.batches(it):
            data, off = common.flat(batch["text"])
            base = base_features(data, off)
            v, n = buckets(data, off)
            own = np.concatenate([[0.0], np.cumsum(shared.value[v])]) if shared.value is not None else np.zeros(len(v) + 1)
            upto = np.cumsum(n)
            llr = (own[upto] - own[upto - n]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(base[k]) for k in FEATURES), pa.array(llr)], ["doc_id", *FEATURES, "llr"])

    return docs.mapInArrow(score, "doc_id long, " + ", ".join(f"{k} long" for k in FEATURES) + ", llr double")


def best_threshold(found: DataFrame, known: DataFrame) -> float:
    """The border of two bins of llr that best separates good from bad labels (mean of both rates; the lowest of equals)."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("llr") - LEAST) / WIDTH).cast("int")))
    counts = np.zeros((2, BINS))
    for k, good, bad in found.where(~F.col("base_failed")).join(known, "doc_id").groupBy(bin_).agg(F.sum("good"), F.sum("bad")).collect():
        counts[:, k] = bad, good
    if not counts.sum(axis=1).all():
        return LEAST
    below = np.concatenate([[[0], [0]], np.cumsum(counts, axis=1)], axis=1) / counts.sum(axis=1, keepdims=True)
    return LEAST + WIDTH * int(np.argmax(below[0] - below[1]))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """doc_id, the base features, base_failed, llr and kept of every document."""
    docs = common.documents(docs, id_col, text_col)
    known = known_labels(labels)
    log_ratio = weights(docs, known)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = common.written(scored(docs, log_ratio).withColumn("base_failed", failed))
    if threshold is None:
        threshold = best_threshold(found, known) if log_ratio is not None else LEAST
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", *FEATURES, "base_failed", "kept", "llr")
