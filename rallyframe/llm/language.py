"""Language ID with bit-sliced Bloom filters of letter n-grams.

Training counts the letter trigrams (lower case; a run of other characters is one blank) of every labelled training
text. A language's filter holds a trigram if its share of the language's trigrams is at least `SHARE`, and at least
`NEAR` times its share in the language where it is most frequent, so passages in another language do no harm. That
bounds a filter to 1 / SHARE trigrams whatever the corpus. The filters are sliced by bit: a slot is a mask with one bit
for each language, so `HASHES` reads give all languages that hold a trigram.

Prediction counts, for each language, the trigrams of the text that its filter holds, and takes off those expected by
chance: (hits - n * f) / (1 - f), where f is the language's measured rate of false positives. The largest corrected
count wins (ties: the first language by name); the score is its share of the text's trigrams.

The filters are cut in tasks. Those of PASS languages at a time go to the executors, which bounds what is broadcast, and what
the driver sees of them; more languages take more scans, and the best of all scans wins.

Cases: a null text or one without a letter is `und` with score 0; so is every text if nothing was learned; a text with
letters but no trigram (a single letter) goes to the first language by name with score 0; rows without lang or id are
never learned from; repeated rows and ids are predicted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rallyframe.llm import common

NAME, SQL = "op3_language_filters", None

SHARE = 1e-5
NEAR = 0.5
SLOT_BITS = 20
#: Bytes of text that a task holds at once: its letters and trigrams take some sixty times as much.
CHUNK_BYTES = 1 << 20
HASHES = 3
#: Languages that are judged in one scan of the texts.
PASS = 256
#: The pipeline rejects documents whose best language explains less than this share of their trigrams.
LEAST_SCORE = 0.3

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """The lower case of every letter; 32 for any other character."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed trigrams of each text one after the other, how many each text has, and its number of letters."""
    data, off = common.flat(column)
    head = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    off = head[off]
    c = letter_table()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    letter = c != 32
    sums = np.concatenate([[0], np.cumsum(letter)])
    letters = sums[off[1:]] - sums[off[:-1]]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank after a letter
    c, doc = c[keep].astype(np.int64), doc[keep]
    v = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    ok = (doc[:-2] == doc[2:]) & (c[1:-1] != 32)
    return v[ok], np.bincount(doc[:-2][ok], minlength=len(off) - 1), letters


def slots(v: np.ndarray) -> list[np.ndarray]:
    h = common.mixed(v.astype(np.uint64))
    a, b = h >> np.uint64(64 - SLOT_BITS), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


def planes_of(number: int) -> np.ndarray:
    """No trigrams yet for that many languages: 8 MB for every 64 of them."""
    return np.zeros(((number + 63) // 64, 1 << SLOT_BITS), np.uint64)


def put(planes: np.ndarray, lang: np.ndarray, gram: np.ndarray) -> None:
    """Puts trigrams into the filters of languages, by their places."""
    for s in slots(gram):
        np.bitwise_or.at(planes, (lang // 64, s), np.uint64(1) << (lang % 64).astype(np.uint64))


class Filters:
    """The filters of languages in order of their names: planes of 64 languages, each a mask for every slot."""

    def __init__(self, langs: list[str], planes: np.ndarray):
        self.langs, self.planes = langs, planes
        self.false_rate = np.array([((planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** HASHES for i in range(len(langs))])

    @classmethod
    def of(cls, held: dict[str, np.ndarray]) -> Filters:
        langs, planes = sorted(held), planes_of(len(held))
        for i, lang in enumerate(langs):
            put(planes, np.full(len(held[lang]), i), held[lang])
        return cls(langs, planes)

    def best(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each text (its place), the corrected count of its trigrams, and the text's trigrams and letters."""
        v, n, letters = trigrams(column)
        upto = np.cumsum(n)
        found = np.zeros((max(1, len(self.langs)), len(n)))
        at = slots(v)
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for s in at[1:]:
                mask &= plane[s]
            for i in range(64 * p, min(64 * p + 64, len(self.langs))):
                hits = np.concatenate([[0], np.cumsum((mask >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
                f = self.false_rate[i]
                found[i] = np.maximum(0, (hits[upto] - hits[upto - n] - n * f) / max(1e-9, 1 - f))
        return found.argmax(axis=0), found.max(axis=0), n, letters


def learned(train: DataFrame) -> list[Filters]:
    """train: text, lang. The filters of its languages, from all its rows, PASS languages at a time."""

    def count(it):
        own: dict[str, list] = {}
        for batch in common.batches(it, limit=CHUNK_BYTES):
            lang = np.array(batch["lang"].to_pylist(), object)
            v, n, _ = trigrams(batch["text"])
            owner = np.repeat(lang, n)
            for x in set(lang):
                gram, k = np.unique(v[owner == x], return_counts=True)
                own.setdefault(x, []).append((gram, k))
                if len(own[x]) > 16:
                    own[x] = [merged(own[x])]
        common.let_go()
        for x, parts in own.items():
            gram, k = merged(parts)
            for i in range(0, len(gram), 100_000):
                g = gram[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(g), pa.string()), pa.array(g), pa.array(k[i : i + 100_000])], ["lang", "gram", "n"])

    def merged(parts):
        gram, k = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return gram, np.bincount(k, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)

    counts = train.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = common.written(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= SHARE)
    most = F.max("share").over(Window.partitionBy("gram"))
    held = common.written(share.withColumn("most", most).where(F.col("share") >= NEAR * F.col("most")).select("lang", "gram"))
    langs = common.written(totals.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).alias("k")))
    several = []
    for first in range(0, langs.count(), PASS):
        names = langs.where(F.col("k").between(first, first + PASS - 1)).withColumn("k", F.col("k") - first)
        of_names = [r.lang for r in names.orderBy("k").collect()]
        masks = sliced(held.join(F.broadcast(names), "lang").select("k", "gram"), len(of_names)).toArrow()
        planes = planes_of(len(of_names))
        planes[masks["plane"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy().view(np.uint64)
        several.append(Filters(of_names, planes))
    return several or [Filters.of({})]


def sliced(held: DataFrame, number: int = PASS) -> DataFrame:
    """plane, slot, mask of the filters that hold trigrams (k: a language's place below number, gram). Tasks set the bits and bit_or adds them up, so the
    driver sees masks, at most one for each slot of a plane, and no trigrams."""

    def cut(it):
        planes = planes_of(number)
        for batch in it:
            put(planes, batch["k"].to_numpy(), batch["gram"].to_numpy())
        plane, slot = np.nonzero(planes)
        mask = planes[plane, slot].view(np.int64)
        for i in range(0, len(plane), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in (plane, slot, mask)], ["plane", "slot", "mask"])

    return held.mapInArrow(cut, "plane long, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask"))


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def judged(docs: DataFrame, several: list[Filters]) -> DataFrame:
    """docs (with a column text) and lang_pred, score. All languages of one set of filters are judged where the texts are; of several
    sets, each gives its best language by row, and the best of these wins."""
    spark = docs.sparkSession
    if len(several) == 1:
        shared = spark.sparkContext.broadcast(several[0])

        def scan(it):
            for batch in common.batches(it, limit=CHUNK_BYTES):
                best, found, n, letters = shared.value.best(batch["text"])
                some = (letters > 0) & (len(shared.value.langs) > 0)
                lang = [shared.value.langs[b] if k else "und" for b, k in zip(best, some)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.where(some, score_of(found, n), 0.0))], [*batch.schema.names, "lang_pred", "score"])
            common.let_go()

        return docs.mapInArrow(scan, StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields]))
    rows = common.written(docs.select(F.struct("*").alias("row"), "text", F.monotonically_increasing_id().alias("rid")))
    every = None
    for filters in several:
        shared = spark.sparkContext.broadcast(filters)

        def scan_rows(it, shared=shared):
            for batch in common.batches(it, limit=CHUNK_BYTES):
                best, found, n, letters = shared.value.best(batch["text"])
                lang = pa.array([shared.value.langs[b] for b in best], pa.string())
                yield pa.RecordBatch.from_arrays([batch["rid"], lang, pa.array(found), pa.array(score_of(found, n)), pa.array(letters > 0)], ["rid", "lang", "found", "score", "some"])

        own = common.written(rows.select("rid", "text").mapInArrow(scan_rows, "rid long, lang string, found double, score double, some boolean"))
        every = own if every is None else every.unionByName(own)
    first = F.min(F.struct((-F.col("found")).alias("minus"), "lang", "score", "some")).alias("best")
    best = every.groupBy("rid").agg(first).select("rid", F.when(F.col("best.some"), F.col("best.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("best.some"), F.col("best.score")).otherwise(0.0).alias("score"))
    return rows.select("rid", "row").join(best, "rid").select("row.*", "lang_pred", "score")


def score_of(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, found / np.maximum(n, 1))


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rows of docs with a language that aren't held out."""
    rows = common.documents(docs, id_col, text_col, lang=F.col(lang_col).cast("string"))
    held = remainder(F.col("doc_id"), 4) == 2
    found = judged(rows.select("doc_id", "text"), learned(rows.where(~held & F.col("lang").isNotNull())))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language: not `und`, and with a score of LEAST_SCORE or more."""
    rows = common.documents(docs, lang=F.col("lang").cast("string"))
    train = rows.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    found = judged(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), learned(train))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")
