"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

1. Each task fingerprints its own whole texts (XXH64 of every shingle, a majority vote for each bit).
2. Documents with equal fingerprints become one node, with its least doc_id. A group of exact copies is one row from
   here on, whatever its size; the count is combined before the shuffle.
3. Nodes that differ in 3 bits at most agree on at least 3 of 6 blocks of bits, so they meet in one of 20 buckets.
   In a bucket a table holds the Hamming distances of its nodes to `PIVOTS` reference fingerprints. A bucket of more than
   `RUN` nodes is taken apart by the pivots: nodes whose distances to one differ by more than 3 are never compared; what
   no pivot takes apart is split by those bits that vary in it. Of the pairs that remain, those with any coordinate more
   than 3 apart are discarded (triangle inequality), and the survivors are verified. A bucket of more than `MOST` nodes
   is split over the cluster by further bits first, so no bucket is compared pair by pair and none is cut short.
4. A task gives a star for each component of its own links, never the pairs; the stars are merged over the cluster.

Cases: null, empty or wordless texts have fingerprint zero and are linked like any other; fewer than three words are one
shingle; repeated rows and ids are linked by their equal fingerprints; null ids don't count for the smallest id (a
component with no other has a null id); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rallyframe.llm import common, components

NAME, SQL = "op9_simhash", None

SEED = 42
SHINGLE = 3
MOST_BITS = 3
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, dtype=np.uint64)
RUN = 64
#: The width of a cell of distances to a pivot.
WIDTH = 4
BLOCKS = 6
#: Fingerprints with one key that are compared in one task.
MOST = 1 << 17


def fingerprint_texts(column: pa.Array) -> np.ndarray:
    data, off = common.flat(column)
    data = common.lower_ascii(data)
    start, end, count = common.words_at(data, off)
    size = end - start
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    joined[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = data[~common._SPACE[data]]
    raw = joined.tobytes()
    first = np.cumsum(count) - count
    n = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    lead = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    tail = lead + np.repeat(np.minimum(count, SHINGLE), n) - 1
    h = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(at[lead].tolist(), (at[tail] + size[tail]).tolist())), np.uint64, len(lead))
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > n[some, None], axis=1).view(">u8")[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and on request text_hash."""
    more = {"text_hash": F.xxhash64(F.col(text_col).cast("string"))} if hashed else {}
    own = ["doc_id", *more]

    def scan(it):
        for batch in common.batches(it, limit=common.SMALL_CHUNK):
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in own), pa.array(fingerprint_texts(batch["text"]))], [*own, "fp"])
        common.let_go()

    return common.documents(docs, id_col, text_col, **more).mapInArrow(scan, ", ".join(f"{k} long" for k in [*own, "fp"]))


def bucket_masks(blocks: int = BLOCKS, most: int = MOST_BITS) -> list[int]:
    """The bits on which two fingerprints with at most `most` differing bits may agree: all but `most` of the blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(parts, blocks - most)]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The Hamming distances of each fingerprint to all pivots."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near(a: np.ndarray, b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray) -> np.ndarray:
    """Which pairs differ in few bits: pivots first, then the survivors."""
    ok = np.flatnonzero(np.abs(table_a - table_b).max(axis=1) <= MOST_BITS)
    return ok[np.bitwise_count(a[ok] ^ b[ok]) <= MOST_BITS]


def link_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints whose keys are equal; sorted by key, and no fingerprint twice under a key."""
    us, vs = [fp[:0]], [fp[:0]]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    for a, n in zip(edge[:-1][size > RUN], size[size > RUN]):
        u, v = split_run(fp[a : a + n])
        us.append(u)
        vs.append(v)
    keep = np.repeat((size > 1) & (size <= RUN), size)
    key, fp = np.repeat(np.arange(len(size)), size)[keep], fp[keep]
    table = pivot_table(fp)
    for s in range(1, RUN):
        i = np.flatnonzero(key[s:] == key[:-s])
        if not len(i):
            break
        i = i[near(fp[i], fp[i + s], table[i], table[i + s])]
        us.append(fp[i])
        vs.append(fp[i + s])
    return np.concatenate(us), np.concatenate(vs)


def split_run(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one large run. By pivots: a linked pair's distances to a pivot differ by MOST_BITS at most, so in order of the
    distance the run falls into cells of WIDTH that reach MOST_BITS into the next one; the pivot is that whose largest cell
    is smallest. A run that no pivot takes apart is split by the values of a quarter of the bits that vary in it, for
    each quarter: a linked pair agrees on one of them."""
    table = pivot_table(fp)
    order = np.argsort(table, axis=0, kind="stable")
    ranked = np.take_along_axis(table, order, axis=0)
    best, cells = len(fp), []
    for j in range(len(PIVOTS)):
        d = ranked[:, j]
        low = np.arange(d[0], d[-1] + 1, WIDTH)
        a, b = np.searchsorted(d, low), np.searchsorted(d, low + WIDTH + MOST_BITS)
        if (b - a).max() < best:
            best, cells = int((b - a).max()), [order[x:y, j] for x, y in zip(a, b) if y - x > 1]
    if best <= 0.7 * len(fp):
        keyed = [(np.full(len(c), i), fp[c]) for i, c in enumerate(cells)]
        if not keyed:
            return fp[:0], fp[:0]
        return components.stars(*link_runs(np.concatenate([k for k, _ in keyed]), np.concatenate([x for _, x in keyed])))
    varying = int(np.bitwise_or.reduce(fp) & ~np.bitwise_and.reduce(fp))
    bits = [i for i in range(64) if varying >> i & 1]
    us, vs = [], []
    for q in range(MOST_BITS + 1):
        mask = np.uint64(sum(1 << i for i in bits[q :: MOST_BITS + 1]))
        key = fp & mask
        order = np.argsort(key, kind="stable")
        u, v = components.stars(*link_runs(key[order], fp[order]))
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def halved(mask: int) -> list[int]:
    """The mask with a quarter of its other bits more, for each quarter: a pair that differs in few bits agrees on one of them."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in rest[q :: MOST_BITS + 1]) for q in range(MOST_BITS + 1)]


def keyed_by(rows: DataFrame, masks: Column) -> DataFrame:
    """key, mask, fp: a row for each mask of a fingerprint."""
    keys = rows.select("fp", F.explode(masks).alias("mask"))
    return keys.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")


def links(nodes: DataFrame) -> DataFrame:
    """`u, v`: enough links between distinct fingerprints to connect all that are near. Keys with more than MOST fingerprints are
    taken apart by more bits, level by level, so what meets in one task is bounded."""
    masks, found = bucket_masks(), None
    keyed = keyed_by(nodes, F.array(*(F.lit(signed(m)) for m in masks)))
    while True:
        hot = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"))
        calm = keyed if hot.isEmpty() else keyed.join(hot, "key", "left_anti")
        own = calm.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")
        found = own if found is None else found.unionByName(own)
        if calm is keyed:
            return found
        further = F.create_map(*(x for m in masks for x in (F.lit(signed(m)), F.array(*(F.lit(signed(k)) for k in halved(m))))))
        keyed = common.written(keyed_by(keyed.join(hot, "key", "left_semi").withColumn("further", F.element_at(further, F.col("mask"))), F.col("further")))
        masks = sorted({k for m in masks for k in halved(m)})


def compare(it):
    """Links of rows sorted by key, as stars."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key, which may go on in the next batch
    for batch in it:
        key, fp = np.asarray(batch["key"]), np.asarray(batch["fp"])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1][0][-1] != key[-1]):
            held.append((key[:cut], fp[:cut]))
            yield from told(*map(np.concatenate, zip(*held)))
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield from told(*map(np.concatenate, zip(*held)))
    held.clear()
    common.let_go()


def told(key: np.ndarray, fp: np.ndarray):
    u, v = link_runs(key, fp.view(np.uint64))
    if len(u):
        u, v = components.stars(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of its class) of every document."""
    prints = common.written(fingerprints(docs, id_col, text_col))
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components.roots(links(nodes))
    rooted = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(joined.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    label = rooted.join(least, "root", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """none, id, text_hash of the row that each class keeps (none: its id is null), and whether any such row repeats."""
    prints = common.written(fingerprints(docs, hashed=True).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash", "fp"))
    nodes = common.written(prints.groupBy("fp").agg(F.min(F.struct("none", "id", "text_hash")).alias("first")))
    joined = components.roots(links(nodes))
    rooted = nodes.join(joined, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = common.written(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    return kept, prints.join(kept, ["none", "id", "text_hash"], "left_semi").count() > kept.count()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that with the smallest id, of rows that share it that with the least hash of its text, and of
    rows equal in both any one. A class of which no document has an id keeps one of its rows in the same way."""
    kept, repeated = kept_rows(docs)
    key = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row"), key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    out = rows.join(kept, ["none", "id", "text_hash"], "left_semi")
    if repeated:  # by another key than the join's, so that AQE may still split a row repeated very often
        out = out.select("row", F.xxhash64("none", "id", "text_hash").alias("k"), F.col("text_hash").alias("h")).dropDuplicates(["k", "h"])
    return out.select("row.*")
