"""Benchmark decontamination: Wu-Manber search for every benchmark window in every whole text.

Texts are brought to one form: A-Z lower-cased, words joined and enclosed by single spaces. The patterns are the
benchmark's windows in that form, so an occurrence starts and ends at word borders. Patterns are put into length
classes. A class searches with the first m bytes of its patterns (m: its shortest one): a table over the hashes of all
blocks in those prefixes says how far a position can jump, and where it can't, the bucket of the suffix block gives the
patterns to compare. Many lanes of one buffer jump at the same time, which keeps the search vectorised.

The windows are made and told apart in tasks, and fall by their hash into groups of about `PATTERN_BYTES`. The search runs
where the documents are scanned: one group goes to the executors at a time, so what is broadcast has a fixed bound
whatever the size of the benchmark or of an item; a worker makes the tables of a group once. One group, which is the
rule, needs no shuffle at all; of several, the hits of each are written and joined to the documents by row.

Cases: a null or wordless text has no words and is clean; an item without words has no window; repeated rows and ids
are judged one by one; items with equal windows are all reported; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rallyframe.llm import common

NAME = "op10_wu_manber"

WINDOW = 13
PATTERN_BYTES = 16 << 20
LANES = 2048

_GAP = np.zeros(256, bool)
_GAP[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Stands between texts; it is no part of any word.
_WALL = 1


def canonical(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts in the form to search, each as ` w w w ` between walls; where its words start in the
    buffer; and the number of words of each text."""
    data = common.lower_ascii(data)
    start, end, count = common.words_at(data, off, _GAP)
    size = end - start
    doc = np.repeat(np.arange(len(count)), count)
    # A word takes its bytes and the space before it; a text adds a last space and a wall.
    at = np.cumsum(size + 1) - size + 2 * doc
    total = int(size.sum() + len(size) + 2 * len(count))
    out = np.full(total, 32, np.uint8)
    out[np.cumsum(np.bincount(doc, size + 1, len(count)).astype(np.int64) + 2) - 1] = _WALL
    out[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = data[~_GAP[data]]
    return out, at, count


class PatternClass:
    """Wu-Manber tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = sorted(set(patterns))
        self.m = min(map(len, self.patterns))
        self.b = min(8, self.m)
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8)
        sums = common.prefix_hash(heads)
        base = np.arange(len(self.patterns)) * self.m
        reach = self.m - self.b
        best: dict[int, int] = {}
        for j in range(reach + 1):  # the later the block, the shorter the jump
            for h in np.unique(common.span_hash(sums, base + j, base + j + self.b)):
                best[int(h)] = reach - j
        self.blocks = np.array(sorted(best), np.uint64)
        self.jumps = np.array([best[int(h)] for h in self.blocks], np.int64)
        # A small table answers for most positions: 0 for blocks that no pattern holds.
        self.bits = max(12, (4 * len(self.blocks) - 1).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.blocks >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.bucket = defaultdict(list)
        for p, h in zip(self.patterns, common.span_hash(sums, base, base + self.m)):
            self.bucket[int(h)].append(p)
        self.heads = np.array(sorted(self.bucket), np.uint64)

    def jump(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.m - self.b + 1, np.int64)
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        if len(maybe):
            k = np.searchsorted(self.blocks, h[maybe])
            k[k == len(self.blocks)] = 0
            out[maybe] = np.where(self.blocks[k] == h[maybe], self.jumps[k], out[maybe])
        return out

    def search(self, buffer: np.ndarray, sums: np.ndarray):
        """(start, pattern) of every occurrence."""
        n, m = len(buffer), self.m
        if n < m:
            return
        lanes = min(LANES, max(1, n // 256))
        edge = np.linspace(0, n - m + 1, lanes + 1).astype(np.int64)
        at, stop = edge[:-1].copy(), edge[1:]
        raw = buffer.tobytes()
        while True:
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
            if not len(at):
                return
            step = self.jump(common.span_hash(sums, at + m - self.b, at + m))
            zero = np.flatnonzero(step == 0)
            if len(zero):
                p = at[zero]
                h = common.span_hash(sums, p, p + m)
                k = np.searchsorted(self.heads, h)
                k[k == len(self.heads)] = 0
                same = self.heads[k] == h
                for i, x in zip(p[same].tolist(), h[same].tolist()):
                    for pattern in self.bucket[x]:
                        if raw.startswith(pattern, i):
                            yield i, pattern
                step[zero] = 1
            at = at + step


def windows(texts: list[tuple[object, str | None]]) -> dict[bytes, set[str]]:
    """Every window of the items, and the ids of the items that hold it."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        buffer, at, count = canonical(data, np.array([0, len(data)]))
        raw, n = buffer.tobytes(), int(count[0])
        for i in range(max(1, n - WINDOW + 1) if n else 0):
            last = min(i + WINDOW, n) - 1
            end = int(at[last + 1]) if last + 1 < n else len(raw) - 1
            found[raw[int(at[i]) - 1 : end]].add(str(item))
    return found


def pattern_classes(patterns: list[bytes]) -> list[PatternClass]:
    by = defaultdict(list)
    for p in patterns:
        by[min(6, len(p).bit_length())].append(p)
    return [PatternClass(x) for _, x in sorted(by.items())]


def search_texts(column: pa.Array, classes: list[PatternClass], owners: dict[bytes, set[str]]):
    """Of each text: its words, the runs of words that are hit (from, to, ...), and the items found."""
    buffer, at, count = canonical(*common.flat(column))
    first = np.concatenate([[0], np.cumsum(count)])
    sums = common.prefix_hash(buffer)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for c in classes:
        for i, pattern in c.search(buffer, sums):
            w = int(np.searchsorted(at, i + 1))
            doc = int(np.searchsorted(first, w, side="right")) - 1
            runs[doc].append((w - int(first[doc]), w - int(first[doc]) + pattern.count(b" ") - 1))
            items[doc] |= owners[pattern]
    return count, runs, items


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def distinct_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """pattern, items: every window, and the ids of the items that hold it."""

    def make(it):
        for batch in it:
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                found = list(windows([(item, text)]))
                for i in range(0, len(found), 10_000):
                    own = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([str(item)] * len(own), pa.string())], ["pattern", "item"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.mapInArrow(make, "pattern binary, item string").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


_ready: dict[int, tuple] = {}


def tables_of(shared) -> tuple[list[PatternClass], dict[bytes, set[str]]]:
    """The tables of a broadcast group, which a worker makes once; it holds one group's."""
    if shared.id not in _ready:
        _ready.clear()
        owners = {p: set(items) for p, items in shared.value}
        _ready[shared.id] = pattern_classes(list(owners)), owners
    return _ready[shared.id]


class Shared:
    """A broadcast with a number of its own."""

    def __init__(self, spark: SparkSession, rows: list):
        self.id, self.held = uuid.uuid4().int, spark.sparkContext.broadcast(rows)

    @property
    def value(self):
        return self.held.value


LISTS = {"runs": pa.list_(pa.int64()), "items": pa.list_(pa.string())}


def found_in(batch: pa.RecordBatch, text_col: str, shared: Shared) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and items of the texts of a batch."""
    n, runs, items = search_texts(batch[text_col], *tables_of(shared))
    flat_runs = [[x for r in union(runs.get(i, [])) for x in r] for i in range(len(n))]
    return pa.array(n.astype(np.int64)), pa.array(flat_runs, LISTS["runs"]), pa.array([sorted(items.get(i, ())) for i in range(len(n))], LISTS["items"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Every document with n_words, runs (flat list of hit word runs: from, to, ...) and items (sorted ids found).

    docs keeps all its columns but those three, which are added; id_col: the benchmark's."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "runs", "items")
    patterns = common.written(distinct_windows(benchmark, id_col, text_col))
    size = F.length("pattern") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x))
    total, most = patterns.agg(F.sum(size), F.count("*")).first()
    groups = max(1, min(most, -(-(total or 0) // pattern_bytes)))
    group = F.pmod(F.xxhash64("pattern"), F.lit(groups))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, runs array<long>, items array<string>").fields])
    if groups == 1:
        shared = Shared(spark, [tuple(r) for r in patterns.collect()])

        def scan(it):
            for batch in common.batches(it, text_col):
                yield pa.RecordBatch.from_arrays([*batch.columns, *found_in(batch, text_col, shared)], [*batch.schema.names, "n_words", *LISTS])
            common.let_go()

        return docs.mapInArrow(scan, schema)
    rows = common.written(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid")))
    hits = None
    for k in range(groups):
        shared = Shared(spark, [tuple(r) for r in patterns.where(group == k).collect()])

        def scan_rows(it, shared=shared, first=k == 0):
            for batch in common.batches(it, "text"):
                n, runs, items = found_in(batch, "text", shared)
                out = pa.RecordBatch.from_arrays([batch["rid"], n, runs, items], ["rid", "n_words", *LISTS])
                yield out if first else out.filter(pc.greater(pc.list_value_length(items), 0))

        own = common.written(rows.select("rid", "text").mapInArrow(scan_rows, "rid long, n_words long, runs array<long>, items array<string>"))
        shared.held.destroy()
        hits = own if hits is None else hits.unionByName(own)

    def unite(it):
        for batch in it:
            runs = [[x for r in union([p for o in own for p in zip(o[::2], o[1::2])]) for x in r] for own in batch["runs"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["n_words"], pa.array(runs, LISTS["runs"]), batch["items"]], ["rid", "n_words", *LISTS])

    whole = hits.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.mapInArrow(unite, "rid long, n_words long, runs array<long>, items array<string>")
    return rows.select("rid", "row").join(whole, "rid").select("row.*", "n_words", "runs", "items")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to what find() returns."""
    runs = F.col("runs")
    n_hit = F.coalesce(F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return found.withColumn("n_hit", n_hit).withColumns(
        {
            "n_items": F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", "items").cast("binary"), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(common.table(spark, sf_dir, "documents"))
    found = judged(find(docs, common.table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return judged(find(rows, common.table(spark, sf_dir, "benchmark"))).where(~F.col("contaminated")).select("row.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS k
  FROM b WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON n <= len(w)),
hits AS (SELECT r, i, g.n, item FROM grams g JOIN windows x ON x.n = g.n AND x.k = array_to_string(g.w[g.i:g.i + g.n - 1], ' ')),
words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
