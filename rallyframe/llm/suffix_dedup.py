"""Exact substring dedup: removes every byte covered by a WINDOW-byte string that also starts anywhere else.

A distributed merge sort of suffixes that knows common prefixes, over a sparse but exact set of suffixes:

1. Every SHORT-byte string has an anchor that depends on its bytes alone: the leftmost of its GRAM-byte strings with the
   least hash; a WINDOW-byte string has the anchor of its first SHORT bytes. Equal strings have their anchors at the same
   place, so strings need only be compared with those of the same anchor string. An anchor stands for a run of window
   starts; the bytes of all their windows are its piece.
2. Hashes only choose what is compared. Anchors that occur once are left out; a bitmap of fixed size (BITMAP bits, exact
   counts behind it) does so before anything is shuffled. Of the pieces with equal hashes two, the least and the greatest
   by place, are sent. Pieces that follow each other in the same two texts, and in no other form anywhere, are sent as
   one long string, so of exact copies two texts are compared and no more.
3. Each task sorts the suffixes that start at its anchors, and the reversed texts before the anchors, into runs, and
   sends them front-coded: the length of the prefix shared with the string before, and the rest.
4. The task that gets an anchor merges its runs with a loser tree. Each string carries the length of the prefix it shares
   with the last one given out, so known prefixes are never compared again; the merge yields the sorted order and the
   prefix lengths of neighbours. Two windows of L bytes that start o bytes before their anchors are equal if they are in
   one group of suffixes that share L - o bytes, and in one group of reversed texts that share o bytes.
5. An anchor with more than MOST different pieces (a passage in very many surroundings) is split: the windows with
   offsets in the lower and in the upper half of its range share more bytes than the anchor, and those bytes are a
   longer anchor. This goes on, level by level, until no anchor has as many, so what meets in one task is bounded.
6. What the merge found for a piece goes to all places with its hashes, by a join that AQE can split, and the runs of a text
   are joined to it. What is shuffled are hashes, the texts, and the strings of step 3.

Besides the WINDOW-byte strings, the same merge tells passages: strings of SHORT bytes or more that occur in another
document too, and of these the ones of more than PASSAGE_WORDS words.

Cases: a null text is empty; texts shorter than WINDOW keep all bytes; matches inside one text count, overlapping ones
too (for passages they don't); rows that repeat are copies of each other, and each is returned (equal id and text: one
document as to passages); an empty table gives no rows. Pieces whose anchors' and own 64-bit hashes agree get the verdict
of the two that were compared.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME, SQL = "op1_suffix_runs", None

WINDOW, SHORT = 400, 256
GRAM = 48
PASSAGE_WORDS = 50
#: Bytes of strings that a task sorts into one set of runs, and that a merging task gets on average.
RUN_BYTES = 8 << 20
#: Different pieces of an anchor that are compared in one task.
MOST = 1 << 14
BITMAP = 1 << 26
#: Enough for a buffer of 4 GB, and an Arrow column of texts holds 2 GB at most.
PLACE_BITS = 32
#: A place is at << 22 | (at - lo) << 11 | (at - hi), a span window << 22 | near << 11 | far: the offsets of an anchor's windows
#: (window 0: of both sizes, else of one).
FIELD = 11
LOW = (1 << FIELD) - 1


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(v)
    wide = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = v
    blocks = wide.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(sums: np.ndarray, off: np.ndarray, window: int = SHORT, gram: int = GRAM) -> dict[str, np.ndarray]:
    """doc, at (anchor), lo, hi (first and last window start; all three from the text's start), key (hash of the anchor)."""
    size = np.diff(off)
    starts = np.maximum(size - window + 1, 0)
    if not starts.sum():
        return {k: np.zeros(0, np.int64) for k in ("doc", "at", "lo", "hi", "key")}
    place = np.arange(len(sums) - gram)
    h = common.span_hash(sums, place, place + gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((h & ~mask) | place.astype(np.uint64), window - gram + 1)
    doc = np.repeat(np.arange(len(size)), starts)
    start = np.repeat(off[:-1] - np.cumsum(starts) + starts, starts) + np.arange(int(starts.sum()))
    at = (least[start] & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    lo, hi, at, doc = start[first], start[last], at[first], doc[first]
    base = off[doc]
    return {"doc": doc, "at": at - base, "lo": lo - base, "hi": hi - base, "key": h[at].view(np.int64)}


def placed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return at << 2 * FIELD | (at - lo) << FIELD | (at - hi)


def shared_prefix(x: bytes, y: bytes, known: int) -> int:
    n = min(len(x), len(y))
    differ = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Of sorted strings: the prefix shared with the one before, the rests, and the rests' lengths."""
    known = [0] + [shared_prefix(a, b, 0) for a, b in zip(strings, strings[1:])]
    rest = [s[k:] for s, k in zip(strings, known)]
    return np.array(known, "<u4"), b"".join(rest), np.array([len(r) for r in rest], "<u4")


def decoded(known: np.ndarray, rest: bytes, lengths: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(known.tolist(), lengths.tolist()):
        last = last[:k] + rest[at : at + n]
        at += n
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs (strings, prefix shared with the one before): the places (run, index) in order and the
    prefix that each string shares with the one before it in that order."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    known = [r[1] for r in runs] + [[]] * (k - len(runs))
    index = [0] * k
    head = [s[0] if s else None for s in strings]
    prefix = [0] * k  # shared with the string given out last

    def beats(a: int, b: int) -> bool:
        x, y = head[a], head[b]
        if x is None or y is None:
            return y is None
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        n = shared_prefix(x, y, prefix[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            prefix[b] = n
            return True
        prefix[a] = n
        return False

    losers = [0] * k
    row = list(range(k))
    level = k
    while level > 1:  # the first round
        level //= 2
        for i in range(level):
            a, b = row[2 * i], row[2 * i + 1]
            if not beats(a, b):
                a, b = b, a
            losers[level + i] = b
            row[i] = a
    winner = row[0]
    order, shared = [], []
    while head[winner] is not None:
        order.append((winner, index[winner]))
        shared.append(prefix[winner])
        i = index[winner] = index[winner] + 1
        if i < len(strings[winner]):
            head[winner], prefix[winner] = strings[winner][i], known[winner][i]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2
    return order, shared


RUNS = "part int, n int, places binary, pieces binary, after_order binary, after_known binary, after_rest binary, after_size binary, before_order binary, before_known binary, before_rest binary, before_size binary"
_NAMES = [c.split()[0] for c in RUNS.split(", ")]
#: What goes with each string: a number for its document, its piece and where it lies, and whether it speaks for its piece. A
#: string of several pieces has window CHAIN, and key and place of each behind the number `more`.
PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("piece", "<i8"), ("near", "<i4"), ("far", "<i4"), ("reach", "<i4"), ("window", "<i4"), ("first", "?"), ("more", "<i4")])
CHAIN = 3


def sorted_runs(part: int, entries: list[tuple[tuple, bytes, bytes, bytes]]) -> pa.RecordBatch:
    """A row with the two front-coded runs of (place, suffix, reversed text before, further pieces)."""
    values = [part, len(entries), np.array([e[0] for e in entries], PLACE).tobytes(), b"".join(e[3] for e in entries)]
    for which in (1, 2):
        order = sorted(range(len(entries)), key=lambda i: entries[i][which])
        known, rest, size = front_coded([entries[i][which] for i in order])
        values += [np.array(order, "<u4").tobytes(), known.tobytes(), rest, size.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < 2 else pa.binary()) for i, v in enumerate(values)], _NAMES)


def merge_side(rows: list[dict], side: str, base: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Over all runs of one side: the number of each entry in order, and the shared prefixes."""
    runs, orders = [], []
    for r, b in zip(rows, base):
        known = np.frombuffer(r[f"{side}_known"], "<u4")
        runs.append((decoded(known, r[f"{side}_rest"], np.frombuffer(r[f"{side}_size"], "<u4")), known.tolist()))
        orders.append((np.frombuffer(r[f"{side}_order"], "<u4").astype(np.int64) + b).tolist())
    order, shared = merged(runs)
    return np.array([orders[a][i] for a, i in order], np.int64), np.array(shared, np.int64)


def repeated_windows(place: np.ndarray, after: tuple, before: tuple, window: int, across: bool) -> list[tuple[int, int, int]]:
    """(entry, from, to): runs of offsets whose windows occur in another entry too; across: in one of another document."""
    n = len(place)
    near, far = np.maximum(place["near"], window - place["reach"]), place["far"]
    out: list[tuple[int, int, int]] = []
    if not (near <= far).any():
        return out
    since = np.full(n, -1)
    a_group, b_group = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(near.min()), int(far.max()) + 2):
        live = np.flatnonzero((near <= o) & (o <= far))
        a_group[after[0]] = np.cumsum(after[1] < 8 + window - o)
        b_group[before[0]] = np.cumsum(before[1] < 8 + o)
        key = a_group[live] * (n + 1) + b_group[live]
        order = np.lexsort((place["doc"][live], key)) if across else np.argsort(key, kind="stable")
        edge = np.concatenate([[0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1, [len(live)]])[: len(live) + 1]
        twice = np.diff(edge) > 1
        if across:
            doc = place["doc"][live][order]
            twice &= doc[edge[:-1]] != doc[edge[1:] - 1]
        now = np.zeros(n, bool)
        now[live[order[np.repeat(twice, np.diff(edge))]]] = True
        for i in np.flatnonzero((since >= 0) & ~now):
            out.append((int(i), int(since[i]), o - 1))
            since[i] = -1
        since[now & (since < 0)] = o
    return out


FOUND = "doc_id long, text_hash long, place long, key long, piece long, span int"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
#: window 1: the offsets from near to far of WINDOW bytes occur elsewhere; 2: those of SHORT bytes occur in another document.
REPEATED = "key long, piece long, window int, near int, far int"


def anchored(docs: DataFrame) -> DataFrame:
    """FOUND: every anchor of every text whose anchor string may occur elsewhere too."""

    def find(it):
        for batch in common.batches(it):
            data, off = common.flat(batch["text"])
            sums = common.prefix_hash(data)
            a = anchors(sums, off)
            doc = a["doc"]
            end = np.minimum(a["hi"] + WINDOW, np.diff(off)[doc])
            piece = common.span_hash(sums, off[doc] + a["lo"], off[doc] + end).view(np.int64)
            own = [batch[c].take(pa.array(doc)) for c in ("doc_id", "text_hash")]
            span = np.full(len(doc), SHORT - GRAM, np.int32)
            yield pa.RecordBatch.from_arrays([*own, pa.array(placed(a["at"], a["lo"], a["hi"])), pa.array(a["key"]), pa.array(piece), pa.array(span)], FOUND_NAMES)

    every = common.written(docs.mapInArrow(find, FOUND))
    slot = F.col("key").bitwiseAND(BITMAP - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    words = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").groupBy(F.shiftright(slot, 6).alias("k")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits = np.zeros(BITMAP // 64, np.int64)
    bits[words["k"].to_numpy()] = words["b"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def repeated(it):
        for batch in it:
            at = np.asarray(batch["key"]) & (BITMAP - 1)
            there = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(there.astype(bool)))

    out = common.written(every.mapInArrow(repeated, FOUND))
    common.dropped(docs.sparkSession, every)
    return out


def split(docs: DataFrame, found: DataFrame) -> DataFrame:
    """FOUND: the anchors of found (of keys with too many pieces) with half the offsets each and longer anchor strings."""

    def halves(it):
        for batch in common.batches(it):
            out = []
            for text, doc_id, text_hash, rows in zip(*(batch[c].to_pylist() for c in ("text", "doc_id", "text_hash", "rows"))):
                data = np.frombuffer(text.encode(), np.uint8)
                sums = common.prefix_hash(data)
                for r in rows:
                    at, near, far = r["place"] >> 2 * FIELD, r["place"] & LOW, r["place"] >> FIELD & LOW
                    window, a, b = r["span"] >> 2 * FIELD, r["span"] >> FIELD & LOW, r["span"] & LOW
                    for w, size in ((1, WINDOW), (2, SHORT)):
                        if window and w != window:
                            continue
                        last = len(data) - size  # the last window start
                        for lo, hi in ((a, (a + b) // 2), ((a + b) // 2 + 1, b)):
                            x, y = max(lo, near, at - last), min(hi, far)
                            if x <= y:
                                out.append((doc_id, text_hash, at, x, y, size, lo, hi, w, r["key"]))
                if out:
                    ids, hashes, at, x, y, size, lo, hi, w, key = zip(*out)
                    at, x, y, size, lo, hi, w = (np.array(v, np.int64) for v in (at, x, y, size, lo, hi, w))
                    salt = np.array(key, np.int64).view(np.uint64) + (w << 2 * FIELD | lo << FIELD | hi).astype(np.uint64)
                    longer = common.mixed(common.span_hash(sums, at - lo, at - hi + size) + common.mixed(salt))
                    piece = common.span_hash(sums, at - y, at - x + size)
                    span = (w << 2 * FIELD | lo << FIELD | hi).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(placed(at, at - y, at - x)), pa.array(longer.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(span)], FOUND_NAMES)
                    out = []

    rows = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "place", "span")).alias("rows"))
    return common.written(with_rows(docs, rows).mapInArrow(halves, FOUND))


def with_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, rows of the documents that have any; equal ones once for each place that they have in docs."""
    same = docs["doc_id"].eqNullSafe(rows["doc_id"]) & (docs["text_hash"] == rows["text_hash"])
    return docs.join(rows, same).select(docs["doc_id"], docs["text_hash"], "text", "rows")


def to_compare(found: DataFrame) -> DataFrame:
    """Of the keys that occur more than once: every piece with its number, the places a and b of two of it, and how many
    pieces its key has."""
    who = F.struct("doc_id", "text_hash", "place")
    classes = common.written(found.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(who).alias("a"), F.max(who).alias("b"), F.min("span").alias("span")))
    keys = common.written(classes.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("pieces")).where("total > 1").select("key", "pieces"))
    out = common.written(classes.join(keys, "key"))  # of two tables, so that AQE can split it by hot keys
    common.dropped(found.sparkSession, classes)
    return out


def strings(classes: DataFrame) -> DataFrame:
    """doc_id, text_hash, rows: the strings that are to be sent of each text. Pieces that are alone with their key are chained."""
    one = classes.where((F.col("pieces") > 1) & (F.col("pieces") <= MOST))
    single = lambda who, first: one.where("n > 1" if who == "b" else "true").select(f"{who}.doc_id", f"{who}.text_hash", F.struct(F.col("key").alias("chain"), "key", "piece", f"{who}.place", F.shiftright("span", 2 * FIELD).alias("window"), F.lit(first).alias("first"), F.lit(None).cast("binary").alias("pieces"), F.lit(0).alias("size")).alias("r"))

    def chained(it):
        for batch in it:
            out = []
            for pair in batch.to_pylist():
                members = sorted((m["a"], m["b"], m["key"], m["piece"], m["window"]) for m in pair["members"])
                held = [members[0]]
                for m in [*members[1:], None]:
                    last = held[-1]
                    if m and m[4] == last[4] == 0 and m[1] - m[0] == last[1] - last[0] and (m[0] >> 2 * FIELD) - (m[0] >> FIELD & LOW) <= (last[0] >> 2 * FIELD) - (last[0] & LOW) + 1 + SHORT:
                        held.append(m)
                        continue
                    raw = np.array([(k, p, w, a) for a, _, k, p, w in held], np.int64).tobytes()
                    size = held[-1][0] - held[0][0] >> 2 * FIELD
                    for side in (0, 1):
                        own = {"chain": held[0][2], "key": held[0][2], "piece": held[0][3], "place": held[0][side], "window": CHAIN, "first": not side, "pieces": raw, "size": size}
                        out.append((pair[f"{'ab'[side]}_id"], pair[f"{'ab'[side]}_hash"], own))
                    held = [m]
            ids, hashes, own = zip(*out)
            kind = pa.struct([("chain", pa.int64()), ("key", pa.int64()), ("piece", pa.int64()), ("place", pa.int64()), ("window", pa.int32()), ("first", pa.bool_()), ("pieces", pa.binary()), ("size", pa.int32())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(own, kind)], ["doc_id", "text_hash", "r"])

    member = F.struct(F.col("a.place").alias("a"), F.col("b.place").alias("b"), "key", "piece", F.shiftright("span", 2 * FIELD).alias("window"))
    pairs = classes.where("pieces = 1").groupBy(F.col("a.doc_id").alias("a_id"), F.col("a.text_hash").alias("a_hash"), F.col("b.doc_id").alias("b_id"), F.col("b.text_hash").alias("b_hash"))
    chains = pairs.agg(F.collect_list(member).alias("members")).mapInArrow(chained, "doc_id long, text_hash long, r struct<chain:long,key:long,piece:long,place:long,window:int,first:boolean,pieces:binary,size:int>")
    both = single("a", True).unionByName(single("b", False)).unionByName(chains)
    return both.groupBy("doc_id", "text_hash").agg(F.collect_list("r").alias("rows"))


def compared_pieces(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """REPEATED: what of each piece occurs elsewhere, by merging front-coded runs."""
    spark = docs.sparkSession
    rows = common.written(strings(classes))
    total = rows.agg(F.sum(F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["size"] + 2 * WINDOW))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // RUN_BYTES)

    def send(it):
        held, size, number = {}, 0, None
        for batch in common.batches(it):
            for row in batch.to_pylist():
                if number == (number := hash((row["doc_id"], row["text_hash"]))):
                    continue  # an equal row; these follow each other
                text = row["text"].encode()
                for r in row["rows"]:
                    key = (r["chain"] & (2**64 - 1)).to_bytes(8, "big")
                    at, far, near = r["place"] >> 2 * FIELD, r["place"] >> FIELD & LOW, r["place"] & LOW
                    if r["window"] == CHAIN:
                        *_, only, last = np.frombuffer(r["pieces"], np.int64).tolist()
                        lo, end = at - far, min(at + r["size"] - (last & LOW) + (SHORT if only == 2 else WINDOW), len(text))
                        after, before, more = text[lo:end], b"", r["pieces"] if r["first"] else b""
                    else:
                        after, before, more = text[at : at - near + (SHORT if r["window"] == 2 else WINDOW)], text[at - far : at][::-1], b""
                    place = (number, r["key"], r["piece"], near, far, len(after), r["window"], r["first"], len(more) // 32)
                    held.setdefault(int.from_bytes(key, "big") % parts, []).append((place, key + after, key + before, more))
                    size += len(after) + len(before) + 200
                    if size > RUN_BYTES:
                        for part, entries in sorted(held.items()):
                            yield sorted_runs(part, entries)
                        held, size = {}, 0
        for part, entries in sorted(held.items()):
            yield sorted_runs(part, entries)

    def merge(it):
        part, rows = None, []
        for batch in it:
            for row in batch.to_pylist():
                if row["part"] != part and rows:
                    yield compared(rows)
                    rows = []
                part = row["part"]
                rows.append(row)
        if rows:
            yield compared(rows)

    sent = with_rows(docs, rows).mapInArrow(send, RUNS)
    return common.written(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, REPEATED))


def compared(rows: list[dict]) -> pa.RecordBatch:
    """REPEATED from all runs of a part."""
    base = np.cumsum([0] + [r["n"] for r in rows])[:-1].tolist()
    place = np.concatenate([np.frombuffer(r["places"], PLACE) for r in rows])
    after, before = merge_side(rows, "after", base), merge_side(rows, "before", base)
    chains = place["window"] == CHAIN
    out = []
    for window, size in ((1, WINDOW), (2, SHORT)):
        mine = ~chains & ((place["window"] == 0) | (place["window"] == window))
        if mine.any():
            number = np.cumsum(mine) - 1
            some = [(number[order[mine[order]]], least_between(shared, mine[order])) for order, shared in (after, before)]
            own = place[mine]
            found = [(i, x, y) for i, x, y in repeated_windows(own, *some, size, window == 2) if own["first"][i]]
            out += [(int(own["key"][i]), int(own["piece"][i]), window, x, y) for i, x, y in found]
    # the two strings of a chain follow each other if they are equal: they start with the same 8 bytes, as no others do
    order, shared = after
    pieces = np.frombuffer(b"".join(r["pieces"] for r in rows), np.int64).reshape(-1, 4)
    edge = np.concatenate([[0], np.cumsum(place["more"])])
    for k in np.flatnonzero(chains[order[1:]] & chains[order[:-1]] & (shared[1:] >= 8)):
        x, y = order[k], order[k + 1]
        equal = shared[k + 1] >= 8 + max(place["reach"][x], place["reach"][y])
        if place["key"][x] != place["key"][y] or not equal:
            continue
        i = x if place["first"][x] else y
        own = pieces[edge[i] : edge[i + 1]]
        other = place["doc"][x] != place["doc"][y]
        start = int(own[0, 3] >> 2 * FIELD) - int(own[0, 3] >> FIELD & LOW)
        end = place["reach"][i]
        for key, piece, only, p in own.tolist():
            at, far, near = (p >> 2 * FIELD) - start, p >> FIELD & LOW, p & LOW
            if only != 2 and max(near, at + WINDOW - end) <= far:
                out.append((key, piece, 1, max(near, at + WINDOW - end), far))
            if only != 1 and other:
                out.append((key, piece, 2, near, far))
    columns = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(columns)], [c.split()[0] for c in REPEATED.split(", ")])


def least_between(shared: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Prefixes shared with the last of mine, from those shared with the string before."""
    if mine.all():
        return shared
    at = np.flatnonzero(mine)
    return np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))


def removed_spans(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, text_hash. doc_id, text_hash, window, lo, hi: spans of bytes that occur elsewhere (they may overlap)."""
    found, spans = anchored(docs), None
    while True:
        classes = to_compare(found)
        repeated = compared_pieces(docs, classes)
        # a table of its own, so that AQE can split the join by hot pieces
        at = F.shiftright("place", 2 * FIELD)
        end = at - F.col("near") + F.when(F.col("window") == 1, WINDOW).otherwise(SHORT)
        own = common.written(found.join(repeated, ["key", "piece"]).select("doc_id", "text_hash", "window", (at - F.col("far")).alias("lo"), end.alias("hi")))
        spans = own if spans is None else spans.unionByName(own)
        hot = classes.where(F.col("pieces") > MOST).select("key").distinct()
        if hot.isEmpty():
            return spans
        found = split(docs, found.join(hot, "key", "left_semi"))


def union(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty), text_hash, removed (flat list of disjoint byte runs: from, to, ...), passages (likewise: what other
    documents have too, runs of more than PASSAGE_WORDS words), n_bytes, n_removed, n_spans, kept_sha256, n_passage_words of every
    row; kept() gives the bytes that are left."""
    rows = common.documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    spans = removed_spans(rows).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("window", "lo", "hi")).alias("spans"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["text_hash"] == spans["text_hash"]), "left").select(rows["doc_id"], "text", "spans")
    names = [c.split()[0] for c in CUT.split(", ")]

    def cut(it):
        for batch in common.batches(it):
            out = []
            data, off = common.flat(batch["text"])
            raw = data.tobytes()
            for spans, a, b in zip(batch["spans"].to_pylist(), off.tolist(), off[1:].tolist()):
                text = raw[a:b]
                runs, shown = (union([(s["lo"], s["hi"]) for s in spans or () if s["window"] == w]) for w in (1, 2))
                words = [(x, y, whole_words(text, x, y)) for x, y in shown]
                left = b"".join(kept(text, list(chain.from_iterable(runs))))
                passages = [(x, y, n) for x, y, n in words if n > PASSAGE_WORDS]
                out.append((b - a, b - a - len(left), len(runs), hashlib.sha256(left).hexdigest(), list(chain.from_iterable(runs)), [v for x, y, _ in passages for v in (x, y)], sum(n for *_, n in passages)))
            n, gone, many, digest, removed, passages, words = zip(*out)
            list_ = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(removed, list_), pa.array(passages, list_), pa.array(n), pa.array(gone), pa.array(many), pa.array(digest), pa.array(words)], names)

    return joined.mapInArrow(cut, CUT)


CUT = "doc_id long, text string, removed array<long>, passages array<long>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def whole_words(text: bytes, lo: int, hi: int) -> int:
    """The words that lie in text[lo:hi] as a whole."""
    n = len(text[lo:hi].split())
    gap = b" \t\n\x0b\x0c\r"
    n -= lo > 0 and text[lo] not in gap and text[lo - 1] not in gap
    return max(0, n - (hi < len(text) and text[hi] not in gap and text[hi - 1] not in gap))


def kept(text: bytes, removed: list[int]) -> list[bytes]:
    """The runs of bytes that are left."""
    edge = [0, *removed, len(text)]
    return [text[a:b] for a, b in zip(edge[::2], edge[1::2])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
