"""Token files: ids in canonical, length-limited Huffman code, in independent blocks with bit-offset checkpoints.

1. Each task encodes its own whole texts with a public tokenizer (special strings are ordinary text), appends the end
   id, and writes the ids, and its counts of them, to a table in the shared folder.
2. The counts of all tasks are added (one row for each id of the vocabulary) and give the code lengths (package-merge,
   at most `LIMIT` bits), which give the canonical code.
3. The ids are brought into ascending doc_id order by ranges, coded, and written in blocks.

A file is Parquet with a row for each block, in order: `part`, `block`, `first` (ids before it in its part), `doc_ids`
(8 bytes each; null ids come first, `n_null` of them), `doc_tokens` (4 bytes each), `checks` (4 bytes each: the bit at which every
`CHECK`-th id of a document starts) and `payload`. `codes` beside it has the length of each id's code. A block holds
whole documents, BLOCK ids or more but for the last of a part, so a block or, from a checkpoint on, any part of it can be
decoded alone. The decoder looks up `LIMIT` bits at a time in one table, for all checkpoints at once.

Cases: a null or empty text is the end id alone; rows that repeat an id are ordered by their number of ids, then by a hash
of them (equal rows are interchangeable); null ids come first; an empty table gives files without blocks, which read back as no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME, SQL = "op7_token_files", None

END_ID = 2
LIMIT = 18
BLOCK = 1 << 16
CHECK = 512
PART_IDS = 1 << 26
#: Pieces whose ids a worker keeps; it starts anew when they are as many.
KEPT_BITS = 21


class Seen:
    """A hash table from 64-bit keys (not 0) to numbers, in arrays: open addressing, at most half full."""

    def __init__(self, bits: int = KEPT_BITS):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct, and not there yet."""
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several keys the last one gets the slot
            own = self.keys[slot] == keys[left]
            self.values[slot[own]] = values[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & self.mask


#: The byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on.
_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start at the latest: cuts that the byte-level pre-tokenizer makes too, whatever stands around them. They are
    made before white space and after a letter that no letter follows; of several white spaces before something else
    the last one stands alone, or before it if it is a space. Texts with other white space than ASCII's stay whole."""
    n = len(data)
    space = common._SPACE[data]
    before = np.zeros(n, bool)  # the byte before ends a letter for sure
    before[1:] = _ALPHA[data[:-1]]
    two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))) + 2
    before[two[two < n]] = True
    cut = before & (data < 128) & ~_ALPHA[data]
    cut[1:] |= space[1:] & ~space[:-1]
    cut[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    cut[1:-1] |= space[1:-1] & space[:-2] & ~space[2:]
    first = off[:-1][np.diff(off) > 0]
    last = first[1:] - 1  # the last byte of a text is followed by no byte of it
    lone = last[space[last] & ~space[first[1:]]] if len(first) > 1 else last
    lone = lone[lone > 0]
    cut[lone] = space[lone] & ~space[lone - 1] | before[lone] & ~_ALPHA[data[lone]] & (data[lone] < 128)
    if ((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3)).any():
        for m in _WIDE_SPACE.finditer(data.tobytes()):
            doc = int(np.searchsorted(off, m.start(), side="right")) - 1
            cut[off[doc] : off[doc + 1]] = False
    cut[first] = True
    return np.flatnonzero(cut)


class Encoder:
    """ids of whole texts. With a byte-level pre-tokenizer texts are cut where it cuts them, and the ids of pieces, which the
    library's model gives, are kept by their 64-bit hash; with any other the library encodes whole texts."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = max(max(self.tokenizer.get_vocab().values()), end_id) + 1
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.end_id = end_id
        before = self.tokenizer.pre_tokenizer
        self.plain = self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        self.let_go()

    def let_go(self) -> None:
        """Forget all pieces; entry 0 is the end."""
        self.seen, self.pool, self.edge = Seen(), [np.array([self.end_id], self.type)], [0, 1]

    def ids_of(self, piece: str) -> list[int]:
        tokenize = self.tokenizer.model.tokenize
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and max(word) < "\u0250":  # one piece
            return [t.id for t in tokenize(piece.encode().decode("latin-1").translate(_CHARS))]
        return [t.id for own, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece) for t in tokenize(own)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and how many each text has."""
        if not self.plain:
            found = self.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)
            ids = [np.array([*x.ids, self.end_id], self.type) for x in found]
            return np.concatenate(ids), np.array([len(x) for x in ids])
        data, off = common.flat(column)
        start = cuts(data, off) if len(data) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(data))[: len(start)]
        h = common.span_hash(common.prefix_hash(data), start, end) | np.uint64(1)
        keys, one, piece = np.unique(h, return_index=True, return_inverse=True)
        if len(self.edge) + len(keys) > 1 << (KEPT_BITS - 1):
            self.let_go()
        entry = self.seen.find(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            made = [self.ids_of(raw[a:b].decode()) for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())]
            entry[new] = len(self.edge) - 1 + np.arange(len(new))
            self.seen.add(keys[new], entry[new])
            self.pool = [np.concatenate([*self.pool, np.fromiter(chain.from_iterable(made), self.type)])]
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum([len(x) for x in made])])
        pool, edge = self.pool[0], np.asarray(self.edge)
        pieces = np.diff(np.searchsorted(start, off))
        ends = np.cumsum(pieces + 1) - 1
        told = np.zeros(len(start) + len(pieces), np.int64)  # the end of each text is entry 0
        told[np.arange(len(start)) + np.repeat(np.arange(len(pieces)), pieces)] = entry[piece]
        size = edge[told + 1] - edge[told]
        upto = np.cumsum(size)
        ids = pool[np.repeat(edge[told] - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        return ids, np.diff(np.concatenate([[0], upto[ends]]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """A worker that goes on to code or decode encodes no more: its tokenizers and pieces go."""
    if _encoders:
        _encoders.clear()
        common.let_go()


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (0 where the count is 0), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    if n <= 1:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    level, leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf.append(order < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for is_leaf in reversed(leaf):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then by id, counting up."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    ends = np.cumsum(np.int64(1) << (63 - 1 - own)) if len(own) else own
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = ((ends - (np.int64(1) << (62 - own))) >> (62 - own)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """The id and the length for any next `limit` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.int64(1) << (limit - lengths[order].astype(np.int64))
    ids, size = np.repeat(order, span), np.repeat(lengths[order], span)
    rest = (1 << limit) - len(ids)  # only a code of a single id leaves values unused
    return np.concatenate([ids, np.zeros(rest, ids.dtype)]), np.concatenate([size, np.ones(rest, size.dtype)]).astype(np.int64)


def to_bits(ids: np.ndarray, count: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """The coded bits of each document (from a 32-bit border on) and the bit of each of its checkpoints, from its start."""
    size = lengths[ids].astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(count)
    first = last - count
    words = (sums[last] - sums[first] + 31) // 32
    base = np.concatenate([[0], np.cumsum(words)])
    at = sums[:-1] + np.repeat(32 * base[:-1] - sums[first], count)
    v = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    w, n = at >> 5, int(base[-1])
    out = np.bincount(w, (v >> np.uint64(32)).astype(np.float64), n + 1) + np.bincount(w + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[: n + 1]
    raw = out[:n].astype(">u4").tobytes()
    checks = (count + CHECK - 1) // CHECK
    k = np.repeat(first - CHECK * (np.cumsum(checks) - checks), checks) + CHECK * np.arange(int(checks.sum()))
    bit = (at[k] - np.repeat(32 * base[:-1], checks)).astype("<u4")
    edge = np.concatenate([[0], np.cumsum(checks)]).tolist()
    base = (4 * base).tolist()
    return [raw[a:b] for a, b in zip(base, base[1:])], [bit[a:b].tobytes() for a, b in zip(edge, edge[1:])]


def from_bits(payload: bytes, checks: np.ndarray, count: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The ids. checks: the bit of every checkpoint in payload; count: the ids from it up to the next."""
    ids, size = table
    data = np.frombuffer(payload + bytes(8), np.uint8)
    order = np.argsort(-count, kind="stable")  # lanes that go on longest come first
    at, left = checks[order].astype(np.int64), count[order]
    start = (np.cumsum(count) - count)[order]
    out = np.zeros(int(count.sum()), np.int64)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))
        p = at[:n]
        byte = p >> 3
        v = data[byte].astype(np.int64) << 24 | data[byte + 1].astype(np.int64) << 16 | data[byte + 2].astype(np.int64) << 8 | data[byte + 3]
        k = (v >> (32 - limit - (p & 7))) & ((1 << limit) - 1)
        out[start[:n] + step] = ids[k]
        at[:n] = p + size[k]
    return out


#: What the first pass writes: a row for each document, and one with the counts of all ids for each task.
IDS = "doc_id long, n long, ids binary, counts binary"
IDS_NAMES = ["doc_id", "n", "ids", "counts"]
CODED = ["doc_id", "n", "hash", "row", "checks", "bits"]
BLOCKS = "part int, block int, first long, doc_ids binary, n_null int, doc_tokens binary, checks binary, payload binary"


def written_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of docs below path."""
    spark = docs.sparkSession

    def tokenize(it):
        enc = encoder(tokenizer)
        counts = np.zeros(enc.size, np.int64)
        for batch in common.batches(it, limit=common.SMALL_CHUNK):
            ids, n = enc.encode(batch["text"])
            counts += np.bincount(ids, minlength=enc.size)
            at = np.concatenate([[0], np.cumsum(n)]) * enc.type.itemsize
            held = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), held.cast(pa.binary()), pa.nulls(len(n), pa.binary())], IDS_NAMES)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], IDS_NAMES)
        common.let_go()

    found = common.documents(docs, id_col, text_col).mapInArrow(tokenize, IDS).withColumns({"hash": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    table = common.written(found)
    ids, kind, size = table.where("ids IS NOT NULL").drop("counts"), encoder(tokenizer).type, encoder(tokenizer).size

    def count(it):
        own = np.zeros(size, np.int64)
        for batch in it:
            for x in batch["counts"].to_pylist():
                own += np.frombuffer(x, np.int64)
        k = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(own[k])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for i, n in table.select("counts").where("counts IS NOT NULL").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    lengths = code_lengths(counts)
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id long, bits int").coalesce(1).write.parquet(f"{path}/codes")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def code(it):
        lengths, codes = shared.value
        forget()
        for batch in common.batches(it, "ids", common.SMALL_CHUNK):
            data, off = common.flat(batch["ids"])
            n = np.diff(off) // kind.itemsize
            bits, checks = to_bits(np.frombuffer(data.tobytes(), kind).astype(np.int64), n, lengths, codes)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in CODED[:4]), pa.array(checks, pa.binary()), pa.array(bits, pa.binary())], CODED)
        common.let_go()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // PART_IDS)
    # Ranges are found by a first look at the rows, so the ids are coded after they have been brought into order. They are cut
    # by more than the id, so rows that share one (or have none) are spread.
    order = ["doc_id", "n", "hash", "row"]
    ordered = ids.repartitionByRange(parts, *order).mapInArrow(code, "doc_id long, n long, hash long, row long, checks binary, bits binary").sortWithinPartitions(*order)
    ordered.mapInArrow(packed, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    common.dropped(spark, table)


def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one part from its documents in order."""
    part = TaskContext.get().partitionId()
    first, block, rows, held = 0, 0, [], 0

    def out():
        ids, n, checks, bits = zip(*rows)
        base = np.concatenate([[0], np.cumsum([8 * len(b) for b in bits])])
        at = [np.frombuffer(c, "<u4") + np.uint32(b) for c, b in zip(checks, base)]
        nulls = sum(i is None for i in ids)
        values = [part, block, first, np.array([i or 0 for i in ids], "<i8").tobytes(), nulls, np.array(n, "<u4").tobytes(), np.concatenate(at).astype("<u4").tobytes(), b"".join(bits)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in BLOCKS.split(", ")])

    for batch in it:
        for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "checks", "bits"))):
            rows.append(row)
            held += row[1]
            if held >= BLOCK:
                yield out()
                first, block, rows, held = first + held, block + 1, [], 0
    if rows:
        yield out()
    rows.clear()
    common.let_go()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below path, decoded from them."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def totals(it):
        for batch in it:
            n = [int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for x in batch["doc_tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["part"], pa.array(n, pa.int64())], ["part", "n"])

    sums = blocks.select("part", "doc_tokens").mapInArrow(totals, "part int, n long").groupBy("part").agg(F.sum("n")).collect()
    before, total = {}, 0  # a number for each part
    for part, n in sorted(map(tuple, sums)):
        before[part], total = total, total + n
    codes = spark.read.schema("id long, bits int").parquet(f"{path}/codes").collect()
    lengths = np.zeros(max([i for i, _ in codes], default=0) + 1, np.uint8)
    for i, bits in codes:
        lengths[i] = bits
    shared = spark.sparkContext.broadcast((before, lengths))

    def decode(it):
        before, lengths = shared.value
        forget()
        table = decode_table(lengths)
        for batch in common.batches(it, "payload"):
            rows = batch.to_pylist()
            tokens = [np.frombuffer(r["doc_tokens"], "<u4").astype(np.int64) for r in rows]
            n = np.concatenate(tokens)
            lanes = (n + CHECK - 1) // CHECK
            count = np.full(int(lanes.sum()), CHECK)
            count[np.cumsum(lanes) - 1] = n - CHECK * (lanes - 1)
            base = np.cumsum([0] + [8 * len(r["payload"]) for r in rows])
            checks = np.concatenate([np.frombuffer(r["checks"], "<u4").astype(np.int64) + b for r, b in zip(rows, base)])
            ids = from_bits(b"".join(r["payload"] for r in rows), checks, count, table).astype("<u4").tobytes()
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
            start = np.concatenate([before[r["part"]] + r["first"] + np.cumsum(t) - t for r, t in zip(rows, tokens)])
            doc = np.concatenate([np.frombuffer(r["doc_ids"], "<i8") for r in rows])
            null = np.concatenate([np.arange(len(t)) < r["n_null"] for r, t in zip(rows, tokens)])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        common.let_go()

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files in the shared folder, and what is read back from them."""
    import public_tokenizers

    path = common.shared_dir(spark)
    written_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, common.table(spark, sf_dir, "documents"), sf_dir)
