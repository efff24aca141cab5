"""LM scoring with a hierarchical Pitman-Yor model of words.

The outcomes are those of the base score: the V words of the training texts (A-Z lower-cased; the end of a text is one),
and one unknown word. Each word, and the start of a text, is a context: a restaurant whose customers are all the training
tokens that follow it. A table sends one customer to the restaurant of no context, which all contexts share as parent, and
whose own tables draw from a base that gives UNKNOWN to the unknown word and the rest to the V words alike. Every pair of
words that occurs is there; nothing is left out by its count.

What is exchanged are arrays of numbers (sorted, as differences, in byte planes, compressed), not rows of words:

1. A task cuts its texts into groups of up to GROUP_BYTES and sends the distinct word hashes of each group, with their
   training counts, to parts of the vocabulary. A part adds the counts and answers with numbers for the words.
2. Each group sends its distinct pairs (context, word) and their training counts to parts by context; a context with more
   than SPLIT customers is dealt out over several parts. A part adds the counts, tells the groups the counts of their pairs,
   and tells the vocabulary in how many contexts each word has a table.
3. Gibbs sampling alternates between the levels. The vocabulary seats its customers (the tables below) and answers with each
   word's probability; every pair with two or more customers, in all parts at the same time, then reseats them SWEEPS
   times given the tables of its context, and sends its tables up. A single customer has a single table. Entries reseat
   their customers one after the other up to SEATED, and in their Poisson limit beyond. The seats of the sweeps after
   BURN are averaged, and so are the vocabulary's probabilities over its draws (all but the first), so the predictive
   probabilities are averages. Discounts follow the entries seen once and twice.
4. The parts answer the groups: tables of pairs and of contexts, and probabilities of words. Each group scores its texts;
   `perplexity` is 10 ** (-score / n_tokens).

The pairs of a context lie in parts of bounded size, there is a part for every PART_BYTES of text, and the driver sees one row of sums for each part and one number for each split context (customers / SPLIT of them at most).

Words are compared by 64-bit hash. Cases: a null or wordless text is the end alone; rows without an id are scored, but
not learned from and not held out; repeated rows and ids are texts of their own; without training texts every word is
the unknown one, with probability 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME, SQL = "op8_pitman_yor", None

STRENGTH = 1.0
UNKNOWN = 0.9
BURN, SWEEPS, ROUNDS = 2, 8, 2
EXACT, SEATED = 64, 256
#: Stands for all words that the training texts don't have.
NO_WORD = (1 << 32) - 1
#: Customers of a context in one part.
SPLIT = 1 << 20
GROUP_BYTES = 6 << 20
#: Text for each part of pairs: parts grow in number with the input, not in size.
PART_BYTES = 16 << 20

END_HASH = np.uint64(0x0E4D)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of each text in turn, its end included, and how many each text has."""
    data, off = common.flat(column)
    data = common.lower_ascii(data)
    start, end, count = common.words_at(data, off)
    h = common.span_hash(common.prefix_hash(data), start, end)
    out = np.full(len(h) + len(count), END_HASH)
    out[np.arange(len(h)) + np.repeat(np.arange(len(count)), count)] = h
    return out, count + 1


# Arrays as bytes


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed; the first bytes tell how many planes and numbers there are."""
    v = np.ascontiguousarray(values).astype("<u8")
    planes = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    raw = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return planes.to_bytes(1, "little") + len(v).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def restored(blob: bytes) -> np.ndarray:
    planes, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = _ZSTD.decompress(blob[9:], decompressed_size=planes * n, asbytes=True)
        out[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return out.view("<u8")[:, 0]


def rising(values: np.ndarray) -> bytes:
    """squeezed() numbers in ascending order."""
    v = values.astype(np.uint64)
    return squeezed(np.diff(v, prepend=np.uint64(0)))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(restored(blob), dtype=np.uint64)


def floats(values: np.ndarray) -> bytes:
    return squeezed(values.astype("<f4").view("<u4"))


def unfloat(blob: bytes) -> np.ndarray:
    return restored(blob).astype("<u4").view("<f4").astype(float)


# Rows of one shape: where they go, what they are, and up to four arrays

ROW = "part long, grp long, kind int, total long, a binary, b binary, c binary, d binary"
ROW_SCHEMA = pa.schema([("part", pa.int64()), ("grp", pa.int64()), ("kind", pa.int32()), ("total", pa.int64()), *((x, pa.binary()) for x in "abcd")])
TEXT, WORDS, VOCAB, IDS, PAIRS, COUNTS, HELD, ASKED, TYPES, SPLITS, CHANCES, ROOT, SEATS, EXTRA, WORD_P, PAIR_T = range(16)


def row(kind: int, part: int = 0, grp: int = 0, total: int = 0, **arrays: bytes) -> tuple:
    return part, grp, kind, total, *(arrays.get(x) for x in "abcd")


def batches_of(rows: Iterable[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r[4:] if x) + 100
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), ROW_SCHEMA)], schema=ROW_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), ROW_SCHEMA)], schema=ROW_SCHEMA)


def by_key(rows: DataFrame, key: str, work: Callable[[int, list[dict]], Iterable], parts: int, schema: str = ROW, batched: Callable = batches_of) -> DataFrame:
    """What work() gives for all rows of each key (in order of kind, then part, then grp)."""

    def run(it):
        def groups():
            own, last = [], None
            for batch in it:
                for r in batch.to_pylist():
                    if own and r[key] != last:
                        yield last, own
                        own = []
                    last = r[key]
                    own.append(r)
            if own:
                yield last, own

        yield from batched(x for k, own in groups() for x in work(k, own))

    return rows.repartition(parts, key).sortWithinPartitions(key, "kind", "part", "grp").mapInArrow(run, schema)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


# 1. Words


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def grouped_texts(docs: DataFrame, parts: int) -> DataFrame:
    """TEXT (places of the group's words, tokens of each text, ids, flags: 1 learned from, 2 held out, 4 no id) and WORDS (hashes,
    training counts) of each group. docs: doc_id, text, held_out, learn."""

    def rows(it):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def told():
            grp = (task << 24) + number
            h = np.concatenate([x[0] for x in held])
            count = np.concatenate([x[1] for x in held])
            flags = np.concatenate([x[3] for x in held])
            words, seq = np.unique(h, return_inverse=True)
            learned = np.repeat((flags & 1).astype(bool), count)
            n = np.bincount(seq[learned], minlength=len(words))
            yield row(TEXT, grp=grp, a=squeezed(seq), b=squeezed(count), c=squeezed(np.concatenate([x[2] for x in held]).view(np.uint64)), d=squeezed(flags))
            edge = np.searchsorted(word_part(words, parts), np.arange(parts + 1))
            for p, (x, y) in enumerate(zip(edge, edge[1:])):
                if x < y:
                    yield row(WORDS, part=p, grp=grp, a=rising(words[x:y]), b=squeezed(n[x:y]))

        for batch in common.batches(it):
            h, count = tokens(batch["text"])
            ids = batch["doc_id"]
            flags = np.asarray(batch["learn"]).astype(np.uint8) | np.asarray(batch["held_out"]).astype(np.uint8) << 1 | np.asarray(ids.is_null()).astype(np.uint8) << 2
            held.append((h, count, np.asarray(ids.fill_null(0)), flags))
            size += batch["text"].nbytes
            if size > GROUP_BYTES:
                yield from told()
                number, held, size = number + 1, [], 0
        if held:
            yield from told()

    return docs.select("doc_id", "text", "held_out", "learn").mapInArrow(lambda it: batches_of(rows(it)), ROW)


def numbered(part: int, rows: list[dict]) -> Iterator[tuple]:
    """Of a part's WORDS: VOCAB (words, known words and training tokens), and IDS (number in the part, count) for each group."""
    hashes = [risen(r["a"]) for r in rows]
    words, n = summed(np.concatenate(hashes), np.concatenate([restored(r["b"]) for r in rows]).astype(np.int64))
    yield row(VOCAB, part=part, total=len(words), a=squeezed(np.array([np.count_nonzero(n), n.sum()])))
    for r, h in zip(rows, hashes):
        at = np.searchsorted(words, h)
        yield row(IDS, part=part, grp=r["grp"], a=rising(at), b=squeezed(n[at]))


# 2. Pairs


class Group:
    """A group's texts with the numbers of their words. first: of each vocabulary part, the number of its first word."""

    def __init__(self, rows: list[dict], first: np.ndarray):
        text, ids = rows[0], [r for r in rows if r["kind"] == IDS]
        self.seq, self.count = restored(text["a"]).astype(np.int64), restored(text["b"]).astype(np.int64)
        self.doc_id, self.flags = restored(text["c"]).view(np.int64), restored(text["d"]).astype(np.uint8)
        self.ids = np.concatenate([risen(r["a"]).astype(np.int64) + first[r["part"]] for r in ids])
        self.n = np.concatenate([restored(r["b"]) for r in ids]).astype(np.int64)
        self.ends = np.cumsum(self.count)
        starts = self.ends - self.count
        self.c_word = self.n[self.seq]
        word = self.ids[self.seq]
        context = np.concatenate([[0], word[:-1]])
        context[starts] = first[-1]  # the start of a text has the number after the last word's
        self.c_context = np.concatenate([[0], self.c_word[:-1]])
        self.c_context[starts] = self.n[self.seq[self.ends - 1]]  # there are as many starts as ends
        self.known = self.c_context > 0
        word = np.where(self.c_word > 0, word, NO_WORD)
        self.key = context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)

    def pairs(self, parts: int, split: int) -> tuple[np.ndarray, ...]:
        """The distinct pairs with a known context, by part and key; their parts, training counts and whether their context is split;
        and the place of each such token's pair."""
        keys, one, place = np.unique(self.key[self.known], return_index=True, return_inverse=True)
        learned = np.repeat((self.flags & 1).astype(bool), self.count)[self.known]
        n = np.bincount(place[learned], minlength=len(keys))
        pieces = (1 + self.c_context[self.known][one] // split).astype(np.uint64)
        bucket = (keys & np.uint64(0xFFFFFFFF)) % pieces
        part = (common.mixed((keys >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + bucket) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return keys[order], part[order], n[order], pieces[order] > 1, back[place]


def pairs_of(first: np.ndarray, parts: int, split: int) -> Callable:
    """PAIRS (pairs, training counts, the contexts that are split) of a group for each part."""

    def work(grp: int, rows: list[dict]) -> Iterator[tuple]:
        keys, part, n, is_split, _ = Group(rows, first).pairs(parts, split)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
        for x, y in zip(edge, edge[1:]):
            yield row(PAIRS, part=int(part[x]), grp=grp, a=rising(keys[x:y]), b=squeezed(n[x:y]), c=rising(np.unique(keys[x:y][is_split[x:y]] >> np.uint64(32))))

    return work


def contexts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of sorted pairs, and the place of each pair's."""
    return np.unique(keys >> np.uint64(32), return_inverse=True)


def added(first: np.ndarray) -> Callable:
    """Of a part's PAIRS, for each group: COUNTS, and ASKED (places among the pairs held, and among the contexts). HELD: the pairs of
    two customers and more with their number, the contexts and their different words; total and grp: pairs seen once and
    twice. TYPES: for
    each vocabulary part the words, in how many contexts they are, which are in a pair held, and their training counts. SPLITS: the split
    contexts, their different words and their customers."""

    def work(part: int, rows: list[dict]) -> Iterator[tuple]:
        own = [risen(r["a"]) for r in rows]
        keys, n = summed(np.concatenate(own), np.concatenate([restored(r["b"]) for r in rows]).astype(np.int64))
        seen = n > 0
        many = n > 1
        held = np.cumsum(many) - 1
        contexts, ctx = contexts_of(keys)
        types = np.bincount(ctx[seen], minlength=len(contexts))
        for r, k in zip(rows, own):
            at = np.searchsorted(keys, k)
            yield row(COUNTS, part=part, grp=r["grp"], a=squeezed(n[at]))
            yield row(ASKED, part=part, grp=r["grp"], a=rising(held[at[many[at]]]), b=rising(np.unique(ctx[at])))
        yield row(HELD, part=part, grp=int((n == 2).sum()), total=int((n == 1).sum()), a=rising(keys[many]), b=squeezed(n[many]), c=rising(contexts), d=squeezed(types))
        split = np.unique(np.concatenate([risen(r["c"]) for r in rows]))
        if len(split):
            at = np.searchsorted(contexts, split)
            yield row(SPLITS, part=part, a=rising(split), b=squeezed(types[at]), c=squeezed(np.bincount(ctx, n, len(contexts)).astype(np.int64)[at]))
        words, where = np.unique(keys[seen] & np.uint64(0xFFFFFFFF), return_inverse=True)
        in_held = np.zeros(len(words), np.uint8)
        in_held[where[many[seen]]] = 1
        count, tokens_ = np.bincount(where, minlength=len(words)), np.bincount(where, n[seen], len(words)).astype(np.int64)
        edge = np.searchsorted(words, first.astype(np.uint64))
        for p, (x, y) in enumerate(zip(edge, edge[1:])):
            if x < y:
                yield row(TYPES, part=p, grp=part, total=int(count[x:y].sum()), a=rising(words[x:y] - np.uint64(first[p])), b=squeezed(count[x:y]), c=squeezed(in_held[x:y]), d=squeezed(tokens_[x:y]))

    return work


# 3. Seats


_stirling: dict[float, np.ndarray] = {}


def seatings(discount: float) -> np.ndarray:
    """log S[c, t]: the weights of all ways to seat c customers at t tables (generalised Stirling numbers), up to EXACT customers."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(EXACT + 1)
        for c in range(1, EXACT):
            stay = out[c] + np.log(np.maximum(c - discount * t, 1e-300))
            out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
        _stirling[discount] = out
    return _stirling[discount]


def seat(rng, c: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float) -> np.ndarray:
    """A Gibbs step: new numbers of tables of entries with c customers, given the parent's probabilities p of their dishes and the
    restaurants' other tables. Up to EXACT customers it is drawn from its distribution; beyond, customers come one after
    the other up to SEATED, and then in their Poisson limit."""
    t = np.minimum(c, 1).astype(float)
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for k, (x, y) in enumerate(zip(edge, edge[1:]), 2):
        for i in range(x, y, 100_000):
            at = order[i : min(y, i + 100_000)]
            log_p = np.cumsum(np.log(STRENGTH + discount * (others[at, None] + np.arange(k))) + np.log(p[at, None]), axis=1) + seatings(discount)[k, 1 : k + 1]
            upto = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (rng.random((len(at), 1)) * upto[:, -1:] > upto).sum(axis=1)
    live = order[edge[-1] :]
    for j in range(1, SEATED):
        live = live[c[live] > j]
        if not len(live):
            return t
        new = (STRENGTH + discount * (others[live] + t[live])) * p[live]
        t[live] += rng.random(len(live)) * (new + j - discount * t[live]) < new
    live = live[c[live] > SEATED]
    if len(live):
        weight = (STRENGTH + discount * (others[live] + t[live])) * p[live]
        rate = weight * np.log((c[live] - discount * t[live]) / (SEATED - discount * t[live]))
        t[live] += np.minimum(rng.poisson(np.minimum(rate, 1e9)), c[live] - SEATED)
    return t


class Root:
    """The restaurant of no context, as far as the driver sees it: v words, training tokens, customers, tables, and the discount."""

    def __init__(self, v: int, tokens: int, customers: float, discount: float):
        self.v, self.tokens, self.customers, self.tables, self.discount = v, tokens, customers, float(v), discount

    def chance(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The probability of known words with n customers at t tables."""
        return (n - self.discount * t + self.new() * (1 - UNKNOWN) / max(1, self.v)) / (STRENGTH + self.customers)

    def new(self) -> float:
        return STRENGTH + self.discount * self.tables


def customers_of(rows: list[dict], words: int) -> np.ndarray:
    """The customers of each word of a vocabulary part: contexts it is in, and the further tables there."""
    n = np.zeros(words)
    held = {}
    for r in rows:
        if r["kind"] == TYPES:
            at = risen(r["a"]).astype(np.int64)
            n[at] += restored(r["b"])
            held[r["grp"]] = at[restored(r["c"]).astype(bool)]
    for r in rows:
        if r["kind"] == EXTRA:
            n[held[r["grp"]]] += unfloat(r["a"])
    return n


def root_seats(root: Root, sizes: np.ndarray, sweep: int) -> Callable:
    """ROOT (customers, tables, and the sum over all draws but the first of the words' probabilities without what new tables give; total:
    tables) of a vocabulary part, and CHANCES: the probabilities of those words that each part of pairs holds."""

    def work(part: int, rows: list[dict]) -> Iterator[tuple]:
        n = customers_of(rows, sizes[part])
        rng = np.random.default_rng([sweep, part])
        base = np.full(len(n), (1 - UNKNOWN) / max(1, root.v))
        t = seat(rng, np.rint(n).astype(np.int64), base, np.full(len(n), max(0.0, root.tables - 1)), root.discount)
        t = np.where(n > 0, np.maximum(t, 1), 0)
        p, seated = root.chance(n, t), (n - root.discount * t) / (STRENGTH + root.customers)
        if not sweep:  # the pairs first meet the words' shares of the training tokens: near where sampling leads to
            p = (1 - UNKNOWN) / max(1, root.v) * STRENGTH * np.ones(len(n))
            for r in rows:
                if r["kind"] == TYPES:
                    p[risen(r["a"]).astype(np.int64)] += restored(r["d"])
            p /= STRENGTH + root.tokens
        before = next((unfloat(r["c"]) for r in rows if r["kind"] == ROOT), np.zeros(len(n)))
        yield row(ROOT, part=part, total=int(t.sum()), a=floats(n), b=squeezed(t), c=floats(before + seated * (sweep > 0)))
        for r in rows:
            if r["kind"] == TYPES:
                at = risen(r["a"]).astype(np.int64)
                yield row(CHANCES, part=r["grp"], grp=part, a=floats(p[at[restored(r["c"]).astype(bool)]]))

    return work


def expected_tables(c: float, discount: float) -> float:
    """Of c customers, whatever they eat."""
    grown = math.lgamma(STRENGTH + discount + c) - math.lgamma(STRENGTH + discount) - math.lgamma(STRENGTH + c) + math.lgamma(STRENGTH)
    return STRENGTH / discount * math.expm1(grown)


def pair_seats(discount: float, split: dict[int, float], customers: dict[int, float], first: np.ndarray, sweep: int, sweeps: int) -> Callable:
    """SEATS (mean tables of the pairs held, and of all contexts; total: thousandths of further tables), EXTRA (mean further tables of
    each word held, for each vocabulary part) and SPLITS (mean tables of the split contexts) of a part. It goes on from the SEATS of the
    round before. split: the tables of split contexts in all parts, as they were last; those of the other parts stay
    during a round."""

    def work(part: int, rows: list[dict]) -> Iterator[tuple]:
        held = next((r for r in rows if r["kind"] == HELD), None)
        if held is None:
            return
        keys, c = risen(held["a"]), restored(held["b"]).astype(np.int64)
        contexts, types = risen(held["c"]), restored(held["d"]).astype(float)
        word = keys & np.uint64(0xFFFFFFFF)
        words, where = np.unique(word, return_inverse=True)
        chances = [unfloat(r["a"]) for r in rows if r["kind"] == CHANCES]  # in order of the words
        p = np.concatenate(chances)[where] if len(words) else np.zeros(0)
        ctx = np.searchsorted(contexts, keys >> np.uint64(32))
        shared = np.array([split.get(int(x), -1.0) for x in contexts]) if split else np.full(len(contexts), -1.0)
        before = next((r for r in rows if r["kind"] == SEATS), None)
        t = np.clip(np.rint(unfloat(before["a"])), 1, c) if before else np.ones(len(keys))
        if before:
            away = shared - unfloat(before["b"])
        else:  # the tables that are expected of a split context, by where its customers are
            mine = types + np.bincount(ctx, c - 1, len(contexts))
            away = shared * (1 - mine / np.array([max(1.0, customers.get(int(x), 0.0)) for x in contexts]))
        away = np.where(shared >= 0, np.maximum(0, away), 0)
        rng, mean = np.random.default_rng([sweep, part, 1]), np.zeros(len(keys))
        for k in range(sweeps):
            total = away + types + np.bincount(ctx, t - 1, len(contexts))
            t = seat(rng, c, p, np.maximum(total[ctx] - t, 0), discount)
            mean += t * (k >= BURN) / (sweeps - BURN)
        tables = types + np.bincount(ctx, mean - 1, len(contexts))
        yield row(SEATS, part=part, total=int(1000 * (mean - 1).sum()), a=floats(mean), b=floats(tables))
        extra = np.bincount(where, mean - 1, len(words))
        edge = np.searchsorted(words, first.astype(np.uint64))
        for q, (x, y) in enumerate(zip(edge, edge[1:])):
            if x < y:
                yield row(EXTRA, part=q, grp=part, a=floats(extra[x:y]))
        if (shared >= 0).any():
            yield row(SPLITS, part=part, a=rising(contexts[shared >= 0]), b=floats(tables[shared >= 0]))

    return work


# 4. Scores


def word_answers(new: float, draws: int, v: int, sizes: np.ndarray) -> Callable:
    """WORD_P: the probabilities of each group's words, from ROOT (averaged over its draws) and IDS. new: the mean chance of a new table."""

    def work(part: int, rows: list[dict]) -> Iterator[tuple]:
        state = next((r for r in rows if r["kind"] == ROOT), None)
        n, p = (unfloat(state["a"]), unfloat(state["c"]) / draws) if state else (np.zeros(sizes[part]), 0.0)
        p = np.where(n > 0, p + new * (1 - UNKNOWN) / max(1, v), new * (UNKNOWN if v else 1.0))
        for r in rows:
            if r["kind"] == IDS:
                yield row(WORD_P, part=part, grp=r["grp"], a=floats(p[risen(r["a"]).astype(np.int64)]))

    return work


def pair_answers(part: int, rows: list[dict]) -> Iterator[tuple]:
    """PAIR_T: the tables of each group's pairs held, and of its contexts, from SEATS and ASKED."""
    seats = next(r for r in rows if r["kind"] == SEATS)
    pairs, contexts = unfloat(seats["a"]), unfloat(seats["b"])
    for r in rows:
        if r["kind"] == ASKED:
            yield row(PAIR_T, part=part, grp=r["grp"], a=floats(pairs[risen(r["a"]).astype(np.int64)]), b=floats(contexts[risen(r["b"]).astype(np.int64)]))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double, token_scores array<double>"


def group_scores(first: np.ndarray, parts: int, split: int, discount: float, shared: dict[int, float], with_tokens: bool) -> Callable:
    """SCORES of a group's texts."""

    def work(grp: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        g = Group(rows, first)
        keys, part, _, _, place = g.pairs(parts, split)
        take = lambda kind, column="a", how=unfloat: np.concatenate([how(r[column]) for r in rows if r["kind"] == kind] or [np.zeros(0)])
        p = take(WORD_P)[g.seq]
        c = take(COUNTS, how=restored).astype(float)
        t = np.minimum(c, 1)
        t[c > 1] = take(PAIR_T)
        # the contexts of each part in order, as the parts told them
        ctx = part.astype(np.uint64) << np.uint64(32) | keys >> np.uint64(32)
        own, where = np.unique(ctx, return_inverse=True)
        tables = take(PAIR_T, "b")
        if shared:
            known = np.array([shared.get(int(x), -1.0) for x in own & np.uint64(0xFFFFFFFF)])
            tables = np.where(known >= 0, known, tables)
        whole = STRENGTH + g.c_context
        weight, seen = np.ones(len(g.seq)), np.zeros(len(g.seq))
        weight[g.known] = (STRENGTH + discount * tables[where][place]) / whole[g.known]
        seen[g.known] = (c - discount * t)[place] / whole[g.known]
        log_p = np.log10(seen + weight * p)
        sums = lambda x: np.add.reduceat(x.astype(float), g.ends - g.count)
        values = [
            pa.array(g.doc_id, pa.int64(), mask=(g.flags & 4).astype(bool)), pa.array((g.flags & 2).astype(bool)), pa.array(g.count, pa.int64()),
            pa.array(sums(g.c_word > 0).round().astype(np.int64)), pa.array(sums(np.log10(g.c_word + 0.5))), pa.array(sums(log_p)),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], g.ends]) if with_tokens else np.zeros(len(g.ends) + 1), pa.int32()), pa.array(log_p if with_tokens else log_p[:0])),
        ]
        yield pa.RecordBatch.from_arrays(values, [x.split()[0] for x in SCORES.split(", ")])

    return work


def added_up(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> dict[int, float]:
    """The sums of numbers by context."""
    out: dict[int, float] = {}
    for contexts, tables in parts:
        for x, t in zip(contexts.tolist(), tables.tolist()):
            out[x] = out.get(x, 0.0) + t
    return out


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, rounds: int = ROUNDS, sweeps: int = SWEEPS, with_tokens: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, and on request token_scores, of every
    document; learned from those with an id that aren't held out."""
    spark = docs.sparkSession
    rows = common.documents(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    vocabularies = max(1, parts // 4)
    rows = rows.withColumn("learn", ~F.col("held_out") & F.col("doc_id").isNotNull())
    of = lambda table, *kinds: table.where(F.col("kind").isin(*kinds))

    texts = common.written(grouped_texts(rows, vocabularies), "none")
    words = common.written(by_key(of(texts, WORDS), "part", numbered, vocabularies), "none")
    sizes, v, n = np.zeros(vocabularies, np.int64), 0, 0
    for r in of(words, VOCAB).select("part", "total", "a").collect():
        known, tokens_ = restored(r.a).tolist()
        sizes[r.part], v, n = r.total, v + known, n + tokens_
    first = np.concatenate([[0], np.cumsum(sizes)])
    if first[-1] >= NO_WORD:
        raise ValueError(f"{first[-1]} different words")

    spoken = of(texts, TEXT).unionByName(of(words, IDS))
    told = common.written(by_key(by_key(spoken, "grp", pairs_of(first, parts, split), parts), "part", added(first), parts), "none")
    once, twice = (x or 0 for x in of(told, HELD).agg(F.sum("total"), F.sum("grp")).first())
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    splits = [(risen(r.a), restored(r.b), restored(r.c)) for r in of(told, SPLITS).select("a", "b", "c").collect()]
    customers = added_up((x, k) for x, _, k in splits)
    shared = {x: max(t, expected_tables(customers[x], discount)) for x, t in added_up((x, t) for x, t, _ in splits).items()}
    types = of(told, TYPES).agg(F.sum("total")).first()[0] or 0
    root = Root(v, n, float(types), discount)
    seats, new = None, []

    def draw(sweep: int, above: DataFrame | None) -> DataFrame:
        """The vocabulary's seats, given those of the pairs."""
        up = of(told, TYPES) if above is None else of(told, TYPES).unionByName(of(seats, EXTRA)).unionByName(of(above, ROOT))
        found = common.written(by_key(up, "part", root_seats(root, sizes, sweep), vocabularies), "none")
        root.tables = float(of(found, ROOT).agg(F.sum("total")).first()[0] or 0)
        if sweep:
            new.append(root.new() / (STRENGTH + root.customers))
        return found

    above = None
    for sweep in range(rounds):
        above = draw(sweep, above)
        below = of(told, HELD).unionByName(of(above, CHANCES))
        below = below if seats is None else below.unionByName(of(seats, SEATS))
        seats = common.written(by_key(below, "part", pair_seats(discount, shared, customers, first, sweep, sweeps), parts), "none")
        root.customers = types + (of(seats, SEATS).agg(F.sum("total")).first()[0] or 0) / 1000
        shared = added_up((risen(r.a), unfloat(r.b)) for r in of(seats, SPLITS).select("a", "b").collect())
    above = draw(rounds, above)
    chances = by_key(of(above, ROOT).unionByName(of(words, IDS)), "part", word_answers(float(np.mean(new)), rounds, v, sizes), vocabularies)
    tables = by_key(of(seats, SEATS).unionByName(of(told, ASKED)), "part", pair_answers, parts)
    every = spoken.unionByName(of(told, COUNTS)).unionByName(chances).unionByName(tables)
    found = by_key(every, "grp", group_scores(first, parts, split, discount, shared, with_tokens), parts, SCORES, lambda x: x)
    base = F.col("log_sum") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    out = found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).alias("train_tokens"), base.alias("base_score"), "score", perplexity.alias("perplexity"), "token_scores")
    return out if with_tokens else out.drop("token_scores")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scored(common.table(spark, sf_dir, "documents"), held_out)
