import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from rallyframe.llm import common, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(docs):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for _, x in docs]
    out, start = [], 0
    for (d, _), i in sorted(zip(docs, ids), key=lambda r: (r[0][0] is not None, r[0][0] or 0, len(r[1]))):
        out.append((str(d), start, len(i), zlib.crc32(i.tobytes())))
        start += len(i)
    return sorted(out)


def rows(df):
    return sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in df.collect())


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b  \n", "don't  stop 's", "\x1c x \x1d", "   x", "é 　中文 \U0001f3be", "<|endoftext|> a<|endoftext|>", "12 345  6", "word " * 70_000, "-" * 3000, "tab\t x", "the. cat!! naïve, Straße&&& \xad x\xady ²x x² ǅ it's, l'eau. a.b ..c ＡＢ ,;: ɐ. THE!! %%% |"]


def test_cases(spark):
    docs = list(enumerate(TEXTS)) + [(4, "a b c"), (None, "null id"), (-7, "below zero"), (4, "a")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ids string")
    assert rows(token_files.stage(spark, df, "")) == brute(docs)
    assert rows(token_files.stage(spark, df.limit(0), "")) == []
    assert rows(token_files.stage(spark, df.where("doc_id = 0"), "")) == brute(docs[:1])


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 3, 300) * rng.integers(1, 1000, 300) ** 2
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    best = np.zeros(300, int)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        best[list(x + y)] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    free = token_files.code_lengths(counts, 30)
    assert (free * counts).sum() == (best * counts).sum()
    short = token_files.code_lengths(counts, 9)
    assert short.max() <= 9 and sum(2.0 ** -int(x) for x in short if x) <= 1
    ids = rng.choice(np.flatnonzero(counts), 5000)
    n = np.array([1, 1700, 0, 2048, 1251])
    bits, checks = token_files.to_bits(ids, n, short, token_files.canonical_codes(short))
    at, lanes, base = [], [], 0
    for k, b, c in zip(n, bits, checks):
        at += (np.frombuffer(c, "<u4") + 8 * base).tolist()
        lanes += [min(token_files.CHECK, k - i) for i in range(0, k, token_files.CHECK)]
        base += len(b)
    assert (token_files.from_bits(b"".join(bits), np.array(at), np.array(lanes), token_files.decode_table(short)) == ids).all()


def test_pieces_are_those_of_the_library():
    rng = random.Random(4)
    parts = ["a", "the", "s", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "'s", "'re", ".", ",", "1", "é", "ß", "×", "÷", "ª", "\xa0", "\x85", "\u3000", "\u2003", "中", "ж", "ɐ", "²", "\U0001f3be", "\xad", "<|endoftext|>", "Ω", "́", "_", "-"]
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    own = token_files.Encoder(PATH)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(100)] + [None, ""]
        ids, n = own.encode(pa.array(texts))
        want = [x.ids + [2] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_seen():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(1, 2**64, 600, dtype=np.uint64) | np.uint64(1) << np.uint64(63))
    seen = token_files.Seen(11)
    seen.add(keys[:500], np.arange(500))
    assert (seen.find(keys[:500]) == np.arange(500)).all() and (seen.find(keys[500:]) == -1).all()


def test_rows_of_one_id_are_spread(spark):
    df = spark.range(10_000).selectExpr("cast(null AS long) AS doc_id", "repeat(concat('word ', id), 1 + id % 20) AS text")
    path = common.shared_dir(spark)
    token_files.written_files(df, path, PATH)
    per_part = spark.read.parquet(f"{path}/blocks").selectExpr("part", "length(doc_ids) / 8 AS n").groupBy("part").sum("n").collect()
    assert len(per_part) == 8 and max(r[1] for r in per_part) < 3000
    assert rows(token_files.read_files(spark, path))[-1][0] == "None" and token_files.read_files(spark, path).count() == 10_000


def test_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    assert rows(token_files.query(spark, "/root/testdata/sf0.01")) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
