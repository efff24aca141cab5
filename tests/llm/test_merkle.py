import hashlib
import random
import zlib

from pyspark.sql import functions as F

from rallyframe.llm import merkle
from tests.llm.oracle import same


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """The last node, and the (left, right) siblings of every leaf."""
    proofs, nodes = [[] for _ in leaves], [(d, [k]) for k, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for j, (_, own) in enumerate(run):
                for k in own:
                    proofs[k].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((h(*(d for d, _ in run)), [k for _, own in run for k in own]))
        nodes = above
    return nodes[0][0], proofs


def brute(rows, arity):
    groups = {}
    for key, order, digest in rows:
        groups.setdefault(key, []).append((order is not None, order or 0, digest))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    done = {k: tree([d for *_, d in sorted(groups[k])], arity) for k in keys}
    root, above = tree([done[k][0] for k in keys], arity)
    out = []
    for n, k in enumerate(keys):
        for (known, order, digest), proof in zip(sorted(groups[k]), done[k][1]):
            out.append((str(k), order if known else None, digest, done[k][0], root, tuple(proof + above[n])))
    return sorted(out, key=str)


def test_against_whole_trees(spark):
    rng = random.Random(5)
    for n, keys, arity, part, fan in ((1, 1, 2, 4, 2), (37, 3, 2, 4, 2), (300, 40, 2, 16, 4), (500, 2, 3, 20, 3), (400, 400, 2, 8, 2), (700, 1, 5, 50, 2)):
        names = [None, "", "-", *(f"k{i}é" for i in range(keys))][: keys + 2]
        rows = [(rng.choice(names), rng.choice([None, rng.randrange(-5, n), 2**63 - 1]), h(str(rng.randrange(max(2, n // 2))))) for _ in range(n)]
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], "`key` string, `ord` long, `hash` string, `block` int, `tree` int")
        got = merkle.manifest(df, "key", "ord", "hash", arity=arity, part=part, fan=fan)
        checked = got.withColumn("back", merkle.folded(F.col("hash"), F.col("left"), F.col("right"))).collect()
        assert all(r.back == r.root and (r.block, r.tree) == (1, 2) for r in checked)
        assert sorted(((str(r.key), r.ord, r.hash, r.subroot, r.root, tuple(zip(r.left, r.right))) for r in checked), key=str) == brute(rows, arity)


def test_fields(spark):
    df = spark.createDataFrame([(1, "é\n", None), (None, "", 2**63 - 1)], "a long, b string, c long")
    got = [r[0] for r in df.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [h("1:1", "3:é\n", "-"), h("-", "0:", "19:9223372036854775807")]


def test_tampered_documents(spark, tmp_path):
    docs = [(i, f"text {i}" * (1 if i else 100_000), ["en", None, "de", ""][i % 4], "s", None if i % 5 == 0 else i) for i in range(120)]
    docs += [docs[7], docs[7], (None, None, None, None, None), (10**15, "top", "zz", None, 2**63 - 1)]
    spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long, left int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = merkle.query(spark, str(tmp_path)).collect()
    changed = {i for i, *_, n in docs if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None}
    assert len(rows) == len(docs) and changed
    assert all(r.verified == (r.doc_id not in changed) == (r.folded_root == r.root) for r in rows)
    assert same(merkle.query(spark, str(tmp_path)), merkle.SQL, tmp_path) == len(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.query(spark, str(tmp_path)).collect() == []


def test_one_row(spark, tmp_path):
    spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = merkle.query(spark, str(tmp_path)).first()
    assert row.root == row.subroot == row.leaf and row.proof_sha256 == h()


def test_sql(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}"
        assert same(merkle.query(spark, path), merkle.SQL, path) >= 200
