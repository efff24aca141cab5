import hashlib
import re

from rallyframe.llm import common, decontaminate
from tests.llm.oracle import same

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").encode().translate(LOW))


def brute(docs, items):
    sets = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            sets.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    sizes = sorted({len(k) for k in sets})
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := sets.get(tuple(w[i : i + n]))) is not None:
                    ids |= own
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(row):
    return tuple(str(x) for x in row)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Rare"), (3, None), (4, "..."), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"), (6, "ça été déjà vu")]
TEXTS = [None, "", "...", "rare", "a rare bird", "ONE two-three four, five six seven eight nine ten eleven twelve thirteen and on", "fourteen", "x " * 5000 + "ça été déjà vu" + " y" * 3, "rareness", "one two three four five six seven eight nine ten eleven twelve", "thirteen fourteen"]


def test_cases(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "rare"), (None, "rare")]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most in (decontaminate.PATTERN_BYTES, 20):
        found = decontaminate.judged(decontaminate.find(common.documents(df), bench, pattern_bytes=most))
        got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted(map(key, got)) == sorted(map(key, brute(docs, ITEMS)))
    assert decontaminate.judged(decontaminate.find(common.documents(df), bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.judged(decontaminate.find(common.documents(df.limit(0)), bench)).count() == 0


def test_stage_keeps_the_columns_of_the_input(spark, monkeypatch):
    columns = ["n_words", "runs", "items", "n_hit", "n_items", "contaminated", "row", "text_hash", "a.b"]
    docs = [(i, t, *range(len(columns))) for i, t in enumerate(TEXTS)] + [(None, "rare", *range(len(columns)))]
    df = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in columns))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(common, "table", lambda *_: bench)
    out = decontaminate.stage(spark, df, "")
    clean = [d for d, b in zip(docs, brute([d[:2] for d in docs], ITEMS)) if not b[5]]
    assert out.columns == df.columns and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, clean))


def test_table(spark):
    got = decontaminate.query(spark, "/root/testdata/sf0.01").collect()
    read = lambda t: [tuple(r) for r in common.table(spark, "/root/testdata/sf0.01", t).select(*((["doc_id"] if t == "documents" else ["item_id"]) + ["text"])).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(read("documents"), read("benchmark"))))
    assert any(r.contaminated for r in got)


def test_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert same(decontaminate.query(spark, f"/root/testdata/{sf}"), decontaminate.SQL, f"/root/testdata/{sf}") > 0
