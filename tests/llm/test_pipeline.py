from collections import Counter

import pyarrow as pa

import corpus_pipeline
from rallyframe.llm import common, mixing, token_files
from tests.llm import test_decontaminate, test_simhash, test_token_files
from tests.llm.oracle import connection

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SF))
        out[name] = before, docs
        if name != "token_files":
            assert docs.columns == before.columns
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]

    before, after = out["language"]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert not any(c.isalpha() for r in gone for c in r.text or "")

    before, after = out["near_duplicates"]
    first = {c for _, _, c in test_simhash.brute(pairs(before))}
    assert {str(r.doc_id) for r in after.collect()} == first and after.count() == len(first)

    before, after = out["decontaminate"]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r[0] for r in test_decontaminate.brute(pairs(before), bench) if not r[5]}
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < before.count()

    before, after = out["mix"]
    con = connection(SF)
    con.execute("DROP VIEW documents")
    rows = before.select("doc_id", "source").toPandas()
    con.register("rows", rows)
    con.execute("CREATE VIEW documents AS SELECT * FROM rows")
    want = Counter(x for (x,) in con.execute(f"WITH RECURSIVE {mixing.MIX_SQL} SELECT doc_id FROM mix").fetchall())
    assert Counter(r.doc_id for r in after.collect()) == want

    before, after = out["token_files"]
    assert test_token_files.rows(after) == test_token_files.brute(pairs(before))


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


CLASHING = ["mix", "row", "kept_id", "n_words", "runs", "items", "contaminated", "text_hash", "score", "lang_pred", "rid", "a.b"]


def planted(spark, tmp_path):
    """A folder of tables with a bit of everything that goes wrong."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    passage = bench.first().text
    some = docs.first()
    extra = [
        (None, None, None, None), (None, "", "en", "src1"), (9001, None, "en", None), (9002, " \n", None, ""), (9003, "12 345", "de", "src2"), (9004, some.text, some.lang, some.source),
        (9004, some.text, some.lang, some.source), (None, some.text, some.lang, "src3"), (9005, passage, "en", "src1"), (9006, "the house and the garden of the man " * 9000, "en", "src1"), (None, "the house and the garden of the woman and that of the child", "en", None), (9007, "a", "en", "src9"),
    ]
    rows = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows)
    for i, c in enumerate(CLASHING):
        every = every.withColumn(c, F.lit(i))
    every.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_planted_rows_go_through(spark, tmp_path):
    path = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, path))
        seen[name] = docs.select("doc_id", *(["text"] if "text" in docs.columns else [])).collect()
        if name != "token_files":
            assert docs.columns == columns
            assert docs.where(" OR ".join(f"`{c}` <> {i}" for i, c in enumerate(CLASHING))).count() == 0
    ids = lambda name: Counter(r.doc_id for r in seen[name])
    assert not {9001, 9002, 9003} & set(ids("language")) and ids("language")[9004] == 2
    texts = [r.text for r in seen["near_duplicates"]]
    assert len(set(texts)) == len(texts) and 9004 not in ids("near_duplicates") and None in ids("near_duplicates")
    assert 9005 in ids("near_duplicates") and 9005 not in ids("decontaminate") and 9006 in ids("decontaminate")
    assert set(ids("mix")) == set(ids("decontaminate")) and all(n >= ids("decontaminate")[i] for i, n in ids("mix").items())
    assert ids("token_files") == ids("mix")


def test_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_bound_the_bytes_of_a_batch(spark):
    """10,000 rows of 3,000 bytes come to a Python task in pieces once a stage has been planned; a lower bound of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")

    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        for own, most in ((None, 2 * common.BATCH_BYTES), (str(1 << 20), 2 << 20)):
            spark.conf.unset(key)
            if own:
                spark.conf.set(key, own)
            corpus_pipeline.STAGES[0][1](spark, docs, SF)
            texts = spark.range(10_000).coalesce(1).selectExpr("repeat('x', 3000) AS text")
            found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(found) >= 30_000_000 and max(found) <= most
    finally:
        spark.conf.unset(key)


def test_workers_that_decode_forget_their_tokenizers():
    import public_tokenizers

    token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.forget()
    assert not token_files._encoders
