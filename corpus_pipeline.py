"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing, token files.

Each stage takes what the one before kept, as a table, and applies its operator to all of it:

1. language: documents without a language go (`und`, or the best language explains too few trigrams).
2. near_duplicates: one document of each SimHash class stays, that with the smallest doc_id.
3. decontaminate: documents of which a twentieth or more of the words lie in benchmark windows go.
4. mix: documents are placed by the Pfair schedule of their sources, in small sources as often as the mix needs.
5. token_files: the documents are written as token files, and the digest read back from them is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm import common, decontaminate, language, mixing, simhash, token_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, with batches that are bounded by bytes: one session runs all stages, and executors keep what their largest batch took."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language", bounded(language.stage)),
    ("near_duplicates", bounded(simhash.stage)),
    ("decontaminate", bounded(decontaminate.stage)),
    ("mix", bounded(mixing.stage)),
    ("token_files", bounded(token_files.stage)),
]

#: Trigram filters, fingerprints and token ids can't be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again, and deleted once the
    next one is there (the last stage reads its own files)."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
        if last is not None:
            common.dropped(spark, last)
        last = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
