"""Small helpers shared by the corpus operators.

Every operator selects the columns it needs before anything else, so further columns, whatever their names, never
reach it. Rows are documents: rows that repeat an id stay separate rows.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds at once, but for a single longer text.
CHUNK_BYTES = 2 << 20
#: The same where a byte takes some hundred of memory meanwhile; powers() of it fill 2 ** 20 places.
SMALL_CHUNK = (1 << 20) - 1
#: Bytes of rows that Spark sends to a Python task at once, in a session of the pipeline.
BATCH_BYTES = 4 << 20


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """`doc_id long, text string` and the further columns asked for, whatever else the input has."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(v.alias(k) for k, v in more.items())
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session (one machine, as in tests) sets one; a
    cluster, whose machines share no folder of their own, must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that written() made, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python tasks are cut by their bytes too, not by 10,000 rows alone, in this session from now on; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is None or not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def let_go() -> None:
    """Gives back what a task has used: its Python worker lives on beside other tasks'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batches(it: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text, or one row."""
    for batch in it:
        n, start = batch.num_rows, 0
        if not n:
            continue
        off = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64))])
        while start < n:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and where each starts (n + 1 offsets). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words_at(data: np.ndarray, off: np.ndarray, is_gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in flat(), and the number of words of each text. A word never crosses texts."""
    word = ~is_gap[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, off))


_MIX = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and their inverses."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _ODD))]).astype(np.uint64)
        _powers[1] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(pow(int(_ODD), -1, 1 << 64))))]).astype(np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of a 64-bit number over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span of data."""
    up, _ = powers(len(data) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum(_MIX[data] * up[: len(data)])])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes; equal bytes, equal hash, wherever they lie."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


#: DuckDB: the table of the checksum, as a common table expression `crc` of one row; crc_sql() needs it in FROM.
CRC_TABLE_SQL = """crc AS (
  SELECT list(list_reduce([i::BIGINT] || [0,0,0,0,0,0,0,0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) g(i)
)"""


def crc_sql(text: str) -> str:
    """DuckDB's text for the unsigned crc32 of an ASCII text."""
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295::BIGINT)"
