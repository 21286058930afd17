"""Helpers shared by the operators: Arrow text buffers, digests, table reads, the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgrid.sources.files import dropped, scratch, temporary

#: Bytes of text that one vectorised step works on; bounds the memory of a Python worker.
BLOCK_BYTES = 1 << 20


#: Most rows and bytes of the Arrow batches between Spark and Python in the operators' own jobs; both sides hold a few of
#: them for each task.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lower the session's limits on Arrow batches to ours (lower ones stay) for the jobs inside."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in limits}
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for k, most in limits.items():
        if not 0 < as_bytes(before[k]) <= most:  # 64m, 67108864b or a plain number
            spark.conf.set(k, most)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Powers of multipliers of rolling hashes that a worker keeps: as many as a block has bytes.
_POWERS: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64; not to be written to."""
    held = _POWERS.get(of)
    if held is None or len(held) < n:
        held = np.full(n + -n % 65536, np.uint64(of))
        held[:1] = 1
        np.cumprod(held, dtype=np.uint64, out=held)
        held.flags.writeable = False
        if n <= 2 * BLOCK_BYTES:
            _POWERS[of] = held
    return held[:n]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: What operators keep in a Python worker from task to task: how to drop it.
LASTING: dict[str, Callable[[], None]] = {}
_kept = ""


def make_room(keep: str = "") -> None:
    """Drop what other operators left in this worker; ``keep`` names what the running one keeps itself."""
    global _kept
    if keep != _kept:
        _kept = keep
        for name, drop in LASTING.items():
            if name != keep:
                drop()
        gc.collect()
    # of the batches before
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_arrays(col, keep: str = "") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets into them; null counts as empty.  ``keep``: see make_room."""
    make_room(keep)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pc.fill_null(col, "").cast(pa.large_string())
    n, at = len(col), col.offset
    offsets = np.frombuffer(col.buffers()[1], np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return data[lo:hi], offsets - lo


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """(first row, row after the last) of runs of rows with about ``most`` bytes; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors cost no recomputation.  The table
    goes with drop_written(), or when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(temporary(spark, path))


def drop_written(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by written()."""
    for df in tables:
        if df is not None:
            for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                dropped(df.sparkSession, path)


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names: other columns can't clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
