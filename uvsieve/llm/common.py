"""Helpers that the text operators share: checkpoints, Arrow text access, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at a time.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, only the named columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master is local (as in tests) a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared checkpoint folder and read back, and where it stands."""
    cut(df.limit(0))  # sees to it that there is a folder
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``written_at`` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of a number's decimal text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor)).cast("int")


def texts(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one large_string array without nulls (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array, and where each text starts (and the last ends)."""
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of a batch's rows with about ``size`` bytes of text each (a longer text stands alone)."""
    column_texts = texts(batch.column(column))
    ends = utf8(column_texts)[1]
    at, n = 0, len(column_texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), column_texts.slice(at, to - at)
        at = to


def by_slice(f: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES):
    """A mapInArrow function that applies ``f`` to each slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, column_texts in slices(batch, column, size):
                yield f(rows, column_texts)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (xor-shift and multiply rounds)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def sorted_groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys starts."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each run, one run after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
