"""What the operators share: tables, held-out folds, shared storage, words and their hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quill-"))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads survive the loss of any executor."""
    path = f"{shared_folder(df.sparkSession)}/quill/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table of stored() that no later plan reads."""
    path = getattr(df, "stored_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def fold(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def words(text: bytes) -> list[bytes]:
    """Lower-cased A-Z, words [^\\x20\\x09-\\x0D]+; exactly what bytes.lower and bytes.split do."""
    return text.lower().split()


class _Hashes(dict):
    """64-bit hashes of words; forgets all when full and keeps no long ones, so that a worker's memory stays bounded."""

    MOST = 400_000
    LONGEST = 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


SLICE_BYTES = 4 << 20  # of texts that a task looks at together


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most that many bytes of a column, or one row; no row is left out."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(b):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def _freed() -> None:
    """Gives back what a task held; an idle worker keeps its memory otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(function: Callable, column: str | None, most: int = SLICE_BYTES) -> Callable:
    """A function of batches that gets them in slices of bounded bytes of a column, and whose memory is given back."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(sliced(batches, column, most) if column else batches)
        finally:
            _freed()

    return run


_ODD = np.array([xxhash.xxh3_64_intdigest(b"position", seed=i) | 1 for i in range(64)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that all bits of a linear hash are usable."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hashes of the tokens at these offsets from every position where the last of them exists."""
    n = len(h) - max(offsets)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in offsets:
        out += h[i : i + n] * _ODD[i]
    return mixed(out)
