"""What several operators of this subpackage share: the shared folder, written intermediate tables, views of Arrow text
columns as bytes, and vectorised word splitting and hashing on those bytes."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows may be broadcast (labels: 12 bytes a row); beyond that they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Texts are handled inside a task in slices of about so many bytes, whatever the batch that Spark hands over.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session has to name; local sessions, as in tests, get a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/threadweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted up to there), else df as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so that no helper column can clash with them; name_of finds one of them."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def name_of(df: DataFrame, col: str) -> str:
    """The name that numbered gives to df's column col, in whatever case it is written."""
    return f"c{[c.lower() for c in df.columns].index(col.lower())}"


def text_of(col: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and UTF-8 bytes of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about `most` bytes of text, one row at least."""
    off, _ = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    tidy()


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... with n[i] numbers for each i."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def lookup(chars: bytes) -> np.ndarray:
    """A table of 256 flags, True for these bytes."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = lookup(b" \t\n\v\f\r")

_MIX = np.random.default_rng(20240229).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, by prefix sums: equal ranges have equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        up = powers(_BASE, n)
        self.down = powers(_BASE_INV, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_MIX[data] * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


#: Ranges of more bytes are hashed one by one.
LONG_WORD = 64
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Keyed 64-bit hashes of these byte ranges: eight bytes a step with a non-linear mix between, so that ranges of eight
    bytes at most and one length never collide; ranges of more than LONG_WORD bytes by keyed BLAKE2."""
    n = end - start
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    first, second = np.uint64(key[0]), np.uint64(key[1])
    h = mix(n.astype(np.uint64) + first)
    left, k = np.flatnonzero((n > 0) & (n <= LONG_WORD)), 0
    while len(left):
        h[left] = mix(h[left] ^ mix((eight[start[left] + k] & _HEAD[np.minimum(n[left] - k, 8)]) + second))
        k += 8
        left = left[n[left] > k]
    for i in np.flatnonzero(n > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=b"%016x%016x" % key)
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


def words(off: np.ndarray, data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, for each text, the index of its first word (one more at the end). is_word: 256 flags."""
    mask = is_word[data]
    inner = off[1:-1]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = inner[inner < len(data)]
    begins[inner] |= mask[inner]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    inner = inner[inner > 0]
    ends[inner - 1] |= mask[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def gram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, in order."""
    count = max(0, len(word_hash) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + word_hash[k : k + count]
    return mix(out + np.uint64(n))


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These words one after the other, a space after each, and where each begins there (one more at the end)."""
    n = end - start
    at = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(at[-1], 32, np.uint8)
    out[spread(at[:-1], n)] = data[spread(start, n)]
    return out, at


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """These ranges of UTF-8 bytes as an Arrow column."""
    n = end - start
    off = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[spread(start, n)])))
