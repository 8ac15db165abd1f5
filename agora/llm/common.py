"""What several operators of the subpackage share: a place for intermediate tables, texts in bounded chunks, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator takes it: a longest run of characters other than ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
BLANKS = "\t\n\x0b\x0c\r "

#: Texts are worked on in chunks of about so many bytes, which bounds the memory of a Python worker.
CHUNK_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables in the folder that the cluster shares.

    The folder is ``spark.checkpoint.dir``; only where that is unset and Spark runs on this machine alone, as in tests, a
    temporary one is made.
    Tables lie below the application's id, so whatever a result still reads can be removed once the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="agora-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark = spark
        self.path = f"{root}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

    def folder(self, label: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{label}"

    def keep(self, frame: DataFrame, label: str) -> DataFrame:
        """Writes a table and reads it again: lineage ends here, and lost executors cost no earlier work."""
        path = self.folder(label)
        frame.write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        self._paths[kept] = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for frame in frames:
            self.remove(self._paths.pop(frame))

    def sweep(self) -> None:
        """Lets Spark remove the shuffle files of plans that are done: it does so when the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers wait for later stages beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text (none of a null)."""
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+")),
    )


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together; one longer text is a slice of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = texts_lengths(texts)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def texts_lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings end to end, and the n + 1 offsets of the texts in them (null: empty)."""
    import pyarrow.compute as pc

    joined = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, np.int64, len(joined) + 1, joined.offset * 8)
    body = np.frombuffer(data, np.uint8, int(at[-1])) if data is not None and at[-1] else np.zeros(0, np.uint8)
    return body[at[0] :], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and those of its inverse."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 100_000)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = have = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, the n + 1 offsets of the texts among the words, and each word's first byte in its text.

    Words of several texts are hashed at once: a polynomial in the bytes, by differences of its running sum.
    """
    body, at = text_bytes(texts)
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    inside = ~_BLANK[body]
    edge = np.zeros(n + 1, bool)  # words end where texts do
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[body] if lower else body] * up[:n], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    offsets = np.searchsorted(first, at).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(offsets))
    return hashes, offsets, first - at[owner]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash at each place where a run of ``width`` words begins, and the texts' offsets among the hashes.

    ``short``: a text with fewer words, but one at least, has its whole sequence as its only shingle.
    """
    counts = np.diff(offsets)
    out = np.maximum(counts - width + 1, 0)
    few = (counts > 0) & (counts < width) if short else np.zeros(len(counts), bool)
    out[few] = 1
    places = np.zeros(len(out) + 1, np.int64)
    np.cumsum(out, out=places[1:])
    if not places[-1]:
        return np.zeros(0, np.uint64), places
    owner = np.repeat(np.arange(len(out)), out)
    begin = offsets[owner] + (np.arange(places[-1]) - places[owner])
    have = np.minimum(width, offsets[owner + 1] - begin)
    total = have.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        part = padded[begin + k]
        if few.any():
            part = np.where(have > k, part, np.uint64(0))
        total = total * np.uint64(0x9FB21C651E98DF25) + part
    return mix(total), places
