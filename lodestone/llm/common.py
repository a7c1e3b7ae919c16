"""Shared plumbing: shared-folder tables, Arrow text buffers, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import itertools
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at once by the vectorised kernels; bounds a worker's memory.
SLICE_BYTES = 1 << 21

#: The ASCII white space that separates words: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes in an Arrow batch between the JVM and a Python worker; texts of any length keep to it, but for one row.
ARROW_BYTES = 12 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of every machine, once a context, and bound the batches they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    # A temporary file of the driver alone; the workers get its content through Spark.
    packed = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone_package.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(packed))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a local one if Spark itself is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        path = Path(tempfile.mkdtemp(prefix="lodestone-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    The folder stays until discard(), release() or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialised table that nothing reads any more."""
    _delete(getattr(df, "scratch_path", None))


def release() -> None:
    """Delete all scratch folders that this driver wrote; results that still read them must be consumed before."""
    for path in list(_written):
        _delete(path)


def _delete(path: str | None) -> None:
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):  # the context may be gone; a folder left over does no harm
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has, in any case."""
    used = {c.lower() for c in docs.columns}
    return [next(x for k in itertools.count() if (x := f"{n}_{k}").lower() not in used) for n in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (first, last) of whole texts of about `most` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


@lru_cache(maxsize=2)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U64(1)], np.full(n, _MULT, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[U64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 18
    while size < n:
        size *= 2
    return _power_table(size)


class Rolling:
    """Polynomial prefix hashes of a byte buffer; spans(a, b) hashes every [a, b) at once.

    Modulo 2^64, so for spans of a few hundred bytes only: Thue-Morse strings collide from 1,024 bytes on.  Longer or
    free spans take span_hashes.
    """

    def __init__(self, data: np.ndarray, byte_hash: np.ndarray = BYTE_HASH):
        up, self.down = powers(len(data) + 1)
        self.prefix = np.empty(len(data) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(byte_hash[data] * up[: len(data)], out=self.prefix[1:], dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


#: Spans longer than this are hashed one by one.
_LONG_SPAN = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return _TO_LOWER[data]


_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): eight bytes at a time, each step a bijection of the state, so that no
    family of strings collides by construction, as it does for polynomials modulo 2^64."""
    size = end - start
    out = mix64(size.astype(np.uint64) * _MULT + U64(0x51ED270B0A1F39C1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at = 0
    while len(live):
        left = size[live] - at
        chunk = eight[start[live] + at] & _KEEP[np.minimum(left, 8)]
        out[live] = mix64((out[live] ^ mix64(chunk + U64(at + 1))) * _MULT)
        live = live[left > 8]
        at += 8
    for k in np.flatnonzero(size > _LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of the texts in one slice: start, end (bytes), doc (text number), first (per text, into the words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        begins = inside & (~before | edge[:n])
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = inside & (~after | edge[1:])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)


#: Odd multipliers, one for each place in a window of words.
_PLACES = mix64(np.arange(11, 27, dtype=np.uint64)) | U64(1)


def windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start word) of each run of `width` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out += hashes[at + k] * _PLACES[k]
    return mix64(out), at


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i+1])."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
