"""Helpers shared by the operators of this package.

Text work inside tasks is vectorised over Arrow buffers: a record batch is cut into
slices of at most ``SLICE_BYTES`` of text, each slice is one numpy byte array with
document offsets, and words are found and hashed without a Python loop per word.
Hashes are 64-bit and the same on every machine (no use of Python's ``hash``).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testsieve.session import checkpoint_dir

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors once for each application (Spark's own file
    server hands it out), so that tasks can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` of a function that uses this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Bounds the bytes of the record batches of what runs inside, for rows that hold much."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """At the end of a task's work: what it has freed goes back to the system, as the worker
    lives on and shares its executor's memory with the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_garbage(spark: SparkSession) -> None:
    """After a step of many small queries: their plans and broadcast tables leave the driver's
    heap, which would grow to its limit before, and the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is run inside deletes its shuffle files as it ends; else they stay on the executors'
    disks until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(column: str, divisor: int):
    """crc32 of an id's decimal text modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of the word rules: 0x20 and 0x09-0x0D.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
WORD_CLASS = np.where(_WHITE, 0, 1).astype(np.uint8)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)  # grows with the slices that are met
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, np.uint64)
            q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            p[0] = q[0] = 1
            p, q = np.cumprod(p), np.cumprod(q)
        if size > 8 * SLICE_BYTES:  # one huge text: do not keep its tables
            return p, q
        _powers, _inverses = p, q
    return _powers[:n], _inverses[:n]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yield (first row, bytes, offsets) over runs of rows with about ``limit`` bytes of
    text; a longer text is a slice of its own. Null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    arr = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(arr)
    if n == 0:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def runs(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Start, end and document of every maximal run of bytes of one class (class 0 is
    skipped); runs do not cross documents."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    cls = classes[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    edge[1:n] |= cls[1:] != cls[:-1]
    full = cls != 0
    starts = np.flatnonzero(edge[:-1] & full)
    ends = np.flatnonzero(edge[1:] & full) + 1
    # empty documents repeat an offset; the last document with a given offset holds the bytes
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, docs


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, A-Z lower-cased."""
    n = len(data)
    powers, inverses = power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[LOWER[data]] * powers[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * inverses[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD_CLASS):
    starts, ends, docs = runs(data, offsets, classes)
    return span_hashes(data, starts, ends), docs


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hash columns."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
