"""Helpers shared by the training-data operators.

Partition keys, shared storage and the byte-packed exchange live here so that every operator
uses the same rules:

* intermediate tables go to the folder named in ``spark.checkpoint.dir`` (all executors and the
  driver see it); a temporary folder is set only where that setting is empty, as in tests;
* large families of small fixed-width records (n-gram counts, signatures, postings) are packed
  into one binary cell per destination before they are shuffled, so the JVM moves a few large
  rows instead of many tiny ones.  Destinations are hash ranges, so their sizes are even.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch sent to Python.  Texts may be long, so batches are kept short.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts short: bounds the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Bytes of input that one partition of a packed exchange stands for, and the most partitions.
PART_BYTES, MOST_PARTS = 64 << 20, 32_768


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions of a packed exchange: the session's number, and more where the files that ``df`` reads
    need them, as a task holds its partition's records in memory."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    if df is None:
        return n
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of files; unknown sizes come as 2^63
    return max(n, min(MOST_PARTS, -(-size // PART_BYTES))) if size < 1 << 62 else n


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="repolens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, *partition_by: str, alone: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and the rows
    survive the loss of any executor.  The shuffle files of the written query go with its end; with
    ``alone``, so do all tables stored before in this session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/repolens-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    if alone:
        cleanup(spark)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a table that may be broadcast after its rows were counted.
BROADCAST = 32 << 20


def lookup_table(df: DataFrame, array: str | None = None, element_bytes: int = 24, row_bytes: int = 32) -> DataFrame:
    """``df`` as a written table, to be joined with whole texts: with a broadcast hint if its counted
    rows (and the elements of its column ``array``) stay within ``BROADCAST`` bytes, so that texts
    aren't shuffled; else without one.  Both ways give the same rows."""
    table = stored(df)
    elements = F.sum(F.size(array)) if array else F.lit(0)
    rows, more = table.agg(F.count("*"), elements).first()
    return F.broadcast(table) if rows * row_bytes + (more or 0) * element_bytes <= BROADCAST else table


def unused_name(name: str, columns: list[str]) -> str:
    """``name``, or with marks behind it if a column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_stored: dict[str, list[str]] = {}


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that operators have stored in this session; results that still read them
    must have been written before."""
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``stored`` whose rows have been read for the last time."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give freed memory back to the system (where the C library can): Python workers are used again by
    later stages, and what one of them needed at its peak isn't kept by all."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def heaps_released(spark: SparkSession) -> None:
    """Give the executors' free heap back to the system, by one collection in each task slot: a heap that
    has grown to its limit in one stage would lie beside the next stage's Python workers."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Note that this worker holds a memory of ``owner`` between tasks, and how it is given up."""
    _kept[owner] = clear


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives up what other owners' tasks kept in the worker, and
    releases its own memory at the end."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [k for k in _kept if k != owner]
        for other in others:
            _kept.pop(other)()
        if others:
            release()
        yield from run(batches)
        release()

    return body


def crc_bucket(column: str, m: int):
    """crc32 of the value written as text, modulo ``m``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def deal(df: DataFrame, n: int | None = None, column: str = "bucket") -> DataFrame:
    """Send each row to the shuffle partition that ``column`` (0 .. n-1) names."""
    return df.repartitionById(n or partitions(df.sparkSession), F.col(column))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 with A-Z in lower case: ``bytes.lower`` touches A-Z only
    and ``bytes.split`` cuts at exactly 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def byte_hashes(words: list[bytes], cache: dict[bytes, int], limit: int = 400_000) -> np.ndarray:
    """64-bit hashes of UTF-8 words, remembered between calls up to ``limit`` words."""
    import xxhash

    if len(cache) > limit:
        cache.clear()
    n = len(words)
    try:
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)
    except KeyError:
        digest = xxhash.xxh3_64_intdigest
        for w in set(words):
            if w not in cache:
                cache[w] = digest(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the non-empty buckets 0..n-1 of ``keys``."""
    order = np.argsort(keys, kind="stable")
    ends = np.searchsorted(keys[order], np.arange(n + 1))
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def range_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Even hash ranges: the bucket 0..n-1 of each 64-bit hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def batches_of(make: Callable[[], Iterator[dict]], schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterator of column dictionaries (lists or arrays)."""
    for cols in make():
        n = len(next(iter(cols.values())))
        for at in range(0, n, rows):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name][at : at + rows], type=f.type) for f in schema], schema=schema)


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns (name = type)."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in columns.items())).fields])
