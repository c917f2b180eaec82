"""Token-ID output: concatenated id arrays with Elias-Fano document boundaries.

File format (one record per block, kept as a row of a Parquet table so that any store Spark can
reach will do): ``ids`` is the concatenation of the documents' ids, fixed width (2 bytes while the
vocabulary has at most 65,536 ids, else 4), little-endian.  ``bounds`` is the Elias-Fano code of
the documents' end offsets within the block, ``docs`` that of the ascending doc_ids.  Blocks carry
(shard, block); ascending (shard, block) is ascending doc_id.  An offset in the whole corpus is the
block's base (a sum over blocks before it) plus a select on ``bounds``: no 64-bit table of offsets
exists anywhere.

Elias-Fano: each value's low ``l = floor(log2(universe / n))`` bits are packed; the high parts are
a unary bit vector of n ones and at most 2n bits in all, so a value costs about 2 + l bits.
``select(i)`` finds the i-th one from a sampled position (every 256th one is sampled).

Defined cases: null text is the empty text (its ids are the end id alone); a null doc_id sorts
first and comes back null; repeated doc_ids keep all their rows, equal ids ordered by content; an
empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import deal, lean, partitions, small_batches, stored
from .encoder import default_path, encoder

#: Ids of a block: bounds what a reader or writer holds.
BLOCK_IDS = 1 << 20
#: Ones between two sampled positions of a select structure.
SAMPLED = 256


class EliasFano:
    """A non-decreasing sequence of integers >= 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        l = max(0, int(v[-1] // np.uint64(n)).bit_length() - 1)
        shifts = np.arange(l, dtype=np.uint64)
        low = np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes() if l else b""
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, l, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLED].astype("<u4").tobytes())

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.uint64)
        bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), count=self.n * self.low_bits, bitorder="little")
        own = bits.reshape(self.n, self.low_bits)[at].astype(np.uint64)
        return (own << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled one on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, dtype="<u4")[i // SAMPLED])
        left = i % SAMPLED
        first = at // 8
        bits = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8, offset=first), bitorder="little")
        bits[: at - first * 8] = 0
        one = first * 8 + int(np.flatnonzero(bits)[left])
        low = 0
        for k in range(self.low_bits):
            p = i * self.low_bits + k
            low |= (self.low[p >> 3] >> (p & 7) & 1) << k
        return (one - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value, in order."""
        if not self.n:
            return np.empty(0, dtype=np.uint64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<u4").tobytes()
        return head + self.low + self.high + self.samples

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, l, a, b = (int(x) for x in np.frombuffer(data, dtype="<u4", count=4))
        return cls(n, l, data[16 : 16 + a], data[16 + a : 16 + a + b], data[16 + a + b :])


def encoded(docs: DataFrame, path: str, end_id: int, cuts: list[int]) -> DataFrame:
    """(doc_id, bucket, ids) for (doc_id, text): each whole text's ids and the end id,
    ``Encoder.dtype`` little-endian, and the doc_id's range between ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            ids = enc.encode(b.column("text").to_pylist())
            least = np.iinfo(np.int64).min
            keys = np.array([least if k is None else k for k in b.column("doc_id").to_pylist()], dtype=np.int64)
            shard = np.searchsorted(np.array(cuts, dtype=np.int64), keys, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shard), pa.array([x + end for x in ids], type=pa.binary())], names=["doc_id", "bucket", "ids"])

    return docs.mapInArrow(lean(run, "encoder"), "doc_id long, bucket int, ids binary")


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids that part the documents into ranges of about equal counts."""
    if n < 2:
        return []
    row = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20_000).alias("q")).first()
    return sorted(set(row.q or []))


def write_store(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the blocks; returns the table of blocks:
    shard int, block int, within long, n_docs long, n_ids long, width int, least long, nulls long, docs binary,
    bounds binary, ids binary."""
    spark, path = docs.sparkSession, path or default_path()
    small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = _bounds(own.select("doc_id"), partitions(spark))
    width = encoder(path).dtype.itemsize
    ids = encoded(own, path, end_id, cuts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, within, shard_no, keys, parts, held = 0, 0, 0, [], [], 0

        def record() -> pa.RecordBatch:
            nulls = sum(k is None for k in keys)
            own = np.array([k for k in keys if k is not None], dtype=np.int64)
            least = int(own[0]) if len(own) else 0
            ends = np.cumsum([len(p) // width for p in parts])
            docs_code = EliasFano.of((own - least).astype(np.uint64)).to_bytes()
            row = [shard_no, block, within, len(keys), int(ends[-1]), width, least, nulls, docs_code, EliasFano.of(ends).to_bytes(), b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

        for b in batches:
            for key, part, s in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("bucket").to_pylist(), strict=True):
                if keys and (s != shard_no or held + len(part) > BLOCK_IDS * width):
                    yield record()
                    block, within = (block + 1, within + held // width) if s == shard_no else (0, 0)
                    keys, parts, held = [], [], 0
                shard_no = s
                keys.append(key)
                parts.append(part)
                held += len(part)
        if keys:
            yield record()

    sorted_ids = deal(ids).sortWithinPartitions(F.col("bucket"), F.col("doc_id").asc_nulls_first(), "ids")
    return stored(sorted_ids.mapInArrow(pack, _SCHEMA))


_SCHEMA = "shard int, block int, within long, n_docs long, n_ids long, width int, least long, nulls long, docs binary, bounds binary, ids binary"
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("within", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("least", pa.int64()), ("nulls", pa.int64()), ("docs", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary())])


def with_bases(blocks: DataFrame) -> DataFrame:
    """Blocks with ``base``: ids of all blocks before them.  The driver sums the shards' totals (one
    number per shuffle partition); ``within`` was counted by the shard's writer."""
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = [], 0
    for s in sorted(totals):
        before += [F.lit(s), F.lit(at).cast("long")]
        at += totals[s]
    start = F.element_at(F.create_map(*before), F.col("shard")) if before else F.lit(0)
    return blocks.withColumn("base", (F.col("within") + start).cast("long"))


def read_store(blocks: DataFrame) -> DataFrame:
    """Documents of a store: doc_id long, start long, n_tokens long, ids_crc32 long, in no order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}")
                ends = EliasFano.from_bytes(r["bounds"]).all().astype(np.int64)
                keys = [None] * r["nulls"] + (EliasFano.from_bytes(r["docs"]).all().astype(np.int64) + r["least"]).tolist()
                starts = np.concatenate([[0], ends[:-1]])
                whole = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(whole[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + r["base"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_bases(blocks).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(blocks: DataFrame, shard: int, block: int, i: int) -> np.ndarray:
    """Ids of the i-th document of a block, through select."""
    r = blocks.where((F.col("shard") == shard) & (F.col("block") == block)).first()
    ends = EliasFano.from_bytes(bytes(r.bounds))
    return np.frombuffer(bytes(r.ids), dtype=f"<u{r.width}")[ends.select(i - 1) if i else 0 : ends.select(i)]
