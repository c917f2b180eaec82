"""Lexical retrieval packing: windows of related documents from a sharded BM25 inverted index.

Each document's ids are cut at multiples of ``WINDOW``: the full windows are sequences of their own,
the rest is a unit.  Document frequencies, number and mean length of the units are those of the whole
corpus (at most one number for each id of the vocabulary).  Units are dealt to shards by likeness: a
unit's place is named by two terms, each drawn by its BM25 weights with the same random numbers for
all units, so that two units draw the same one the likelier the more weight they share; units sorted
by these terms are cut into ranges, and every ``SHARD`` of a range are one shard.  A group of like
units larger than a shard falls into several; it is never held whole.

Each shard builds an inverted index of its units' token ids.  The longest unused unit is the seed of a
window; its ``QUERY`` heaviest terms are looked up, and the unused units of the highest BM25 scores
fill the window greedily, best first.  A unit that is too long for the room left is cut at a multiple
of ``STEP`` ids, and its rest stays in the index as a unit; where no unit shares a term, the next
unused one is taken.  So a window loses less than ``STEP`` ids, but for the last one of a shard.

Ids themselves aren't shuffled: a unit travels as its length, its bag of token ids and the crc32 of
its prefixes at every ``STEP`` ids; the crc32 of any piece follows from the crcs of two prefixes.
``piece_ids`` gives a piece's real ids.

Defined cases: null and empty texts are the end id alone; rows of one doc_id are packed each on its
own; a null doc_id comes back null; an empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import deal, lean, mix64, partitions, small_batches, stored, widened
from .encoder import default_path, encoder, forget

WINDOW, STEP, SHARD, QUERY, AHEAD = 2_048, 16, 4_096, 32, 64
#: BM25's saturation and length norm.
K1, B = 1.2, 0.75
_POLY = 0xEDB88320


def _power_table(most: int) -> np.ndarray:
    """x^(32 L) modulo the crc polynomial, for L = 0 .. most ids (bit-reflected)."""
    out = np.zeros(most + 1, dtype=np.uint64)
    value = 0x80000000
    for i in range(most + 1):
        out[i] = value
        for _ in range(32):
            value = value >> 1 ^ (_POLY if value & 1 else 0)
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of bit-reflected polynomials modulo the crc polynomial."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1) == 1, b, np.uint64(0))
        b = np.where(b & np.uint64(1) == 1, b >> np.uint64(1) ^ np.uint64(_POLY), b >> np.uint64(1))
    return out


_POWERS = _power_table(WINDOW)


def crc_between(to_start: np.ndarray, to_end: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of the ``length`` ids (4 bytes each, WINDOW at most) between two prefixes."""
    return _times(_POWERS[length], to_start.astype(np.uint64)) ^ to_end.astype(np.uint64)


class Bm25:
    """Weights of the terms of units, by statistics of all units."""

    def __init__(self, df: np.ndarray, n: int, mean: float) -> None:
        self.idf, self.mean = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), max(1.0, mean)
        draw = mix64(np.arange(2 * len(df), dtype=np.uint64)).astype(np.float64) / 2.0**64
        self.race = -np.log(np.maximum(draw, 1e-18)).reshape(2, -1)

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Weight of each posting (unit 0 .. n-1, term, frequency)."""
        norm = K1 * (1 - B + B * np.bincount(doc, tf, n) / self.mean)
        return self.idf[term] * tf * (K1 + 1) / (tf + norm[doc])

    def drawn(self, term: np.ndarray, weight: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Two terms of each unit (its postings begin at ``first``), drawn by weight: the term that is
        first in a race at the speed of its weight."""
        out = []
        for race in self.race:
            time = race[term] / weight
            best = np.flatnonzero(time == np.repeat(np.minimum.reduceat(time, first), np.diff(np.r_[first, len(term)])))
            out.append(term[best[np.searchsorted(best, first)]])
        return out


class Shard:
    """Units of one shard and their inverted index."""

    def __init__(self, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], bm25: Bm25) -> None:
        n = self.n = len(lengths)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float32)
        weight = bm25.weights(doc, term, tf, n)
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.own_terms, self.own_weights = term, weight
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_first = np.r_[0, np.cumsum(np.bincount(term))]
        self.left = lengths.astype(np.int64).copy()

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused units that share a heavy term with the seed, best first, ties to earlier ones."""
        s, e = self.first[seed], self.first[seed + 1]
        w = self.own_weights[s:e]
        top = np.argpartition(-w, QUERY)[:QUERY] if len(w) > QUERY else np.arange(len(w))
        spans = [(self.post_first[t], self.post_first[t + 1]) for t in self.own_terms[s:e][top[w[top] > 0]].tolist()]
        if not spans:
            return
        score = np.bincount(np.concatenate([self.post_doc[a:z] for a, z in spans]), np.concatenate([self.post_weight[a:z] for a, z in spans]), self.n)
        score[self.left <= 0] = 0
        score[seed] = 0
        hit = np.flatnonzero(score)
        if len(hit) > AHEAD:  # most windows are full after a few
            least = np.partition(score[hit], -AHEAD)[-AHEAD]
            first, hit = hit[score[hit] >= least], hit[score[hit] < least]
            yield from first[np.argsort(-score[first], kind="stable")].tolist()
        yield from hit[np.argsort(-score[hit], kind="stable")].tolist()

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as (unit, start in the unit, length); every id of every unit once."""
        left, whole = self.left, self.left.copy()
        order = np.argsort(-whole, kind="stable")
        at = 0
        while True:
            while at < self.n and left[order[at]] <= 0:
                at += 1
            if at == self.n:
                return
            seed = int(order[at])
            window = [(seed, int(whole[seed] - left[seed]), int(left[seed]))]
            room, left[seed] = WINDOW - int(left[seed]), 0
            if room >= STEP:
                for u in self.neighbours(seed):
                    take = int(left[u]) if left[u] <= room else room - room % STEP
                    window.append((u, int(whole[u] - left[u]), take))
                    left[u] -= take
                    room -= take
                    if room < STEP:
                        break
            scan = at
            while room >= 1 and scan < self.n:  # nothing related is left: the next unused units
                u = int(order[scan])
                scan += 1
                take = int(left[u]) if left[u] <= room else room - room % STEP
                if take > 0:
                    window.append((u, int(whole[u] - left[u]), take))
                    left[u] -= take
                    room -= take
                if room < STEP:
                    break
            yield window


def _units(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            keys, texts = b.column("doc_id"), b.column("text").to_pylist()
            order, total, crcs, terms, counts = [], [], [], [], []
            for x in enc.encode(texts):
                ids = np.append(np.frombuffer(x, dtype=enc.dtype), end_id).astype("<u4")
                data, crc, own = memoryview(ids.tobytes()), 0, [0]
                for s in range(0, len(data), 4 * STEP):
                    crc = zlib.crc32(data[s : s + 4 * STEP], crc)
                    own.append(crc)
                t, c = np.unique(ids[len(ids) - len(ids) % WINDOW :], return_counts=True)
                total.append(len(ids))
                crcs.append(np.array(own, dtype="<u4").tobytes())
                terms.append(t.astype("<u4" if enc.dtype.itemsize == 4 else "<u2").tobytes())
                counts.append(c.astype("<u2").tobytes())
                order.append(zlib.crc32(crcs[-1]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(order, pa.int64()), pa.array(total, pa.int64()), pa.array(crcs, pa.binary()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=_UNIT)

    return docs.mapInArrow(lean(run, "encoder"), "doc_id long, tie long, total long, crcs binary, terms binary, counts binary")


def _statistics(units: DataFrame, kind: str, ids: int, n: int) -> Bm25:
    """BM25 statistics of all units: tasks count, slices of the vocabulary are summed apart."""
    slices = min(n, 16)
    cuts = np.linspace(0, ids + 2, slices + 1).astype(int)  # the last two cells: units, ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(ids + 2, dtype=np.int64)
        for b in batches:
            t, total = np.frombuffer(b"".join(b.column("terms").to_pylist()), kind), b.column("total").to_numpy()
            df[:ids] += np.bincount(t, minlength=ids)
            df[ids] += int((total % WINDOW > 0).sum())
            df[ids + 1] += int((total % WINDOW).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([df[x:z].tobytes() for x, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "df"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column("bucket").to_pylist(), b.column("df").to_pylist(), strict=True):
                found[k] = found.get(k, 0) + np.frombuffer(blob, dtype=np.int64)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["bucket", "df"])

    got = {r.bucket: bytes(r.df) for r in deal(units.select("terms", "total").mapInArrow(lean(count), "bucket int, df binary")).mapInArrow(lean(total), "bucket int, df binary").collect()}
    df = np.frombuffer(b"".join(got[k] for k in sorted(got)), dtype=np.int64) if got else np.zeros(ids + 2, dtype=np.int64)
    return Bm25(df[:ids].astype(np.float64), int(df[ids]), float(df[ids + 1]) / max(1, int(df[ids])))


_UNIT = ["doc_id", "tie", "total", "crcs", "terms", "counts"]


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset long; each id lies in one piece, and a sequence has WINDOW ids at most."""
    spark, path = docs.sparkSession, path or default_path()
    small_batches(spark)
    n = partitions(spark, docs)
    enc = encoder(path)
    kind, ids = ("<u4" if enc.dtype.itemsize == 4 else "<u2"), max(enc.size, end_id + 1)
    del enc
    forget()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = stored(_units(own, path, end_id))
    shared = spark.sparkContext.broadcast(_statistics(units, kind, ids, n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bm25 = shared.value
        for b in batches:
            terms = [np.frombuffer(x, kind) for x in b.column("terms").to_pylist()]
            size = np.array([len(t) for t in terms])
            keys = np.zeros((2, len(terms)), dtype=np.int64)
            some = np.flatnonzero(size)
            if len(some):
                doc, term = np.repeat(np.arange(len(terms)), size), np.concatenate(terms).astype(np.int64)
                tf = np.frombuffer(b"".join(b.column("counts").to_pylist()), "<u2").astype(np.float32)
                keys[:, some] = bm25.drawn(term, bm25.weights(doc, term, tf, len(terms)), np.r_[0, np.cumsum(size)[:-1]][some])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _UNIT), pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32())], names=[*_UNIT, "near", "nearer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket, number, rows = TaskContext.get().partitionId(), 0, []

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            total = np.array([r[2] for r in rows], dtype=np.int64)
            pieces = []  # (row, start, length, sequence, offset)
            for i, t in enumerate(total.tolist()):
                for k in range(t // WINDOW):
                    pieces.append((i, k * WINDOW, WINDOW, number, 0))
                    number += 1
            units = np.flatnonzero(total % WINDOW)
            if len(units):
                shard = Shard(total[units] % WINDOW, [np.frombuffer(rows[i][4], kind) for i in units], [np.frombuffer(rows[i][5], "<u2") for i in units], shared.value)
                for window in shard.windows():
                    at = 0
                    for u, s, length in window:
                        i = int(units[u])
                        pieces.append((i, int(total[i]) // WINDOW * WINDOW + s, length, number, at))
                        at += length
                    number += 1
            p = np.array(pieces, dtype=np.int64)
            crcs = [np.frombuffer(r[3], "<u4") for r in rows]
            first = np.array([crcs[i][s // STEP] for i, s in zip(p[:, 0].tolist(), p[:, 1].tolist(), strict=True)], dtype=np.uint64)
            last = np.array([crcs[i][-(-e // STEP)] for i, e in zip(p[:, 0].tolist(), (p[:, 1] + p[:, 2]).tolist(), strict=True)], dtype=np.uint64)
            crc = crc_between(first, last, p[:, 2]).astype(np.int64)
            keys = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(p[:, 0])), *map(pa.array, (np.ascontiguousarray(p[:, 1]), np.ascontiguousarray(p[:, 2]), crc, total[p[:, 0]], p[:, 3] + (bucket << 40), np.ascontiguousarray(p[:, 4])))], names=names)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _UNIT), strict=True):
                rows.append(row)
                if len(rows) == SHARD:
                    yield from flush(rows)
                    rows = []
        if rows:
            yield from flush(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    order = ["near", "nearer", F.xxhash64("doc_id", "tie"), F.col("doc_id"), F.col("tie")]
    units = units.mapInArrow(lean(place), widened(units, near="int", nearer="int")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return units.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def piece_ids(text: str | None, start: int, length: int, path: str | None = None, end_id: int = 1) -> list[int]:
    """The ids of one piece of a document."""
    enc = encoder(path or default_path())
    ids = [*np.frombuffer(enc.encode([text])[0], dtype=enc.dtype).tolist(), end_id]
    return ids[start : start + length]
