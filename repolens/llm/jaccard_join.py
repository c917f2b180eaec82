"""Exact Jaccard self-join of shingle sets by a pigeonhole over a partitioned universe.

A set's band is its size's power of 4/3; sets that reach Jaccard 0.75 are in the same band or in
neighbouring ones.  For a band whose largest size is u, two similar sets (one of the band, one of
it or of the next) differ in at most H = floor((1 - t) / t * u) elements.  The universe of hashes is
cut into m = H + 1 + S equal ranges (segments), so similar sets agree in at least 1 + S of them.  A
set is indexed by the hash of each non-empty segment in its own band's cut, and probes the band
below in that band's cut.

Allocation: S is the number of empty segments that is usual for the band.  Empty segments, which
all sets share, get no signature: a set with e <= S empty ones still has a non-empty segment that
agrees.  A set with more empty ones spends two units on each segment of two elements or more: its
one-deletion neighbourhood is indexed too, so a difference of one element there still meets; if
even that doesn't reach H + 1 units, its empty segments are indexed.

Large groups: a signature shared by more than ``GROUP`` different sets isn't paired out.  Its
members are compared with the group's first member and with the one before them.  A pair that
shares nothing else needs more than S - e such signatures; the few sets that have so many of them are
compared with one another after the first pass, block by block within a band, and only links that
join components leave a task.

Counting: similar sets agree in 1 + S segments at least, no more than the emptier set's e of them
empty, so they share more than S - e signatures (the larger such room of the two).  Pairs that
share fewer, even if all their signatures of large groups were common, are no candidates.

Every candidate pair is verified on the whole sets; equal sets are one vertex.  Sets are compared
where the pair's second set lives; the first set is sent once to each task that needs it, so a
hub costs a copy per task and not one per pair.

Vertices are 64-bit fingerprints of whole sets, elements 64-bit hashes.  Defined cases: a text of
fewer words than a shingle has one element, the whole sequence; null and empty texts have none and
link with nothing; null ids come back null and count as no component's smallest id; repeated rows
are equal sets; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import deal, lean, lookup_table, mix64, partitions, range_bucket, small_batches, stored, word_bytes
from .components import components
from .lm import FEW, Words
from .shingles import shingle_hashes

THRESHOLD, GROUP = (3, 4), 32
#: Further spare segments, as a share of H + 1, so that sets may have some in large groups; sets of a block.
SPARE, BLOCK = 0.12, 512
#: A set's signatures in one bucket: n of them, 255 at most; a room beyond its field only lets more pairs through to be verified.
_HEAD = np.dtype([("fp", "<u8"), ("room", "<i2"), ("band", "u1"), ("n", "u1")])
#: Two heads of a set in one bucket, of ``band`` and of the band below (n 0: none), as they are shuffled.
_BOTH = np.dtype([("fp", "<u8"), ("room", "<i2", (2,)), ("band", "u1"), ("n", "u1", (2,))])


def band_of(size: int) -> int:
    """Band of a size: exact integers, the first band holds size 1."""
    k = 0
    while top_of(k) < size:
        k += 1
    return k


@lru_cache(None)
def top_of(band: int) -> int:
    """Largest size of a band: sizes beyond top * 4 / 3 can't be similar to it."""
    return 1 if band == 0 else max(top_of(band - 1) + 1, top_of(band - 1) * 4 // 3)


@lru_cache(None)
def cut(band: int) -> tuple[int, int, int]:
    """(H, S, m) of a band."""
    u, least = top_of(band), top_of(band - 1) + 1 if band else 1
    differ = (THRESHOLD[1] - THRESHOLD[0]) * u // THRESHOLD[0]
    spare = 0
    while True:
        m = differ + 1 + spare
        e = m * math.exp(-least / m)
        if spare >= e + 3 * math.sqrt(e) + SPARE * (differ + 1) or spare > u:
            return differ, spare, m
        spare += 1


_TOPS = np.array([top_of(k) for k in range(90)], dtype=np.int64)


def signatures(sets: list[np.ndarray], fps: np.ndarray, n: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, heads, signatures) of a batch of sets: every set in its own cut and the one below."""
    found: dict[int, tuple[list, list]] = {}
    for lower in (0, 1):
        own = []
        for fp, s in zip(fps, sets, strict=True):
            band = int(np.searchsorted(_TOPS, len(s))) - lower
            if len(s) and band >= 0:
                own.append((fp, s, band))
        if not own:
            continue
        sizes = np.array([len(s) for _, s, _ in own])
        bands = np.array([b for _, _, b in own], dtype=np.uint64)
        cuts = np.array([cut(b) for _, _, b in own])
        doc, h = np.repeat(np.arange(len(own)), sizes), np.concatenate([s for _, s, _ in own])
        m = cuts[doc, 2].astype(np.uint64)
        seg = (h >> np.uint64(32)) * m >> np.uint64(32)  # ascending hashes: segments come in order
        first = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])])
        inner = mix64(h)
        total = np.add.reduceat(inner, first)
        length = np.diff(np.r_[first, len(h)])
        d, name = doc[first], (bands[doc[first]] << np.uint64(32)) + seg[first]
        sig = mix64(total ^ mix64(name))
        filled = np.bincount(d, minlength=len(own))
        room = cuts[:, 1] - (cuts[:, 2] - filled)
        sig_doc, sig_all = [d], [sig]
        poor = room < 0
        if poor.any():
            whole = np.flatnonzero(poor[d] & (length > 1))
            each = np.repeat(whole, length[whole])
            at = np.concatenate([np.arange(first[i], first[i] + length[i]) for i in whole]) if len(whole) else np.empty(0, np.int64)
            sig_doc.append(d[each])
            sig_all.append(mix64((total[each] - inner[at]) ^ mix64(name[each])))
            for i in np.flatnonzero(poor):
                mine = length[d == i]
                if (mine == 1).sum() + 2 * (mine > 1).sum() < cuts[i, 0] + 1:
                    missing = np.setdiff1d(np.arange(cuts[i, 2], dtype=np.uint64), seg[first][d == i])
                    sig_doc.append(np.full(len(missing), i))
                    sig_all.append(mix64(np.uint64(0) ^ mix64((bands[i] << np.uint64(32)) + missing)))
        d, sig = np.concatenate(sig_doc), np.concatenate(sig_all)
        part = range_bucket(sig, n)
        order = np.lexsort((d, part))
        d, sig, part = d[order], sig[order], part[order]
        new = np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])]
        start = np.flatnonzero(new)
        at = np.flatnonzero(new | ((np.arange(len(d)) - start[np.cumsum(new) - 1]) % 255 == 0))
        head = np.zeros(len(at), dtype=_HEAD)
        head["fp"], head["room"], head["band"] = np.array([o[0] for o in own], dtype=np.uint64)[d[at]], np.clip(room[d[at]], -32_768, 32_767), bands[d[at]]
        head["n"] = np.diff(np.r_[at, len(d)])
        low = np.ascontiguousarray(sig).view("<u2").reshape(-1, 4)[:, :3]
        for b in np.unique(part):
            x, z = np.searchsorted(part, [b, b + 1])
            u, w = np.searchsorted(part[at], [b, b + 1])
            got = found.setdefault(int(b), ([], []))
            got[0].append(head[u:w].tobytes())
            got[1].append(low[x:z].tobytes())
    return [(b, b"".join(x), b"".join(y)) for b, (x, y) in found.items()]


def _moved(rows: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``rows``, of which each group has ``n``, with the groups in another order."""
    start, n = (np.cumsum(n) - n)[order], n[order]
    return rows[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(rows))]


def packed(heads: bytes, low: bytes) -> tuple[bytes, bytes]:
    """A bucket's heads and signatures for the shuffle, as with many buckets the heads weigh as much as the
    signatures: a fingerprint stands once for its two bands, and the fields stand apart in the order
    of band and room, so that all but the fingerprints compress."""
    head, sig = np.frombuffer(heads, dtype=_HEAD), np.frombuffer(low, dtype="<u2").reshape(-1, 3)
    order = np.lexsort((-head["band"].astype(np.int64), head["fp"]))
    head, sig = head[order], _moved(sig, head["n"].astype(np.int64), order)
    below = np.r_[False, (head["fp"][1:] == head["fp"][:-1]) & (head["band"][1:] + 1 == head["band"][:-1])]
    first, second = np.flatnonzero(~below), np.flatnonzero(below)
    both = np.zeros(len(first), dtype=_BOTH)
    both["fp"], both["band"] = head["fp"][first], head["band"][first]
    both["room"][:, 0], both["n"][:, 0] = head["room"][first], head["n"][first]
    at = np.searchsorted(first, second) - 1
    both["room"][at, 1], both["n"][at, 1] = head["room"][second], head["n"][second]
    order = np.lexsort((both["room"][:, 0], both["band"]))
    sig, both = _moved(sig, both["n"].sum(axis=1, dtype=np.int64), order), both[order]
    return b"".join(both[f].T.tobytes() for f in _BOTH.names), sig.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    """The heads that ``packed`` has put together, in the order of its signatures."""
    k, at = len(blob) // _BOTH.itemsize, 0
    heads = np.zeros((k, 2), dtype=_HEAD)
    for f in _BOTH.names:
        kind, shape = _BOTH[f].base, (*_BOTH[f].shape, k)
        got = np.frombuffer(blob, kind, int(np.prod(shape)), at).reshape(shape)
        at += got.nbytes
        heads[f] = got.T if got.ndim == 2 else got[:, None]
    heads["band"][:, 1] -= 1
    return heads[heads["n"] > 0]


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("band", "<i4"), ("room", "<i4"), ("n", "<i8")])
_HOT = np.dtype([("sig", "<u8"), ("fp", "<u8"), ("room", "<i4"), ("band", "<i4")])


def grouped(heads: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket, with the number of signatures they share and the larger room
    of the two, and the members of its large groups."""
    wide = np.zeros((len(low), 4), dtype="<u2")
    wide[:, :3] = low
    sig, row = wide.reshape(-1).view("<u8"), np.repeat(np.arange(len(heads), dtype=np.int32), heads["n"])
    del wide, low
    order = np.lexsort((heads["fp"][row], sig)).astype(np.int32)
    sig, row = sig[order], row[order]
    del order
    fp = heads["fp"][row]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])] if len(sig) else np.empty(0, bool)
    if not keep.all():
        sig, row, fp = sig[keep], row[keep], fp[keep]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(sig)])
    shared = np.repeat(size > 1, size)  # most signatures are one set's alone
    sig, row, fp, size = sig[shared], row[shared], fp[shared], size[size > 1]
    first = np.cumsum(size) - size
    left, right = [], []
    for g in range(2, GROUP + 1):
        own = first[size == g]
        if len(own):
            i, j = np.triu_indices(g, 1)
            left.append((own[:, None] + i).ravel())
            right.append((own[:, None] + j).ravel())
    large = np.flatnonzero(size > GROUP)
    hot = np.zeros(0, dtype=_HOT)
    if len(large):
        at = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in large])
        lead = np.repeat(first[large], size[large])
        left += [lead[at > lead], at[at > lead + 1] - 1]
        right += [at[at > lead], at[at > lead + 1]]
        hot = np.zeros(len(at), dtype=_HOT)
        hot["sig"], hot["fp"], hot["room"], hot["band"] = sig[at], fp[at], heads["room"][row[at]], heads["band"][row[at]]
    if not left:
        return np.zeros(0, dtype=_PAIR), hot
    x, y = np.concatenate(left), np.concatenate(right)
    pairs = np.zeros(len(x), dtype=_PAIR)
    pairs["a"], pairs["b"], pairs["band"] = fp[x], fp[y], heads["band"][row[x]]
    pairs["room"] = np.maximum(heads["room"][row[x]], heads["room"][row[y]])
    pairs, counts = np.unique(pairs, return_counts=True)
    pairs["n"] = counts
    return pairs, hot


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(bucket, a, elements) of the texts of ``wanted`` (fp, row_key, buckets), once for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(FEW)
        for b in batches:
            out: list[tuple] = []
            for fp, buckets, text in zip(*(b.column(c).to_pylist() for c in ("fp", "buckets", "text")), strict=True):
                elements = np.unique(shingle_hashes(words.hashes(word_bytes(text)))).tobytes()
                out += [(k, fp, elements) for k in buckets]
            for s in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out[s : s + 512], strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "a", "elements"])

    return docs.join(lookup_table(wanted, "buckets", 8), "row_key").select("fp", "buckets", "text").mapInArrow(lean(run), "bucket int, a long, elements binary")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(a, b) of the pairs whose sets reach the threshold.  A set goes once to each task that needs it."""
    home = F.pmod(F.xxhash64("b"), F.lit(n)).cast("int")
    needs = pairs.select(F.col("b").alias("fp"), home.alias("bucket")).union(pairs.select("a", home)).groupBy("fp").agg(F.collect_set("bucket").alias("buckets"))  # n at most
    sets = _sets(docs, needs.join(reps, "fp").select("fp", "row_key", "buckets"), n).select("*", F.lit(None).cast("long").alias("b"))
    asks = pairs.select(home.alias("bucket"), "a", F.lit(None).cast("binary").alias("elements"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        todo: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            ask = b.column("b").is_valid().to_numpy(zero_copy_only=False)
            a, c, blobs = b.column("a").to_numpy(), b.column("b").fill_null(0).to_numpy(), b.column("elements")
            todo.append((a[ask], c[ask]))
            for i in np.flatnonzero(~ask).tolist():
                if int(a[i]) not in known:
                    known[int(a[i])] = np.frombuffer(blobs[i].as_py(), dtype="<u8")
        for a, b in todo:
            good = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                p, q = known[x], known[y]
                if min(len(p), len(q)) * THRESHOLD[1] >= max(len(p), len(q)) * THRESHOLD[0]:
                    at = np.searchsorted(q, p)
                    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    good[i] = both * THRESHOLD[1] >= (len(p) + len(q) - both) * THRESHOLD[0]
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return deal(sets.unionByName(asks), n).mapInArrow(lean(run), "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (doc_id, text): rows (doc_id, row_key, n_shingles, fp), one a document, and verified
    links (a, b) between fingerprints of different sets; both are written tables."""
    import xxhash

    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(FEW)
        for b in batches:
            texts, sizes, fps = b.column("text").to_pylist(), [], []
            for s in range(0, len(texts), 128):
                sets = [np.unique(shingle_hashes(words.hashes(word_bytes(t)))) for t in texts[s : s + 128]]
                own = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64)
                sizes += [len(x) for x in sets]
                fps.append(own)
                _, once = np.unique(own, return_index=True)
                for bucket, heads, low in signatures([sets[i] for i in once], own[once], n):
                    heads, low = packed(heads, low)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([heads], pa.binary()), pa.array([low], pa.binary())], names=names)
            k = b.num_rows
            fp = np.concatenate(fps).view(np.int64) if fps else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(sizes, pa.int64()), pa.array(fp), pa.array(range_bucket(mix64(fp.view(np.uint64)), n)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)

    names = ["doc_id", "row_key", "n_shingles", "fp", "bucket", "heads", "low"]
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    first = deal(all_docs.mapInArrow(lean(run), "doc_id long, row_key long, n_shingles long, fp long, bucket int, heads binary, low binary"), n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, low = [], []
        for b in batches:
            doc = b.column("fp").is_valid()
            rows = pa.RecordBatch.from_arrays([b.column(c) for c in names[:4]], names=names[:4]).filter(doc)
            if len(rows):
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(len(rows), t) for t in types[4:])], names=out)
            rest = b.filter(pa.compute.invert(doc))
            heads += rest.column("heads").to_pylist()
            low += rest.column("low").to_pylist()
        if not heads:
            return
        heads, low = np.concatenate([unpacked(x) for x in heads]), np.frombuffer(b"".join(low), dtype="<u2").reshape(-1, 3)
        pairs, hot = grouped(heads, low)
        del heads, low

        def made(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            k = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[c]).view(t.to_pandas_dtype())) if c in columns else pa.nulls(k, t) for c, t in zip(out, types, strict=True)], names=out)

        for at in range(0, len(pairs), 50_000):
            p = pairs[at : at + 50_000]
            yield made({"a": p["a"], "b": p["b"], "sig": p["n"], "room": p["room"], "band": p["band"]})
        for at in range(0, len(hot), 50_000):
            h = hot[at : at + 50_000]
            yield made({"a": h["fp"], "sig": h["sig"], "room": h["room"], "band": h["band"]})

    out, types = [*names[:4], "a", "b", "sig", "room", "band"], [pa.int64()] * 7 + [pa.int32()] * 2
    met = stored(first.mapInArrow(lean(meet), "doc_id long, row_key long, n_shingles long, fp long, a long, b long, sig long, room int, band int"))
    rows = met.where("a is null").select("doc_id", "row_key", "n_shingles", "fp")
    hot = met.where("a is not null and b is null").select(F.col("a").alias("fp"), "sig", "room", "band")
    often = hot.groupBy("fp", "band").agg(F.count("*").alias("hot"), F.min("room").alias("room"))
    shared = met.where("b is not null").groupBy("a", "b", "band").agg(F.sum("sig").alias("n"), F.max("room").alias("room"))
    for side in ("a", "b"):
        shared = shared.join(often.select(F.col("fp").alias(side), "band", F.col("hot").alias(f"hot_{side}")), [side, "band"], "left")
    enough = F.col("n") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))) > F.col("room")
    pairs = stored(shared.where(enough).select("a", "b").distinct())
    reps = rows.groupBy("fp").agg(F.min("row_key").alias("row_key"))

    found = stored(_verified(pairs, all_docs, reps, n))
    poor = often.where("hot > room").select("fp", "band")
    labels = components(found)
    again = stored(poor.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "band", F.coalesce("component", "fp").alias("component")))
    if again.limit(1).count():
        wanted = again.select("fp").distinct().join(reps, "fp").withColumn("buckets", F.array(F.lit(0)))
        sets = stored(_sets(all_docs, wanted, n).select(F.col("a").alias("fp"), "elements").dropDuplicates(["fp"]))
        found = stored(found.union(_between(again.join(sets, "fp"), n)))
    return rows, found


def _between(poor: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that join different components of ``poor`` (fp, band, component, elements), sets
    of a band compared block against block.  A task gives only the links that join components which
    its earlier links leave apart: fewer than it has components."""
    sizes = poor.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = poor.join(F.broadcast(sizes), "band").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))  # a row a band: 90 at most
    cells = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("band", "fp", "component", "elements", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("band", "i", "j"), F.lit(n)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("band", "i", "j", "own", "fp", "component", "elements")), strict=True):
                groups.setdefault(row[:3], []).append(row[3:])
        for (_, i, j), members in groups.items():
            block, fp, component = (np.array([m[c] for m in members], dtype=np.int64) for c in range(3))
            sets = [np.frombuffer(m[3], dtype="<u8") for m in members]
            size = np.array([len(x) for x in sets])
            _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(members)), size)
            both = often[col] > 1  # elements of one set only can't be common
            row, (_, col) = row[both], np.unique(col[both], return_inverse=True)
            x, y = (np.arange(len(members)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
            common = np.zeros((len(x), len(y)), dtype=np.float32)
            for at in range(0, int(col.max(initial=-1)) + 1, 4_096):
                part = (col >= at) & (col < at + 4_096)
                m = np.zeros((len(members), 4_096), dtype=np.float32)
                m[row[part], col[part] - at] = 1
                common += m[x] @ m[y].T
            similar = THRESHOLD[1] * common >= THRESHOLD[0] * (size[x][:, None] + size[y][None, :] - common)
            a, b = np.nonzero(similar & (component[x][:, None] != component[y][None, :]))
            root: dict[int, int] = {}

            def head(c: int, root: dict[int, int] = root) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            out = []
            for p, q in zip(x[a].tolist(), y[b].tolist(), strict=True):
                u, v = head(int(component[p])), head(int(component[q]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out.append((int(fp[p]), int(fp[q])))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return deal(cells, n).mapInArrow(lean(run), "a long, b long")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id long, n_shingles long, component_id long of every document."""
    rows, found = links(docs)
    reps = rows.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(found).withColumnRenamed("v", "fp").join(reps, "fp")
    roots = roots.join(roots.groupBy("component").agg(F.min("rep").alias("root")), "component").select("fp", "root")
    known = reps.join(roots, "fp", "left").select("fp", F.coalesce("root", "rep").alias("root"))
    linked = rows.where("n_shingles > 0").join(known, "fp").select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    return linked.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
