"""Language-model scoring with a log-frequency Bloom filter.

Counting: every text is lower-cased (A-Z), cut into words and given one end token.  A task combines
some million tokens to a batch: its distinct words and pairs, with their counts in training texts
(0 for those of held-out texts alone), are packed by hash range and sent in one exchange.  Words are
known by 64-bit hashes, pairs by 48 bits besides their range.  The batch's tokens are kept beside
them as numbers of its words.

Filter: a count c is quantised to level 1 + floor(log_1.5 c), and the n-gram is inserted once for
each level up to its own; a reader probes level after level until one is missing.  The filter is cut
at the hash ranges: each part holds every word and pair of its range, those that occur once too, and
answers the batches that sent it n-grams with their levels (and the words' exact counts).  No part
leaves its task and nothing is broadcast, so the model grows with the corpus and nothing is pruned.

Probability: P(w | h) = (1 - l) * P1(w) + l * c(hw) / c(h), P1(w) = (c(w) + 1) / (N + V + 1), with
c(hw) no larger than c(h).  These counts come from the filter; the context of the first word is the
end token.  The weight l belongs to the level of c(h) and is fitted by deleted interpolation on every
``EVERY``-th token of the training texts, each left out of its own counts.
``score`` is the sum of log10 P over words and end; ``base_score`` is made of the exact counts.

Defined cases: null and empty texts are one end token; repeated rows are scored and, in training,
counted each; with no training text N = V = 0 and base_score is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_bucket, deal, lean, mix64, partitions, range_bucket, small_batches, stored, word_bytes

#: Membership hashes of a key and bits a key; base of the quantisation.
PROBES, BITS, BASE = 5, 10, 1.5
#: The weights are fitted on every EVERY-th training token; steps of a ratio's logarithm; no ratio.
EVERY, ODDS, NONE = 32, 16, -(1 << 40)
#: Tokens combined at once, words remembered by a worker, and by one that has much else to hold.
TOKENS, REMEMBERED, FEW = 3_000_000, 400_000, 150_000
LEVELS = 96
END = b" end"
#: Rows of the exchanges: n-grams for a range, a text, a batch's tokens, its sample of places, a range's answer, its totals.
ASK, TEXT, TOKENS_OF, PLACES, ANSWER, TOTAL = range(6)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def low48(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 48) - 1)


def step_of(k: int) -> np.uint64:
    """What tells the keys of one n-gram apart."""
    return np.uint64(k * 0xD1B54A32D192ED03 & (1 << 64) - 1)


def level(n: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the middle of its range (1 for the first)."""
    low = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE**levels - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


class Words:
    """Hashes of words, remembered up to a bound."""

    def __init__(self, most: int | None = None) -> None:
        import xxhash

        self.digest, self.known, self.most = xxhash.xxh3_64_intdigest, {}, most or REMEMBERED

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.digest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Slots:
    """Numbers of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.words = Words()
        self.slot: dict[bytes, int] = {}
        self.hash = np.empty(0, np.uint64)

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of the texts' words, one text after another."""
        new = set().union(*texts).difference(self.slot)
        if new:
            words = sorted(new)
            self.slot.update(zip(words, range(len(self.hash), len(self.hash) + len(words)), strict=True))
            self.hash = np.r_[self.hash, np.array([self.words.digest(w) for w in words], dtype=np.uint64)]
        return np.concatenate([np.fromiter(map(self.slot.__getitem__, t), np.uint32, len(t)) for t in texts])


class Filter:
    """Log-frequency Bloom filter cut at hash ranges: part i holds bits first[i] .. first[i + 1]."""

    def __init__(self, parts: list[bytes], sizes: list[int]) -> None:
        self.sizes = np.array(sizes, dtype=np.uint64)
        self.first = np.r_[0, np.cumsum([len(p) * 8 for p in parts])].astype(np.uint64)
        self.bits = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def levels(self, h: np.ndarray, part: np.ndarray, most: int = LEVELS) -> np.ndarray:
        """The level of each n-gram: probe 1, 2, ... until a key is missing."""
        out = np.zeros(len(h), dtype=np.int64)
        at = np.arange(len(h))
        for k in range(1, most + 1):
            key = mix64(h[at] + step_of(k))
            step = (key >> np.uint64(32)) | np.uint64(1)
            size, first = self.sizes[part[at]], self.first[part[at]]
            alive = np.flatnonzero(size)
            for i in range(PROBES):
                p = first[alive] + (key[alive] + np.uint64(i) * step[alive]) % size[alive]
                alive = alive[(self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            at = at[alive]
            if not len(at):
                break
            out[at] = k
        return out


def filter_part(h: np.ndarray, levels: np.ndarray, size: int) -> bytes:
    """Bits of one part that holds the n-grams ``h``."""
    bits = np.zeros(-(-size // 8) * 8, dtype=np.uint8)
    for k in range(1, int(levels.max(initial=0)) + 1):
        own = h[levels >= k]
        key = mix64(own + step_of(k))
        step = (key >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            bits[((key + np.uint64(i) * step) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the order that sorts ``keys`` and where each distinct key begins in it."""
    order = np.argsort(keys)
    s = keys[order]
    return order, np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])


def spread(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values of the distinct keys, one for each key (``order``, ``first`` of ``grouped``)."""
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = np.repeat(values, np.diff(np.r_[first, len(order)]))
    return out


def packed(ids: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte planes, compressed."""
    planes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(ids).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


def _home(batch: int, n: int) -> int:
    """The partition in which a batch is scored."""
    return int(range_bucket(mix64(np.array([batch], dtype=np.uint64)), n)[0])


class Asks:
    """The distinct words and pairs of a batch in the order in which the ranges are asked for them."""

    def __init__(self, vocabulary: np.ndarray, before: np.ndarray, at: np.ndarray) -> None:
        pairs = pair_hash(vocabulary[before], vocabulary[at])
        self.order, self.first = grouped(pairs)
        self.pairs = pairs[self.order[self.first]]
        self.words = np.argsort(mix64(vocabulary))

    def rows(self, vocabulary: np.ndarray, pair_counts: np.ndarray, word_counts: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(range, pairs, their counts, words, their counts)."""
        h = vocabulary[self.words]
        k, m = range_bucket(self.pairs, n), range_bucket(mix64(h), n)
        low, c, d = low48(self.pairs).view("<u2").reshape(-1, 4)[:, :3], pair_counts.astype("<u4"), word_counts[self.words].astype("<u4")
        p, w = np.searchsorted(k, np.arange(n + 1)), np.searchsorted(m, np.arange(n + 1))
        for b in np.flatnonzero((np.diff(p) > 0) | (np.diff(w) > 0)).tolist():
            x, y = slice(p[b], p[b + 1]), slice(w[b], w[b + 1])
            yield b, low[x].tobytes(), c[x].tobytes(), h[y].tobytes(), d[y].tobytes()

    def answers(self, got: list[tuple[int, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(levels of the pairs, token by token, levels and exact counts of the vocabulary)."""
        got = sorted(got)
        pairs, levels, counts = (np.frombuffer(b"".join(g[i] for g in got), dtype=t) for i, t in ((1, "u1"), (2, "u1"), (3, "<i8")))
        lv, c = np.empty(len(self.words), np.int64), np.empty(len(self.words), np.int64)
        lv[self.words], c[self.words] = levels, counts
        return spread(pairs, self.order, self.first).astype(np.int64), lv, c


def answered(asks: list[tuple[int, bytes, bytes, bytes, bytes]]) -> tuple[list[tuple[int, bytes, bytes, bytes]], int, int]:
    """One range: its part of the filter is filled from the summed counts and probed for all that was
    asked; (batch, levels of the pairs, levels and counts of the words), training tokens, distinct words."""
    low = np.frombuffer(b"".join(a[1] for a in asks), dtype="<u2").reshape(-1, 3)
    wide = np.zeros((len(low), 4), dtype="<u2")
    wide[:, :3] = low
    del low
    keys, counts = wide.reshape(-1).view("<u8"), np.frombuffer(b"".join(a[2] for a in asks), dtype="<u4")
    words, n = np.frombuffer(b"".join(a[3] for a in asks), dtype="<u8"), np.frombuffer(b"".join(a[4] for a in asks), dtype="<u4")
    order, first = grouped(keys)
    order = order.astype(np.int32)
    h, c = keys[order[first]], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    del keys, wide, counts
    word_order, word_first = grouped(words)
    v, d = words[word_order[word_first]], np.add.reduceat(n[word_order].astype(np.int64), word_first) if len(word_first) else np.empty(0, np.int64)
    held = np.concatenate([v[d > 0], h[c > 0]])
    lv = level(np.concatenate([d[d > 0], c[c > 0]]))
    size = int(lv.sum()) * BITS
    part = Filter([filter_part(held, lv, size) if size else b""], [size])
    del held, lv

    def probed(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.uint8)
        for s in range(0, len(keys), 1 << 18):
            k = keys[s : s + (1 << 18)]
            out[s : s + len(k)] = part.levels(k, np.zeros(len(k), dtype=np.int64))
        return out

    pairs, levels, exact = spread(probed(h), order, first), spread(probed(v), word_order, word_first), spread(d, word_order, word_first)
    out, p, w = [], 0, 0
    for batch, low, _, own, _ in asks:
        x, y = slice(p, p + len(low) // 6), slice(w, w + len(own) // 8)
        out.append((batch, pairs[x].tobytes(), levels[y].tobytes(), exact[y].tobytes()))
        p, w = x.stop, y.stop
    return out, int(d.sum()), int((d > 0).sum())


class Model:
    """Totals and interpolation weights."""

    def __init__(self, tokens: int, types: int) -> None:
        self.tokens, self.types = tokens, types
        self.weights = np.full(LEVELS, 0.1)

    def log_probabilities(self, cw: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
        """log10 P of tokens by the levels of c(w), c(h) and c(hw)."""
        cw, ch = count_of(cw), count_of(context)
        l = self.weights[context] * (ch > 0)
        return np.log10((1 - l) * (cw + 1) / (self.tokens + self.types + 1) + l * np.minimum(count_of(both), ch) / np.maximum(ch, 1))

    def odds(self, cw: np.ndarray, context: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Pair estimate over word estimate of training tokens, each left out of its own counts, as a
        whole number of steps of 1 / ODDS of its logarithm, NONE if it is 0; by levels as above."""
        cw, ch = count_of(cw), count_of(context)
        p1, p2 = np.maximum(cw, 1) / (self.tokens + self.types + 1), np.maximum(np.minimum(count_of(both), ch) - 1, 0) / np.maximum(ch - 1, 1)
        return np.where(p2 > 0, np.round(np.log(np.maximum(p2, 1e-300) / p1) * ODDS), NONE).astype(np.int64)

    def tune(self, at: np.ndarray, ratio: np.ndarray, n: np.ndarray) -> None:
        """Weights by level of the context from numbers of tokens by (level, ratio)."""
        r = np.where(ratio == NONE, 0.0, np.exp(np.minimum(ratio, 600 * ODDS) / ODDS))
        total = np.bincount(at, n, LEVELS)
        for _ in range(20):
            l = self.weights[at]
            self.weights = (np.bincount(at, n * (l * r / (l * r + 1 - l)), LEVELS) + 0.05) / (total + 1.0)


_COLUMNS = {"_kind": pa.int8(), "_bucket": pa.int32(), "_range": pa.int32(), "_batch": pa.int64(), "_at": pa.int64(), "_n": pa.int64(), "_held_out": pa.bool_(), "_a": pa.binary(), "_b": pa.binary(), "_c": pa.binary(), "_d": pa.binary()}
_SCHEMA = "_kind byte, _bucket int, _range int, _batch long, _at long, _n long, _held_out boolean, _a binary, _b binary, _c binary, _d binary"


def _record(keep: pa.Schema, size: int = 1, kept: list | None = None, **columns) -> pa.RecordBatch:
    """A record batch of the exchanges; columns that aren't named are null."""
    cols = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array([columns.get(c)] * size, t) for c, t in _COLUMNS.items()]
    return pa.RecordBatch.from_arrays([*(kept or [pa.nulls(size, f.type) for f in keep]), *cols], names=[*keep.names, *_COLUMNS])


def counted(docs: DataFrame, keep: list[str], n: int) -> DataFrame:
    """Texts, batches of tokens, samples of places and the ranges' answers to them, as rows with the
    partition (``_bucket``) in which their batch is scored, and the ranges' totals."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, held, train, size, texts = Slots(), [], [], 0, 0
        task, number, fields = TaskContext.get().partitionId() << 32, 0, None

        def asked(batch: int, asks: Asks, vocabulary: np.ndarray, pair_counts: np.ndarray, word_counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for b, p, c, w, d in asks.rows(vocabulary, pair_counts, word_counts, n):
                yield _record(fields, _kind=ASK, _bucket=b, _range=b, _batch=batch, _a=p, _b=c, _c=w, _d=d)

        def flush() -> Iterator[pa.RecordBatch]:
            batch, at, mine = task + number, np.concatenate(held), np.concatenate(train)
            at, vocabulary = renumbered(at, slots.hash)
            before = np.r_[at[-1:], at[:-1]]  # each text ends with the end token, which the next one starts after
            asks = Asks(vocabulary, before, at)
            yield from asked(batch, asks, vocabulary, np.add.reduceat(mine[asks.order].astype(np.int64), asks.first), np.bincount(at, mine, len(vocabulary)))
            yield _record(fields, _kind=TOKENS_OF, _bucket=_home(batch, n), _batch=batch, _a=packed(at), _c=vocabulary.tobytes())
            del asks
            some = np.flatnonzero(mine)[::EVERY]
            if len(some):
                both, own = renumbered(np.r_[before[some], at[some]], vocabulary)
                x, y = both[: len(some)], both[len(some) :]
                asks, batch = Asks(own, x, y), batch + 1
                yield from asked(batch, asks, own, np.zeros(len(asks.pairs)), np.zeros(len(own)))
                yield _record(fields, _kind=PLACES, _bucket=_home(batch, n), _batch=batch, _a=packed(both), _c=own.tobytes())

        for b in batches:
            fields = pa.schema([b.schema.field(c) for c in keep])
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                words = [[*word_bytes(t), END] for t in part.column("text").to_pylist()]
                lengths = np.array([len(w) for w in words])
                out = part.column("held_out")
                held.append(slots.of(words))
                train.append(np.repeat(~out.to_numpy(zero_copy_only=False), lengths))
                k, batch = part.num_rows, task + number
                yield _record(fields, k, [part.column(c) for c in keep], _kind=TEXT, _bucket=_home(batch, n), _batch=batch, _at=pa.array(np.arange(texts, texts + k)), _n=pa.array(lengths), _held_out=out)
                size, texts = size + int(lengths.sum()), texts + k
                if size >= TOKENS:
                    yield from flush()
                    held, train, size, texts, number = [], [], 0, 0, number + 2
                    if len(slots.slot) > REMEMBERED:
                        slots = Slots()
        if held:
            yield from flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, bucket, fields = [], -1, None
        for b in batches:
            fields = pa.schema([b.schema.field(c) for c in keep])
            ask = b.column("_kind").to_numpy() == ASK
            if ask.any():
                own = b.filter(pa.array(ask))
                bucket = own.column("_range")[0].as_py()
                asks += zip(*(own.column(c).to_pylist() for c in ("_batch", "_a", "_b", "_c", "_d")), strict=True)
            if not ask.all():
                yield b.filter(pa.array(~ask))
        if not asks:
            return
        out, tokens, types = answered(asks)
        del asks
        yield _record(fields, _kind=TOTAL, _at=tokens, _n=types)
        for batch, p, w, c in out:
            yield _record(fields, _kind=ANSWER, _bucket=_home(batch, n), _range=bucket, _batch=batch, _a=p, _b=w, _c=c)

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), _SCHEMA])
    return stored(deal(docs.mapInArrow(lean(emit), schema), n, "_bucket").mapInArrow(lean(total), schema))


def renumbered(at: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with gaps closed, and the words that are left."""
    used = np.zeros(len(vocabulary), dtype=bool)
    used[at] = True
    return (np.cumsum(used, dtype=np.int64) - 1)[at], vocabulary[used]


def _batches(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple], pa.Table]]:
    """(batch, tokens, vocabulary, answers, all rows) of each batch whose tokens are rows of ``kind``."""
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got)
    del got
    answers: dict[int, list[tuple]] = {}
    own = rows.filter(pa.array(rows.column("_kind").to_numpy() == ANSWER))
    for batch, *x in zip(*(own.column(c).to_pylist() for c in ("_batch", "_range", "_a", "_b", "_c")), strict=True):
        answers.setdefault(batch, []).append(tuple(x))
    tokens = rows.filter(pa.array(rows.column("_kind").to_numpy() == kind))
    for batch, a, c in zip(*(tokens.column(x) for x in ("_batch", "_a", "_c")), strict=True):
        batch = batch.as_py()
        yield batch, unpacked(a.as_py()), np.frombuffer(c.as_py(), dtype="<u8"), answers.pop(batch), rows


def tune(model: Model, rows: DataFrame, n: int) -> None:
    """Fit the interpolation weights on every EVERY-th training token: tasks count tokens by level of
    the context and ratio of the two estimates, and the driver sees these counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, both, vocabulary, answers, _ in _batches(batches, PLACES):
            before, at = both[: len(both) // 2], both[len(both) // 2 :]
            pairs, levels, _ = Asks(vocabulary, before, at).answers(answers)
            key, k = np.unique(np.stack([levels[before], model.odds(levels[at], levels[before], pairs)], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(k)], names=["level", "ratio", "n"])

    places = rows.where((F.col("_kind") == PLACES) | (F.col("_kind") == ANSWER) & (F.col("_batch") % 2 == 1))
    got = deal(places, n, "_bucket").mapInArrow(lean(run), "level long, ratio long, n long").groupBy("level", "ratio").agg(F.sum("n").alias("n")).collect()  # LEVELS times some hundred ratios
    if got:
        at, ratio, k = (np.array([r[c] for r in got], dtype=np.int64) for c in ("level", "ratio", "n"))
        order = np.lexsort((ratio, at))
        model.tune(at[order], ratio[order], k[order].astype(np.float64))


def score(docs: DataFrame, held_out, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with held_out boolean, n_tokens, n_known, train_tokens long,
    base_score, score double; texts where ``held_out`` is false train the model."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark, docs)
    own = docs.select(*keep, F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = counted(own, keep, n)
    sums = rows.where(F.col("_kind") == TOTAL).agg(F.sum("_at"), F.sum("_n")).first()
    model = Model(sums[0] or 0, sums[1] or 0)
    tune(model, rows, n)
    floor = float(np.log10(model.tokens + model.types + 1))
    names = [*keep, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, vocabulary, answers, rows in _batches(batches, TOKENS_OF):
            before = np.r_[at[-1:], at[:-1]]
            pairs, levels, counts = Asks(vocabulary, before, at).answers(answers)
            lp = model.log_probabilities(levels[at], levels[before], pairs)
            texts = rows.filter(pa.array((rows.column("_kind").to_numpy() == TEXT) & (rows.column("_batch").to_numpy() == batch))).sort_by("_at")
            first = np.r_[0, np.cumsum(texts.column("_n").to_numpy())[:-1]]
            exact = counts[at]
            known, base, total = np.add.reduceat((exact > 0).astype(np.int64), first), np.add.reduceat(np.log10(exact + 1.0) - floor, first), np.add.reduceat(lp, first)
            cols = [*(texts.column(c) for c in keep), texts.column("_held_out"), texts.column("_n"), pa.array(known), pa.array(np.full(len(first), model.tokens)), pa.array(base), pa.array(total)]
            yield from pa.Table.from_arrays(cols, names=names).combine_chunks().to_batches(20_000)

    kept = rows.where(F.col("_kind").isin(TEXT, TOKENS_OF) | (F.col("_kind") == ANSWER) & (F.col("_batch") % 2 == 0))
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep), "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return deal(kept, n, "_bucket").mapInArrow(lean(run), schema)


def language_model(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return score(docs, crc_bucket("doc_id", held_out_of) == held_out, ["doc_id"])
