"""N-best SentencePiece segmentation of whole texts, and decoding.

The lattice of a text has an edge for each stretch that is a piece (its score is the model's), and
for each character that no piece holds an edge of its byte pieces (score: the lowest usual piece's
less 10).  Forward Viterbi gives the best score up to every place; a search backward from the end
uses it as its heuristic.  The heuristic is exact, so A-star takes complete paths from its queue in
falling order of score, and the first n are the n best.

No piece of such a model holds a word mark after another character, so the lattice falls apart at
the marks: a text's best path is its chunks' best paths, and any of the n best paths differs from
it only in the n - 1 chunks that lose least by their own second-best path (if it differed in
another one, n paths would be at least as good).  Chunks are met again and again: each is solved
once a worker (many at a time, by array operations) for its best path and that least loss, and
A-star runs on the lattice of those n - 1 chunks alone.  A model with pieces across marks is
searched as one lattice.

Equal scores: the path that loses in the earlier chunk, then the one with the longer piece where two
paths of a chunk part (seen from its end), comes first.  The scores are the model file's: those of a
BPE model are merge ranks, no log-likelihoods, so its best path here is the best sum of ranks and not
the one that the merges give.  Null and empty texts have one path, of no piece, with score 0; a text with fewer than
n paths has them all; other columns are not read; repeated rows are rows of their own.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keeps, lean, small_batches

MARK = "▁"
BEST, REMEMBERED, LONGEST = 4, 600_000, 48
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_SCORE, _LOSS, _IDS, _SAID = map(itemgetter, range(4))
_open: dict[str, Pieces] = {}


class Pieces:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte.items()}
        self.raw = [bytes([self.bytes_of[i]]) if i in self.bytes_of else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.unknown = sp.unk_id()
        self.piece = {self.text[i]: (i, sp.get_score(i)) for i in usual}
        self.single = {p for p in self.piece if len(p) == 1}
        self.longest = max(map(len, self.piece))
        self.other = min((s for _, s in self.piece.values() if s > -1e8), default=0.0) - 10.0
        self.parts = not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p[1:] or "\n" in p[:-1] for p in self.piece)
        keys = np.array([self._hash(p) for p in self.piece], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([v[0] for v in self.piece.values()], dtype=np.int64)[order]
        self.scores = np.array([v[1] for v in self.piece.values()])[order]
        # most stretches are no piece: a table of hash prefixes, small enough to stay in cache, says so
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[self.keys >> np.uint64(42)] = True
        self.known: dict[str, tuple[float, float, bytes, bytes]] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, bytes, bytes]]] = {}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_STEP) + ord(c) + 1) & (1 << 64) - 1
        return h ^ h >> 32

    def into(self, text: str, e: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """Edges (start, score, ids) into place ``e`` of the lattice, longest first."""
        piece, out = self.piece, []
        for s in range(max(0, e - self.longest), e):
            if (p := piece.get(text[s:e])) is not None:
                out.append((s, p[1], (p[0],)))
        if not out or out[-1][0] != e - 1:
            raw = text[e - 1].encode("utf-8", "surrogatepass")
            out.append((e - 1, self.other, tuple(self.byte.get(b, self.unknown) for b in raw) if self.byte else (self.unknown,)))
        return out

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """The edges into each place of the lattice."""
        return [[], *(self.into(text, e) for e in range(1, len(text) + 1))]

    def forward(self, text: str) -> np.ndarray:
        """Viterbi: the best score up to every place."""
        best, piece, longest, other = [0.0] * (len(text) + 1), self.piece, self.longest, self.other
        for e in range(1, len(text) + 1):
            top, last = -np.inf, None
            for s in range(max(0, e - longest), e):
                last = piece.get(text[s:e])
                if last is not None and (x := best[s] + last[1]) > top:
                    top = x
            best[e] = max(top, best[e - 1] + other) if last is None else top
        return np.array(best)

    def nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of one lattice: forward Viterbi, then backward A-star.  Equal scores:
        the path with the longer piece where the two part, seen from the end.

        The heuristic is exact and each entry of the queue stands for paths of its own, so more entries
        than paths that are still wanted are never needed: memory doesn't grow with the search."""
        best = self.forward(text)
        queue: list = [(-float(best[-1]), 0, len(text), 0.0, None)]
        out, count = [], 0
        while queue and len(out) < n:
            _, _, at, behind, tail = heapq.heappop(queue)
            if not at:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((behind, tuple(ids)))
                continue
            for s, x, ids in reversed(self.into(text, at)):
                count -= 1  # of equal scores the one pushed last goes on
                heapq.heappush(queue, (-(float(best[s]) + x + behind), count, s, x + behind, (ids, tail)))
            if len(queue) > n - len(out):
                queue = heapq.nsmallest(n - len(out), queue)
        return out

    def solve(self, chunks: list[str]) -> None:
        """Remember (best score, least loss of another path, ids, what they decode to) of new chunks."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.ranked.clear()
        plain = []
        for c in chunks:
            if len(c) <= LONGEST and self.single.issuperset(c):
                plain.append(c)
            else:
                two = self.nbest(c, 2)
                self.known[c] = (two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf, np.array(two[0][1], dtype="<u4").tobytes(), self._joined(two[0][1]))
        plain.sort(key=len)
        for s in range(0, len(plain), 4_096):
            self._solve_many(plain[s : s + 4_096])

    def _solve_many(self, chunks: list[str]) -> None:
        n, size = len(chunks), np.array([len(c) for c in chunks])
        width = int(size.max())
        grid = np.zeros((n, width), dtype=np.uint64)
        grid[np.arange(width)[None, :] < size[:, None]] = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        best = np.full((n, width + 1), -np.inf)
        second = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), dtype=np.int64), np.zeros((n, width + 1), dtype=np.int64)
        # hashes of the stretches of each length, then the dynamic programme over their ends
        score = np.full((self.longest + 1, n, width), -np.inf)
        ids = np.zeros((self.longest + 1, n, width), dtype=np.int32)
        h = np.zeros((n, width), dtype=np.uint64)
        for l in range(1, min(self.longest, width) + 1):
            h = h[:, : width - l + 1] * _STEP + grid[:, l - 1 :] + np.uint64(1)
            key = h ^ h >> np.uint64(32)
            row, col = np.nonzero(self.seen[(key >> np.uint64(42)).astype(np.int64)] & (np.arange(l, width + 1)[None, :] <= size[:, None]))
            at = np.minimum(np.searchsorted(self.keys, key[row, col]), len(self.keys) - 1)
            hit = self.keys[at] == key[row, col]
            row, col, at = row[hit], col[hit], at[hit]
            score[l, row, col] = self.scores[at]
            ids[l, row, col] = self.ids[at]
        for e in range(1, width + 1):
            for l in range(min(e, self.longest), 0, -1):
                own = score[l, :, e - l]
                r = np.flatnonzero(own > -np.inf)
                if not len(r):
                    continue
                new, old = best[r, e - l] + own[r], best[r, e]
                more = new > old
                second[r, e] = np.where(more, old, np.maximum(second[r, e], new))
                r = r[more]
                best[r, e], back[r, e], piece[r, e] = new[more], l, ids[l, r, e - l]
        rows, at = np.arange(n), size.copy()
        loss, path, steps = np.full(n, np.inf), np.zeros((n, width), dtype="<u4"), np.zeros(n, dtype=np.int64)
        while (live := at > 0).any():
            r = rows[live]
            loss[r] = np.minimum(loss[r], best[r, at[r]] - second[r, at[r]])
            steps[r] += 1
            path[r, width - steps[r]] = piece[r, at[r]]
            at[r] -= back[r, at[r]]
        total = best[rows, size].tolist()
        for c, t, x, p, k in zip(chunks, total, loss.tolist(), path, steps.tolist(), strict=True):
            self.known[c] = (t, x, p[width - k :].tobytes(), self._joined(p[width - k :].tolist()))

    def ways(self, chunk: str, n: int) -> list[tuple[float, bytes, bytes]]:
        """The n best (loss, ids, what they decode to) of a chunk."""
        key = (chunk, n)
        if key not in self.ranked:
            found = self.nbest(chunk, n)
            self.ranked[key] = [(found[0][0] - s, np.array(ids, dtype="<u4").tobytes(), self._joined(ids)) for s, ids in found]
        return self.ranked[key]

    def normalized(self, text: str | None) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def text_nbest(self, texts: list[str | None], n: int) -> list[list[tuple[float, bytes]]]:
        """For each text, its n best (score, ids as little-endian unsigned 32-bit integers)."""
        return [[x[:2] for x in found] for found in self.text_decoded(texts, n)]

    def text_decoded(self, texts: list[str | None], n: int) -> list[list[tuple[float, bytes, bytes]]]:
        """``text_nbest`` with the UTF-8 bytes that each path's ids decode to; a chunk's ids are decoded
        when it is solved, as decoding joins what pieces stand for."""
        if not self.parts:
            found = [self.nbest(self.normalized(t), n) if t else [(0.0, ())] for t in texts]
            return [[(s, np.array(i, dtype="<u4").tobytes(), self._unspaced(self._joined(i))) for s, i in f] for f in found]
        cut = [_CHUNK.findall(self.normalized(t)) for t in texts]
        known = self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > REMEMBERED:
            new.update(c for chunks in cut for c in chunks)
            known.clear()
            self.ranked.clear()
        if new:
            self.solve(sorted(new))
        return [self._combined(chunks, n) for chunks in cut]

    def _combined(self, chunks: list[str], n: int) -> list[tuple[float, bytes, bytes]]:
        own = list(map(self.known.__getitem__, chunks))
        total, parts, said = sum(map(_SCORE, own)), list(map(_IDS, own)), list(map(_SAID, own))
        loss = np.fromiter(map(_LOSS, own), np.float64, len(own))
        out = [(total, b"".join(parts), self._unspaced(b"".join(said)))]
        if n < 2 or not len(loss):
            return out
        order = np.lexsort((np.arange(len(loss)), loss)) if len(loss) <= n - 1 else None
        if order is None:
            limit = np.partition(loss, n - 2)[n - 2]
            low, equal = np.flatnonzero(loss < limit), np.flatnonzero(loss == limit)
            order = np.sort(np.concatenate([low, equal[: n - 1 - len(low)]]))
        places = sorted(int(i) for i in order if np.isfinite(loss[i]))
        choices = [(0.0, ())]  # (loss, ways of the places so far): the n best combinations
        for i in places:
            ways = self.ways(chunks[i], n)
            choices = sorted(((x + w[0], (*c, k)) for x, c in choices for k, w in enumerate(ways)), key=lambda c: (c[0], tuple(-k for k in c[1])))[:n]
        for x, c in choices:
            if any(c):
                ids, texts = list(parts), list(said)
                for i, k in zip(places, c, strict=True):
                    _, ids[i], texts[i] = self.ways(chunks[i], n)[k]
                out.append((total - x, b"".join(ids), self._unspaced(b"".join(texts))))
        return out[:n]

    def _joined(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    @staticmethod
    def _unspaced(data: bytes) -> bytes:
        return data[1:] if data.startswith(b" ") else data

    def decoded(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that pieces stand for: a byte piece is its byte, a mark a space."""
        return self._unspaced(self._joined(ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of pieces (bytes that are no UTF-8 become U+FFFD)."""
        return self.decoded(ids).decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    """The model of a file, one a worker, until a task of another kind comes."""
    keeps("pieces", _open.clear)
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_nbest(docs: DataFrame, n: int = BEST, path: str | None = None, ids: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, rank int (from 1), score double, n_pieces long, ids_crc32 long and, with ``ids``,
    ids array<int>: the n best segmentations of each document.  With ``decoded`` also text_crc32
    long, of the UTF-8 bytes of what the ids decode to, and same_text boolean."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in range(0, len(texts), 128):
                found = model.text_decoded(texts[s : s + 128], n)
                row = pa.array(np.repeat(np.arange(s, s + len(found)), [len(f) for f in found]))
                flat = [(k, *x) for f in found for k, x in enumerate(f, 1)]
                cols = [b.column("doc_id").take(row), pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.float64()), pa.array([len(f[2]) // 4 for f in flat], pa.int64()), pa.array([zlib.crc32(f[2]) for f in flat], pa.int64())]
                if ids:
                    cols.append(pa.array([np.frombuffer(f[2], "<u4").astype(np.int32) for f in flat], pa.list_(pa.int32())))
                if decoded:
                    back = [f[3] for f in flat]
                    given = [(t or "").encode("utf-8", "surrogatepass") for t in texts[s : s + 128]]
                    cols.append(pa.array(map(zlib.crc32, back), pa.int64()))
                    cols.append(pa.array([t == given[i - s] for t, i in zip(back, row.to_pylist(), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", *["ids"] * ids, *["text_crc32", "same_text"] * decoded]
    key = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lean(run, "pieces"), f"doc_id {key}, rank int, score double, n_pieces long, ids_crc32 long" + ", ids array<int>" * ids + ", text_crc32 long, same_text boolean" * decoded)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (with ids array<int>) with a column ``decoded`` instead of ``ids``; null stays null."""
    path = path or default_path()
    kept = [f for f in rows.schema.fields if f.name not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts = [None if i is None else model.decode(np.array(i, dtype=np.int64)) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), "decoded"])

    return rows.mapInArrow(lean(run, "pieces"), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded string"]))
