"""Whole-text encoding with a byte-level BPE of the tokenizers library.

A text's ids are those of the tokenizer file; ``add_special_tokens=False``, and the spelling of a
special token inside a text is ordinary text.  Encoding a text is the concatenation of encoding
its pre-tokens, so the pre-tokens' ids are remembered between texts: most words of a corpus occur
again, and a look-up costs far less than the merge loop.  Texts are cut and looked up by operations on
whole arrays of bytes: a pre-token of up to ``KEY`` bytes is its own key, so different ones never meet.
The memory stays below ``CACHED`` entries.  Texts with characters outside Latin scripts and common punctuation are
encoded as a whole, because there the library's own pre-tokeniser decides what a letter is.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

from ._common import keeps

#: Entries after which the pre-token memory starts anew.
CACHED = 1_000_000
#: Longer pre-tokens are not remembered.
LONGEST = 64
#: Bytes of a pre-token that is found by its own bytes in arrays; longer ones are kept in a dictionary.
KEY = 24
#: Slots of the arrays (a power of two); characters of the texts that are looked up at once.
SLOTS, AT_ONCE = 21, 1 << 20
_SPACE, _BREAK, _LETTER, _DIGIT, _OTHER, _END = range(6)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

_open: dict[str, Encoder] = {}


def _class(kind: str) -> str:
    """Body of a character class: the letters (L) or numbers (N) below U+0250."""
    return "".join(rf"\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


class Encoder:
    """Encoder of one tokenizer file; ``encode`` maps texts to little-endian id bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.size = self.model.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(self.size, dtype=np.int64)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(token)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        # the tokenizer's own pattern, for the characters that ``usual`` lets through
        letters, digits = _class("L"), _class("N")
        self.words = re.compile(rf" ?[{letters}]+| ?[{digits}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")
        self.usual = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u20ac]*")
        kinds = np.full(0x20B0, _OTHER, dtype=np.uint8)
        kinds[0], kinds[0x20], kinds[[9, 10, 13]] = _END, _SPACE, _BREAK
        for c in range(0x250):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                kinds[c] = _LETTER if kind == "L" else _DIGIT
        self.kinds = kinds
        self._anew()

    def _anew(self) -> None:
        """Forget all pre-tokens."""
        self.held, self.full = 1, 0  # row 0 is no pre-token
        self.slots = np.zeros(1 << SLOTS, dtype=np.int32)
        self.keys = np.zeros((1 << 12, 3), dtype=np.uint64)
        self.spans = np.zeros((1 << 12, 2), dtype=np.int64)  # place of the first id in the pool, number of ids
        self.pool = np.zeros(1 << 14, dtype=self.dtype)
        self.long: dict[bytes, int] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens.  Those made of a space and letters are encoded many to a call: joined,
        they part at the same places, and the ids' byte lengths (a character each in a byte-level
        vocabulary) tell them apart."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        chunks = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        out: dict[str, bytes] = {}
        for chunk, e in zip(chunks, self.model.encode_batch_fast(["".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in chunk])
            at = [0, *(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1).tolist()]
            data, size = ids.tobytes(), self.dtype.itemsize
            out.update(zip(chunk, [data[size * a : size * z] for a, z in zip(at, at[1:], strict=False)], strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._whole(rest), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``; null is the empty text."""
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if t and not self.usual.fullmatch(t)]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        apart, group, size = set(odd), [], 0
        for i, t in enumerate(texts):
            if t and i not in apart:
                group.append(i)
                size += len(t)
                if size > AT_ONCE:
                    self._usual([texts[i] for i in group], group, out)
                    group, size = [], 0
        if group:
            self._usual([texts[i] for i in group], group, out)
        return out

    def starts(self, data: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of usual texts begin, in their UTF-8 bytes; a zero byte, which counts as
        a pre-token, stands behind each text."""
        kind = self.kinds[data]
        high = np.flatnonzero(data >= 0xC0)
        if len(high):
            lead = data[high].astype(np.int64)
            two, code = lead < 0xE0, (lead & 0x1F) << 6 | data[high + 1] & 0x3F
            three = high[~two]
            code[~two] = (lead[~two] & 0x0F) << 12 | (data[three + 1].astype(np.int64) & 0x3F) << 6 | data[three + 2] & 0x3F
            kind[high] = kind[high + 1] = self.kinds[code]
            kind[three + 2] = kind[three]
        blank = kind <= _BREAK
        run = np.where(blank, np.uint8(_SPACE), kind)
        start = np.empty(len(data), dtype=bool)
        start[0], start[1:] = True, run[1:] != run[:-1]
        # the last blank before a word stands alone, or goes with the word if it is a space
        before = np.flatnonzero(blank[:-1] & ~blank[1:] & (kind[1:] != _END))
        start[before] = True
        start[before + 1] = kind[before] != _SPACE
        mark = np.flatnonzero((data[:-2] == 0x27) & start[:-2])
        mark = mark[kind[mark + 1] == _LETTER]
        if len(mark):
            x, y = data[mark + 1], data[mark + 2]
            one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
            start[mark[one | two] + 1] = False
            start[mark[one] + 2] = True
            start[mark[two] + 3] = True
        return np.flatnonzero(start)

    def _find(self, key: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The row of each key (0: none)."""
        row = self.slots[slot]
        other = np.flatnonzero((self.keys.take(row, axis=0) != key).any(axis=1) & (row > 0))
        while len(other):
            slot[other] = slot[other] + 1 & (1 << SLOTS) - 1
            row[other] = self.slots[slot[other]]
            other = other[(self.keys.take(row[other], axis=0) != key[other]).any(axis=1) & (row[other] > 0)]
        return row

    def _insert(self, slot: np.ndarray, row: np.ndarray) -> None:
        """Give different keys' rows a slot each, from ``slot`` on."""
        while len(row):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = row[free]
            left = self.slots[slot] != row
            slot, row = slot[left] + 1 & (1 << SLOTS) - 1, row[left]

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """New rows for pre-tokens, without keys; their ids are put in the pool."""
        known = self._fresh([w.decode() for w in words])
        ids = [known[w.decode()] for w in words]
        size = np.array([len(x) // self.dtype.itemsize for x in ids], dtype=np.int64)
        joined = np.frombuffer(b"".join(ids), dtype=self.dtype)
        row = np.arange(self.held, self.held + len(words))
        while self.held + len(words) > len(self.keys):
            self.keys, self.spans = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.spans))
        while self.full + len(joined) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.spans[row, 0], self.spans[row, 1] = self.full + np.cumsum(size) - size, size
        self.pool[self.full : self.full + len(joined)] = joined
        self.held, self.full = self.held + len(words), self.full + len(joined)
        return row

    def _usual(self, texts: list[str], at: list[int], out: list[bytes]) -> None:
        """Put the ids of usual texts, none of them empty, at their places in ``out``."""
        blob = "\0".join(texts).encode() + bytes(1 + KEY)
        data = np.frombuffer(blob, dtype=np.uint8)
        start = self.starts(data[:-KEY])
        size = np.diff(np.r_[start, len(data) - KEY])
        text = np.cumsum(data[start] == 0)  # the zero behind a text counts for the next one and is dropped
        word = data[start] != 0
        start, size, text = start[word], size[word], text[word]
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=blob, strides=(1,))
        key = np.empty((len(start), 3), dtype=np.uint64)
        for k in range(3):
            key[:, k] = eight[np.minimum(start + 8 * k, len(eight) - 1)] & _MASK[np.clip(size - 8 * k, 0, 8)]
        h = key[:, 0] * _MIX[0] ^ key[:, 1] * _MIX[1] ^ key[:, 2] * _MIX[2]
        h ^= h >> np.uint64(32)
        slot = (h * _MIX[3] >> np.uint64(64 - SLOTS)).astype(np.int64)
        row = self._find(key, slot.copy())
        row[size > KEY] = 0
        miss = np.flatnonzero(row == 0)
        held, full = self.held, self.full
        if len(miss):
            words = [blob[s:e] for s, e in zip(start[miss].tolist(), (start[miss] + size[miss]).tolist(), strict=True)]
            fresh = [w for w in dict.fromkeys(words) if w not in self.long]
            if self.held + len(fresh) > CACHED:
                if self.held > 1:
                    self._anew()
                    return self._usual(texts, at, out)
                for i, ids in zip(at, self._whole(texts), strict=True):
                    out[i] = ids
                return None
            kept = [w for w in fresh if len(w) <= LONGEST]
            number = dict(zip(kept, self._rows(kept).tolist(), strict=True))
            held, full = self.held, self.full
            passing = [w for w in fresh if len(w) > LONGEST]
            number.update(zip(passing, self._rows(passing).tolist(), strict=True))
            row[miss] = [number.get(w) or self.long[w] for w in words]
            new, first = np.unique(row[miss], return_index=True)
            first = miss[first]
            short = size[first] <= KEY
            new, first = new[short], first[short]
            self.keys[new] = key[first]
            self._insert(slot[first], new)
            self.long.update((w, number[w]) for w in kept if len(w) > KEY)
        at_pool, count = self.spans.take(row, axis=0).T
        end = np.cumsum(count)
        ids = self.pool[np.repeat(at_pool - end + count, count) + np.arange(end[-1])]
        self.held, self.full = held, full
        ends = np.r_[0, end][np.searchsorted(text, np.arange(len(texts) + 1))].tolist()
        whole, width = ids.tobytes(), self.dtype.itemsize
        for i, s, e in zip(at, ends, ends[1:], strict=False):
            out[i] = whole[s * width : e * width]


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per Python worker, until a task of another kind comes."""
    keeps("encoder", _open.clear)
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def forget() -> None:
    """Drop the encoders of this process."""
    _open.clear()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
