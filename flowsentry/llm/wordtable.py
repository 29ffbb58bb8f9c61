"""Words of many texts as numpy arrays, and a table from word hashes to
numbers.  Operators that need something per word (token ids, counts,
probabilities, weights) work it out once per distinct word and look it up for
all others without a Python object per word.

A word is a run of bytes without ASCII white space.  Its 64-bit hash is a
polynomial over its bytes, taken from one running sum per block; with ten
million distinct words the odds of any collision are about 3 in a million.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int):
    """Powers 0..n-1 of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((_BASE, _UNBASE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hashes of the byte runs [start, end), in order of their starts; never 0.
    Long data are taken in blocks, so no array is larger than a block and its
    last run."""
    if len(data) > block and len(starts) > 1:
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), block)))
        parts = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(starts)]) if b > a]
        if len(parts) > 1:
            out = [span_hashes(data[starts[a]:int(ends[a:b].max())], starts[a:b] - starts[a], ends[a:b] - starts[a])
                   for a, b in parts]
            return np.concatenate(out)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1))


class Words:
    """The words of a list of texts (as bytes): ``hash`` of each, in order, and
    ``first``, the number of the first word of each text (one more entry than
    texts)."""

    def __init__(self, texts: list[bytes], space: np.ndarray = _SPACE):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        self.raw = joined
        gap = space[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.r_[0, edge]
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.starts = self.starts[:len(self.ends)]
        self.hash = span_hashes(self.data, self.starts, self.ends)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.r_[0, np.cumsum(sizes)]
        self.first = np.searchsorted(self.starts, self.text_starts)

    def word(self, k: int) -> bytes:
        return self.raw[self.starts[k]:self.ends[k]]

    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class HashTable:
    """Hashes to the numbers 0, 1, 2... in the order of their adding."""

    def __init__(self, bits: int = 16):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)

    def clear(self) -> None:
        self._clear(16)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if unknown."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.at[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        last = (1 << self.bits) - 1
        while len(left):
            slot[left] = (slot[left] + 1) & last
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Add distinct unknown hashes."""
        if 3 * (self.n + len(h)) > 2 * len(self.keys):
            known, at = self.keys[self.keys != 0], self.at[self.keys != 0]
            order = np.argsort(at)
            bits = max(self.bits + 1, int(2 * (self.n + len(h))).bit_length())
            self._clear(bits)
            self._place(known[order], np.arange(len(known), dtype=np.int32))
            self.n = len(known)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        last = (1 << self.bits) - 1
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            done = self.keys[slot] == h
            self.at[slot[done]] = number[done]
            h, number, slot = h[~done], number[~done], (slot[~done] + 1) & last


class WordValues:
    """What is known per distinct word: a row of numbers of variable length
    (``width`` None) or of fixed width, worked out by ``learn(words) -> list of
    arrays or one 2-d array`` for words not met before.  Starts afresh when
    more than ``limit`` words are known; what one block needs is always kept."""

    def __init__(self, learn, dtype, limit: int = 800_000):
        self.learn, self.limit, self.dtype = learn, limit, dtype
        self._reset()

    def _reset(self) -> None:
        self.table = HashTable()
        self.used = 0
        self.store = np.zeros(1 << 16, self.dtype)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _keep(self, name: str, n: int) -> np.ndarray:
        have = getattr(self, name)
        if n > len(have):
            grown = np.zeros(max(n, 2 * len(have)), have.dtype)
            grown[:len(have)] = have
            setattr(self, name, grown)
        return getattr(self, name)

    def _add(self, words: Words, number: np.ndarray) -> None:
        unknown = np.flatnonzero(number < 0)
        if not len(unknown):
            return
        h, first = np.unique(words.hash[unknown], return_index=True)
        values, sizes = self.learn([words.word(k) for k in unknown[first]])
        n0, n1, u1 = self.table.n, self.table.n + len(h), self.used + len(values)
        self.table.add(h)
        self._keep("store", u1)[self.used:u1] = values
        self._keep("start", n1)[n0:n1] = self.used + np.cumsum(sizes) - sizes
        self._keep("size", n1)[n0:n1] = sizes
        self.used = u1

    def numbers(self, words: Words) -> np.ndarray:
        """The number of every word of a block, learning what is new."""
        number = self.table.find(words.hash)
        if number.size and number.min() < 0:
            if self.table.n > self.limit:
                self._reset()
                number[:] = -1
            self._add(words, number)
            number = self.table.find(words.hash)
        return number

    def rows(self, number: np.ndarray):
        """The values of words in order, and the size of each word's part."""
        size = self.size[number].astype(np.int64)
        before = np.cumsum(size) - size
        total = int(size.sum())
        return self.store[np.repeat(self.start[number] - before, size) + np.arange(total)], size


#: Every ASCII byte but letters and digits separates words; bytes of longer
#: UTF-8 characters belong to words (see word_bytes).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8 of a text; null is empty."""
    return (text or "").lower().encode("utf-8", "surrogatepass")


#: Characters that end a sentence as ``.`` does, and a line as a newline does.
STOPS = "。｡．！？؟۔।॥…‼⁇⁈⁉‽։።፧"
LINES = "\x85\u2028\u2029"
#: Blocks of the scripts that put no space between words.
_UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035"
             "\u3038-\u303b\u3040-\u30ff\u3100-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f"
             "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff")
_IN_UNSPACED = re.compile(f"[{_UNSPACED}]")
_AFTER_UNSPACED = re.compile(f"(?<=[{_UNSPACED}])(?=[^{_UNSPACED} ])")


class _Letters(dict):
    """What ``str.translate`` makes of each character met so far."""

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        if code < 128:
            self[code] = code
        elif c in STOPS:
            self[code] = "."
        elif c in LINES:
            self[code] = "\n"
        elif 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or (kind == "Cf" and code != 0x200B):
            self[code] = None                                  # variation selectors, soft hyphens, joiners, ...
        elif kind[0] not in "LNM":
            self[code] = " "
        else:
            self[code] = f" {c}" if kind[0] != "M" and _IN_UNSPACED.match(c) else c
        return self[code]


_LETTERS = _Letters()
#: Anything but ASCII and the letters, digits and marks of the first blocks, which stay as they are.
_ODD = re.compile("[^\\x00-\\x7f%s]" % "".join(chr(k) for k in range(128, 0x530) if unicodedata.category(chr(k))[0] in "LNM"))


def word_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8 of a text for splitting at NOT_ALNUM; null is empty.
    Beyond ASCII too, what is no letter, digit or mark becomes a space (or the
    ASCII sign that ends a sentence or line alike), invisible characters go,
    and in scripts without spaces every character is a word."""
    text = (text or "").lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_LETTERS)
        if _IN_UNSPACED.search(text):
            text = _AFTER_UNSPACED.sub(" ", text)
    return text.encode("utf-8", "surrogatepass")


def spread(counts: np.ndarray):
    """For runs of the given sizes: the run of each element and its place."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def sum_runs(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[k]:edges[k+1]]; 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[edges[1:]] - total[edges[:-1]]
