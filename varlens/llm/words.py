"""Words of Arrow text batches as numpy arrays.

A word is a run of bytes other than the six ASCII white-space ones, which for UTF-8 is
`[^\\x20\\x09-\\x0D]+`. Texts are never cut: a block is a few whole texts. Words and lines are
compared by 64-bit hashes (a polynomial over random byte codes, then a finaliser), so two different
words are taken for equal with a chance near 2**-64 a pair.
"""

import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CODE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
STEP = pow(3, 41, 2**64)
BACK = pow(STEP, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        x[0] = 1
        have = np.cumprod(x)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def released() -> None:
    """Give memory that a finished task leaves unused back to the system: its Python worker lives on, idle, beside the executor."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if name := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(name), "malloc_trim", None)
        if trim:
            trim(0)


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offset; a null counts as an empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    valid, starts, data = col.buffers()
    if len(col) == 0 or starts is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(starts, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)
    if col.null_count and (np.diff(off)[~np.asarray(col.is_valid())] > 0).any():
        return text_column(pa.record_batch([col.fill_null("")], [name]), name)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, name: str, most: int = BLOCK_BYTES):
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about `most` bytes."""
    buf, off = text_column(batch, name)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


class Hasher:
    """Hashes of any spans of one block."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODE[buf] * powers(STEP, n), out=self.sums[1:])
        self.back = powers(BACK, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def windows(h: np.ndarray, word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every window of n words that lies in one text."""
    count = np.maximum(np.diff(word_off) - (n - 1), 0)
    at = ranges(word_off[:-1], count)
    x = np.zeros(len(at), np.uint64)
    for k in range(n):
        x = x * np.uint64(STEP) + h[at + k]
    return at, mix(x)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    out = np.repeat(np.asarray(starts) - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


def member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of the keys that are among values (sorted, distinct)."""
    if not len(values) or not len(keys):
        return np.zeros(0, np.int64)
    hint = np.zeros(1 << 20, bool)
    hint[values >> np.uint64(44)] = True
    at = np.flatnonzero(hint[keys >> np.uint64(44)])
    k = keys[at]
    found = np.minimum(np.searchsorted(values, k), len(values) - 1)
    return at[values[found] == k]


def repeated(keys: np.ndarray) -> np.ndarray:
    """The values, sorted, that occur in keys more than once."""
    s = np.sort(keys)
    return np.unique(s[1:][s[1:] == s[:-1]])


class Lookup:
    """Places of fixed 64-bit keys, by their top bits; keys that share a slot are searched."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.key, self.drop = np.asarray(keys, np.uint64), np.uint64(64 - bits)
        n, top = len(self.key), (self.key >> self.drop).astype(np.int64)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[top[::-1]] = np.arange(n)[::-1]
        rest = np.flatnonzero(self.slot[top] != np.arange(n))
        self.rest = rest[np.argsort(self.key[rest])]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[top[self.rest]] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, -1 for others."""
        if not len(self.key):
            return np.full(len(h), -1)
        top = (h >> self.drop).astype(np.int64)
        at = self.slot[top].astype(np.int64)
        is_ = (at >= 0) & (self.key[at] == h)
        look = np.flatnonzero(~is_ & self.crowded[top])
        at[~is_] = -1
        if len(look):
            k = self.key[self.rest]
            p = np.minimum(np.searchsorted(k, h[look]), len(k) - 1)
            hit = k[p] == h[look]
            at[look[hit]] = self.rest[p[hit]]
        return at
