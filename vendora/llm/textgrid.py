"""Vectorised word and shingle hashes over the bytes of an Arrow text column.

All helpers work on one Arrow batch inside a Spark task.  Words are the maximal
runs of ``[^\\x20\\x09-\\x0D]`` (bytes of UTF-8: no continuation byte falls in
that set), lower-cased for A-Z only.  A null text counts as empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18            # bytes hashed at a time
SLICE = 2 << 20            # text bytes of the row slices handed to callers
LONG = 256                 # bytes from which on a word's hash is a cryptographic one
BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# everything in ASCII but letters and digits
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    """BASE**i and BASE**-i mod 2**64 for i < n (kept, grown by doubling)."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 12)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, base & M64, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(table, column: str = "text", limit: int | None = None):
    """Row slices of a batch whose text stays near ``limit`` bytes (one row at least)."""
    limit = limit or SLICE
    n = table.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    lo, base = 0, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield table.slice(lo, hi - lo)
        lo, base = hi, int(ends[hi - 1])


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0]:offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


# scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, kana, bopomofo, ideographs, Yi
UNSPACED = np.array([(0x0E00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
                     (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)])


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each character of a script without spaces, in text order."""
    at = np.flatnonzero(data >= 0xE0)
    long = data[at] >= 0xF0
    size = 3 + long
    at, long, size = (x[at + size <= len(data)] for x in (at, long, size))
    code = np.zeros(len(at), np.int64)
    for j in range(4):
        code = np.where(j < size, code << 6 | data[np.minimum(at + j, len(data) - 1)] & 63, code) if len(at) else code
    code &= np.where(long, 0x1FFFFF, 0xFFFF)
    found = np.searchsorted(UNSPACED[:, 0], code, "right") - 1
    lone = (found >= 0) & (code <= UNSPACED[found, 1])
    return at[lone], (at + size)[lone]


class Words:
    """Words of a slice: start, end (byte positions), 64-bit hash, row pointer.

    ``ptr[i]:ptr[i+1]`` are the words of row i.  Words also end at the byte positions
    ``cuts``.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, gaps=IS_SPACE, cuts=None):
        gap = gaps[data]
        prev = np.empty(len(data) + 1, bool)
        prev[0] = True
        prev[1:] = gap
        cut = offs[(offs >= 0) & (offs <= len(data))]
        if cuts is not None:
            cut = np.concatenate([cut, cuts])
        first = prev.copy()
        first[cut] = True
        last = np.append(gap, True)
        last[cut] = True
        self.start = np.flatnonzero(~gap & first[:-1])
        self.end = np.flatnonzero(~gap & last[1:]) + 1
        self.ptr = np.searchsorted(self.start, offs)
        self.data = LOWER[data] if lower else data
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out, n, i = [], len(self.start), 0
        while i < n:
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + PIECE, "right")))
            hi = self.end[j - 1]
            power, inverse = _powers(hi - lo + 1)
            c = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[:-1], out=c[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out.append(mix((c[e] - c[s]) * inverse[s] + (e - s).astype(np.uint64)))
            i = j
        h = np.concatenate(out) if out else np.zeros(0, np.uint64)
        # sums of powers modulo 2**64 are blind to some patterns of a thousand bytes and more, whatever the base
        for w in np.flatnonzero(self.end - self.start > LONG).tolist():
            word = self.data[self.start[w]:self.end[w]].tobytes()
            h[w] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def prefixes(self, lengths) -> dict:
        """Hash of the first L bytes of each word for L in ``lengths`` (of the
        whole word where it is shorter)."""
        size, h, out = self.end - self.start, np.zeros(len(self.start), np.uint64), {}
        for j in range(max(lengths)):
            inside = j < size
            at = np.minimum(self.start + j, max(len(self.data) - 1, 0))
            h = np.where(inside, h * np.uint64(BASE) + self.data[at] + np.uint64(1), h) if len(h) else h
            if j + 1 in lengths:
                out[j + 1] = mix(h + np.uint64(j + 1 << 56))
        return out


def words_of(col, lower: bool = True, gaps=IS_SPACE) -> Words:
    data, offs = text_bytes(col)
    return Words(data, offs, lower, gaps)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row pointer) of the k-word shingles, in text order, repeats kept.

    A row with 1..k-1 words gives its whole sequence as one shingle; a row
    without words gives none.
    """
    h, ptr = words.hash, words.ptr
    n = np.diff(ptr)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_ptr = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = ptr[row] + (np.arange(out_ptr[-1]) - out_ptr[row])
    width = np.minimum(n, k)[row]
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        use = j < width
        term = np.where(use, h[np.minimum(at + j, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else s
        s = s * np.uint64(0xD6E8FEB86659FD93) + term
    return mix(s + width.astype(np.uint64)), out_ptr


def shingle_bytes(words: Words, ptr: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the words of each shingle that ``shingles`` gives."""
    n = np.diff(words.ptr)
    row = np.repeat(np.arange(len(n)), np.diff(ptr))
    at = words.ptr[row] + (np.arange(ptr[-1]) - ptr[row])
    total = np.concatenate([[0], np.cumsum(words.end - words.start)])
    return total[at + np.minimum(n, k)[row]] - total[at]


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits (Spark's long)."""
    return h.view(np.int64)
