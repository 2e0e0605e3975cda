"""Words of a chunk of Arrow text as numpy arrays: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RUN = 1 << 16  # long words whose blocks are laid out at once
_BLOCK_STEP = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_class(separators: str) -> np.ndarray:
    """For each byte, 1 unless it is one of ``separators`` (ranges as in a regex class, bytes under 0x80)."""
    import re

    one = re.compile(f"[{separators}]")
    return np.array([0 if i < 128 and one.match(chr(i)) else 1 for i in range(256)], np.uint8)


SPACED = byte_class(r"\x20\x09-\x0D")
ALNUM = byte_class(r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F")  # ASCII letters and digits, and all above ASCII
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``start``/``end``: byte places of each word; ``first``: n_docs+1 places in these arrays."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED, lower: bool = False, hashes: bool = True) -> Words:
    """Maximal runs of word bytes inside each document."""
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    inside = classes[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= inside[:-1] ^ 1
    ends[:-1] &= inside[1:] ^ 1
    full = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    words = Words(data, start, end, first)
    if hashes:
        words.hash = hashed(data, start, end)
    return words


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: blocks of 8 bytes are mixed with their place, one by one, and added up.

    Each block passes ``mix`` before it meets another, so no pattern of letters
    makes blocks cancel out, as they do in a polynomial of the bytes modulo 2**64.
    """
    size = end - start
    out = size.astype(np.uint64) * _BLOCK_STEP
    near = np.concatenate([data, np.zeros(8, np.uint8)])
    block = np.ndarray(len(data) + 1, "<u8", near, strides=(1,))  # the 8 bytes from each byte on
    with np.errstate(over="ignore"):
        left = np.minimum(size, 8)
        out += mix(block[start] & _FIRST_BYTES[left])
        long = np.flatnonzero(size > 8)
        for at in range(0, len(long), _RUN):
            some = long[at : at + _RUN]
            n = (size[some] - 1) >> 3  # blocks after the first
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first, n) + 1
            place = np.repeat(start[some], n) + 8 * k
            value = block[place] & _FIRST_BYTES[np.minimum(np.repeat(end[some], n) - place, 8)]
            out[some] += np.add.reduceat(mix(mix(value) + k.astype(np.uint64) * _BLOCK_STEP), first)
    return mix(out)


def hash_word(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(hashed(b, np.array([0]), np.array([len(b)]))[0])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n words (runs across documents too; the caller masks them)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:count].copy()
        for k in range(1, n):
            out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + count]
    return mix(out)
