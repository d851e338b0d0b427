"""Words of many texts at once as numpy arrays: where they are, and a 64-bit hash of each.

Hashes only nominate: operators compare the words themselves before they call anything equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MASK = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 9)], dtype=np.uint64)

_SPACES = set(b" \t\n\v\f\r")
#: bytes of a word: all but ASCII white space
NOT_SPACE = np.array([b not in _SPACES for b in range(256)])
#: bytes of a word: digits, lower-case letters, and everything outside ASCII
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one after the other
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # the byte after each word
    row: np.ndarray  # row[i]:row[i + 1] are the words of text i
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.row) - 1), self.counts)


def words_of(texts: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, buf = texts.buffers()
    n = len(texts)
    off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    size = len(raw)
    data = np.zeros(size + 8, dtype=np.uint8)
    data[:size] = LOWER[raw] if lower else raw
    inside = is_word[data[:size]]
    before = np.zeros(size, dtype=bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < size]] = False
    after = np.zeros(size, dtype=bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, off), _hash(data, start, end))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes of every word that still has some, until none has."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    eights = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * _A
    left, at = np.arange(len(start)), 0
    while len(left):
        rest = size[left] - at
        h[left] = mixed(h[left] ^ (eights[start[left] + at] & _MASK[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    return h


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _A + hashes[j:j + n]
    return mixed(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if len(sizes) > begin:
        yield batch.slice(begin)


def packed(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes with one space between words, first byte of each word, byte after each word)."""
    size = len(words.data) - 8
    inside = np.zeros(size + 1, dtype=np.int8)
    inside[words.start] += 1
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside)[:size] > 0
    keep = inside.copy()
    after = words.end[words.end < size]
    keep[after] = True
    at = np.cumsum(keep) - 1
    return np.where(inside, words.data[:size], 32)[keep].tobytes(), at[words.start], at[words.end - 1] + 1
