"""Runs: stretches of words that repeat with a period, found by block convolution.

A run is a stretch of consecutive words with smallest period q, at least max(12, 2 q) words long, that
no neighbouring word extends. For periods from 2 L - 1 to 4 L - 2 a text is cut into blocks of L words
(L = 8, 16, 32, ...). A run with such a period holds one whole block in its first length - q words, and
that block occurs again q words later. So each block is laid over the 3 L - 1 words that follow at a
distance of 2 L - 1, and the sum of squared differences of the words' numbers at each distance comes from
one convolution, done modulo a prime by a number-theoretic transform, in integers. Sum zero nominates a
distance; all stretches of that distance are then compared word by word, so nothing rests on the prime.
Periods up to 14 are compared directly: there a convolution is no shorter than the comparison.

A block is transformed only if each of its words occurs again within 4 L - 2 words, without which no
distance can have sum zero. Distances that are multiples of the period of a run known from a shorter scale are
left out where block and occurrence both lie in that run: the stretch would be that run again.

Texts are worked on whole, a few megabytes at a time, in the task that reads them; nothing is shuffled.

Defined cases: a null or empty text, or one without runs, has n_runs 0, no longest run, no runs and all
of its words kept. Repeated rows and ids are texts of their own. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import text_of
from .wordhash import NOT_SPACE, Words, pieces, words_of

LEAST = 12  # words of the shortest run
DIRECT = 14  # periods up to this are compared word by word
PRIME, ROOT = 2013265921, 31  # 15 * 2 ** 27 + 1, and a generator
ROOM = 1 << 20  # numbers that are transformed at once

_P = np.uint64(PRIME)


# --- the transform -------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first `half` powers of a root of unity of order 2 * half."""
    w = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    out = np.ones(half, dtype=np.uint64)
    have = 1
    while have < half:  # by doubling
        out[have:2 * have] = out[:have] * np.uint64(pow(w, have, PRIME)) % _P
        have *= 2
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    return np.minimum(x, x - _P)  # below the prime, x - prime wraps round to a large number


def transformed(rows: np.ndarray) -> np.ndarray:
    """Transform of each row; the result is in bit-reversed order."""
    a, half = rows, rows.shape[1] // 2
    while half:
        pair = a.reshape(len(rows), -1, 2, half)
        x, y = pair[:, :, 0], pair[:, :, 1]
        a = np.stack([_reduced(x + y), (x + (_P - y)) * _powers(half, False) % _P], axis=2)
        half //= 2
    return a.reshape(rows.shape)


def restored(rows: np.ndarray) -> np.ndarray:
    """Rows from their transforms in bit-reversed order."""
    n = rows.shape[1]
    a, half = rows, 1
    while half < n:
        pair = a.reshape(len(rows), -1, 2, half)
        x, y = pair[:, :, 0], pair[:, :, 1] * _powers(half, True) % _P
        a = np.stack([_reduced(x + y), _reduced(x + (_P - y))], axis=2)
        half *= 2
    return a.reshape(rows.shape) * np.uint64(pow(n, PRIME - 2, PRIME)) % _P


def zero_mismatch(numbers: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) at which a block of `size` numbers occurs again, for distances 2 size - 1 to
    4 size - 2, where the sum of squared differences is zero modulo the prime."""
    first, n = 2 * size - 1, 4 * size
    out = []
    for a in range(0, len(begin), max(1, ROOM // n)):
        at = begin[a:a + max(1, ROOM // n), None]
        block = numbers[at + np.arange(size)]
        window = numbers[at + first + np.arange(3 * size - 1)]
        x, y = np.zeros((len(at), n), dtype=np.uint64), np.zeros((len(at), n), dtype=np.uint64)
        x[:, :size], y[:, :3 * size - 1] = block[:, ::-1], window
        both = restored(transformed(x) * transformed(y) % _P)[:, size - 1:3 * size - 1]
        squares = np.zeros((len(at), 3 * size), dtype=np.uint64)
        squares[:, 1:] = np.cumsum(window * window % _P, axis=1)
        squares = squares[:, size:] - squares[:, :2 * size]
        own = (block * block % _P).sum(axis=1)[:, None]
        i, d = np.nonzero((squares + own) % _P == both * np.uint64(2) % _P)
        out.append((i + a, d + first))
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (begin[:0], begin[:0])


# --- runs ----------------------------------------------------------------------------------------


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def _short_periods(numbers: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """Runs with periods up to DIRECT: rows of (begin, end, period), begins counted over all texts."""
    n = len(numbers)
    found = []
    for d in range(1, min(DIRECT, n // 2) + 1):
        same = (numbers[:-d] == numbers[d:]) & (text_end[:-d] == text_end[d:])
        a, b = _stretches(same)
        long = b - a + d >= max(LEAST, 2 * d)
        found.append(np.stack([a[long], b[long] + d, np.full(long.sum(), d)], axis=1))
    return _first_periods(found)


def _first_periods(found: list[np.ndarray]) -> np.ndarray:
    """A stretch has one smallest period: of rows with one (begin, end), the smallest period stays."""
    rows = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), dtype=np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    head = np.ones(len(rows), dtype=bool)
    head[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[head]


def _next_distance(numbers: np.ndarray, text_end: np.ndarray) -> np.ndarray:
    """Words from each word to its next occurrence in the same text; a large number if there is none."""
    keys = np.sort(numbers.astype(np.int64) << 32 | np.arange(len(numbers)))
    place, number = keys & 0xFFFFFFFF, keys >> 32
    out = np.full(len(numbers), 1 << 40)
    again = np.flatnonzero(number[1:] == number[:-1])
    out[place[again]] = place[again + 1] - place[again]
    return np.where(np.arange(len(numbers)) + out < text_end, out, 1 << 40)


def _known(runs: np.ndarray, begin: np.ndarray, size: int, distance: np.ndarray) -> np.ndarray:
    """Seeds whose block and occurrence lie in one known run, at a multiple of its period."""
    out = np.zeros(len(begin), dtype=bool)
    order = np.argsort(begin, kind="stable")
    sorted_begin = begin[order]
    for a, b, q in runs[runs[:, 1] - runs[:, 0] >= 3 * size - 1].tolist():
        some = order[np.searchsorted(sorted_begin, a):np.searchsorted(sorted_begin, b)]
        out[some] |= (begin[some] + size + distance[some] <= b) & (distance[some] % q == 0)
    return out


def runs_of(numbers: np.ndarray, row: np.ndarray) -> np.ndarray:
    """All runs of texts laid end to end (text i is numbers[row[i]:row[i + 1]]), as rows of (begin, end, period)."""
    counts = np.diff(row)
    if not len(numbers):
        return np.zeros((0, 3), dtype=np.int64)
    text_end = np.repeat(row[1:], counts)
    runs = _short_periods(numbers, text_end)
    longest = counts.max()
    size = (DIRECT + 2) // 2
    if 2 * (2 * size - 1) > longest:
        return runs
    again = _next_distance(numbers, text_end)
    padded = np.concatenate([numbers, np.zeros(longest + 64, dtype=numbers.dtype)]).astype(np.uint64)
    while 2 * (2 * size - 1) <= longest:
        lone = np.append(0, np.cumsum(again > 4 * size - 2))
        blocks = np.maximum(0, (counts - (2 * size - 1)) // size)
        text = np.repeat(np.arange(len(counts)), blocks)
        begin = row[text] + (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * size
        open_ = lone[begin + size] == lone[begin]
        begin, text = begin[open_], text[open_]
        i, d = zero_mismatch(padded, begin, size)
        inside = begin[i] + size + d <= row[text[i] + 1]
        i, d = i[inside], d[inside]
        new = ~_known(runs, begin[i], size, d)
        found = [runs]
        for t, q in np.unique(np.stack([text[i[new]], d[new]], axis=1), axis=0).tolist():
            words = numbers[row[t]:row[t + 1]]
            a, b = _stretches(words[:-q] == words[q:])
            long = b - a >= q
            found.append(np.stack([a[long], b[long] + q, np.full(long.sum(), q)], axis=1) + [[row[t], row[t], 0]])
        runs = _first_periods(found)
        size *= 2
    return runs


# --- texts ---------------------------------------------------------------------------------------


def planted(doc_id, n: int) -> np.ndarray | None:
    """Which word stands at each place once a tail of every tenth text (by a hash of its id) repeats; None: as it is."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _numbers(words: Words) -> np.ndarray:
    """Equal words get equal numbers, by their bytes."""
    size = words.end - words.start
    offsets = np.append(0, np.cumsum(size))
    data = words.data[np.repeat(words.start - offsets[:-1], size) + np.arange(offsets[-1])]
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return tokens.dictionary_encode().indices.to_numpy()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _batch(part: pa.RecordBatch, placed: Callable | None) -> pa.RecordBatch:
    words = words_of(part.column("text"), NOT_SPACE)
    row = words.row
    if placed:
        order = np.arange(len(words.start))
        for i, (doc_id, n) in enumerate(zip(part.column("id").to_pylist(), words.counts.tolist())):
            own = placed(doc_id, n)
            if own is not None:
                order[row[i]:row[i + 1]] = row[i] + own
        words.start, words.end = words.start[order], words.end[order]
    runs = runs_of(_numbers(words), row)
    text = np.searchsorted(row, runs[:, 0], side="right") - 1
    start, length, period = runs[:, 0] - row[text], runs[:, 1] - runs[:, 0], runs[:, 2]
    order = np.lexsort((period, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    runs = runs[order]
    n = np.bincount(text, minlength=part.num_rows)
    best = np.lexsort((period, start, -length, text))
    best = best[np.append(True, text[best][1:] != text[best][:-1])] if len(best) else best
    longest = np.full((4, part.num_rows), -1)
    longest[:, text[best]] = start[best], length[best], period[best], 1000 * length[best] // period[best]
    covered = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(covered, runs[:, 0] + runs[:, 2], 1)
    np.add.at(covered, runs[:, 1], -1)
    keep = np.cumsum(covered)[:-1] == 0
    raw, begin, end, collapsed = words.data.tobytes(), words.start, words.end, []
    for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
        at = np.flatnonzero(keep[a:b]) + a
        collapsed.append(b" ".join([raw[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist())]).decode())
    each = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN))
    none = n == 0
    return pa.RecordBatch.from_arrays([
        part.column("id"), pa.array(n), *[pa.array(x, mask=none) for x in longest],
        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), each), pa.array(collapsed, pa.string()),
    ], names=["id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  placed: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs, collapsed) of every text: its longest run
    (ties: smallest start), all runs in order of start and period, and its words joined by one space
    without those that a run repeats. `placed` may name, by id and number of words, the word at each place."""
    rows = text_of(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield _batch(part, placed)

    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {_COLUMNS}")
    return out.withColumnRenamed("id", id_col)
