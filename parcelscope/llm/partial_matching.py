"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is read as its lower-cased (A-Z) words, each followed by one space, then an end mark. A trie
of byte contexts holds how often each symbol followed each context of `ORDER` bytes in the training
texts; at a shorter context a symbol counts once for each longer one that showed it (update
exclusion), which is when an encoder would have asked there. A symbol that the longest known context has seen costs its share there; otherwise
the context pays its escape (method D: half a count of every symbol seen once more goes to the
escape), and the next shorter context is asked, without the symbols that the longer one has already
ruled out (symbol exclusion). Below the empty context all symbols left are equally likely. The sum
of log10 probabilities over a text is its score; minus that sum over log10(2) is its code length in bits.

How it is spread out:

* Texts are cut into chunks of about 8 MB, written once. A chunk's different grams (context and
  symbol, six bytes in one integer) are its share of the training counts and its questions.
* Grams with the same last three context bytes lie in one part: their contexts of three bytes and
  more form whole sub-tries there. A sub-trie has at most 2 ** 24 grams, whatever the input's size.
  Contexts of up to two bytes are one table of at most 2 ** 24 rows, which goes to all tasks.
* A part adds up the counts of all chunks, then answers each chunk's questions, one chunk at a time.
  A chunk gathers its answers and sums them per document. A gram is asked once a chunk, so frequent
  grams, hot sources and copies are folded before they are shuffled.

The unigram base travels the same way: a chunk's different words are its counts and its questions.
The end of a text is the empty word.

Defined cases: a null or empty text has no words and scores its end mark. A row without an id is
held out. Repeated rows are texts of their own. Without any training text all symbols are equally
likely, and the base is the log10 of 1 for each token. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import text_of, written
from .wordhash import NOT_SPACE, mixed, pieces, words_of

ORDER, SPLIT = 5, 3  # bytes of context; grams are dealt out by the last SPLIT of them
CHUNK = 8 << 20
END, SPACE = 10, 32  # no word has these bytes, nor the other four white-space bytes
SYMBOLS = 256 - 4
NO_GRAM = np.uint64(0x090909090909)  # stands where no gram ends: tabs occur in none
SLICE = 1 << 21  # positions that are sorted at once

_CHUNKS = "chunk long, block binary"
_ASKED = "part int, chunk long, grams binary, train binary, words binary, word_train binary"
_MODEL = "part int, grams binary, counts binary, words binary, word_counts binary, tokens long, vocabulary long"
_ANSWERS = "chunk long, part int, logs binary, word_counts binary"


def held_out(id_col: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(True))


# --- small helpers on arrays ---------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Integers or floats, bytes of equal weight together, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values.view(np.uint8)
    return len(values).to_bytes(8, "little") + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unpack(block: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(block[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(block[8:], n * size, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def _pack_sorted(codes: np.ndarray) -> bytes:
    return _pack(np.diff(codes, prepend=np.uint64(0)))


def _unpack_sorted(block: bytes) -> np.ndarray:
    return np.cumsum(_unpack(block, np.uint64), dtype=np.uint64)


def _pack_words(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.record_batch([words], names=["word"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(table)
    return sink.getvalue().to_pybytes()


def _unpack_words(block: bytes) -> pa.Array:
    return pa.ipc.open_stream(block).read_all().column("word").combine_chunks()


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes folded, in order."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else order
    return codes[head], np.add.reduceat(counts, head) if len(head) else counts


def _part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    context = (codes >> np.uint64(8)) & np.uint64((1 << (8 * SPLIT)) - 1)
    return (mixed(context + np.uint64(1)) >> np.uint64(33)).astype(np.int64) % parts


# --- chunks --------------------------------------------------------------------------------------


def _streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begin of each text): ORDER end marks as the first context, words each with one space, an end mark."""
    words = words_of(texts, NOT_SPACE, lower=True)
    size = words.end - words.start
    owner = words.owner()
    ends = np.cumsum(np.bincount(owner, size + 1, minlength=len(texts)).astype(np.int64) + ORDER + 1)
    begin = np.append(0, ends)
    to = np.cumsum(size + 1) - (size + 1) + (owner + 1) * ORDER + owner
    out = np.full(begin[-1], END, dtype=np.uint8)
    if len(size):
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + inside] = words.data[np.repeat(words.start, size) + inside]
        out[to + size] = SPACE
    return out, begin


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Callable[[Column], Column] = held_out,
            chunk: int = CHUNK) -> DataFrame:
    """The texts as a written table of chunks: one compressed block of (id, held, bytes) each."""
    rows = text_of(docs, id_col, text_col).withColumn("held", held(F.col("id")))

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        kept, size = [], 0

        def flush():
            nonlocal kept, size, number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(kept).combine_chunks())
            number, kept, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "block"])

        for batch in batches:
            for part in pieces(batch, "text", min(chunk, 2 << 20)):
                data, begin = _streams(part.column("text"))
                if kept and size + len(data) > chunk:
                    yield flush()
                streams = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(begin), pa.py_buffer(data)])
                kept.append(pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), streams], names=["id", "held", "bytes"]))
                size += len(data)
        if kept:
            yield flush()

    return written(rows.mapInArrow(run, _CHUNKS), "ppm-chunks")


@dataclass
class _Chunk:
    ids: pa.Array
    held: np.ndarray
    data: np.ndarray
    begin: np.ndarray  # first byte of each text, and the end

    @staticmethod
    def of(block: bytes) -> _Chunk:
        table = pa.ipc.open_stream(block).read_all().combine_chunks()
        streams = table.column("bytes").combine_chunks()
        _, off, buf = streams.buffers()
        begin = np.frombuffer(off, np.int64)[streams.offset:streams.offset + len(streams) + 1]
        return _Chunk(table.column("id").combine_chunks(), table.column("held").to_numpy(), np.frombuffer(buf, np.uint8)[begin[0]:begin[-1]], begin - begin[0])

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, codes) of the grams that end at each byte; the first ORDER bytes of a text end none."""
        first = np.zeros(len(self.data), dtype=bool)
        for k in range(ORDER):
            first[self.begin[:-1] + k] = True
        for a in range(0, len(self.data), SLICE):
            b = min(len(self.data), a + SLICE)
            raw = self.data[max(0, a - ORDER):b]
            raw = np.concatenate([np.zeros(ORDER - (a - max(0, a - ORDER)), np.uint8), raw])
            codes = np.zeros(b - a, dtype=np.uint64)
            for k in range(ORDER + 1):
                codes = (codes << np.uint64(8)) | raw[k:k + b - a]
            codes[first[a:b]] = NO_GRAM
            yield a, codes

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(different grams in order, how often each occurs in training texts)."""
        held = np.repeat(self.held, np.diff(self.begin)).astype(np.uint64)
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for a, more in self.slices():
            keys = np.sort(more << np.uint64(1) | held[a:a + len(more)])
            different = keys >> np.uint64(1)
            gap = slice(*np.searchsorted(different, np.array([NO_GRAM, NO_GRAM + np.uint64(1)])))
            keys, different = np.delete(keys, gap), np.delete(different, gap)
            if not len(keys):
                continue
            head = np.flatnonzero(np.append(True, different[1:] != different[:-1]))
            train = np.add.reduceat(1 - (keys & np.uint64(1)).astype(np.int64), head)
            codes, counts = _summed(np.concatenate([codes, different[head]]), np.concatenate([counts, train]))
        return codes, counts

    def words(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(different words and the empty one for the end, number of the word at each token, text of each token)."""
        last = (self.data == SPACE) | (self.data == END)
        last[np.concatenate([self.begin[:-1] + k for k in range(ORDER)])] = False
        end = np.flatnonzero(last)
        owner = np.searchsorted(self.begin, end, side="right") - 1
        start = np.append(0, end[:-1] + 1)
        head = np.append(True, owner[1:] != owner[:-1])
        start[head] = self.begin[owner[head]] + ORDER
        # pads lie between texts, so the words are copied into one run of bytes
        size = end - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        offsets = np.append(0, np.cumsum(size))
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])
        found = tokens.dictionary_encode()
        return found.dictionary, found.indices.to_numpy(), owner


def _word_parts(words: pa.Array, parts: int) -> np.ndarray:
    found = words_of(words.cast(pa.large_binary()).view(pa.large_string()), np.ones(256, dtype=bool))
    hashes = np.zeros(len(words), dtype=np.uint64)
    hashes[np.diff(found.row) > 0] = found.hash  # the empty word has none
    return (hashes >> np.uint64(33)).astype(np.int64) % parts


def asked(chunks: DataFrame, parts: int) -> DataFrame:
    """What each chunk sends to each part: different grams and words with their training counts (written)."""

    def run(batches):
        for batch in batches:
            for number, block in zip(batch.column("chunk").to_pylist(), batch.column("block")):
                chunk = _Chunk.of(block.as_buffer())
                grams, train = chunk.grams()
                words, token, owner = chunk.words()
                word_train = np.bincount(token[~chunk.held[owner]], minlength=len(words)).astype(np.int64)
                gram_part, word_part = _part_of(grams, parts), _word_parts(words, parts)
                by_gram, by_word = np.argsort(gram_part, kind="stable"), np.argsort(word_part, kind="stable")
                g, w = np.searchsorted(gram_part[by_gram], np.arange(parts + 1)), np.searchsorted(word_part[by_word], np.arange(parts + 1))
                rows = []
                for p in range(parts):
                    i, j = by_gram[g[p]:g[p + 1]], by_word[w[p]:w[p + 1]]
                    if len(i) or len(j):
                        rows.append((p, number, _pack_sorted(grams[i]), _pack(train[i]), _pack_words(words.take(pa.array(j))), _pack(word_train[j])))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)],
                                                 names=["part", "chunk", "grams", "train", "words", "word_train"])

    return written(chunks.mapInArrow(run, _ASKED), "ppm-asked")


# --- the trie ------------------------------------------------------------------------------------


class _Level:
    """Contexts of k bytes: the grams (context and symbol) with their counts, and sums by context."""

    def __init__(self, order: int, grams: np.ndarray, counts: np.ndarray):
        self.order, self.grams, self.counts = order, grams, counts
        contexts = grams >> np.uint64(8)
        head = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(grams) else np.zeros(0, np.int64)
        self.head, self.contexts = head, contexts[head]
        self.total = np.add.reduceat(counts, head) if len(head) else counts
        self.symbols = np.diff(np.append(head, len(grams)))
        self.left_total = self.left_symbols = None

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """The grams of the next shorter contexts, and how many longer contexts showed each (update exclusion)."""
        return _summed(self.grams & np.uint64((1 << (8 * self.order)) - 1), np.ones(len(self.counts), np.int64))

    def exclude(self, below: _Level) -> None:
        """What the next shorter context has left without the symbols of this one: counts, symbols."""
        mask = np.uint64((1 << (8 * self.order)) - 1)
        same = np.searchsorted(below.grams, self.grams & mask)
        known = np.add.reduceat(below.counts[same], self.head) if len(self.head) else self.total
        at = np.searchsorted(below.contexts, self.contexts & (mask >> np.uint64(8)))
        self.left_total, self.left_symbols = below.total[at] - known, below.symbols[at] - self.symbols


class Trie:
    """Levels of grams, longest contexts first, each complete for the contexts that it has."""

    def __init__(self, order: int, grams: np.ndarray, counts: np.ndarray, lowest: int = 0, below: Trie | None = None):
        self.levels = []
        for k in range(order, lowest - 1, -1):
            self.levels.append(_Level(k, grams, counts))
            if k > lowest:
                grams, counts = self.levels[-1].shorter()
        self.levels += below.levels if below else []
        for level, next_one in zip(self.levels, self.levels[1:]):
            if level.left_total is None:
                level.exclude(next_one)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each code after the bytes before it."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        total = symbols = np.full(len(codes), -1)  # what the level asked next has left; -1: all
        for level in self.levels:
            grams = codes[open_] & np.uint64((1 << (8 * (level.order + 1))) - 1)
            at, there = _find(level.contexts, grams >> np.uint64(8))
            t = np.where(total >= 0, total, level.total[at] if len(level.total) else 0)
            d = np.where(symbols >= 0, symbols, level.symbols[at] if len(level.symbols) else 0)
            place, seen = _find(level.grams, grams)
            seen &= there
            with np.errstate(divide="ignore", invalid="ignore"):
                if len(level.counts):
                    out[open_[seen]] += np.log10((2 * level.counts[place[seen]] - 1) / (2 * t[seen]))
                escape = there & ~seen & (t > 0)
                out[open_[escape]] += np.log10(d[escape] / (2 * t[escape]))
            left = ~seen
            if level.left_total is not None and len(level.contexts):
                total = np.where(there, level.left_total[at], -1)[left]
                symbols = np.where(there, level.left_symbols[at], -1)[left]
            else:
                total = symbols = np.full(left.sum(), -1)
            last = level
            open_ = open_[left]
        out[open_] -= np.log10(SYMBOLS - (last.symbols[0] if len(last.symbols) else 0))
        return out


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each value in a sorted table."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


# --- training and answers ------------------------------------------------------------------------


@dataclass
class Model:
    table: DataFrame  # a row for each part: its grams and words with their counts
    parts: int
    low_grams: np.ndarray  # grams of two context bytes, at most 2 ** 24
    low_counts: np.ndarray
    tokens: int
    vocabulary: int


def _word_sums(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    table = pa.table({"word": pa.chunked_array(words, pa.large_binary()), "n": pa.chunked_array([pa.array(c) for c in counts], pa.int64())})
    table = table.group_by("word").aggregate([("n", "sum")])
    return table.column("word").combine_chunks(), table.column("n_sum").to_numpy()


def train(blocks: DataFrame, parts: int) -> Model:
    """Counts of all chunks added up, part by part; a part holds its different grams and words."""

    def run(batches):
        held: dict[int, list] = {}

        def fold(p):
            g, c, w, n = held[p][:4]
            codes, counts = _summed(np.concatenate(g), np.concatenate(c))
            words, sums = _word_sums(w, n)
            held[p] = [[codes], [counts], [words], [sums], 0]

        for batch in batches:
            for r in range(batch.num_rows):
                part, grams, train_, words, word_train = (batch.column(c)[r].as_py() for c in ("part", "grams", "train", "words", "word_train"))
                h = held.setdefault(part, [[], [], [], [], 0])
                n, wn = _unpack(train_, np.int64), _unpack(word_train, np.int64)
                h[0].append(_unpack_sorted(grams)[n > 0])
                h[1].append(n[n > 0])
                h[2].append(_unpack_words(words).filter(pa.array(wn > 0)))
                h[3].append(wn[wn > 0])
                h[4] += len(h[1][-1]) + len(h[3][-1])
                if h[4] > 2_000_000 + 2 * len(h[0][0]):
                    fold(part)
        for part in held:
            fold(part)
            (codes,), (counts,), (words,), (sums,), _ = held[part]
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([_pack_sorted(codes)], pa.binary()), pa.array([_pack(counts)], pa.binary()),
                pa.array([_pack_words(words)], pa.binary()), pa.array([_pack(sums)], pa.binary()),
                pa.array([int(sums.sum())], pa.int64()), pa.array([len(sums)], pa.int64()),
            ], names=["part", "grams", "counts", "words", "word_counts", "tokens", "vocabulary"])

    sent = blocks.select("part", "grams", "train", "words", "word_train").repartitionById(parts, F.col("part"))
    table = written(sent.mapInArrow(run, _MODEL), "ppm-model")

    def low(batches):
        for batch in batches:
            for g, c in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist()):
                codes, counts = Trie(ORDER, _unpack_sorted(g), _unpack(c, np.int64), SPLIT).levels[-1].shorter()
                yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["gram", "n"])

    sums = table.select("grams", "counts").mapInArrow(low, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    codes, counts = _summed(sums["gram"].to_numpy(np.int64).astype(np.uint64), sums["n"].to_numpy(np.int64))
    seen = table.agg(F.sum("tokens").alias("tokens"), F.sum("vocabulary").alias("vocabulary")).first()
    return Model(table, parts, codes, counts, seen["tokens"] or 0, seen["vocabulary"] or 0)


def answered(blocks: DataFrame, model: Model) -> DataFrame:
    """(chunk, part, logs, word_counts): each chunk's grams and words of a part, in the chunk's order."""
    spark = blocks.sparkSession
    low = spark.sparkContext.broadcast((model.low_grams, model.low_counts))
    none = F.lit(None).cast("binary")
    known = model.table.select("part", F.lit(-1).cast("long").alias("chunk"), "grams", "counts", "words", "word_counts")
    rows = known.unionAll(blocks.select("part", "chunk", "grams", none.alias("counts"), "words", none.alias("word_counts")))

    def run(batches):
        below = Trie(SPLIT - 1, *low.value)
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at, trie, words, sums = None, None, None, None
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                part, chunk, grams, counts, asked_words, word_counts = (x[r].as_py() for x in batch.columns)
                if part != at:
                    at, trie = part, None
                if chunk == -1:
                    trie = Trie(ORDER, _unpack_sorted(grams), _unpack(counts, np.int64), SPLIT, below)
                    words, sums = _unpack_words(asked_words), _unpack(word_counts, np.int64)
                    continue
                if trie is None:  # nothing was learned for this part
                    trie, words, sums = Trie(ORDER, *nothing, SPLIT, below), pa.array([], pa.large_binary()), nothing[1]
                place = pc.index_in(_unpack_words(asked_words), value_set=words)
                c = np.append(sums, 0)[pc.fill_null(place, len(sums)).to_numpy()]
                out.append((chunk, part, _pack(trie.log10(_unpack_sorted(grams)).astype(np.float32)), _pack(c)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["chunk", "part", "logs", "word_counts"])

    dealt = rows.repartitionById(model.parts, F.col("part")).sortWithinPartitions("part", "chunk")
    return written(dealt.mapInArrow(run, _ANSWERS), "ppm-answers")


# --- sums per document ---------------------------------------------------------------------------


def _numbered(raw: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value among the different ones, those in order) of values below 2 ** bits."""
    there = np.zeros(1 << bits, dtype=bool)
    there[raw] = True
    different = np.flatnonzero(there)
    number = np.zeros(1 << bits, dtype=np.int32)
    number[different] = np.arange(len(different), dtype=np.int32)
    return number[raw], different


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the codes, first place of each different one in that order). Codes are halved and their
    halves numbered, so that code and place mostly fit one integer, which sorts several times faster."""
    half = 4 * (ORDER + 1)
    a, different_a = _numbered((codes >> np.uint64(half)).astype(np.int64), half)
    b, different_b = _numbered((codes & np.uint64((1 << half) - 1)).astype(np.int64), half)
    places = max(1, (len(codes) - 1).bit_length())
    if (len(different_a) * len(different_b)).bit_length() + places <= 63:
        keys = np.sort(((a.astype(np.int64) * len(different_b) + b) << places) | np.arange(len(codes)))
        order, keys = keys & ((1 << places) - 1), keys >> places
    else:
        order = np.argsort(codes, kind="stable")
        keys = codes[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _ranked(chunk: _Chunk) -> tuple[np.ndarray, list[tuple]]:
    """(different grams in order, (first position, order, heads, their grams) of each slice)."""
    slices = []
    for a, codes in chunk.slices():
        order, head = _ranks(codes)
        slices.append((a, order.astype(np.int32), head, codes[order[head]]))
    grams = np.unique(np.concatenate([s[3] for s in slices]))
    return grams[grams != NO_GRAM], slices


def _scored(chunk: _Chunk, grams: np.ndarray, slices: list[tuple], logs: np.ndarray) -> np.ndarray:
    at = np.zeros(len(chunk.data))
    for a, order, head, value in slices:
        place, known = _find(grams, value)
        each = np.where(known, logs[place], 0.0) if len(grams) else np.zeros(len(value))  # unknown: NO_GRAM
        at[a + order] = np.repeat(each, np.diff(np.append(head, len(order))))
    return np.add.reduceat(at, chunk.begin[:-1])


def score(chunks: DataFrame, answers: DataFrame, model: Model, id_type: str) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document."""
    none, parts, tokens, vocabulary = F.lit(None).cast("binary"), model.parts, model.tokens, model.vocabulary
    rows = chunks.select("chunk", F.lit(-1).alias("part"), "block", none.alias("word_counts")).unionAll(
        answers.select("chunk", "part", F.col("logs").alias("block"), "word_counts"))

    def finish(chunk: _Chunk, found: dict) -> pa.RecordBatch:
        grams, slices = _ranked(chunk)
        logs, part = np.zeros(len(grams)), _part_of(grams, parts)
        words, token, owner = chunk.words()
        counts, word_part = np.zeros(len(words), np.int64), _word_parts(words, parts)
        by_gram, by_word = np.argsort(part, kind="stable"), np.argsort(word_part, kind="stable")
        g, w = np.searchsorted(part[by_gram], np.arange(parts + 1)), np.searchsorted(word_part[by_word], np.arange(parts + 1))
        for p, (a, b) in found.items():
            logs[by_gram[g[p]:g[p + 1]]] = _unpack(a, np.float32)
            counts[by_word[w[p]:w[p + 1]]] = _unpack(b, np.int64)
        n = len(chunk.ids)
        base = np.log10((counts + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        total = _scored(chunk, grams, slices, logs)
        size = np.diff(chunk.begin) - ORDER
        return pa.RecordBatch.from_arrays([
            chunk.ids, pa.array(chunk.held), pa.array(np.bincount(owner, minlength=n)),
            pa.array(np.bincount(owner, counts[token] > 0, minlength=n).astype(np.int64)),
            pa.array(np.full(n, tokens)), pa.array(np.bincount(owner, base[token], minlength=n)),
            pa.array(total), pa.array(-total / np.log10(2) / size),
        ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    def run(batches):
        chunk, at, found = None, None, {}
        for batch in batches:
            for number, part, block, word_counts in zip(*(x for x in batch.columns)):
                number, part = number.as_py(), part.as_py()
                if number != at:
                    if chunk is not None:
                        yield finish(chunk, found)
                    at, found = number, {}
                if part == -1:
                    chunk = _Chunk.of(block.as_buffer())
                else:
                    found[part] = block.as_py(), word_counts.as_py()
        if chunk is not None:
            yield finish(chunk, found)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(run, schema)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           held: Callable[[Column], Column] = held_out, chunk: int = CHUNK) -> DataFrame:
    """Train on the documents that are not held out, and score all of them."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunked(docs, id_col, text_col, held, chunk)
    blocks = asked(chunks, parts)
    model = train(blocks, parts)
    out = score(chunks, answered(blocks, model), model, dict(docs.select(docs[id_col].alias("id")).dtypes)["id"])
    return out.withColumnRenamed("id", id_col)
