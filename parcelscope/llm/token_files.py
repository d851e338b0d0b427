"""Token ids in files: ranks by frequency, one to four bytes each, lengths in separate control bytes.

1. Each text is encoded once and its ids are kept as a table.
2. Ids are counted over the whole corpus; a frequent id gets a low rank, and ranks below 256 take
   one byte. The rank table has one entry for each id of the vocabulary, which bounds what is
   collected and broadcast.
3. Documents are dealt by ranges of their id, sorted, and written. A control byte holds the lengths
   of four ranks (two bits each). Reading looks a control byte up in a table of 256 rows, sums the
   lengths, and takes all values with one indexed read.

File: b"RVB1", the documents' blocks (control bytes, then data bytes), an Arrow table of
(id, n_tokens, offset), its length as eight bytes, b"RVB1". Each attempt of a task writes a file of
its own name; the manifest lists those that count.

Encoding works on the words between ASCII white space, each different word once. That equals
encoding the whole text only if the tokenizer drops white space and joins nothing across it, lowers
case, and cuts between a letter and a full stop; `check_splits` verifies that for awkward strings
before any work, and the tests for whole texts.

Defined cases: a null or empty text has the end id only; documents without an id come first; equal
ids keep all their rows, ordered by their ids' bytes; an empty table makes no file.
"""

from __future__ import annotations

import itertools
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import open_store, shared_folder, text_of, written
from .wordhash import LOWER, pieces

MAGIC = b"RVB1"
AT_ONCE = 16_384  # words that the tokenizer gets in one call; it takes some hundred bytes for each id
KNOWN_WORDS = 400_000  # a worker's memory of encoded words; beyond it begins anew with the words at hand


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_splits(path: str) -> None:
    t = tokenizer(path)
    for s in ("it's one  two\tthree\n", " a\x0b\x0cb ", "<|endoftext|> x<|endoftext|>y", "é ́e", " a b"):
        whole = t.encode(s, add_special_tokens=False).ids
        parts = [i for w in s.encode().split() for i in t.encode(w.decode(), add_special_tokens=False).ids]
        if whole != parts:
            raise ValueError(f"{path}: this tokenizer can't be applied word by word")


_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_STOP = np.array([b in b".," for b in range(256)])


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with a space where an ASCII letter meets a full stop or comma (the tokenizer cuts
    there too), and in lower case unless a special token may be written in them; a capital before a
    character beyond ASCII stays, as the tokenizer may compose the two before it lowers. It only
    makes words repeat more often."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lower = not pc.any(pc.match_substring(texts, "<|")).as_py()
    n = len(texts)
    _, off, buf = texts.buffers()
    if not n or buf is None:
        return texts
    off = np.frombuffer(off, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]]
    if lower:
        stays, raw = np.flatnonzero(data[1:] >= 128), data
        data = LOWER[raw]
        data[stays] = raw[stays]
    off = off - off[0]
    letter, stop = _LETTER[data], _STOP[data]
    cut = np.flatnonzero((letter[:-1] & stop[1:]) | (stop[:-1] & letter[1:])) + 1
    off = off + np.searchsorted(cut, off, side="left")
    data = np.insert(data, cut, 32)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(data))


@dataclass
class _Units:
    """Ids of words: those of word i are pool[begin[i]:begin[i] + size[i]]."""

    begin: np.ndarray
    size: np.ndarray
    pool: np.ndarray

    @staticmethod
    def none() -> _Units:
        return _Units(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    @staticmethod
    def joined(parts: list[_Units]) -> _Units:
        parts = [_Units.none(), *parts]
        shift = np.cumsum([0, *(len(p.pool) for p in parts[:-1])])
        return _Units(np.concatenate([p.begin + k for p, k in zip(parts, shift)]), np.concatenate([p.size for p in parts]),
                      np.concatenate([p.pool for p in parts]))

    def take(self, at: np.ndarray) -> _Units:
        return _Units(self.begin[at], self.size[at], self.pool)

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word's begin, and the end)."""
        stop = np.concatenate([[0], np.cumsum(self.size)])
        return self.pool[np.repeat(self.begin - stop[:-1], self.size) + np.arange(stop[-1])], stop


class Encoder:
    def __init__(self, path: str, end_id: int):
        self.tokenizer, self.end_id = tokenizer(path), end_id
        self.words, self.units = pa.array([], pa.large_string()), _Units.none()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a unit, if marked
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each text closed by the end id; number of ids of each)."""
        split = pc.ascii_split_whitespace(spaced(texts))
        words = split.flatten()
        full = pc.greater(pc.binary_length(words), 0)
        upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        rows = upto[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])]
        coded = words.filter(full).dictionary_encode()
        ids, stop = self._units(coded.dictionary).take(coded.indices.to_numpy(zero_copy_only=False)).spelled()
        ends = stop[rows]
        return np.insert(ids, ends[1:], self.end_id), np.diff(ends) + 1

    def _units(self, words: pa.Array) -> _Units:
        """The ids of different words. Those met lately are not encoded again."""
        place = pc.index_in(words, value_set=self.words)
        unknown = place.is_null()
        new = words.filter(unknown)
        at = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        at[unknown.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        every = _Units.joined([self.units, self._encoded(new)])
        units = every.take(at)
        if len(self.words) + len(new) <= KNOWN_WORDS:
            self.words, self.units = pa.concat_arrays([self.words, new]), every
        else:
            ids, stop = units.spelled()
            self.words, self.units = words, _Units(stop[:-1], units.size, ids)
        return units

    def _encoded(self, words: pa.Array) -> _Units:
        alpha = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        parts, order = [], np.concatenate([np.flatnonzero(alpha), np.flatnonzero(~alpha)])
        for kind, of in ((alpha, self._plain), (~alpha, self._each)):
            some = words.filter(pa.array(kind)).to_pylist()
            parts += [of(some[i:i + AT_ONCE]) for i in range(0, len(some), AT_ONCE)]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return _Units.joined(parts).take(back)

    def _each(self, words: list[str]) -> _Units:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return _Units(np.cumsum(size) - size, size, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())))

    def _plain(self, words: list[str]) -> _Units:
        """Words of letters only are encoded as one text, unless they turn out not to be one unit each."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._each(words)
        begin = np.append(0, ends[:-1])
        return _Units(begin, ends - begin, ids)


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which Spark keeps for many tasks."""
    return Encoder(path, end_id)


def id_bytes(path: str, end_id: int) -> int:
    """Two bytes are enough for the ids of a small vocabulary."""
    return 2 if max(tokenizer(path).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row; ids are little-endian unsigned integers of `id_bytes` bytes."""
    check_splits(tokenizer_path)
    kind = f"<u{id_bytes(tokenizer_path, end_id)}"
    rows = text_of(docs, id_col, text_col)

    def run(batches):
        encode = encoder(tokenizer_path, end_id)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                ids, n = encode(part.column("text"))
                raw, stop = ids.astype(kind).tobytes(), int(kind[2]) * np.concatenate([[0], np.cumsum(n)])
                blobs = [raw[a:b] for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(blobs, pa.binary())], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids binary")


def ranks(tokens: DataFrame, width: int) -> np.ndarray:
    """The ids from frequent to rare (ties: smaller first). Counted in each task, then summed by id."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "ids"):
                n = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), f"<u{width}"))
                if len(n) > len(total):
                    n, total = total, n
                total[:len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["t", "n"])

    rows = tokens.select("ids").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return np.array([r["t"] for r in sorted(rows, key=lambda r: (-r["n"], r["t"]))], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    lengths = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    lengths[:len(values)] = size - 1
    control = (lengths.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    four = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < size[:, None]].tobytes()


_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def unpack(block: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    c = -(-n // 4)
    size = _LENGTHS[np.frombuffer(block, np.uint8, c)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    data = block[c:] + b"\0\0\0"
    four = np.ndarray(shape=(max(len(data) - 3, 0),), dtype="<u4", buffer=data, strides=(1,))
    return four[at] & _KEEP[size]


class _Writer:
    def __init__(self, folder: str, part: int, seq: int, kind: pa.DataType):
        self.store, root = open_store(folder)
        self.path, self.part, self.seq, self.kind = f"{root}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.rvb", part, seq, kind
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.out.write(MAGIC)
        self.at, self.index = len(MAGIC), []

    def add(self, key, ranks_of_doc: np.ndarray) -> None:
        control, data = pack(ranks_of_doc)
        self.out.write(control + data)
        self.index.append((key, len(ranks_of_doc), self.at))
        self.at += len(control) + len(data)

    def close(self):
        ids, n, at = zip(*self.index)
        table = pa.table({"id": pa.array(ids, self.kind), "n_tokens": pa.array(n, pa.int64()), "offset": pa.array(at, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        raw = sink.getvalue().to_pybytes()
        self.out.write(raw + len(raw).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.part, self.seq, self.path, len(n), sum(n)


_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def write_files(tokens: DataFrame, width: int, order: np.ndarray, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Write all rows of tokens (id, ids) in ascending id; returns the manifest, one row per file."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    sent = tokens.sparkSession.sparkContext.broadcast(rank)
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        part, seq, writer = TaskContext.get().partitionId(), 0, None
        done = []
        for batch in batches:
            keys = batch.column("id")
            for key, ids in zip(keys.to_pylist(), batch.column("ids").to_pylist()):
                if writer is None:
                    writer = _Writer(folder, part, seq, keys.type)
                writer.add(key, sent.value[np.frombuffer(ids, f"<u{width}")])
                if writer.at >= file_bytes:
                    done.append(writer.close())
                    writer, seq = None, seq + 1
        if writer:
            done.append(writer.close())
        cols = list(zip(*done)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                         names=["part", "seq", "path", "n_docs", "n_tokens"])

    ordered = tokens.repartitionByRange("id").sortWithinPartitions("id", "ids")
    return written(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read_files(manifest: DataFrame, order: np.ndarray, folder: str, id_type: str = "bigint", block: int = 8 << 20) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    sent = manifest.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(path) as f:
                    yield from _read_file(f, start, sent.value, block)

    n = max(1, manifest.count())
    return files.repartition(n, "path").mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids binary")


def _read_file(f, start: int, order: np.ndarray, block: int):
    size = f.size()
    tail = f.read_at(12, size - 12)
    if f.read_at(4, 0) != MAGIC or tail[8:] != MAGIC:
        raise ValueError("not a token file")
    length = int.from_bytes(tail[:8], "little")
    index = pa.ipc.open_stream(f.read_at(length, size - 12 - length)).read_all()
    n = index["n_tokens"].to_numpy()
    at = np.append(index["offset"].to_numpy(), size - 12 - length)
    begin = start + np.cumsum(n) - n
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(at, at[i] + block, side="right")) - 1)
        raw = f.read_at(int(at[j] - at[i]), int(at[i]))
        ids = [order[unpack(raw[at[k] - at[i]:at[k + 1] - at[i]], int(n[k]))].astype("<u4").tobytes() for k in range(i, j)]
        yield pa.RecordBatch.from_arrays([
            index["id"].slice(i, j - i).combine_chunks(), pa.array(begin[i:j], pa.int64()),
            pa.array(n[i:j], pa.int64()), pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])
        i = j


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write, and read back: (id, start, n_tokens, ids) as the files have them."""
    tokens = written(encoded(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    width = id_bytes(tokenizer_path, end_id)
    order = ranks(tokens, width)
    folder = shared_folder(docs.sparkSession, "token-files")
    manifest = write_files(tokens, width, order, folder)
    return read_files(manifest, order, folder, dict(tokens.dtypes)["id"]).withColumnRenamed("id", id_col)
