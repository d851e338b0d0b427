"""Repeated passages, found by super-k-mers.

A window is 13 consecutive words of one document. Its minimiser is the least hash of its 4-word
grams. Neighbouring windows mostly share it, and travel together as one string (a super-k-mer) to
the bucket of that minimiser; equal windows have equal minimisers, so they meet there. A task reads
its buckets in order of minimiser and document, sorts the windows of a batch by hash, and compares
the words of equal hashes, so a window counts as seen only if its words were. The first document of
a window keeps it; later ones lose every word that it covers.

Super-k-mers travel in blocks: what a batch has for one partition is one compressed Arrow message,
which takes under half the room that rows do. The receiving task unpacks them and Spark sorts them.

Before the shuffle, equal super-k-mers of a batch are folded: all but the smallest document's are
known to be repeats. A bucket that spans batches is carried as a dictionary of at most
`carried` windows; windows that no longer fit are judged by a second pass, grouped by themselves.
So neither memory nor one task has to hold a whole bucket.

Defined cases: a null or empty text, or one under 13 words, loses nothing. Rows that share a
document's id are no earlier than each other. A null id comes after all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_of, written
from .wordhash import NOT_SPACE, grams, mixed, packed, pieces, sliding_min, words_of

SPAN, GRAM = 13, 4
LAST = (1 << 63) - 1

#: bucket; document (its rank, and its text's hash to tell rows with one id apart); first word;
#: windows; their words, or null where the windows are already known to be repeats
_SUPER = "bucket int, doc long, copy long, first int, n int, words binary"
_RANGE = "doc long, copy long, first int, end int, words binary"


def _super_kmers(part: pa.RecordBatch) -> pa.RecordBatch:
    words = words_of(part.column("text"), NOT_SPACE)
    low = sliding_min(grams(words.hash, GRAM), SPAN - GRAM + 1)
    counts = words.counts
    windows = np.maximum(counts - (SPAN - 1), 0)
    row = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + words.row[row]
    low = low[at]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(head)
    n = np.diff(np.append(head, len(at)))
    raw, begin, end = packed(words) if len(head) else (b"", at, at)
    a, b = begin[at[head]], end[at[head] + n - 1 + SPAN - 1]
    packs = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
    doc = part.column("doc").to_numpy(zero_copy_only=False)[row[head]]
    copy = part.column("copy").to_numpy(zero_copy_only=False)[row[head]]
    first = at[head] - words.row[row[head]]
    code = packs.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    least = np.full(code.max() + 1 if len(code) else 0, LAST)
    np.minimum.at(least, code, doc)
    repeat = doc > least[code]
    bucket = (np.where(repeat, mixed(doc.astype(np.uint64)), low[head]) >> np.uint64(33)).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(bucket), pa.array(doc), pa.array(copy), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)),
        pc.if_else(pa.array(repeat), pa.scalar(None, pa.binary()), packs),
    ], names=["bucket", "doc", "copy", "first", "n", "words"])


def _blocks(rows: pa.RecordBatch, partitions: int) -> pa.RecordBatch:
    """(part, block): the rows of each partition, compressed."""
    part = rows.column("bucket").to_numpy() % partitions
    order = np.argsort(part, kind="stable")
    rows, part = rows.take(pa.array(order)), part[order]
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    out = []
    for a, b in zip(begin.tolist(), [*begin.tolist()[1:], len(part)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(rows.slice(a, b - a))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array(out, pa.binary())], names=["part", "block"])


def _gathered(batches, rows: int):
    """Batches joined to `rows` rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


class _Judge:
    """Windows in order of (bucket, document); tells which were seen in an earlier document."""

    def __init__(self, carried: int):
        self.bucket, self.seen, self.carried = None, {}, carried

    def __call__(self, batch: pa.RecordBatch):
        """(removed row, first, end)..., (undecided row, first, words)..."""
        bucket = batch.column("bucket").to_numpy()
        doc = batch.column("doc").to_numpy()
        words = words_of(batch.column("words").cast(pa.large_binary()).view(pa.large_string()), NOT_SPACE)
        counts = np.maximum(words.counts - (SPAN - 1), 0)
        row = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = offset + words.row[row]
        raw, begin, end = words.data.tobytes(), words.start[at], words.end[at + SPAN - 1]
        removed = np.zeros(len(row), dtype=bool)
        open_rows = (bucket[row] == bucket[-1]) | (bucket[row] == self.bucket)  # may meet other batches
        if len(row):
            self._within(grams(words.hash, SPAN)[at], raw, begin, end, doc[row], ~open_rows, removed)
        undecided = []
        for i in np.flatnonzero(open_rows).tolist():
            r = row[i]
            if bucket[r] != self.bucket:
                self.bucket, self.seen = bucket[r], {}
            key = raw[begin[i]:end[i]]
            was = self.seen.get(key)
            if was is not None:
                removed[i] = was < doc[r]
            elif len(self.seen) < self.carried:
                self.seen[key] = int(doc[r])
            else:
                undecided.append((r, int(offset[i]), key))
        if len(bucket) and bucket[-1] != self.bucket:
            self.bucket, self.seen = bucket[-1], {}
        return row, offset, removed, undecided

    @staticmethod
    def _within(h, raw, begin, end, doc, use, removed) -> None:
        """Windows whose bucket lies in this batch: sort by hash, then compare the words."""
        i = np.flatnonzero(use)
        i = i[np.argsort(h[i], kind="stable")]  # equal hashes stay in order of document
        if not len(i):
            return
        head = np.ones(len(i), dtype=bool)
        head[1:] = h[i][1:] != h[i][:-1]
        first = i[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = np.flatnonzero(doc[i] > doc[first])
        for x, f in zip(i[later].tolist(), first[later].tolist()):
            if raw[begin[x]:end[x]] == raw[begin[f]:end[f]]:
                removed[x] = True
            else:  # two different windows with one hash: look at all of them
                removed[x] = any(h[y] == h[x] and doc[y] < doc[x] and raw[begin[y]:end[y]] == raw[begin[x]:end[x]]
                                 for y in i.tolist())


def _ranges(rows: pa.RecordBatch, row, offset, removed, undecided) -> pa.RecordBatch:
    """Runs of removed windows as word ranges, and the undecided windows with their words."""
    x = np.flatnonzero(removed)
    head = np.ones(len(x), dtype=bool)
    head[1:] = (row[x][1:] != row[x][:-1]) | (offset[x][1:] != offset[x][:-1] + 1)
    a = x[head]
    b = x[np.append(head[1:], True)] if len(x) else x
    take = np.concatenate([row[a], np.array([u[0] for u in undecided], dtype=np.int64)]).astype(np.int64)
    first = rows.column("first").to_numpy()[take] + np.concatenate(
        [offset[a], np.array([u[1] for u in undecided], dtype=np.int64)])
    size = np.concatenate([offset[b] - offset[a], np.zeros(len(undecided), np.int64)]) + SPAN
    return pa.RecordBatch.from_arrays([
        rows.column("doc").take(pa.array(take)), rows.column("copy").take(pa.array(take)),
        pa.array(first.astype(np.int32)), pa.array((first + size).astype(np.int32)),
        pa.array([None] * len(a) + [u[2] for u in undecided], pa.binary()),
    ], names=["doc", "copy", "first", "end", "words"])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: int = 500_000) -> DataFrame:
    """(doc, copy, first, end): word ranges that a smaller document also has. May overlap."""
    rows = keyed(docs, id_col, text_col).select("doc", "copy", "text")

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield _blocks(_super_kmers(part), partitions)
                pa.default_memory_pool().release_unused()

    def unpack(batches):
        for batch in batches:
            for block in batch.column("block"):
                yield from pa.ipc.open_stream(block.as_buffer())

    def judge(batches):
        state = _Judge(carried)
        for batch in _gathered(batches, 8000):
            known = batch.column("words").is_null()
            folded = batch.filter(known)
            if folded.num_rows:
                first = folded.column("first").to_numpy()
                yield pa.RecordBatch.from_arrays([
                    folded.column("doc"), folded.column("copy"), folded.column("first"),
                    pa.array((first + folded.column("n").to_numpy() + SPAN - 1).astype(np.int32)),
                    pa.nulls(folded.num_rows, pa.binary())], names=["doc", "copy", "first", "end", "words"])
            left = batch.filter(pc.invert(known))
            if left.num_rows:
                yield _ranges(left, *state(left))

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(cut, "part int, block binary").repartitionById(partitions, F.col("part"))
    dealt = blocks.mapInArrow(unpack, _SUPER).sortWithinPartitions("bucket", "doc")
    judged = written(dealt.mapInArrow(judge, _RANGE), "repeated-ranges")
    left = judged.filter("words is not null")
    least = left.groupBy("words").agg(F.min("doc").alias("least"))
    late = left.join(least, "words").filter("doc > least").select("doc", "copy", "first", "end")
    return judged.filter("words is null").select("doc", "copy", "first", "end").unionByName(late)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = text_of(docs, id_col, text_col)
    return rows.select("id", F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64("text").alias("copy"), "text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: int = 500_000) -> DataFrame:
    """(id, n_words, n_removed, kept): kept words of every row, joined by one space."""
    found = repeated_ranges(docs, id_col, text_col, carried)
    ranges = found.groupBy("doc", "copy").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    rows = keyed(docs, id_col, text_col).join(ranges, ["doc", "copy"], "left").select("id", "text", "ranges")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"), NOT_SPACE)
                raw, out = words.data.tobytes(), []
                for i, spans in enumerate(part.column("ranges").to_pylist()):
                    a, b = words.row[i], words.row[i + 1]
                    keep = np.ones(b - a, dtype=bool)
                    for s in spans or ():
                        keep[s["first"]:s["end"]] = False
                    at = np.flatnonzero(keep) + a
                    kept = b" ".join([raw[x:y] for x, y in zip(words.start[at].tolist(), words.end[at].tolist())])
                    out.append((int(b - a), int(b - a - len(at)), kept.decode()))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()),
                ], names=["id", "n_words", "n_removed", "kept"])

    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
