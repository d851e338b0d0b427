"""Benchmark decontamination by winnowing.

Text is words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Of every 9 neighbouring
5-word grams the one with the least hash is a fingerprint. A span of 13 shared words holds 9 shared
grams, so both sides pick the same one: joining fingerprints finds every such span. Each hit is then
extended word by word in both directions, and counts if it reaches 13 words. Items under 13 words are
one window; for them every run of as many words is looked up.

The benchmark is cut into blocks of at most `block_bytes` of text (a longer item is a block of its
own). Each block is sent to the tasks, which read the documents once per block; the corpus is never
shuffled, and no block grows with it. With several blocks the hits of a document are merged.

Defined cases: a null or empty text has no words and no hits; an item without words matches
nothing; an item without an id still marks words but is not listed; repeated items and documents
are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_of
from .wordhash import ALNUM, grams, pieces, sliding_min, words_of

SPAN, GRAM = 13, 5
NEAR = SPAN - GRAM + 1  # grams in a span


class Block:
    """Fingerprints of some items. `long`: hash -> places; `short`: words -> hash -> items."""

    def __init__(self, items: list[tuple[str | None, str]]):
        words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        raw = words.data.tobytes()
        self.names, self.words = [], []
        long, short = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for i, (name, _) in enumerate(items):
            a, b = words.row[i], words.row[i + 1]
            if a == b:
                continue
            own = [raw[s:e] for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]
            k = len(self.names)
            self.names.append(name)
            self.words.append(own)
            if len(own) < SPAN:
                short[len(own)][int(grams(words.hash[a:b], len(own))[0])].append(k)
                continue
            g = grams(words.hash[a:b], GRAM)
            for h in set(sliding_min(g, NEAR).tolist()):
                long[h] += [(k, int(q)) for q in np.flatnonzero(g == np.uint64(h))]
        self.long = dict(long)
        self.short = {n: dict(x) for n, x in short.items()}
        self.long_keys = np.array(sorted(self.long), dtype=np.uint64)
        self.short_keys = {n: np.array(sorted(x), dtype=np.uint64) for n, x in self.short.items()}


def _known(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(hashes):
        return np.zeros(0, dtype=np.int64)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.flatnonzero(keys[at] == hashes)


def _hits(words, block: Block):
    """Yields (row, first word, end word, item) for each maximal shared run."""
    raw, rows, ws, we = None, words.row, words.start, words.end
    ends = rows[1:]

    def own(i, row):  # word i, unless another text's
        return raw[ws[i]:we[i]] if rows[row] <= i < rows[row + 1] else None

    g = grams(words.hash, GRAM)
    low = sliding_min(g, NEAR)
    picked = np.zeros(len(g), dtype=bool)
    for j in range(NEAR):  # a gram is a fingerprint if it is the least of any span around it
        if len(low):
            picked[j:j + len(low)] |= g[j:j + len(low)] == low
    found = np.flatnonzero(picked)
    found = found[_known(g[found], block.long_keys)]
    if len(found) or block.short:
        raw = words.data.tobytes()
    done: dict[tuple[int, int, int], int] = {}
    for p, h in zip(found.tolist(), g[found].tolist()):
        row = bisect_right(rows, p) - 1
        for k, q in block.long[h]:
            line = (row, k, p - q)
            if done.get(line, -1) > p:
                continue
            item = block.words[k]
            a, b = p, p
            while b - p + q < len(item) and own(b, row) == item[b - p + q]:
                b += 1
            if b == p:
                continue
            while a - p + q > 0 and own(a - 1, row) == item[a - 1 - p + q]:
                a -= 1
            done[line] = b
            if b - a >= SPAN:
                yield row, a, b, k
    for n, table in block.short.items():
        g = grams(words.hash, n)
        at = _known(g, block.short_keys[n])
        if not len(at):
            continue
        row = np.searchsorted(rows, at, side="right") - 1
        inside = at + n <= ends[row]
        for p, r, h in zip(at[inside].tolist(), row[inside].tolist(), g[at[inside]].tolist()):
            for k in table[h]:
                if all(raw[ws[p + j]:we[p + j]] == w for j, w in enumerate(block.words[k])):
                    yield r, p, p + n, k


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan(texts: pa.Array, block: Block) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, hit spans, items) of each text."""
    words = words_of(texts, ALNUM, lower=True)
    spans, items = defaultdict(list), defaultdict(set)
    for row, a, b, k in _hits(words, block):
        spans[row].append((a - int(words.row[row]), b - int(words.row[row])))
        if block.names[k] is not None:
            items[row].add(block.names[k])
    return [(int(n), _merged(spans[i]) if i in spans else [], sorted(items[i]) if i in items else [])
            for i, n in enumerate(words.counts.tolist())]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    """The benchmark's items block by block; the driver holds one block at a time."""
    items = text_of(benchmark, id_col, text_col).select(F.col("id").cast("string").alias("id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(2 * size / block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        held, total = [], 0
        for r in part.toLocalIterator():
            held.append((r["id"], r["text"]))
            total += len(r["text"])
            if total >= block_bytes:
                yield Block(held)
                held, total = [], 0
        if held or n == 1:
            yield Block(held)


_FOUND = "id {id}, n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: (id, n_words, n_hit, spans, items); spans are word ranges [first, end)."""
    spark = docs.sparkSession
    rows = text_of(docs, id_col, text_col)
    schema = _FOUND.format(id=dict(rows.dtypes)["id"])
    sent = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, item_id, item_text, block_bytes)]

    def task(block):
        def run(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    found = scan(part.column("text"), block.value)
                    yield pa.RecordBatch.from_arrays([
                        part.column("id"),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"first": a, "end": b} for a, b in x[1]] for x in found],
                                 pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
                        pa.array([x[2] for x in found], pa.list_(pa.string())),
                    ], names=["id", "n_words", "spans", "items"])
        return run

    if len(sent) == 1:
        out = rows.mapInArrow(task(sent[0]), schema)
    else:
        out = _over_blocks(rows, [task(b) for b in sent], schema)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))
    return out.select(F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), "spans", "items")


def _over_blocks(rows: DataFrame, tasks: list, schema: str) -> DataFrame:
    """Hits of all blocks together. Rows that share an id are told apart by their text's hash, and
    equal rows by how many there are."""
    keyed = rows.withColumn("copy", F.xxhash64("text"))
    parts = []
    for k, run in enumerate(tasks):
        part = keyed.select(F.struct("id", "copy").alias("id"), "text").mapInArrow(
            run, schema.replace(schema.split(", ")[0], f"id struct<id:{dict(rows.dtypes)['id']},copy:bigint>", 1))
        part = part if k == 0 else part.filter(F.size("spans") > 0)
        parts.append(part.withColumn("first", F.lit(k == 0).cast("int")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    flat = whole.groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.sum("first").alias("rows"),
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.array().cast("array<struct<first:int,end:int>>")

    def join(done, s):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["first"]), F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], s["end"]).alias("end"))))
        ).otherwise(F.concat(done, F.array(s)))

    flat = flat.withColumn("spans", F.aggregate(F.sort_array("spans"), start, join))
    flat = flat.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return flat.select(F.col("id.id").alias("id"), "n_words", "spans", "items")


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Rows of docs, with all their columns, under one hit word in `share` (or without any hit)."""
    spark = docs.sparkSession
    blocks = list(blocks_of(benchmark, item_id, item_text, block_bytes))
    if len(blocks) > 1:
        key = F.struct(F.lit(0).alias("z"), F.xxhash64(docs[text_col].cast("string")).alias("h"), F.octet_length(docs[text_col].cast("string")).alias("n"))
        texts = docs.select(key.alias("key"), docs[text_col].alias("text"))
        found = contamination(texts, benchmark, "key", "text", item_id, item_text, block_bytes)
        bad = found.filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select("key").distinct()
        return docs.join(bad, key == bad["key"], "left_anti")
    sent = spark.sparkContext.broadcast(blocks[0])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col):
                found = scan(part.column(text_col), sent.value)
                hit = [sum(b - a for a, b in spans) for _, spans, _ in found]
                yield part.filter(pa.array([h == 0 or share * h < n for h, (n, _, _) in zip(hit, found)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
