"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their first 4, 5 and 6 bytes (for inflected forms),
hashed into 2 ** 22 buckets and counted once per text. The machine scores
bias + sum w[i] + 1/m * sum over pairs <v[i], v[j]>, so that a pair of terms (an insult and whom it
meets) can weigh more, or less, than both alone; m is the number of terms found.

It is fitted on about `sample` labelled rows, taken by a hash of the id from the folds open to
training. That bound is the only one: the terms that separate the labels best are chosen in one
task over the sample, the machine is fitted on the driver over those terms, and every text is scored
whole, in parallel.

Defined cases: a null or empty text has no terms and gets the score of the bias; a row without an
id counts as held out; null labels are ignored; if a document has several labels the highest holds;
without any usable label, or with one class only, every score is that class's share (0 if none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import text_of, written
from .wordhash import _MASK, ALNUM, mixed, pieces, words_of

BITS, PREFIXES = 22, (4, 5, 6)
SAMPLE, TERMS, FACTORS = 16_000, 4096, 8
SIGNIFICANT = 5.0  # standard errors by which a term's share must differ between the classes


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(True))


def buckets(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every different term of each text; with a table, only of terms that it numbers
    (-1: not), as (row, number)."""
    words = words_of(texts, ALNUM, lower=True)
    size = words.end - words.start
    row, shift = words.owner(), np.uint64(64 - BITS)
    eights = np.ndarray(shape=(len(words.data) - 7,), dtype="<u8", buffer=words.data, strides=(1,))
    rows, terms = [row], [mixed(words.hash + np.uint64(1)) >> shift]
    for p in PREFIXES:
        long = np.flatnonzero(size >= p)
        rows.append(row[long])
        terms.append(mixed((eights[words.start[long]] & _MASK[p]) + np.uint64(p << 56)) >> shift)
    rows, terms = np.concatenate(rows), np.concatenate(terms).astype(np.int64)
    if table is not None:
        terms = table[terms].astype(np.int64)
        rows, terms = rows[terms >= 0], terms[terms >= 0]
    both = np.unique(rows << np.int64(BITS) | terms)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Machine:
    table: np.ndarray  # bucket -> number of the term, or -1
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, term = buckets(texts, self.table)
        return 1 / (1 + np.exp(-np.clip(_raw(self.bias, self.w, self.v, row, term, len(texts))[0], -30, 30)))


def _raw(bias, w, v, row, term, n):
    m = np.maximum(np.bincount(row, minlength=n), 1)
    linear = np.bincount(row, w[term], minlength=n)
    s = np.stack([np.bincount(row, v[term, f], minlength=n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, (v[term] ** 2).sum(axis=1), minlength=n)
    return bias + linear + ((s ** 2).sum(axis=1) - squares) / 2 / m, s, m


def fit_machine(row: np.ndarray, term: np.ndarray, label: np.ndarray, terms: int, factors: int = FACTORS,
                epochs: int = 30, batch: int = 512, rate: float = 0.1, decay: float = 1e-4, seed: int = 7):
    """(bias, w, v) by Adagrad on the logistic loss; the rarer class weighs more, half way to even."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(terms), rng.normal(0, 0.05, (terms, factors)), 0.0
    gw, gv, gb = np.full(terms, 1e-6), np.full((terms, factors), 1e-6), 1e-6
    share = np.where(label == 1, label.sum(), len(label) - label.sum()) / len(label)
    weight = np.sqrt(0.5 / share)
    begin = np.searchsorted(row, np.arange(len(label) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for k in range(0, len(order), batch):
            docs = order[k:k + batch]
            n = begin[docs + 1] - begin[docs]
            at = np.repeat(begin[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            r, t = np.repeat(np.arange(len(docs)), n), term[at]
            z, s, m = _raw(bias, w, v, r, t, len(docs))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[docs]) * weight[docs] / len(docs)
            g = np.bincount(t, d[r], minlength=terms) + decay * w
            gw += g ** 2
            w -= rate * g / np.sqrt(gw)
            part = (d / m)[r][:, None] * (s[r] - v[t])
            g = np.stack([np.bincount(t, part[:, f], minlength=terms) for f in range(factors)], axis=1) + decay * v
            gv += g ** 2
            v -= rate / 4 * g / np.sqrt(gv)
            gb += d.sum() ** 2
            bias -= rate * d.sum() / np.sqrt(gb)
    return float(bias), w, v


def _choose(sample: DataFrame, terms: int) -> np.ndarray:
    """Buckets whose share differs most between the classes, in standard errors; counted in one task,
    which the size of the sample bounds."""

    def run(batches):
        seen, docs = np.zeros((2, 1 << BITS), dtype=np.int32), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                label = part.column("toxic").to_numpy(zero_copy_only=False)
                row, term = buckets(part.column("text"))
                for y in (0, 1):
                    seen[y] += np.bincount(term[label[row] == y], minlength=1 << BITS).astype(np.int32)
                    docs[y] += (label == y).sum()
        used = np.flatnonzero(seen.sum(axis=0) >= 3)
        n = np.maximum(docs, 1)
        p0, p1 = seen[0, used] / n[0], seen[1, used] / n[1]
        p = (seen[0, used] + seen[1, used]) / max(1, docs.sum())
        z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
        best = used[np.lexsort((used, -z))[:min(terms, int((z >= SIGNIFICANT).sum()))]]
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64())], names=["bucket"])

    rows = sample.repartition(1).mapInArrow(run, "bucket long").collect()
    return np.array([r["bucket"] for r in rows], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, terms: int = TERMS, seed: int = 1) -> Machine:
    known = (labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic"))
             .filter("toxic is not null and id is not null").filter(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = known.count()
    if n > sample:
        draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * sample / n)
        known = known.filter(draw)
    # about `sample` rows of two numbers, so they can be sent to every task
    rows = text_of(docs, id_col, text_col).join(F.broadcast(known), "id").select("id", "text", "toxic")
    rows = written(rows, "labelled")
    table = np.full(1 << BITS, -1, dtype=np.int32)
    shares = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        p = 1e-9 if 1 not in shares else 1 - 1e-9
        return Machine(table, float(np.log(p / (1 - p))), np.zeros(1), np.zeros((1, FACTORS)))
    best = _choose(rows, terms)
    table[best] = np.arange(len(best))
    if not len(best):
        p = shares[1] / (shares[0] + shares[1])
        return Machine(table, float(np.log(p / (1 - p))), np.zeros(1), np.zeros((1, FACTORS)))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def found(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                row, term = buckets(part.column("text"), sent.value)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), lists], names=["id", "toxic", "terms"])

    got = rows.mapInArrow(found, f"id {dict(rows.dtypes)['id']}, toxic int, terms array<int>").toPandas()
    got = got.sort_values("id", kind="stable").reset_index(drop=True)  # the same machine whatever the order of tasks
    n = got["terms"].map(len).to_numpy()
    term = np.concatenate([np.asarray(t, dtype=np.int64) for t in got["terms"]] + [np.zeros(0, np.int64)])
    bias, w, v = fit_machine(np.repeat(np.arange(len(n)), n), term, got["toxic"].to_numpy(float), len(best))
    return Machine(table, bias, w, v)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = text_of(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sent.value.scores(part.column("text")), pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
