import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fixtures import DOCS, docs, empty, rows
from parcelscope.llm import toxicity_fm as T


def test_pairs_are_learned_where_no_single_term_tells():
    """Label 1 needs an insult and a target together; each alone is as common in label 0."""
    rng = random.Random(1)
    row, term, label = [], [], []
    for i in range(1500):
        insult, target = rng.random() < 0.5, rng.random() < 0.5
        have = ({0} if insult else set()) | ({1} if target else set()) | {rng.randrange(2, 40) for _ in range(4)}
        row += [i] * len(have)
        term += sorted(have)
        label.append(float(insult and target))
    row, term, label = np.array(row), np.array(term), np.array(label)
    bias, w, v = T.fit_machine(row, term, label, 40, epochs=60)
    raw = T._raw(bias, w, v, row, term, len(label))[0]
    assert ((raw > 0) == (label == 1)).mean() > 0.97
    assert v[0] @ v[1] > 0  # the interaction itself


def test_raw_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=6), rng.normal(size=(6, 3))
    have = [[0, 2, 5], [], [1]]
    row = np.array([i for i, t in enumerate(have) for _ in t])
    raw = T._raw(0.3, w, v, row, np.array(sum(have, [])), 3)[0]
    for got, t in zip(raw, have):
        pairs = sum(v[a] @ v[b] for i, a in enumerate(t) for b in t[:i])
        assert got == pytest.approx(0.3 + w[t].sum() + pairs / max(1, len(t)))


def corpus(spark, n=600):
    rng, out, labels = random.Random(3), [], []
    for i in range(n):
        bad = rng.random() < 0.3
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        if bad:
            w[rng.randrange(60)] = rng.choice(["grobian", "grobiane", "grobianen"]) + rng.choice(["", "s", "x"])
        out.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(out, "doc_id long, text string").repartition(3),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy(spark):
    table, labels, truth = corpus(spark)
    got = T.score(table, T.train(table, labels)).withColumn("out", T.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_only_the_training_folds_are_learned_from(spark):
    table, labels, _ = corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (rows(T.score(table, T.train(table, x)), "doc_id", "score") for x in (labels, flipped))
    assert a == b


def test_sample_bound(spark):
    table, labels, _ = corpus(spark, 400)
    machine = T.train(table, labels, sample=100)
    assert (machine.table >= 0).sum() <= T.TERMS


def test_awkward_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (15, 0), (15, 1), (777, 1)], "doc_id long, toxic int")
    got = T.score(docs(spark), T.train(docs(spark), labels)).collect()
    assert len(got) == len(DOCS) and all(r["score"] is not None for r in got)
    none = T.train(docs(spark), labels.filter("toxic is null"))
    assert all(r["score"] < 0.5 for r in T.score(docs(spark), none).collect())
    one = T.train(docs(spark), spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, toxic int"))
    assert all(r["score"] > 0.5 for r in T.score(docs(spark), one).collect())
    assert T.score(empty(spark), one).count() == 0


def test_inflected_forms_share_terms():
    a, b = (set(T.buckets(pa.array([t]))[1].tolist()) for t in ("grobiane", "grobianen"))
    assert len(a & b) >= 3
