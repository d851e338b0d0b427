import random

import pytest

from fixtures import DOCS, docs, empty, rows, words
from parcelscope.llm import substring_dedup


def brute(table):
    least = {}
    for d, t in table:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            least[k] = min(least.get(k, 1 << 63), d if d is not None else (1 << 63) - 1)
    out = []
    for d, t in table:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if least[tuple(w[i:i + 13])] < (d if d is not None else (1 << 63) - 1):
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_words", "n_removed", "kept")


@pytest.mark.parametrize("carried", [0, 3, 500_000])
def test_same_as_brute_force(spark, carried):
    got = substring_dedup.deduplicated(docs(spark), carried=carried)
    assert rows(got, *COLS) == brute([d[:2] for d in DOCS])


@pytest.mark.parametrize("carried", [5, 500_000])
def test_repetitive_texts(spark, carried):
    rng = random.Random(3)
    table = [(i, " ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(10, 120)))) for i in range(60)]
    table += [(i, "ab " * rng.randrange(5, 90)) for i in range(60, 90)]
    got = substring_dedup.deduplicated(spark.createDataFrame(table, "doc_id long, text string").repartition(4), carried=carried)
    assert rows(got, *COLS) == brute(table)


def test_many_small_batches(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    table = [(i, " ".join(f"u{rng.randrange(50)}" for _ in range(20)) + " " + passage + f" t{i}") for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(substring_dedup.deduplicated(spark.createDataFrame(table, "doc_id long, text string").repartition(5)), *COLS)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(table)


def test_empty_table(spark):
    assert substring_dedup.deduplicated(empty(spark)).count() == 0
