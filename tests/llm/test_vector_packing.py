import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fixtures import DOCS, docs, empty
from parcelscope.llm import vector_packing as V


def corpus(spark, n, seed=1, hot=0):
    rng = random.Random(seed)
    table = [(i, " ".join(["word"] * int(rng.paretovariate(1.2) * 5))[:20_000] + f" {rng.randrange(n)}") for i in range(n)]
    table += [(n + i, "the same text") for i in range(hot)]
    return table, spark.createDataFrame(table, "doc_id long, text string").repartition(4)


def placed(df, **kw):
    return V.pack(df, **kw).collect()


@pytest.mark.parametrize("cell", [50, 4096])
def test_shards_are_even_and_slots_gapless(spark, cell):
    table, df = corpus(spark, 3000)
    got = placed(df, shards=8, cell=cell)
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in table)
    text = dict(table)
    size, slots, shard_of = np.zeros(8), defaultdict(list), {}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(raw, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert size.max() / size.mean() < 1.02
    counts = np.array([len(slots[k]) for k in range(8)])
    assert counts.max() / counts.mean() < 1.1


def test_a_group_beyond_a_shards_share_is_cut(spark):
    table, df = corpus(spark, 400, hot=900)
    got = placed(df, shards=4)
    rows = defaultdict(int)
    for r in got:
        rows[r["shard"]] += 1
    assert max(rows.values()) < 1.15 * len(table) / 4


def test_awkward_rows(spark):
    got = placed(docs(spark), shards=3)
    want = sorted(((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in DOCS), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= {0, 1, 2} and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert V.pack(empty(spark)).count() == 0


def test_slots_over_many_buckets(spark):
    df = spark.range(1000).selectExpr("id % 300 as id", "1L as size", "id % 7 as text_crc32", "cast(id % 2 as int) as shard")
    got = V.numbered(df, per_bucket=40).collect()
    for k in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(500))


def test_dot_product_rule():
    shard, load = V.place(np.array([[0.5, 0.1, 0.1], [0.1, 0.5, 0.1], [0.4, 0.1, 0.2]]), np.array([[0.6, 0.5, 0.5], [0.5, 0.6, 0.5]]))
    assert shard.tolist() == [0, 1, 1] and load[0].tolist() == pytest.approx([0.5, 0.1, 0.1])
