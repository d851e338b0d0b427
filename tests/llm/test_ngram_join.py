import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fixtures import DOCS, docs, empty, lower_words, rows
from parcelscope.llm import ngram_join as J


def shingle_set(text):
    w = lower_words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(table):
    sets = [shingle_set(t) for _, t in table]
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(table):
        least[find(i)].append(d)
    name = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return sorted(((d, len(sets[i]), name[find(i)] if sets[i] else d) for i, (d, _) in enumerate(table)), key=repr)


COLS = ("doc_id", "n_shingles", "component_id")


def check(spark, table):
    got = J.linked(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert rows(got, *COLS) == brute(table)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.pop(k), lambda: words.insert(k, f"e{rng.random()}"),
                    lambda: words.__setitem__(k, f"r{rng.random()}")])()
    return words


def test_awkward_rows(spark):
    assert rows(J.linked(docs(spark)), *COLS) == brute([d[:2] for d in DOCS])


def test_empty_table(spark):
    assert J.linked(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_all_sizes(spark, seed):
    rng, table = random.Random(seed), []
    for size in [5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 64, 70, 100, 150, 260]:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(9):  # around the threshold: each edit changes up to five shingles
            table.append((len(table), " ".join(edited(base, rng, rng.randrange(0, max(2, size // 20))))))
        for cut in (1, 2, size // 10, size // 8, size // 6):
            table.append((len(table), " ".join(base[cut:])))
    rng.shuffle(table)
    check(spark, table)


def test_a_shared_passage_links_nothing(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(100)]
    table = [(i, " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(50)])) for i in range(120)]
    table += [(200 + i, " ".join(passage + [f"t{i // 10}x{k}" for k in range(50)] + [f"z{i}"])) for i in range(60)]
    check(spark, table)


def test_repetitive_sets(spark):
    check(spark, [(i, " ".join(["a", "b", "c"][: 1 + i % 3] * (3 + i))) for i in range(40)] + [(99, "x y"), (98, "X Y"), (97, "y x")])


def test_every_close_pair_shares_an_indexed_signature(spark):
    """The guarantee itself, on hashed sets around the largest difference, for all small sizes."""
    import pandas as pd
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    frames, pairs = [], []
    for size in [*range(4, 60), 80, 120, 200, 400]:
        for _ in range(12):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            b = list(a)
            while True:
                c = list(b)
                if rng.random() < 0.5 and len(c) > 1:
                    c.pop(rng.integers(len(c)))
                else:
                    c.append(rng.integers(0, 2**63, dtype=np.uint64))
                both = len(set(a.tolist()) & set(map(int, c)))
                if 100 * both < 80 * (len(a) + len(c) - both):
                    break
                b = c
            small, large = sorted((np.sort(a), np.sort(np.array(b, dtype=np.uint64))), key=len)
            if len(small) == len(large) and (small == large).all():
                continue
            k = 2 * len(pairs)
            pairs.append((k, k + 1, len(small) == len(large)))
            for node, s in ((k, small), (k + 1, large)):
                n = np.array([len(s)])
                row = np.zeros(len(s), dtype=np.int64)
                band = np.searchsorted(J.BANDS, n, side="right") - 1
                first = J.BANDS[band]
                own = np.where(J.largest_difference(n) >= 1, band, -1)
                before = np.where((band > 0) & (-(-n * 4 // 5) < first) & (J.largest_difference(first - 1) >= 1), band - 1, -1)
                for part in (J._scheme(row, s, own, True), J._scheme(row, s, before, False)):
                    frames.append(pd.DataFrame({"sig": part[1].view(np.int64), "node": node, "size": len(s), "tag": part[2]}))
    sigs = spark.createDataFrame(pd.concat(frames, ignore_index=True)).selectExpr("sig", "node", "cast(size as int) size", "tag").repartition(4)
    many = sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi")
    shared = J.written(sigs.join(many, "sig").select("sig", "node", "size", "tag", "n"), "shared")
    indexed = {(r["sig"], r["node"]) for r in J._indexed(shared).collect()}
    has = {}
    for r in shared.collect():
        has.setdefault(r["node"], set()).add(r["sig"])
    for x, y, even in pairs:
        meet = has.get(x, set()) & has.get(y, set())
        assert any((s, x) in indexed or even and (s, y) in indexed for s in meet), (x, y)
    assert len(indexed) < shared.count() / 4


def test_sets_with_enough_segments_of_their_own_index_nothing(spark):
    """Documents that only share a passage: no segment is looked at, however many they are."""
    passage = " ".join(f"p{i}" for i in range(30))
    table = [(i, " ".join(f"w{i}x{j}" for j in range(200)) + " " + passage) for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    shared = J._shared(df, "doc_id", "text")
    assert shared.count() > 0 and J._allocated(shared).count() == 0
    assert {r["component_id"] for r in J.linked(df).collect()} == set(range(60))


def test_sketches_bound_the_difference():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (6, 40, 200, 900)]
    row, h = J.shingles(pa.array(texts))
    size = np.bincount(row, minlength=4)
    for s, n in zip(J._sketches(row, h, size), size):
        ones = sum(bin(int(x) & (2**64 - 1)).count("1") for x in s)
        assert ones <= n and (n - ones) % 2 == 0 and len(s) * 64 >= n


def component_roots(table):
    """A name for each component of rows with a set, also where rows share an id."""
    sets = [shingle_set(t) for _, t in table]
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return {find(i) for i in range(len(table)) if sets[i]}


def test_keep_one(spark):
    out = J.keep_one(docs(spark))
    assert out.columns == docs(spark).columns
    kept, whole = [r[:2] for r in rows(out, *out.columns)], [d[:2] for d in DOCS]
    assert all(d in whole for d in kept)
    assert sum(bool(shingle_set(t)) for _, t in kept) == len(component_roots(whole))
    assert sum(not shingle_set(t) for _, t in kept) == sum(not shingle_set(t) for _, t in whole)
    named = {c for _, n, c in brute(whole) if n}
    assert {d for d, t in kept if shingle_set(t)} == named


def test_near_misses_of_one_text_are_told_apart_in_the_join(spark, monkeypatch):
    """Copies of one text with four words changed in each are at 0.76 of each other: none is linked, and
    their pairs are not handed on from each signature that they share."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(300), 4):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    counts, ordered = [], J._ordered

    def counted(pairs, sets):
        counts.append(pairs.count())
        return ordered(pairs, sets)

    monkeypatch.setattr(J, "_ordered", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] for r in J.linked(docs).collect())
    assert counts[-1] <= 200, counts
