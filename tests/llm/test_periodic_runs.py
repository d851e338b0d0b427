import random
from zlib import crc32

import numpy as np
import pytest

from fixtures import DOCS, docs, empty, rows, words
from parcelscope.llm.periodic_runs import PRIME, periodic_runs, planted, restored, runs_of, transformed, zero_mismatch

COLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(table, plant=False):
    out = []
    for d, t in table:
        w = words(t)
        h = crc32(str(d).encode())
        if plant and d is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        out.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, runs,
                    " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:6], [tuple(x) for x in r[6]], r[7]) for r in rows(df, *COLS)), key=repr)


def test_same_as_brute_force(spark):
    table = [d[:2] for d in DOCS if len(d[1] or "") < 20_000]
    few = docs(spark).filter("length(text) < 20000 or text is null")
    assert got(periodic_runs(few)) == brute(table)
    assert got(periodic_runs(few, placed=planted)) == brute(table, plant=True)


def random_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 150))]
    if kind == 1:
        unit = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90))]
        return [rng.choice("xyz") for _ in range(rng.randrange(30))] + unit * rng.randrange(1, 6) + unit[:rng.randrange(len(unit))]
    if kind == 2:  # a Fibonacci word, full of runs
        a, b = ["a"], ["a", "b"]
        while len(b) < 300:
            a, b = b, b + a
        return b[:rng.randrange(300)]
    if kind == 3:
        return ["a"] * rng.randrange(0, 400)
    if kind == 4:  # runs in runs
        unit = ["a"] * 13 + ["b"] * 12 + [rng.choice("cd") for _ in range(rng.randrange(20))]
        return unit * rng.randrange(1, 5)
    one = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(2, 140))]
    return one + one + [f"w{rng.randrange(50)}"] + one


def test_random_texts(spark):
    rng = random.Random(11)
    table = [(i, " ".join(random_words(rng))) for i in range(400)]
    assert got(periodic_runs(spark.createDataFrame(table, "doc_id long, text string").repartition(3))) == brute(table)


def test_planted_repeats(spark):
    rng = random.Random(12)
    table = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 700)))) for i in range(150)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    found = got(periodic_runs(df, placed=planted))
    assert found == brute(table, plant=True)
    assert sum(f[1] > 0 for f in found) >= 8


def test_long_single_word_text_is_one_run():
    numbers = np.zeros(200_000, dtype=np.int64)
    assert runs_of(numbers, np.array([0, len(numbers)])).tolist() == [[0, 200_000, 1]]


@pytest.mark.parametrize("n", [2, 8, 64])
def test_transform_is_exact(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, PRIME, (2, 3, n)).astype(np.uint64)
    assert (restored(transformed(a)) == a).all()
    product = restored(transformed(a) * transformed(b) % np.uint64(PRIME))
    for r in range(3):
        want = [sum(int(a[r, i]) * int(b[r, (k - i) % n]) for i in range(n)) % PRIME for k in range(n)]
        assert product[r].tolist() == want


def test_zero_mismatch_finds_every_occurrence():
    rng = np.random.default_rng(4)
    for size in (8, 16):
        numbers = np.concatenate([rng.integers(0, 2, 40), np.tile(rng.integers(0, 3, 17), 12), np.zeros(5 * size, int)]).astype(np.uint64)
        begin = np.arange(0, 200, size)
        i, d = zero_mismatch(numbers, begin, size)
        want = [(k, x) for k, b in enumerate(begin) for x in range(2 * size - 1, 4 * size - 1)
                if (numbers[b:b + size] == numbers[b + x:b + x + size]).all()]
        assert list(zip(i.tolist(), d.tolist())) == want


def test_empty_table_and_other_names(spark):
    assert periodic_runs(empty(spark)).count() == 0
    df = spark.createDataFrame([("k", "a b " * 6, 5), (None, None, 6)], "key string, body string, n_runs int")
    assert rows(periodic_runs(df, "key", "body"), "key", "n_runs", "collapsed") == [("k", 1, "a b"), (None, 0, "")]
