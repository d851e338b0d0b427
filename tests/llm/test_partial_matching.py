import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from fixtures import DOCS, docs, empty, lower_words, rows
from parcelscope.llm import partial_matching
from parcelscope.llm.partial_matching import ORDER, scored

COLS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def symbols(text):
    return "".join(w + " " for w in lower_words(text)).encode() + b"\n"


def held(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def brute(table):
    seen, tokens = defaultdict(Counter), Counter()
    for d, t in table:
        if not held(d):
            raw = b"\n" * ORDER + symbols(t)
            for i in range(ORDER, len(raw)):
                for k in range(ORDER, -1, -1):
                    seen[raw[i - k:i]][raw[i]] += 1
                    if seen[raw[i - k:i]][raw[i]] > 1:
                        break  # a context that knows the symbol does not ask a shorter one
            tokens.update(lower_words(t) + [""])
    n, v = sum(tokens.values()), len(tokens)

    def log10(context, symbol):
        total, out = 0.0, set()
        for k in range(len(context), -1, -1):
            left = {s: c for s, c in seen.get(context[len(context) - k:], {}).items() if s not in out}
            every = sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * every))
            if left:
                total += math.log10(len(left) / (2 * every))
            out |= set(left)
        return total - math.log10(252 - len(out))

    found = []
    for d, t in table:
        raw = b"\n" * ORDER + symbols(t)
        own = lower_words(t) + [""]
        found.append((d, held(d), len(own), sum(tokens[w] > 0 for w in own), n,
                      sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own),
                      sum(log10(raw[i - ORDER:i], raw[i]) for i in range(ORDER, len(raw)))))
    return sorted(found, key=repr)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("chunk", [500, 8 << 20])
def test_same_as_brute_force(spark, chunk):
    same(rows(scored(docs(spark), chunk=chunk), *COLS), brute([d[:2] for d in DOCS]))


def test_many_texts_and_slices(spark, monkeypatch):
    rng = random.Random(5)
    table = [(i, " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    table += [(300 + i, table[7][1]) for i in range(100)] + [(None, "\0\0\0\0\0\0\0\0 \0\0\0\0\0\0\0"), (401, "\0" * 20), (401, "\0" * 20)]
    same(rows(scored(spark.createDataFrame(table, "doc_id long, text string").repartition(5), chunk=3000), *COLS), brute(table))


def test_ranks_of_wide_and_narrow_codes():
    import numpy as np

    rng = np.random.default_rng(1)
    for high, n in ((1 << 48, 200_000), (1 << 20, 5000), (3, 1)):
        codes = rng.integers(0, high, n).astype(np.uint64)
        order, head = partial_matching._ranks(codes)
        assert (np.sort(codes) == codes[order]).all()
        assert (np.unique(codes) == codes[order[head]]).all()


def test_probabilities_of_a_context_sum_to_one():
    import numpy as np

    rng = random.Random(2)
    raw = b"\n" * ORDER + symbols(" ".join(rng.choice(("red", "read", "dear", "are", "ear")) for _ in range(400)))
    codes = np.array([int.from_bytes(raw[i - ORDER:i + 1], "big") for i in range(ORDER, len(raw))], dtype=np.uint64)
    trie = partial_matching.Trie(ORDER, *partial_matching._summed(codes, np.ones(len(codes), dtype=np.int64)))
    for context in (b"d rea", b"zzzzz", b"\n\n\n\n\n", b"xxear"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256) if s == 10 or s == 32 or not 9 <= s <= 13], dtype=np.uint64)
        assert len(asked) == 252
        assert (10 ** trie.log10(asked)).sum() == pytest.approx(1)


def test_no_training_text_and_other_ids(spark):
    from pyspark.sql import functions as F

    table = [("a", "one two"), ("b", None)]
    got = rows(scored(spark.createDataFrame(table, "key string, body string"), "key", "body", held=lambda c: F.lit(True)), "key", "n_tokens", "n_known", "base_score", "score")
    assert [g[:3] for g in got] == [("a", 3, 0), ("b", 1, 0)]
    assert got[0][3] == 0 and got[0][4] == pytest.approx(-9 * math.log10(252), rel=1e-6)
    assert got[1][4] == pytest.approx(-math.log10(252), rel=1e-6)


def test_empty_table(spark):
    assert scored(empty(spark)).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    from parcelscope.llm import queries

    got = queries.QUERIES["op11_lm_scoring"](spark, "/root/testdata/sf0.1").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > 0.97 * got["b"]
