import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import DOCS, docs, empty, rows, words
from parcelscope.llm import rule_ledger as L

NASTY = [
    (1, "a b c d e " * 30, None), (2, "x\n\nx\n x\ny\ny y\n", None), (3, "w" * 200_000, None), (4, "#*$%&|<> " * 12, None),
    (5, "one two three four five six seven eight nine ten one two three four five", None),
    (6, "Ü ß 漢字 \x0b\x0c word\r\nword\r\n", None), (7, "A B C D E F G H I J K L", None), (8, "aaaaa " * 5, None)]


def brute(text):
    t = text or ""
    w = words(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    m = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", t)),
             n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), n_lines=len(lines),
             n_upper=len(re.findall("[A-Z]", t)))
    bits = sum(r.mask for r in L.RULES if eval(r.fails, {}, m))
    return (*(m[k] for k in L.MEASURES), bits)


def test_same_as_brute_force(spark):
    got = rows(L.ledger(docs(spark)), "doc_id", *L.MEASURES, "failed_bits")
    assert got == sorted(((d[0], *brute(d[1])) for d in DOCS), key=repr)
    more = spark.createDataFrame(NASTY, "doc_id long, text string, failed_bits int")
    got = rows(L.ledger(more), "doc_id", *L.MEASURES, "failed_bits")
    assert got == sorted(((d[0], *brute(d[1])) for d in NASTY), key=repr)


def test_main_path_has_no_python(spark):
    plan = L.keep(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def test_empty_table(spark):
    assert L.ledger(empty(spark)).count() == 0 and L.keep(empty(spark)).count() == 0


@pytest.mark.parametrize("name", list(L.POLICIES))
def test_policies_and_ablations_come_from_the_bits(spark, name):
    kept = [d for d in DOCS if not brute(d[1])[-1] & L.POLICIES[name]]
    assert rows(L.keep(docs(spark), name), *docs(spark).columns) == sorted(kept, key=repr)
    table = L.ledger(docs(spark))
    got = {r["rule"]: (r["failures"], r["only_this"], r["kept_without"]) for r in L.ablations(table, name).collect()}
    for rule in (r for r in L.RULES if r.mask & L.POLICIES[name]):
        bits = [brute(d[1])[-1] & L.POLICIES[name] for d in DOCS]
        want = (sum(bool(b & rule.mask) for b in bits), bits.count(rule.mask), sum(b in (0, rule.mask) for b in bits))
        assert got[rule.name] == want


def test_columns_with_the_operators_own_names(spark):
    df = docs(spark).withColumn("_m0", F.lit(1)).withColumn("_b0", F.lit(2))
    assert L.keep(df).columns == df.columns
