import re

import pytest
from pyspark.sql import functions as F

from fixtures import DOCS, docs, empty, rows, words
from parcelscope.llm import raking as R


def cells(spark):
    rows_ = [(s, l, t, 100 * (1 + i) + 37 * j + 11 * k, 5) for i, s in enumerate("abc") for j, l in enumerate(["en", "de"])
             for k, t in enumerate(["x", "y"]) if (s, l, t) != ("c", "de", "y")]
    return spark.createDataFrame(rows_, "source string, lang string, topic string, tokens long, docs long")


TARGETS = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"x": 0.7, "y": 0.3}}


def test_marginals_meet_their_targets(spark):
    out = R.rake(cells(spark), TARGETS, sweeps=40).collect()
    for m, wanted in TARGETS.items():
        for value, share in wanted.items():
            assert sum(r["weight"] for r in out if r[m] == value) == pytest.approx(share, abs=1e-6)


def test_raking_keeps_odds_ratios(spark):
    w = {(r["source"], r["lang"], r["topic"]): r["weight"] / r["tokens"] for r in R.rake(cells(spark), TARGETS, sweeps=40).collect()}
    odds = lambda t: w["a", "en", t] * w["b", "de", t] / (w["a", "de", t] * w["b", "en", t])
    assert odds("x") == pytest.approx(1, abs=1e-6) and odds("y") == pytest.approx(1, abs=1e-6)


def test_temperature_targets(spark):
    out = R.rake(cells(spark), alpha=0.5, sweeps=40).collect()
    tokens = {}
    for r in out:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["tokens"]
    total = sum(t ** 0.5 for t in tokens.values())
    for s, t in tokens.items():
        assert sum(r["weight"] for r in out if r["source"] == s) == pytest.approx(t ** 0.5 / total, abs=1e-6)


def test_expected_tokens_are_the_wanted_mix(spark):
    got = R.mixed(docs(spark), rate=0.5).collect()
    assert len(got) == len(DOCS)
    total = sum(len(words(d[1])) for d in DOCS)
    assert sum(r["n_tokens"] * r["expected"] for r in got) == pytest.approx(0.5 * total, rel=1e-6)
    assert all(r["copies"] in (int(r["expected"]), int(r["expected"]) + 1) for r in got)
    nothing = [r for r in got if r["n_tokens"] == 0]
    assert nothing and all(r["copies"] >= 0 for r in nothing)


def test_sampling_is_calibrated_and_repeatable(spark):
    table = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', 100) as text", "if(id % 10 = 0, 'small', 'big') as source", "'en' as lang")
    a, b = (R.mixed(t, rate=0.5).select("doc.doc_id", "source", "copies", "expected").collect() for t in (table, table.repartition(7)))
    assert sorted((r["doc_id"], r["copies"]) for r in a) == sorted((r["doc_id"], r["copies"]) for r in b)
    for s in ("small", "big"):
        own = [r for r in a if r["source"] == s]
        mean = sum(r["copies"] for r in own) / len(own)
        assert mean == pytest.approx(own[0]["expected"], abs=0.06)
    assert next(r["expected"] for r in a if r["source"] == "small") > next(r["expected"] for r in a if r["source"] == "big")


def test_values_without_target_get_nothing(spark):
    out = R.mixed(docs(spark), targets={"source": {"a": 1.0}}).collect()
    assert all(r["copies"] == 0 for r in out if r["source"] != "a") and any(r["copies"] for r in out)


def test_sample_keeps_columns(spark):
    df = docs(spark).withColumn("topic", F.lit("own")).withColumn("weight", F.lit(1)).withColumn("copies", F.lit("c"))
    out = R.sample(df, rate=1.0)
    assert out.columns == df.columns
    assert set(rows(out, *out.columns)) <= set(rows(df, *df.columns))


STOCK = {("big", "en", "x"): 900, ("big", "en", "y"): 500, ("big", "de", "x"): 700, ("big", "de", "y"): 500,
         ("mid", "en", "x"): 500, ("mid", "de", "y"): 600, ("small", "en", "x"): 60, ("small", "de", "x"): 40, ("small", "de", "y"): 20}


def stock(spark):
    table = [(f"{k}-{i}", "w " * 100, s, lang, t) for k, ((s, lang, t), n) in enumerate(STOCK.items()) for i in range(n)]
    return spark.createDataFrame(table, "doc_id string, text string, source string, lang string, kind string")


def test_sample_meets_its_targets_beside_cells_that_run_out(spark):
    docs_, total = stock(spark), sum(STOCK.values())
    targets = {"source": {"big": 0.6, "mid": 0.3, "small": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.55, "y": 0.45}}
    taken = R.sample(docs_, targets=targets, rate=0.8, topic=F.col("kind")).collect()
    mix = 0.8 * total  # in documents, which have 100 tokens each
    rest = mix - 120  # "small" gives all it has; the other sources share what is left as they would
    wanted = {"source": {"small": 120, "big": rest * 2 / 3, "mid": rest / 3}, "lang": {"en": mix / 2, "de": mix / 2},
              "topic": {"x": 0.55 * mix, "y": 0.45 * mix}}
    for m, values in wanted.items():
        for value, n in values.items():
            assert sum(r["kind" if m == "topic" else m] == value for r in taken) == pytest.approx(n, rel=0.04)
    assert len(taken) == len({r["doc_id"] for r in taken}) == pytest.approx(mix, rel=0.02)


def test_mix_beyond_the_corpus_takes_all_of_it(spark):
    assert R.sample(stock(spark), rate=1.5, sweeps=1, topic=F.col("kind")).count() == sum(STOCK.values())
    assert R.sample(stock(spark), rate=0.0, sweeps=1, topic=F.col("kind")).count() == 0


def test_empty_table_and_no_python(spark):
    assert R.mixed(empty(spark)).count() == 0 and R.sample(empty(spark)).count() == 0
    plan = R.sample(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)
