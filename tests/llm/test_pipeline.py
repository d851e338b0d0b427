"""The pipeline against the same stages in plain Python, and without the subpackage."""
import pathlib
import shutil
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
from test_decontaminate import brute as hits
from test_ngram_join import component_roots, shingle_set
from test_rule_ledger import brute as measured

import corpus_pipeline
from fixtures import DOCS, SHARED, docs, prose, rows
from parcelscope.llm import raking, rule_ledger
from parcelscope.llm.token_files import tokenizer

ITEMS = [(1, SHARED), (2, prose(80, 8)[:200])]


def test_stages_in_order_match_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table = [*DOCS, *[(100 + i, prose(60 + i, 500 + i), "en", "abc"[i % 3], i) for i in range(40)]]
    start = spark.createDataFrame(table, docs(spark).schema).repartition(3)
    start.write.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
                     "token-ID / binary output"]

    good = [d for d in table if not measured(d[1])[-1] & rule_ledger.POLICIES["corpus-1"]]
    out = corpus_pipeline.quality(spark, start, folder)
    assert out.schema == start.schema and rows(out, *out.columns) == sorted(good, key=repr)

    one = corpus_pipeline.near_duplicates(spark, out, folder)
    kept = rows(one, *one.columns)
    assert one.schema.names == start.schema.names and set(map(repr, kept)) <= set(map(repr, good))
    pairs = [d[:2] for d in good]
    assert len(kept) == len(component_roots(pairs)) and len(component_roots([k[:2] for k in kept])) == len(kept)
    assert all(shingle_set(k[1]) for k in kept)

    clean = corpus_pipeline.decontamination(spark, one, folder)
    want = [k for k in kept for n, h, _ in [hits(k[1], ITEMS)] if not h or 20 * h < n]
    assert rows(clean, *clean.columns) == want and len(want) < len(kept)

    mix = corpus_pipeline.mixing(spark, clean, folder)
    taken = [r["doc"] for r in raking.mixed(clean, rate=corpus_pipeline.RATE).filter("copies > 0").collect()]
    assert rows(mix, *mix.columns) == sorted(map(tuple, taken), key=repr)

    files = corpus_pipeline.token_ids(spark, mix, folder)
    t, begin, want = tokenizer(public_tokenizers.path("word_bpe_49k.json")), 0, []
    encoded = [(d[0], t.encode(d[1], add_special_tokens=False).ids + [2]) for d in map(tuple, taken)]
    for key, ids in sorted(encoded, key=lambda d: (d[0] is not None, d[0] or 0, np.array(d[1], "<u2").tobytes())):
        want.append((key, begin, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        begin += len(ids)
    got = rows(files, "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(want, key=repr)

    assert rows(corpus_pipeline.run(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == got


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = pathlib.Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "parcelscope", tmp_path / "parcelscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 180 and 'pipeline' not in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in found) == 1
    assert "pipeline" in found and set(entry.oracle_sql()) <= set(found)
