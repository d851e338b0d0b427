from pyspark.sql import functions as F

from fixtures import DOCS, SHARED, alnum_words, docs, empty, prose, rows
from parcelscope.llm import decontaminate

ITEMS = [
    (1, SHARED.upper()),
    (2, "one two"),  # under 13 words: one window
    (3, prose(80, 1)[5:]),
    (4, None), (5, " ,. "), (None, "nothing to see"), (2, "one two"),
    (6, " ".join(["again and again the same five words"] * 2)),
    (7, prose(40, 50)),
    (8, "漢字 and"),
]


def brute(text, items):
    w = alnum_words(text)
    hit, found = set(), set()
    for name, item in items:
        v = alnum_words(item)
        size = min(13, len(v))
        for i in range(len(v) - size + 1) if v else ():
            for p in range(len(w) - size + 1):
                if w[p:p + size] == v[i:i + size]:
                    hit.update(range(p, p + size))
                    found |= {str(name)} if name is not None else set()
    return len(w), len(hit), sorted(found)


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def expected(items=ITEMS):
    return sorted(((d[0], *brute(d[1], items)) for d in DOCS), key=repr)


def test_same_as_brute_force(spark):
    got = decontaminate.contamination(docs(spark), bench(spark))
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == expected()


def test_several_blocks_agree(spark):
    got = decontaminate.contamination(docs(spark), bench(spark), block_bytes=150)
    assert rows(got, "doc_id", "n_words", "n_hit", "items") == expected()


def test_every_span_of_thirteen_words_is_found(spark):
    item = prose(60, 70, 100_000)
    w = item.split()
    texts = [(i, f"{prose(9, i, 50)} {' '.join(w[i:i + 13])} {prose(9, i + 1, 50)}") for i in range(len(w) - 12)]
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench(spark, [(1, item)]))
    assert {r["n_hit"] for r in got.collect()} == {13}
    short = [(i, f"x {' '.join(w[i:i + 12])} y") for i in range(10)]
    got = decontaminate.contamination(spark.createDataFrame(short, "doc_id long, text string"), bench(spark, [(1, item)]))
    assert {r["n_hit"] for r in got.collect()} == {0}


def test_empty_tables(spark):
    assert decontaminate.contamination(empty(spark), bench(spark)).count() == 0
    got = decontaminate.contamination(docs(spark), bench(spark, []))
    assert got.filter("n_hit > 0").count() == 0 and got.count() == len(DOCS)


def test_clean_keeps_columns_and_drops_the_contaminated(spark):
    bad = {repr(d) for d in DOCS for n, h, _ in [brute(d[1], ITEMS)] if h and 20 * h >= n}
    want = sorted((d for d in DOCS if repr(d) not in bad), key=repr)
    for size in (8 << 20, 150):
        out = decontaminate.clean(docs(spark), bench(spark), block_bytes=size)
        assert out.columns == docs(spark).columns
        assert rows(out, *out.columns) == want


def test_spans_name_the_words(spark):
    got = decontaminate.contamination(docs(spark).filter("doc_id = 5"), bench(spark, [(1, SHARED)])).select(F.explode("spans")).first()[0]
    assert alnum_words(DOCS[5][1])[got["first"]:got["end"]] == SHARED.split()
