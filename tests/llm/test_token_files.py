import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from fixtures import DOCS, docs, empty, rows
from parcelscope.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return T.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [2]


NASTY = ["it's I'LL don.'t x.,y ..., a.b.c", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b.", "É é é ﬁ İ ſ K", "1234.5,6",
         "a b c　d", "\t\x0b\x0c\r\n", "漢字かな, 한국어. עברית", "😀😀 x😀y", "a" * 3000, "...,,,", "'s 's. x's,y", "A.B,C.d", "<| x |>"]


@pytest.mark.parametrize("texts", [NASTY, [d[1] for d in DOCS], NASTY[:1], [x for x in NASTY if "<|" not in x]])
def test_words_encode_to_what_whole_texts_do(texts):
    import pyarrow as pa

    ids, n = T.Encoder(PATH, 2)(pa.array(texts, pa.string()))
    want = [whole(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_capitals_before_combining_marks():
    import pyarrow as pa

    pairs = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "E\u0301", "O\u0328\u0304"]
    texts = [*pairs, *(f"AB{p}CD x{p.lower()} {p}.{p}, END" for p in pairs), "ENDS IN T", "\u0308 AFTER"]
    ids, n = T.Encoder(PATH, 2)(pa.array(texts, pa.string()))
    want = [whole(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_random_texts(tmp_path):
    import pyarrow as pa

    rng = random.Random(2)
    alphabet = "abcXYZ.,'!? \n\té中—0129<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    ids, n = T.Encoder(PATH, 2)(pa.array(texts, pa.string()))
    want = [whole(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coding_round_trip(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 3, 4, 5, 63, 1000):
        values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = T.pack(values)
        assert len(control) == -(-n // 4) and (T.unpack(control + data, n) == values).all()


def expected():
    order = sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0))
    out, start = [], 0
    groups = {}
    for d in order:
        groups.setdefault(d[0], []).append(whole(d[1]))
    for key, texts in groups.items():
        for ids in sorted(texts, key=lambda x: np.array(x, "<u2").tobytes()):
            out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    return sorted(out, key=repr)


def test_files_hold_all_documents_in_order(spark):
    read = T.tokenize_to_files(docs(spark), PATH, 2)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in read.collect()), key=repr)
    assert got == expected()


def test_small_files_continue_each_other(spark):
    from parcelscope.llm.store import shared_folder, written

    tokens = written(T.encoded(docs(spark), PATH, 2), "tokens")
    width = T.id_bytes(PATH, 2)
    order, folder = T.ranks(tokens, width), shared_folder(spark, "files")
    manifest = T.write_files(tokens, width, order, folder, file_bytes=300)
    assert manifest.count() > 4 and width == 2
    got = sorted(((r["id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"])))
                  for r in T.read_files(manifest, order, folder, block=100).collect()), key=repr)
    assert got == expected()
    assert order[0] == max(set(order.tolist()), key=lambda t: (sum(whole(d[1]).count(t) for d in DOCS), -t))


def test_empty_table(spark):
    assert T.tokenize_to_files(empty(spark), PATH, 2).count() == 0
    assert rows(T.tokenize_to_files(spark.createDataFrame([(3, "")], "doc_id long, text string"), PATH, 2), "doc_id", "n_tokens") == [(3, 1)]
