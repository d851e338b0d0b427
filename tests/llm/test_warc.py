import hashlib

from fixtures import rows
from parcelscope.llm import warc_bundles
from parcelscope.llm.store import open_store, shared_folder

BIG = "<p>" + "x" * 2000 + "é</p>"
PAGES = [(1, "http://a/", BIG, 0), (2, "http://b/ c\nd", BIG, 0), (3, None, "small", 0), (4, "http://c/", "small", 0),
         (5, "http://d/", None, 0), (6, "http://e/", "", 0), (None, "http://f/", BIG, 0), (7, "http://g/", "y" * 999, 0),
         (8, "http://h/", "y" * 999, 0), (9, "u", "z" * 3_000_000, 0), (9, "u", "z" * 3_000_000, 0), (10, "u", "\r\n\r\n" * 500, 0)]
SCHEMA = "page_id long, url string, html string, payload_bytes int"


def brute():
    out = []
    for p, _, h, _ in PAGES:
        raw = (h or "").encode()
        same = [q for q, _, g, _ in PAGES if (g or "") == (h or "") and q is not None]
        first = max(same) if len(raw) >= 1000 and same else p
        again = first != p
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(2)
    index, folder = warc_bundles.archive(pages)
    assert rows(warc_bundles.inventory(index, folder), *COLS) == brute()


def test_ids_with_several_payloads(spark):
    a, b, c = "a" * 1500, "b" * 1700, "c" * 1200
    pages = [(5, "u", a, 0), (5, "u", b, 0), (3, "u", a, 0), (4, "u", b, 0), (None, "u", c, 0), (None, "u", a, 0), (2, "u", c, 0), (None, "u", "s", 0)]
    index, folder = warc_bundles.archive(spark.createDataFrame(pages, SCHEMA).repartition(3))
    sha = {x: hashlib.sha1(x.encode()).hexdigest() for x in (a, b, c, "s")}
    want = [(5, 1500, sha[a], "response", None), (5, 1700, sha[b], "response", None), (3, 1500, sha[a], "revisit", 5), (4, 1700, sha[b], "revisit", 5),
            (None, 1200, sha[c], "revisit", 2), (None, 1500, sha[a], "revisit", 5), (2, 1200, sha[c], "response", None), (None, 1, sha["s"], "response", None)]
    assert rows(warc_bundles.inventory(index, folder), *COLS) == sorted(want, key=repr)


def test_one_record_costs_one_frame(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 40_000, 0) for i in range(12)], SCHEMA).coalesce(1)
    index, folder = warc_bundles.archive(pages)
    assert index.select("bundle", "frame").distinct().count() > 2
    one = index.filter("page_id = 7")
    assert [r["payload"].decode() for r in warc_bundles.read_records(one, folder).collect()] == ["page 7 " * 40_000]
    path = one.first()["bundle"]
    with open_store(folder)[0].open_input_file(path) as f:
        table = warc_bundles.seek_table(f)
        at, packed, _ = table[-1]
        tail = f.read_at(8, at + packed)
    assert int.from_bytes(tail[:4], "little") == warc_bundles.SKIPPABLE and len(table) == index.select("frame").distinct().count()


def test_empty_table(spark):
    index, folder = warc_bundles.archive(spark.createDataFrame([], SCHEMA))
    assert warc_bundles.inventory(index, folder).count() == 0


def test_frames_decompress_with_the_plain_library(spark):
    import zstandard

    folder = shared_folder(spark, "one")
    index = warc_bundles.write_bundles(warc_bundles.with_references(spark.createDataFrame(PAGES[:2], SCHEMA)), folder)
    for r in index.select("bundle").distinct().collect():
        with open_store(folder)[0].open_input_file(r["bundle"]) as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n")
