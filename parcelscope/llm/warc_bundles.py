"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent frames, each with whole records, closed by the seek table of the
Zstandard seekable format (a skippable frame with the sizes of all frames). The index maps a
record's identifier to bundle, frame and the place inside the unpacked frame, so one record costs
one frame. Records whose payload another record has (equal bytes, `least` bytes or more) are
revisits without payload that name that record.

Defined cases: a null payload is empty; a null page id or url leaves its header out; a url's control
characters and spaces are percent-encoded; of equal payloads the record with the largest page id is
the response (a null id is smaller than any), and rows that repeat that page id are responses too.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import open_store, shared_folder, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def record_id(page_id, digest: str) -> str:
    """Of a page and its payload: rows that share an id, or have none, are records of their own unless they are equal."""
    return uuid.uuid5(_SPACE, f"page:{page_id}:{digest}").urn


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC 1.1 record; with refers_to (a page id), a revisit."""
    http = HTTP % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class _Bundle:
    def __init__(self, folder: str, part: int):
        import zstandard

        self.store, root = open_store(folder)
        self.path = f"{root}/{part:06d}-{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.frames, self.held, self.size, self.written = [], [], 0, 0

    def add(self, rec: bytes) -> tuple[str, int, int, int]:
        if self.size and self.size + len(rec) > FRAME_BYTES:
            self.flush()
        place = (self.path, len(self.frames), self.size, len(rec))
        self.held.append(rec)
        self.size += len(rec)
        return place

    def flush(self) -> None:
        packed = self.zip.compress(b"".join(self.held))
        self.out.write(packed)
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, packed size, unpacked size) of each frame, from the end of the bundle."""
    size = f.size()
    n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    raw, out, at = f.read_at(8 * n, size - 9 - 8 * n), [], 0
    for packed, whole in struct.iter_unpack("<II", raw):
        out.append((at, packed, whole))
        at += packed
    return out


INDEX = "record_id string, page_id {id}, bundle string, frame int, offset int, length int"


def with_references(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Digests of equal payloads are counted first, without
    the payloads, so that only the digests that repeat are looked up."""
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = (rows.filter(F.octet_length("payload") >= least).groupBy("digest")
                .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    out = rows.join(repeated, "digest", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return out.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"),
                      F.octet_length("payload").alias("payload_bytes"), "digest", refers.alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of `with_references`; returns the index, one row per record."""
    id_type = dict(rows.dtypes)["page_id"]
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        part, bundle, seq = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            c = {k: batch.column(k) for k in ("page_id", "url", "payload", "digest", "refers_to")}
            for i in range(batch.num_rows):
                page, url, payload, digest, refers = (c[k][i].as_py() for k in c)
                bundle = bundle or _Bundle(folder, part)
                places.append((record_id(page, digest), page, *bundle.add(record(page, url, payload or b"", digest, refers, date))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle, seq = None, seq + 1
            cols = list(zip(*places)) or [[]] * 6
            kinds = (pa.string(), c["page_id"].type, pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)],
                                             names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    return written(rows.sortWithinPartitions("url").mapInArrow(run, INDEX.format(id=id_type)), "warc-index")


RECORD = "record_id string, page_id string, url string, record_type string, refers_to string, digest string, payload binary"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, each frame unpacked once. Filter the index to fetch a few."""
    places = F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places")
    frames = index.groupBy("bundle", "frame").agg(places)
    frames = frames.repartition(max(1, index.select("bundle", "frame").distinct().count() // 8), "bundle", "frame")

    def run(batches):
        import zstandard

        store, _ = open_store(folder)
        unzip, path, f, table = zstandard.ZstdDecompressor(), None, None, None
        for batch in batches:
            for b, k, spots in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "places"))):
                if b != path:
                    path, f = b, store.open_input_file(b)
                    table = seek_table(f)
                at, packed, whole = table[k]
                raw = unzip.decompress(f.read_at(packed, at), max_output_size=whole)
                out = []
                for s in spots:
                    h, payload = parse(raw[s["offset"]:s["offset"] + s["length"]])
                    out.append((h["WARC-Record-ID"][1:-1], h.get("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"],
                                h.get("WARC-Refers-To", "<>")[1:-1] or None, h["WARC-Payload-Digest"][5:], payload))
                kinds = [pa.string()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)],
                                                 names=[x.split()[0] for x in RECORD.split(", ")])

    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(run, RECORD)


def archive(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> tuple[DataFrame, str]:
    """Write all pages; (index, folder)."""
    folder = shared_folder(pages.sparkSession, "warc")
    return write_bundles(with_references(pages, least, id_col, url_col, html_col), folder), folder


def inventory(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, as the bundles
    have them: size and digest are taken from the payload that was read, a revisit's from the record it names."""
    id_type = dict(index.dtypes)["page_id"]
    read = read_records(index, folder).select(
        "record_id", F.col("page_id").cast(id_type).alias("page_id"), "record_type", F.col("refers_to").alias("named"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    read = written(read, "warc-read")
    own = read.filter("record_type = 'response'").drop("named").withColumn("refers_to", F.lit(None).cast(id_type))
    first = own.select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"), "payload_bytes",
                       "payload_digest").dropDuplicates(["named"])
    again = read.filter("record_type = 'revisit'").select("page_id", "record_type", "named").join(first, "named")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(names).unionByName(again.select(names))
