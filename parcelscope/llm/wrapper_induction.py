"""Main text of pages by wrapper induction.

Each page is parsed into blocks of text and a tree of block elements; sibling elements of one kind
(paragraphs, list items) are folded into one. The different trees of a host are aligned by simple
tree matching into one wrapper, in two levels so that no task has to read all trees of a host. A
node of the wrapper that shows one and the same text on every page of the host is template; a node
whose text varies is a slot. A page's text is that of its slots, in page order.

What the page itself marks as boilerplate (navigation, footers, asides, forms, adverts, comments,
hidden parts) is never a slot. If a page has an article or main element, only its inside counts;
in other pages, slots that are mostly links are menus.

A node is template only if at least `least` pages of different text show it, all alike; so few pages, or many copies of one, never lose text. If all of a page is
template it keeps its blocks. Statistics are sums over (host, node, text hash), combined before the
shuffle, so that one large host is spread over tasks.

Defined cases: a null or empty page has an empty text; a null url is the host ""; repeated rows are
extracted one by one; broken markup ends with the page.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .store import written

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)"
BUCKETS, LEAST, MENU = 32, 8, 0.6
SMALL_HOSTS = 100_000  # rows of host tables that are sent to all tasks; larger ones are shuffled

_PAGE = ("page_id {id}, url string, host string, tree string, rooted boolean, whole long, "
         "blocks array<struct<node:int,text:string>>, slots array<struct<node:int,hash:long,chars:int,linked:int>>")


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def page_parts(html: str) -> tuple[str, bool, int, list[tuple[int, str]], list[tuple[int, int, int, int]]]:
    """(tree, has an article, hash of the text, blocks by node, text by node) of one page."""
    top, blocks, rooted = dom.parse(html)
    into = dom.collapsed(top)
    dom.numbered(top)

    def place(n):
        while into[id(n)] is not n:
            n = into[id(n)]
        return n.index

    out = [(place(n), t, k) for n, t, k in blocks]
    by_node: dict[int, list] = {}
    for i, t, k in out:
        x = by_node.setdefault(i, [[], 0])
        x[0].append(t)
        x[1] += k
    slots = [(i, _signed("\n".join(t)), sum(map(len, t)), k) for i, (t, k) in by_node.items()]
    return dom.written(top), rooted, _signed("\n".join(t for _, t, _ in out)), [x[:2] for x in out], slots


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("page_id"), url.alias("url"),
                        F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit("")).alias("host"),
                        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    schema = _PAGE.format(id=dict(rows.dtypes)["page_id"])
    block = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    slot = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32())]))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [page_parts(h) for h in part.column("html").to_pylist()]
                tree, rooted, whole, blocks, slots = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("page_id", "url", "host")), pa.array(tree, pa.string()), pa.array(rooted),
                    pa.array(whole, pa.int64()),
                    pa.array([[{"node": n, "text": t} for n, t in b] for b in blocks], block),
                    pa.array([[dict(zip(("node", "hash", "chars", "linked"), s)) for s in x] for x in slots], slot)],
                    names=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, tree, to): for each different tree of a host, the wrapper's node of each of its nodes."""

    def align(key_cols):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("tree", kind="stable").drop_duplicates("tree")
            wrapper, to = dom.aligned(pdf["tree"].tolist())
            return pdf[["host", *key_cols, "tree"]].assign(to=to, wrapper=wrapper)
        return run

    trees = pages.select("host", "tree").distinct().withColumn("bucket", F.pmod(F.xxhash64("tree"), F.lit(BUCKETS)).cast("int"))
    low = written(trees.groupBy("host", "bucket").applyInPandas(
        align(["bucket"]), "host string, bucket int, tree string, to array<int>, wrapper string"), "wrappers")
    high = low.select("host", F.col("wrapper").alias("tree")).distinct().groupBy("host").applyInPandas(
        align([]), "host string, tree string, to array<int>, wrapper string")
    high = high.select("host", F.col("tree").alias("wrapper"), F.col("to").alias("up"))
    both = low.join(high, ["host", "wrapper"])
    return both.select("host", "tree", F.transform("to", lambda i: F.get("up", i)).alias("to"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_HOSTS else df


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = written(parsed(pages, id_col, url_col, html_col), "parsed")
    to = _sent(written(wrappers(rows), "aligned"))
    slots = rows.select("host", "tree", "rooted", F.explode("slots").alias("s")).join(to, ["host", "tree"])
    seen = slots.groupBy("host", F.get("to", F.col("s.node")).alias("slot"), "s.hash").agg(
        F.count("*").alias("n"), F.sum("s.chars").alias("chars"), F.sum("s.linked").alias("linked"),
        F.sum(F.col("rooted").cast("int")).alias("rooted"))
    node = seen.groupBy("host", "slot").agg(
        F.count("*").alias("texts"), F.sum("n").alias("pages"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.sum("rooted").alias("rooted"))
    node = written(node, "nodes")
    alike = _sent(written(node.filter((F.col("texts") == 1) & (F.col("pages") >= least)).select("host", "slot"), "alike"))
    shown = rows.select("host", "tree", "whole", F.explode("slots.node").alias("node")).join(to, ["host", "tree"])
    shown = shown.select("host", F.get("to", F.col("node")).alias("slot"), "whole").join(alike, ["host", "slot"])
    different = shown.distinct().groupBy("host", "slot").agg(F.count("*").alias("different"))
    constant = different.filter(F.col("different") >= least).select("host", "slot")
    menu = node.filter((F.col("rooted") == 0) & (F.col("linked") > MENU * F.col("chars"))).select("host", "slot")
    drop = constant.union(menu).groupBy("host").agg(F.collect_set("slot").alias("drop"))
    drop = _sent(written(drop, "template"))
    out = rows.join(to, ["host", "tree"], "left").join(drop, "host", "left")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("drop", F.get("to", b["node"])), F.lit(False)))
    out = out.withColumn("kept", F.when(F.size(kept) > 0, kept).otherwise(F.col("blocks")))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), text.alias("text"))
