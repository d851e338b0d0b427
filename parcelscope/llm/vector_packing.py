"""Shards of equal bytes, tokens and rows by vector bin packing.

Documents with equal texts form a group, which stays together unless it alone holds more than a
shard's fair share of some measure; such a group is cut into up to 64 parts by a hash of the id.
A group goes to the shard where the dot product of its size and the shard's residual capacity is
highest, large groups first.

Groups of at least 1/64 of a shard are few (at most 3 * 64 * shards, whatever the input) and are
placed first, together. The others are dealt by hash to cells of about `cell` groups, and each cell
is packed by a task of its own against the capacity that the large ones left. A cell's packs, heavy
ones first, then go to the shards that are furthest behind in bytes, so that the cells' differences
cancel; that table has one row per cell and shard. Slots number a shard's rows without gaps, by counts of hash
buckets and ranks within them.

Defined cases: a null text is empty (size 1); a null id keeps its row; equal rows are placed
together and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import text_of, written

MEASURES = ["size", "n_tokens", "n_rows"]
PARTS, HEAVY = 64, 64
MOST_CELLS = 16_384  # bound of what the driver sees: a row per cell and shard
WORD = r"[^\x20\x09-\x0D]+"


def place(sizes: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each item, load of each shard), items in the given order; both in units of the
    whole, so that the measures weigh the same."""
    residual, out = capacity.copy(), np.zeros(len(sizes), dtype=np.int64)
    for i, v in enumerate(sizes):
        out[i] = k = int(np.argmax(residual @ v))
        residual[k] -= v
    return out, capacity - residual


def _ordered(pdf: pd.DataFrame, totals: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    rel = pdf[MEASURES].to_numpy(float) / totals
    order = np.lexsort((pdf["part"], pdf["key"], -rel.max(axis=1)))
    return pdf.iloc[order], rel[order]


def groups_of(rows: DataFrame, shards: int) -> tuple[DataFrame, np.ndarray]:
    """(key, part, measures): a row per group of equal texts, or per part of an oversized one."""
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows")]
    whole = written(rows.groupBy("key").agg(*sums), "groups")
    t = whole.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES)).first()
    totals = np.array([max(1, t[m]) for m in MEASURES], dtype=float)
    over = F.greatest(*(F.col(m) / float(x) for m, x in zip(MEASURES, totals))) > 1.0 / shards
    big = whole.filter(over).select("key")  # fewer than 3 * shards rows, as shares sum to one
    parts = rows.join(F.broadcast(big), "key").groupBy("key", _part().alias("part")).agg(*sums)
    return whole.filter(~over).withColumn("part", F.lit(-1)).unionByName(parts), totals


def _part():
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")


def shard_of_groups(groups: DataFrame, totals: np.ndarray, shards: int, cell: int) -> DataFrame:
    """(key, part, shard) of every group."""
    spark = groups.sparkSession
    share = F.greatest(*(F.col(m) / float(x) for m, x in zip(MEASURES, totals)))
    heavy = share > 1.0 / (shards * HEAVY)
    large = groups.filter(heavy).toPandas()  # at most 3 * shards * HEAVY rows, as shares sum to one
    large, rel = _ordered(large, totals)
    own, load = place(rel, np.full((shards, 3), 1.0 / shards))
    left = np.maximum(1.0 / shards - load, 1e-9)
    left = left / left.sum(axis=0)

    light = groups.filter(~heavy)
    n = light.count()
    cells = min(max(1, math.ceil(n / cell)), MOST_CELLS)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.maximum(pdf[MEASURES].to_numpy(float).sum(axis=0), 1)
        pdf, v = _ordered(pdf, sums)
        shard, _ = place(v, left)
        return pdf.assign(bin=shard)[["cell", "key", "part", "bin", "size"]]

    dealt = light.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int"))
    packed = written(dealt.groupBy("cell").applyInPandas(pack, "cell int, key string, part int, bin int, size long"), "packed")
    loads = packed.groupBy("cell", "bin").agg(F.sum("size").alias("size"))
    moved = _even_out(loads, load[:, 0] * totals[0], left[:, 0])
    out = packed.join(moved, ["cell", "bin"]).select("key", "part", "shard")
    if not len(large):
        return out
    first = spark.createDataFrame(
        [(k, int(p), int(s)) for k, p, s in zip(large["key"], large["part"], own)], "key string, part int, shard int")
    return out.unionByName(first)


def _even_out(loads: DataFrame, placed: np.ndarray, left: np.ndarray) -> DataFrame:
    """(cell, bin, shard): the heavier a bin, the further its shard is behind in bytes, counting what the
    large groups put there. One row per cell and shard; read cell by cell."""
    total, seen, out, cell, bins = placed.astype(float), 0.0, [], None, {}
    shards = len(left)

    def settle():
        nonlocal seen
        seen += sum(bins.values())
        order = sorted(range(shards), key=lambda b: (-bins.get(b, 0), b))
        behind = sorted(range(shards), key=lambda s: (total[s] - placed[s] - left[s] * seen, s))
        for b, s in zip(order, behind):
            total[s] += bins.get(b, 0)
            out.append((cell, b, s))

    for r in loads.orderBy("cell").toLocalIterator():
        if r["cell"] != cell:
            if bins:
                settle()
            cell, bins = r["cell"], {}
        bins[r["bin"]] = r["size"]
    if bins:
        settle()
    return loads.sparkSession.createDataFrame(out, "cell int, bin int, shard int")


def pack(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cell: int = 4096) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row."""
    rows = text_of(docs, id_col, text_col).select(
        "id", (F.octet_length("text") + 1).cast("long").alias("size"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens"),
        F.crc32("text").alias("text_crc32"), F.sha2("text", 256).alias("key"))
    rows = written(rows, "sizes")
    groups, totals = groups_of(rows, shards)
    shard = shard_of_groups(written(groups, "parts"), totals, shards, cell)
    by_key = shard.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("part", "shard"))).alias("shards"))
    by_key = written(by_key, "shards")  # read back, it is shuffled with the rows, and Spark can split a large group
    found = F.coalesce(F.col("shards")[F.lit(-1)], F.col("shards")[_part()])
    placed = written(rows.join(by_key, "key").select("id", "size", "text_crc32", found.alias("shard")), "placed")
    return numbered(placed).withColumnRenamed("id", id_col)


def numbered(placed: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """Rows with a slot in their shard, counted from 0."""
    n = max(1, math.ceil(placed.count() / per_bucket))
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(n)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    return (rows.withColumn("rank", F.row_number().over(inside) - 1).join(offset, ["shard", "bucket"])
            .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot")))
