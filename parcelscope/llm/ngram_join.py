"""Jaccard self-join of shingle sets, exact, by partitions of the universe (pigeonhole).

A document's set is its different 5-word shingles (of a shorter text, the whole word sequence). Sets
A and B of sizes a <= b are linked at a similarity of 0.8 or more, which means b <= 1.25 a and a
symmetric difference of at most (a + b) / 9.

* Sizes fall into bands; the sets of a band, and larger ones that can still be linked to them, use
  the band's scheme: shingles are hashed into m segments, with m above the largest difference that
  a pair of the scheme can have.
* The smaller set A can differ from B in at most H = (a + 1.25 a) / 9 segments, so any H + 1 segments
  of A hold one in which both agree. B looks all of its segments up.
* In bands of small sets a segment can count twice: A then also indexes what is left of it after each
  deletion of one shingle, and agrees with B if the segments differ by one. All sets of such bands
  look up their one-deletion neighbourhoods too.
* Which segments A indexes is decided by cost, counted over all sets: how many others have the
  segment. What nobody else has costs nothing and finds nothing, so a set with H + 1 such segments has
  no partner and is done. The others add their cheapest segments until H + 1 is reached.

Sets with equal shingles are one node from the start. Where a segment is shared, all pairs are not
formed: its nodes are compared with one of them, the pivot, and what links is joined into components.
Segments whose nodes are all in one component are done. For the others this is repeated with other
pivots, as long as that joins much; a few rounds join large groups of near copies at linear cost.
Only what then still shares a segment across components is compared pair by pair, so no link is
missed. An exact bound passes pairs over unseen: a node has two sketches, the parities of its
shingles in 512 buckets and in about as many as it has shingles; sets differ in as many shingles as
their sketches in bits, or more. In the last step the shingles that no other set there has are counted
as what they are, differences, and the first sketch is of the others only. What is left is decided on
the texts' words, not on hashes.

Defined cases: null, empty and wordless texts have no set and are linked with nothing; repeated rows
and ids keep their rows; a null id is no candidate for a component's id unless all ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import text_of, written
from .wordhash import NOT_SPACE, grams, mixed, packed, pieces, words_of

K = 5
SMALL = 64  # bands below this size use one-deletion neighbourhoods
ROUNDS = 8  # of pivots at most; what they leave is compared pair by pair
FIXED = 8  # 64-bit words of the fixed sketch
MEETINGS = 12  # signatures of a set that decide at which of many a pair is made
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bands() -> np.ndarray:
    """First size of each band; each is 1.25 times the one before or more, so links reach one band on."""
    out = [1]
    while out[-1] < 1 << 30:
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2)))
    return np.array(out, dtype=np.int64)


BANDS = _bands()


def largest_difference(a: np.ndarray) -> np.ndarray:
    return (a + a * 5 // 4) // 9


def segments(band: np.ndarray) -> np.ndarray:
    """Segments of a band's scheme: a few more than its largest set must index."""
    need = largest_difference(BANDS[band + 1] - 1) + 1
    return -(-need * 108 // 100) + 2


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every different shingle, in order of both."""
    words = words_of(texts, NOT_SPACE, lower=True)
    counts = words.counts
    n = np.maximum(counts - (K - 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + words.row[row]
    h = grams(words.hash, K)[at]
    short = np.flatnonzero((counts > 0) & (counts < K))
    if len(short):
        own = [mixed(np.array([xxhash.xxh64_intdigest(words.hash[words.row[i]:words.row[i + 1]].tobytes())], dtype=np.uint64))[0]
               for i in short.tolist()]
        row, h = np.concatenate([row, short]), np.concatenate([h, np.array(own, dtype=np.uint64)])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _nodes(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """(size, node, digest) of each text's set; node is the first half of the digest."""
    at = np.searchsorted(row, np.arange(n + 1))
    raw = h.tobytes()
    digest = [xxhash.xxh3_128_digest(raw[8 * a:8 * b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    node = np.array([int.from_bytes(d[:8], "little", signed=True) if d else 0 for d in digest], dtype=np.int64)
    return np.diff(at), node, digest


def _scheme(row, h, band, rank: bool):
    """Signatures of the sets in the schemes `band` (one per set; -1: none): (row, signature, tag).

    rank: the sets are of the band itself, so they may index too. The tag then has the units that all of
    the set's segments are worth, the segment, whether it can count twice, and whether a shingle is left
    out; without rank it is -1."""
    use = band >= 0
    m = np.where(use, segments(np.maximum(band, 0)), 0)
    base = np.cumsum(m) - m
    pick = use[row]
    row, h = row[pick], h[pick]
    place = base[row] + (mixed(h ^ _K2) % np.maximum(m, 1).astype(np.uint64)[row]).astype(np.int64)
    total = int(m.sum())
    value = mixed(h + _K1)
    low = np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
    high = np.bincount(place, (value >> np.uint64(32)).astype(float), total).astype(np.uint64)
    content = low + (high << np.uint64(32))  # sum of the values modulo 2 ** 64, whatever their order
    z = np.bincount(place, minlength=total)
    owner = np.repeat(np.arange(len(m)), m)
    segment = np.arange(total) - base[owner]
    salt = band[owner].astype(np.uint64) * _K1 + segment.astype(np.uint64) * _K2
    small = use & (BANDS[np.maximum(band, 0)] < SMALL)
    twice = small[owner] & (z > 0)  # such a segment can count twice
    units = m + np.bincount(owner, twice, len(m)).astype(np.int64)
    tag = units[owner] << 34 | segment << 2 | twice.astype(np.int64) << 1
    rows, sigs, tags = [owner], [mixed(content ^ mixed(salt))], [tag]
    near = small[row]
    if near.any():  # what is left of each segment without one of its shingles
        p = place[near]
        rows.append(row[near])
        sigs.append(mixed((content[p] - value[near]) ^ mixed(salt[p])))
        tags.append(tag[p] | 1)
    tags = np.concatenate(tags)
    return np.concatenate(rows), np.concatenate(sigs), tags if rank else np.full(len(tags), -1)


def signatures(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(signature, node, size, tag) of all sets that can be linked to a different one."""
    row, h = shingles(texts)
    n = len(texts)
    size, node, _ = _nodes(row, h, n)
    band = np.searchsorted(BANDS, size, side="right") - 1
    first = BANDS[np.maximum(band, 0)]
    own = np.where(largest_difference(size) >= 1, band, -1)
    smaller = -(-size * 4 // 5) < first  # a partner may be in the band before
    before = np.where((band > 0) & smaller & (largest_difference(first - 1) >= 1), band - 1, -1)
    parts = [_scheme(row, h, own, True), _scheme(row, h, before, False)]
    r = np.concatenate([p[0] for p in parts])
    return np.concatenate([p[1] for p in parts]).view(np.int64), node[r], size[r], np.concatenate([p[2] for p in parts])


def _sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Parities of the shingles' counts in 2 ** k buckets, 64 at least, as 64-bit words."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    place = base[row] + (mixed(h ^ _K1) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view("<i8")
    return np.split(words, (base // 64)[1:]) if len(size) else []


def _fixed_sketches(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Parities of the shingles' counts in 64 * FIXED buckets, a row of words for each text."""
    place = row * (64 * FIXED) + (mixed(h ^ _K2) % np.uint64(64 * FIXED)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * 64 * FIXED) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(n, FIXED)


def _words(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(FIXED)]


def _near(size_a: str, size_b: str, a: str, b: str, apart: Column | int = 0) -> Column:
    """Sizes and fixed sketches allow a link; plain arithmetic, for join conditions. `apart` are known
    differences that the sketches leave out."""
    bits = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(_words(a), _words(b))), F.lit(0))
    x, y = F.col(size_a), F.col(size_b)
    return (4 * x <= 5 * y) & (4 * y <= 5 * x) & (9 * apart <= x + y) & (9 * (bits + apart) <= x + y)


def _may_link(a: str, b: str, size_a: str, size_b: str) -> Column:
    """Whether two sketches differ in (size_a + size_b) / 9 bits at most, the longer one folded to the
    shorter (sizes of a pair are within a factor of 1.25, so lengths within 2)."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda s: F.when(F.size(s) > n, F.zip_with(
        F.slice(s, F.lit(1), n), F.slice(s, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(s))
    bits = F.zip_with(fold(a), fold(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return 9 * F.aggregate(bits, F.lit(0), lambda x, y: x + y) <= F.col(size_a) + F.col(size_b)


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, n_shingles, node, digest, sketch) of every row; without a set, node is null."""
    rows = text_of(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                row, h = shingles(part.column("text"))
                size, node, digest = _nodes(row, h, part.num_rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("copy"), pa.array(size, pa.int64()),
                    pa.array(node, mask=size == 0), pa.array(digest, pa.binary()),
                    pa.array(_sketches(row, h, size), pa.list_(pa.int64())),
                    *map(pa.array, _fixed_sketches(row, h, part.num_rows).T.copy())],
                    names=["id", "copy", "n_shingles", "node", "digest", "sketch", *_words("k")])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "copy", "text").mapInArrow(run, f"id {kind}, copy long, n_shingles long, node long, digest binary, sketch array<long>, "
                           + ", ".join(f"{k} long" for k in _words("k")))


def _shared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sig, node, size, tag, n): signatures that different nodes share, with the rows that have each."""
    rows = text_of(docs, id_col, text_col).select("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sig, node, size, tag = signatures(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig), pa.array(node), pa.array(size.astype(np.int32)), pa.array(tag)], names=["sig", "node", "size", "tag"])

    sigs = rows.mapInArrow(run, "sig long, node long, size int, tag long")
    w = Window.partitionBy("sig")
    out = sigs.withColumns({"n": F.count(F.lit(1)).over(w), "lo": F.min("node").over(w), "hi": F.max("node").over(w)}).filter("lo != hi")
    return written(out.select("sig", "node", "size", "tag", "n"), "shared")


def _indexed(shared: DataFrame) -> DataFrame:
    """(sig, node): what each set indexes. Segments that no other set shares cost nothing and find nothing;
    where those are worth H + 1 units, the set indexes none at all. Else it takes the cheapest others."""
    own = shared.filter("tag >= 0").selectExpr(
        "sig", "node", "n", "tag >> 34 as units", f"(tag >> 2) & {0xFFFFFFFF} as segment",
        "(tag & 2) > 0 as twice", "(tag & 1) > 0 as without", "cast((size + size * 5 div 4) div 9 + 1 as int) as need")
    cost = own.groupBy("node", "segment").agg(
        F.first("units").alias("units"), F.first("need").alias("need"), F.first("twice").alias("twice"),
        F.coalesce(F.max(F.expr("if(without, null, n)")), F.lit(0)).alias("whole"), F.coalesce(F.sum(F.expr("if(without, n, null)")), F.lit(0)).alias("parts"))
    once = F.expr("if(whole > 0, named_struct('cost', whole, 'unit', 1), null)")
    again = F.expr("if(twice, named_struct('cost', whole + parts, 'unit', 2), null)")
    priced = cost.select("node", "segment", "units", "need", F.explode(F.array_compact(F.array(once, again))).alias("o"))
    w = Window.partitionBy("node")
    ranked = priced.withColumns({"priced": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy("o.cost", "o.unit", "segment"))})
    taken = ranked.filter("place <= need - (units - priced)").groupBy("node", "segment").agg(F.max("o.unit").alias("unit"))
    return own.join(taken, ["node", "segment"]).filter("not without or unit = 2").select("sig", "node").distinct()


def _allocated(shared: DataFrame) -> DataFrame:
    """(sig, node, size, indexed, pivot): the signatures that a set indexes, with all sets that have them;
    the first pivot is the smallest set that indexes it."""
    indexed = written(_indexed(shared).withColumn("indexed", F.lit(True)), "indexed")
    wanted = shared.select("sig", "node", "size").join(indexed.select("sig").distinct(), "sig", "left_semi").distinct()
    rows = written(wanted.join(indexed, ["sig", "node"], "left").withColumn("indexed", F.coalesce("indexed", F.lit(False))), "allocated")
    pivots = rows.filter("indexed").groupBy("sig").agg(F.min(F.struct("size", "node")).alias("p")).select("sig", F.col("p.node").alias("pivot"))
    return written(rows.join(pivots, "sig"), "segments")


def _verify(pairs: DataFrame, texts: DataFrame, per_star: int = 256) -> DataFrame:
    """(x, y, both, either) of each pair: sizes of intersection and union, counted on the words.

    Pairs with the same x meet in stars of about `per_star`, x first, and are read as a stream."""
    many = pairs.groupBy("x").agg(F.count("*").alias("n"))
    stars = pairs.join(many, "x").select(
        "x", "y", F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / per_star)).cast("int").alias("star"))
    stars = written(stars, "stars")
    leaf = stars.join(texts.withColumnRenamed("node", "y"), "y").select("x", "star", F.lit(1).alias("o"), "y", "text")
    head = (stars.select("x", "star").distinct().join(texts.withColumnRenamed("node", "x"), "x")
            .select("x", "star", F.lit(0).alias("o"), F.col("x").alias("y"), "text"))

    def run(batches):
        held, own = None, set()
        for batch in batches:
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"), NOT_SPACE, lower=True)
                raw, begin, end = packed(words)
                out = []
                cols = zip(*(part.column(c).to_pylist() for c in ("x", "star", "o", "y")))
                for i, (x, star, o, y) in enumerate(cols):
                    a, b = int(words.row[i]), int(words.row[i + 1])
                    k = min(K, b - a)
                    own_set = {raw[s:e] for s, e in zip(begin[a:b - k + 1].tolist(), end[a + k - 1:b].tolist())}
                    if o == 0:
                        held, own = (x, star), own_set
                    elif held == (x, star):
                        both = len(own & own_set)
                        out.append((x, y, both, len(own) + len(own_set) - both))
                    else:
                        raise ValueError("a star without its centre")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 4)], names=["x", "y", "both", "either"])

    rows = leaf.unionByName(head).repartition("x", "star").sortWithinPartitions("x", "star", "o")
    return written(rows.mapInArrow(run, "x long, y long, both long, either long"), "verified")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (x, y): label is the least node reached."""
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.min(F.least("x", "y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
                .withColumnRenamed("x", "node"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = written(step.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"), "labels")
        labels = after.select("node", "label")
        if after.filter("label != old").limit(1).count() == 0:
            return labels


def _texts(docs: DataFrame, members: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes, from one row of each."""
    one = members.filter("node is not null").groupBy("node").agg(F.min(F.struct("id", "copy")).alias("r"))
    wanted = one.join(nodes, "node", "left_semi").select("node", F.col("r.id").alias("id"), "r.copy")
    rows = text_of(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))
    same = rows["id"].eqNullSafe(F.col("w.id")) & (rows["copy"] == F.col("w.copy"))
    return rows.join(wanted.alias("w"), same).select("w.node", "text").dropDuplicates(["node"])


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    return _linked(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, n_shingles, label, component_id) of every row; label is null without a set."""
    members = written(_members(docs, id_col, text_col), "members")
    sets = members.filter("node is not null").groupBy("node").agg(
        F.min("digest").alias("a"), F.max("digest").alias("b"), F.first("sketch").alias("sketch"),
        *(F.first(k).alias(k) for k in _words("k")))
    sets = written(sets, "sets")
    if not sets.filter("a != b").isEmpty():
        raise RuntimeError("two different sets have the same first 64 bits of their digest")
    shared = _allocated(_shared(docs, id_col, text_col))
    # (node, text) of the nodes that share a signature, and only of those
    texts = written(_texts(docs, members, shared.select("node").distinct(), id_col, text_col), "texts")
    # (sig, node, size, indexed, label, pivot, fixed sketch) of segments across components
    active = written(shared.join(sets.select("node", *_words("k")), "node").withColumn("label", F.col("node")), "active")
    labels = active.select("node", F.col("node").alias("label")).limit(0)
    checked = None
    for r in range(ROUNDS):
        pairs = _with_pivots(active, sets)
        if checked is not None:
            pairs = pairs.join(checked, ["x", "y"], "left_anti")
        done = _verify(written(pairs, "pairs"), texts)
        links = done.filter("100 * both >= 80 * either").select("x", "y")
        seen = done.select("x", "y")
        checked = seen if checked is None else written(checked.unionByName(seen), "checked")
        before, labels = labels, _joined(labels, links)
        active = written(_relabelled(active, labels, r + 1), "active")
        if active.isEmpty() or (r and 50 * _moved(before, labels) < active.select("node").distinct().count()):
            break
    rest = _across(_apart(active, texts), sets).join(checked, ["x", "y"], "left_anti")
    found = _verify(written(rest, "pairs"), texts).filter("100 * both >= 80 * either").select("x", "y")
    return _named(members, _joined(labels, found))


def _with_pivots(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of each node with the pivots of its segments, as far as the bounds allow."""
    nodes = active.select("node", "size", "label", *_words("k")).dropDuplicates(["node"])
    pivots = nodes.toDF("pivot", "psize", "plabel", *_words("p"))
    met = active.filter("pivot != node").select("pivot", "node").distinct()
    near = met.join(pivots, "pivot").join(nodes, "node").filter("label != plabel").filter(_near("size", "psize", "k", "p"))
    return _ordered(near.select(F.col("pivot").alias("x"), F.col("node").alias("y"), F.col("psize").alias("a"),
                                F.col("size").alias("b")), sets)


def _ordered(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (x, y, a, b) whose long sketches allow a link, the smaller node first."""
    whole = sets.select("node", "sketch")
    ok = (pairs.distinct().join(whole.toDF("x", "sx"), "x").join(whole.toDF("y", "sy"), "y")
          .filter(_may_link("sx", "sy", "a", "b")))
    return ok.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links: components of the old labels, then of their nodes."""
    a = labels.toDF("x", "lx")
    b = labels.toDF("y", "ly")
    edges = links.join(a, "x", "left").join(b, "y", "left").select(
        F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y")).filter("x != y").distinct()
    merged = components(edges).toDF("old", "new")
    nodes = labels.select("node", "label").unionByName(
        links.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(labels, "node", "left_anti")
        .withColumn("label", F.col("node")))
    return written(nodes.join(merged, nodes["label"] == merged["old"], "left").select(
        "node", F.coalesce("new", "label").alias("label")), "labels")


def _relabelled(active: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """The segments that still have nodes of several components, each with a new pivot.

    Segments are folded before the shuffle, and the fold is read back, so that Spark can split a
    segment with very many nodes in the join."""
    now = active.drop("label", "pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    now = written(now, "relabelled")
    pivot = F.min(F.when(F.col("indexed"), F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node")))
    folds = now.groupBy("sig").agg(pivot.alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    folds = written(folds.filter("lo != hi").select("sig", F.col("p.node").alias("pivot")), "segments")
    return now.join(folds, "sig")


def _moved(before: DataFrame, after: DataFrame) -> int:
    """Nodes whose component is another one than before."""
    old = before.withColumnRenamed("label", "old")
    return after.join(old, "node", "left").filter("old is null or old != label").count()


def _apart(active: DataFrame, texts: DataFrame) -> DataFrame:
    """The active rows with `own`, how many shingles of the node no other active node has; these are taken
    out of the fixed sketch. A node with more of them than a link allows is left out.

    Own shingles all count as differences, and without them the sketch has fewer that fall together, so
    the two tell near copies of one text apart that the sketch alone lets through."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                row, h = shingles(part.column("text"))
                place = (mixed(h ^ _K2) % np.uint64(64 * FIXED)).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(part.column("node").to_numpy()[row]), pa.array(place)], names=["h", "node", "place"])

    held = texts.join(active.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(
        run, "h long, node long, place short")
    single = held.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("place").alias("place")).filter("n = 1")
    bits = [F.bit_xor(F.expr(f"if(place div 64 = {i}, shiftleft(1L, place % 64), 0L)")).alias(f"u{i}") for i in range(FIXED)]
    own = written(single.groupBy("node").agg(F.count("*").alias("own"), *bits), "own")
    rows = active.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter("4 * own <= size")
    rest = [F.col(k).bitwiseXOR(F.coalesce(u, F.lit(0))).alias(k) for k, u in zip(_words("k"), _words("u"))]
    rows = written(rows.select("sig", "node", "size", "indexed", "label", "own", *rest), "apart")
    few = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, MEETINGS)
    least = written(rows.groupBy("node").agg(few(F.when(F.col("indexed"), F.col("sig"))).alias("asks"), few("sig").alias("has")), "least")
    return rows.join(least, "node")


def _across(active: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) that share a signature which the smaller one indexes, lie in different components,
    and may be linked.

    A pair that shares many signatures is made at one: the first that is among the least few of both. These
    are shared indeed, so it is made there; a pair without such a one is made at each that it shares."""
    a = active.filter("indexed").select("sig", F.col("node").alias("x"), F.col("size").alias("a"), F.col("label").alias("lx"),
                                        F.col("own").alias("ox"), "asks", *(F.col(k).alias(p) for k, p in zip(_words("k"), _words("p"))))
    b = active.select("sig", F.col("node").alias("y"), F.col("size").alias("b"), F.col("label").alias("ly"), F.col("own").alias("oy"), "has", *_words("k"))
    pairs = a.join(b, "sig").filter("lx != ly and a <= b").filter(_near("a", "b", "p", "k", F.col("ox") + F.col("oy")))
    pairs = pairs.filter(F.coalesce(F.array_min(F.array_intersect("asks", "has")), F.col("sig")) == F.col("sig"))
    return _ordered(pairs.select("x", "y", "a", "b"), sets)


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with the least id of its component; rows without a set are their own."""
    least = members.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    least = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = least.groupBy("label").agg(F.min("least").alias("component_id"))
    by_node = written(least.join(named, "label").select("node", "label", "component_id"), "components")
    out = members.join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "copy", "n_shingles", "label", component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with its least id (of rows that share it, one text's), and
    all rows without a set; with the columns of docs."""
    found = written(_linked(docs, id_col, text_col), "linked")
    first = (found.filter("label is not null").filter(F.col("id").eqNullSafe(F.col("component_id")))
             .groupBy("label").agg(F.min(F.struct("id", "copy")).alias("r")).select("r.id", "r.copy", F.lit(True).alias("one")))
    alone = found.filter("label is null").select("id", "copy", F.lit(False).alias("one")).distinct()
    kept = written(first.unionByName(alone), "kept").select(F.col("id").alias("_id"), F.col("copy").alias("_copy"), "one")
    own = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    rows = docs.select(own, docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("copy"))
    same = (rows["copy"] == kept["_copy"]) & rows["id"].eqNullSafe(kept["_id"])
    taken = rows.join(kept, same).select("doc", "id", "copy", "one")
    nth = F.row_number().over(Window.partitionBy("copy", "id").orderBy("one"))
    return taken.withColumn("nth", nth).filter("nth = 1 or not one").select("doc.*")
