"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells (source, language, topic). Raking scales the cells until the sums by
source, by language and by topic all meet their targets, and changes the mix inside no cell. Each
document is then taken with its cell's probability, decided by a hash of its id, so a repeated run
or a lost executor takes the same ones. Only the small table of cells is fitted; the documents are
read once to count and once to sample. Everything here is DataFrame functions.

Targets are shares per value; without them, a value's target is its token share to the power
`alpha`, brought back to one in sum (below one, small sources and languages gain). Values without a
target (where targets are given) get none of the mix. A target whose value has no tokens cannot be
met; the other targets of that marginal are scaled up.

Where every document is taken at most once, no cell can give more than its own tokens. A value whose
target is beyond its tokens gives all of them, and the other targets of that marginal are scaled up;
inside a marginal's value, what a full cell can't give comes from its other cells. So the mix has all
its tokens as long as the corpus has them. Targets that only contradict each other together are met
by topic, and by source and language as closely as the sweeps come.

Topics: documents have none of their own, so `topic_of` sorts them by length and layout; any other
column can be given instead.

Defined cases: a null source or language is a value of its own (the empty string); a null or empty
text has no tokens, weighs nothing, and takes its cell's probability; equal rows are taken or left
together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

MARGINALS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
SWEEPS, ALPHA, RATE = 12, 0.7, 0.5
SMALL_PLAN = 100_000  # cells; a larger table of cells is joined by a shuffle


def topic_of(text: Column, tokens: Column) -> Column:
    """notes (under 80 words), lists (a line break for each 12 words or fewer), articles, long reads."""
    breaks = F.regexp_count(text, F.lit("\n"))
    return (F.when(tokens < 80, "notes").when(breaks * 12 >= tokens, "lists")
            .when(tokens < 1500, "articles").otherwise("long"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Documents and tokens of each cell."""
    return rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def _target(cells: DataFrame, name: str, given: Mapping[str, float] | None, alpha: float) -> Column:
    """The wanted share of the cell's value in one marginal, before scaling to one in sum."""
    if given is None:
        return F.pow(F.sum("tokens").over(Window.partitionBy(name)).cast("double"), F.lit(alpha))
    out = F.lit(0.0)
    for k, v in given.items():
        out = F.when(F.col(name) == k, F.lit(float(v))).otherwise(out)
    return out


def _fitted(df: DataFrame, by, size: str, want: Column, keys) -> DataFrame:
    """df with `size` scaled by one factor for each group, so that the sum of least(size, cap) is `want`,
    or all of the caps where they are less. With the rows in the order in which they fill up, it is
    the largest factor that some row and those after it need for what the rows before it leave."""
    group, full = Window.partitionBy(by), F.col("cap") / F.col(size)
    before = Window.partitionBy(by).orderBy(full, *keys).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(by).orderBy(full.desc(), *(F.desc(k) for k in keys)).rowsBetween(Window.unboundedPreceding, 0)
    left = F.least(want, F.sum("cap").over(group)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    df = df.withColumn("need", left / F.sum(size).over(after))
    factor = F.least(F.max("need").over(group), F.max(full).over(group))
    return df.withColumn(size, F.col(size) * factor).drop("need")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA,
         sweeps: int = SWEEPS, rate: float | None = None) -> DataFrame:
    """The cells with `weight`: their share of the mix. With a `rate`, the mix is that share of all tokens
    and no cell has more of it than `cap`, its own tokens; cells without a target are left out."""
    targets, out = targets or {}, cells.filter("tokens > 0")
    for m in MARGINALS:
        values = out.withColumn("t", _target(out, m, targets.get(m), alpha)).select(m, "t").distinct()
        share = values.select(m, (F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0)))).alias(f"want_{m}"))
        out = out.join(share, m)
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    out = written(out.withColumn("weight", F.col("tokens") / all_tokens), "cells")
    if rate is not None:
        return _raked_within(out, sweeps, rate)
    for i in range(sweeps):
        for m in MARGINALS:
            have = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"want_{m}") / have).otherwise(0.0))
        if i % 4 == 3:
            out = written(out, "cells")
    return out


def _raked_within(cells: DataFrame, sweeps: int, rate: float) -> DataFrame:
    out = cells.withColumn("cap", F.col("weight") / rate if rate > 0 else F.lit(1.0))
    out = out.filter(" and ".join(f"want_{m} > 0" for m in MARGINALS))
    for m in MARGINALS:
        values = out.groupBy(m).agg(F.max(f"want_{m}").alias("t"), F.sum("cap").alias("cap"))
        values = _fitted(values, F.lit(0), "t", F.lit(1.0), [m])
        out = out.drop(f"want_{m}").join(values.select(m, F.least("t", "cap").alias(f"want_{m}")), m)
    out = written(out, "cells")
    for i in range(sweeps):
        for m in MARGINALS:
            out = _fitted(out, m, "weight", F.col(f"want_{m}"), MARGINALS)
        if i % 4 == 3:
            out = written(out, "cells")
    return out.withColumn("weight", F.least("weight", "cap"))


def _uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: the first 13 hex digits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _measured(docs: DataFrame, text_col: str, topic: Column | None) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("doc"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
        (topic if topic is not None else topic_of(text, tokens)).alias("topic"), tokens.alias("n_tokens"))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE,
          alpha: float = ALPHA, sweeps: int = SWEEPS, seed: int = 1, text_col: str = "text", id_col: str = "doc_id",
          topic: Column | None = None, once: bool = True) -> DataFrame:
    """(doc, source, lang, topic, n_tokens, weight, expected, copies): `doc` has all columns of docs.

    `rate` of the corpus' tokens is wanted, mixed as raked. A document's expected number of copies is
    weight * rate * all tokens / tokens of its cell, given as `expected`; `copies` is that number
    rounded up or down at random, so that the expectation is met. With `once`, the cells are raked within
    their own tokens and no document has more than one copy; without, no cell is capped.
    """
    rows = _measured(docs, text_col, topic)
    cells = cells_of(rows.select(*MARGINALS, "n_tokens"))
    cells = written(cells, "cells")
    raked = rake(cells, targets, alpha, sweeps, rate if once else None)
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    if once:
        raked = raked.withColumn("expected", F.col("weight") / F.col("cap") if rate > 0 else F.lit(0.0))
    else:
        raked = raked.withColumn("expected", F.lit(rate) * F.col("weight") * all_tokens / F.col("tokens"))
    plan = raked.select(*MARGINALS, "weight", "expected")
    plan = written(plan, "mix")
    if plan.count() <= SMALL_PLAN:
        plan = F.broadcast(plan)
    out = rows.join(plan, list(MARGINALS), "left")
    expected = F.coalesce("expected", F.lit(0.0))
    copies = (F.floor(expected) + F.when(_uniform(F.col("doc")[id_col], seed) < expected - F.floor(expected), 1).otherwise(0))
    return out.select("doc", *MARGINALS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                      expected.alias("expected"), copies.cast("int").alias("copies"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """Documents of docs that the mix takes (once each), with their own columns."""
    taken = mixed(docs, **options, once=True).filter("copies > 0")
    return taken.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
