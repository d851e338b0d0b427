"""Quality rules as a ledger: each rule runs once, its outcome is one bit, and policies read bits.

The ledger keeps what was measured and which rules failed. A policy is a named, versioned set of
rules; applying one, or asking what a rule contributes, is arithmetic on the bits and never reads
the texts again. Everything here is DataFrame functions.

Defined cases: a null or empty text has no words and fails `few_words`. Repeated rows are judged
alike, one by one. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside windows of five words that occur at least twice in the text."""
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def twice(s: Column) -> Column:
        def same(p, j):
            return F.coalesce(F.get(s, j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(
                F.get(s, j + 1)["h"] == p["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, same), lambda p: p["i"]))

    def covered(pos: Column) -> Column:
        return F.aggregate(
            F.transform(pos, lambda p, j: F.least(F.coalesce(F.get(pos, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(F.sort_array(pairs), lambda s: _let(twice(s), covered)))

    return _let(hashes, count)


def _measured(text: Column) -> Column:
    split = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        _let(split, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: A bit belongs to one rule for good; a changed rule gets a new bit, so old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 8 * word_chars"),
    Rule(3, "shouting", "100 * n_upper > 40 * word_chars"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(5, "word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
BY_NAME = {r.name: r for r in RULES}


def policy(*names: str) -> int:
    return sum(BY_NAME[n].mask for n in names)


POLICIES = {
    "base-1": policy("few_words", "repeated_words"),
    "corpus-1": policy("few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "word_length"),
}


def _with_ledger(docs: DataFrame, text: str, measures: str, bits: str) -> DataFrame:
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    m = docs.withColumn(measures, _measured(whole))
    flat = F.struct(*(F.col(f"{measures}.{p}{k}").alias(k) for k, p in
                      [(k, {"n_words": "w.", "word_chars": "w.", "n_repeat_words": "w.", "n_lines": "l.",
                            "n_dup_lines": "l."}.get(k, "")) for k in MEASURES]))
    m = m.withColumn(measures, flat)
    failed = F.lit(0).cast("long")
    for r in RULES:
        sql = " ".join(f"{measures}.{t}" if t in MEASURES else t for t in r.fails.split())
        failed = failed + F.when(F.expr(sql), F.lit(r.mask)).otherwise(F.lit(0))
    return m.withColumn(bits, failed)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements..., failed_bits) of every row."""
    own = docs.select(docs[id_col], docs[text_col].alias("_text"))
    out = _with_ledger(own, "_text", "_m", "failed_bits")
    return out.select(id_col, *(F.col(f"_m.{k}").alias(k) for k in MEASURES), "failed_bits")


def apply_policy(rows: DataFrame, name: str, bits: str = "failed_bits") -> Column:
    """True where no rule of the policy failed."""
    return rows[bits].bitwiseAND(F.lit(POLICIES[name])) == 0


def keep(docs: DataFrame, name: str = "corpus-1", text_col: str = "text") -> DataFrame:
    """Rows of docs that the policy keeps, with their own columns."""
    taken = set(docs.columns)
    m, b = (next(f"{c}{i}" for i in range(len(taken) + 1) if f"{c}{i}" not in taken) for c in ("_m", "_b"))
    out = _with_ledger(docs, text_col, m, b)
    return out.filter(apply_policy(out, name, b)).select(*docs.columns)


def ablations(rows: DataFrame, name: str) -> DataFrame:
    """For each rule of a policy: failures, rows that only it rejects, rows kept without it.

    Rows are first counted by their bits (2 ** rules groups at most, combined before the shuffle).
    """
    mask = POLICIES[name]
    counted = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("n"))
    used = [r for r in RULES if r.mask & mask]
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("m")) for r in used)))
    each = counted.withColumn("r", rules)
    hit = F.col("b").bitwiseAND(F.col("r.m")) != 0
    alone = F.col("b") == F.col("r.m")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failures"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when(alone | (F.col("b") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )
