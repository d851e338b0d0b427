"""The operators of this subpackage as registered queries: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, ngram_join, partial_matching, periodic_runs, raking, rule_ledger, substring_dedup, token_files, toxicity_fm, vector_packing, warc_bundles, wrapper_induction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_decontamination(table):
    found = decontaminate.contamination(table("documents"), table("benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


@query
def op8_quality_rules(table):
    rows = rule_ledger.ledger(table("documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rule_ledger.apply_policy(rows, "base-1")).alias("base_failed"),
        rule_ledger.apply_policy(rows, "corpus-1").alias("kept"), "failed_bits")


@query
def op2_warc(table):
    index, folder = warc_bundles.archive(table("pages"))
    return warc_bundles.inventory(index, folder)


@query
def op7_token_files(table):
    import public_tokenizers

    read = token_files.tokenize_to_files(table("documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_substring_dedup(table):
    kept = substring_dedup.deduplicated(table("documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_mixing(table):
    mix = raking.mixed(table("documents"), once=False)
    return mix.select(F.col("doc.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens",
                      F.round("weight", 9).alias("weight"), F.round("expected", 9).alias("expected"), "copies")


@query
def op10_sharding(table):
    placed = vector_packing.pack(table("documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_toxicity(table):
    docs = table("documents")
    scored = toxicity_fm.score(docs, toxicity_fm.train(docs, table("labels")))
    return scored.select("doc_id", toxicity_fm.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_ngram_join(table):
    return ngram_join.linked(table("documents"))


@query
def op9_html_extraction(table):
    found = wrapper_induction.extract(table("pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_lm_scoring(table):
    return partial_matching.scored(table("documents"))


@query
def op13_periodic_runs(table):
    found = periodic_runs.periodic_runs(table("documents"), placed=periodic_runs.planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_conversation_repair(table):
    found = conversation_repair.repair(conversation_repair.damaged(table("conversations")))
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
