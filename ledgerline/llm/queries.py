"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import ann_forest, bitslices, hilbert, host_rules, html_tree, mixing, nbsvm, packing, runs, simhash, skip_chain, token_counts, warc
from ledgerline.llm.common import bounded, let, table, words_of

VOCABULARY = "byte_bpe_50k.json"
WEIGHTS = [5.0, 2.0, 1.0]
WARC_DATE = "2024-01-01T00:00:00Z"


def vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> nbsvm.Model:
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id")) != 1)
    return nbsvm.train(docs, labels, "quality")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.host_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "host_n", "host_failures", F.round("host_rate", 9).alias("host_rate"))


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(), [512])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("_row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_dom_sum_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).select("_row.*", "text", "n_chars")


def op8_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"], WEIGHTS)
    return mixed.select("_row.doc_id", "size", "source_size", "target", "taken")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.page_derivatives(table(spark, sf_dir, "pages"), ["page_id"], WARC_DATE)
    return found.select("_row.page_id", *[c for c in found.columns if c != "_row"])


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = nbsvm.score(docs, quality_model(spark, docs, sf_dir), ["doc_id"])
    held_out = F.coalesce(remainder(F.col("_row.doc_id")) == 1, F.lit(False))
    return scored.select("_row.doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = runs.periodic_runs(docs.withColumn("_periodic", with_periods(F.col("doc_id"), F.col("text"))), ["doc_id"], "_periodic")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    higher = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    found = found.withColumn("_top", F.aggregate("runs", F.get("runs", F.lit(0)), higher))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("_row.doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period",
                        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_periods(doc_id: Column, text: Column) -> Column:
    """The contract's input: in a tenth of the documents, by their id, the words from some place on repeat with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        copies = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(copies, 1, n - a)), " "))

    return F.when(h % 10 == 0, let(words_of(text), repeated)).otherwise(text)


def op12_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = skip_chain.personal_data(docs, skip_chain.train(docs), ["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("_row.doc_id", *[count(k) for k in skip_chain.KINDS],
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: bounded(f) for f in (
    op1_sum_of_squares_packing, op2_projection_forest, op3_host_rules, op4_prefix_token_counts, op5_hilbert_shards,
    op6_simhash_tiles, op7_dom_sum_product, op8_min_cost_mix, op9_warc_derivatives, op10_nbsvm_quality, op11_periodic_runs,
    op12_skip_chain_pii, op13_bit_sliced_search)}
