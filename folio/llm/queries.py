"""The registered queries: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontam, langid, licenses, lm, packing, periodic, quality, quality_rules, simhash, sql, substring_dedup, trie, warc
from folio.llm.common import shared_folder, table
from folio.llm.line_dedup import LineIndex
from folio.llm.registry import ORACLE, QUERIES, query
from folio.session import cut_lineage

__all__ = ["ORACLE", "QUERIES"]


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_decontaminate", sql.OP9)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_line_dedup", sql.OP10)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = LineIndex.create(spark).insert(docs).dedup(docs, counts=("n_lines", "n_dropped"), indexed=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out("doc_id", 4, 2)))
    out = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


@query("op3_pack")
def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = langid.profiles(docs.where(~held_out("doc_id", 3, 1)))
    out = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), langid.predict(F.col("text"), known).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Runs of 20 words: sure to be in every 50 words that recur, and phrases of fewer, which clean documents share, stay.
    out = substring_dedup.dedup(docs, lengthen=True, min_words=20)
    return out.select("doc_id", "text", F.coalesce(F.size("removed_sentences"), F.lit(0)).cast("bigint").alias("n_removed"),
                      "removed_sentences")


@query("op2_quality_rules", sql.OP2)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A line's documents are counted, copies included, and the absolute limit holds in hosts of every size.
    return quality_rules.rules(table(spark, sf_dir, "documents"), copies=True, max_share=0).drop("clean_text")


@query("op4_licenses", sql.op4(licenses.TEMPLATES))
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = spark.createDataFrame(licenses.TEMPLATES, "license string, notice string")
    out = licenses.scan(table(spark, sf_dir, "documents"), notices, apart=True)
    return out.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"),
                      F.array_join("licenses", ",").alias("licenses"))


@query("op7_lm_score")
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs.where(~held_out("doc_id", 5, 1)))
    return lm.score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "perplexity")


@query("op13_warc", sql.OP13)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, compression="gzip")
    out = warc.captures(warc.read_records(spark, folder, payload=False))
    return out.select(warc.page_of(F.col("metadata")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
                      "record_type", warc.page_of(F.col("referred.metadata")).cast("bigint").alias("refers_to"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: texts with an id whose crc32 is divisible by 10 repeat some of their words to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(
        "text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = (F.col("n") - F.col("a")).cast("int")
    cycle = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a").cast("int")), tail)
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(table(spark, sf_dir, "documents"))
    out = docs.select("doc_id", periodic.periodic_runs(F.col("text")).alias("p"))
    runs = F.col("p.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                            (-r["period"]).alias("period"))))
    told = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size(runs) > 0, F.concat(told, F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"),
                     F.sha2("p.collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
                      F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns -> those of the rebuilt conversations, whose first turns are another one's, and all conversation ids."""
    of = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    of = cut_lineage(of.join(of.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left"))
    lead = rows.where("pos <= 8").withColumnRenamed("conv_id", "base").join(of.select("conv_id", "base", "h"), "base").where("pos <= h")
    own = rows.join(of.select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("led")), "conv_id").where("pos > h")
    own = own.withColumn("pos", F.col("led") + F.col("pos") - F.col("h"))
    return cut_lineage(lead.select(*rows.columns).unionAll(own.select(*rows.columns))), of.select("conv_id")


@query("op11_prefix_trie", sql.OP11)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = rebuilt(cut_lineage(trie.numbered(table(spark, sf_dir, "conversations"))))
    return trie.prefix_trie(rows, members).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                  "saved_tokens", "ends_sha256")
