"""The registered queries of this package: each operator, with production parameters, on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm import (bytecnn, conversations, decontam, idfiles, interactions, linechunks, pieces, quality, render,
                            secrets, simhash, urls, warc)
from tideledger.llm.common import ship, table
from tideledger.session import shared_folder

#: host, path, verdict of the URL rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the same on driver and executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base rules and the certified rules' verdict."""
    rows = quality.durable(quality.measured(table(spark, folder, "documents")))
    cuts = quality.fit(rows, table(spark, folder, "labels"))
    return quality.judge(rows, cuts).select(
        "doc_id", *[F.col(f"m.{c}").alias(c) for c in quality.MEASURES], "base_failed", "kept", "rule")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and the test item that it holds."""
    ship(spark)
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    ship(spark)
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    found = warc.read_archives(spark, path, with_payload=False).where("gap is null")
    return found.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secrets: fixed patterns and literals assigned to sensitive names."""
    ship(spark)
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, longest fitting rule and verdict."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's distinct sampled segmentations as piece ids, one row per sample."""
    ship(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pieces.exploded(pieces.encode(docs, tokenizer_file("piece_bpe_32k.model")))
    return found.select("doc_id", "sample", "n_pieces", F.xxhash64("ids").alias("ids_hash"), "ids", "log_prob",
                        "log_inclusion", "round_trip")


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's visible text."""
    ship(spark)
    return render.visible_text(table(spark, folder, "pages").select("page_id", "html"))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the least doc_id of its component."""
    ship(spark)
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written in the package's format and read back."""
    ship(spark)
    path = shared_folder(spark, "ids")
    idfiles.write_ids(table(spark, folder, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return idfiles.read_ids(spark, path, with_ids=False)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the chunks of lines and passages that came before."""
    ship(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return linechunks.dedup_lines(docs, passages=True)


def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Every part, order of the five filters and step: what is kept, removed and lost there."""
    ship(spark)
    masks = interactions.failure_masks(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return interactions.audit_orders(masks, "ABCDE")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, damaged: its faults and the least edits that repair it."""
    ship(spark)
    rows = table(spark, folder, "conversations")
    return conversations.audits(conversations.damage(rows), rows)


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, by a network trained on three quarters of the labelled ones."""
    ship(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    net = bytecnn.train(docs)
    held_out = F.coalesce(~bytecnn.in_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    return bytecnn.predict(docs.select("doc_id", held_out, "text"), net)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_decontamination, op3_warc, op4_secret_scan, op5_url_filter, op6_sentencepiece, op7_html_extraction,
    op8_simhash, op9_token_files, op10_line_dedup, op11_filter_interactions,
    op12_conversation_repair, op13_language_id)}
