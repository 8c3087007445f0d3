"""The registered query of each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchmart.llm import bigrams, bpe, classifier, conversations, counts, lines, packing, periods, rules, simhash, topk, urls, warc
from dispatchmart.llm.oracles import LINE_DEDUP, QUALITY_RULES, REVISITS, URL_FILTER
from dispatchmart.llm.records import spark_records
from dispatchmart.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_warc_revisits(spark, sf_dir):
    """All revisit records of an archive derived from the pages."""
    flat = spark.sql(spark_records("{pages}"), pages=table(spark, sf_dir, "pages"))
    names = ("etag", "last_modified", "cache_control", "content_length")
    pairs = [part for name in names for part in (F.lit(name.replace("_", "-").title()), F.col(name))]
    records = flat.select(
        "record_id",
        "kind",
        "url",
        F.timestamp_seconds("seconds").alias("date"),
        "status",
        F.create_map(*pairs).alias("headers"),
    )
    resolved = warc.resolve_revisits(records)
    headers = [F.element_at("headers", F.lit(name.replace("_", "-"))).alias(name) for name in names]
    return resolved.select("record_id", "canonical", "outcome", "refers_to", *headers)


# The rules of the query, as given.
URL_RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]

LISTED_HOSTS = "(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"
"""Hosts whose addresses make up the list of the query."""


@query
def op3_url_filter(spark, sf_dir):
    """The list holds every address of the corpus on a host with a listed word in its name."""
    pages = urls.with_address(table(spark, sf_dir, "pages").select("page_id", "url"))
    listed = pages.where(F.col("host").rlike(LISTED_HOSTS)).select("key")
    cascade = urls.build_cascade(listed, pages.select("key"))
    return urls.judge(pages, URL_RULES, cascade).select("page_id", "host", "path", "rule", "verdict", "listed")


@query
def op4_bpe_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_quality_rules(spark, sf_dir):
    return rules.measure(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("lost_share", 6).alias("lost_share"),
    )


@query
def op6_lm_scoring(spark, sf_dir):
    """The target is what the labels call good; the background is the whole corpus."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return bigrams.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query
def op7_token_counts(spark, sf_dir):
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_simhash(spark, sf_dir):
    linked = simhash.link(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", simhash.as_hex(F.col("bits")).alias("fingerprint"), "component_id")


@query
def op10_topk_search(spark, sf_dir):
    """Every row whose identifier is divisible by 20 asks with all terms of its whole text, all rows are searched."""
    return topk.search(table(spark, sf_dir, "documents"), "doc_id % 20 = 0")


def _quality_labels(spark, sf_dir):
    """``doc_id, label`` of the rows that may be learned from."""
    labels = table(spark, sf_dir, "labels").where(~classifier.held_out())
    return labels.select("doc_id", F.col("quality").alias("label"))


@query
def op9_quality_classifier(spark, sf_dir):
    scored = classifier.classify(table(spark, sf_dir, "documents"), _quality_labels(spark, sf_dir))
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", "predicted")


@query
def op11_conversation_repair(spark, sf_dir):
    """Conversations damaged by a hash of their turns, repaired."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations"))).conversations


@query
def op12_line_dedup(spark, sf_dir):
    kept = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op13_periodic_runs(spark, sf_dir):
    found = periods.collapse_runs(table(spark, sf_dir, "documents"))
    digest = F.sha2("collapsed", 256).alias("collapsed_sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", digest)


ORACLES["op2_warc_revisits"] = REVISITS
ORACLES["op3_url_filter"] = URL_FILTER
ORACLES["op5_quality_rules"] = QUALITY_RULES
ORACLES["op12_line_dedup"] = LINE_DEDUP
