"""The queries of the corpus operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_search, bpe, conversation_trie, line_dedup, mixing, packing, quality_rules, secret_scan, simhash_dedup, source_divergence, token_counts, toxicity, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.with_components(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digests=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op4_binary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are all rows whose id is divisible by 100; they may find themselves."""
    rows = _read(spark, sf_dir, "embeddings")
    return binary_search.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


#: Host and path rules of the URL query.
URL_RULES = [
    url_filter.UrlRule("block", "net", "/"),
    url_filter.UrlRule("allow", "example.net", "/en/"),
    url_filter.UrlRule("block", "example.com", "/de/"),
    url_filter.UrlRule("allow", "org", "/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets its tree; one in eight is edited: words put in at its middle, a cut, and a replacement."""
    import public_tokenizers

    size = F.char_length(F.coalesce("text", F.lit("")))

    def edit(seq: int, start: str, length: int, text: str):
        at = F.expr(start).cast("int")
        return F.struct(F.lit(seq).alias("seq"), at.alias("start"), (at + length).alias("end"), F.lit(text).alias("text"))

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    touched = docs.where(F.crc32(F.col("doc_id").cast("string")) % 8 == 0).select("doc_id", size.alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    edits = touched.select("doc_id", F.inline(F.array(edit(1, "size div 2", 0, " some words put in\n"), edit(2, "size div 3", 7, ""), edit(3, "(2 * size) div 3", 5, "  re-placed, 2 times "))))
    ranks = bpe.read_spec(spark, tokenizer_path("byte_bpe_50k.tiktoken"))
    return token_counts.count_with_edit_table(docs, edits, ranks, public_tokenizers.PATTERN).drop("edited_text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_history(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.shared_prefixes(_read(spark, sf_dir, "conversations")).drop("key")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_binary_topk": op4_binary_topk,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op10_bpe": op10_bpe,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_divergence": op13_source_divergence,
}
