"""Registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalweave.llm import bpe, chat, decontaminate, exact_copies, html_extract, language, lexical, ngram_join, prefix_trie, quality, repeats, secret_scan, statements, token_counts


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)


PLANS: dict[str, Plan] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        PLANS[name] = Plan(name, build, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict:
    return bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(), "text", ["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op6_quality_rules", statements.QUALITY)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


@query("op7_benchmark_decontamination", statements.DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontaminate.hit_words()
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op8_token_counts")
def token_count_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary(), "text", "ids", ["doc_id"])
    histogram = token_counts.length_histogram(encoded.select(F.size("ids").alias("n_tokens")))
    return token_counts.limit_table(histogram)


@query("op10_ngram_jaccard_join", statements.NGRAM_JOIN)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op2_chat_formatting")
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(given.unionByName(more))


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language.fit(rows.filter("NOT held_out AND doc_id IS NOT NULL"), order=F.col("doc_id"))
    return language.predict(rows.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


@query("op5_suffix_array_dedup", statements.REPEATS)
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


def secret_forest(docs: DataFrame) -> secret_scan.Forest:
    """The forest of the built-in labelled findings and those that the corpus labels by their form."""
    return secret_scan.train([*secret_scan.labelled_findings(), *secret_scan.corpus_findings(docs)])


@query("op3_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_forest(docs), ["doc_id", "text"])
    opened = found.select("doc_id", "text", F.inline("findings"))
    value = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return opened.select("doc_id", "start", "end", "score", F.sha2(value.cast("binary"), 256).alias("secret_sha256"))


@query("op4_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_pages(pages, ["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op12_exact_dedup", statements.EXACT_COPIES)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.mark_copies(table(spark, sf_dir, "documents"))


@query("op13_ranked_lexical_search", statements.RANKED_SEARCH)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_prefix_trie", statements.PREFIX_TRIE)
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("enter", "exit")
