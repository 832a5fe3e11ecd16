"""One thin query per operator over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roughcut.llm.common import stored
from roughcut.llm.conversation_trie import CONVERSATION_TRIE_SQL, ordered_turns, prefix_trie, rebuilt
from roughcut.llm.decontaminate import DECONTAMINATION_SQL, contaminated
from roughcut.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from roughcut.llm.html_text import extract_pages
from roughcut.llm.langid import identify_languages
from roughcut.llm.line_dedup import LINE_DEDUP_SQL, dedup_lines
from roughcut.llm.mixing import cube_mix
from roughcut.llm.near_dedup import NEAR_DEDUP_SQL, near_duplicates
from roughcut.llm.periodic import periodic_runs, strongest, with_repeated_tail
from roughcut.llm.quality import quality_rules
from roughcut.llm.secrets import scan_secrets
from roughcut.llm.sharding import rendezvous_shards, sharding_sql
from roughcut.llm.substring_dedup import SUBSTRING_DEDUP_SQL, dedup_substrings
from roughcut.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "kept")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that strings repeated from earlier leave of every document."""
    return dedup_substrings(read_table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by compression."""
    return identify_languages(read_table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeated runs leave of every document."""
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query
def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix."""
    return cube_mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the equal texts stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


@query
def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return rendezvous_shards(read_table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")) \
        .withColumn("similarity", F.round("similarity", 6))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and whether the base rule and the learned rules keep it."""
    rows, _ = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "rule")


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each begun with turns of the first of five."""
    turns = stored(ordered_turns(read_table(spark, sf_dir, "conversations")), "turns")
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 9
    convs, again = rebuilt(turns, head, conv - conv % 5, 8)
    return prefix_trie(convs, stored(again, "rebuilt"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every text, a tenth of the texts with a repeated tail."""
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs, text_col=with_repeated_tail(F.col("text"), F.col("doc_id")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = [F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256)
              .alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
    return found.withColumn("best", strongest()).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), *digest)


ORACLE_SQL |= {
    "op1_minhash_near_dedup": NEAR_DEDUP_SQL,
    "op2_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op7_exact_dedup": EXACT_DEDUP_SQL,
    "op8_rendezvous_sharding": sharding_sql(),
    "op9_decontamination": DECONTAMINATION_SQL,
    "op12_conversation_trie": CONVERSATION_TRIE_SQL,
}
