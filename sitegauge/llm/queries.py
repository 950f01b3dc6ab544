"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .decontaminate import contaminated
from .html_text import extract_pages
from .line_dedup import dedup_lines
from .merkle import document_manifest, verified
from .mixing import mix_plan
from .near_dup import near_duplicates
from .oracles import SQL
from .pieces import decode, digests, encode
from .token_counts import token_counts
from .token_ids import token_ids
from .toxicity import toxicity
from .trie import conversation_turns, prefix_trie, rebuilt
from .warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, as read back from their archives."""
    return archive(table(spark, sf_dir, "pages")).drop("url")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of each document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each whole document."""
    return token_counts(table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's token ids, as read back from the files."""
    return token_ids(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, exactly or nearly."""
    return dedup_lines(table(spark, sf_dir, "documents"))


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for each vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_plan(table(spark, sf_dir, "documents")).drop("source")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(*conversation_turns(table(spark, sf_dir, "conversations"))))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document by its distinct chunks and the text they decode to, as digests."""
    return digests(decode(encode(table(spark, sf_dir, "documents"))))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and whether a tampered one is found out."""
    return verified(document_manifest(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_order_minhash, op3_token_counts, op4_token_ids, op5_line_dedup, op6_learned_partitions, op7_mixing, op8_decontamination, op9_toxicity, op10_html_text, op11_prefix_trie, op12_pieces, op13_merkle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
