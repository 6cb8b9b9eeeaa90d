"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_count, collocations, fertility, html_text, line_dedup, markov_secrets, minhash, mixing, packing, token_files,
    topk, warc, whitening,
)
from .common import read_table
from .oracle import ORACLE as ORACLE

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op3_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages"))


def op4_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).taken()


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


def op6_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(read_table(spark, sf_dir, "documents")).drop("row")


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {
    "op1_genetic_packing": op1_genetic_packing,
    "op2_tag_path_text": op2_tag_path_text,
    "op3_warc_pages": op3_warc_pages,
    "op4_block_mix": op4_block_mix,
    "op5_line_windows": op5_line_windows,
    "op6_minhash_groups": op6_minhash_groups,
    "op7_segment_top_k": op7_segment_top_k,
    "op8_fertility": op8_fertility,
    "op9_markov_secrets": op9_markov_secrets,
    "op10_token_files": op10_token_files,
    "op11_whitening": op11_whitening,
    "op12_phrases": op12_phrases,
    "op13_token_counts": op13_token_counts,
}
