"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiltgraph.llm import alignment, credentials, decontaminate, licenses, media, packing, quality, search, sharding, simhash, suffixes, urls, warc
from quiltgraph.llm.common import read_table


def tokenizer_path() -> str:
    """The tokenizers file of the packing query: a parameter of the machine, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The sentencepiece model of the alignment query, likewise."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_sequences(read_table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(read_table(spark, sf_dir, "documents")))


def op4_sniff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.sniff_media(media.store_media(read_table(spark, sf_dir, "documents"))))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.interleave_shards(read_table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), report=suffixes.WORDS_50))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.archive_pages(read_table(spark, sf_dir, "pages")))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digest(credentials.find_secrets(read_table(spark, sf_dir, "documents")))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read_table(spark, sf_dir, "documents"), (tokenizer_path(), piece_model_path()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_pack, op3_license_scan, op4_sniff_media, op5_shard, op6_simhash, op7_quality, op8_url_filter, op9_suffix_dedup, op10_warc, op11_search, op12_secrets, op13_align)
}

#: The others need hashes, trained models or formats that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_url_filter": urls.oracle_sql(), "op10_warc": warc.ORACLE_SQL, "op11_search": search.ORACLE_SQL}
