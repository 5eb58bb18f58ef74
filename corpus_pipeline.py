"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Quality classifier, near-dedup, suffix-array dedup, benchmark
decontamination, packing.  Each stage works on all that its predecessor kept.

Stages read text and, where they choose or name documents, doc_id; other
columns pass through all but the last.  The quality model takes a null text for
an empty one; near-dedup takes all texts without words, null ones too, for
copies of each other; a null or empty text is not cut, holds no benchmark
window and packs as an end token.  Texts of any length are worked on whole.
Repeated rows are scored alike, and near-dedup leaves one row of each text,
that with the smallest id.  An empty table of documents gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import decontaminate, packing, quality, simhash, suffixes
from quiltgraph.llm.common import read_table
from quiltgraph.llm.queries import tokenizer_path
from quiltgraph.storage import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on labelled ones that aren't held out, rejects go."""
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a likeness, in five-word shingles, of 0.8 or more stays, that with the smallest id."""
    return simhash.keep_alike(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur elsewhere are cut; n_chars follows the text."""
    cut = suffixes.strip_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences."""
    return packing.digest(packing.pack_sequences(docs, tokenizer_path()))


STAGES = [("quality", keep_quality), ("simhash", drop_near_copies), ("suffixes", cut_repeats), ("decontaminate", drop_leaks), ("pack", pack)]

#: A trained model, hashes and a tokenizer take part: not for SQL.  Tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
