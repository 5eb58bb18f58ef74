"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorting all
rows by fractional rank interleaves the sources in proportion, and cutting
that order into equal pieces gives every shard the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.operators.ranking import prefix_sum

SHARDS = 16
SEED = 20240501
#: Rows of a bucket within which rows are ranked; see _bucket_rows.
LEAST_BUCKET, MOST_BUCKET = 500, 200_000


def _bucket_rows(n: int) -> int:
    """Rows in a ranking bucket: few enough to deal well, many enough that bucket counts stay small."""
    return min(MOST_BUCKET, max(LEAST_BUCKET, n // 20_000))


def interleave_shards(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Deal rows into shards of equal counts (at most one apart), each with the mixture of sources.

    Returns doc_id, source, size (UTF-8 bytes plus 1; null text: 1),
    text_crc32 (null text: that of nothing), shard, slot (gapless from 0 in
    each shard).  Rank and position are exact but never computed in one task:
    a row's rank within its source is its rank in a hash bucket plus the
    counts of the buckets before, and likewise for the position overall, so a
    source with a third of all rows, or very many sources of one row each, are
    spread over many tasks.  At most a quarter of the slices are crowded, each
    with four buckets' rows, so the table of them that is broadcast is small;
    within a crowded slice the source's hash orders before the fraction.  Only ids,
    sources and two numbers are shuffled, not texts.  A null source is a
    source of its own; null ids and repeated rows each get a slot (rows that
    agree in all columns read are interchangeable).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    n = docs.count()
    each = _bucket_rows(n)
    buckets = max(1, -(-n // each))

    # Rank within the source: (bucket, hash, id).
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("stratum", "bucket", (F.sum("n").over(before) - F.col("n")).alias("start"), F.sum("n").over(whole).alias("n_source"))
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1).join(starts, ["stratum", "bucket"])
    # The middle of the row's place among n_source, from 0 to 1.
    placed = ranked.withColumn("f", (2 * (F.col("start") + F.col("r")) + 1) / (2 * F.col("n_source"))).select("doc_id", "source", "stratum", "h", "size", "text_crc32", "f")
    placed = placed.withColumn("slice", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)))

    # Position overall: (slice of the fraction, part, fraction, source, hash, id).  The part comes from
    # the source's hash, so that slices with the one row each of very many sources are divided too.
    sizes = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n_slice"))
    crowded = sizes.where(F.col("n_slice") > 4 * each).select("slice", F.ceil(F.col("n_slice") / each).alias("parts"))
    placed = placed.join(F.broadcast(crowded), "slice", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.coalesce("parts", F.lit(1))))
    starts = prefix_sum(placed.groupBy("slice", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.col("slice") * F.lit(buckets) + F.col("part")), "key", "n", "first_at").select("slice", "part", "first_at")
    in_part = Window.partitionBy("slice", "part").orderBy("f", "stratum", "h", "doc_id", "text_crc32", "size")
    at = placed.withColumn("r", F.row_number().over(in_part) - 1).join(starts, ["slice", "part"]).withColumn("at", F.col("first_at") + F.col("r"))
    shard = F.expr(f"(at * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return at.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("at") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def digest(placed: DataFrame) -> DataFrame:
    """The report columns: the law that holds here is ``rows``, so there is no grown shard."""
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", "grown_shard", "source")
