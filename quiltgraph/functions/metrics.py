"""Losses and accuracies of logit tables, on built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_entropy(logits: DataFrame) -> DataFrame:
    """One row (loss, correct, total) from (logits array, label): mean cross-entropy, argmax hits (ties: the first)."""
    top = F.array_max("logits")
    lse = top + F.log(F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("logits"))))
    one = logits.select((lse - F.col("logits")[F.col("label").cast("int")]).alias("ce"), (F.array_position("logits", top) - 1 == F.col("label")).cast("bigint").alias("ok"))
    return one.agg(F.avg("ce").alias("loss"), F.sum("ok").alias("correct"), F.count(F.lit(1)).alias("total"))


def bce_with_logits(logits: DataFrame) -> DataFrame:
    """One row (loss, correct, total) from (logits array, labels array): means and counts over elements, threshold 0."""
    each = F.zip_with("logits", "labels", lambda x, y: F.greatest(x, F.lit(0.0)) - x * y.cast("double") + F.log(1 + F.exp(-F.abs(x))))
    right = F.zip_with("logits", "labels", lambda x, y: ((x > 0) == (y > 0.5)).cast("bigint"))
    one = logits.select(F.aggregate(each, F.lit(0.0), lambda s, v: s + v).alias("l"), F.aggregate(right, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("c"), F.size("logits").cast("bigint").alias("t"))
    return one.agg((F.sum("l") / F.sum("t")).alias("loss"), F.sum("c").alias("correct"), F.sum("t").alias("total"))
