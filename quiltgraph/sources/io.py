"""Sinks and sources of results: blocked graphs, datasets by parameters, configs and metrics."""

from __future__ import annotations

import hashlib
import json

import yaml
from pyspark.sql import DataFrame, SparkSession

from quiltgraph.operators import blocking
from quiltgraph.schema import GraphBundle, GraphMeta


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML file from any store that Spark reads."""
    return yaml.safe_load("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())) or {}


def dataset_key(config: dict) -> str:
    """A folder name from the parameters that decide a dataset's contents."""
    own = {k: v for k, v in sorted(config.items()) if k not in ("epochs", "output")}
    return f"{config.get('source', 'graph')}-{hashlib.md5(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()[:12]}"


def save_bundle(bundle: GraphBundle, path: str) -> None:
    bundle.edges.write.mode("overwrite").parquet(f"{path}/edges")
    bundle.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    m = bundle.meta
    row = (m.num_rows, m.num_cols, m.tile_rows, m.tile_cols, bundle.num_classes, bundle.multi_label)
    bundle.edges.sparkSession.createDataFrame([row], "num_rows long, num_cols long, tile_rows int, tile_cols int, num_classes int, multi_label boolean").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> GraphBundle:
    m = spark.read.json(f"{path}/meta").first()
    return GraphBundle(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"), GraphMeta(m["num_rows"], m["num_cols"], m["tile_rows"], m["tile_cols"]), m["num_classes"], m["multi_label"])


def save_tiles(edges: DataFrame, meta: GraphMeta, path: str) -> None:
    """The blocked form: windows and tiles, each a table."""
    cols = blocking.window_cols(edges, meta.tile_rows, meta.tile_cols)
    wins = blocking.windows(cols, meta.num_windows, meta.tile_cols)
    wins.write.mode("overwrite").parquet(f"{path}/windows")
    blocking.tiles(edges, cols, wins, meta.tile_rows, meta.tile_cols).write.mode("overwrite").parquet(f"{path}/tiles")


def load_tiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/tiles")


def estimated_bytes(n_tiles: int, n_windows: int, tile_rows: int = 16, tile_cols: int = 8) -> int:
    """Bytes of the blocked form: 64-bit offsets, 32-bit columns and values."""
    return 8 * (n_windows + 1) + n_tiles * tile_cols * 4 * (1 + tile_rows)


def save_results(spark: SparkSession, path: str, **results) -> None:
    spark.createDataFrame([(json.dumps(results),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_log(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Epoch rows as a metrics table."""
    spark.createDataFrame([(r["epoch"], float(r["loss"]), float(r["train_acc"]), None if r["val_acc"] is None else float(r["val_acc"])) for r in rows], "epoch int, loss double, train_acc double, val_acc double").coalesce(1).write.mode("append").parquet(path)


def summary(bundle: GraphBundle) -> dict:
    """Counts of a dataset."""
    by_split = {r["split"]: r["count"] for r in bundle.nodes.groupBy("split").count().collect()} if "split" in bundle.nodes.columns else {}
    return {"nodes": bundle.meta.num_rows, "edges": bundle.edges.count(), "windows": bundle.meta.num_windows, "classes": bundle.num_classes, "multi_label": bundle.multi_label, "split": by_split}
