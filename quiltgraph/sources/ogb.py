"""Graphs in the folder layout of the open graph benchmarks: headerless CSV, compressed, a node's id being its line number.

raw/edge.csv.gz has source,target lines; raw/node-feat.csv.gz and
raw/node-label.csv.gz a line for each node, in order; split/SCHEME/train.csv.gz,
valid.csv.gz and test.csv.gz a node's id on each line.  Each name may be a file
or a folder of part files, which follow each other by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.operators import etl
from quiltgraph.operators.ranking import prefix_sum
from quiltgraph.schema import GraphBundle, GraphMeta

FILES = {"edges": "raw/edge.csv.gz", "features": "raw/node-feat.csv.gz", "labels": "raw/node-label.csv.gz", "splits": "split/{scheme}/{split}.csv.gz"}
#: The names of splits in files, by ours.
SPLITS = {"train": "train", "val": "valid", "test": "test"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): every line of the text at path with its exact number from 0, over all of its files by name.

    A compressed file can't be split, so one task reads it from start to end:
    there, ids that only rise are without gaps, and those of a file less its first
    are the lines' numbers in it.  The files' first numbers are sums of the counts of the files before.
    An empty line counts.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    files = rows.groupBy("file").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    names = sorted(r["file"] for r in files.select("file").collect())  # as many as the folder has files
    places = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "file string, n bigint")
    starts = prefix_sum(files.join(places, "file"), "n", "lines", "before").select("file", "first", "before")
    return rows.join(starts, "file").select((F.col("id") - F.col("first") + F.col("before")).alias("line"), "value")


def from_ogb(spark: SparkSession, path: str, *, scheme: str = "random", files: dict[str, str] | None = None, directed: bool = False, normalize: bool = False) -> GraphBundle:
    """The graph at path: normalised edges, and nodes (node_id, features, label or labels, split).

    files replaces names of FILES.  Edges are taken in both directions unless
    directed.  A label line with several fields makes labels; an empty or
    unreadable label becomes -1.  A node in no split has none.
    """
    at = {k: f"{path}/{v}" for k, v in (FILES | (files or {})).items()}
    fields = F.split(F.trim("value"), r"\s*,\s*")
    nodes = numbered_lines(spark, at["features"]).select(F.col("line").alias("node_id"), fields.cast("array<float>").alias("features"))
    given = numbered_lines(spark, at["labels"]).select(F.col("line").alias("node_id"), fields.alias("f"))
    multi = (given.agg(F.max(F.size("f"))).first()[0] or 0) > 1
    first = F.get("f", F.lit(0)).try_cast("double")
    label = F.transform("f", lambda x: x.cast("float")).alias("labels") if multi else F.when(F.isnan(first), -1).otherwise(F.coalesce(first.try_cast("bigint"), F.lit(-1))).alias("label")
    nodes = nodes.join(given.select("node_id", label), "node_id")
    own = [spark.read.text(at["splits"].format(scheme=scheme, split=name)).where("trim(value) <> ''").select(F.trim("value").cast("bigint").alias("node_id"), F.lit(split).alias("split")) for split, name in SPLITS.items()]
    nodes = nodes.join(own[0].union(own[1]).union(own[2]), "node_id", "left")
    ends = F.split(F.trim("value"), r"\s*,\s*")
    pairs = spark.read.text(at["edges"]).where("trim(value) <> ''").select(ends[0].cast("bigint").alias("src"), ends[1].cast("bigint").alias("dst"))
    edges = etl.sym_norm(pairs.distinct(), nodes) if directed else etl.prepare(pairs, nodes)
    count = nodes.count()
    return GraphBundle(edges, etl.l2_normalize(nodes) if normalize else nodes, GraphMeta(count, count), etl.label_kind(nodes)[1], multi)


def _write(lines: DataFrame, path: str, order: str | None = None) -> None:
    """Gzip text of the column value, by ranges of order, so that files follow each other by name as rows do."""
    placed = lines.repartitionByRange(order).sortWithinPartitions(order) if order else lines
    placed.select("value").write.option("compression", "gzip").text(path)


def write_ogb(pairs: DataFrame, nodes: DataFrame, path: str, *, scheme: str = "random") -> None:
    """The layout, from pairs (src, dst) and nodes (node_id, features, label, split) whose ids are 0, 1, ... without gaps."""
    _write(pairs.select(F.concat_ws(",", "src", "dst").alias("value")), f"{path}/{FILES['edges']}")
    _write(nodes.select("node_id", F.concat_ws(",", F.col("features").cast("array<string>")).alias("value")), f"{path}/{FILES['features']}", "node_id")
    _write(nodes.select("node_id", F.col("label").cast("string").alias("value")), f"{path}/{FILES['labels']}", "node_id")
    for split, name in SPLITS.items():
        _write(nodes.where(F.col("split") == split).select(F.col("node_id").cast("string").alias("value")), f"{path}/{FILES['splits'].format(scheme=scheme, split=name)}")
