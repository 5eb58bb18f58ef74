"""Graph sources: tables, Matrix Market text, tile arrays, and graphs over the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltgraph.operators import etl
from quiltgraph.operators.etl import prepare
from quiltgraph.operators.blocking import tiles_to_edges
from quiltgraph.operators.ranking import dealt, prefix_sum
from quiltgraph.schema import GraphBundle, GraphMeta
from quiltgraph.sources import ogb


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(o_custkey, l_partkey) of every order line, and a bound on their number from the table's footers."""
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.count()
    return dealt(orders, rows, "o_orderkey").join(dealt(lines, rows, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey"), rows


def customer_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """G1, (edges, nodes): customers and, from the customer count on, parts; joined by what was ordered."""
    customers, parts = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    n = customers.count()
    ordered, rows = _ordered(spark, sf_dir)
    pairs = ordered.select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + n).alias("dst"))
    nodes = customers.select(F.col("c_custkey").alias("node_id")).union(parts.select(F.col("p_partkey") + n))
    return prepare(pairs, nodes, rows), nodes


def embedding_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """G2, (edges, nodes): embeddings as features and labels; edges from order lines, modulo their number."""
    nodes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("features"), F.col("label").cast("bigint").alias("label"))
    n = nodes.count()
    ordered, rows = _ordered(spark, sf_dir)
    return prepare(ordered.select((F.col("o_custkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst")), nodes, rows), nodes


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, rectangular: (src part, dst supplier, weight 1)."""
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return pairs.withColumn("weight", F.lit(1.0).cast("float"))


def from_columns(df: DataFrame, src: str, dst: str, weight: str | None = None) -> DataFrame:
    """Edges (src, dst, weight) from any pair table; weight 1 if there is none.  Swap the names for blocks whose rows are targets."""
    return df.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"), (F.col(weight) if weight else F.lit(1.0)).cast("float").alias("weight"))


def disjoint_union(nodes: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Many graphs as one: (graph_id, local_id, node_id), and edges (graph_id, src, dst) in the new ids.

    A graph's ids follow those of all graphs with smaller graph_id.
    """
    sizes = prefix_sum(nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("c")), "graph_id", "c", "start").select("graph_id", "start")
    joined = nodes.join(sizes, "graph_id").withColumn("node_id", F.col("start") + F.col("local_id")).drop("start")
    if edges is None:
        return joined, None
    return joined, edges.join(sizes, "graph_id").select((F.col("src") + F.col("start")).alias("src"), (F.col("dst") + F.col("start")).alias("dst"))


def split_graphs(nodes: DataFrame, train: int, val: int) -> DataFrame:
    """split by graph number: the first ``train`` graphs, then ``val``, then test."""
    return nodes.withColumn("split", F.when(F.col("graph_id") < train, "train").when(F.col("graph_id") < train + val, "val").otherwise("test"))


def numbered_in_graph(df: DataFrame, graph: str, key: str) -> DataFrame:
    """(graph_id, local_id, key): each graph's nodes numbered from 0 by key."""
    place = F.row_number().over(Window.partitionBy(graph).orderBy(key)) - 1
    return df.select(F.col(graph).cast("bigint").alias("graph_id"), place.cast("bigint").alias("local_id"), F.col(key))


def from_mtx(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """(src, dst, weight) of Matrix Market coordinate text: 1-based, weight = how often a pair stands there.

    The size line is the first after the comments, by file, block and line.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("at"))
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.agg(F.min("at")).first()[0]
    parts = F.split(F.trim("value"), r"\s+")
    rest = body if size is None else body.where((F.col("at.file_path") != size["file_path"]) | (F.col("at.file_block_start") != size["file_block_start"]) | (F.col("at.line") != size["line"]))
    pairs = rest.select((parts[0].cast("bigint") - 1).alias("src"), (parts[1].cast("bigint") - 1).alias("dst"))
    if undirected:
        pairs = pairs.union(pairs.where("src <> dst").select("dst", "src"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("float").alias("weight"))


def write_mtx(edges: DataFrame, path: str, rows: int, cols: int) -> None:
    """Matrix Market text in one folder: the header's file sorts first."""
    spark, n = edges.sparkSession, edges.count()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate pattern general",), (f"{rows} {cols} {n}",)], "value string").coalesce(1)
    head.write.text(f"{path}/part=0")
    edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("value")).write.text(f"{path}/part=1")


def from_tiles(tiled: DataFrame, tile_rows: int = 16, tile_cols: int = 8) -> DataFrame:
    return tiles_to_edges(tiled, tile_rows, tile_cols)


def _star(build: Callable) -> Callable[[SparkSession, dict], GraphBundle]:
    def load(spark: SparkSession, config: dict) -> GraphBundle:
        edges, nodes = build(spark, config["path"])
        n = nodes.count()
        if "label" in nodes.columns:
            nodes = etl.random_split(etl.l2_normalize(nodes) if config.get("normalize", True) else nodes, n, config.get("seed", 7))
            return GraphBundle(edges, nodes, GraphMeta(n, n), etl.label_kind(nodes)[1])
        return GraphBundle(edges, nodes, GraphMeta(n, n))

    return load


def _tables(spark: SparkSession, config: dict) -> GraphBundle:
    """path/edges and path/nodes as Parquet, with masks or a split; directed graphs stay directed.

    config["keys"] says what our columns are called there, such as {"features": "feat", "labels": "y", "src": "from"}.
    """
    names = {theirs: ours for ours, theirs in (config.get("keys") or {}).items()}
    nodes = spark.read.parquet(f"{config['path']}/nodes").withColumnsRenamed(names)
    edges = spark.read.parquet(f"{config['path']}/edges").withColumnsRenamed(names)
    n = nodes.count()
    nodes = etl.mask_split(nodes) if "train_mask" in nodes.columns else nodes if "split" in nodes.columns else etl.random_split(nodes, n, config.get("seed", 7))
    edges = etl.sym_norm(edges, nodes) if config.get("directed") else prepare(edges, nodes, edges.count())
    multi, classes = etl.label_kind(nodes)
    return GraphBundle(edges, nodes, GraphMeta(n, n), classes, multi)


def _ogb(spark: SparkSession, config: dict) -> GraphBundle:
    return ogb.from_ogb(spark, config["path"], **{k: config[k] for k in ("scheme", "files", "directed", "normalize") if k in config})


ADAPTERS: dict[str, Callable[[SparkSession, dict], GraphBundle]] = {"customer_part": _star(customer_part), "embedding": _star(embedding_graph), "tables": _tables, "ogb": _ogb}


def load(spark: SparkSession, config: dict) -> GraphBundle:
    """The graph that config["source"] names."""
    try:
        adapter = ADAPTERS[config["source"]]
    except KeyError:
        raise ValueError(f"unknown source {config.get('source')!r}: one of {', '.join(ADAPTERS)}") from None
    return adapter(spark, config)
