"""Graph ETL: from raw pairs to a normalised matrix, and node features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.operators.ranking import dealt, shuffled
from quiltgraph.schema import TILE_ROWS


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def dedupe(edges: DataFrame, policy: str = "max") -> DataFrame:
    """One edge for each (src, dst): its largest weight, the sum, or an error if there are several."""
    if "weight" not in edges.columns:
        return edges.dropDuplicates(["src", "dst"])
    if policy == "error":
        found = edges.groupBy("src", "dst").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        return found.select("src", "dst", F.when(F.col("n") == 1, F.col("weight")).otherwise(F.raise_error(F.lit("repeated edge"))).alias("weight"))
    return edges.groupBy("src", "dst").agg({"max": F.max, "sum": F.sum}[policy]("weight").cast("float").alias("weight"))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A loop for every node of the node table, isolated ones too."""
    return edges.select("src", "dst").union(nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))).distinct()


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, deg): edges that end there, 1 at least."""
    count = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("node_id").join(count, "node_id", "left").select("node_id", F.greatest(F.coalesce("deg", F.lit(0)), F.lit(1)).cast("bigint").alias("deg"))


def sym_norm(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """weight = deg(src)^-1/2 * deg(dst)^-1/2 by in-degrees, as FLOAT."""
    deg = in_degree(edges, nodes).withColumn("w", 1 / F.sqrt(F.col("deg").cast("double")))
    left = deg.select(F.col("node_id").alias("src"), F.col("w").alias("ws"))
    right = deg.select(F.col("node_id").alias("dst"), F.col("w").alias("wd"))
    return edges.select("src", "dst").join(left, "src").join(right, "dst").select("src", "dst", (F.col("ws") * F.col("wd")).cast("float").alias("weight"))


def prepare(pairs: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """The standard ETL: both directions, no repeats, a loop for each node, degree-normalised.

    rows: a bound on the pairs' number, by which tasks are dealt (see
    ranking.dealt).  Loops of nodes differ from all edges that have lost
    theirs, so one distinct is enough.  The graph is symmetric, so a node has
    as many edges on one side as on the other: the edges are shuffled once by
    either end, and degrees are counted where they lie.  A node of the table
    has its loop there; edges of ids that have none drop out.
    """
    count = None if rows is None else 2 * rows + nodes.count()
    loops = nodes.select("node_id").distinct().select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    ends = [F.struct(F.col(a).cast("bigint").alias("src"), F.col(b).cast("bigint").alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
    both = drop_self_loops(pairs).select(F.inline(F.array(*ends))).union(loops)  # a union of both ways would run the pairs' plan twice
    at_dst = dealt(both, count, "dst").distinct().select("src", "dst", *_degree("dst", "d"))
    at_src = dealt(at_dst.select("src", "dst", F.when(F.col("known_d"), F.col("wd")).alias("wd")), count, "src").select("src", "dst", "wd", *_degree("src", "s"))
    return at_src.where("known_s and wd is not null").select("src", "dst", (F.col("ws") * F.col("wd")).cast("float").alias("weight"))


def _degree(end: str, name: str) -> list[Column]:
    """w: degree^-1/2 of the node at an end of each edge; known: whether it has a loop."""
    own = Window.partitionBy(end)
    return [(1 / F.sqrt(F.count(F.lit(1)).over(own).cast("double"))).alias(f"w{name}"), F.max(F.col("src") == F.col("dst")).over(own).alias(f"known_{name}")]


def norm(features: str | Column) -> Column:
    column = F.col(features) if isinstance(features, str) else features
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(nodes: DataFrame) -> DataFrame:
    """features divided by their length, which counts as 1e-12 at least."""
    scale = F.array(F.greatest(norm("features"), F.lit(1e-12)))  # as a variable of transform it is computed once, and not for each entry
    return nodes.withColumn("features", F.transform(scale, lambda s: F.transform("features", lambda x: (x.cast("double") / s).cast("float")))[0])


def pad_rows(nodes: DataFrame, n: int, width: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(node_id, features, label): rows of zeros up to a multiple of tile_rows; labels of padding are 0."""
    end = -(-n // tile_rows) * tile_rows
    pad = nodes.sparkSession.range(n, end).select(F.col("id").alias("node_id"), F.array_repeat(F.lit(0.0).cast("float"), width).alias("features"), F.lit(0).cast("bigint").alias("label"))
    return nodes.select("node_id", "features", "label").unionByName(pad)


def mask_split(nodes: DataFrame) -> DataFrame:
    """split from boolean columns train_mask, val_mask, test_mask; the first that holds, else null."""
    name = F.coalesce(*[F.when(F.col(f"{s}_mask"), F.lit(s)) for s in ("train", "val", "test")])
    return nodes.withColumn("split", name)


def random_split(nodes: DataFrame, n: int, seed: object = 7, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Adds split: the seeded shuffle cut after int(train * n) and int(val * n) more."""
    a, b = int(train * n), int(train * n) + int(val * n)
    return shuffled(nodes, "node_id", seed, "_n").withColumn("split", F.when(F.col("_n") < a, "train").when(F.col("_n") < b, "val").otherwise("test")).drop("_n")


def label_kind(nodes: DataFrame) -> tuple[bool, int]:
    """(multi-label, number of classes): arrays are multi-label if they have more than one entry; else the largest label plus one."""
    if dict(nodes.dtypes).get("labels", "").startswith("array"):
        width = nodes.agg(F.max(F.size("labels"))).first()[0] or 0
        return (True, width) if width > 1 else (False, int((nodes.agg(F.max(F.col("labels")[0])).first()[0] or 0) + 1))
    return False, int((nodes.agg(F.max("label")).first()[0] or 0) + 1)


def bad_features(nodes: DataFrame) -> DataFrame:
    """Nodes with a feature that is NaN or infinite."""
    return nodes.where(F.exists("features", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))


def hacs_static(nodes: DataFrame, deg: DataFrame, q_min: float = 0.5, q_max: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """(node_id, q): feature length over ln(degree + 2), relative to its mean, within [q_min, q_max].

    Rounded to five digits so that engines agree, then FLOAT.
    """
    raw = nodes.join(deg, "node_id").select("node_id", (norm("features") / F.greatest(F.log(F.col("deg").cast("double") + 2), F.lit(1e-6))).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("node_id", F.round(F.least(F.greatest(F.col("raw") / F.lit(mean + eps), F.lit(q_min)), F.lit(q_max)), 5).cast("float").alias("q"))
