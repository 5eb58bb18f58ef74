"""Registered queries of the graph operators on the star schema, with DuckDB SQL beside them.

Floating sums are rounded to six digits, as engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph import train
from quiltgraph.functions import metrics
from quiltgraph.functions.formula import formula_weights
from quiltgraph.operators import blocking, cut, epochs, etl, linalg, model, partition, sampling
from quiltgraph.operators.ranking import hash_text
from quiltgraph.schema import GraphBundle, GraphMeta, HacsOptions
from quiltgraph.sources import graphs, ogb, raw
from quiltgraph.storage import materialize, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

K, SPLIT_SEED, SHUFFLE_SEED = 32, 7, 7
HIDDEN, CLASSES, DIM = 16, 10, 64

NORM = """
deg AS MATERIALIZED (SELECT dst AS node_id, count(*) AS deg FROM e GROUP BY 1),
edges AS MATERIALIZED (SELECT src, dst, CAST((1 / sqrt(a.deg::DOUBLE)) * (1 / sqrt(b.deg::DOUBLE)) AS FLOAT) AS weight
          FROM e JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst)"""
G1 = f"""
cnt AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM part) AS np),
base AS (SELECT DISTINCT o_custkey AS u, nc + l_partkey AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey, cnt),
nodes AS MATERIALIZED (SELECT c_custkey AS node_id FROM customer UNION ALL SELECT nc + p_partkey FROM part, cnt),
e AS (SELECT u AS src, v AS dst FROM base WHERE u <> v UNION SELECT v, u FROM base WHERE u <> v UNION SELECT node_id, node_id FROM nodes),{NORM}"""
G2 = f"""
cnt AS (SELECT count(*) AS n FROM embeddings),
base AS (SELECT DISTINCT o_custkey % n AS u, l_partkey % n AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey, cnt),
nodes AS (SELECT vec_id AS node_id, label FROM embeddings),
e AS (SELECT u AS src, v AS dst FROM base WHERE u <> v UNION SELECT v, u FROM base WHERE u <> v UNION SELECT node_id, node_id FROM nodes),{NORM},
x AS (SELECT vec_id AS node_id, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS value FROM embeddings)"""
WINCOLS = """
wc AS (SELECT window_id, col, row_number() OVER (PARTITION BY window_id ORDER BY col) - 1 AS pos FROM (SELECT DISTINCT src // 16 AS window_id, dst AS col FROM edges)),
wins AS (SELECT window_id, count(*) AS n_cols, (count(*) + 7) // 8 AS n_tiles FROM wc GROUP BY 1),
offs AS (SELECT *, (sum(n_tiles) OVER (ORDER BY window_id) - n_tiles)::BIGINT AS tile_start FROM wins)"""
SCORE = "(sum(CAST(trunc((CAST(1.0 AS FLOAT) + CAST(10.0 AS FLOAT) * abs(weight)) * CAST(1000.0 AS FLOAT)) AS INT)) + (16 - count(*)) * 1000)::BIGINT"


#: The training split: 60 % of all nodes in seeded order; the others are evaluated.
TRAIN = f"""
ranked AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY md5(node_id::VARCHAR || '_{SPLIT_SEED}'), node_id) - 1 AS r FROM nodes),
train AS (SELECT node_id FROM ranked WHERE r < floor(0.6 * (SELECT count(*) FROM nodes))),
held AS (SELECT node_id FROM ranked WHERE r >= floor(0.6 * (SELECT count(*) FROM nodes)))"""


def _train(nodes: DataFrame) -> DataFrame:
    return _split(nodes).where("split = 'train'").select("node_id")


def _split(nodes: DataFrame) -> DataFrame:
    own = nodes.select("node_id")
    return etl.random_split(own, own.count(), SPLIT_SEED)


def _edge_bound(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> int:
    """At most so many edges has a graph of order lines, by its tables' footers."""
    return 2 * graphs.read(spark, sf_dir, "lineitem").count() + nodes.count()


def _windows(spark: SparkSession, sf_dir: str, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return blocking.windows(blocking.window_cols(edges, rows=_edge_bound(spark, sf_dir, nodes)), -(-nodes.count() // 16))


def topk_sql(edges: str, k: int) -> str:
    return f"""SELECT window_id, col, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, col) AS rank FROM (
    SELECT src // 16 AS window_id, dst AS col, {SCORE} AS score FROM {edges} GROUP BY 1, 2)) WHERE rank <= {k}"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {G1} SELECT * FROM edges")
def etl_norm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.customer_part(spark, sf_dir)[0]


@query(f"WITH {G1}, t AS ({topk_sql('edges', K)}) SELECT window_id, col, score, rank::INT AS rank FROM t")
def topk_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 best columns of every window of the customer-part graph."""
    return sampling.topk(sampling.score_columns(graphs.customer_part(spark, sf_dir)[0]), K)


@query(f"WITH {G1} SELECT * FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.in_degree(*graphs.customer_part(spark, sf_dir))


@query(f"WITH {G1} SELECT node_id AS row, n, (sum(n) OVER (ORDER BY node_id) - n)::BIGINT AS row_start FROM (SELECT src AS node_id, count(*) AS n FROM edges GROUP BY 1)")
def csr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.customer_part(spark, sf_dir)
    return blocking.row_counts(edges, nodes.count())


@query(f"WITH {G1}, {WINCOLS} SELECT window_id, col, pos, pos // 8 AS tile_in_window, pos % 8 AS col_in_tile FROM wc")
def window_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.customer_part(spark, sf_dir)
    return blocking.window_cols(edges, rows=_edge_bound(spark, sf_dir, nodes))


@query(f"WITH {G1}, {WINCOLS} SELECT window_id, n_cols, n_tiles, tile_start FROM offs")
def window_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.customer_part(spark, sf_dir)
    return _windows(spark, sf_dir, edges, nodes)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.customer_part(spark, sf_dir)
    edges = materialize(edges, "edges")
    return blocking.block_tiles(edges, -(-nodes.count() // 16), edges.count())


def _cells(tiles: DataFrame) -> DataFrame:
    """(window_id, tile_id, slot, col, weight) of tiles."""
    cells = tiles.select("window_id", "tile_id", "cols", F.posexplode("vals").alias("slot", "weight")).where("weight <> 0")
    return cells.select("window_id", "tile_id", "slot", F.col("cols")[F.col("slot") % 8].cast("bigint").alias("col"), "weight")


@query(f"WITH {G1}, {WINCOLS} SELECT e.src // 16 AS window_id, tile_start + pos // 8 AS tile_id, ((e.src % 16) * 8 + pos % 8)::INT AS slot, col, weight FROM edges e JOIN wc ON wc.window_id = e.src // 16 AND col = dst JOIN offs ON offs.window_id = wc.window_id")
def tiles_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every tile with its slot and column."""
    return _cells(_tiles(spark, sf_dir))


@query(f"WITH {G1} SELECT * FROM edges")
def tiles_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.tiles_to_edges(_tiles(spark, sf_dir))


@query(f"WITH {G1}, {TRAIN} SELECT node_id // 16 AS window_id, bit_or((1 << (node_id % 16))::INT) AS mask FROM train GROUP BY 1")
def frontier_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and row masks of the training split as seeds."""
    return sampling.active_windows(_train(graphs.customer_part(spark, sf_dir)[1]))


SEEDS = f"{TRAIN}, seeds AS MATERIALIZED (SELECT DISTINCT node_id // 16 AS window_id FROM train)"
HOP1 = f"h1 AS MATERIALIZED ({topk_sql('(SELECT * FROM edges WHERE src // 16 IN (SELECT window_id FROM seeds)) q', 8)})"
HOP2 = f"w2 AS (SELECT DISTINCT col // 16 AS window_id FROM h1), h2 AS MATERIALIZED ({topk_sql('(SELECT * FROM edges WHERE src // 16 IN (SELECT window_id FROM w2)) q', 16)})"


def _layers(spark: SparkSession, sf_dir: str):
    edges, nodes = graphs.customer_part(spark, sf_dir)
    # The edges are read twice in each hop.
    return sampling.sample_layers(materialize(edges, "edges"), _train(nodes), (16, 8))


@query(f"WITH {G1}, {SEEDS}, {HOP1} SELECT src // 16 AS window_id, src, dst, weight FROM edges JOIN h1 ON window_id = src // 16 AND col = dst")
def sample_hop1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the output layer: 8 columns for each window of the training split."""
    return _layers(spark, sf_dir)[1].edges


@query(f"WITH {G1}, {SEEDS}, {HOP1}, {HOP2} SELECT src // 16 AS window_id, src, dst, weight FROM edges JOIN h2 ON window_id = src // 16 AND col = dst")
def sample_hop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the input layer: 16 columns for each window that hop 1 reached."""
    return _layers(spark, sf_dir)[0].edges


#: A layer of 20 columns for each training window, of which the last tile is half empty.
HOP20 = f"""h AS MATERIALIZED ({topk_sql('(SELECT * FROM edges WHERE src // 16 IN (SELECT window_id FROM seeds)) q', 20)}),
placed AS (SELECT window_id, col, row_number() OVER (PARTITION BY window_id ORDER BY col) - 1 AS pos FROM h),
counted AS (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS idx, coalesce(n_cols, 0) AS n_cols, (coalesce(n_cols, 0) + 7) // 8 AS n_tiles FROM seeds LEFT JOIN (SELECT window_id, count(*) AS n_cols FROM h GROUP BY 1) USING (window_id)),
offsets AS (SELECT *, (sum(n_tiles) OVER (ORDER BY idx))::BIGINT AS tile_end FROM counted)"""


def _layer20(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges, nodes = graphs.customer_part(spark, sf_dir)
    edges = materialize(edges, "edges")
    layer = sampling.sample_layers(edges, _train(nodes), (20,))[0]
    return edges, layer.extra["sampled"], layer.nodes


@query(f"WITH {G1}, {SEEDS}, {HOP20} SELECT window_id, idx, n_cols, n_tiles, tile_end FROM offsets")
def sampled_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid columns and inclusive tile offsets of a sampled layer's windows."""
    _, sampled, active = _layer20(spark, sf_dir)
    return sampling.sampled_windows(sampled, active).drop("tile_start")


@query(f"WITH {G1}, {SEEDS}, {HOP20} SELECT e.src // 16 AS window_id, tile_end - n_tiles + pos // 8 AS tile_id, ((e.src % 16) * 8 + pos % 8)::INT AS slot, col, weight FROM edges e JOIN placed ON placed.window_id = e.src // 16 AND col = dst JOIN offsets ON offsets.window_id = placed.window_id")
def sampled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the tiles into which a layer's sampled columns are condensed."""
    return _cells(sampling.sampled_tiles(*_layer20(spark, sf_dir)))


@query(f"WITH {G1}, {SEEDS}, {HOP1}, {HOP2}, a AS (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS idx FROM seeds) SELECT src, dst, weight, idx * 16 + dst % 16 AS local_dst FROM edges JOIN h2 ON h2.window_id = src // 16 AND col = dst JOIN a ON a.window_id = dst // 16")
def reindex_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop-2 edges whose column lies in a seed window, with its row there."""
    layers = _layers(spark, sf_dir)
    return sampling.reindex(layers[0].edges, layers[1].nodes).select("src", "dst", "weight", "local_dst")


@query(f"WITH {G1}, {SEEDS}, {HOP1} SELECT col, src % 16 AS row_in_window, window_id, weight FROM edges JOIN h1 ON window_id = src // 16 AND col = dst")
def transposed_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.transposed_coo(_layers(spark, sf_dir)[1].edges)


@query(f"WITH {G1}, {SEEDS}, a AS (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS idx FROM seeds) SELECT node_id, idx * 16 + node_id % 16 AS row FROM nodes JOIN a ON a.window_id = node_id // 16 WHERE node_id IN (SELECT node_id FROM train)")
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _train(graphs.customer_part(spark, sf_dir)[1])
    return sampling.seed_rows(nodes, sampling.active_windows(nodes))


@query(f"WITH {G2} SELECT src AS node_id, f, round(sum(weight * value), 6) AS value FROM edges JOIN x ON node_id = dst GROUP BY 1, 2")
def spmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    return _rounded(linalg.to_long(linalg.spmm_arrays(edges, nodes, DIM, _edge_bound(spark, sf_dir, nodes))))


@query(f"WITH {G2} SELECT dst AS node_id, f, round(sum(weight * value), 6) AS value FROM edges JOIN x ON node_id = src GROUP BY 1, 2")
def spmm_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    return _rounded(linalg.to_long(linalg.spmm_arrays(linalg.transpose(edges), nodes, DIM, _edge_bound(spark, sf_dir, nodes))))


def _rounded(long: DataFrame) -> DataFrame:
    return long.select("node_id", "f", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def weights_sql(rows: int, cols: int) -> str:
    return f"SELECT i.range AS i, j.range AS j, (((i.range * 31 + j.range * 17) % 13) - 6) / 64.0::DOUBLE AS w FROM range({rows}) i, range({cols}) j"


@query(f"WITH {G2}, w AS ({weights_sql(DIM, HIDDEN)}) SELECT node_id, j AS f, round(sum(value * w), 6) + 0.0 AS value FROM x JOIN w ON i = f GROUP BY 1, 2")
def dense_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.embedding_graph(spark, sf_dir)[1]
    return _rounded(linalg.to_long(linalg.project(nodes, formula_weights(DIM, HIDDEN))))


def conv_sql(source: str, wn: str, ws: str) -> str:
    return f"""SELECT node_id, f, sum(value) AS value FROM (
  SELECT src AS node_id, j AS f, sum(weight * value * w) AS value FROM edges JOIN {source} s ON s.node_id = dst JOIN ({wn}) ON i = f GROUP BY 1, 2
  UNION ALL SELECT node_id, j, sum(value * w) FROM {source} JOIN ({ws}) ON i = f GROUP BY 1, 2) GROUP BY 1, 2"""


CONV1 = conv_sql("x", weights_sql(DIM, HIDDEN), weights_sql(DIM, HIDDEN))
CONV2 = conv_sql("r", weights_sql(HIDDEN, CLASSES), weights_sql(HIDDEN, CLASSES))
LOGITS = f"c1 AS ({CONV1}), r AS (SELECT node_id, f, greatest(value, 0) AS value FROM c1), z AS ({CONV2})"


@query(f"WITH {G2}, c1 AS ({CONV1}) SELECT node_id, f, round(value, 6) + 0.0 AS value FROM c1")
def sage_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    w = formula_weights(DIM, HIDDEN)
    return _rounded(linalg.to_long(linalg.sage_conv(edges, nodes, w, w)))


def _embedding(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The embedding graph with its edges written once, for plans that read them several times."""
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    return materialize(edges, "edges"), nodes


def _model() -> model.GraphModel:
    a, b = formula_weights(DIM, HIDDEN), formula_weights(HIDDEN, CLASSES)
    return model.GraphModel([(a, a), (b, b)])


@query(f"WITH {G2}, {LOGITS} SELECT node_id, f, round(value, 6) + 0.0 AS value FROM z")
def inference_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers with relu between, formula weights."""
    return _rounded(linalg.to_long(model.forward(_model(), *_embedding(spark, sf_dir))))


@query(f"""WITH {G2}, c1 AS ({CONV1}),
z1 AS (SELECT node_id, f, sum(value) AS value FROM (SELECT * FROM c1 UNION ALL SELECT node_id, j, sum(value * w) FROM x JOIN ({weights_sql(DIM, HIDDEN)}) ON i = f GROUP BY 1, 2) GROUP BY 1, 2),
a AS (SELECT node_id, f, greatest(value, 0) AS value FROM z1),
r AS (SELECT node_id, f, (value - avg(value) OVER own) / sqrt(var_pop(value) OVER own + 1e-5) AS value FROM a WINDOW own AS (PARTITION BY node_id)),
z AS ({CONV2}) SELECT node_id, f, round(value, 6) + 0.0 AS value FROM z""")
def norm_residual_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layers with a projected residual and a layer norm between them."""
    net = replace(_model(), layer_norm=True, residual=True, projections={0: formula_weights(DIM, HIDDEN)})
    return _rounded(linalg.to_long(model.forward(net, *_embedding(spark, sf_dir))))


@query(f"""WITH {G2}, {LOGITS},
m AS (SELECT node_id, max(value) AS top, arg_max(f, struct_pack(v := round(value, 9), k := -f)) AS best FROM z GROUP BY 1),
l AS (SELECT z.node_id, ln(sum(exp(value - top))) + any_value(top) AS lse FROM z JOIN m USING (node_id) GROUP BY 1)
SELECT round(avg(lse - z.value), 6) AS loss, sum((best = label)::INT)::BIGINT AS correct, count(*) AS total
FROM nodes JOIN l USING (node_id) JOIN m USING (node_id) JOIN z ON z.node_id = nodes.node_id AND z.f = label""")
def ce_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _embedding(spark, sf_dir)
    logits = model.forward(_model(), edges, nodes).select("node_id", F.col("features").alias("logits")).join(nodes.select("node_id", "label"), "node_id")
    return metrics.cross_entropy(logits).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {G2}, {LOGITS}, y AS (SELECT node_id, f, value, ((label + f) % 3 = 0)::INT AS y FROM z JOIN nodes USING (node_id))
SELECT round(avg(greatest(value, 0) - value * y + ln(1 + exp(-abs(value)))), 6) AS loss, sum(((value > 0) = (y = 1))::INT)::BIGINT AS correct, count(*) AS total FROM y""")
def bce_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten labels for each node, by formula."""
    edges, nodes = _embedding(spark, sf_dir)
    labels = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda f: ((F.col("label") + f) % 3 == 0).cast("float"))
    logits = model.forward(_model(), edges, nodes).select("node_id", F.col("features").alias("logits")).join(nodes.select("node_id", labels.alias("labels")), "node_id")
    return metrics.bce_with_logits(logits).withColumn("loss", F.round("loss", 6))


@query(f"""WITH {G2}, c AS ({conv_sql('x', weights_sql(DIM, CLASSES), weights_sql(DIM, CLASSES))}),
p AS (SELECT node_id, f, exp(value - max(value) OVER (PARTITION BY node_id)) AS e FROM c),
g AS MATERIALIZED (SELECT node_id, f, (e / sum(e) OVER (PARTITION BY node_id) - (f = label)::INT) / n AS value FROM p JOIN nodes USING (node_id), cnt),
atg AS MATERIALIZED (SELECT dst AS node_id, f, sum(weight * value) AS value FROM edges JOIN g ON node_id = src GROUP BY 1, 2),
both_ AS (SELECT 'neighbour' AS weights, * FROM atg UNION ALL SELECT 'self', * FROM g)
SELECT weights, x.f AS i, b.f AS j, round(sum(x.value * b.value), 6) + 0.0 AS value FROM both_ b JOIN x USING (node_id) GROUP BY 1, 2, 3""")
def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one layer from formula weights, the gradients of both weight matrices of the mean loss over all nodes."""
    edges, nodes = _embedding(spark, sf_dir)
    w = formula_weights(DIM, CLASSES)
    neighbour, own = model.loss_and_gradients(model.GraphModel([(w, w)]), edges, nodes, nodes)[3][0]
    rows = [(name, i, j, float(v)) for name, grad in (("neighbour", neighbour), ("self", own)) for (i, j), v in np.ndenumerate(grad)]
    found = spark.createDataFrame(rows, "weights string, i bigint, j bigint, value double")
    return found.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(f"WITH {G2}, l AS (SELECT node_id, sqrt(sum(value * value)) AS s FROM x GROUP BY 1) SELECT node_id, f, round((value / greatest(s, 1e-12))::FLOAT::DOUBLE, 6) AS value FROM x JOIN l USING (node_id)")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(linalg.to_long(etl.l2_normalize(graphs.embedding_graph(spark, sf_dir)[1])))


@query(f"WITH {G2}, o AS (SELECT node_id, row_number() OVER (ORDER BY md5(node_id::VARCHAR || '_{SPLIT_SEED}'), node_id) - 1 AS r FROM nodes) SELECT node_id, CASE WHEN r < floor(0.6 * n) THEN 'train' WHEN r < floor(0.6 * n) + floor(0.2 * n) THEN 'val' ELSE 'test' END AS split FROM o, cnt")
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(graphs.embedding_graph(spark, sf_dir)[1])


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id AS node_id, label::BIGINT AS label, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5) AS total FROM embeddings UNION ALL SELECT unnest(range(n, (n + 15) // 16 * 16)), 0, 64, 0.0 FROM n")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows up to a whole number of windows, those that are added being zeros."""
    nodes = graphs.embedding_graph(spark, sf_dir)[1]
    padded = etl.pad_rows(nodes, nodes.count(), DIM)
    total = F.aggregate("features", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return padded.select("node_id", "label", F.size("features").alias("width"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query("SELECT c_custkey AS node_id, CASE WHEN c_nationkey < 12 THEN 'train' WHEN c_nationkey < 18 THEN 'val' WHEN c_acctbal > 0 THEN 'test' END AS split FROM customer")
def masked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split from masks, of which several may hold for a customer, or none."""
    masks = {"train_mask": F.col("c_nationkey") < 12, "val_mask": F.col("c_nationkey") < 18, "test_mask": F.col("c_acctbal") > 0}
    nodes = graphs.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), *[m.alias(name) for name, m in masks.items()])
    return etl.mask_split(nodes).select("node_id", "split")


HACS = """
raw AS (SELECT node_id, sqrt(sum(value * value)) / greatest(ln(any_value(deg)::DOUBLE + 2), 1e-6) AS raw FROM x JOIN deg USING (node_id) GROUP BY 1),
q AS (SELECT node_id, round(least(greatest(raw / ((SELECT avg(raw) FROM raw) + 1e-6), 0.5), 2.0), 5)::FLOAT AS q FROM raw)"""


def _hacs(spark: SparkSession, sf_dir: str):
    edges, nodes = _embedding(spark, sf_dir)
    return edges, nodes, etl.hacs_static(nodes, etl.in_degree(edges, nodes))


@query(f"WITH {G2}, {HACS} SELECT node_id, q FROM q")
def hacs_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hacs(spark, sf_dir)[2]


@query(f"""WITH {G2}, {HACS}, s AS (
  SELECT src // 16 AS window_id, dst AS col, (sum(CAST(trunc((CAST(1.0 AS FLOAT) + CAST(10.0 AS FLOAT) * abs(weight)) * q * CAST(100.0 AS FLOAT)) AS INT)) + (16 - count(*)) * any_value(CAST(trunc(q * CAST(100.0 AS FLOAT)) AS INT)))::BIGINT AS score
  FROM edges JOIN q ON node_id = dst GROUP BY 1, 2)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY window_id ORDER BY score DESC, col))::INT AS rank FROM s) WHERE rank <= {K}""")
def hacs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, q = _hacs(spark, sf_dir)
    return sampling.topk(sampling.score_columns(edges, hacs=HacsOptions(), q=q, rows=edges.count()), K)


LOCAL = HacsOptions(delta=0.5, gamma_bonus=0.25)


@query(f"""WITH {G2}, {HACS}, {TRAIN}, m AS MATERIALIZED (SELECT node_id // 16 AS window_id, bit_or((1 << (node_id % 16))::INT) AS mask FROM train GROUP BY 1),
own AS (SELECT window_id, dst AS col, abs(weight) AS w, q, bit_count(mask) AS rows, CASE WHEN window_id % 3 = dst // 16 % 3 THEN 0.5 ELSE 0 END::FLOAT AS d FROM edges JOIN m ON window_id = src // 16 AND (mask >> (src % 16)::INT) & 1 = 1 JOIN q ON node_id = dst),
s AS (SELECT window_id, col, (sum(CAST(trunc(((CAST(1.0 AS FLOAT) + CAST(10.0 AS FLOAT) * w) * q + d) * CAST(100.0 AS FLOAT)) AS INT)) + (any_value(rows) - count(*)) * max(CAST(trunc((q + d) * CAST(100.0 AS FLOAT)) AS INT)) + 25)::BIGINT AS score FROM own GROUP BY 1, 2)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY window_id ORDER BY score DESC, col))::INT AS rank FROM s WHERE score > 0) WHERE rank <= {K}""")
def hacs_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a bonus for columns of the window's own part, one for each column, and only training rows counted."""
    edges, nodes, q = _hacs(spark, sf_dir)
    parts = nodes.select("node_id", F.expr("cast(node_id div 16 % 3 as int)").alias("part_id"))
    windows = nodes.select(F.expr("node_id div 16").alias("window_id")).distinct().withColumn("part_id", F.expr("cast(window_id % 3 as int)"))
    frontier = sampling.active_windows(_train(nodes))
    return sampling.topk(sampling.score_columns(edges, frontier, hacs=LOCAL, q=q, window_parts=windows, node_parts=parts, mask_rows=True, rows=edges.count()), K)


PARTS = f"""parts AS (SELECT node_id, (node_id * 7 % 3)::INT AS part_id FROM nodes),
sized AS (SELECT part_id, count(*) AS real_count, (count(*) + 15) // 16 * 16 AS padded FROM parts GROUP BY 1),
partitions AS (SELECT part_id, (sum(padded) OVER (ORDER BY part_id) - padded)::BIGINT AS start_idx, (sum(padded) OVER (ORDER BY part_id))::BIGINT AS end_idx, real_count, padded - real_count AS pad_count FROM sized),
mapping AS (SELECT part_id, node_id AS old, start_idx + row_number() OVER (PARTITION BY part_id ORDER BY node_id) - 1 AS new FROM parts JOIN partitions USING (part_id))"""


def _parts(spark: SparkSession, sf_dir: str):
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    return edges, *partition.align_pad(nodes.select("node_id", (F.col("node_id") * 7 % 3).cast("int").alias("part_id")))


@query(f"WITH {G2}, {PARTS} SELECT * FROM mapping")
def align_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[1]


@query(f"WITH {G2}, {PARTS} SELECT * FROM partitions")
def part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2]


@query(f"WITH {G2}, {PARTS}, w AS (SELECT range AS window_id FROM range((SELECT max(end_idx) // 16 + 3 FROM partitions))) SELECT window_id, coalesce(part_id, -1)::INT AS part_id FROM w LEFT JOIN partitions ON window_id * 16 >= start_idx AND window_id * 16 < end_idx")
def window_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each window; three windows beyond the last part have none."""
    partitions = _parts(spark, sf_dir)[2]
    return partition.window_parts(partitions, partitions.agg(F.max("end_idx")).first()[0] // 16 + 3)


@query(f"WITH {G2}, {PARTS}, c AS (SELECT *, (sum(end_idx - start_idx) OVER (ORDER BY part_id) - (end_idx - start_idx))::BIGINT AS local FROM partitions WHERE part_id IN (0, 2)), m AS (SELECT old, new - start_idx + local AS l FROM mapping JOIN c USING (part_id)) SELECT a.l AS src, b.l AS dst, weight FROM edges JOIN m a ON a.old = src JOIN m b ON b.old = dst")
def partition_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts 0 and 2 of the padded graph, in ids of their own."""
    edges, mapping, partitions = _parts(spark, sf_dir)
    return sampling.partition_slice(partition.reorder(edges, mapping), partitions, (0, 2))


RATIO, PART_COUNT = 5.0, 4
HALO = f"""placed AS MATERIALIZED (SELECT node_id, node_id // 16 * {PART_COUNT} // ((SELECT count(*) FROM nodes) + 15 >> 4) AS part FROM nodes),
inside AS (SELECT part, node_id, row_number() OVER (PARTITION BY part ORDER BY node_id) - 1 AS local_id, true AS internal FROM placed),
sizes AS (SELECT part, count(*) AS n FROM placed GROUP BY 1),
outs AS (SELECT DISTINCT a.part, dst AS node_id FROM edges JOIN placed a ON a.node_id = src JOIN placed b ON b.node_id = dst WHERE a.part <> b.part),
kept AS (SELECT part, node_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5(node_id::VARCHAR || '_{SHUFFLE_SEED}'), node_id) AS r FROM outs) JOIN sizes USING (part) WHERE r <= floor({RATIO} * n)),
local AS MATERIALIZED (SELECT * FROM inside UNION ALL SELECT part, node_id, n + row_number() OVER (PARTITION BY part ORDER BY node_id) - 1, false FROM kept JOIN sizes USING (part)),
h AS (SELECT a.part, a.local_id AS src, b.local_id AS dst, weight FROM edges JOIN inside a ON a.node_id = src JOIN local b ON b.node_id = dst AND b.part = a.part)"""


def _by_part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """The edges, (part, window_id) of PART_COUNT ranges that together are the whole graph, and the number of nodes."""
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    count = nodes.count()
    windows = nodes.select(F.expr("node_id div 16").alias("window_id")).distinct()
    return edges, windows.select(F.expr(f"window_id * {PART_COUNT} div {-(-count // 16)}").alias("part"), "window_id"), count


def _halos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges, windows, count = _by_part(spark, sf_dir)
    # What is read twice is written once; the edges are read by that alone.
    own = materialize(sampling.edges_by_part(edges, windows), "part_edges")
    return sampling.halos(own, windows, count, max_external_ratio=RATIO, seed=SHUFFLE_SEED)


@query(f"WITH {G2}, {HALO} SELECT * FROM local")
def halo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four parts, which are the whole graph, with at most five times as many neighbours outside."""
    return _halos(spark, sf_dir)[0]


@query(f"WITH {G2}, {HALO} SELECT * FROM h")
def halo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halos(spark, sf_dir)[1].drop("inner")


@query(f"WITH {G2}, {HALO} SELECT h.* FROM h JOIN sizes USING (part) WHERE dst < n")
def inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halos(spark, sf_dir)[1].where("inner").drop("inner")


@query(f"WITH {G1} SELECT * FROM edges")
def bcsr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked customer-part matrix written as raw arrays and read by byte ranges."""
    edges, nodes = graphs.customer_part(spark, sf_dir)
    count, path = nodes.count(), shared_path(spark, "raw")
    raw.save_graph(materialize(edges, "edges"), GraphMeta(count, count), path)
    return blocking.tiles_to_edges(raw.load_blocked(spark, path)[1])


@query(f"WITH {G1}, {TRAIN}, w AS (SELECT DISTINCT node_id // 16 AS window_id FROM held) SELECT (row_number() OVER (ORDER BY window_id) - 1) // 12 AS part_id, window_id FROM w")
def eval_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all nodes that aren't for training."""
    return partition.eval_book(_split(graphs.customer_part(spark, sf_dir)[1]).where("split <> 'train'"), 12)


@query(f"WITH {G1}, r AS (SELECT node_id, row_number() OVER (ORDER BY md5(node_id::VARCHAR || '_{SHUFFLE_SEED}'), node_id) - 1 AS r FROM nodes), p AS (SELECT node_id, r // 160 AS pool, row_number() OVER (PARTITION BY r // 160 ORDER BY node_id) - 1 AS p FROM r) SELECT pool * 5 + p // 32 AS batch_id, node_id FROM p")
def mega_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.mega_batches(graphs.customer_part(spark, sf_dir)[1], 32, 5, SHUFFLE_SEED)


@query(f"WITH c AS (SELECT n_nationkey::INT AS part_id, (row_number() OVER (ORDER BY n_nationkey) - 1) // 3 AS chunk FROM nation), o AS (SELECT chunk, row_number() OVER (ORDER BY md5(chunk::VARCHAR || '_{SHUFFLE_SEED}'), chunk) - 1 AS batch_id FROM (SELECT DISTINCT chunk FROM c)) SELECT batch_id, part_id FROM c JOIN o USING (chunk)")
def partition_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.partition_batches(graphs.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("part_id")), 3, SHUFFLE_SEED)


@query(f"WITH {G1}, {TRAIN}, {WINCOLS} SELECT count(*) AS n_windows, sum(n_tiles)::BIGINT AS n_tiles, (sum(n_tiles) * 128)::BIGINT AS n_values, (sum(n_tiles) * 8)::BIGINT AS n_cols FROM offs WHERE window_id IN (SELECT node_id // 16 FROM train)")
def window_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.customer_part(spark, sf_dir)
    wins = _windows(spark, sf_dir, edges, nodes)
    return partition.window_loads(wins, _train(nodes).select(F.expr("node_id div 16").alias("window_id")))


@query("WITH g AS (SELECT c_nationkey::BIGINT AS graph_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS local_id, c_custkey FROM customer), s AS (SELECT graph_id, (sum(count(*)) OVER (ORDER BY graph_id) - count(*))::BIGINT AS start FROM g GROUP BY 1) SELECT graph_id, local_id, c_custkey, start + local_id AS node_id, CASE WHEN graph_id < 20 THEN 'train' WHEN graph_id < 22 THEN 'val' ELSE 'test' END AS split FROM g JOIN s USING (graph_id)")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each nation's customers, laid one after the other; split by graph."""
    nodes = graphs.numbered_in_graph(graphs.read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")
    return graphs.split_graphs(graphs.disjoint_union(nodes)[0], 20, 2)


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 1.0::FLOAT AS weight FROM lineitem")
def mtx_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part-supplier matrix, written as Matrix Market text and read again."""
    edges, path = graphs.part_supplier(spark, sf_dir), shared_path(spark, "mtx")
    graphs.write_mtx(edges, path, graphs.read(spark, sf_dir, "part").count(), graphs.read(spark, sf_dir, "supplier").count())
    return graphs.from_mtx(spark, path).select("src", "dst", "weight")


@query(f"WITH {G2}, {TRAIN}, o AS (SELECT node_id, r, (SELECT count(*) FROM nodes) AS c FROM ranked) SELECT vec_id AS node_id, label::BIGINT AS label, CASE WHEN r < floor(0.6 * c) THEN 'train' WHEN r < floor(0.6 * c) + floor(0.2 * c) THEN 'val' ELSE 'test' END AS split, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5) AS total FROM embeddings JOIN o ON node_id = vec_id")
def ogb_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding graph written as headerless gzip CSV, where a node's id is its line number, and read again."""
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    path = shared_path(spark, "ogb")
    ogb.write_ogb(edges.where("src < dst"), nodes.join(_split(nodes), "node_id"), path)
    bundle = graphs.load(spark, {"source": "ogb", "path": path})
    total = F.aggregate("features", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return bundle.nodes.select("node_id", "label", "split", F.size("features").alias("width"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


@query(f"WITH {G2} SELECT * FROM edges")
def ogb_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the same, one direction written and both read."""
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    path = shared_path(spark, "ogb")
    ogb.write_ogb(edges.where("src < dst"), nodes.withColumn("split", F.lit("train")), path)
    return graphs.load(spark, {"source": "ogb", "path": path}).edges


@query("SELECT l_suppkey AS src, l_partkey AS dst, 1.0::FLOAT AS weight FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def block_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a rectangular block whose rows are the targets."""
    return graphs.from_columns(graphs.part_supplier(spark, sf_dir), "dst", "src")


@query(f"WITH {G2}, o AS (SELECT DISTINCT node_id // 16 AS window_id FROM nodes WHERE md5(node_id::VARCHAR || '_q') < '4') SELECT node_id, node_id // 16 IN (SELECT window_id FROM o) AS train_mask, node_id % 3 = 0 AS val_mask FROM nodes")
def split_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.embedding_graph(spark, sf_dir)[1].select("node_id")
    own = nodes.where(hash_text("node_id", "q") < "4").select(F.expr("node_id div 16").alias("w")).distinct()
    train = nodes.join(own, F.expr("node_id div 16") == F.col("w"), "left_semi")
    return partition.split_masks(nodes, {"train": train, "val": nodes.where("node_id % 3 = 0")})


BOOK_LIMIT, BOOK_STEP, BATCH_NODES = 120_000, 10, 256


def _order_sql(table: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY md5(window_id::VARCHAR || '_{SHUFFLE_SEED}'), window_id) AS i FROM {table}"


#: Of each step: the part that is open, where it starts and ends, the next step, and what this step put into which part.
BOOK = f"""o AS MATERIALIZED ({_order_sql('wins')}),
upto AS MATERIALIZED (SELECT 0::BIGINT AS i, 0::BIGINT AS load UNION ALL SELECT i, (sum(n_tiles * 128) OVER (ORDER BY i))::BIGINT FROM o),
size AS (SELECT max(i) AS n FROM upto),
fold AS (
  SELECT 0 AS part, 0::BIGINT AS first, 0::BIGINT AS past, {BOOK_STEP} AS step, -1 AS into_part, 0::BIGINT AS a, 0::BIGINT AS b
  UNION ALL
  SELECT part + shut::INT, CASE WHEN shut THEN upper ELSE first END, upper,
    CASE WHEN shut THEN {BOOK_STEP} WHEN load < {BOOK_LIMIT // 2} THEN least(step * 2, {BOOK_STEP * 4}) WHEN load > {int(0.85 * BOOK_LIMIT)} THEN greatest(step // 2, {max(1, BOOK_STEP // 4)}) ELSE step END, part, past, upper
  FROM (SELECT *, refused OR load >= {BOOK_LIMIT} AS shut, CASE WHEN refused THEN past ELSE wanted END AS upper
    FROM (SELECT fold.*, y.i AS wanted, y.load - x.load AS load, past > first AND y.load - x.load > {BOOK_LIMIT} AS refused
      FROM fold, size JOIN upto x ON x.i = first JOIN upto y ON y.i = least(past + step, n) WHERE past < n)))"""


@query(f"WITH RECURSIVE {G1}, {WINCOLS}, {BOOK} SELECT into_part AS part_id, window_id FROM fold JOIN o ON o.i > a AND o.i <= b")
def dps_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows packed by tiles: an ordered fold."""
    edges, nodes = graphs.customer_part(spark, sf_dir)
    wins = _windows(spark, sf_dir, edges, nodes)
    return partition.dps_book(wins, wins, limit=BOOK_LIMIT, base_step=BOOK_STEP, seed=SHUFFLE_SEED)


@query(f"""WITH RECURSIVE {G1}, {TRAIN}, held_windows AS (SELECT node_id // 16 AS window_id, count(*) AS n FROM train GROUP BY 1),
o AS MATERIALIZED ({_order_sql('held_windows')}),
fold AS (SELECT i, 0 AS batch_id, n AS filled FROM o WHERE i = 1
  UNION ALL SELECT o.i, batch_id + (filled >= {BATCH_NODES})::INT, CASE WHEN filled >= {BATCH_NODES} THEN n ELSE filled + n END FROM fold JOIN o ON o.i = fold.i + 1)
SELECT batch_id, window_id FROM fold JOIN o USING (i)""")
def window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.window_batches(_train(graphs.customer_part(spark, sf_dir)[1]), BATCH_NODES, seed=SHUFFLE_SEED)


REACHED = f"""placed AS MATERIALIZED (SELECT node_id, node_id // 16 * {PART_COUNT} // ((SELECT count(*) FROM nodes) + 15 >> 4) AS part FROM nodes),
own AS (SELECT DISTINCT part, node_id // 16 AS window_id FROM placed),
best AS MATERIALIZED ({topk_sql('edges', 5)}),
reached AS MATERIALIZED (SELECT part, window_id FROM own UNION SELECT part, col // 16 FROM own JOIN best USING (window_id)),
inside AS MATERIALIZED (SELECT part, node_id, row_number() OVER (PARTITION BY part ORDER BY node_id) - 1 AS local_id, true AS internal FROM reached JOIN nodes ON node_id // 16 = window_id),
sizes AS (SELECT part, count(*) AS n FROM inside GROUP BY 1),
outs AS (SELECT part, dst AS node_id FROM edges JOIN reached ON window_id = src // 16 EXCEPT SELECT part, node_id FROM inside),
kept AS (SELECT part, node_id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5(node_id::VARCHAR || '_{SHUFFLE_SEED}'), node_id) AS r FROM outs) JOIN sizes USING (part) WHERE r <= floor({RATIO} * n))"""


@query(f"WITH {G2}, {REACHED} SELECT part, node_id, local_id, internal FROM inside UNION ALL SELECT part, node_id, n + row_number() OVER (PARTITION BY part ORDER BY node_id) - 1, false FROM kept JOIN sizes USING (part)")
def dps_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each of four parts, which are the whole graph, what its probe reaches, repacked."""
    edges, windows, count = _by_part(spark, sf_dir)
    edges = materialize(edges, "edges")
    return sampling.dps_online(edges, windows, count, rows=edges.count())[0]


#: A step of walk keeps the level before it as well (age 1): the neighbours of a level lie in these two or in the next.
RCM = """p AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst),
degrees AS (SELECT node_id, count(src) AS deg FROM nodes LEFT JOIN p ON src = node_id GROUP BY 1),
reach AS (SELECT node_id, node_id AS component FROM nodes UNION SELECT dst, component FROM reach JOIN p ON src = node_id WHERE dst > component),
info AS MATERIALIZED (SELECT node_id, deg, min(component) AS component FROM reach JOIN degrees USING (node_id) GROUP BY 1, 2),
walk AS (
  SELECT arg_min(node_id, struct_pack(d := deg, i := node_id)) AS node_id, 0 AS level, 0::BIGINT AS place, 0 AS age FROM info GROUP BY component
  UNION ALL
  (WITH found AS (SELECT dst AS node_id, max(level) + 1 AS level, min(place) AS parent FROM walk JOIN p ON src = walk.node_id WHERE age = 0 AND dst NOT IN (SELECT node_id FROM walk) GROUP BY 1)
   SELECT node_id, level, row_number() OVER (ORDER BY parent, deg, node_id) - 1, 0 FROM found JOIN info USING (node_id)
   UNION ALL SELECT node_id, level, place, 1 FROM walk WHERE age = 0))"""


@query(f"WITH RECURSIVE {G2}, {RCM} SELECT node_id AS old, (SELECT count(*) FROM nodes) - row_number() OVER (ORDER BY component, level, place) AS new FROM walk JOIN info USING (node_id) WHERE age = 0")
def rcm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = graphs.embedding_graph(spark, sf_dir)
    return partition.rcm_order(edges, nodes)


@query()
def kway_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of the customer-part graph with few edges between them."""
    edges, nodes = graphs.customer_part(spark, sf_dir)
    return cut.kway_parts(edges, nodes, PART_COUNT, seed=SHUFFLE_SEED)


@query()
def train_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two full-graph epochs from formula weights: (epoch, loss, train_acc, val_acc)."""
    bundle = graphs.load(spark, {"source": "embedding", "path": sf_dir})
    # Every product of every step reads the edges.
    bundle = replace(bundle, edges=materialize(bundle.edges, "edges"), nodes=materialize(bundle.nodes, "nodes"))
    own = bundle.nodes.where("split = 'train'")
    log = model.train(bundle, _model(), lambda epoch: iter([(bundle.edges, bundle.nodes, own)]), epochs=2, adam=model.Adam(0.01))
    return spark.createDataFrame([(r["epoch"], round(r["loss"], 6), r["train_acc"], r["val_acc"]) for r in log], "epoch int, loss double, train_acc double, val_acc double")


def _one_epoch(spark: SparkSession, sf_dir: str, make: Callable) -> DataFrame:
    """(epoch, loss, train_acc, val_acc) of one epoch from formula weights over the batches that make gives for the bundle."""
    bundle = graphs.load(spark, {"source": "embedding", "path": sf_dir})
    bundle = replace(bundle, edges=materialize(bundle.edges, "edges"), nodes=materialize(bundle.nodes, "nodes"))
    batches, known = make(bundle)
    log = model.train(bundle, _model(), batches, epochs=1, adam=model.Adam(0.01), **known)
    return spark.createDataFrame([(r["epoch"], round(r["loss"], 6), r["train_acc"], r["val_acc"]) for r in log], "epoch int, loss double, train_acc double, val_acc double")


@query()
def train_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled layers of 10 and 10 columns for each window, batches of 1024 training nodes."""
    return _one_epoch(spark, sf_dir, lambda b: (epochs.node_batches(b, [10, 10], 1024, seed=SHUFFLE_SEED, in_tasks=True), {"weighted": False}))


@query()
def train_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ranges of the nodes, two of them in each batch."""

    def make(b: GraphBundle) -> tuple[model.Batches, dict]:
        order = b.nodes.select(F.col("node_id").alias("old"), F.col("node_id").alias("new"))
        return epochs.part_batches(b, partition.range_parts(order, b.meta.num_rows, 4), 2, seed=SHUFFLE_SEED), {}

    return _one_epoch(spark, sf_dir, make)


@query()
def train_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows packed by tiles, two packs and their halo in each batch; accuracy over cuts of the validation's windows."""
    config = {"train_mode": "DPS", "seed": SHUFFLE_SEED, "in_tasks": True, "batch_partition_size": 2, "DPS": {"max_partition_edges": BOOK_LIMIT, "probe_step_size": BOOK_STEP, "max_external_ratio": RATIO}}
    return _one_epoch(spark, sf_dir, lambda b: train.batches_for(b, config, 2))
