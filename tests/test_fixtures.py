"""Operators on the five-node fixture and other hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.functions import metrics
from quiltgraph.functions.formula import formula_weights
from quiltgraph.operators import blocking, etl, linalg, model, partition, sampling
from quiltgraph.operators.ranking import number_by_id, prefix_sum
from quiltgraph.schema import GraphMeta, HacsOptions
from quiltgraph.sources import graphs, io

F5 = [(0, 1, 1.0), (0, 3, 2.0), (1, 1, 3.0), (1, 4, 4.0), (2, 0, 5.0), (4, 2, 6.0), (4, 3, 7.0), (4, 4, 8.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(F5, "src bigint, dst bigint, weight float").cache()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.fixture(scope="module")
def blocked(edges):
    cols = blocking.window_cols(edges, 2, 2)
    wins = blocking.windows(cols, 3, 2)
    return cols, wins, blocking.tiles(edges, cols, wins, 2, 2)


def test_tiles_and_back(edges, blocked):
    cols, wins, tiled = blocked
    assert [r[0] for r in rows(wins, "tile_start")] + [wins.agg(F.sum("n_tiles")).first()[0]] == [0, 2, 3, 5]
    got = {r["tile_id"]: (r["cols"], r["vals"]) for r in tiled.collect()}
    assert [got[i][0] for i in range(5)] == [[1, 3], [4, -1], [0, -1], [2, 3], [4, -1]]
    assert [got[i][1] for i in range(5)] == [[1, 2, 3, 0], [0, 0, 4, 0], [5, 0, 0, 0], [6, 7, 0, 0], [8, 0, 0, 0]]
    assert rows(blocking.tiles_to_edges(tiled, 2, 2)) == F5
    assert rows(blocking.row_counts(edges, 5), "row", "n", "row_start") == [(0, 2, 0), (1, 2, 2), (2, 1, 4), (3, 0, 5), (4, 3, 5)]


def test_products(spark, edges):
    x = spark.createDataFrame([(i, 0, 10.0**i) for i in range(5)], "node_id bigint, f bigint, value double")
    assert rows(linalg.spmm(edges, x), "node_id", "value") == [(0, 2010.0), (1, 40030.0), (2, 5.0), (4, 87600.0)]
    ones = x.withColumn("value", F.lit(1.0))
    assert [v for _, v in rows(linalg.spmm_t(edges, ones), "node_id", "value")] == [5, 4, 6, 9, 12]


def test_scores_and_best_columns(edges):
    scores = sampling.score_columns(edges, tile_rows=2)
    by = {}
    for w, c, s in rows(scores, "window_id", "col", "score"):
        by.setdefault(w, {})[c] = s
    assert by == {0: {1: 42000, 3: 22000, 4: 42000}, 1: {0: 52000}, 2: {2: 62000, 3: 72000, 4: 82000}}
    best = {}
    for w, c in rows(sampling.topk(scores, 2), "window_id", "col"):
        best.setdefault(w, []).append(c)
    assert best == {0: [1, 4], 1: [0], 2: [3, 4]}


def test_masked_and_hacs_scores(spark, edges):
    frontier = sampling.active_windows(spark.createDataFrame([(0,)], "node_id bigint"), tile_rows=2)
    assert rows(sampling.score_columns(edges, frontier, tile_rows=2, mask_rows=True), "col", "score") == [(1, 11000), (3, 21000)]
    q = spark.createDataFrame([(i, 0.5 if i else 2.0) for i in range(5)], "node_id bigint, q float")
    got = sampling.score_columns(edges, tile_rows=2, hacs=HacsOptions(gamma_bonus=1.0), q=q)
    assert {(w, c): s for w, c, s in rows(got, "window_id", "col", "score")}[0, 1] == int(11 * 0.5 * 100) + int(31 * 0.5 * 100) + 100


def test_frontier_and_layers(spark, edges):
    ids = spark.createDataFrame([(1,), (4,), (4,), (-1,), (None,)], "node_id bigint")
    assert rows(sampling.active_windows(ids, tile_rows=2)) == [(0, 2), (2, 1)]
    layers = sampling.sample_layers(edges, spark.createDataFrame([(0,)], "node_id bigint"), (2, 2), tile_rows=2)
    assert [r[0] for r in rows(layers[0].nodes, "window_id")] == [0, 2]
    assert {r[0] for r in rows(layers[1].extra["sampled"], "col")} == {1, 4}
    with_self = sampling.sample_layers(edges, spark.createDataFrame([(2,)], "node_id bigint"), (2, 2), tile_rows=2, include_self=True)
    assert [r[0] for r in rows(with_self[0].nodes, "window_id")] == [0, 1]


def test_reindex_and_prune(spark):
    sampled = spark.createDataFrame([(0, 1, 1.0), (0, 4, 4.0)], "src bigint, dst bigint, weight float")
    active = lambda *w: spark.createDataFrame([(x,) for x in w], "window_id bigint")
    assert rows(sampling.reindex(sampled, active(0, 2), 2), "dst", "local_dst") == [(1, 1), (4, 2)]
    assert rows(sampling.reindex(sampled, active(2), 2), "dst", "local_dst") == [(4, 0)]


def test_halo_and_inner(spark, edges):
    wins = spark.createDataFrame([(0,), (0,)], "window_id bigint")
    sub = sampling.halo(edges, wins, 5, tile_rows=2)
    assert rows(sub.nodes, "local_id", "node_id", "internal") == [(0, 0, True), (1, 1, True), (2, 3, False), (3, 4, False)]
    assert rows(sub.edges) == [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 3.0), (1, 3, 4.0)]
    assert rows(sampling.inner(sub)) == [(0, 1, 1.0), (1, 1, 3.0)]
    assert sampling.halo(edges, wins, 5, max_external_ratio=0.5, tile_rows=2).nodes.where("not internal").count() == 1


def test_partitions(spark):
    parts = spark.createDataFrame([(i, 0 if i < 17 else 1) for i in range(33)], "node_id bigint, part_id int")
    mapping, partitions = partition.align_pad(parts)
    assert rows(partitions, "part_id", "start_idx", "end_idx", "pad_count") == [(0, 0, 32, 15), (1, 32, 48, 0)]
    assert dict(rows(mapping, "old", "new"))[17] == 32
    assert partition.pad_nodes(partitions, 2).count() == 15
    two = spark.createDataFrame([(0, 0, 4), (1, 4, 6)], "part_id int, start_idx bigint, end_idx bigint")
    assert [p for _, p in rows(partition.window_parts(two, 4, 2))] == [0, 0, 1, -1]
    ids = spark.createDataFrame([(w * 16,) for w in (0, 2, 5, 7)], "node_id bigint")
    assert rows(partition.eval_book(ids, 2)) == [(0, 0), (0, 2), (1, 5), (1, 7)]
    chunks = {}
    for b, p in rows(partition.partition_batches(spark.range(5).withColumnRenamed("id", "part_id"), 2)):
        chunks.setdefault(b, []).append(p)
    assert sorted(chunks.values()) == [[0, 1], [2, 3], [4]]


def test_books_cover_each_window_once(spark):
    wins = spark.range(40).select(F.col("id").alias("window_id"), (F.col("id") % 4 + 1).alias("n_tiles"))
    book = rows(partition.dps_book(wins, wins, limit=1500, base_step=2), "window_id")
    assert book == [(i,) for i in range(40)]
    nodes = spark.range(40 * 16).withColumnRenamed("id", "node_id")
    batches = rows(partition.window_batches(nodes, 50))
    assert sorted(w for _, w in batches) == list(range(40))
    sizes = np.bincount([b for b, _ in batches])
    assert set(sizes[:-1]) <= {1, 2, 3, 4}


def test_rcm_is_a_permutation_that_narrows_the_band(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(40)
    pairs = [(int(names[i]), int(names[i + 1])) for i in range(29)] + [(int(names[i]), int(names[i + 1])) for i in range(31, 38)]
    edges = etl.symmetrize(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    order = partition.rcm_order(edges, spark.range(40).withColumnRenamed("id", "node_id"))
    new = dict(rows(order, "old", "new"))
    assert sorted(new.values()) == list(range(40))
    assert max(abs(new[a] - new[b]) for a, b in pairs) <= 2
    assert rows(partition.range_parts(order, 40, 4).groupBy("part_id").count(), "count") == [(10,)] * 4
    assert partition.reorder(edges, order).count() == edges.count()


def test_losses(spark):
    one = spark.createDataFrame([([2.0, 1.0], 0), ([0.0, 3.0], 0)], "logits array<double>, label bigint")
    assert metrics.cross_entropy(one).first()[0] == pytest.approx(1.680925, abs=1e-6)
    assert metrics.cross_entropy(one).first()[1:] == (1, 2)
    two = spark.createDataFrame([([1.0, -1.0], [1.0, 1.0])], "logits array<double>, labels array<float>")
    assert metrics.bce_with_logits(two).first()[0] == pytest.approx(0.813262, abs=1e-6)
    assert metrics.bce_with_logits(two).first()[1:] == (1, 2)


def test_features(spark):
    nodes = spark.createDataFrame([(0, [3.0, 4.0], 1), (1, [0.0, 0.0], 0), (2, [float("nan"), 0.0], 2)], "node_id bigint, features array<float>, label bigint")
    assert dict(rows(etl.l2_normalize(nodes.where("node_id < 2")), "node_id", "features")) == {0: pytest.approx([0.6, 0.8]), 1: [0.0, 0.0]}
    assert rows(etl.bad_features(nodes), "node_id") == [(2,)]
    deg = spark.createDataFrame([(0, 2)], "node_id bigint, deg bigint")
    assert etl.hacs_static(nodes.where("node_id = 0"), deg).first()["q"] == pytest.approx(1.0)
    assert etl.pad_rows(nodes, 3, 2).count() == 16
    assert etl.label_kind(nodes) == (False, 3)
    masks = spark.createDataFrame([(0, True, False, False), (1, False, False, True), (2, False, False, False)], "node_id bigint, train_mask boolean, val_mask boolean, test_mask boolean")
    assert [r["split"] for r in etl.mask_split(masks).orderBy("node_id").collect()] == ["train", "test", None]


def test_edge_policies(spark):
    twice = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "src bigint, dst bigint, weight float")
    assert rows(etl.dedupe(twice, "max")) == [(0, 1, 2.0)] and rows(etl.dedupe(twice, "sum")) == [(0, 1, 3.0)]
    with pytest.raises(Exception, match="repeated edge"):
        etl.dedupe(twice, "error").collect()


def test_numbering_across_groups(spark):
    df = spark.range(20_000).select((F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("v"))
    sums = dict(rows(prefix_sum(df, "k", "v", "s"), "k", "s"))
    plain = np.concatenate([[0], np.cumsum(np.arange(20_000) % 5)])
    assert all(sums[3 * i] == plain[i] for i in range(20_000))
    assert rows(number_by_id(df, "k", "n", each=100), "n") == [(i,) for i in range(20_000)]


def test_gradients_by_differences(spark):
    pairs = spark.createDataFrame([(i, (i * 3 + 1) % 8) for i in range(8)], "src bigint, dst bigint")
    rng = np.random.default_rng(1)
    nodes = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)], i % 2) for i in range(8)], "node_id bigint, features array<float>, label bigint").cache()
    edges = graphs.prepare(pairs, nodes).cache()
    net = model.GraphModel.init([3, 4, 2], seed=3)
    own = nodes.where("node_id < 6")
    _, _, n, grads = model.loss_and_gradients(net, edges, nodes, own)
    assert n == 6

    def loss():
        logits = model.forward(net, edges, nodes).select("node_id", F.col("features").alias("logits")).join(own, "node_id")
        return metrics.cross_entropy(logits).first()["loss"]

    for layer, which, at in ((0, 0, (1, 2)), (0, 1, (0, 1)), (1, 0, (3, 1)), (1, 1, (2, 0))):
        w, eps = net.layers[layer][which], 1e-4
        w[at] += eps
        up = loss()
        w[at] -= 2 * eps
        down = loss()
        w[at] += eps
        assert grads[layer][which][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_model_options_and_checkpoint(spark, edges, tmp_path):
    nodes = spark.createDataFrame([(i, [float(i), 1.0, -1.0]) for i in range(5)], "node_id bigint, features array<float>")
    net = model.GraphModel.init([3, 4, 4, 2], seed=1, activation="elu", layer_norm=True, residual=True)
    out = dict(rows(model.forward(net, edges, nodes), "node_id", "features"))
    a = np.zeros((5, 5))
    for s, d, w in F5:
        a[s, d] = w
    h = np.array([[i, 1.0, -1.0] for i in range(5)])
    for i, (wn, ws) in enumerate(net.layers):
        y = a @ h @ wn + h @ ws
        if i < 2:
            y = y + (h @ net.projections[i] if i in net.projections else h)
            y = model.layer_norm(model.ACTIVATIONS["elu"](y))
        h = y
    assert all(np.allclose(out[i], h[i]) for i in range(5))
    model.save_weights(net, spark, str(tmp_path / "w"), epoch=3)
    again, meta = model.load_weights(spark, str(tmp_path / "w"))
    assert meta == {"epoch": 3}
    assert rows(model.forward(again, edges, nodes)) == rows(model.forward(net, edges, nodes))


def test_dropout_does_not_depend_on_batches():
    ids = np.arange(4000)
    whole = model.uniform(ids, 8, 3, 1)
    assert np.array_equal(whole[100:], model.uniform(ids[100:], 8, 3, 1))
    assert abs((whole < 0.3).mean() - 0.3) < 0.02
    assert not np.array_equal(whole, model.uniform(ids, 8, 4, 1))


def test_adam_and_plateau():
    net = model.GraphModel([(np.ones((1, 1)), np.ones((1, 1)))])
    adam = model.Adam(0.1)
    adam.step(net, [(np.full((1, 1), 30.0), np.full((1, 1), 40.0))])
    assert np.allclose(net.layers[0], 0.9, atol=1e-6)
    plateau = model.Plateau(patience=1)
    for acc in (0.5, 0.4, 0.4):
        plateau.step(acc, adam)
    assert adam.rate == 0.05


def test_storage(spark, edges, tmp_path, tiny):
    io.save_tiles(edges, GraphMeta(5, 5, 2, 2), str(tmp_path / "t"))
    assert rows(blocking.tiles_to_edges(io.load_tiles(spark, str(tmp_path / "t"))[1], 2, 2)) == F5
    bundle = graphs.load(spark, {"source": "embedding", "path": tiny})
    io.save_bundle(bundle, str(tmp_path / "b"))
    again = io.load_bundle(spark, str(tmp_path / "b"))
    assert io.summary(again) == io.summary(bundle) and again.meta == bundle.meta
    assert io.summary(bundle)["edges"] == 10478 and bundle.num_classes == 10
    (tmp_path / "c.yaml").write_text("source: tables\npath: " + str(tmp_path / "b") + "\ndirected: true\n")
    config = io.load_config(spark, str(tmp_path / "c.yaml"))
    assert graphs.load(spark, config).edges.count() == 10478
    assert io.dataset_key(config) == io.dataset_key(config | {"epochs": 3}) != io.dataset_key(config | {"seed": 1})
    with pytest.raises(ValueError, match="unknown source"):
        graphs.load(spark, {"source": "none"})
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 3 3\n1 2 0.5\n1 2 7\n3 1 1\n")
    assert rows(graphs.from_mtx(spark, str(tmp_path / "m.mtx"), undirected=True)) == [(0, 1, 2.0), (0, 2, 1.0), (1, 0, 2.0), (2, 0, 1.0)]


def test_formula_weights():
    assert formula_weights(2, 2).tolist() == [[-6 / 64, -2 / 64], [-1 / 64, 3 / 64]]
