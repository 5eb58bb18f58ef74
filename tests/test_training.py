"""Gradients of every model option by differences, batches of each mode, and a run from a config."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph import phases, train
from quiltgraph.operators import epochs, linalg, model, partition
from quiltgraph.schema import GraphBundle, GraphMeta
from quiltgraph.sources import graphs, io
from quiltgraph.storage import shared_dir

N = 24


@pytest.fixture(scope="module")
def bundle(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)], i % 2, [float(i % 2), float(i % 3 == 0)], ("train", "train", "val", "test")[i % 4]) for i in range(N)]
    nodes = spark.createDataFrame(rows, "node_id bigint, features array<float>, label bigint, labels array<float>, split string").coalesce(1).cache()
    pairs = spark.createDataFrame([(i, (i * 5 + 1) % N) for i in range(N)] + [(i, (i + 1) % N) for i in range(N)], "src bigint, dst bigint")
    edges = graphs.prepare(pairs, nodes.select("node_id")).coalesce(1).cache()
    return GraphBundle(edges, nodes, GraphMeta(N, N, 4, 4), 2, False)


def dense(bundle):
    a = np.zeros((N, N))
    for e in bundle.edges.collect():
        a[e["src"], e["dst"]] = e["weight"]
    rows = bundle.nodes.orderBy("node_id").collect()
    return a, np.array([r["features"] for r in rows], dtype=float), rows


def plain_loss(net, a, x, rows, multi, epoch):
    """The whole model on matrices."""
    ids = np.arange(len(x))
    for i, (wn, ws) in enumerate(net.layers):
        y = a @ x @ wn + x @ ws
        if i < len(net.layers) - 1:
            if net.residual:
                y = y + (x @ net.projections[i] if i in net.projections else x)
            y = model.ACTIVATIONS[net.activation](y)
            if net.layer_norm:
                y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + 1e-5) * net.norms[i][0] + net.norms[i][1]
            if net.dropout:
                y = y * (model.uniform(ids, y.shape[1], epoch, i) >= net.dropout) / (1 - net.dropout)
        x = y
    own = [i for i, r in enumerate(rows) if r["split"] == "train"]
    if multi:
        t = np.array([rows[i]["labels"] for i in own])
        return np.mean(np.logaddexp(0, x[own]) - x[own] * t)
    return np.mean([np.log(np.exp(x[i]).sum()) - x[i][rows[i]["label"]] for i in own])


@pytest.mark.parametrize("activation,multi", [("gelu", False), ("elu", True)])
def test_gradients_of_all_options(bundle, activation, multi):
    net = model.GraphModel.init([3, 4, 4, 2], seed=3, activation=activation, layer_norm=True, residual=True, dropout=0.3)
    rng = np.random.default_rng(5)
    net.norms = {i: (1 + rng.normal(size=4) / 4, rng.normal(size=4) / 4) for i in range(2)}
    a, x, rows = dense(bundle)
    own = bundle.nodes.where("split = 'train'").drop("label" if multi else "labels")
    loss, _, n, grads = model.loss_and_gradients(net, bundle.edges, bundle.nodes, own, epoch=2)
    assert n == (24 if multi else 12)
    assert loss == pytest.approx(plain_loss(net, a, x, rows, multi, 2), abs=1e-6)
    weights = net.weights()
    assert [[g.shape for g in layer] for layer in grads] == [[w.shape for w in layer] for layer in weights]
    for layer, found in zip(weights, grads, strict=True):
        for w, g in zip(layer, found, strict=True):
            for at in np.ndindex(w.shape):
                kept, eps = w[at], 1e-4
                w[at] = kept + eps
                up = plain_loss(net, a, x, rows, multi, 2)
                w[at] = kept - eps
                down = plain_loss(net, a, x, rows, multi, 2)
                w[at] = kept
                assert g[at] == pytest.approx((up - down) / (2 * eps), abs=2e-5)


def test_norms_and_erf(spark, tmp_path):
    import math

    x = np.linspace(-6, 6, 200)
    assert np.allclose(model.normal_cdf(x), [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x], atol=2e-7)
    net = model.GraphModel.init([3, 4, 2], layer_norm=True)
    net.norms[0] = (np.arange(4.0), np.ones(4))
    model.save_weights(net, spark, str(tmp_path / "w"))
    again = model.load_weights(spark, str(tmp_path / "w"))[0]
    assert np.array_equal(again.norms[0], net.norms[0])


def test_node_batches_cover_the_training_nodes(bundle):
    net = model.GraphModel.init([3, 4, 2], seed=3)
    seen, losses = [], []
    for edges, nodes, own in epochs.node_batches(bundle, [N, N], 5)(1):
        assert len(edges) == 2
        seen += [r["node_id"] for r in own.collect()]
        losses.append(model.loss_and_gradients(net, edges, nodes, own)[0] * own.count())
    assert sorted(seen) == [i for i in range(N) if i % 4 < 2]
    # budgets of all columns sample nothing away: the batches' losses are the whole graph's
    whole = model.loss_and_gradients(net, bundle.edges, bundle.nodes, bundle.nodes.where("split = 'train'").drop("labels"))[0]
    assert sum(losses) / len(seen) == pytest.approx(whole)


def test_part_batches_cut_edges_between_batches(bundle):
    parts = bundle.nodes.select("node_id", F.expr("cast(node_id div 6 as int)").alias("part_id"))
    found = [(sorted(r["node_id"] for r in nodes.collect()), {(e["src"], e["dst"]) for e in edges.collect()}, {r["node_id"] for r in own.collect()}) for edges, nodes, own in epochs.part_batches(bundle, parts, 2)(1)]
    assert sorted(found)[0][0] == list(range(12)) and len(found) == 2
    every = {(e["src"], e["dst"]) for e in bundle.edges.collect()}
    for nodes, edges, own in found:
        assert edges == {(s, d) for s, d in every if s in nodes and d in nodes}
        assert own == {i for i in nodes if i % 4 < 2}


def test_halo_batches_and_accuracy(spark, bundle):
    book = spark.createDataFrame([(w // 2, w) for w in range(N // 4)], "part_id int, window_id bigint")
    a, x, rows = dense(bundle)
    net = model.GraphModel.init([3, 2], seed=3)
    loss = seen = 0
    for edges, nodes, own in epochs.halo_batches(bundle, book, 1, 1)(1):
        part, _, n, _ = model.loss_and_gradients(net, edges, nodes, own)
        loss, seen = loss + part * n, seen + n
    assert seen == 12
    assert loss / seen == pytest.approx(plain_loss(net, a, x, rows, False, 0), abs=1e-6)  # one layer sees its whole halo
    logits = a @ x @ net.layers[0][0] + x @ net.layers[0][1]
    right = [logits[i].argmax() == r["label"] for i, r in enumerate(rows) if r["split"] == "val"]
    assert epochs.halo_accuracy(bundle, book, 2)(net) == pytest.approx(np.mean(right))


@pytest.mark.parametrize("kind,multi", [("halo", False), ("halo", True), ("node", False)])
def test_runs_in_tasks_equal_steps_of_jobs(spark, bundle, monkeypatch, kind, multi):
    monkeypatch.setattr(epochs, "RUN_ROWS", 60)  # more than one run
    graph = GraphBundle(bundle.edges, bundle.nodes.drop("label" if multi else "labels"), bundle.meta, 2, multi)
    book = spark.createDataFrame([(w, w) for w in range(N // 4)], "part_id int, window_id bigint")
    got = {}
    for in_tasks in (False, True):
        net = model.GraphModel.init([3, 4, 4, 2], seed=3, activation="gelu", layer_norm=True, residual=True, dropout=0.3)
        net.norms = {i: (np.linspace(0.5, 1.5, 4), np.linspace(-0.2, 0.2, 4)) for i in range(2)}
        if kind == "halo":
            batches, known = epochs.halo_batches(graph, book, 3, 2, max_external_ratio=1.0, in_tasks=in_tasks), {"accuracy": epochs.halo_accuracy(graph, book, 2, max_external_ratio=1.0, in_tasks=in_tasks)}
        else:
            batches, known = epochs.node_batches(graph, [3, 3, 3], 5, in_tasks=in_tasks), {"weighted": False}
        if in_tasks:
            assert len(list(batches(9))) > 1
        got[in_tasks] = model.train(graph, net, batches, epochs=1, adam=model.Adam(0.05), **known), net.weights()
    (was, before), (now, after) = got[False], got[True]
    assert [(r["train_acc"], r["val_acc"]) for r in now] == [(r["train_acc"], r["val_acc"]) for r in was]
    assert [r["loss"] for r in now] == pytest.approx([r["loss"] for r in was])
    assert all(np.allclose(a, b) for x, y in zip(before, after, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("mode", ["full", "node", "BAPS", "DPS"])
def test_run(spark, bundle, tmp_path, mode):
    path = str(tmp_path / "data")
    bundle.nodes.drop("label" if mode == "full" else "labels").write.parquet(f"{path}/nodes")
    bundle.edges.select("src", "dst").write.parquet(f"{path}/edges")
    config = {"source": "tables", "path": path, "train_mode": mode, "epochs": 1, "hidden_size": 4, "fanouts": [8, 8], "num_partitions": 2, "batch_partition_size": 1, "residual": True, "dropout": 0.1, "output": str(tmp_path / "out"), "cache": str(tmp_path / "cache")}
    found = train.run(spark, config)
    assert 0 <= found["test_acc"] <= 1 and found["best_epoch"] == 1
    assert spark.read.parquet(f"{found['folder']}/log").count() == 1
    net, meta = model.load_weights(spark, found["folder"])
    assert meta["epoch"] == 1 and [w[0].shape for w in net.layers] == [(3, 4), (4, 2)]
    costs = {r["stage"]: r for r in spark.read.parquet(f"{found['folder']}/timers").collect()}
    assert set(costs) >= {"data", "model", "train", "test", "batch", "gradients", "layer", "spmm", "step", "evaluate"}
    assert ("sample" in costs) == (mode == "node")
    assert costs["spmm"]["jobs"] >= costs["spmm"]["runs"] >= 2 and costs["spmm"]["task_seconds"] > 0 and costs["spmm"]["rows_written"] > 0
    assert costs["step"]["jobs"] == 0
    again = train.dataset(spark, config)
    assert again.multi_label == (mode == "full")
    assert io.summary(again)["nodes"] == N


def test_training_leaves_no_tables(spark, bundle):
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    net = model.GraphModel.init([3, 4, 4, 2], seed=3, layer_norm=True, residual=True, dropout=0.3)
    batches = epochs.full_batches(bundle)
    before = {n for n in os.listdir(folder) if os.listdir(f"{folder}/{n}")}
    assert len(model.train(bundle, net, batches, epochs=2)) == 2
    assert {n for n in os.listdir(folder) if os.listdir(f"{folder}/{n}")} <= before


def test_phases_count_their_own_jobs(spark):
    found = phases.Phases()
    with phases.phase(spark, "unseen"):
        spark.range(10).count()
    with found.active():
        with phases.phase(spark, "outer"):
            spark.range(0, 1000, 1, 4).repartition(3).count()
            with phases.phase(spark, "inner"):
                spark.range(5).collect()
            spark.range(7).collect()
        with phases.phase(spark, "inner"), pytest.raises(ZeroDivisionError):
            1 / 0
    costs = {r["stage"]: r for r in found.table(spark).collect()}
    assert set(costs) == {"outer", "inner"}
    assert (costs["inner"]["runs"], costs["inner"]["jobs"]) == (2, 1)
    assert costs["outer"]["jobs"] >= 2 and costs["outer"]["shuffle_bytes"] > 0
    assert spark.sparkContext.getLocalProperty(phases.GROUP) is None


def test_unknown_mode(bundle):
    with pytest.raises(ValueError, match="unknown mode"):
        train.batches_for(bundle, {"train_mode": "other"}, 2)
    assert partition.resolve_mode("full") == "rcm"


def test_sparse_products_make_no_array_for_an_edge(spark, bundle):
    plan = linalg.spmm_arrays(bundle.edges, bundle.nodes, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan
    a, x, _ = dense(bundle)
    found = {r["node_id"]: r["features"] for r in linalg.spmm_arrays(bundle.edges, bundle.nodes, 3).collect()}
    assert np.allclose([found[i] for i in range(N)], a @ x)


def test_edges_of_task_batches_have_empty_arrays(spark, bundle):
    nodes = model.targets(bundle).select(F.lit(0).alias("batch_id"), "node_id", "features", "label", F.lit(True).alias("target"))
    rows = epochs._rows(nodes, bundle.edges.select(F.lit(0).alias("batch_id"), "src", "dst", "weight", F.lit(1).alias("layers")))
    assert rows.where("features is null").count() == 0 < rows.where("layers = 1 and size(features) = 0").count()
