"""Long jobs that stop after a step and go on in another session."""

import os

import numpy as np
import pytest

from quiltgraph import storage
from quiltgraph.operators import epochs, model, partition
from quiltgraph.schema import GraphBundle, GraphMeta
from quiltgraph.sources import graphs


class Stopped(Exception):
    pass


def resumed(monkeypatch, spark, folder, job, after):
    """job(log) stopped at the commit of a version, then done in a new session: its result, and the versions of both runs."""
    commit = storage.StateLog.commit

    def stop(self, **values):
        commit(self, **values)
        if self.version == after:
            raise Stopped

    with monkeypatch.context() as m:
        m.setattr(storage.StateLog, "commit", stop)
        with pytest.raises(Stopped):
            job(storage.StateLog(spark, folder))
    log = storage.StateLog(spark.newSession(), folder)
    assert log.version == after
    return job(log), log.version - after


def test_versions_and_tables(spark, tmp_path):
    log = storage.StateLog(spark, f"file://{tmp_path}/state")
    one = log.keep("a", spark.range(3))
    log.commit(step=1, of="x")
    log.keep("a", one.union(one))
    log.keep("b", spark.range(0))
    assert storage.StateLog(spark, log.folder).get("a").count() == 3  # what isn't committed isn't there
    log.commit(step=2)
    again = storage.StateLog(spark, log.folder)
    assert (again.version, again.values, again.get("a").count(), again.get("b").count()) == (2, {"step": 2, "of": "x"}, 6, 0)
    again.drop("b")
    again.commit()
    names = [n for n in os.listdir(f"{tmp_path}/state") if not n.startswith(".")]
    assert len(names) == 2 and "manifest-000000003.json" in names  # the manifest and the table a
    with pytest.raises(Exception):
        log.commit()  # another run has gone on
    again.remove()
    assert not os.path.exists(f"{tmp_path}/state")


def test_order_goes_on_from_its_last_level(spark, tmp_path, monkeypatch):
    path = [(i * 7 % 11, (i + 1) * 7 % 11) for i in range(10)]
    edges, nodes = spark.createDataFrame(path, "src bigint, dst bigint"), spark.range(11).withColumnRenamed("id", "node_id")
    order = lambda log=None: {r["old"]: r["new"] for r in partition.rcm_order(edges, nodes, log=log).collect()}
    got, left = resumed(monkeypatch, spark, f"file://{tmp_path}/rcm", order, 7)
    assert got == order() and left == 5  # a start, ten further levels and the end, of which seven were done


def test_book_goes_on_from_its_last_round(spark, tmp_path, monkeypatch):
    wins = spark.createDataFrame([(i, i % 5 + 1) for i in range(60)], "window_id bigint, n_tiles bigint")
    book = lambda log=None: sorted(map(tuple, partition.dps_book(wins, wins, limit=1000, base_step=2, log=log).collect()))
    got, left = resumed(monkeypatch, spark, f"file://{tmp_path}/book", book, 4)
    assert got == book() and 0 < left < 6


def test_training_goes_on_from_its_last_epoch(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)], i % 2, ("train", "val")[i % 3 == 0]) for i in range(12)]
    nodes = spark.createDataFrame(rows, "node_id bigint, features array<float>, label bigint, split string").coalesce(1).cache()
    edges = graphs.prepare(spark.createDataFrame([(i, (i * 5 + 1) % 12) for i in range(12)], "src bigint, dst bigint"), nodes.select("node_id")).coalesce(1).cache()
    bundle = GraphBundle(edges, nodes, GraphMeta(12, 12, 4, 4), 2, False)

    def trained(log=None):
        net = model.GraphModel.init([3, 4, 2], seed=3, dropout=0.2, layer_norm=True)
        rows = model.train(bundle, net, epochs.full_batches(bundle), epochs=3, adam=model.Adam(0.05), state=log)
        return rows, net.weights()

    (got, weights), left = resumed(monkeypatch, spark, f"file://{tmp_path}/train", trained, 2)
    want, plain = trained()
    assert left == 1 and [r["epoch"] for r in got] == [1, 2, 3]
    assert [r["loss"] for r in got] == pytest.approx([r["loss"] for r in want])
    assert all(np.allclose(a, b) for x, y in zip(weights, plain, strict=True) for a, b in zip(x, y, strict=True))
