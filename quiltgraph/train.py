"""A run from a config: dataset, model, training, test, and what is kept of it."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.operators import blocking, cut, epochs, model, partition
from quiltgraph.phases import Phases, phase
from quiltgraph.schema import GraphBundle
from quiltgraph.sources import graphs, io
from quiltgraph.storage import StateLog, shared_dir


def timed(spark: SparkSession, batches: model.Batches, name: str) -> model.Batches:
    """The same batches; a phase for making each of them."""

    def epoch_batches(epoch: int) -> Iterator:
        source = iter(batches(epoch))
        while True:
            with phase(spark, name):
                batch = next(source, None)
            if batch is None:
                return
            yield batch

    return epoch_batches


def dataset(spark: SparkSession, config: dict) -> GraphBundle:
    """The config's graph, from the cache if it was built with the same parameters, else built and kept."""
    own = {k: v for k, v in config.items() if k in ("source", "path", "seed", "normalize", "directed", "keys", "scheme", "files")}
    path = f"{config.get('cache') or shared_dir(spark)}/{io.dataset_key(own)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")  # written last
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        io.save_bundle(graphs.load(spark, own), path)
    return io.load_bundle(spark, path)


def mode_of(config: dict) -> str:
    return config.get("train_mode") or config.get("mode") or "node"


def _books(bundle: GraphBundle, config: dict) -> tuple[DataFrame, DataFrame]:
    """(part_id, window_id): training windows packed by their tiles, and the validation's in chunks as large on average."""
    meta, nodes, own = bundle.meta, model.targets(bundle), config.get("DPS") or {}
    wins = blocking.windows(blocking.window_cols(bundle.edges, meta.tile_rows, meta.tile_cols, bundle.edges.count()), meta.num_windows, meta.tile_cols)
    seeds = nodes.where("split = 'train'").select(F.expr(f"node_id div {meta.tile_rows}").alias("window_id"))
    book = partition.dps_book(wins, seeds, limit=int(own.get("max_partition_edges", 2_000_000)), base_step=int(own.get("probe_step_size", 50)), cells=meta.tile_rows * meta.tile_cols, seed=config.get("seed", 7), log=StateLog(wins.sparkSession, f"{config['state']}/book") if config.get("state") else None)
    windows, parts = book.agg(F.count(F.lit(1)), F.countDistinct("part_id")).first()
    return book, partition.eval_book(nodes.where("split = 'val'").select("node_id"), -(-windows // max(parts, 1)), meta.tile_rows)


def batches_for(bundle: GraphBundle, config: dict, layers: int) -> tuple[model.Batches, dict]:
    """The batches that config["train_mode"] (or mode) asks for (full, node, BAPS or DPS), and what training must know of them.

    config["in_tasks"]: node and DPS batches are trained in tasks, by runs of them.
    """
    mode, seed, in_tasks = mode_of(config).upper(), config.get("seed", 7), bool(config.get("in_tasks"))
    partition.resolve_mode(mode)
    if mode == "NODE":
        return epochs.node_batches(bundle, config.get("fanouts", [10] * layers), config.get("batch_size", 1024), seed=seed, in_tasks=in_tasks), {"weighted": False}
    if mode == "BAPS":
        parts = cut.kway_parts(bundle.edges, bundle.nodes.select("node_id"), config.get("num_partitions", 10), seed=zlib.crc32(str(seed).encode()))
        return epochs.part_batches(bundle, parts, config.get("batch_partition_size", 2), seed=seed), {}
    if mode == "DPS":
        own, size, ratio = _books(bundle, config), config.get("batch_partition_size", 2), float((config.get("DPS") or {}).get("max_external_ratio", 5.0))
        return epochs.halo_batches(bundle, own[0], layers, size, seed=seed, max_external_ratio=ratio, in_tasks=in_tasks), {"accuracy": epochs.halo_accuracy(bundle, own[1], size, seed=seed, max_external_ratio=ratio, in_tasks=in_tasks)}
    return epochs.full_batches(bundle), {}


def run(spark: SparkSession, config: dict) -> dict:
    """Load, build, train, test.  Returns the results and, if config["output"] is set, keeps them.

    With config["state"], a folder, a run that stopped goes on from the last
    epoch, and the last round of its book, that it committed there.  The run's folder is output/SOURCE_MODE_TIME, with the best weights (weights,
    meta), the epochs' rows (log), what each phase cost (timers, see quiltgraph.phases) and results.
    """
    phases, mode = Phases(), mode_of(config)
    with phases.active():
        return _run(spark, config, phases, mode)


def _run(spark: SparkSession, config: dict, phases: Phases, mode: str) -> dict:
    with phase(spark, "data"):
        bundle = dataset(spark, config)
    with phase(spark, "model"):
        width = len(model.targets(bundle).first()["features"])
        hidden = [config.get("hidden_size", 128)] * (config.get("num_layers", len(config.get("fanouts", [0, 0]))) - 1)
        options = {"activation": config.get("activation", "relu"), "layer_norm": config.get("layer_norm", True), "residual": config.get("residual", False), "dropout": config.get("dropout", 0.0)}
        net = model.GraphModel.init([width, *hidden, config.get("num_classes") or bundle.num_classes], config.get("seed", 7), **options)
        batches, known = batches_for(bundle, config, len(net.layers))
    state = StateLog(spark, f"{config['state']}/train") if config.get("state") else None
    with phase(spark, "train"):
        adam = model.Adam(float(config.get("lr", 1e-3)), float(config.get("weight_decay", 0.0)))
        log = model.train(bundle, net, timed(spark, batches, "batch"), epochs=config.get("epochs", 200), eval_interval=config.get("eval_interval", 1), patience=config.get("patience", 20), adam=adam, plateau=config.get("use_scheduler", True), state=state, **known)
    with phase(spark, "test"):
        test = model.accuracy_of(net, bundle.edges, bundle.nodes, model.targets(bundle).where("split = 'test'"))
    seen = [r for r in log if r["val_acc"] is not None]
    best = max(seen, key=lambda r: r["val_acc"], default={"val_acc": None, "epoch": 0})
    results = {"best_val_acc": best["val_acc"], "best_epoch": best["epoch"], "test_acc": test, "seconds": {k: c.seconds for k, c in phases.costs.items()}}
    if config.get("output"):
        results["folder"] = f"{config['output']}/{config.get('source', 'graph')}_{mode}_{time.strftime('%Y%m%d-%H%M%S')}"
        model.save_weights(net, spark, results["folder"], epoch=best["epoch"])
        io.save_log(spark, log, f"{results['folder']}/log")
        phases.table(spark).coalesce(1).write.parquet(f"{results['folder']}/timers")
        io.save_results(spark, f"{results['folder']}/results", **results)
    return results
