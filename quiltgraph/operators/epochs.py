"""Batches of an epoch: the whole graph, sampled layers, parts, or parts with a halo.

Each builder returns a function of the epoch that yields (edges, nodes, train
nodes), as ``model.train`` takes them.  Only batch numbers come to the driver.
What a batch reads of the graph is written once, in a folder for each batch,
so that an epoch reads the graph once and not once for each batch.

Batches whose size their parameters bound, sampled ones and parts with a halo,
can be trained in tasks (in_tasks): Spark samples, cuts and deals them as
before, and writes them by runs of batches in a row.  One task takes a run's
steps, and the next task goes on from its weights; so the jobs are as many as
the runs and not some for each step."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quiltgraph.operators import model, partition, sampling
from quiltgraph.operators.ranking import dealt
from quiltgraph.schema import GraphBundle
from quiltgraph.storage import materialize, remove, remove_path, shared_path

#: Files of each batch's folder.
FILES = 8
#: Nodes and edges, on average, of a run: the batches that one task trains on.
RUN_ROWS = 1 << 18


def _by_batch(df: DataFrame, name: str, key: str) -> DataFrame:
    """df (with batch_id) written in a folder for each batch; a batch is shared out to FILES tasks by key."""
    path = shared_path(df.sparkSession, name)
    df.repartition("batch_id", F.expr(f"pmod(hash({key}), {FILES})")).write.partitionBy("batch_id").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbers(book: DataFrame) -> int:
    last = book.agg(F.max("batch_id")).first()[0]
    return 0 if last is None else last + 1


def _order(n: int, seed: object, epoch: int) -> list[int]:
    """Batch numbers in an order of the epoch's own."""
    return np.random.default_rng([zlib.crc32(str(seed).encode()), epoch]).permutation(n).tolist()


def _rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (batch_id, node_id, features, label or labels, target) and edges (batch_id, src, dst, weight, layers) as one table, in which layers is 0 for nodes.

    layers: a bit for each layer that has the edge.  Edges have empty arrays, as a null one takes Spark far longer to hand to a task.
    """
    label = "labels" if "labels" in nodes.columns else "label"
    own = nodes.select("batch_id", F.col("node_id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("double").alias("weight"), F.lit(0).alias("layers"), "features", F.col(label).alias("label"), F.coalesce("target", F.lit(False)).alias("target"))
    none = [(F.array() if isinstance(own.schema[c].dataType, ArrayType) else F.lit(None)).cast(own.schema[c].dataType).alias(c) for c in ("features", "label", "target")]
    return own.union(edges.select("batch_id", "src", "dst", F.col("weight").cast("double").alias("weight"), "layers", *none))


def _numbers_of(lists: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0)
    return flat.reshape(len(lists), -1)


def _task_batches(table: pa.Table, layers: int, key: str) -> Iterator[model.TaskBatch]:
    """The batches of a task's rows, see _rows, in the order of key."""
    place, bits = table.column(key).to_numpy(), table.column("layers").to_numpy()
    src, dst = table.column("src").to_numpy(), table.column("dst").fill_null(-1).to_numpy()
    order = np.lexsort((dst, src, bits > 0, place))
    table, place, bits, src, dst = table.take(pa.array(order)), place[order], bits[order], src[order], dst[order]
    weight = table.column("weight").fill_null(0.0).to_numpy()
    ends = [*np.flatnonzero(np.diff(place)) + 1, len(place)]
    for start, end in zip([0, *ends], ends, strict=False):
        middle = start + int((bits[start:end] == 0).sum())
        nodes, ids = table.slice(start, middle - start), src[start:middle]
        targets = np.flatnonzero(nodes.column("target").to_numpy(zero_copy_only=False).astype(bool))
        label = nodes.column("label").take(pa.array(targets))
        labels = _numbers_of(label).astype(float) if pa.types.is_list(label.type) else label.to_numpy().astype(int)
        graphs = []
        for layer in range(layers):
            at = middle + np.flatnonzero(bits[middle:end] >> layer & 1)
            u, v = np.searchsorted(ids, src[at]), np.searchsorted(ids, dst[at])
            known = (u < len(ids)) & (v < len(ids))
            known[known] = (ids[u[known]] == src[at][known]) & (ids[v[known]] == dst[at][known])
            graphs.append((u[known], v[known], weight[at][known]))
        yield model.TaskBatch(ids, _numbers_of(nodes.column("features")), graphs, targets, labels)


def _steps(rows: DataFrame) -> model.Run:
    """The steps of a run's rows, in the order of place, taken by one task."""

    def run(net: model.GraphModel, adam: model.Adam, epoch: int) -> list[tuple[float, int, int]]:
        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = []
            for batch in _task_batches(pa.Table.from_batches(batches), len(net.layers), "place"):
                *found, grads = model.task_gradients(net, batch, epoch=epoch)
                if found[2]:
                    adam.step(net, grads)
                told.append(tuple(found))
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps((net.weights(), adam, told))]})

        state = rows.coalesce(1).mapInArrow(trained, "state binary").collect()  # one small row
        weights, after, told = pickle.loads(state[0]["state"])
        net.set_weights(weights)
        adam.m, adam.v, adam.t = after.m, after.v, after.t
        return told

    return run


def _runs(rows: DataFrame, order: list[int]) -> Iterator[model.Run]:
    """Runs of the batches of a written table, see _rows, in that order of their numbers; an epoch's copy is written by runs."""
    if not order:
        return
    spark, count = rows.sparkSession, rows.count()
    each = max(1, RUN_ROWS * len(order) // max(count, 1))
    places = spark.createDataFrame([(b, i, i // each) for i, b in enumerate(order)], "batch_id bigint, place bigint, run bigint")
    placed, path = rows.join(F.broadcast(places), "batch_id").drop("batch_id"), shared_path(spark, "runs")  # three numbers for each batch
    dealt(placed, count, "run").write.partitionBy("run").parquet(path)
    for i in range(-(-len(order) // each)):
        yield _steps(spark.read.schema(placed.drop("run").schema).parquet(f"{path}/run={i}"))
    remove_path(spark, path)


def full_batches(bundle: GraphBundle) -> model.Batches:
    """One batch: the whole graph."""
    nodes = model.targets(bundle)
    return lambda epoch: iter([(bundle.edges, nodes, nodes.where("split = 'train'"))])


def node_batches(bundle: GraphBundle, cols_per_window: Sequence[int], batch_size: int, *, seed: object = 7, include_self: bool = True, drop_last: bool = False, in_tasks: bool = False, **scoring) -> model.Batches:
    """Batches of shuffled windows of training nodes; each layer has the edges that its hop sampled.

    Every epoch shuffles anew; all its batches are sampled at once, by as many
    jobs however many they are, and written in a folder each.  include_self keeps the targets' own windows in
    the hop before, so that their self part is computed there and not left at
    what one layer's self weights make of it.  One model layer for each entry
    of cols_per_window.
    """
    nodes, meta = model.targets(bundle), bundle.meta
    train = materialize(nodes.where("split = 'train'"), "train")

    def epoch_batches(epoch: int) -> Iterator[tuple[list[DataFrame], DataFrame, DataFrame]]:
        book = materialize(partition.window_batches(train, batch_size, tile_rows=meta.tile_rows, seed=f"{seed}-{epoch}", drop_last=drop_last), "book")
        seeds = train.withColumn("window_id", F.expr(f"node_id div {meta.tile_rows}")).join(book, "window_id").drop("window_id")
        seeds = materialize(seeds, "seeds") if in_tasks else _by_batch(seeds, "seeds", "node_id")
        layers = sampling.sample_layers(bundle.edges, seeds, cols_per_window, num_nodes=meta.num_rows, tile_rows=meta.tile_rows, include_self=include_self, by=("batch_id",), **scoring)
        if in_tasks:
            of_layers = [materialize(layer.edges.select("batch_id", "src", "dst", "weight", F.lit(1 << i).alias("layers")), "sampled_edges") for i, layer in enumerate(layers)]
            ids = [seeds.select("batch_id", "node_id", F.lit(True).alias("target")), *[e.select("batch_id", F.col(c).alias("node_id"), F.lit(False).alias("target")) for e in of_layers for c in ("src", "dst")]]
            ids = reduce(DataFrame.union, ids).groupBy("batch_id", "node_id").agg(F.max("target").alias("target"))
            rows = materialize(_rows(nodes.join(ids, "node_id"), reduce(DataFrame.union, of_layers)), "batch_rows")
            n = _numbers(book)
            remove(book, seeds, *of_layers, *[t for layer in layers for t in (layer.nodes, layer.extra["sampled"])])
            yield from _runs(rows, list(range(n)))
            remove(rows)
            return
        edges = [_by_batch(layer.edges.drop("window_id"), "sampled_edges", "src") for layer in layers]
        for layer in layers:
            remove(layer.nodes, layer.extra["sampled"])
        ids = seeds.select("batch_id", "node_id")
        for e in edges:
            ids = ids.union(e.select("batch_id", "src")).union(e.select("batch_id", "dst"))
        inputs = _by_batch(nodes.join(ids.distinct(), "node_id"), "inputs", "node_id")
        for i in range(_numbers(book)):
            of = lambda df: df.where(F.col("batch_id") == i)  # noqa: B023, E731
            yield [of(e) for e in edges], of(inputs), of(seeds)
        remove(book, seeds, inputs, *edges)

    return epoch_batches


def part_batches(bundle: GraphBundle, parts: DataFrame, batch_size: int, *, seed: object = 7) -> model.Batches:
    """Batches of batch_size parts (node_id, part_id): their nodes, and the edges between these.

    Which parts make a batch is fixed; every epoch takes the batches in another order.
    """
    nodes, book = model.targets(bundle), partition.partition_batches(parts.select("part_id").distinct(), batch_size, seed)
    where = materialize(parts.join(book, "part_id").select("node_id", "batch_id"), "batch_of_node")
    inside = bundle.edges.join(where.withColumnRenamed("node_id", "src"), "src").join(where.withColumnRenamed("node_id", "dst"), ["dst", "batch_id"])
    edges = _by_batch(inside.select("batch_id", "src", "dst", "weight"), "part_edges", "src")
    own = _by_batch(nodes.join(where, "node_id"), "part_nodes", "node_id")

    def epoch_batches(epoch: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
        for i in _order(_numbers(where), seed, epoch):
            batch = own.where(F.col("batch_id") == i)
            yield edges.where(F.col("batch_id") == i), batch, batch.where("split = 'train'")

    return epoch_batches


def halo_cuts(bundle: GraphBundle, book: DataFrame, batch_size: int, *, seed: object = 7, max_external_ratio: float = 5.0, in_tasks: bool = False) -> tuple[int, DataFrame, DataFrame]:
    """The number of batches of book (part_id, window_id), and their cuts, all made at once: nodes and edges in local ids, with batch_id.

    See sampling.halos: nodes have internal, edges inner.  In a folder for each batch, unless in_tasks; then a batch's edges fit a task.
    """
    nodes, meta = model.targets(bundle), bundle.meta
    batches = partition.partition_batches(book.select("part_id").distinct(), batch_size, seed)
    where = materialize(book.join(batches, "part_id").select(F.col("batch_id").alias("part"), "window_id").distinct(), "batch_of_window")
    own = sampling.edges_by_part(bundle.edges, where, meta.tile_rows)
    if in_tasks:
        own = sampling.first_edges(own, where, meta.num_rows, bundle.edges.count(), max_external_ratio=max_external_ratio, seed=seed, tile_rows=meta.tile_rows)
    own = materialize(own, "batch_rows")
    cut = sampling.halos(own, where, meta.num_rows, max_external_ratio=max_external_ratio, seed=seed, tile_rows=meta.tile_rows)
    placed = nodes.join(cut[0], "node_id").drop("node_id").withColumnsRenamed({"local_id": "node_id", "part": "batch_id"})
    count = _numbers(where.withColumnRenamed("part", "batch_id"))
    write = (lambda df, name, key: materialize(df, name)) if in_tasks else _by_batch
    made = count, write(placed, "halo_nodes", "node_id"), write(cut[1].withColumnRenamed("part", "batch_id"), "halo_edges", "src")
    remove(where, own)
    return made


def _halo_layers(edges: DataFrame, layers: int) -> list[DataFrame]:
    """The first layer reads the halo, the others inner edges."""
    return [edges] + [edges.where("inner")] * (layers - 1)


def _halo_rows(nodes: DataFrame, edges: DataFrame, layers: int, split: str) -> DataFrame:
    """_rows of cuts; their targets are a split's internal nodes."""
    bits = F.when(F.col("inner"), F.lit((1 << layers) - 1)).otherwise(F.lit(1))
    return _rows(nodes.withColumn("target", F.col("internal") & (F.col("split") == split)), edges.withColumn("layers", bits))


def halo_batches(bundle: GraphBundle, book: DataFrame, layers: int, batch_size: int, *, seed: object = 7, max_external_ratio: float = 5.0, in_tasks: bool = False) -> model.Batches:
    """Batches of batch_size parts of book (part_id, window_id) with their halo; the loss is on inner training nodes."""
    n, nodes, edges = halo_cuts(bundle, book, batch_size, seed=seed, max_external_ratio=max_external_ratio, in_tasks=in_tasks)
    if in_tasks:
        rows = materialize(_halo_rows(nodes, edges, layers, "train"), "batch_rows")
        remove(nodes, edges)
        return lambda epoch: _runs(rows, _order(n, seed, epoch))

    def epoch_batches(epoch: int) -> Iterator[tuple[list[DataFrame], DataFrame, DataFrame]]:
        for i in _order(n, seed, epoch):
            own = nodes.where(F.col("batch_id") == i)
            yield _halo_layers(edges.where(F.col("batch_id") == i), layers), own, own.where("internal and split = 'train'")

    return epoch_batches


def halo_accuracy(bundle: GraphBundle, book: DataFrame, batch_size: int, split: str = "val", *, seed: object = 7, max_external_ratio: float = 5.0, in_tasks: bool = False) -> Callable[[model.GraphModel], float]:
    """A function of the model: its accuracy over a split's nodes, each in the cut whose book holds its window."""
    n, nodes, edges = halo_cuts(bundle, book, batch_size, seed=seed, max_external_ratio=max_external_ratio, in_tasks=in_tasks)
    size = nodes.count() + edges.count() if in_tasks else 0

    def of_tasks(net: model.GraphModel) -> float:
        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            found = [model.task_hits(net, b) for b in _task_batches(table, len(net.layers), "batch_id")] if table else []
            yield pa.RecordBatch.from_pydict({"ok": [sum(f[0] for f in found)], "n": [sum(f[1] for f in found)]})

        rows = dealt(_halo_rows(nodes, edges, len(net.layers), split), size, "batch_id")
        right, total = rows.mapInArrow(counted, "ok bigint, n bigint").agg(F.sum("ok"), F.sum("n")).first()
        return (right or 0) / max(total or 0, 1)

    def accuracy(net: model.GraphModel) -> float:
        right = total = 0
        for i in range(n):
            own = nodes.where(F.col("batch_id") == i)
            made: list[DataFrame] = []
            logits = model.forward(net, _halo_layers(edges.where(F.col("batch_id") == i), len(net.layers)), own, made=made)
            ok, count = model.hits(logits, own.where(F.col("internal") & (F.col("split") == split)))
            right, total = right + ok, total + count
            remove(*made)
        return right / max(total, 1)

    return of_tasks if in_tasks else accuracy
