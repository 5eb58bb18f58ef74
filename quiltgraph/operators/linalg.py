"""Sparse products as joins with sums (of arrays, or in long form), dense products with a small matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.ranking import dealt
from quiltgraph.storage import materialize, open_store


def to_long(nodes: DataFrame, column: str = "features") -> DataFrame:
    """(node_id, f, value) of an array column."""
    return nodes.select("node_id", F.posexplode(column).alias("f", "value")).select("node_id", F.col("f").cast("bigint").alias("f"), F.col("value").cast("double").alias("value"))


def to_arrays(long: DataFrame, width: int, column: str = "features") -> DataFrame:
    """(node_id, array) of a long table; missing entries are 0."""
    packed = long.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("f", "value"))).alias("m"))
    return packed.select("node_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias(column))


#: Entries of an array that one aggregation sums; wider arrays are summed in slices.
SLICE = 128
#: Edges that a task holds while it reads the nodes' arrays once; entries of sums, and of weighted arrays, that it holds.
HELD, SUMS, CELLS = 1 << 20, 1 << 24, 1 << 18


def sum_arrays(rows: DataFrame, key: str, width: int, column: str = "features") -> DataFrame:
    """(key, array): the sums of the arrays, entry by entry.  A row stays a row: tasks sum it in place, before the shuffle."""
    entries = lambda n: [F.sum(F.get(column, F.lit(i))).alias(f"s{i}") for i in range(n)]
    packed = lambda n: F.array(*[F.col(f"s{i}") for i in range(n)])
    if width <= SLICE:
        return rows.groupBy(key).agg(*entries(width)).select(key, packed(width).alias(column))
    cut = F.transform(F.sequence(F.lit(0), F.lit((width - 1) // SLICE)), lambda k: F.struct(k.alias("k"), F.slice(column, k * SLICE + 1, SLICE).alias(column)))
    parts = rows.select(key, F.explode(cut).alias("c")).select(key, "c.k", f"c.{column}").groupBy(key, "k").agg(*entries(SLICE)).select(key, F.struct("k", packed(SLICE).alias("v")).alias("p"))
    return parts.groupBy(key).agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"])), 1, width).alias(column))


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Arrays as rows of a matrix, and which of their first entries are there (None: all)."""
    lengths, flat = pc.list_value_length(lists).fill_null(0).to_numpy(), lists.flatten()
    if (lengths == width).all() and not flat.null_count:
        return flat.to_numpy().reshape(-1, width).astype(float), None
    row, place = np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = np.flatnonzero((place < width) & flat.is_valid().to_numpy(zero_copy_only=False))
    values, known = np.zeros((len(lists), width)), np.zeros((len(lists), width), bool)
    values[row[own], place[own]] = flat.fill_null(0).to_numpy()[own]
    known[row[own], place[own]] = True
    return values, known


def _sums(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, files: list[str], width: int) -> Iterator[pa.RecordBatch]:
    """(node_id, features): of each src, the weighted sum of its dsts' arrays.  They are read file by file, a batch's ids ascending; srcs that meet none are left out."""
    ids, row = np.unique(src, return_inverse=True)
    order = np.lexsort((row, dst))
    row, dst, weight = row[order], dst[order], weight[order]
    sums, known, met = np.zeros((len(ids), width)), np.zeros((len(ids), width), bool), np.zeros(len(ids), bool)
    for file in files:
        store, path = open_store(file)
        with store.open_input_file(path) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(columns=["node_id", "features"]):
                nodes = batch.column("node_id").to_numpy()
                own = slice(np.searchsorted(dst, nodes[0], "left"), np.searchsorted(dst, nodes[-1], "right")) if len(nodes) else slice(0)
                first = np.searchsorted(nodes, dst[own], "left")
                count = np.searchsorted(nodes, dst[own], "right") - first  # how often the id stands there
                edge = np.repeat(np.arange(len(count)), count)
                at = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + first[edge]
                if not len(edge):
                    continue
                by_row = np.argsort(row[own][edge], kind="stable")
                edge, at = edge[by_row], at[by_row]
                to, w = row[own][edge], weight[own][edge]
                values, there = _matrix(batch.column("features"), width)
                for k in range(0, len(edge), max(1, CELLS // width)):
                    part = slice(k, k + max(1, CELLS // width))
                    starts = np.flatnonzero(np.diff(to[part], prepend=-1))
                    sums[to[part][starts]] += np.add.reduceat(values[at[part]] * w[part, None], starts)
                    known[to[part][starts]] |= True if there is None else np.logical_or.reduceat(there[at[part]], starts)
                    met[to[part][starts]] = True
    offsets = pa.array(np.arange(met.sum() + 1) * width, pa.int32())
    features = pa.ListArray.from_arrays(offsets, pa.array(sums[met].ravel(), mask=~known[met].ravel()))
    yield pa.record_batch([pa.array(ids[met].astype(np.int64)), features], ["node_id", "features"])


def _spmm_by_rows(edges: DataFrame, nodes: DataFrame, width: int, rows: int) -> DataFrame:
    """spmm_arrays of at most so many edges, see there."""
    table = materialize(nodes.select(F.col("node_id").cast("bigint").alias("node_id"), "features").where("node_id is not null").repartitionByRange("node_id").sortWithinPartitions("node_id"), "arrays")
    files = sorted(table.inputFiles())
    own = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("weight").cast("double").alias("weight"))

    def summed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, weight = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in range(3))
        order = np.argsort(src, kind="stable")
        src, dst, weight = src[order], dst[order], weight[order]
        first = np.flatnonzero(np.diff(src, prepend=src[:1] - 1))[:: max(1, SUMS // width)]
        for start, end in zip(first, [*first[1:], len(src)], strict=True):
            yield from _sums(src[start:end], dst[start:end], weight[start:end], files, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= HELD:
                yield from summed(held)
                held, size = [], 0
        if size:
            yield from summed(held)

    # A task's edges are mostly held at once, so there is about one sum for each node.
    return sum_arrays(dealt(own.where("src is not null and dst is not null and weight is not null"), rows, "src").mapInArrow(run, "node_id bigint, features array<double>"), "node_id", width)


def spmm_arrays(edges: DataFrame, nodes: DataFrame, width: int, rows: int | None = None) -> DataFrame:
    """(node_id, features) = A X for arrays of ``width`` numbers: one row for each edge, not for each edge and entry.

    Entries are weighted as they are summed, so that no array is made for an
    edge.  A task that has its edges by dst makes a partial sum for nearly each
    of them, if the graph is large, and all of these are shuffled.  rows, a
    bound on the edges' number, has them dealt by src instead (see
    ranking.dealt), and tasks read the arrays from the shared folder, where
    they are written at once; then a node's sum is shuffled about once.
    """
    if rows is not None:
        return _spmm_by_rows(edges, nodes, width, rows)
    own = edges.select("src", F.col("dst").alias("node_id"), F.col("weight").cast("double").alias("w")).join(nodes.select("node_id", "features"), "node_id")
    if width <= SLICE:
        entries = [F.sum(F.get("features", F.lit(i)) * F.col("w")).alias(f"s{i}") for i in range(width)]
        return own.groupBy(F.col("src").alias("node_id")).agg(*entries).select("node_id", F.array(*[F.col(f"s{i}") for i in range(width)]).alias("features"))
    weighted = own.select(F.col("src").alias("node_id"), F.transform("features", lambda v: v * F.col("w")).alias("features"))
    return sum_arrays(weighted, "node_id", width)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def spmm(edges: DataFrame, x: DataFrame) -> DataFrame:
    """(node_id, f, value) = A x: sum over a row's columns.  Partial sums are made before the shuffle."""
    own = edges.select("src", F.col("dst").alias("node_id"), F.col("weight").cast("double").alias("w")).join(x, "node_id")
    return own.groupBy(F.col("src").alias("node_id"), "f").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def spmm_t(edges: DataFrame, g: DataFrame) -> DataFrame:
    """The same with the transpose of A."""
    return spmm(transpose(edges), g)


def project(nodes: DataFrame, w: np.ndarray, column: str = "features") -> DataFrame:
    """(node_id, features) times a small matrix, which goes to tasks in the closure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"node_id": pdf["node_id"], "features": list(np.stack(pdf["x"].to_numpy()).astype(float) @ w)})

    return nodes.select("node_id", F.col(column).alias("x")).mapInPandas(run, "node_id bigint, features array<double>")


def sage_conv(edges: DataFrame, nodes: DataFrame, w_neighbour: np.ndarray, w_self: np.ndarray, targets: DataFrame | None = None) -> DataFrame:
    """(node_id, features) = A (X Wn) + X Ws, for targets (node_id; all nodes, if none).

    Features are projected first where that makes them narrower, as sums then
    move fewer numbers; else neighbours are summed first.
    """
    d, h = w_neighbour.shape
    neighbours = spmm_arrays(edges, project(nodes, w_neighbour), h) if h <= d else project(spmm_arrays(edges, nodes, d), w_neighbour)
    both = neighbours.unionByName(project(nodes, w_self))
    if targets is not None:
        both = both.join(targets.select("node_id").distinct(), "node_id", "left_semi")
    return sum_arrays(both, "node_id", h)
