"""Column sampling by window, multi-hop expansion, reindexing and cut-outs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.operators import blocking
from quiltgraph.operators.blocking import with_window
from quiltgraph.operators.ranking import dealer, dealt, hash_text, number_by_id, number_within, prefix_sum
from quiltgraph.phases import phase
from quiltgraph.schema import TILE_COLS, TILE_ROWS, HacsOptions, Subgraph
from quiltgraph.storage import materialize, remove


def round_up_32(k: int) -> int:
    return -(-k // 32) * 32


def active_windows(ids: DataFrame, column: str = "node_id", tile_rows: int = TILE_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """(*by, window_id, mask): windows of the ids, and a bit for each row; null and negative ids drop out."""
    own = ids.where(F.col(column) >= 0).select(*by, F.expr(f"`{column}` div {tile_rows}").alias("window_id"), F.expr(f"shiftleft(1, cast(`{column}` % {tile_rows} as int))").alias("bit"))
    return own.groupBy(*by, "window_id").agg(F.bit_or("bit").alias("mask"))


def score_columns(edges: DataFrame, frontier: DataFrame | None = None, *, tile_rows: int = TILE_ROWS, hacs: HacsOptions | None = None, q: DataFrame | None = None, window_parts: DataFrame | None = None, node_parts: DataFrame | None = None, mask_rows: bool = False, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """(window_id, col, score): the columns of the windows in frontier (all, if none).

    A row earns int((1 + 10 |w|) * 1000) in single precision, rows without
    the column too.  With hacs and q (node_id, q) it earns
    int(((alpha + beta |w|) q + delta) * scale), delta only where the column
    lies in the window's part, and the column int(gamma * scale) once; scores
    of zero or less drop out.  mask_rows: only rows in the frontier's mask
    count.  by: columns of the frontier by which windows are scored apart.
    rows: the edges' number; with it, joins and sums are dealt by it, see
    ranking.dealt, and a window's columns lie in one task, so that topk needs
    no shuffle of its own.
    """
    at = dealer(rows)
    own = with_window(edges, tile_rows)
    height = F.lit(tile_rows)
    if frontier is not None:
        own = at(own, "window_id").join(at(frontier, "window_id"), "window_id")
        if mask_rows:
            own = own.where(F.expr(f"mask & shiftleft(1, cast(src % {tile_rows} as int))") != 0)
            height = F.max(F.bit_count("mask"))
    own = own.withColumnRenamed("dst", "col")
    single = lambda x: F.lit(x).cast("float")
    if hacs is None or q is None:
        earned = ((single(1.0) + single(10.0) * F.abs("weight")) * single(1000.0)).cast("int")
        scores = at(own, "window_id").groupBy(*by, "window_id", "col").agg((F.sum(earned) + (height - F.count(F.lit(1))) * 1000).cast("bigint").alias("score"))
        return scores
    own = at(own, "col").join(at(q.select(F.col("node_id").alias("col"), "q"), "col"), "col")
    delta = single(0.0)
    if window_parts is not None and node_parts is not None:
        own = own.join(at(node_parts.select(F.col("node_id").alias("col"), F.col("part_id").alias("cp")), "col"), "col", "left")
        own = at(own, "window_id").join(at(window_parts.select("window_id", F.col("part_id").alias("wp")), "window_id"), "window_id", "left")
        delta = F.when(F.col("wp") == F.col("cp"), single(hacs.delta)).otherwise(single(0.0))
    value = lambda base: ((base * F.col("q") + delta) * single(hacs.score_scale)).cast("int")
    full = own.select(*by, "window_id", "col", value(single(hacs.alpha) + single(hacs.beta) * F.abs("weight")).alias("hit"), value(single(hacs.alpha)).alias("miss"), *([F.col("mask")] if mask_rows else []))
    score = F.sum("hit") + (height - F.count(F.lit(1))) * F.max("miss") + int(hacs.gamma_bonus * hacs.score_scale)
    return at(full, "window_id").groupBy(*by, "window_id", "col").agg(score.cast("bigint").alias("score")).where("score > 0")


def topk(scores: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k best columns of each window (of each by): by score, ties by smaller column.  Adds rank, from 1."""
    best = Window.partitionBy(*by, "window_id").orderBy(F.desc("score"), "col")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recompress(edges: DataFrame, sampled: DataFrame, tile_rows: int = TILE_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """(*by, window_id, src, dst, weight): the edges of the sampled columns, all rows of their windows."""
    keys = sampled.select(*by, "window_id", F.col("col").alias("dst"))
    return with_window(edges, tile_rows).join(keys, ["window_id", "dst"]).select(*by, "window_id", "src", "dst", "weight")


def next_frontier(sampled: DataFrame, num_nodes: int | None = None, tile_rows: int = TILE_ROWS, by: Sequence[str] = ()) -> DataFrame:
    own = sampled.select(*by, "col").distinct()
    return active_windows(own if num_nodes is None else own.where(F.col("col") < num_nodes), "col", tile_rows, by)


def sample_layers(edges: DataFrame, seeds: DataFrame, cols_per_window: Sequence[int], *, num_nodes: int | None = None, tile_rows: int = TILE_ROWS, include_self: bool = False, by: Sequence[str] = (), **scoring) -> list[Subgraph]:
    """Expand seeds (*by, node_id) hop by hop; the last budget is used first.

    Returns layers from input to output, each with its edges in global ids,
    its windows (nodes: *by, window_id, mask) and the sampled columns (extra).
    by: columns of the seeds, such as a batch's number; each of their values
    has frontiers of its own, all expanded by the same jobs.  A window's
    columns are scored once for all of them, unless only the rows in a mask
    count.  include_self keeps a layer's own windows in the next frontier.
    Each hop is written to the shared folder, as the next one's plan would
    hold it several times.
    """
    frontier = materialize(active_windows(seeds, "node_id", tile_rows, by), "frontier")
    layers = []
    for hop, k in enumerate(reversed(cols_per_window), 1):
        if by and not scoring.get("mask_rows"):
            once = topk(score_columns(edges, frontier.select("window_id").distinct(), tile_rows=tile_rows, **scoring), k)
            found = frontier.select(*by, "window_id").join(once, "window_id")
        else:
            found = topk(score_columns(edges, frontier, tile_rows=tile_rows, by=by, **scoring), k, by)
        with phase(edges.sparkSession, "sample"):
            sampled = materialize(found, "sampled")
        layers.append(Subgraph(recompress(edges, sampled, tile_rows, by), frontier, extra={"sampled": sampled}))
        if hop == len(cols_per_window):
            break
        after = next_frontier(sampled, num_nodes, tile_rows, by)
        if include_self:
            after = after.unionByName(frontier).groupBy(*by, "window_id").agg(F.bit_or("mask").alias("mask"))
        with phase(edges.sparkSession, "frontier"):
            frontier = materialize(after, "frontier")
    return layers[::-1]


def sampled_windows(sampled: DataFrame, active: DataFrame, tile_cols: int = TILE_COLS) -> DataFrame:
    """(window_id, idx, n_cols, n_tiles, tile_start, tile_end): of each active window, in their order, its valid sampled columns and where its tiles are.

    tile_end is the inclusive sum of tiles; windows of which nothing was sampled have none.
    """
    count = sampled.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_cols"))
    own = window_ids(active).join(count, "window_id", "left").select("window_id", "idx", F.coalesce("n_cols", F.lit(0)).cast("bigint").alias("n_cols"))
    placed = prefix_sum(own.withColumn("n_tiles", F.expr(f"(n_cols + {tile_cols - 1}) div {tile_cols}")), "idx", "n_tiles", "tile_start")
    return placed.select("window_id", "idx", "n_cols", "n_tiles", "tile_start", (F.col("tile_start") + F.col("n_tiles")).alias("tile_end"))


def sampled_cols(sampled: DataFrame, tile_cols: int = TILE_COLS) -> DataFrame:
    """(window_id, col, pos, tile_in_window, col_in_tile): as blocking.window_cols, by place among a window's sampled columns."""
    pos = (F.row_number().over(Window.partitionBy("window_id").orderBy("col")) - 1).cast("bigint")  # a budget's columns at most
    placed = sampled.select("window_id", "col").withColumn("pos", pos)
    return placed.withColumns({"tile_in_window": F.expr(f"pos div {tile_cols}"), "col_in_tile": F.expr(f"pos % {tile_cols}")})


def sampled_tiles(edges: DataFrame, sampled: DataFrame, active: DataFrame, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS) -> DataFrame:
    """(window_id, tile_id, cols, vals): the sampled columns condensed into tiles anew, all rows of their windows."""
    return blocking.tiles(edges, sampled_cols(sampled, tile_cols), sampled_windows(sampled, active, tile_cols), tile_rows, tile_cols)


def transposed_coo(edges: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(col, row_in_window, window_id, weight) of recompressed edges."""
    return edges.select(F.col("dst").alias("col"), F.expr(f"src % {tile_rows}").alias("row_in_window"), "window_id", "weight")


def window_ids(active: DataFrame) -> DataFrame:
    """(window_id, idx): place of each active window in their order."""
    return number_by_id(active.select("window_id").distinct(), "window_id", "idx")


def reindex(edges: DataFrame, active: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Adds local_dst: idx(window of dst) * tile_rows + dst % tile_rows; edges to inactive windows drop out."""
    idx = window_ids(active).select(F.col("window_id").alias("_w"), "idx")
    own = edges.withColumn("_w", F.expr(f"dst div {tile_rows}")).join(idx, "_w")
    return own.withColumn("local_dst", F.col("idx") * tile_rows + F.expr(f"dst % {tile_rows}")).drop("_w", "idx")


def seed_rows(seeds: DataFrame, active: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(node_id, row): the row of each seed in the output of a layer with these windows."""
    own = seeds.select("node_id", F.expr(f"node_id div {tile_rows}").alias("window_id"))
    return own.join(window_ids(active), "window_id").select("node_id", (F.col("idx") * tile_rows + F.expr(f"node_id % {tile_rows}")).alias("row"))


def partition_slice(edges: DataFrame, partitions: DataFrame, part_ids: Sequence[int]) -> DataFrame:
    """(src, dst, weight) in local ids: the rows and columns of some parts, laid one after the other by part."""
    chosen = partitions.where(F.col("part_id").isin(list(part_ids)) & (F.col("end_idx") > F.col("start_idx"))).withColumn("size", F.col("end_idx") - F.col("start_idx"))
    before = Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each chosen part
    placed = chosen.withColumn("local", F.sum("size").over(before) - F.col("size"))
    ids = placed.select(F.explode(F.expr("sequence(start_idx, end_idx - 1)")).alias("id"), "start_idx", "local").select("id", (F.col("id") - F.col("start_idx") + F.col("local")).alias("l"))
    rows, cols = ids.select(F.col("id").alias("src"), F.col("l").alias("ls")), ids.select(F.col("id").alias("dst"), F.col("l").alias("ld"))
    return edges.join(rows, "src").join(cols, "dst").select(F.col("ls").alias("src"), F.col("ld").alias("dst"), "weight")


def edges_by_part(edges: DataFrame, windows: DataFrame, tile_rows: int = TILE_ROWS, rows: int | None = None) -> DataFrame:
    """(part, src, dst, weight): the rows of each part's windows (part, window_id), by one reading of the edges; rows: their number, see ranking.dealt."""
    at = dealer(rows)
    return at(with_window(edges, tile_rows), "window_id").join(at(windows.select("part", "window_id").distinct(), "window_id"), "window_id").select("part", "src", "dst", "weight")


def window_nodes(windows: DataFrame, num_nodes: int, tile_rows: int = TILE_ROWS, by: Sequence[str] = ("part",)) -> DataFrame:
    """(*by, node_id): the nodes of windows (*by, window_id)."""
    rows = F.explode(F.expr(f"sequence(window_id * {tile_rows}, window_id * {tile_rows} + {tile_rows - 1})"))
    return windows.select(*by, "window_id").distinct().select(*by, rows.alias("node_id")).where(F.col("node_id") < num_nodes)


#: Edges among which a task looks for the first neighbours at a time.
HELD = 1 << 20


def _first(part: np.ndarray, node: np.ndarray, cap: np.ndarray, seed: object) -> np.ndarray:
    """Which rows name one of the first cap nodes of their part, in the order of hash_text; at least these."""
    nodes, place = np.unique(node, return_inverse=True)
    hashes = np.frombuffer(b"".join(hashlib.md5(f"{i}_{seed}".encode()).digest()[:8] for i in nodes.tolist()), ">u8").astype(np.uint64)[place]
    order = np.lexsort((node, hashes, part))
    part_, node_, hash_ = part[order], node[order], hashes[order]
    begins = np.diff(part_, prepend=part_[:1] - 1) != 0
    number = np.cumsum(begins | (np.diff(node_, prepend=node_[:1] - 1) != 0))  # of different nodes
    start = number[begins]
    last = number - np.repeat(start, np.diff(np.flatnonzero(begins), append=len(part_))) < cap[order]
    kept = np.empty(len(order), bool)
    kept[order] = last
    return kept


def first_edges(own: DataFrame, windows: DataFrame, num_nodes: int, rows: int, *, max_external_ratio: float = 5.0, seed: object = 7, tile_rows: int = TILE_ROWS) -> DataFrame:
    """own (part, src, dst, weight), at most so many rows, without edges that halos would drop, mostly: a cut of them is that of own.

    They are dealt by part, and a task keeps, of what it holds of a part, the
    edges to internal nodes and to as many external ones as may stay, those
    first in the seeded shuffle: what is among the first of all is among the
    first of any rows that name it.  So it pays for parts that fit a task and
    have many more neighbours than may stay.
    """
    sizes = window_nodes(windows, num_nodes, tile_rows).groupBy("part").agg(F.floor(F.count(F.lit(1)) * F.lit(float(max_external_ratio))).cast("bigint").alias("cap"))
    inside = windows.select("part", "window_id").distinct().withColumn("inside", F.lit(True))
    marked = own.withColumn("window_id", F.expr(f"dst div {tile_rows}")).join(inside, ["part", "window_id"], "left").join(F.broadcast(sizes), "part")  # a number for each part
    marked = marked.select("part", "src", "dst", "weight", (F.coalesce("inside", F.lit(False)) & (F.col("dst") < num_nodes)).alias("inside"), "cap")

    def kept(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        inside = table.column("inside").to_numpy()
        out = np.flatnonzero(~inside)
        keep = inside.copy()
        if len(out):
            keep[out] = _first(*(table.column(name).to_numpy()[out] for name in ("part", "dst", "cap")), seed)
        yield from table.drop_columns(["inside", "cap"]).filter(pa.array(keep)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= HELD:
                yield from kept(held)
                held, size = [], 0
        if size:
            yield from kept(held)

    return dealt(marked, rows, "part").mapInArrow(run, own.schema)


def halos(own: DataFrame, windows: DataFrame, num_nodes: int, *, max_external_ratio: float = 5.0, seed: object = 7, tile_rows: int = TILE_ROWS, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each part's windows (part, window_id) with their neighbours, repacked: nodes and edges of all parts in one plan.

    own: the parts' rows, see edges_by_part.  nodes: (part, node_id, local_id,
    internal), of each part the internal ones first, then external ones, both
    by id.  At most int(ratio * internal) external nodes stay, those first in
    the seeded shuffle; edges to the others drop out.  edges: (part, src, dst,
    weight, inner) in local ids; inner ones end at internal nodes.  Weights
    that are NaN become 0.  rows: a bound on the number of own's, by which
    its tasks are dealt, see ranking.dealt.
    """
    at = dealer(rows)
    inside = window_nodes(windows, num_nodes, tile_rows)
    sizes = inside.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    outside = at(own.select("part", F.col("dst").alias("node_id")), "part", "node_id").distinct().join(at(inside, "part", "node_id"), ["part", "node_id"], "left_anti")
    ranked = number_within(outside.withColumn("_h", hash_text("node_id", seed)), "part", F.conv(F.substring("_h", 1, 4), 16, 10), ["_h", "node_id"], "_r")
    kept = ranked.join(sizes, "part").where(F.col("_r") < F.floor(max_external_ratio * F.col("n"))).select("part", "node_id", "n")
    numbered = lambda df: number_within(df, "part", F.expr("node_id div 65536"), ["node_id"], "local_id")
    first = numbered(inside).select("part", "node_id", "local_id", F.lit(True).alias("internal"))
    then = numbered(kept).select("part", "node_id", (F.col("local_id") + F.col("n")).alias("local_id"), F.lit(False).alias("internal"))
    nodes = first.union(then)
    sources = first.select("part", F.col("node_id").alias("src"), F.col("local_id").alias("ls"))
    cols = nodes.select("part", F.col("node_id").alias("dst"), F.col("local_id").alias("ld"), "internal")
    local = at(own, "part", "src").join(at(sources, "part", "src"), ["part", "src"])
    local = at(local, "part", "dst").join(at(cols, "part", "dst"), ["part", "dst"])
    return nodes, local.select("part", F.col("ls").alias("src"), F.col("ld").alias("dst"), F.nanvl(F.col("weight"), F.lit(0.0).cast("float")).alias("weight"), F.col("internal").alias("inner"))


def halo(edges: DataFrame, window_ids_: DataFrame, num_nodes: int, *, tile_rows: int = TILE_ROWS, **options) -> Subgraph:
    """One part's cut, see halos: nodes (node_id, local_id, internal) and edges (src, dst, weight)."""
    windows = window_ids_.select(F.lit(0).alias("part"), "window_id")
    nodes, local = halos(edges_by_part(edges, windows, tile_rows), windows, num_nodes, tile_rows=tile_rows, **options)
    return Subgraph(local.select("src", "dst", "weight"), nodes.drop("part"), window_nodes(windows, num_nodes, tile_rows).count())


def inner(sub: Subgraph) -> DataFrame:
    """The halo graph's edges between internal nodes."""
    return sub.edges.where(F.col("dst") < sub.n_internal)


def reached_windows(edges: DataFrame, seed_windows: DataFrame, num_nodes: int, cols_per_window: Sequence[int] = (5, 5), tile_rows: int = TILE_ROWS, rows: int | None = None) -> DataFrame:
    """(part, window_id): what a probe from all rows of each part's seed windows (part, window_id) samples from, all parts at once."""
    seeds = window_nodes(seed_windows, num_nodes, tile_rows)
    layers = sample_layers(edges, seeds, cols_per_window, num_nodes=num_nodes, tile_rows=tile_rows, by=("part",), rows=rows)
    reached = materialize(reduce(DataFrame.union, [layer.nodes.select("part", "window_id") for layer in layers]).distinct(), "reached")
    for layer in layers:
        remove(layer.nodes, layer.extra["sampled"])
    return reached


def dps_online(edges: DataFrame, seed_windows: DataFrame, num_nodes: int, cols_per_window: Sequence[int] = (5, 5), *, tile_rows: int = TILE_ROWS, rows: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Probe from all rows of each part's seed windows (part, window_id) and repack all windows that it reached, see halos.

    rows: the edges' number, by which tasks are dealt, see ranking.dealt.
    """
    reached = reached_windows(edges, seed_windows, num_nodes, cols_per_window, tile_rows, rows)
    # A window's edges are repeated for each part that has reached it.
    most = None if rows is None else rows * (reached.groupBy("window_id").count().agg(F.max("count")).first()[0] or 1)
    return halos(edges_by_part(edges, reached, tile_rows, rows), reached, num_nodes, tile_rows=tile_rows, rows=most, **options)
