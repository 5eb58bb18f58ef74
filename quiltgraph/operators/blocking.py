"""Blocking: rows in windows, each window's distinct columns condensed to the left and cut into tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.operators.ranking import dealt, prefix_sum
from quiltgraph.schema import TILE_COLS, TILE_ROWS
from quiltgraph.storage import materialize


def with_window(edges: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    return edges.withColumn("window_id", F.expr(f"src div {tile_rows}"))


def row_counts(edges: DataFrame, num_rows: int) -> DataFrame:
    """CSR: (row, n, row_start) for every row, empty ones too."""
    rows = edges.sparkSession.range(num_rows).withColumnRenamed("id", "row")
    count = edges.groupBy(F.col("src").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sum(rows.join(count, "row", "left").select("row", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")), "row", "n", "row_start")


def window_cols(edges: DataFrame, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS, rows: int | None = None) -> DataFrame:
    """(window_id, col, pos, tile_in_window, col_in_tile): pos is the column's rank in its window.

    rows: the edges' number or a bound, see ranking.dealt.  One shuffle by
    window is enough: few edges of a window share a column.
    """
    cols = dealt(with_window(edges, tile_rows).select("window_id", F.col("dst").alias("col")), rows, "window_id").distinct()
    pos = (F.row_number().over(Window.partitionBy("window_id").orderBy("col")) - 1).cast("bigint")
    return cols.withColumn("pos", pos).withColumns({"tile_in_window": F.expr(f"pos div {tile_cols}"), "col_in_tile": F.expr(f"pos % {tile_cols}")})


def windows(cols: DataFrame, num_windows: int | None = None, tile_cols: int = TILE_COLS) -> DataFrame:
    """(window_id, n_cols, n_tiles, tile_start); with num_windows, empty windows too.  The counts are read twice, so they are written once."""
    count = materialize(cols.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_cols")), "window_counts")
    if num_windows is not None:
        count = cols.sparkSession.range(num_windows).withColumnRenamed("id", "window_id").join(count, "window_id", "left").select("window_id", F.coalesce("n_cols", F.lit(0)).cast("bigint").alias("n_cols"))
    return prefix_sum(count.withColumn("n_tiles", F.expr(f"(n_cols + {tile_cols - 1}) div {tile_cols}")), "window_id", "n_tiles", "tile_start").select("window_id", "n_cols", "n_tiles", "tile_start")


def tile_cells(edges: DataFrame, cols: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(window_id, tile_in_window, row_in_tile, col_in_tile, col, weight): where every edge is."""
    own = with_window(edges, tile_rows).withColumnRenamed("dst", "col")
    return own.join(cols, ["window_id", "col"]).select("window_id", "tile_in_window", F.expr(f"src % {tile_rows}").alias("row_in_tile"), "col_in_tile", "col", "weight")


def tiles(edges: DataFrame, cols: DataFrame, wins: DataFrame, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS) -> DataFrame:
    """(window_id, tile_id, cols, vals): columns padded with -1, values row by row with zeros."""
    cells = tile_cells(edges, cols, tile_rows).join(wins.select("window_id", "tile_start"), "window_id")
    slot = F.col("row_in_tile") * tile_cols + F.col("col_in_tile")
    placed = cells.select("window_id", (F.col("tile_start") + F.col("tile_in_window")).alias("tile_id"), "col_in_tile", slot.alias("slot"), F.col("col").cast("int").alias("col"), "weight")
    return _condensed(placed.repartition("window_id").sortWithinPartitions("tile_id"), tile_rows, tile_cols)


def block_tiles(edges: DataFrame, num_windows: int, rows: int | None = None, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS) -> DataFrame:
    """tiles() of all windows and columns: a column's rank is counted where its window's edges lie, so that they are shuffled once and joined with no columns."""
    wins = windows(window_cols(edges, tile_rows, tile_cols, rows), num_windows, tile_cols)
    own = dealt(with_window(edges, tile_rows), rows, "window_id").join(dealt(wins.select("window_id", "tile_start"), rows, "window_id"), "window_id")
    pos = (F.dense_rank().over(Window.partitionBy("window_id").orderBy("dst")) - 1).cast("bigint")
    ranked = own.withColumn("pos", pos).withColumn("col_in_tile", F.expr(f"pos % {tile_cols}"))
    slot = F.expr(f"src % {tile_rows}") * tile_cols + F.col("col_in_tile")
    placed = ranked.select("window_id", (F.col("tile_start") + F.expr(f"pos div {tile_cols}")).alias("tile_id"), "col_in_tile", slot.alias("slot"), F.col("dst").cast("int").alias("col"), "weight")
    return _condensed(placed.sortWithinPartitions("window_id", "tile_id"), tile_rows, tile_cols)


def _condensed(cells: DataFrame, tile_rows: int, tile_cols: int) -> DataFrame:
    """(window_id, tile_id, cols, vals) of cells (window_id, tile_id, col_in_tile, slot, col, weight), of which each tile's lie one after the other in one task."""
    size = tile_rows * tile_cols
    names = ["window_id", "tile_id", "col_in_tile", "slot", "col", "weight"]

    def filled(rows: pa.Table) -> pa.RecordBatch:
        window, tile, column, slot, col = (rows.column(n).to_numpy() for n in names[:5])
        first = np.flatnonzero(np.diff(tile, prepend=tile[:1] - 1))
        at = np.repeat(np.arange(len(first)), np.diff(first, append=len(tile)))
        cols, vals, seen = np.full((len(first), tile_cols), -1, np.int32), np.zeros((len(first), size), np.float32), np.zeros((len(first), size), bool)
        cols[at, column], vals[at, slot], seen[at, slot] = col, rows.column("weight").fill_null(0.0).to_numpy(), True
        if seen.sum() != len(tile):
            raise ValueError("repeated edge")
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel())) for a in (cols, vals)]
        return pa.RecordBatch.from_arrays([pa.array(window[first]), pa.array(tile[first]), *lists], names=["window_id", "tile_id", "cols", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tile may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            tile = rows.column("tile_id").to_numpy()
            last = len(tile) - int(np.argmax(tile[::-1] != tile[-1])) if tile[0] != tile[-1] else 0
            if last:
                yield filled(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield filled(held)

    return cells.select(*names).mapInArrow(run, "window_id bigint, tile_id bigint, cols array<int>, vals array<float>")


def tiles_to_edges(tiled: DataFrame, tile_rows: int = TILE_ROWS, tile_cols: int = TILE_COLS) -> DataFrame:
    """The edges that tiles hold: the inverse of tiles() for weights other than zero."""
    cells = tiled.select("window_id", "cols", F.posexplode("vals").alias("i", "weight")).where("weight <> 0")
    return cells.select((F.col("window_id") * tile_rows + F.expr(f"i div {tile_cols}")).alias("src"), F.col("cols")[F.expr(f"i % {tile_cols}").cast("int")].cast("bigint").alias("dst"), "weight").where("dst >= 0")
