"""Reordering, partitioning and batching of nodes and windows.

Sequential packing is done for all starts at once: where the next part begins
depends on where this one does and on nothing else, so the next start of every
place is computed first, and pointer doubling marks the places that are
reached from the first one (see reached_starts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.operators.components import connected_components
from quiltgraph.operators.ranking import number_by_id, number_rows, number_within, prefix_sum, shuffled
from quiltgraph.schema import TILE_ROWS
from quiltgraph.storage import StateLog, materialize, remove


def rcm_order(edges: DataFrame, nodes: DataFrame, *, log: StateLog | None = None) -> DataFrame:
    """(old, new): reverse Cuthill-McKee, of the edges in both directions.

    Components by least id; each starts at its least (degree, id) and goes
    level by level, neighbours by (place of the parent, degree, id); the whole
    order is reversed.  One join per level, which reads the edges and the last
    two levels; each level is written once and nothing is written again.  With
    the log of a run that stopped, the search goes on from its last level.
    """
    own, log = log is None, log or StateLog(edges.sparkSession)
    if not log.values:
        plain = edges.where("src <> dst").select("src", "dst")
        plain = log.keep("plain", plain.union(plain.select("dst", "src")).distinct())
        deg = nodes.select("node_id").join(plain.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("deg")), "node_id", "left").select("node_id", F.coalesce("deg", F.lit(0)).alias("deg"))
        comp = connected_components(plain.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v")))  # one way is enough
        info = log.keep("info", deg.join(comp.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id")))
        first = info.groupBy("component").agg(F.min(F.struct("deg", "node_id")).alias("s"))
        log.keep("level-0", first.select(F.col("s.node_id").alias("node_id"), "component", F.lit(0).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("place")))
        log.commit(depth=0, done=False)
    plain, info = log.get("plain"), log.get("info")
    while not log.values["done"]:
        depth = log.values["depth"]
        level = log.get(f"level-{depth}")
        found = plain.join(level.select(F.col("node_id").alias("src"), "place"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("place").alias("parent"))
        # In a symmetric graph the neighbours of a level lie in it, the one before or the next: no others need be left out.
        for known in range(max(depth - 1, 0), depth + 1):
            found = found.join(log.get(f"level-{known}").select("node_id"), "node_id", "left_anti")
        # Places follow the parents', so numbers run on within a level; components are told apart at the end.
        numbered = number_rows(found.join(info, "node_id"), F.floor(F.col("parent") / 64), ["parent", "deg", "node_id"], "place")
        after = log.keep(f"level-{depth + 1}", numbered.select("node_id", "component", F.lit(depth + 1).cast("bigint").alias("level"), F.col("place").cast("bigint").alias("place")))
        if after.isEmpty():
            log.drop(f"level-{depth + 1}")
            log.commit(done=True)
        else:
            log.commit(depth=depth + 1)
    seen = materialize(_tree_union([log.get(f"level-{k}") for k in range(log.values["depth"] + 1)]), "levels")
    if own:
        log.remove()
    n = nodes.count()
    sizes = prefix_sum(seen.groupBy("component").agg(F.count(F.lit(1)).alias("c")), "component", "c", "start")
    levels = seen.groupBy("component", "level").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("component").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = levels.withColumn("level_start", F.sum("c").over(before) - F.col("c")).drop("c")
    # A level may hold most nodes: its places, which other components may share, are numbered in buckets.
    keyed = seen.withColumn("_key", F.struct("component", "level"))
    placed = number_within(keyed, "_key", F.floor(F.col("place") / 65536), ["place"], "w").drop("_key").join(levels, ["component", "level"]).join(sizes, "component")
    return placed.select(F.col("node_id").alias("old"), (F.lit(n - 1) - F.col("start") - F.col("level_start") - F.col("w")).cast("bigint").alias("new"))


def _tree_union(tables: list[DataFrame]) -> DataFrame:
    """Their union, as a tree: thousands of tables in a row would be a plan as deep."""
    while len(tables) > 1:
        tables = [tables[i].union(tables[i + 1]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def reorder(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """The edges with both ends mapped (old, new); edges to unmapped ids drop out."""
    return edges.join(mapping.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(mapping.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def range_parts(order: DataFrame, n: int, k: int) -> DataFrame:
    """(node_id, part_id): k balanced ranges of an order (old, new)."""
    return order.select(F.col("old").alias("node_id"), F.expr(f"cast((new * {k}) div {n} as int)").alias("part_id"))


def align_pad(parts: DataFrame, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Mapping (part_id, old, new) and partitions, from (node_id, part_id).

    New ids follow the old order within a part; every part is padded to a
    multiple of tile_rows, and the next one starts there.
    """
    count = parts.groupBy("part_id").agg(F.count(F.lit(1)).alias("real_count"))
    sized = prefix_sum(count.withColumn("padded", F.expr(f"(real_count + {tile_rows - 1}) div {tile_rows} * {tile_rows}")), "part_id", "padded", "start_idx")
    partitions = sized.select("part_id", "start_idx", (F.col("start_idx") + F.col("padded")).alias("end_idx"), "real_count", (F.col("padded") - F.col("real_count")).alias("pad_count"))
    place = F.row_number().over(Window.partitionBy("part_id").orderBy("node_id")) - 1
    mapping = parts.withColumn("p", place).join(partitions, "part_id").select("part_id", F.col("node_id").alias("old"), (F.col("start_idx") + F.col("p")).alias("new"))
    return mapping, partitions


def pad_nodes(partitions: DataFrame, width: int) -> DataFrame:
    """(node_id, features, label): padding rows, features of zeros and label -1."""
    rows = partitions.where("pad_count > 0").select(F.explode(F.expr("sequence(start_idx + real_count, end_idx - 1)")).alias("node_id"))
    return rows.select("node_id", F.array_repeat(F.lit(0.0).cast("float"), width).alias("features"), F.lit(-1).cast("bigint").alias("label"))


def part_ranges(partitions: DataFrame) -> DataFrame:
    return partitions.select("part_id", "start_idx", "end_idx")


def window_parts(partitions: DataFrame, num_windows: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(window_id, part_id) for every window; -1 if no part covers it."""
    own = partitions.where("end_idx > start_idx").select("part_id", F.explode(F.expr(f"sequence(start_idx div {tile_rows}, end_idx div {tile_rows} - 1)")).alias("window_id"))
    every = partitions.sparkSession.range(num_windows).withColumnRenamed("id", "window_id")
    return every.join(own, "window_id", "left").select("window_id", F.coalesce("part_id", F.lit(-1)).cast("int").alias("part_id"))


def window_loads(windows: DataFrame, chosen: DataFrame, tile_rows: int = 16, tile_cols: int = 8) -> DataFrame:
    """One row: windows, tiles, approximate values and columns of a window set."""
    found = windows.join(chosen.select("window_id").distinct(), "window_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_tiles").alias("n_tiles"), (F.sum("n_tiles") * tile_rows * tile_cols).alias("n_values"), (F.sum("n_tiles") * tile_cols).alias("n_cols"))


def reached_starts(jumps: DataFrame, *, log: StateLog | None = None) -> DataFrame:
    """(start): the places that jumps (start, next) reach from place 0, with 0 itself.

    start: distinct; next > start, or null where there is no next.  In round k
    the table holds the 2**k-th next of each start, and what has been reached so far jumps on by as
    much: the rounds are log2 of the number of starts reached.  With the log
    of a run that stopped, it goes on from the last round.
    """
    own, log = log is None, log or StateLog(jumps.sparkSession)
    if "reached" not in log.values:
        log.keep("jumps", jumps.select("start", "next").where("next is not null"))
        log.keep("reached", jumps.sparkSession.createDataFrame([(0,)], "start bigint"))
        log.commit(reached=1, whole=False)
    while not log.values["whole"]:
        jumps, reached = log.get("jumps"), log.get("reached")
        more = log.keep("reached", reached.union(reached.join(jumps, "start").select(F.col("next").alias("start"))))
        count = more.count()
        if count > log.values["reached"]:
            on = jumps.select(F.col("start").alias("next"), F.col("next").alias("then"))
            log.keep("jumps", jumps.join(on, "next").select("start", F.col("then").alias("next")))
        log.commit(reached=count, whole=count == log.values["reached"])
    found = materialize(log.get("reached"), "reached")
    if own:
        log.remove()
    return found


def _parts_from(placed: DataFrame, starts: DataFrame, out: str) -> DataFrame:
    """(out, window_id) of placed (place, window_id): a part begins at each of starts (start), among which 0 is."""
    marked = placed.join(starts.select(F.col("start").alias("place"), F.lit(1).alias("_mark")), "place", "left")
    numbered = prefix_sum(marked.withColumn("_mark", F.coalesce("_mark", F.lit(0))), "place", "_mark", "_before")
    return numbered.select((F.col("_before") + F.col("_mark") - 1).cast("int").alias(out), "window_id")


def book_jumps(loads: DataFrame, limit: int, base_step: int) -> DataFrame:
    """(start, next): where a part ends that begins at each place; next is null at the last place's end.

    loads (place, load): 0, 1, ... in order.  A part grows by steps of places
    until it would pass the limit, and ends once it has reached it; its first
    step always goes in.  A part under half full doubles the step, one over
    85 % halves it, between a quarter and four times the base, from which each
    part starts.  All parts take their k-th step at once, as one join with the
    loads before each place; so there are as many joins as steps in the
    longest part.
    """
    summed = materialize(prefix_sum(loads.select("place", "load"), "place", "load", "_before").select("place", "load", "_before"), "loads")
    n = summed.count()
    upto = materialize(summed.select((F.col("place") + 1).alias("wanted"), (F.col("_before") + F.col("load")).alias("upto")), "upto")
    open_ = materialize(summed.select(F.col("place").alias("start"), F.col("_before").alias("base"), F.col("place").alias("end"), F.lit(base_step).alias("step")), "open")
    closed = []
    half, most, least = int(0.5 * limit), base_step * 4, max(base_step // 4, 1)
    while not open_.isEmpty():
        tried = open_.withColumn("wanted", F.least(F.col("end") + F.col("step"), F.lit(n))).join(upto, "wanted").withColumn("load", F.col("upto") - F.col("base"))
        refused = (F.col("end") > F.col("start")) & (F.col("load") > limit)
        step = F.when(F.col("load") < half, F.least(F.col("step") * 2, F.lit(most))).when(F.col("load") > int(0.85 * limit), F.greatest(F.expr("step div 2"), F.lit(least))).otherwise(F.col("step"))
        shut = refused | (F.col("load") >= limit) | (F.col("wanted") == n)
        stepped = materialize(tried.select("start", "base", F.when(refused, F.col("end")).otherwise(F.col("wanted")).alias("end"), step.cast("int").alias("step"), shut.alias("shut")), "stepped")
        closed.append(stepped)
        remove(open_)
        open_ = materialize(stepped.where("not shut").drop("shut"), "open")
    ended = reduce(DataFrame.union, [t.where("shut").select("start", "end") for t in closed], open_.select("start", "end"))
    jumps = materialize(ended.select("start", F.when(F.col("end") < n, F.col("end")).alias("next")), "book_jumps")
    remove(open_, upto, summed, *closed)
    return jumps


def dps_book(windows: DataFrame, seeds: DataFrame, *, limit: int, base_step: int = 10, cells: int = 128, seed: object = 7, log: StateLog | None = None) -> DataFrame:
    """(part_id, window_id): the windows of seeds (window_id) in shuffled order, packed by tiles * cells, see book_jumps.

    A probe of one layer reads the seed windows alone, so what a part loads is
    the sum over its windows, and the windows are what it keeps.  With the log
    of a run that stopped, it goes on from what that had written.
    """
    own, log = log is None, log or StateLog(windows.sparkSession)
    if not log.values:
        chosen = windows.join(seeds.select("window_id").distinct(), "window_id", "left_semi").select("window_id", "n_tiles")
        log.keep("placed", shuffled(chosen, "window_id", seed, "place").select(F.col("place").cast("bigint").alias("place"), "window_id", (F.col("n_tiles") * cells).cast("bigint").alias("load")))
        log.commit(placed=True)
    if "jumped" not in log.values:
        jumps = book_jumps(log.get("placed"), limit, base_step)
        log.keep("all_jumps", jumps)
        log.commit(jumped=True)
        remove(jumps)
    starts = reached_starts(log.get("all_jumps"), log=log)
    placed = materialize(log.get("placed"), "placed")
    if own:
        log.remove()
    return _parts_from(placed, starts, "part_id")


def window_batches(seeds: DataFrame, batch_size: int, *, tile_rows: int = TILE_ROWS, seed: object = 7, drop_last: bool = False) -> DataFrame:
    """(batch_id, window_id): windows of the seeds (node_id), shuffled; a batch ends once it has batch_size nodes.

    A batch that begins after s nodes ends with the window that holds node
    number s + batch_size, in the windows' order: a join on that number, with a
    row for each node, says where the next one begins.
    """
    own = seeds.groupBy(F.expr(f"node_id div {tile_rows}").alias("window_id")).agg(F.count(F.lit(1)).alias("n"))
    placed = shuffled(own, "window_id", seed, "place").select(F.col("place").cast("bigint").alias("place"), "window_id", "n")
    placed = materialize(prefix_sum(placed, "place", "n", "before"), "placed")
    holds = placed.select(F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("number"), (F.col("place") + 1).alias("next"))
    jumps = placed.select(F.col("place").alias("start"), (F.col("before") + batch_size).alias("number")).join(holds, "number", "left")
    starts = reached_starts(jumps.where(F.col("next") < placed.count()))
    if drop_last:
        last = starts.agg(F.max("start")).first()[0]
        if (placed.where(F.col("place") >= last).agg(F.sum("n")).first()[0] or 0) < batch_size:
            placed = placed.where(F.col("place") < last)
    return _parts_from(placed.select("place", "window_id"), starts, "batch_id")


def mega_batches(ids: DataFrame, batch_size: int, factor: int = 50, seed: object = 7) -> DataFrame:
    """(batch_id, node_id): shuffled, pooled by factor * batch_size, sorted in the pool and sliced."""
    pooled = shuffled(ids, "node_id", seed, "r").withColumn("pool", F.expr(f"r div {factor * batch_size}"))
    place = F.row_number().over(Window.partitionBy("pool").orderBy("node_id")) - 1
    return pooled.withColumn("p", place).select((F.col("pool") * factor + F.expr(f"p div {batch_size}")).alias("batch_id"), "node_id")


def partition_batches(partitions: DataFrame, batch_size: int = 10, seed: object = 7) -> DataFrame:
    """(batch_id, part_id): consecutive parts in chunks, the chunks shuffled."""
    placed = number_by_id(partitions.select("part_id"), "part_id", "p").withColumn("chunk", F.expr(f"p div {batch_size}"))
    chunks = shuffled(placed.select("chunk").distinct(), "chunk", seed, "batch_id")
    return placed.join(chunks, "chunk").select("batch_id", "part_id")


def eval_book(ids: DataFrame, average: int = 1024, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(part_id, window_id): the distinct windows of ids, sorted, in chunks of the average training part."""
    wins = ids.select(F.expr(f"node_id div {tile_rows}").alias("window_id")).distinct()
    return number_by_id(wins, "window_id", "p").select(F.expr(f"p div {max(1, average)}").alias("part_id"), "window_id")


def resolve_mode(mode: str) -> str:
    """The reordering that a training mode asks for."""
    try:
        return {"BAPS": "metis+rcm", "NODE": "rcm", "FULL": "rcm", "DPS": "none"}[mode.upper()]
    except KeyError:
        raise ValueError(f"unknown mode {mode!r}: BAPS, node, full or DPS") from None


def split_masks(nodes: DataFrame, ids: dict[str, DataFrame]) -> DataFrame:
    """node_id with a boolean column NAME_mask for each id table (node_id)."""
    out = nodes.select("node_id")
    for name, own in ids.items():
        out = out.join(own.select("node_id").distinct().withColumn(f"{name}_mask", F.lit(True)), "node_id", "left").fillna(False, [f"{name}_mask"])
    return out
