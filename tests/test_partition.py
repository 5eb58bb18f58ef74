"""Packing by pointer doubling against plain folds; partitions by cut."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.operators import cut, partition
from quiltgraph.operators.ranking import shuffled
from quiltgraph.phases import Phases, phase
from quiltgraph.plans import queries


def fold_parts(loads, limit, base_step):
    """Where each part starts: one part after the other, step by step."""
    starts, at = [], 0
    while at < len(loads):
        starts.append(at)
        step, load, end = base_step, 0, at
        while end < len(loads):
            more = sum(loads[end : end + step])
            if end > at and load + more > limit:
                break
            end, load = min(end + step, len(loads)), load + more
            if load < int(0.5 * limit):
                step = min(step * 2, base_step * 4)
            elif load > int(0.85 * limit):
                step = max(step // 2, base_step // 4, 1)
            if load >= limit:
                break
        at = end
    return starts


def fold_batches(sizes, batch_size):
    out, batch, held = [], 0, 0
    for n in sizes:
        out.append(batch)
        held += n
        if held >= batch_size:
            batch, held = batch + 1, 0
    return out, batch


def test_the_plain_fold():
    assert fold_parts([8, 4, 8], 12, 1) == [0, 2]
    assert fold_parts([128 * (5 * i % 12 % 4 + 1) for i in range(12)], 1500, 2) == [0, 2, 6, 10]


def test_places_reached(spark):
    rng = np.random.default_rng(5)
    jumps = [(i, int(i + rng.integers(1, 6)) if i < 295 else None) for i in range(300)]
    want, at = [], 0
    while at is not None:
        want.append(at)
        at = jumps[at][1]
    table = spark.createDataFrame(jumps, "start bigint, next bigint").repartition(7)
    assert sorted(r["start"] for r in partition.reached_starts(table).collect()) == want
    assert [r["start"] for r in partition.reached_starts(table.limit(0)).collect()] == [0]


@pytest.mark.parametrize("limit, base, top", [(1500, 2, 5), (40_000, 10, 9), (500, 3, 40), (10**9, 4, 3)])
def test_books_equal_the_plain_fold(spark, limit, base, top):
    rng = np.random.default_rng(limit)
    loads = rng.integers(0, top, 157) * (rng.random(157) < 0.8)
    wins = spark.createDataFrame([(i * 3, int(n)) for i, n in enumerate(loads)], "window_id bigint, n_tiles bigint")
    order = [r["window_id"] for r in shuffled(wins, "window_id", 7, "p").orderBy("p").collect()]
    starts = set(fold_parts([int(loads[w // 3]) * 128 for w in order], limit, base))
    part, want = -1, {}
    for i, w in enumerate(order):
        part += i in starts
        want[w] = part
    assert {r["window_id"]: r["part_id"] for r in partition.dps_book(wins, wins, limit=limit, base_step=base).collect()} == want


@pytest.mark.parametrize("size, drop", [(50, False), (50, True), (1, False), (10_000, False), (10_000, True)])
def test_batches_equal_the_plain_fold(spark, size, drop):
    rng = np.random.default_rng(size)
    ids = [w * 16 + int(k) for w in range(90) for k in rng.permutation(16)[: rng.integers(1, 17)]]
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id bigint")
    counts = nodes.groupBy(F.expr("node_id div 16").alias("window_id")).count()
    held = shuffled(counts, "window_id", 7, "p").orderBy("p").collect()
    batches, whole = fold_batches([r["count"] for r in held], size)
    want = {r["window_id"]: b for r, b in zip(held, batches, strict=True) if not drop or b < whole}
    assert {r["window_id"]: r["batch_id"] for r in partition.window_batches(nodes, size, drop_last=drop).collect()} == want


def test_empty_books(spark):
    none = spark.createDataFrame([], "window_id bigint, n_tiles bigint")
    assert partition.dps_book(none, none, limit=10).count() == 0
    assert partition.window_batches(none.select(F.col("window_id").alias("node_id")), 5, drop_last=True).count() == 0


def crossing(pairs, part):
    return sum(part[a] != part[b] for a, b in pairs)


def parts_of(spark, pairs, n, k, shuffle=None, **options):
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    if shuffle:
        edges, nodes = edges.repartition(shuffle).union(edges.select("dst", "src")).union(edges.selectExpr("src", "src")), nodes.repartition(shuffle)
    return {r["node_id"]: r["part_id"] for r in cut.kway_parts(edges, nodes, k, **options).collect()}


def test_two_clusters_are_found_as_exhaustive_search_finds_them(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(14).tolist()
    pairs = [(names[i], names[j]) for i, j in combinations(range(14), 2) if rng.random() < (0.8 if i // 7 == j // 7 else 0.15)]
    least = min(crossing(pairs, {i: i in half for i in range(14)}) for half in map(set, combinations(range(14), 7)))
    part = parts_of(spark, pairs, 14, 2)
    assert sorted(part) == list(range(14)) and sum(part.values()) == 7
    assert crossing(pairs, part) == least
    assert parts_of(spark, pairs, 14, 2, shuffle=5) == part


def test_four_groups_by_levels(spark):
    rng = np.random.default_rng(4)
    names = rng.permutation(240).tolist()
    pairs = [(names[i], names[j]) for i, j in combinations(range(240), 2) if rng.random() < (0.2 if i // 60 == j // 60 else 0.006)]
    planted = crossing(pairs, {names[i]: i // 60 for i in range(240)})
    part = parts_of(spark, pairs, 240, 4)
    sizes = np.bincount(list(part.values()), minlength=4)
    assert sizes.min() >= 57 and sizes.max() <= 63
    assert crossing(pairs, part) <= 1.4 * planted


def test_sizes_without_edges_and_with_a_star(spark):
    assert sorted(np.bincount(list(parts_of(spark, [(0, 0)], 10, 3).values()), minlength=3)) == [3, 3, 4]
    star = parts_of(spark, [(0, i) for i in range(1, 61)], 61, 3)
    assert sorted(np.bincount(list(star.values()), minlength=3))[0] >= 19 and len(star) == 61
    assert cut.kway_parts(spark.createDataFrame([], "src bigint, dst bigint"), spark.createDataFrame([], "node_id bigint"), 2).count() == 0


def test_parts_by_chunks_are_those_by_one_task(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 70, (260, 2))]
    found, jobs = [], []
    for small, chunk, slab, cells in ((cut.SMALL, cut.CHUNK, cut.SLAB, cut.CELLS), (0, 50, 16, 3)):
        for name, value in {"SMALL": small, "CHUNK": chunk, "SLAB": slab, "CELLS": cells}.items():
            monkeypatch.setattr(cut, name, value)
        with Phases().active() as costs, phase(spark, "cut"):
            found.append(parts_of(spark, pairs, 70, 2, turns=3))
        jobs.append(costs.costs["cut"].jobs)
    assert found[0] == found[1] and len(found[0]) == 70
    assert jobs[0] < jobs[1]  # a turn of a small level is no job


def test_exchanges_by_one_task_are_those_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (130, 2))]
    for name, value in {"SMALL": 0, "CHUNK": 60, "SLAB": 16}.items():
        monkeypatch.setattr(cut, name, value)
    found, shuffled_bytes = [], []
    for most in (cut.EXCHANGED, 0):
        monkeypatch.setattr(cut, "EXCHANGED", most)
        with Phases().active() as costs, phase(spark, "cut"):
            found.append(parts_of(spark, pairs, 40, 2, turns=3))
        shuffled_bytes.append(costs.costs["cut"].shuffle_bytes)
    assert found[0] == found[1] and len(found[0]) == 40
    assert shuffled_bytes[0] < shuffled_bytes[1]


def test_hashes_are_those_of_spark(spark):
    u, v = np.array([0, 5, 1 << 40, -3]), np.array([7, 2, 9, 1 << 62])
    rows = spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "u bigint, v bigint")
    for seed in (7, -2, (1 << 31) + 5):
        assert cut.spark_hash([u, v], seed).tolist() == [r[0] for r in rows.select(F.xxhash64("u", "v", F.lit(seed))).collect()]


def test_parts_of_the_customer_graph_cut_less_than_ranges_of_an_order(spark, tiny):
    edges, nodes = queries.graphs.customer_part(spark, tiny)
    pairs = [(r["src"], r["dst"]) for r in edges.where("src < dst").collect()]
    ranges = partition.range_parts(partition.rcm_order(edges, nodes), nodes.count(), 4)
    got, other = ({r["node_id"]: r["part_id"] for r in df.collect()} for df in (queries.kway_parts(spark, tiny), ranges))
    assert max(np.bincount(list(got.values()))) <= 1.05 * 350 / 4 + 1
    assert crossing(pairs, got) < 0.85 * crossing(pairs, other)


def plain_rcm(pairs, n):
    """Reverse Cuthill-McKee node by node: components by least id, each from its least (degree, id)."""
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    deg, seen, order = {i: len(v) for i, v in near.items()}, set(), []
    for least in range(n):
        if least in seen:
            continue
        own, todo = {least}, [least]
        while todo:
            fresh = near[todo.pop()] - own
            own |= fresh
            todo += fresh
        level = [min(own, key=lambda i: (deg[i], i))]
        seen |= own
        done = set(level)
        while level:
            order += level
            place = {x: k for k, x in enumerate(level)}
            parent = {}
            for x in level:
                for y in near[x] - done:
                    parent[y] = min(parent.get(y, n), place[x])
            level = sorted(parent, key=lambda y: (parent[y], deg[y], y))
            done |= set(level)
    return {x: n - 1 - i for i, x in enumerate(order)}


def test_rcm_of_several_components_equals_the_plain_order(spark):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (70, 2))] + [(60 + i, 61 + i) for i in range(8)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")  # one direction, loops and repeats
    order = partition.rcm_order(edges, spark.range(75).withColumnRenamed("id", "node_id"))
    assert {r["old"]: r["new"] for r in order.collect()} == plain_rcm(pairs, 75)
