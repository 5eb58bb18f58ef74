"""Every registered query with SQL beside it, against DuckDB on the smallest tables."""

import os
import time

import duckdb
import pytest

from quiltgraph.operators import blocking, etl, linalg, ranking, sampling
from quiltgraph.phases import Phases, phase
from quiltgraph.plans import queries


@pytest.fixture(scope="module")
def tables(tiny):
    con = duckdb.connect()
    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tiny}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, tiny, tables, name):
    df = queries.QUERIES[name](spark, tiny)
    want = tables.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_counts_of_canonical_graphs(spark, tiny):
    edges, nodes = queries.graphs.customer_part(spark, tiny)
    assert (nodes.count(), edges.count()) == (350, 11_114)
    assert queries.topk_columns(spark, tiny).count() == 704
    edges, nodes = queries.graphs.embedding_graph(spark, tiny)
    assert (nodes.count(), edges.count()) == (500, 10_478)


def test_wide_arrays_are_summed_in_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 3, [float(i * k) for i in range(7)]) for k in range(9)], "node_id bigint, features array<double>")
    want = {k: [float(i * (3 * k + 9)) for i in range(7)] for k in range(3)}
    for size in (128, 3):
        monkeypatch.setattr(linalg, "SLICE", size)
        assert {r["node_id"]: r["features"] for r in linalg.sum_arrays(rows, "node_id", 7).collect()} == want


def test_tasks_of_the_etl_grow_with_its_rows(spark, monkeypatch):
    """However well ids compress, no task takes many more rows than its share; the edges are those of the plain definition."""
    monkeypatch.setattr(ranking, "TASK_ROWS", 500)
    nodes = spark.range(2000).withColumnRenamed("id", "node_id")
    pairs = spark.range(10_000).selectExpr("id * 7 % 2003 as src", "(id * id) % 1999 as dst")  # some ends are not in the table
    edges = etl.prepare(pairs, nodes, 10_000)
    sizes = [r["count"] for r in edges.groupBy(queries.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1500 and len(sizes) > 20
    plain = etl.sym_norm(etl.add_self_loops(etl.symmetrize(etl.drop_self_loops(pairs)), nodes), nodes)
    assert sorted(edges.collect()) == sorted(plain.collect())


def test_blocking_shuffles_by_window_for_tasks_of_its_rows(spark, monkeypatch):
    edges = spark.range(20_000).selectExpr("id % 1600 as src", "id * 7 % 1601 as dst", "cast(id % 9 + 1 as float) as weight").cache()
    cols = blocking.window_cols(edges)
    plain = blocking.tiles(edges, cols, blocking.windows(cols, 100)).collect()
    monkeypatch.setattr(ranking, "TASK_ROWS", 500)
    cols = blocking.window_cols(edges, rows=20_000)
    sizes = [r["count"] for r in cols.groupBy(queries.F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2000 and len(sizes) > 20
    tiles = blocking.block_tiles(edges, 100, 20_000)
    assert "collect_" not in tiles._jdf.queryExecution().toString()  # no maps of cells
    assert sorted(map(str, tiles.collect())) == sorted(map(str, plain))
    with pytest.raises(Exception, match="repeated edge"):
        blocking.block_tiles(edges.union(edges.limit(1)), 100, 20_001).collect()


def test_columns_are_scored_in_tasks_of_the_rows(spark, monkeypatch):
    edges = spark.range(20_000).selectExpr("id % 1600 as src", "id * 7 % 1601 as dst", "cast(id % 9 / 10 as float) as weight").cache()
    q = spark.range(1601).selectExpr("id as node_id", "cast(0.5 + id % 7 / 10 as float) as q")
    parts = q.selectExpr("node_id", "cast(node_id % 3 as int) as part_id")
    windows = spark.range(101).selectExpr("id as window_id", "cast(id % 3 as int) as part_id")
    seen = sampling.active_windows(q.where("node_id % 2 = 0"))
    local = {"hacs": queries.LOCAL, "q": q, "window_parts": windows, "node_parts": parts, "mask_rows": True}
    plain = [sampling.score_columns(edges, hacs=queries.HacsOptions(), q=q).collect(), sampling.score_columns(edges, seen, **local).collect()]
    monkeypatch.setattr(ranking, "TASK_ROWS", 500)
    for want, found in zip(plain, (sampling.score_columns(edges, hacs=queries.HacsOptions(), q=q, rows=20_000), sampling.score_columns(edges, seen, rows=20_000, **local)), strict=True):
        assert sorted(found.collect()) == sorted(want)
        sizes = [r["count"] for r in found.groupBy(queries.F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000 and len(sizes) > 20


def test_full_training_builds_its_edges_once(spark, tiny, monkeypatch):
    read = []
    monkeypatch.setattr(queries.model, "train", lambda bundle, *_, **__: read.extend([bundle.edges.inputFiles(), bundle.nodes.inputFiles()]) or [])
    queries.train_full(spark, tiny)
    assert all("/edges-" in f for f in read[0]) and all("/nodes-" in f for f in read[1])


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_probe_dealt_by_rows_is_the_same(spark, tiny, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_ROWS", 300)
    edges, windows, count = queries._by_part(spark, tiny)
    edges = edges.localCheckpoint()
    rows = edges.count()
    dealt, plain = (sampling.dps_online(edges, windows, count, rows=n) for n in (rows, None))
    for own, other in zip(dealt, plain, strict=True):
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect()))
    assert any(f", {-(-rows * most // 300)}), REPARTITION_BY_NUM" in dealt[0]._jdf.queryExecution().toString() for most in range(1, 5))


def test_sums_of_products_dealt_by_rows(spark, monkeypatch):
    """A node's sum is shuffled about once, not once for each task that has some of its edges; odd rows count as in the plain join."""
    pairs = spark.range(20_000).selectExpr("id div 100 as src", "id % 100 as dst", "cast(pmod(hash(id), 997) / 7 as float) as weight")
    nodes = spark.range(100).selectExpr("id as node_id", "transform(sequence(0, 63), i -> cast(pmod(hash(id, i), 991) / 7 as float)) as features")
    many, sums, costs = pairs.repartition(40, "dst"), [], []
    for rows in (None, 20_000):
        with Phases().active() as collected, phase(spark, "sums"):
            found = linalg.spmm_arrays(many, nodes.repartition(40, "node_id"), 64, rows).collect()
        sums.append({r["node_id"]: r["features"] for r in found})
        costs.append(collected.costs["sums"].shuffle_bytes)
    assert len(sums[1]) == 200 and all(v == pytest.approx(sums[0][k], rel=1e-12) for k, v in sums[1].items())
    assert costs[1] < costs[0] / 3

    x = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [None, 4.0, 0.5]), (2, [5.0, 6.0, 7.0]), (3, None), (4, [8.0]), (5, [float("nan"), 1.0, 9.0]), (7, [1.0, 1.0, 1.0])], "node_id bigint, features array<float>")
    odd = spark.createDataFrame([(9, 1, 2.0), (9, 2, 3.0), (8, 4, 1.0), (8, 99, 5.0), (7, 99, 1.0), (6, 5, 0.5), (1 << 40, 1, -1.0), (9, 4, 1.0), (-3, 7, 1.0), (None, 1, 1.0)], "src bigint, dst bigint, weight double")
    for held, width in ((1 << 20, 3), (2, 3), (1 << 20, 2)):
        monkeypatch.setattr(linalg, "HELD", held)
        monkeypatch.setattr(linalg, "CELLS", held)
        monkeypatch.setattr(linalg, "SUMS", held)
        plain, ours = ({r["node_id"]: str(r["features"]) for r in linalg.spmm_arrays(odd.where("src is not null"), x, width, n).collect()} for n in (None, 10))
        assert plain == ours
    assert {r["node_id"] for r in linalg.spmm_arrays(odd, x, 3, 10).collect()} == {9, 8, 6, 1 << 40, -3}
    assert linalg.spmm_arrays(odd.limit(0), x, 3, 10).count() == 0 == linalg.spmm_arrays(odd, x.limit(0), 3, 10).count()


def test_first_edges_leave_a_cut_as_it_is(spark, monkeypatch):
    rng = queries.np.random.default_rng(6)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 640, (30_000, 2))} | {(i, i) for i in range(630)} | {(5, 700), (40, 641)}
    edges = spark.createDataFrame([(a, b, float((a + b) % 9)) for a, b in pairs if a < 630], "src bigint, dst bigint, weight float").repartition(6)
    windows = spark.createDataFrame([(w % 7, w) for w in range(40)] + [(8, 3), (8, 39), (8, 3)], "part int, window_id bigint")  # a window in two parts, one row twice
    own = sampling.edges_by_part(edges, windows).cache()
    for held, ratio in ((1 << 20, 2.0), (50, 0.31), (1 << 20, 0.0)):
        monkeypatch.setattr(sampling, "HELD", held)
        fewer = sampling.first_edges(own, windows, 630, 40_000, max_external_ratio=ratio, seed=3).cache()
        found = [sampling.halos(rows, windows, 630, max_external_ratio=ratio, seed=3) for rows in (own, fewer)]
        for plain, ours in zip(*found, strict=True):
            assert sorted(plain.collect()) == sorted(ours.collect())
        assert fewer.count() < own.count() * (0.6 if held > 50 else 1)


def test_a_norm_is_computed_once_for_an_array(spark):
    wide = spark.range(40).selectExpr("id as node_id", "transform(sequence(1, 6000), i -> cast(i + id as float)) as features").cache()
    wide.count()
    began = time.perf_counter()
    found = etl.l2_normalize(wide).select(queries.F.aggregate("features", queries.F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert time.perf_counter() - began < 12  # minutes, if computed for each of the 240,000 entries
    assert [r["n"] for r in found] == pytest.approx([1.0] * 40, rel=1e-4)
