"""Raw arrays: round trips over many segments and ranges, and files that aren't as meta.json says."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.schema import GraphMeta
from quiltgraph.sources import raw


def table(spark, n):
    rows = spark.range(n).repartition(3)
    return rows.select("id", F.array(F.col("id") * 7, -F.col("id")).alias("a"), F.array((F.col("id") / 3).cast("float")).alias("b"))


@pytest.mark.parametrize("n, segment, reach", [(1000, 256 << 20, 32 << 20), (1000, 400, 100), (1, 1, 1), (0, 1, 1)])
def test_arrays_round_trip(spark, tmp_path, monkeypatch, n, segment, reach):
    monkeypatch.setattr(raw, "RANGE_BYTES", reach)
    path = f"file://{tmp_path}/x"
    df = table(spark, n)
    raw.write_arrays(df, path, "a:i8:2,b:f4:1")
    got = raw.read_arrays(spark, path)
    assert [f.name for f in got.schema] == ["id", "a", "b"]
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert sum(f.stat().st_size for f in (tmp_path / "x" / "a").glob("*.bin")) == n * 16 if n else True


def test_short_files_and_gaps_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    raw.write_arrays(table(spark, 200), path, "a:i8:2,b:f4:1")
    file = next((tmp_path / "x" / "b").glob("*.bin"))
    os.truncate(file, file.stat().st_size - 1)
    with pytest.raises(Exception, match="bytes where"):
        raw.read_arrays(spark, path).collect()
    for bad in (table(spark, 50).where("id <> 20"), table(spark, 50).union(table(spark, 5))):
        with pytest.raises(Exception, match="missing|ascending"):
            raw.write_arrays(bad, f"file://{tmp_path}/y", "a:i8:2,b:f4:1")


def test_a_blocked_matrix_is_plain_numbers(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 3, 2.0), (1, 1, 3.0), (1, 4, 4.0), (4, 2, 6.0)], "src bigint, dst bigint, weight float")
    raw.save_graph(edges, GraphMeta(6, 6, 2, 2), f"file://{tmp_path}/g")
    read = lambda name, kind: np.concatenate([np.fromfile(f, kind) for f in sorted((tmp_path / "g" / name).glob("*.bin"))])
    assert read("windows/offset", "<i8").tolist() == [0, 2, 2] and read("windows/count", "<i8").tolist() == [2, 0, 1]
    assert read("tiles/cols", "<i4").tolist() == [1, 3, 4, -1, 2, -1]
    assert read("tiles/vals", "<f4").tolist() == [1, 2, 3, 0, 0, 0, 4, 0, 6, 0, 0, 0]
    windows, tiles = raw.load_blocked(spark, f"file://{tmp_path}/g")
    assert sorted((r["window_id"], r["tile_id"]) for r in tiles.collect()) == [(0, 0), (0, 1), (2, 2)]
    assert windows.count() == 3


def test_rows_are_made_once(spark, tmp_path):
    """Writing deals rows by their numbers, not by ranges of a sample, for which the plan would run before the write as well."""
    made = spark.sparkContext.accumulator(0)

    def arrays(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(v=[[i] for i in pdf["id"]])

    rows = spark.range(0, 5000, 1, 4).mapInPandas(arrays, "id bigint, v array<bigint>")
    raw.write_arrays(rows, f"file://{tmp_path}/once", "v:i8:1")
    assert made.value == 5000
    assert sorted((r["id"], r["v"]) for r in raw.read_arrays(spark, f"file://{tmp_path}/once").collect()) == [(i, [i]) for i in range(5000)]
