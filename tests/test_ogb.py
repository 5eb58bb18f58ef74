"""The layout in which a node's id is its line number, and tables under other names."""

import gzip

import pytest

from quiltgraph.sources import graphs, ogb


def put(path, name, text):
    file = path / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(gzip.compress(text.encode()))


def test_lines_of_many_files_in_order(spark, tmp_path):
    want, n = [], 0
    for k in range(23):
        lines = [f"{k}-{i}" for i in range(k * 37 % 50)] + ([""] if k % 4 == 0 else [])
        put(tmp_path, f"part-{k:03d}.gz", "".join(f"{x}\n" for x in lines))
        want += lines
    got = ogb.numbered_lines(spark, f"file://{tmp_path}").collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["line"])] == want
    assert sorted(r["line"] for r in got) == list(range(len(want)))


@pytest.mark.parametrize("multi", [False, True])
def test_files_of_one_graph(spark, tmp_path, multi):
    put(tmp_path, "raw/edge.csv.gz", "0,1\n1,2\n1,0\n3,3\n")
    put(tmp_path, "raw/node-feat.csv.gz", "0.5,1\n-2,3e-3\n4,5\n6,7\n")
    put(tmp_path, "other/labels.csv.gz", "1,0\n0,0\n1,1\n0,1\n" if multi else "2\n0\nnan\n1\n")
    for name, ids in (("train", "0\n3\n"), ("valid", "1\n"), ("test", "")):
        put(tmp_path, f"split/time/{name}.csv.gz", ids)
    bundle = graphs.load(spark, {"source": "ogb", "path": f"file://{tmp_path}", "scheme": "time", "files": {"labels": "other/labels.csv.gz"}})
    rows = {r["node_id"]: r for r in bundle.nodes.collect()}
    assert [list(rows[i]["features"]) for i in range(4)] == [[0.5, 1], [-2, pytest.approx(0.003)], [4, 5], [6, 7]]
    assert [rows[i]["split"] for i in range(4)] == ["train", "val", None, "train"]
    assert bundle.multi_label == multi
    assert [rows[i]["labels"] if multi else rows[i]["label"] for i in range(4)] == ([[1, 0], [0, 0], [1, 1], [0, 1]] if multi else [2, 0, -1, 1])
    assert sorted((r["src"], r["dst"]) for r in bundle.edges.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    directed = ogb.from_ogb(spark, f"file://{tmp_path}", scheme="time", files={"labels": "other/labels.csv.gz"}, directed=True)
    assert sorted((r["src"], r["dst"]) for r in directed.edges.collect()) == [(0, 1), (1, 0), (1, 2), (3, 3)]


def test_tables_under_other_names(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 0)], "id bigint, feat array<float>, y bigint").write.parquet(f"{path}/nodes")
    spark.createDataFrame([(0, 1)], "a bigint, b bigint").write.parquet(f"{path}/edges")
    bundle = graphs.load(spark, {"source": "tables", "path": path, "keys": {"node_id": "id", "features": "feat", "label": "y", "src": "a", "dst": "b"}})
    assert {r["node_id"]: (list(r["features"]), r["label"]) for r in bundle.nodes.collect()} == {0: ([1.0], 1), 1: ([2.0], 0)}
    assert bundle.edges.count() == 4 and bundle.num_classes == 2
