"""Fixed-width arrays in raw files, and the blocked matrix in them.

Each field is a folder of segments, files of little-endian numbers and nothing
else, named by the first row that they hold.  A row's bytes follow from its
number, so readers take byte ranges.  meta.json, written last, has the fields,
the number of rows and each segment's rows; sizes are checked against it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quiltgraph.operators import blocking
from quiltgraph.schema import GraphMeta

#: Bytes of a row range that one task reads, and of a segment that one writes before it begins another.
RANGE_BYTES, SEGMENT_BYTES = 32 << 20, 256 << 20
KINDS = {"i8": "bigint", "i4": "int", "f4": "float", "f8": "double"}


@dataclass(frozen=True)
class Field:
    """Rows of ``width`` numbers of a kind such as i4."""

    name: str
    kind: str
    width: int

    @property
    def bytes(self) -> int:
        return np.dtype(self.kind).itemsize * self.width


def _fields(text: str) -> list[Field]:
    """name:kind:width, comma-separated."""
    return [Field(n, k, int(w)) for n, k, w in (f.split(":") for f in text.split(","))]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there; Hadoop writes file:/ for file:///."""
    return pafs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file:///") else path)


@dataclass
class Written(WriterCommitMessage):
    segments: list[tuple[int, int]]


@dataclass
class Range(InputPartition):
    """Rows [first, last) of the segment that starts at a row."""

    segment: int
    first: int
    last: int


class RawWriter(DataSourceArrowWriter):
    """Each task writes its rows, which come in ascending order of id, to segments of its own; a task that runs again writes the same bytes."""

    def __init__(self, options: dict):
        self.path, self.fields = options["path"], _fields(options["fields"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = _store(self.path)
        segments: list[list[int]] = []
        streams: list = []
        size = sum(f.bytes for f in self.fields)
        for batch in iterator:
            ids = batch.column("id").to_numpy()
            columns = [batch.column(f.name).flatten().to_numpy(zero_copy_only=False).astype(f"<{f.kind}").reshape(len(ids), f.width) for f in self.fields]
            # Runs of consecutive rows.
            cuts = [0, *(np.flatnonzero(np.diff(ids) != 1) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                follows = segments and segments[-1][1] == ids[a] and (segments[-1][1] - segments[-1][0]) * size < SEGMENT_BYTES
                if not follows:
                    if segments and ids[a] < segments[-1][1]:
                        raise ValueError("rows must come in ascending order of id, each once")
                    for s in streams:
                        s.close()
                    for f in self.fields:
                        files.create_dir(f"{path}/{f.name}", recursive=True)
                    streams = [files.open_output_stream(f"{path}/{f.name}/{ids[a]:015d}.bin") for f in self.fields]
                    segments.append([int(ids[a]), int(ids[a])])
                for s, column in zip(streams, columns, strict=True):
                    s.write(np.ascontiguousarray(column[a:b]).tobytes())
                segments[-1][1] += b - a
        for s in streams:
            s.close()
        return Written([(a, b) for a, b in segments])

    def commit(self, messages: list[Written | None]) -> None:
        found = sorted(s for m in messages if m for s in m.segments)
        rows = 0
        for first, last in found:
            if first != rows:
                raise ValueError(f"rows {rows} to {first} are missing or there twice")
            rows = last
        files, path = _store(self.path)
        files.create_dir(path, recursive=True)
        meta = {"rows": rows, "fields": [[f.name, f.kind, f.width] for f in self.fields], "segments": found}
        with files.open_output_stream(f"{path}/meta.json") as out:
            out.write(json.dumps(meta).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without meta.json nothing is read; another write takes the segments' places."""


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        files, path = _store(self.path)
        with files.open_input_stream(f"{path}/meta.json") as f:
            meta = json.loads(f.read())
        self.fields, self.segments, self.rows = [Field(*f) for f in meta["fields"]], meta["segments"], meta["rows"]

    def partitions(self) -> list[Range]:
        """Ranges of RANGE_BYTES, after each segment's size has been compared with its rows."""
        files, path = _store(self.path)
        for f in self.fields:
            found = files.get_file_info([f"{path}/{f.name}/{first:015d}.bin" for first, _ in self.segments])
            for info, (first, last) in zip(found, self.segments, strict=True):
                if info.size != (last - first) * f.bytes:
                    raise ValueError(f"{info.path} has {info.size} bytes where {(last - first) * f.bytes} are due")
        each = max(1, RANGE_BYTES // sum(f.bytes for f in self.fields))
        return [Range(first, a, min(last, a + each)) for first, last in self.segments for a in range(first, last, each)] or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, path = _store(self.path)
        step = 1 << 14
        for a in range(partition.first, partition.last, step):
            n, columns = min(step, partition.last - a), []
            for f in self.fields:
                with files.open_input_file(f"{path}/{f.name}/{partition.segment:015d}.bin") as source:
                    data = source.read_at(n * f.bytes, (a - partition.segment) * f.bytes)
                values = pa.array(np.frombuffer(data, f"<{f.kind}"))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * f.width), values))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *columns], names=["id", *[f.name for f in self.fields]])


class RawArrays(DataSource):
    """spark.read.format("raw_arrays").load(path): (id, a column of arrays for each field)."""

    @classmethod
    def name(cls) -> str:
        return "raw_arrays"

    def schema(self) -> str:
        fields = RawReader(self.options).fields
        return ", ".join(["id bigint", *[f"{f.name} array<{KINDS[f.kind]}>" for f in fields]])

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


def write_arrays(rows: DataFrame, path: str, fields: str) -> None:
    """rows (id, a column of arrays for each field): ids are 0, 1, ... without gaps; fields as name:kind:width, comma-separated."""
    rows.sparkSession.dataSource.register(RawArrays)
    names = [f.name for f in _fields(fields)]
    # Runs of RANGE_BYTES go to a task each.  Ranges by samples would make the rows twice.
    run = max(1, RANGE_BYTES // sum(f.bytes for f in _fields(fields)))
    dealt = rows.select("id", *names).repartition(F.expr(f"id div {run}")).sortWithinPartitions("id")
    dealt.write.format("raw_arrays").option("fields", fields).mode("append").save(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RawArrays)
    return spark.read.format("raw_arrays").load(path)


def save_blocked(windows: DataFrame, tiles: DataFrame, meta: GraphMeta, path: str) -> None:
    """The blocked matrix as three arrays: where each window's tiles start, and each tile's columns and values."""
    write_arrays(windows.select(F.col("window_id").alias("id"), F.array("tile_start").alias("offset"), F.array("n_tiles").alias("count")), f"{path}/windows", "offset:i8:1,count:i8:1")
    write_arrays(tiles.select(F.col("tile_id").alias("id"), "cols", "vals"), f"{path}/tiles", f"cols:i4:{meta.tile_cols},vals:f4:{meta.tile_rows * meta.tile_cols}")


def load_blocked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """windows (window_id, n_tiles, tile_start) and tiles (window_id, tile_id, cols, vals)."""
    windows = read_arrays(spark, f"{path}/windows").select(F.col("id").alias("window_id"), F.col("count")[0].alias("n_tiles"), F.col("offset")[0].alias("tile_start"))
    of = windows.where("n_tiles > 0").select("window_id", F.explode(F.sequence(F.col("tile_start"), F.col("tile_start") + F.col("n_tiles") - 1)).alias("tile_id"))
    tiles = read_arrays(spark, f"{path}/tiles").withColumnRenamed("id", "tile_id").join(of, "tile_id")
    return windows, tiles.select("window_id", "tile_id", "cols", "vals")


def save_graph(edges: DataFrame, meta: GraphMeta, path: str) -> None:
    rows = edges.count()
    windows = blocking.windows(blocking.window_cols(edges, meta.tile_rows, meta.tile_cols, rows), meta.num_windows, meta.tile_cols)
    save_blocked(windows, blocking.block_tiles(edges, meta.num_windows, rows, meta.tile_rows, meta.tile_cols), meta, path)
