"""What several operators share: table access, byte tables, mapping over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Maps bytes A-Z to a-z and leaves all others, those of longer characters too.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Lower-cases A-Z and makes every ASCII byte but a-z and 0-9 a space.  Lengths
#: stay, so an offset in the result is an offset in the original.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there; Hadoop writes file:/ for file:///."""
    return pafs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file:///") else path)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null gives empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, columns: list, schema: str, rows: Callable[[pa.RecordBatch], pa.RecordBatch | dict]) -> DataFrame:
    """mapInArrow over the chosen columns, one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return df.select(*columns).mapInArrow(run, schema)


def filter_batches(df: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Rows whose text passes, with all their columns as they are."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(utf8(batch.column(at))), pa.bool_()))

    return df.mapInArrow(run, df.schema)
