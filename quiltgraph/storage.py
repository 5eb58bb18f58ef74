"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Where a local session names none (tests on one machine) a temporary folder
    is set as the checkpoint folder once and used from then on.  On a cluster
    there is no such folder, so a session that names none is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quiltgraph-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it: lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path there, for tasks; Hadoop writes file:/ for file:///."""
    return pafs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file:///") else path)


def remove(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads, divided ones too."""
    for df in tables:
        for folder in {re.sub(r"(/[^/=]+=[^/]*)+$", "", f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
            remove_path(df.sparkSession, folder)


class StateLog:
    """The state of a long job in a folder: tables, and values that JSON holds, by versions.

    keep writes a table, commit makes what has been kept since part of the
    state: its manifest is written aside and renamed, so a version is there
    whole or not at all.  A job that is given the folder of one that stopped
    finds the last version's values and tables and goes on from there.  What a
    version no longer names is deleted once it is committed.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_path(spark, "state")
        self.version, self.values, self.tables = 0, {}, {}
        for version in sorted(self._versions(), reverse=True)[:1]:
            text = spark.read.option("wholetext", True).text(f"{self.folder}/manifest-{version:09d}.json").first()[0]
            found = json.loads(text)
            self.version, self.values, self.tables = version, found["values"], found["tables"]

    def _system(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, files = self._system(self.folder)
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return [int(n[9:18]) for n in names if re.fullmatch(r"manifest-\d{9}\.json", n)]

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write a table under a name, in place of what has it, and return a reader of it."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.tables[name] = {"path": path, "schema": df.schema.json()}
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.tables[name]["schema"]))
        return self.spark.read.schema(schema).parquet(self.tables[name]["path"])

    def drop(self, *names: str) -> None:
        for name in names:
            self.tables.pop(name)

    def commit(self, **values) -> None:
        """The next version: these values besides the earlier ones, and the tables that are kept."""
        self.values |= values
        before, self.version = self.version, self.version + 1
        aside, files = self._system(f"{self.folder}/.{uuid.uuid4().hex}")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps({"values": self.values, "tables": self.tables}).encode()))
        out.close()
        if not files.rename(aside, self._system(f"{self.folder}/manifest-{self.version:09d}.json")[0]):
            raise OSError(f"version {self.version} is there already: {self.folder}")
        named = {t["path"].rsplit("/", 1)[1] for t in self.tables.values()}
        for f in files.listStatus(self._system(self.folder)[0]):
            name = f.getPath().getName()
            if (f.isDirectory() and name not in named) or name == f"manifest-{before:09d}.json":
                files.delete(f.getPath(), True)

    def remove(self) -> None:
        remove_path(self.spark, self.folder)
