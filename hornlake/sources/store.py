"""Tables of Parquet parts under manifests, and materialised intermediates in the cluster's shared folder."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Only for local sessions that name no shared folder.
LOCAL_FALLBACK = "/tmp/checkpoints/hornlake"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a cluster must name one, as its machines share no folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return LOCAL_FALLBACK


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str = "facts") -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    """Tables as folders of Parquet parts under root. A commit names, in one numbered manifest, the parts of every table.

    Parts are written first and count once a manifest names them, so a commit of several tables is seen whole or not at
    all, and an append writes its own rows only. Two writers cannot commit the same number. Parts that no manifest of
    the last `keep_seconds` names are deleted by vacuum(), so that frames read before stay readable.
    """

    #: Parts of a table before an append puts them together.
    MOST_PARTS = 64

    def __init__(self, spark: SparkSession, root: str, partitions: Mapping[str, str] | None = None):
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), dict(partitions or {})

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[tuple[int, int]]:
        """(number, time in milliseconds) of each manifest, in order."""
        fs, folder = self._fs(), self._path(f"{self.root}/_manifests")
        if not fs.exists(folder):
            return []
        found = [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(folder)]
        return sorted((int(name.removesuffix(".json")), at) for name, at in found if name.endswith(".json"))

    def _read(self, number: int) -> dict[str, dict]:
        stream = self._fs().open(self._path(f"{self.root}/_manifests/{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, dict]]:
        """(number of the last commit, {table: version and parts}); 0 and nothing before the first."""
        manifests = self._manifests()
        return (manifests[-1][0], self._read(manifests[-1][0])) if manifests else (0, {})

    def version(self, name: str) -> int:
        return self.current()[1].get(name, {"version": 0})["version"]

    def _frame(self, parts: list[str], ddl) -> DataFrame:
        base = f"{self.root}/{parts[0].split('/')[0]}"
        return self.spark.read.schema(ddl).option("basePath", base).parquet(*[f"{self.root}/{p}" for p in parts]).drop("part")

    def read(self, name: str, ddl: str) -> DataFrame:
        """The table as of the last commit, empty with the schema if there is none."""
        held = self.current()[1].get(name)
        return self._frame(held["parts"], ddl) if held else self.spark.createDataFrame([], ddl)

    def _write(self, name: str, df: DataFrame) -> str:
        """A new part; rows of a partition are spread by size, so none lands in one task."""
        part, by = f"{name}/part=p{uuid.uuid4().hex[:16]}", self.partitions.get(name)
        writer = (df if by is None else df.hint("rebalance", by)).write
        (writer if by is None else writer.partitionBy(by)).parquet(f"{self.root}/{part}")
        return part

    def commit(self, replaced: Mapping[str, DataFrame] | None = None, appended: Mapping[str, DataFrame] | None = None) -> int:
        """Replace some tables and append to others, at once; the commit's number. RuntimeError if another writer came first."""
        number, tables = self.current()
        for name, df in (replaced or {}).items():
            tables[name] = {"version": tables.get(name, {"version": 0})["version"] + 1, "parts": [self._write(name, df)]}
        for name, df in (appended or {}).items():
            held = tables.get(name, {"version": 0, "parts": []})
            parts = [*held["parts"], self._write(name, df)]
            if len(parts) > self.MOST_PARTS:
                parts = [self._write(name, self._frame(parts, df.schema))]
            tables[name] = {"version": held["version"] + 1, "parts": parts}
        fs, text = self._fs(), json.dumps(tables)
        draft, final = self._path(f"{self.root}/_manifests/{uuid.uuid4().hex}.tmp"), self._path(f"{self.root}/_manifests/{number + 1}.json")
        out = fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made commit {number + 1}")
        return number + 1

    def vacuum(self, keep_seconds: float = 86_400.0) -> list[str]:
        """Delete manifests older than keep_seconds but the last, and parts that no other names; the parts deleted."""
        fs, manifests = self._fs(), self._manifests()
        if not manifests:
            return []
        limit = time.time() * 1000 - keep_seconds * 1000
        stay = [n for n, at in manifests if at >= limit or n == manifests[-1][0]]
        named = {p for n in stay for held in self._read(n).values() for p in held["parts"]}
        gone = []
        for table in fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            if name != "_manifests" and table.isDirectory():
                for part in fs.listStatus(table.getPath()):
                    path = f"{name}/{part.getPath().getName()}"
                    if path not in named and part.getModificationTime() < limit:
                        fs.delete(part.getPath(), True)
                        gone.append(path)
        for n, _ in manifests:
            if n not in stay:
                fs.delete(self._path(f"{self.root}/_manifests/{n}.json"), False)
        return gone
