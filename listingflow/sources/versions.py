"""Versions of a registry: changes and snapshots as folders, and a log of what is complete.

A change is written first and then entered in the log under the next free number; the entry's file is renamed into its place,
which fails if another writer took the number, who is then followed by the next.  So a writer that dies leaves a
folder that no entry names.  A version is the last snapshot up to it, and the changes since.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow import schemas

ADMITS = "_admits"


class _Folder:
    """The log's folder through Hadoop's file systems, which know every kind of path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.log = self._path(f"{path}/log")
        self.fs = self.log.getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def entries(self) -> dict[int, dict]:
        if not self.fs.exists(self.log):
            return {}
        found = {}
        for status in self.fs.listStatus(self.log):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                stream = self.fs.open(status.getPath())
                try:
                    found[int(name[:-5])] = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return dict(sorted(found.items()))

    def enter(self, entry: dict) -> int:
        """Gives ``entry`` the next free number."""
        self.fs.mkdirs(self.log)
        draft = self._path(f"{self.log.toString()}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.log.toUri(), self.conf)
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        number = max(self.entries(), default=0) + 1
        while True:
            try:
                context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self._path(f"{self.log.toString()}/{number:08d}.json")), plain)
                return number
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
                number += 1


def commit(spark: SparkSession, path: str, admitted: DataFrame | None = None, removed: DataFrame | None = None) -> int:
    """Enters ``admitted`` entries and the ``listingId`` of ``removed`` ones as a new version and returns its number.

    An id admitted again takes the place of its entry; one that is removed and admitted by one change is there
    afterwards.  Rows without an id are left out.
    """
    parts = []
    if admitted is not None:
        parts.append(admitted.select(*[F.col(f.name).cast(f.dataType) for f in schemas.REGISTRY]).withColumn(ADMITS, F.lit(True)))
    if removed is not None:
        parts.append(removed.select(F.col("listingId").cast("string").alias("listingId"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.REGISTRY if f.name != "listingId"], F.lit(False).alias(ADMITS)))
    if not parts:
        raise ValueError("nothing to commit")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    folder = f"changes-{uuid.uuid4().hex}"
    rows.where("listingId is not null").write.parquet(f"{path}/{folder}")
    return _Folder(spark, path).enter({"kind": "changes", "folder": folder})


def compact(spark: SparkSession, path: str) -> int:
    """Writes the present version as a snapshot, from which later readings start; changes made meanwhile stay changes."""
    upto = max(versions(spark, path), default=0)
    folder = f"snapshot-{uuid.uuid4().hex}"
    read_version(spark, path, upto).withColumn(ADMITS, F.lit(True)).write.parquet(f"{path}/{folder}")
    return _Folder(spark, path).enter({"kind": "snapshot", "folder": folder, "upto": upto})


def versions(spark: SparkSession, path: str) -> list[int]:
    return list(_Folder(spark, path).entries())


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The registry as of ``version``, or of the last one; empty before the first."""
    entries = {v: e for v, e in _Folder(spark, path).entries().items() if version is None or v <= version}
    base = max((v for v, e in entries.items() if e["kind"] == "snapshot"), default=None)
    upto = entries[base]["upto"] if base else 0
    used = {e["folder"]: v for v, e in entries.items() if e["kind"] == "changes" and v > upto} | ({entries[base]["folder"]: upto} if base else {})
    if not used:
        return spark.createDataFrame([], schemas.REGISTRY)
    kind = schemas.REGISTRY.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    rows = spark.read.schema(f"{kind}, {ADMITS} boolean").parquet(*[f"{path}/{f}" for f in used])
    numbers = spark.createDataFrame(list(used.items()), "_folder string, _version long")  # a row for each change since the snapshot
    rows = rows.withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(numbers), "_folder")
    last = rows.groupBy("listingId").agg(F.max_by(F.struct(*schemas.REGISTRY.names, ADMITS), F.struct("_version", ADMITS)).alias("e"))
    return last.where(f"e.{ADMITS}").select(*[F.col(f"e.{n}").alias(n) for n in schemas.REGISTRY.names])
