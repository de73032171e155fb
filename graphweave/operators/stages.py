"""A store of stage tables: every stage is written once under a name made of what it comes from.

A stage's key is a hash of its name, its version, its parameters and the keys of its inputs; that
of a source is a hash of its files' paths, sizes and times.  The manifest (inputs, parameters,
schema, rows, bytes) is written after the data, so a stage that was cut off has none and is made
again; its data folder has a name of its own, so two runs at once don't write into each other.
A second run with equal inputs reads all stages, and one with a changed parameter makes only
what depends on it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Stage:
    name: str
    key: str
    table: DataFrame


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


class StageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.made: list[str] = []
        self.read: list[str] = []
        self.used: dict[str, set[str]] = {}

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def source(self, name: str, table: DataFrame) -> Stage:
        """A table that is read from files, known by their paths, sizes and times."""
        files = []
        for f in sorted(table.inputFiles()):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            status = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
            files.append([f, status.getLen(), status.getModificationTime()])
        return Stage(name, _digest(name, table.schema.simpleString(), files), table)

    def passing(self, name: str, table: DataFrame, inputs: Iterable[Stage]) -> Stage:
        """A table that isn't stored, as one stage alone reads it; known by its inputs."""
        return Stage(name, _digest(name, [i.key for i in inputs]), table)

    def manifest(self, name: str, key: str) -> dict | None:
        path, fs = self._path(name, key, "manifest.json")
        if not fs.exists(path):
            return None
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def stage(self, name: str, make: Callable[[], DataFrame], inputs: Iterable[Stage] = (), version: int = 1, **parameters) -> Stage:
        """The stage's table: read if it was made of the same, else made by ``make`` and written."""
        inputs = list(inputs)
        key = _digest(name, version, parameters, [i.key for i in inputs])
        self.used.setdefault(name, set()).add(key)
        known = self.manifest(name, key)
        if known is None:
            rows = make()
            folder = f"data-{uuid.uuid4().hex}"
            place = "/".join([self.root, name, key, folder])
            rows.write.parquet(place)
            back = self.spark.read.schema(rows.schema).parquet(place)
            data, fs = self._path(name, key, folder)
            known = {"name": name, "version": version, "parameters": json.loads(json.dumps(parameters, default=str)), "inputs": {i.name: i.key for i in inputs}, "schema": json.loads(rows.schema.json()), "rows": back.count(), "bytes": fs.getContentSummary(data).getLength(), "data": folder}
            path, fs = self._path(name, key, "manifest.json")
            out = fs.create(path, True)
            out.write(bytearray(json.dumps(known, indent=1).encode()))
            out.close()
            self.made.append(name)
        else:
            self.read.append(name)
        table = self.spark.read.schema(StructType.fromJson(known["schema"])).parquet("/".join([self.root, name, key, known["data"]]))
        return Stage(name, key, table)

    def clean(self) -> list[str]:
        """Delete what this run didn't use of the stages that it has: other versions, and data that no manifest names; the folders' names."""
        gone = []
        for name, keys in self.used.items():
            path, fs = self._path(name)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                key = status.getPath().getName()
                if key not in keys:
                    fs.delete(status.getPath(), True)
                    gone.append(f"{name}/{key}")
                    continue
                known = self.manifest(name, key)
                for part in fs.listStatus(status.getPath()):
                    own = part.getPath().getName()
                    if own != "manifest.json" and (known is None or own != known["data"]):
                        fs.delete(part.getPath(), True)
                        gone.append(f"{name}/{key}/{own}")
        return sorted(gone)
