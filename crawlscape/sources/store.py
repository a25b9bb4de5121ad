"""Durable state as generations: a snapshot table and a log of changes, committed by numbered pointer files.

A commit writes ``CURRENT-<n>``, one above the highest, without overwriting, with a
checksum of its contents; the highest whole one is in force. A crash while it is
written leaves a pointer that doesn't check, and the one before stays in force.
Older pointers, and the files that only they name, go later. A generation that was
written but not committed is ignored. The log is a set of Parquet batches numbered
by the LSN they begin with; recovery applies what is newer than the snapshot, last
writer wins.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.placement import replica


class Store:
    def __init__(self, spark: SparkSession, root: str, key: str, schema: str):
        """``schema``: columns of a row with its ``key``, which may be any type."""
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of all pointers, whole or not, highest first."""
        path, fs = self._path("")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted((int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-")), reverse=True)

    def _read(self, number: int) -> dict | None:
        path, fs = self._path(f"CURRENT-{number:020d}")
        stream = fs.open(path)
        try:
            said = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        checksum, _, body = said.partition("\n")
        return json.loads(body) if checksum == hashlib.sha256(body.encode()).hexdigest() else None

    def _pointer(self) -> dict:
        for number in self._numbers():
            if (found := self._read(number)) is not None:
                return found
        return {"generation": None, "lsn": -1, "log": []}

    def _commit(self, pointer: dict) -> None:
        """One new file; two writers at once can't both create it, so that one of them fails."""
        body = json.dumps(pointer)
        path, fs = self._path(f"CURRENT-{max(self._numbers(), default=0) + 1:020d}")
        out = fs.create(path, False)
        try:
            out.write(bytearray(f"{hashlib.sha256(body.encode()).hexdigest()}\n{body}".encode()))
        finally:
            out.close()

    def tidy(self, keep: int = 2) -> None:
        """Removes pointers older than the ``keep`` newest whole ones, and the files that none of those names."""
        whole = [(n, p) for n in self._numbers() if (p := self._read(n)) is not None][:keep]
        if not whole:
            return
        named = {x for _, p in whole for x in (*p["log"], p["generation"])}
        for folder in ("log", "gen"):
            path, fs = self._path(folder)
            for name in [f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(path)] if fs.exists(path) else []:
                if name not in named:
                    fs.delete(self._path(name)[0], True)
        for n in self._numbers():
            if n < whole[-1][0]:
                path, fs = self._path(f"CURRENT-{n:020d}")
                fs.delete(path, False)

    def append(self, changes: DataFrame) -> int:
        """Adds puts and deletes (``lsn``, ``op``, columns) to the log; returns the highest LSN."""
        pointer = self._pointer()
        name = f"log/{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.root}/{name}", compression="zstd")
        top = self.spark.read.parquet(f"{self.root}/{name}").agg(F.max("lsn")).head()[0]
        self._commit(pointer | {"log": [*pointer["log"], name], "lsn": max(pointer["lsn"], -1 if top is None else top)})
        return self._pointer()["lsn"]

    def rows(self) -> DataFrame:
        """The current state: snapshot and log."""
        pointer = self._pointer()
        empty = self.spark.createDataFrame([], self.schema)
        snapshot = self.spark.read.schema(self.schema).parquet(f"{self.root}/{pointer['generation']}") if pointer["generation"] else empty
        if not pointer["log"]:
            return snapshot
        tail = self.spark.read.schema(f"lsn BIGINT, op STRING, {self.schema}").parquet(*[f"{self.root}/{n}" for n in pointer["log"]])
        return replica(snapshot, tail, self.key, applied=-1)

    def get(self, keys: DataFrame) -> DataFrame:
        return self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi")

    def checkpoint(self) -> str:
        """Folds the log into a new generation; what no kept pointer names goes once the new one stands."""
        old = self._pointer()
        name = f"gen/{uuid.uuid4().hex}"
        self.rows().write.parquet(f"{self.root}/{name}", compression="zstd")
        self._commit({"generation": name, "lsn": old["lsn"], "log": []})
        self.tidy()
        return name


class Collection:
    """Partitions of a fleet behind one manifest, which routes keys without opening files."""

    def __init__(self, manifest: DataFrame):
        self.manifest = manifest

    def route(self, rows: DataFrame, key):
        from ..operators.placement import route

        return route(rows, key, self.manifest)

    def open(self, spark: SparkSession, root: str, partition_id: int) -> DataFrame:
        return spark.read.parquet(f"{root}/partition_id={partition_id}")
