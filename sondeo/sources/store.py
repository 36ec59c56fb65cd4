"""A keyed store that grows over runs: Parquet generations, each made visible by one commit.

A run writes its rows into a folder of their own and then creates the next numbered commit
file, which names that folder.  Creating a file that must not exist yet is atomic, so of two
writers one goes first and the other takes the next number, and a run that ends before its
commit leaves nothing that a reader sees.  Of rows with equal keys the last generation's counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import record_batch, slices


class Store:
    """Rows with the columns of ``ddl`` under ``path``, of which ``key`` names one."""

    def __init__(self, spark: SparkSession, path: str, key: str, ddl: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], ddl).schema

    def _at(self, *parts: str):
        """A path of the store, and the file system that it is on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[tuple[int, dict]]:
        """The commits in order: number, and what it says.  There is one for each run."""
        folder, fs = self._at("commits")
        if not fs.exists(folder):
            return []
        files = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        out = []
        for name in (f for f in files if f.endswith(".json")):
            stream = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(fs.open(self._at("commits", name)[0]), "UTF-8"))
            try:
                line = stream.readLine()
            finally:
                stream.close()
            if line:  # an empty file: its writer died while creating it, so nothing was promised
                out.append((int(name.split(".")[0]), json.loads(line)))
        return out

    def _commit(self, said: dict) -> int:
        commits, fs = self._at("commits")
        n = 0
        if fs.exists(commits):
            n = max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(commits) if s.getPath().getName().endswith(".json")), default=-1) + 1
        while True:
            try:
                out = fs.create(self._at("commits", f"{n:012d}.json")[0], False)
            except Exception as e:
                if not fs.exists(self._at("commits", f"{n:012d}.json")[0]):
                    raise e
                n += 1  # another writer was faster
                continue
            out.write(bytearray((json.dumps(said) + "\n").encode()))
            out.close()
            return n

    def generations(self) -> DataFrame:
        """All rows that count, with ``generation``, the number of their commit."""
        frames, live = [], []
        for n, said in self._commits():
            live = [(n, said["folder"])] if said.get("replaces") else [*live, (n, said["folder"])]
        for n, folder in live:
            frames.append(self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").withColumn("generation", F.lit(n).cast("long")))
        out = self.spark.createDataFrame([], self.schema).withColumn("generation", F.lit(0).cast("long"))
        for f in frames:
            out = out.unionByName(f)
        return out

    def read(self) -> DataFrame:
        """One row for each key, that of the last generation which has it (of several in
        one generation any)."""
        others = [c for c in self.schema.names if c != self.key]
        last = self.generations().groupBy(self.key).agg(F.max_by(F.struct(*others), "generation").alias("_row"))
        return last.select(*(F.col(self.key) if c == self.key else F.col(f"_row.{c}") for c in self.schema.names))

    def append(self, rows: DataFrame, replaces: bool = False) -> int:
        """Write rows as a new generation; its number.  ``replaces``: those before don't count
        any more."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
        return self._commit({"folder": folder, "replaces": replaces})

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` whose key isn't in the store."""
        return wanted.join(self.generations().select(self.key), self.key, "left_anti")

    def compact(self) -> int:
        """The last row of each key as the only generation.  Rows that another run adds
        meanwhile would be hidden, so it is for times without writers."""
        return self.append(self.read(), replaces=True)


def encode_missing(store: Store, texts: DataFrame, encode: Callable[[list[str]], Iterable[list[float]]], text: str, to: str, batch: int = 32) -> int | None:
    """Encode each text whose key the store lacks, once, in batches, and append the vectors;
    the generation's number, or None if nothing was missing and so nothing was asked."""
    lacking = store.missing(texts.filter(F.col(store.key).isNotNull())).groupBy(store.key).agg(F.any_value(text).alias(text))
    if not lacking.take(1):
        return None
    kind = dict(texts.dtypes)[store.key]

    def run(batches):
        for part in slices(batches, text, batch):
            vectors = [[float(x) for x in v] for v in encode(part[text].to_pylist())]
            yield record_batch(zip(part[store_key].to_pylist(), vectors, strict=True), {store_key: part.schema.field(store_key).type, to: pa.list_(pa.float64())})

    store_key = store.key
    return store.append(lacking.mapInArrow(run, f"`{store_key}` {kind}, `{to}` array<double>"))
