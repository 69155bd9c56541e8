"""A stored table with versions: bucketed files, a manifest a version, atomic publishing (SNK-1, SNK-3, SNK-6, SNK-8, UPD-9).

Rows lie in folders by ``bucket``, a hash of the key. A version is one small manifest that says which folders make up each bucket; it is
written beside and renamed into place, which fails if the version is there already, so a version is whole or not there, and of
two writers one gets :class:`Conflict`. Nothing that a version names is ever overwritten: readers of an older one go on, a failed write
leaves folders that no manifest names, and a table may be rewritten from itself.

A merge or delete reads and writes only the buckets that hold one of its keys. Folders of a bucket are written with Spark's rebalancing,
so a bucket with a third of all rows (one key, or none) is several files of several tasks. The manifest also keeps the last batch of each stream, so a micro-batch that is written again after a kill changes nothing.

Defined cases: a null key is a key like others (null-safe); of several new rows of one key the last by ``order`` counts; an empty
batch is a version without new folders.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer published the version first."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on a single machine where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: what follows neither plans nor works it out anew."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Files:
    """The few file operations that a manifest needs, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that nobody sees before it is whole; an error if it is there."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(draft, self._path(name), none)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(name) from error
            raise


class Table:
    """A versioned table of a fixed schema under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, list(key), buckets
        self.files = _Files(spark, path)

    # --- versions ---

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one by default) consists of."""
        known = self.versions()
        if not known:
            return {"version": -1, "folders": {}, "batches": {}}
        return json.loads(self.files.read(f"{self.path}/versions/{known[-1] if version is None else version:012d}.json"))

    def _publish(self, old: dict, folders: dict[str, list[str]], batch: tuple[str, int] | None) -> int:
        new = {"version": old["version"] + 1, "folders": folders, "batches": old["batches"] | ({batch[0]: batch[1]} if batch else {})}
        self.files.publish(f"{self.path}/versions/{new['version']:012d}.json", json.dumps(new))
        return new["version"]

    # --- rows ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, names: Iterable[str]) -> DataFrame:
        names = sorted(names)
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; folders of several buckets are one scan."""
        return self._folders({f for fs in self.manifest(version)["folders"].values() for f in fs})

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders by bucket."""
        base = f"{self.path}/data/{uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema], self._bucket().alias("_bucket"))
        typed.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(base)
        return {n.removeprefix("_bucket="): [f"{base}/{n}"] for n in self.files.names(base) if n.startswith("_bucket=")}

    # --- changes ---

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows. A ``batch`` (stream, number) that the table has already, or an older one, changes nothing."""
        old = self.manifest()
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old["version"]
        new = self._write(rows)
        return self._publish(old, {b: old["folders"].get(b, []) + new.get(b, []) for b in old["folders"] | new}, batch)

    def _replace(self, keys: DataFrame, add: DataFrame | None, batch: tuple[str, int] | None = None) -> int:
        old = self.manifest()
        if batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old["version"]
        gone = keys.select(*[F.col(k).alias(f"_gone{i}") for i, k in enumerate(self.key)], self._bucket().alias("_b")).distinct()
        touched = [str(r[0]) for r in gone.select("_b").distinct().collect()]  # at most as many as there are buckets
        stored = self._folders({f for b in touched for f in old["folders"].get(b, [])})
        same = [F.col(k).eqNullSafe(F.col(f"_gone{i}")) for i, k in enumerate(self.key)]
        kept = stored.join(gone, same, "left_anti")
        rows = kept if add is None else kept.unionByName(add.select(*self.schema.names))
        new = self._write(rows) if touched else {}
        return self._publish(old, {b: f for b, f in old["folders"].items() if b not in touched} | new, batch)

    def merge(self, news: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows of ``news`` in place of stored ones with their key, and new keys added; of several the last by ``order``."""
        if order:
            whole = F.struct(*self.schema.names)
            news = news.groupBy(*self.key).agg(F.max_by(whole, F.struct(F.col(order), F.to_json(whole))).alias("_row")).select("_row.*")
        return self._replace(news, news, batch)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of these keys."""
        return self._replace(keys, None)

    def sink(self, stream: str):  # noqa: ANN201
        """A function for ``foreachBatch`` that appends every micro-batch once, also if it is handed over again."""

        def add(rows: DataFrame, number: int) -> None:
            if self.manifest()["batches"].get(stream, -1) >= number:
                rows.write.format("noop").mode("overwrite").save()  # a stateful query commits its state only when its rows are read
            else:
                self.append(rows, (stream, number))

        return add
