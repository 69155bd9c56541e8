"""What the operators share: fresh column names, row-wise Arrow mapping and checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of anything but ASCII white space, as in ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared checkpoint folder that ``spark.checkpoint.dir`` names.

    Where none is named, a temporary folder does on one machine only; executors of a cluster can't read it, so there this raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-"))


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to ``name``, a path in the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    df.write.parquet(path := f"{spark.sparkContext.getCheckpointDir()}/{name}")
    return spark.read.schema(df.schema).parquet(path)


#: Rows that go to a Python worker at a time. Spark's 10,000 long texts are tens of megabytes on both sides of each task.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Send Python workers at most ``BATCH_ROWS`` rows at a time from now on; a session that wants fewer keeps its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) <= 0 or int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Tables of the scratch scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose tables by :func:`cut` are deleted at its end, but for those to be kept, which go to the scope around it if there is one.

    What leaves the scope mustn't be worked out from a deleted table any more: cut it with ``keep``.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared checkpoint folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so lost executors cost no recomputation.

    A table rather than ``checkpoint()``: that keeps the planner's size estimate, which joins multiply, so that after some
    dozens of steps planning alone takes minutes; a table has the size of its files.
    """
    out = table(df, name := f"cut-{uuid.uuid4().hex}")
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}")
    return out


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` splits at just the six ASCII white-space bytes."""
    return text.encode().split() if text else []


def map_rows(
    df: DataFrame,
    text: str,
    out: Sequence[tuple[str, T.DataType]],
    make: Callable[[list[str | None]], Sequence[pa.Array]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns that ``make`` computes from a list of texts, batch by batch.

    ``keep`` names the columns that pass through (all by default). Batches are bounded by
    Spark's Arrow limits on rows and bytes; no row moves and none is dropped.
    """
    keep = list(df.columns if keep is None else keep)
    cols = keep + ([text] if text not in keep else [])
    src = df.select(*[F.col(f"`{c}`") for c in cols])
    kept = T.StructType([src.schema[c] for c in keep])
    schema = T.StructType([*kept.fields, *[T.StructField(n, t) for n, t in out]])
    at, n_keep, step = cols.index(text), len(keep), 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, max(whole.num_rows, 1), step):
                batch = whole.slice(i, step)
                made = make(batch.column(at).to_pylist())
                names = [f"c{k}" for k in range(n_keep + len(made))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=names)

    flat = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema.fields)])
    return src.mapInArrow(run, flat).toDF(*schema.names)


def n_words(text: Column) -> Column:
    """Number of words, null counted as none, without leaving the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, also where ``body`` is used inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
