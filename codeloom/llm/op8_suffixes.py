"""Repeated passages by a sparse suffix array.

Of all suffixes of the documents' word sequences only those are retained that begin at a minimiser: of
the 27 runs of 24 words in any window of 50 words the one with the least hash. Windows of equal content
choose the same one, so every passage of 50 words or more that two documents share has a retained suffix at
the same place in both. Then

1. suffixes are brought together by their first 24 words; those that stand alone go;
2. neighbours are compared on their whole reach, all words of the windows that chose them: equal reach means that
   all these windows repeat, which settles the inside of long passages and of copies;
3. where one start has several reaches, at a passage's ends, one suffix of each is extended to the left and right
   word by word, as windows of 50 words around it, and a window in two documents repeats.

The order is kept by hashes of 64 bits, so the sorting and comparing of neighbours are aggregations with map-side
combining: a start that a third of all documents share is never in one task's memory, and equal reaches are
compared once. (In the lexical order the neighbour with the longest match to the right needn't have the
longest match in all; comparing windows finds every passage.) Found intervals are merged document by document.

Defined cases: words are split at ASCII white space and compared as they are; null, empty and short texts have no
passages; a passage must be in two documents of different ``doc_id``, so repeated rows don't make one and rows
with a null ``doc_id`` are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table
from .op4_simhash import bit_map, marked

WORDS = 50
START = 24
_REACH = WORDS - START + 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any runs of words of a list of documents, from prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, texts: list[str | None]) -> None:
        words = [t.encode().split() if t else [] for t in texts]
        if len(self.known) > 500_000:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in {w for ws in words for w in ws if w not in known}:
            known[w] = digest(w, 1)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        n = int(self.sizes.sum())
        if len(self.up) <= n:
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, _BASE, np.uint64))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, _INVERSE, np.uint64))))
        h = np.fromiter((known[w] for ws in words for w in ws), np.uint64, n)
        self.prefix = np.concatenate(([np.uint64(0)], np.cumsum(h * self.up[:n], dtype=np.uint64)))

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` up to ``stop``, places in the joint sequence."""
        return _mix((self.prefix[stop] - self.prefix[start]) * self.down[start])

    def anchors(self) -> tuple[np.ndarray, ...]:
        """``(doc, first, many, start hash, reach hash)`` of every retained suffix: the windows that chose it
        begin at the words ``first`` to ``first + many`` of the document."""
        n = int(self.sizes.sum())
        none = np.empty(0, np.int64)
        if n < WORDS:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        at = np.arange(n - START + 1)
        h = self.hash(at, at + START)
        # The least of _REACH neighbours, the leftmost of equal ones, by doubling.
        best, width = at, 1
        while width < _REACH:
            step = min(width, _REACH - width)
            a, b = best[:-step], best[step:]
            best, width = np.where(h[b] < h[a], b, a), width + step
        doc = np.searchsorted(self.ends, np.arange(len(best)), side="right")
        starts = np.flatnonzero(np.arange(len(best)) + WORDS <= self.ends[np.minimum(doc, len(self.ends) - 1)])
        chosen, doc = best[starts], doc[starts]
        if not len(starts):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])))
        first = starts[new]
        last = starts[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]
        doc, chosen = doc[new], chosen[new]
        reach = _mix(self.hash(first, last + WORDS) + (chosen - first).astype(np.uint64) * np.uint64(_BASE))
        return doc, first - (self.ends - self.sizes)[doc], last - first, h[chosen], reach


def _lists(doc: np.ndarray, docs: int, fields: dict[str, np.ndarray]) -> pa.Array:
    """One list of structs a document from columns sorted by document."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=docs)))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields)))


def _struct(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


def _suffixes(texts: list[str | None], kept: list = []) -> list[pa.Array]:  # noqa: B006  one memory a task
    if not kept:
        kept.append(Rolling())
    kept[0].load(texts)
    doc, first, many, h, reach = kept[0].anchors()
    return [_lists(doc, len(texts), {"h": h.view(np.int64), "reach": reach.view(np.int64), "first": first.astype(np.int32), "many": many.astype(np.int32)})]


def _table(df: DataFrame, base: str, name: str) -> DataFrame:
    return table(df, f"{base}/{name}")


def _extend(docs: DataFrame, ends: DataFrame, base: str) -> DataFrame:
    """``(window, h, reach, o, low, high)``: the windows around the suffixes ``ends(doc_id, row, h, reach, first, many, low, high)``."""
    asked = table(ends.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "many", "h", "reach", "low", "high")).alias("asked")), f"{base}/asked")
    # Only texts that the bit map marks move.
    bits = bit_map(asked.select(F.xxhash64("doc_id", "row")))
    look = F.pandas_udf(lambda hashes: pd.Series(marked(bits, hashes.to_numpy())), "boolean")
    few = docs.where(look(F.xxhash64("doc_id", "row"))).join(asked.select("doc_id", "row"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    joined = few.join(asked, ["doc_id", "row"]).select("text", "asked", F.transform("asked", lambda x: F.struct(x["first"], x["many"])).alias("places"))
    out = T.StructType([T.StructField("asked", joined.schema["asked"].dataType), T.StructField("windows", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches):  # noqa: ANN001, ANN202
        rolling = Rolling()
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                rolling.load(batch.column(0).to_pylist())
                got = []
                for k, places in enumerate(batch.column(2).to_pylist()):
                    low = int(rolling.ends[k] - rolling.sizes[k])
                    at = [np.arange(low + p["first"], low + p["first"] + p["many"] + 1) for p in places]
                    got.append([rolling.hash(a, a + WORDS).view(np.int64).tolist() for a in at])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.list_(pa.int64())))], names=["asked", "windows"])

    shown = joined.mapInArrow(run, out).select(F.explode(F.arrays_zip("asked", "windows")).alias("x"))
    return shown.select("x.asked.h", "x.asked.reach", "x.asked.low", "x.asked.high", F.posexplode("x.windows").alias("o", "window"))


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, first_word, n_words)`` of every longest run of words covered by repeated windows of ``WORDS``."""
    base = f"suffixes-{uuid.uuid4().hex}"
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    src = src.withColumn("row", F.xxhash64("text"))
    kind = _struct(("h", T.LongType()), ("reach", T.LongType()), ("first", T.IntegerType()), ("many", T.IntegerType()))
    made = map_rows(src, "text", [("found", kind)], _suffixes, keep=["doc_id", "row"])
    anchors = _table(made.select("doc_id", "row", F.inline("found")), base, "anchors")

    # 1. Starts in more than one document.
    starts = anchors.groupBy("h").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("m")).where("l <> m").select("h")
    # Written first, so that the join deals out both sides anew and Spark can split a start's rows.
    starts = _table(starts, base, "starts")
    shared = _table(anchors.join(starts, "h", "left_semi"), base, "shared")
    # 2. Equal reaches, one row each with a representative.
    reaches = shared.groupBy("h", "reach").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct("doc_id", "row", "first", "many")).alias("one")
    )
    reaches = _table(reaches, base, "reaches")
    settled = reaches.where("low <> high").select("h", "reach", F.lit(None).cast("int").alias("o_from"), F.lit(None).cast("int").alias("o_to"))
    # 3. Starts with several reaches: every reach that isn't settled is extended, against one of each settled one.
    several = reaches.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("low") == F.col("high")).alias("open")).where("n > 1 and open > 0").select("h")
    ends = reaches.join(several, "h", "left_semi").select("h", "reach", "low", "high", "one.doc_id", "one.row", "one.first", "one.many")
    windows = _table(_extend(src, ends, base), base, "windows")
    again = windows.groupBy("window").agg(F.min("low").alias("l"), F.max("high").alias("m")).where("l <> m").select("window")
    again = _table(again, base, "again")
    opened = windows.where("low = high").join(again, "window", "left_semi")
    # Windows of one suffix lie less than a window apart, so the repeated ones cover a single run of words.
    opened = opened.groupBy("h", "reach").agg(F.min("o").alias("o_from"), F.max("o").alias("o_to"))

    spread = _table(settled.unionByName(opened), base, "spread")
    begin, end = F.col("first") + F.coalesce("o_from", F.lit(0)), F.col("first") + F.coalesce("o_to", F.col("many")) + WORDS
    found = shared.join(spread, ["h", "reach"]).select("doc_id", "row", begin.alias("a"), end.alias("b")).distinct()
    # Runs that touch or overlap become one: a run is opened where none before it reaches its first word.
    by_doc = Window.partitionBy("doc_id", "row").orderBy("a", "b")
    opens = F.coalesce(F.col("a") > F.max("b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = found.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "row", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.select("doc_id", F.col("a").cast("long").alias("first_word"), (F.col("b") - F.col("a")).cast("long").alias("n_words"))


def remove_repeats(text_words: list[str], spans: list[tuple[int, int]]) -> list[str]:
    """The words outside the spans (first word, words)."""
    cut = {i for a, n in spans for i in range(a, a + n)}
    return [w for i, w in enumerate(text_words) if i not in cut]


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that another document has too."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
