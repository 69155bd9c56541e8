"""Fill-in-the-middle: texts cut at two code points and put in another order behind markers.

A ``Split`` pre-tokenizer whose isolated regex matches are runs of ``BLOCK`` code points gives the offsets of a text's runs, and one
whose matches are single code points those of the last run and of the runs that hold a cut: the lengths of the offset arrays
give ``n``, and the offsets of two ranks the slices. (With runs of one code point this is one flat array; it gives the same and
takes eight times as long.) Nothing is trained. Long texts are split ``SLICE`` code points at a time, so what a task holds
beside a text doesn't grow with it.

The numbers that choose cuts and form come from the SHA-256 of seed and ``doc_id``, in the JVM, so a task that runs again makes
the same choice. No row moves.

Defined cases: a null text is an empty one; an empty text and one that holds a marker stay plain; a null ``doc_id`` counts as the
text ``null``; repeated rows come out alike; other columns pass through, also those with the names of new ones, which then
get further underscores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

MARKERS = ("<P>", "<S>", "<M>")
SEED = 1
#: Texts in a hundred that stay plain, and of the others those that put the suffix first.
PLAIN = 10
SUFFIX_FIRST = 20
#: Code points in a run, and in what is split at a time (a multiple of it).
BLOCK = 64
SLICE = 1 << 16


class Units:
    """Offsets of a text's code points by rank."""

    def __init__(self, block: int = BLOCK):
        from tokenizers import Regex, pre_tokenizers

        self.block = block
        self.runs, self.points = (pre_tokenizers.Split(Regex(rf"[\s\S]{{1,{n}}}"), "isolated") for n in (block, 1))

    def read(self, text: str) -> int:
        """Take a text; the number of its code points."""
        self.text, parts = text, []
        for at in range(0, len(text), SLICE):
            parts.append(np.fromiter((a for _, (a, _) in self.runs.pre_tokenize_str(text[at : at + SLICE])), np.int64) + at)
        self.starts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.n = (len(self.starts) - 1) * self.block + len(self._points(len(self.starts) - 1)) if parts else 0
        return self.n

    def _points(self, run: int) -> list[int]:
        stop = self.starts[run + 1] if run + 1 < len(self.starts) else None
        return [self.starts[run] + a for _, (a, _) in self.points.pre_tokenize_str(self.text[self.starts[run] : stop])]

    def offset(self, rank: int) -> int:
        """Where the unit of this rank begins; that of rank ``n`` is the end."""
        return int(self._points(rank // self.block)[rank % self.block]) if rank < self.n else len(self.text)


def rearrange(units: Units, text: str | None, h: tuple[int, int, int, int], plain: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, code points of the prefix, of the middle, output)`` of a text."""
    text = text or ""
    n = units.read(text)
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = units.offset(a), units.offset(b)
    p, s, m = MARKERS
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{text[j:]}{p}{text[:i]}{m}{text[i:j]}"
    return n, "psm", a, b - a, f"{p}{text[:i]}{s}{text[j:]}{m}{text[i:j]}"


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output`` after their columns."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))), 256)
    number = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)], *[x.alias(f"h{k}") for k, x in enumerate(number)])
    at, width = docs.columns.index(text), len(docs.columns)
    made = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(block)
        for whole in batches:
            for i in range(0, max(whole.num_rows, 1), 256):
                batch = whole.slice(i, 256)
                hs = zip(*[batch.column(width + k).to_pylist() for k in range(4)], strict=True)
                rows = [rearrange(units, t, h, plain, suffix_first) for t, h in zip(batch.column(at).to_pylist(), hs, strict=True)]
                cols = zip(*rows, strict=True) if rows else [()] * len(made)
                new = [pa.array(c, pa.int64() if k in (0, 2, 3) else pa.string()) for k, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[f"c{k}" for k in range(width + len(new))])

    flat = T.StructType([*src.schema.fields[:width], *[T.StructField(f"c{width + k}", t) for k, (_, t) in enumerate(made)]])
    names: list[str] = list(docs.columns)
    for name, _ in made:
        names.append(fresh(docs, name))
    return src.mapInArrow(run, flat).toDF(*names)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. Plain outputs are texts; others hold each marker once."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), numbered AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {100 - PLAIN} THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM hashed
), cut AS (
  SELECT *, substr(text, 1, least(x, y)) AS prefix, substr(text, least(x, y) + 1, abs(x - y)) AS middle, substr(text, greatest(x, y) + 1) AS suffix FROM numbered
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, with digests of its output and of the text that the output gives back."""
    got = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
