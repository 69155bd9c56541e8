"""Quality rules by weak supervision.

Ten rules vote on every whole text: keep (1), reject (-1) or abstain (0). The number of
documents with each pattern of votes (at most 3**10 patterns, however large the corpus) goes to
an expectation-maximisation that estimates, without labels, how often each rule votes how on
good and on bad documents. A document's posterior probability of being good is then a sum of
log-likelihood ratios over its votes, a plain column expression with literals.

Defined cases: a null or empty text has no words and fails the base rules; nulls in other columns
don't matter; repeated rows are judged alike; an empty table gives an empty result; extra columns
pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, map_rows

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Words without a letter; every non-ASCII character counts as one.
_LETTERLESS = re.compile(rb"(?<![^\s])[^A-Za-z\x80-\xff\s]+(?![^\s])")
_SPACES = " \t\n\x0b\x0c\r"
_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ended", "n_distinct", "n_letterless"]
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b";", b")", "…".encode(), "”".encode(), "»".encode())


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, first occurrences included.

    Windows of 1, 2, 4, 8 words are ranked by doubling: two windows have one rank just if they are
    equal, so nothing rests on hashes.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < window:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
        if int(rank.max()) + 1 == len(rank):
            return 0
    found = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(found)
    edge[at] += 1
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def features(text: str | None) -> tuple[int, ...]:
    """The counts that the rules look at, in the order of ``_FEATURES``."""
    if not text:
        return (0,) * len(_FEATURES)
    words = text.encode().split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.encode().split(b"\n") if x and not x.isspace()]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        len(_SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        upper,
        sum(map(str.isalpha, text)),
        sum(x.rstrip().endswith(_ENDS) for x in lines),
        len(seen),
        len(_LETTERLESS.findall(text.encode())),
    )


def _make(texts: list[str | None]) -> list[pa.Array]:
    cols = zip(*map(features, texts), strict=True) if texts else [()] * len(_FEATURES)
    return [pa.array(c, pa.int64()) for c in cols]


def votes(f: dict[str, Column]) -> list[Column]:
    """Each rule's vote; ``f`` has the features. Thresholds follow commonly published heuristics."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n, lines = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["n_lines"], F.lit(1))
    letters = F.greatest(f["n_letters"], F.lit(1))
    mean = f["word_chars"] / n
    return [
        rule(f["n_words"] < MIN_WORDS, f["n_words"] >= 50),
        rule((mean < 2) | (mean > 15), (mean >= 3) & (mean <= 10)),
        rule(f["n_symbols"] > 0.1 * n, f["n_symbols"] <= 0.02 * n),
        rule(f["n_dup_lines"] > 0.3 * lines, f["n_dup_lines"] <= 0.1 * lines),
        rule(100 * f["n_repeat_words"] > MAX_REPEAT_PCT * n, 100 * f["n_repeat_words"] <= 10 * n),
        rule(f["n_upper"] > 0.3 * letters, f["n_upper"] <= 0.15 * letters),
        rule(f["n_letters"] < 0.6 * f["word_chars"], f["n_letters"] >= 0.8 * f["word_chars"]),
        rule(f["n_ended"] < 0.3 * lines, f["n_ended"] >= 0.6 * lines),
        rule((f["n_words"] >= 100) & (f["n_distinct"] < 0.15 * n), (f["n_words"] < 100) | (f["n_distinct"] >= 0.25 * n)),
        rule(f["n_letterless"] > 0.2 * n, f["n_letterless"] <= 0.1 * n),
    ]


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 50, prior: float = 0.8) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over the counted vote patterns.

    Returns the log-odds of the prior and, by rule and vote (reject, abstain, keep), the log-likelihood
    ratio good : bad. It starts from the number of rejects; one pseudo-count a cell keeps every ratio
    finite. A rule's vote is never allowed to count against its own direction: a keep vote can't
    lower and a reject vote can't raise the odds, which pins the two classes to their names.
    """
    rules = len(next(iter(patterns))) if patterns else len(votes({k: F.lit(0) for k in _FEATURES}))
    if not patterns:
        return float(np.log(prior / (1 - prior))), np.zeros((rules, 3))
    keys = sorted(patterns)
    v = np.array(keys, np.int64) + 1
    count = np.array([patterns[k] for k in keys], float)
    one = np.eye(3)[v]
    good = 1 / (1 + np.exp(3.0 * (v == 0).sum(1) - 2.0))
    for _ in range(rounds):
        mass = (count * good).sum(), (count * (1 - good)).sum()
        p = [(np.einsum("i,ijk->jk", count * w, one) + 1) / (m + 3) for w, m in ((good, mass[0]), (1 - good, mass[1]))]
        ratio = np.log(p[0] / p[1])
        ratio[:, 0] = np.minimum(ratio[:, 0], 0)
        ratio[:, 2] = np.maximum(ratio[:, 2], 0)
        base = float(np.log((mass[0] + 1) / (mass[1] + 1)))
        good = 1 / (1 + np.exp(-np.clip(base + np.einsum("ijk,jk->i", one, ratio), -500, 500)))
    return base, ratio


def judge(docs: DataFrame, text: str = "text", prefix: str = "q_", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the features, ``base_failed``, ``probability`` and ``kept``, all named with ``prefix``.

    The texts are read once: features and votes are written with the columns ``keep`` (all by default) and read again, to
    count vote patterns and to judge.
    """
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    names = [f"{prefix}{x}" for x in _FEATURES]
    df = map_rows(docs, text, [(x, T.LongType()) for x in names], _make, keep=keep)
    f = {k: F.col(f"`{x}`") for k, x in zip(_FEATURES, names, strict=True)}
    df = cut(df.withColumn(f"{prefix}votes", F.array(*[x.cast("int") for x in votes(f)])))
    counted = df.groupBy(f"{prefix}votes").agg(F.count(F.lit(1)).alias("n"))
    base, ratio = fit({tuple(r[0]): r[1] for r in counted.collect()})
    odds = F.lit(base)
    for j, row in enumerate(ratio):
        v = F.col(f"`{prefix}votes`")[j]
        odds = odds + F.when(v < 0, float(row[0])).when(v > 0, float(row[2])).otherwise(float(row[1]))
    n, rep = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PCT * n)
    df = df.withColumn(f"{prefix}base_failed", failed).withColumn(f"{prefix}probability", 1 / (1 + F.exp(-odds)))
    return df.withColumn(f"{prefix}kept", ~F.col(f"`{prefix}base_failed`") & (F.col(f"`{prefix}probability`") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns unchanged."""
    name = fresh(docs, "q_").rstrip("_") + "_"
    judged = judge(docs, prefix=name)
    kept = next(c for c in reversed(judged.columns) if c.endswith("kept"))
    return judged.where(F.col(f"`{kept}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = judge(docs, keep=["doc_id"])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"]
    return got.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in cols])


__all__ = ["features", "fit", "judge", "keep_good", "op10_quality", "repeated_words", "votes"]
