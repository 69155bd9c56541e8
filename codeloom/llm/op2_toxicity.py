"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 to 5, with word boundaries) and of itself; its vector is the
average of their embeddings, a passage's vector the average of its words', and a linear softmax tells the
classes. Embeddings and softmax are trained jointly in numpy on a bounded sample of labelled
documents, starting from smoothed log-odds along the softmax. A misspelling that was never seen shares n-grams, and so most of its vector, with its word.

A few toxic words drown in the average of a long text, so a document scores as its worst passage of
``PASSAGE`` words does: training alternates between picking every document's worst passage and fitting to
those and to random ones. As the model is linear, scoring needs one number a word: each task remembers the
words it met (up to a bound) and slides a window over their running sum, over the whole text.

Defined cases: a null or empty text is scored like a passage of neutral words; repeated rows score
alike; without labels of both classes every score is the share of toxic labels (0.0 if there is none);
an empty table gives an empty result; a null ``doc_id`` is never held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Bounds on the training sample: labelled documents a class, and characters a class.
TRAIN_DOCS = 4000
TRAIN_CHARS = 8_000_000
PASSAGE = 20
BUCKETS = 1 << 18
DIM = 8
#: Training: step size, its damping, pseudo-documents of the warm start, epochs a round, rounds.
RATE = 1.0
DAMP = 1e-6
PRIOR = 2.0
EPOCHS = 3
ROUNDS = 4
_SHORTEST = 10
#: Words hashed at once.
_LOT = 1 << 13
_PRIME = np.uint64(1_000_003)
_STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”„’‘…–—"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its character n-grams, and where each word's begin (plus the end).

    All words are hashed at once, as polynomials of code points. Edge punctuation doesn't count; words
    hold no white space, so a line feed parts them.
    """
    if not words:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    if len(words) > _LOT:
        lots = [subwords(words[i : i + _LOT]) for i in range(0, len(words), _LOT)]
        ends = np.cumsum([0, *[len(flat) for flat, _ in lots]])
        return np.concatenate([flat for flat, _ in lots]), np.concatenate([[0], *[o[1:] + e for (_, o), e in zip(lots, ends, strict=False)]])
    text = "\n".join(f"<{w.strip(_STRIP)}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = codes == 10
    word = np.cumsum(gap)
    start = np.concatenate(([0], np.flatnonzero(gap) + 1))
    power = _power(int(np.diff(np.append(start, len(codes) + 1)).max()))
    found, owner = [np.add.reduceat(np.where(gap, np.uint64(0), codes) * power[np.arange(len(codes)) - start[word]], start)], [np.arange(len(words))]
    for n in (3, 4, 5):
        m = len(codes) - n + 1
        if m < 1:
            break
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * _PRIME + codes[k : k + m]
        at = np.flatnonzero((word[:m] == word[n - 1 :]) & ~gap[:m])
        found.append(h[at])
        owner.append(word[at])
    h, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    flat = ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32)[order]
    return flat, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def _power(n: int) -> np.ndarray:
    """Odd powers for hashing whole words, by position."""
    return np.cumprod(np.full(max(n, 1), _PRIME, np.uint64))


def words(text: str | None) -> list[str]:
    """White-space separated words, lower-cased."""
    return text.lower().split() if text else []


class Weights(dict):
    """What each word adds to the log-odds: the average over its subwords; remembered up to a bound."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The weights of the words of each text."""
        if len(self) > 500_000:
            self.clear()
        if new := list(dict.fromkeys(w for ws in texts for w in ws if w not in self)):
            flat, offsets = subwords(new)
            self.update(zip(new, (np.add.reduceat(self.table[flat], offsets[:-1]) / np.diff(offsets)).tolist(), strict=True))
        return [np.fromiter(map(self.__getitem__, ws), np.float64, len(ws)) for ws in texts]


def worst(weights: np.ndarray) -> tuple[float, int]:
    """The highest average of any passage, and where it starts. Short texts average over 10 words at least."""
    n = len(weights)
    if n <= PASSAGE:
        return float(weights.sum()) / max(n, _SHORTEST), 0
    total = np.concatenate(([0.0], np.cumsum(weights)))
    means = (total[PASSAGE:] - total[:-PASSAGE]) / PASSAGE
    at = int(means.argmax())
    return float(means[at]), at


def _fit_passages(model: dict, passages: list[np.ndarray], y: np.ndarray, share: np.ndarray, grams: tuple[np.ndarray, np.ndarray], draw: np.random.Generator, epochs: int) -> None:
    """Adagrad on the softmax cross-entropy of passages (lists of word numbers), embeddings and softmax together."""
    offsets, flat = grams
    for _ in range(epochs):
        order = draw.permutation(len(passages))
        for lot in np.array_split(order, max(1, len(order) // 256)):
            sizes = np.array([len(passages[i]) for i in lot])
            ids = np.concatenate([passages[i] for i in lot])
            row = np.repeat(np.arange(len(lot)), sizes)
            many = offsets[ids + 1] - offsets[ids]
            at = np.repeat(offsets[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            sub, owner = flat[at], np.repeat(row, many)
            weight = np.repeat(1.0 / (many * np.maximum(sizes, _SHORTEST)[row]), many).astype(np.float32)
            mean = np.stack([np.bincount(owner, model["e"][sub, d] * weight, len(lot)) for d in range(DIM)], axis=1)
            z = mean @ model["u"] + model["b"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - np.eye(2)[y[lot]]) * share[lot, None] / share[lot].sum()
            steps = {"u": mean.T @ g, "b": g.sum(axis=0)}
            back = (g @ model["u"].T).astype(np.float32)
            used, where = np.unique(sub, return_inverse=True)
            grad = np.stack([np.bincount(where, back[owner, d] * weight, len(used)) for d in range(DIM)], axis=1)
            model["he"][used] += (grad**2).sum(axis=1)
            model["e"][used] -= model["rate"] * grad / np.sqrt(model["he"][used] + model["damp"])[:, None]
            for k, step in steps.items():
                model[f"h{k}"] += step**2
                model[k] -= 0.1 * step / np.sqrt(model[f"h{k}"] + 1e-8)


def train(texts: list[str | None], labels: list[int], toxic_share: float, rounds: int = ROUNDS, seed: int = 2) -> tuple[np.ndarray, float, float]:
    """``(table, scale, shift)``: log-odds a bucket, and the calibration of a document's worst passage.

    Deterministic: the same sample in the same order gives the same model.
    """
    y = np.array(labels)
    if len(set(labels)) < 2:
        share = float(np.clip(toxic_share, 1e-9, 1 - 1e-9))
        return np.zeros(BUCKETS, np.float32), 0.0, float(np.log(share / (1 - share)))
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in words(t)], np.int32) for t in texts]
    flat, offsets = subwords(list(numbers))
    held = np.zeros((2, BUCKETS))
    for d, c in zip(docs, labels, strict=True):
        if len(d):
            held[c, np.unique(np.concatenate([flat[offsets[w] : offsets[w + 1]] for w in np.unique(d).tolist()]))] += 1
    draw = np.random.default_rng(seed)
    u = draw.standard_normal((DIM, 2)) * 0.5
    # A warm start along the softmax: each bucket's smoothed log-odds by the documents that have it.
    odds = np.log((held + PRIOR) / (np.bincount(y, minlength=2)[:, None] + 2 * PRIOR))
    odds = np.where(held.sum(0) > 0, odds[1] - odds[0], 0)
    along = u[:, 1] - u[:, 0]
    e = (odds[:, None] * along / (along @ along)).astype(np.float32)
    model = {"e": e, "u": u, "b": np.zeros(2), "he": np.zeros(BUCKETS), "hu": np.zeros((DIM, 2)), "hb": np.zeros(2), "rate": RATE, "damp": DAMP}
    # Both classes weigh alike in training; calibration brings the real shares back.
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    filled = [i for i, d in enumerate(docs) if len(d)]

    def by_word() -> np.ndarray:
        if not len(flat):
            return np.zeros(0)
        table = model["e"] @ (model["u"][:, 1] - model["u"][:, 0])
        return np.add.reduceat(table[flat], offsets[:-1]) / np.diff(offsets)

    for _ in range(rounds):
        weight = by_word()
        passages, who = [], []
        for i in filled:
            at = worst(weight[docs[i]])[1]
            picks = [at] if y[i] else [at, int(draw.integers(0, max(1, len(docs[i]) - PASSAGE)))]
            passages += [docs[i][a : a + PASSAGE] for a in picks]
            who += [i] * len(picks)
        _fit_passages(model, passages, y[who], balance[who] / np.where(y[who] == 1, 1, 2), (offsets, flat), draw, EPOCHS)
    weight = by_word()
    x = np.array([worst(weight[d])[0] for d in docs])
    real = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    scale, shift = _calibrate(x, y, real)
    return (model["e"] @ (model["u"][:, 1] - model["u"][:, 0])).astype(np.float32), scale, shift


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, by damped Newton steps with a slight ridge."""
    a = np.stack((x / (x.std() + 1e-9), np.ones_like(x)), axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - 1e-2 * w)
        w += step / max(1.0, float(np.abs(step).max()))
    return float(w[0] / (x.std() + 1e-9)), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, docs_a_class: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[str | None], list[int], float]:
    """The training texts and labels, and the share of toxic ones among all labels open to training.

    At most ``docs_a_class`` documents a class, chosen by hash, and of these as many as have ``chars``
    characters together; only ids and lengths, then the chosen texts, come to the driver. Of several texts under one
    id the shortest counts.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = dict(usable.groupBy("toxic").count().collect())
    lots = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs_a_class) for c in (0, 1)]
    chosen = F.broadcast(lots[0].unionByName(lots[1]))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    mark = F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("mark"))
    # One text an id, the shortest, so no more rows than ids are chosen ever come to the driver.
    sizes = found.groupBy("doc_id", "toxic").agg(F.min(mark).alias("x"), F.max(F.xxhash64("doc_id")).alias("order")).select("doc_id", "toxic", "x.n", "x.mark", "order")
    room, picks = {0: chars, 1: chars}, []
    for doc_id, toxic, n, mark, _ in sorted(map(tuple, sizes.collect()), key=lambda r: (r[4], r[0])):
        if n <= room[toxic]:
            room[toxic] -= n
            picks.append((doc_id, mark))
    picked = docs.sparkSession.createDataFrame(picks, T.StructType([docs.schema["doc_id"], T.StructField("mark", T.LongType())])) if picks else None
    rows = found.withColumn("mark", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]).collect() if picked is not None else []
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows)
    n = sum(counts.values())
    return [r[1] for r in rows], [r[2] for r in rows], counts.get(1, 0) / n if n else 0.0


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    texts, marks, share = sample(docs, labels)
    table, scale, shift = train(texts, marks, share)
    del texts

    def make(lot: list[str | None], kept: list = []) -> list[pa.Array]:  # noqa: B006  one memory a task
        if not kept:
            kept.append(Weights(table))
        x = [worst(w)[0] for w in kept[0].of([words(t) for t in lot])]
        z = np.clip(scale * np.array(x, float) + shift, -500, 500)
        return [pa.array(1 / (1 + np.exp(-z)), pa.float64())]

    got = map_rows(docs.select("doc_id", "text"), "text", [("score", T.DoubleType())], make, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that aren't held out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
