"""Benchmark decontamination: item-sized SimHash windows, multi-index Hamming lookup, exact check.

A benchmark item contaminates a document if some window of the document, as many words long as the
item, has a weighted Jaccard similarity of at least 0.8 with it over five-word shingles, a shingle's
weight being how often it occurs. Words are runs of letters, digits and underscores, lower-cased.

1. A window that similar shares a shingle with the item, so only windows around shared shingles are
   looked at; this drops no match.
2. Each such window of an item's length gets a 64-bit SimHash, from prefix sums over the positions.
3. The items' fingerprints are indexed by four blocks of 16 bits, each block under every value within
   5 bits; any two fingerprints within radius 23 agree so in at least one block, so four look-ups
   give all items within the radius. Shingle sets of similarity 0.8 differ in about 10 bits of 64.
4. Candidates are verified by their exact weighted similarity.

The benchmark is a stated query set. It is taken in blocks of bounded items and characters, so what travels to
executors never grows with it. Of several blocks each is one pass over the few documents that share a shingle with any
item at all, which one pass with a bit map of bounded size finds first.

Defined cases: null or empty texts and items have no words and never match; an item or document
of fewer than five words is one shingle; a document shorter than an item is one window; repeated rows
and repeated items are reported alike; no items or no documents give no rows; a null id is passed on.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, map_rows

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
#: Bounds on a block of the benchmark that is sent to executors at once.
BLOCK_ITEMS = 1000
BLOCK_CHARS = 4_000_000
#: Bits of the map of all items' shingles, where there are several blocks.
MAP_BITS = 1 << 27
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """The compared words of a text."""
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Well-mixed 64-bit hashes of all runs of ``width`` words."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _MULTIPLIER + h[j : j + n]
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _simhash(bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints from how many of ``counts`` shingles set each bit."""
    return np.packbits(2 * bits > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Scanner:
    """One block of the benchmark, indexed; built anew in each task from the items' texts."""

    def __init__(self, items: list[str | None]):
        self.hashes = _Hashes()
        words = [self.hashes.of(tokens(t)) for t in items]
        self.length = np.array([len(w) for w in words])
        self.bags = [_shingle_hashes(w, min(SHINGLE, len(w))) if len(w) else w for w in words]
        self.prints = np.array([_simhash(_bits(b).sum(0, dtype=np.int64)[None], np.array([len(b)]))[0] if len(b) else 0 for b in self.bags], np.uint64)
        self.widths = sorted({min(SHINGLE, n) for n in self.length.tolist() if n})
        self.owners: dict[int, dict[int, list[int]]] = {w: defaultdict(list) for w in self.widths}
        for i, bag in enumerate(self.bags):
            for s in set(bag.tolist()):
                self.owners[min(SHINGLE, int(self.length[i]))][s].append(i)
        self.filters = {}
        for w in self.widths:
            table = np.zeros(1 << 20, bool)
            table[np.array(list(self.owners[w]), np.uint64) & np.uint64((1 << 20) - 1)] = True
            self.filters[w] = table
        self.index = None

    def _lookup(self, prints: np.ndarray) -> np.ndarray:
        """Bit sets (windows x items) of all items that may lie within the radius: four look-ups each."""
        if self.index is None:
            values = np.arange(1 << 16, dtype=np.uint16)
            self.index = []
            for b in range(4):
                block = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
                close = np.empty((1 << 16, -(-len(block) // 8)), np.uint8)
                for i in range(0, 1 << 16, 4096):
                    close[i : i + 4096] = np.packbits(np.bitwise_count(values[i : i + 4096, None] ^ block) <= RADIUS // 4, axis=1)
                self.index.append(close)
        found = self.index[0][prints & np.uint64(0xFFFF)]
        for b in range(1, 4):
            found = found | self.index[b][(prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)]
        return found

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text its (item, first word, words, similarity), the best window of each item."""
        words = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        h = self.hashes.of([w for ws in words for w in ws])
        anchors: list[dict[int, list[int]]] = [defaultdict(list) for _ in texts]
        for width in self.widths:
            s = _shingle_hashes(h, width)
            at = np.flatnonzero(self.filters[width][s & np.uint64((1 << 20) - 1)])
            owners = self.owners[width]
            docs = np.searchsorted(ends, at, side="right")
            for p, d in zip(at.tolist(), docs.tolist(), strict=True):
                if p + width <= ends[d] and (own := owners.get(int(s[p]))):
                    for i in own:
                        anchors[d][i].append(p - int(ends[d] - sizes[d]))
        # A text too short for a shingle is one shingle itself, which only an item as short can equal.
        return [self._windows(h[e - n : e], a) if a else [] for a, n, e in zip(anchors, sizes, ends, strict=True)]

    def _windows(self, h: np.ndarray, anchors: dict[int, list[int]]) -> list[tuple[int, int, int, float]]:
        best: dict[int, tuple[int, int, int, float]] = {}
        groups: dict[tuple[int, int], dict[int, None]] = defaultdict(dict)
        for i, places in anchors.items():
            length = int(self.length[i])
            width, size = min(SHINGLE, length), min(length, len(h))
            starts = groups[width, length]
            for p in places:
                starts.update(dict.fromkeys(range(max(0, p - size + width), min(p, len(h) - size) + 1)))
        for (width, length), starts in groups.items():
            size = min(length, len(h))
            all_starts = np.array(sorted(starts))
            for piece in np.split(all_starts, np.flatnonzero(np.diff(all_starts) > size) + 1):
                for k in range(0, len(piece), 4096):
                    self._check(h, piece[k : k + 4096], width, size, length, best)
        return sorted(best.values())

    def _check(self, h: np.ndarray, starts: np.ndarray, width: int, size: int, length: int, best: dict[int, tuple]) -> None:
        low = int(starts[0])
        bag = _shingle_hashes(h[low : int(starts[-1]) + size], width)
        n = size - width + 1
        total = np.zeros((len(bag) + 1, 64), np.int32)
        np.cumsum(_bits(bag), axis=0, dtype=np.int32, out=total[1:])
        at = starts - low
        prints = _simhash(total[at + n] - total[at], np.full(len(at), n))
        found = np.unpackbits(self._lookup(prints), axis=1)[:, : len(self.length)]
        found[:, self.length != length] = 0
        for row, i in zip(*(x.tolist() for x in np.nonzero(found)), strict=True):
            if int(prints[row] ^ self.prints[i]).bit_count() <= RADIUS:
                near = similarity(bag[at[row] : at[row] + n], self.bags[i])
                if near >= SIMILARITY and (i not in best or near > best[i][3]):
                    best[i] = (i, int(starts[row]), size, near)


def n_blocks(benchmark: DataFrame, text: str = "text") -> int:
    """How many blocks of bounded items and characters the benchmark takes."""
    n, chars = benchmark.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    return max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[Row]]:
    """The benchmark's items, block by block, each of bounded size (a longer single item is a block's part)."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    parts = n_blocks(benchmark, text)
    for part in range(parts):
        mine = F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(parts)) == part
        yield sorted(items.where(mine).collect(), key=lambda r: (r[0] is not None, r[0], r[1]))


def shares(benchmark: DataFrame, docs: DataFrame, text: str, flag: str) -> DataFrame:
    """``docs`` with ``flag``: whether a document may share a shingle with an item; false only if it shares none."""
    bits, widths, hashes = np.zeros(MAP_BITS // 8, np.uint8), set(), _Hashes()
    for items in blocks(benchmark):
        for r in items:
            h = hashes.of(tokens(r[1]))
            if len(h):
                widths.add(width := min(SHINGLE, len(h)))
                at = _shingle_hashes(h, width) & np.uint64(MAP_BITS - 1)
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def one(found: np.ndarray) -> bool:
        for width in widths:
            at = _shingle_hashes(found, width) & np.uint64(MAP_BITS - 1)
            if (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).any():
                return True
        return False

    def make(lot: list[str | None], known: _Hashes = _Hashes()) -> list[pa.Array]:  # noqa: B008  one memory a task
        return [pa.array([one(known.of(tokens(t))) for t in lot], pa.bool_())]

    return map_rows(docs, text, [(flag, T.BooleanType())], make)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, similarity)`` of every contaminated document and item."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = benchmark.select("item_id").schema["item_id"].dataType
    found = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("i", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]))
    names = ["doc_id", "item_id", "first_word", "n_words", "similarity"]
    out = None
    if n_blocks(benchmark) > 1:
        src = cut(shares(benchmark, src, "text", "shares").where("shares").drop("shares"))
    for items in blocks(benchmark):
        texts, ids = [r[1] for r in items], [r[0] for r in items]

        def make(lot: list[str | None], texts: list[str] = texts, kept: list = []) -> list[pa.Array]:  # noqa: B006  one scanner a task
            if not kept:
                kept.append(Scanner(texts))
            return [pa.array([[dict(zip(("i", "first_word", "n_words", "similarity"), x, strict=True)) for x in xs] for xs in kept[0].scan(lot)], arrow)]

        got = map_rows(src, "text", [("found", found)], make, keep=["doc_id"]).where(F.size("found") > 0).select("doc_id", F.inline("found"))
        known = F.array(*[F.lit(x) for x in ids]).cast(T.ArrayType(kind))
        got = got.withColumn("item_id", F.element_at(known, F.col("i") + 1)).select(*names)
        out = got if out is None else out.unionAll(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], T.StructType([src.schema["doc_id"], T.StructField("item_id", kind), *found.elementType.fields[1:]]))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with their columns unchanged; no text is shuffled."""
    flag, names = fresh(docs, "leaks"), docs.columns
    plain = [F.col(f"`{c}`") for c in names]
    clean = None
    if n_blocks(benchmark) > 1:
        marked = cut(shares(benchmark, docs, "text", flag))
        clean, docs = marked.where(~F.col(f"`{flag}`")).select(*plain), marked.where(F.col(f"`{flag}`")).select(*plain)
    for items in blocks(benchmark):
        texts = [r[1] for r in items]

        def make(lot: list[str | None], texts: list[str] = texts, kept: list = []) -> list[pa.Array]:  # noqa: B006  one scanner a task
            if not kept:
                kept.append(Scanner(texts))
            return [pa.array([bool(x) for x in kept[0].scan(lot)], pa.bool_())]

        docs = map_rows(docs, "text", [(flag, T.BooleanType())], make).where(~F.col(f"`{flag}`")).select(*plain)
    return docs if clean is None else clean.unionByName(docs)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of ``benchmark`` into ``documents``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
