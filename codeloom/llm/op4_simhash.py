"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made where the text lies; from there on only distinct 64-bit fingerprints move.
Two that differ in at most 4 of 64 bits agree on at least two of six blocks of bits, so fifteen
tables keyed by two blocks each (about 21 bits) bring every such pair together. A bucket is compared
vertically: bit planes of up to thousands of fingerprints meet one fingerprint at a time, carry-save
counters add up the differing bits of 64 fingerprints a machine word, and a block of planes is
abandoned as soon as all its counters exceed the radius. A bucket's component is grown breadth
first, so fingerprints known to be connected are never compared again and only a spanning forest leaves
the task. Buckets over ``BUCKET`` fingerprints are dealt to tiles, each pair of chunks one task's work.

:func:`find` has the 64-bit fingerprints over four words and radius 4. :func:`keep_one`, for pipelines,
links texts of a similarity of at least 0.8 over five words. 256-bit SimHashes of the sets of different shingles,
compared by the same bit-sliced buckets, propose links; a distance only estimates a similarity, so each is verified by
the exact similarity of the two sets. What tables of seeded bits miss is found by an exact filter on prefixes of the
sets, which looks only between texts that aren't linked yet: no pair is lost, at any size of the corpus.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated
rows share a component; a null ``doc_id`` takes part but never names a component (which is null if
no member has an id); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, map_rows, scratch
from .components import components

SHINGLE = 4
RADIUS = 4
SIMILARITY = 0.8
SEED = 42
#: Bits of the six blocks; radius 4 leaves at least two of them untouched.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A bucket of more fingerprints than this is compared in tiles by several tasks.
BUCKET = 16384
#: For sets of shingles: the most frequent of those counted more often than this go to the end of the order (any order
#: is exact); shingles are counted in lots of so many.
HOT = 64
MOST_HOT = 200_000
COUNTED = 1 << 19
#: Bits of a parity sketch for each shingle, and bits at least and at most.
SKETCH = 2
LEAST_SKETCH = 256
MOST_SKETCH = 1 << 22
#: For links proposed by SimHash: lanes of 64 bits, the radius (about the mean distance at 0.8) and the tables.
LANES = 4
WIDE_RADIUS = 40
TABLES = 8
#: Bits of the map of wanted sets at most, and of one of Spark's bit maps.
MAP_BITS = 1 << 27
_PAGE = 1 << 15
_PIECE = 1 << 13
_LOT = 256
#: For wide fingerprints: fingerprints in a table's bucket on average, and the share of links missed by ``groups``.
_WIDE_BUCKET = 1024
_MISS = 0.005


def _spread(h: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 64-bit hashes from each hash: itself, then its mixtures with odd constants."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for k in range(1, lanes):
        x = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE, lanes: int = 1) -> np.ndarray:
    """The text's SimHash in ``lanes`` words: a bit is 1 if set in over half of the shingles' hashes."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    stops, digest = ends[size - 1 :].tolist(), xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64), lanes)


def majority(h: np.ndarray, lanes: int) -> np.ndarray:
    """The SimHash of hashes: the bits that are set in over half of them."""
    ones = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), _PIECE):
        ones += np.unpackbits(_spread(h[i : i + _PIECE], lanes).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, names: list[str], text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint in signed longs, one a name."""
    lanes = len(names)

    def make(texts: list[str | None]) -> list[pa.Array]:
        got = np.array([fingerprint(t, shingle, lanes) for t in texts], np.uint64).reshape(-1, lanes).view(np.int64)
        return [pa.array(np.ascontiguousarray(got[:, k])) for k in range(lanes)]

    return map_rows(docs, text, [(n, T.LongType()) for n in names], make, keep)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n x lanes): row b holds bit b of each, 64 of them a word."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    packed = np.packbits(np.pad(bits, ((0, -n % 64), (0, 0))), axis=0, bitorder="little")
    return np.ascontiguousarray(packed.T).view(np.uint64)


def near(query: np.ndarray, vertical: np.ndarray, radius: int) -> np.ndarray:
    """Bit mask (queries x words) of the fingerprints in ``vertical`` within ``radius`` of each query.

    ``digits`` are the binary digits of each lane's count of differing bits and ``over`` its overflow.
    Planes are added four at a time by carry-save adders, on whole words; after each sixteen the
    block is abandoned if every lane's count exceeds the radius.
    """
    shape, full = (len(query), vertical.shape[1]), np.uint64(2**64 - 1)
    digits = [np.zeros(shape, np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = np.zeros(shape, np.uint64)
    flip = np.unpackbits(np.ascontiguousarray(query).view(np.uint8).reshape(len(query), -1), axis=1, bitorder="little")
    flip = flip.astype(np.uint64) * full

    def add(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """A full adder: ``digits[k]`` takes the sum of three words, the carry is returned."""
        half = digits[k] ^ x
        carry = (digits[k] & x) | (half & y)
        digits[k] = half ^ y
        return carry

    above = over
    for b in range(0, len(vertical), 4):
        w, x, y, z = (vertical[b + i] ^ flip[:, b + i, None] for i in range(4))
        carry = add(add(w, x, 0), add(y, z, 0), 1)
        for k in range(2, len(digits)):
            rest = digits[k] & carry
            digits[k] ^= carry
            carry = rest
        over |= carry
        if b % 16 == 12:
            above, equal = over.copy(), ~over
            for k in range(len(digits) - 1, -1, -1):
                if radius >> k & 1:
                    equal &= digits[k]
                else:
                    above |= equal & digits[k]
                    equal &= ~digits[k]
            if (above == full).all():
                break
    return ~above


def forest(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (positions) that connect just what the links within the radius connect.

    Growth is breadth first, up to ``_LOT`` fingerprints at a time. What is reached leaves the pool,
    and fingerprints known to be of one component aren't compared again, so a dense group costs
    little more than one comparison each. With ``side``, links within a side don't count.
    """
    n = len(fps)
    label, rest, queue = np.arange(n), np.arange(n), np.empty(0, np.int64)
    edges: list[tuple[int, int]] = []
    while len(rest) or len(queue):
        if len(queue):
            lot = queue[label[queue] == label[queue[0]]][:_LOT]
            queue = np.setdiff1d(queue, lot, assume_unique=True)
        else:
            lot, rest = rest[:_LOT], rest[_LOT:]
        open_to = np.concatenate((queue, lot))
        if (label[lot] == label[lot[0]]).all():
            open_to = open_to[label[open_to] != label[lot[0]]]
        pool = np.concatenate((rest, open_to))
        if not len(pool):
            continue
        mask = near(fps[lot], planes(fps[pool]), radius)
        hit = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(pool)].astype(bool)
        if side is not None:
            hit &= side[lot][:, None] != side[pool]
        hit[:, len(rest) :] &= lot[:, None] != pool[len(rest) :]
        at = np.flatnonzero(hit.any(axis=0))
        if not len(at):
            continue
        first = hit[:, at].argmax(axis=0)
        pairs = list(zip(lot[first].tolist(), pool[at].tolist(), strict=True))
        # A fingerprint that several of the lot reach connects them all.
        who, what = np.nonzero(hit[:, at])
        joined = np.unique(np.stack((who, first[what])), axis=1)
        pairs += [(int(lot[i]), int(lot[j])) for i, j in joined.T if i != j]
        for i, j in pairs:
            if label[i] != label[j]:
                edges.append((i, j))
                old, new = (i, j) if i > j and label[i] == i else (j, i)
                label[label == label[old]] = label[new]
        reached = at[at < len(rest)]
        queue = np.concatenate((queue, rest[reached]))
        rest = np.delete(rest, reached)
    return edges


def small_links(fps: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions) within many small buckets at once: each pair is a lane of the bit planes."""
    starts = np.cumsum(sizes) - sizes
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(sizes):
        i, j = np.triu_indices(n, 1)
        base = starts[sizes == n][:, None]
        a.append((base + i).ravel())
        b.append((base + j).ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    edges: list[tuple[int, int]] = []
    zero = np.zeros((1, fps.shape[1]), np.uint64)
    for i in range(0, len(a), 1 << 15):
        x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
        hit = np.unpackbits(near(zero, planes(fps[x] ^ fps[y]), radius).view(np.uint8), bitorder="little")[: len(x)].astype(bool)
        edges += zip(x[hit].tolist(), y[hit].tolist(), strict=True)
    return edges


def _bit(lanes: list[Column], b: int) -> Column:
    return F.shiftrightunsigned(lanes[b // 64], b % 64).bitwiseAND(F.lit(1).cast("long"))


def block_keys(lanes: list[Column]) -> Column:
    """Fifteen (table, two blocks) keys, one long each, for radius 4 of 64 bits: no pair is missed."""
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(F.shiftrightunsigned(lanes[0], at).bitwiseAND(F.lit(2**width - 1).cast("long")))
        at += width
    pairs = enumerate(combinations(range(len(BLOCKS)), 2))
    return F.array(*[F.lit(t << 32).cast("long").bitwiseOR(F.shiftleft(blocks[i], 11)).bitwiseOR(blocks[j]) for t, (i, j) in pairs])


def table_keys(lanes: list[Column], n: int, agree: float, tables: int | None = None) -> Column:
    """(table, k bits) keys for wide fingerprints of which linked ones agree in each bit with ``agree``.

    ``k`` lets a table's buckets hold about ``_WIDE_BUCKET`` of ``n`` fingerprints; as many tables of
    seeded bits are used as miss a pair that agrees in just this share of bits with a probability of at most ``_MISS``;
    pairs that agree in fewer are missed more often, the more so the larger ``n`` is. With ``tables``, there are just
    so many, for callers that find the rest in another way.
    """
    k = max(0, math.ceil(math.log2(max(n, 1) / _WIDE_BUCKET)))
    tables = 1 if k == 0 else tables or math.ceil(math.log(_MISS) / math.log1p(-(agree**k)))
    draw = np.random.default_rng(SEED)
    keys = []
    for t in range(tables):
        key = F.lit(t << 40).cast("long")
        for i, b in enumerate(draw.choice(64 * len(lanes), k, replace=False).tolist()):
            key = key.bitwiseOR(F.shiftleft(_bit(lanes, b), i))
        keys.append(key)
    return F.array(*keys)


def _comparer(lanes: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares sorted buckets of rows (key, i, j, c, id, lanes); one bucket is in memory at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[tuple[np.ndarray, np.ndarray]] = []
        held: dict = {}

        def out(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
            uv = ids[np.array(edges, np.int64).reshape(-1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(uv[:, k])) for k in (0, 1)], names=["u", "v"])

        def flush() -> Iterator[pa.RecordBatch]:
            if small:
                sizes = np.array([len(ids) for ids, _ in small])
                edges = small_links(np.concatenate([f for _, f in small]), sizes, radius)
                if edges:
                    yield out(np.concatenate([ids for ids, _ in small]), edges)
                small.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            (_, i, j), rows = held["name"], np.concatenate(held["rows"], axis=1)
            held.clear()
            chunk, ids, fps = rows[0], rows[1], np.ascontiguousarray(rows[2:].T).view(np.uint64)
            if i == j and len(ids) <= 48:
                small.append((ids, fps))
                if len(small) >= 4096:
                    yield from flush()
            elif edges := forest(fps, radius, chunk if i != j else None):
                yield out(ids, edges)

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5 + lanes)]
            if not len(cols[0]):
                continue
            head = np.stack(cols[:3])
            cuts = np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1
            rows = np.stack(cols[3:])
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cols[0])], strict=True):
                name = tuple(head[:, a].tolist())
                if held and held["name"] != name:
                    yield from close()
                held.setdefault("name", name)
                held.setdefault("rows", []).append(rows[:, a:b])
        yield from close()
        yield from flush()

    return compare


def links(distinct: DataFrame, names: list[str], node: str, radius: int, keys: Column, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` between nodes that connect all fingerprints within the radius, bucket by bucket.

    ``distinct`` has a row for each different fingerprint with a long ``node`` and its words ``names``.
    """
    keyed = distinct.select(F.col(node).alias("id"), *names, F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / bucket).cast("int")
    dealt = keyed.join(shared, "key").withColumn("m", parts).withColumn("c", F.pmod(F.xxhash64("id"), parts).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least(F.col("c"), k).alias("i"), F.greatest(F.col("c"), k).alias("j")))
    tiled = dealt.withColumn("t", F.explode(tiles)).select("key", "t.i", "t.j", "c", "id", *names)
    tiled = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tiled.mapInArrow(_comparer(len(names), radius), "u long, v long")


def groups(prints: DataFrame, names: list[str], radius: int, similarity: float | None = None) -> DataFrame:
    """``(*names, component_id)`` of every distinct fingerprint in ``prints(doc_id, *names)``.

    A fingerprint of several words is stood for by a hash of them; its tables follow from ``similarity``.
    """
    distinct = prints.groupBy(*names).agg(F.min("doc_id").alias("least"))
    lanes = [F.col(c) for c in names]
    if len(names) == 1:
        distinct, keys = distinct.withColumn("node", F.col(names[0])), block_keys(lanes)
    else:
        distinct = cut(distinct.withColumn("node", F.xxhash64(*names)))
        keys = table_keys(lanes, distinct.count(), 1 - angle(similarity))
    roots = components(links(distinct, names, "node", radius, keys))
    # Only linked fingerprints go through their root. What is aggregated by a root is cut before it is joined, so that
    # the join has an exchange of its own on both sides and Spark can split the rows of a hot root.
    linked = cut(distinct.select("node", "least").join(roots, "node"))
    ids = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    named = linked.join(ids, "root").select("node", F.lit(True).alias("_linked"), "component_id")
    member = distinct.join(named, "node", "left")
    return cut(member.select(*names, F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))


def angle(similarity: float) -> float:
    """The share of bits in which bags of this Jaccard similarity (of equal size) differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row: links at ``RADIUS`` of 64 bits, none missed."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        prints = cut(fingerprints(src, ["fp"], keep=["doc_id"]))
        got = prints.join(groups(prints, ["fp"], RADIUS), "fp")
        return cut(got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), keep=True)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The text's different shingles as sorted 64-bit hashes; a text of fewer words is one shingle, none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    joined, size, digest = b" ".join(words), min(shingle, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def _node(found: np.ndarray) -> int:
    """What stands for a set: texts with the same shingles have the same node."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each class of shingles: whether their number is odd. There are about ``SKETCH`` classes a shingle, a power of 2.

    Sketches of one size differ in at most as many bits as there are shingles in just one of the two sets, and one
    folds to half its size by the exclusive-or of its halves.
    """
    size = min(max(LEAST_SKETCH, 1 << (SKETCH * len(found) - 1).bit_length()), MOST_SKETCH) if len(found) else LEAST_SKETCH
    return np.packbits(np.bincount(found & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrow lists of longs."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def nodes(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """``(*keep, node, n, sketch, print)`` of every row."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingle_set(t, shingle) for t in texts]
        prints = [majority(x.view(np.uint64), LANES).view(np.int64) for x in sets]
        return [pa.array(list(map(_node, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), _lists(list(map(sketch, sets))), _lists(prints)]

    longs = T.ArrayType(T.LongType())
    return map_rows(docs, "text", [("node", T.LongType()), ("n", T.LongType()), ("sketch", longs), ("print", longs)], make, keep=keep)


def _each_set(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Nodes, sizes and sets, lot by lot, of the texts with words; a task gives each node once."""
    seen: set[int] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, _LOT):
            fresh_sets = {}
            for text in batch.column(0).slice(i, _LOT).to_pylist():
                found = shingle_set(text, shingle)
                if len(found) and (node := _node(found)) not in seen:
                    seen.add(node)
                    fresh_sets[node] = found
            if fresh_sets:
                sets = list(fresh_sets.values())
                yield np.array(list(fresh_sets), np.int64), np.array([len(x) for x in sets], np.int64), sets


def frequent(docs: DataFrame, shingle: int) -> DataFrame:
    """``(key, c)``: how many sets have a shingle, as far as two of a lot of ``COUNTED`` shingles do.

    Where n lots hold a table, a shingle of some sqrt(n) sets or fewer may not show; so many can't make much work.
    """

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        key, c = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[c > 1]), pa.array(c[c > 1])], names=["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, n, sets in _each_set(batches, shingle):
            held += sets
            size += int(n.sum())
            if size >= COUNTED:
                yield count(held)
                held, size = [], 0
        yield count(held)

    return docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def prefixes(docs: DataFrame, shingle: int, similarity: Fraction, hot: dict[int, int]) -> DataFrame:
    """``(key, node, n, pos)``: of each set the first n - ceil(similarity n) + 1 shingles, ``hot`` ones last, by their count.

    Two sets of at least ``similarity`` share one of these, whatever the order is, as long as it is one for all sets.
    ``pos`` is a shingle's place in the order of its set, from 0.
    """
    known = np.array(sorted(hot), np.int64)
    counts = np.array([hot[k] for k in known.tolist()], np.int64)
    over, under = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, n, sets in _each_set(batches, shingle):
            flat, row = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, counts[at], 0)
            order = np.lexsort((flat, rank, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place < (n + (-n * over) // under + 1)[row]
            key, row = flat[order][first], row[first]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(n[row]), pa.array(place[first])], names=["key", "node", "n", "pos"])

    return docs.select("text").mapInArrow(run, "key long, node long, n long, pos long")


def may_fit(similarity: Fraction, n: str, pos: str, m: str, at: str) -> Column:
    """Whether two sets of ``n`` and ``m`` shingles can be similar enough if the first that they share is at these places.

    What comes before is in one set only. A pair need only pass at its first shared shingle, which it always does if it is
    similar enough; at later ones the bound is stricter.
    """
    over, under = similarity.numerator, similarity.denominator
    most = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))
    return most * (over + under) >= (F.col(n) + F.col(m)) * over


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit map, of at most ``MAP_BITS`` bits, of the one column of longs; :func:`marked` looks a hash up."""
    bits = min(MAP_BITS, max(_PAGE, 1 << (16 * hashes.count()).bit_length()))
    at = F.pmod(F.col(hashes.columns[0]), F.lit(bits))
    pages = hashes.select(F.floor(at / _PAGE).cast("int").alias("page"), (at % _PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    found = np.zeros(bits // 8, np.uint8)
    for r in pages.collect():
        found[r.page * _PAGE // 8 : (r.page + 1) * _PAGE // 8] = np.frombuffer(r.map, np.uint8)
    return found


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the map: never false for one that is."""
    place = hashes % (8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def sets_of(docs: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """``(node, n, set)`` for each ``node`` of ``wanted``.

    A bit map of them is tried where the text lies; few other sets move.
    """
    bits = bit_map(wanted.select("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, n, sets in _each_set(batches, shingle):
            keep = np.flatnonzero(marked(bits, node))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(n[keep]), _lists([sets[k] for k in keep])], names=["node", "n", "set"])

    got = docs.select("text").mapInArrow(run, "node long, n long, set array<long>")
    return cut(got.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def _apart(batches: Iterator[pa.RecordBatch], similarity: Fraction) -> Iterator[pa.RecordBatch]:
    """Of rows (u, v, n_a, n_b, a, b) the pairs (u, v) whose sketches don't rule the similarity out."""
    over, under = similarity.numerator, similarity.denominator

    def folded(x: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)

    for batch in batches:
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        good = np.zeros(batch.num_rows, bool)
        for k, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            x, y = a.values.to_numpy(), b.values.to_numpy()
            size = min(len(x), len(y))
            differ = int(np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum())
            good[k] = differ * (over + under) <= int(total[k]) * (under - over)
        at = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in (0, 1)], names=["u", "v"])


def similar(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets have at least this Jaccard similarity, exactly.

    Sketches that differ in too many bits rule nearly all other pairs out, and never one that is similar enough.
    """
    over, under = similarity.numerator, similarity.denominator
    total, fits = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b") * under >= F.greatest("n_a", "n_b") * over
    side = lambda df, value, node, x, m: df.select(F.col("node").alias(node), F.col(value).alias(x), F.col("n").alias(m))
    pairs = pairs.join(side(sketches, "sketch", "u", "a", "n_a"), "u").join(side(sketches, "sketch", "v", "b", "n_b"), "v").where(fits)
    pairs = cut(pairs.select("u", "v", "n_a", "n_b", "a", "b").mapInArrow(lambda batches: _apart(batches, similarity), "u long, v long"))
    sets = sets_of(docs, shingle, cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
    both = F.size(F.array_intersect("a", "b"))
    pairs = pairs.join(side(sets, "set", "u", "a", "n_a"), "u").join(side(sets, "set", "v", "b", "n_b"), "v")
    return cut(pairs.where(both * (over + under) >= total * over).select("u", "v"))


def simhash_pairs(sketches: DataFrame, similarity: Fraction) -> DataFrame:
    """Pairs ``(u, v)`` that connect what SimHashes within ``WIDE_RADIUS`` connect in ``TABLES`` tables of seeded bits."""
    names = [f"s{k}" for k in range(LANES)]
    prints = cut(sketches.where("n > 0").select("node", *[F.col("print")[k].alias(c) for k, c in enumerate(names)]))
    keys = table_keys([F.col(c) for c in names], prints.count(), 1 - angle(float(similarity)), TABLES)
    found = links(prints, names, "node", WIDE_RADIUS, keys)
    return cut(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def set_links(docs: DataFrame, sketches: DataFrame, shingle: int, similarity: Fraction, hot_from: int = HOT) -> DataFrame:
    """Verified links ``(u, v)`` that connect just what all pairs of at least ``similarity`` connect.

    Links that SimHashes propose join most; the prefixes of the sets are then searched for pairs of different
    components, of a bucket's hub first, then of all that are left. Shingles of more than ``hot_from`` sets go to the end of the order, by their count: a passage in a
    third of all texts then is in few prefixes. Sets are made from the texts again where they are needed, which takes
    less than to keep them.
    """
    proposed = similar(simhash_pairs(sketches, similarity), sketches, docs, shingle, similarity)
    roots = components(proposed)
    most = frequent(docs, shingle).where(F.col("c") > hot_from).orderBy(F.desc("c"), "key").limit(MOST_HOT)
    hot = {r.key: r.c for r in most.collect()}
    shared = cut(prefixes(docs, shingle, similarity, hot).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    keyed = cut(prefixes(docs, shingle, similarity, hot).join(shared.select("key"), "key").distinct())
    # In each bucket the member of most links so far is compared with those of other components, which joins nearly all
    # of what is left of a dense group: a group's origin has most links.
    many = proposed.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    known = cut(roots.join(many, "node", "left"))
    named = keyed.join(known, "node", "left")
    named = cut(named.select("key", "node", "n", "pos", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    hub = F.max(F.struct("links", "node", "n", "pos", "root")).alias("hub")
    mixed = cut(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub).where("low <> high").select("key", "hub"))
    named = cut(named.drop("links").join(mixed, "key"))
    star = named.select(F.col("node").alias("u"), "n", "pos", "root", F.col("hub.node").alias("v"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("at"), F.col("hub.root").alias("root_v"))
    star = star.where((F.col("root") != F.col("root_v")) & may_fit(similarity, "n", "pos", "m", "at"))
    star = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    proposed = proposed.union(similar(star, sketches, docs, shingle, similarity))
    named = named.drop("root", "hub").join(components(proposed), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.select("key", "node", "n", "pos", "root"))
    mixed = cut(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"))
    named = cut(named.join(mixed, "key"))
    other = named.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("root_v"))
    rest = named.withColumnRenamed("node", "u").join(other, "key").where((F.col("u") > F.col("v")) & (F.col("root") != F.col("root_v")) & may_fit(similarity, "n", "pos", "m", "at"))
    return proposed.union(similar(rest.select("u", "v").distinct(), sketches, docs, shingle, similarity))


def _similar_sets(docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, node)`` of every row, with a hash of its text, and ``(node, root)`` of the linked sets."""
    ratio = Fraction(similarity).limit_denominator(1000)
    found = nodes(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), shingle, ["doc_id", "mark"])
    rows = cut(found)
    sketches = cut(rows.select("node", "n", "sketch", "print").dropDuplicates(["node"]))
    return rows.drop("sketch", "print"), components(set_links(docs, sketches, shingle, ratio))


def find_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5) -> DataFrame:
    """``(doc_id, component_id)`` for every row, linking texts whose different shingles are at least this similar.

    Similarity is Jaccard's, exact but for collisions of 64-bit hashes, and no pair of at least ``similarity`` is missed.
    """
    with scratch(docs.sparkSession):
        rows, roots = _similar_sets(docs, similarity, shingle)
        least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
        rooted = cut(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
        named = cut(rooted.join(ids, "root").select("node", "component_id"))
        return cut(rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id"), keep=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, that of the smallest ``doc_id`` and hash of the text, its columns unchanged.

    Of rows that repeat both one stays; different texts under one ``doc_id`` are told apart. Rows without a
    ``doc_id`` all stay, as nothing tells which of them to keep.
    """
    with scratch(docs.sparkSession):
        rows, roots = _similar_sets(docs, SIMILARITY, 5)
        rows = rows.where(F.col("doc_id").isNotNull())
        least = rows.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count(F.lit(1)).alias("rows"))
        rooted = cut(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        # Groups of one row need no look; of the others every row but the chosen one goes.
        several = cut(rooted.groupBy("root").agg(F.min("least").alias("least"), F.sum("rows").alias("rows")).where("rows > 1"))
        inside = cut(rooted.select("node", "root").join(several.select("root"), "root").select("node"))
        grouped = cut(rows.join(inside, "node").select("doc_id", "mark").distinct())
        lost = cut(grouped.join(several.select("least.doc_id", "least.mark"), ["doc_id", "mark"], "left_anti"), keep=True)
        bits = bit_map(grouped.select(F.xxhash64("doc_id", "mark")))
    look = F.pandas_udf(lambda hashes: pd.Series(marked(bits, hashes.to_numpy())), "boolean")

    mark, seen, lost_id = fresh(docs, "text_mark"), fresh(docs, "seen"), fresh(docs, "lost_id")
    known = docs.where(F.col("doc_id").isNotNull()).withColumn(mark, F.xxhash64("text")).withColumn(seen, look(F.xxhash64("doc_id", mark)))
    lost = lost.select(F.col("doc_id").alias(lost_id), F.col("mark").alias(f"{lost_id}_mark"))
    # Only rows that the bit map marks move.
    tried = known.where(F.col(seen)).join(lost, (F.col("doc_id") == F.col(lost_id)) & (F.col(mark) == F.col(f"{lost_id}_mark")), "left_anti")
    tried = tried.dropDuplicates(["doc_id", mark])
    return known.where(~F.col(seen)).unionByName(tried).drop(mark, seen).unionByName(docs.where(F.col("doc_id").isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
