"""Near-duplicates, repeated passages, decontamination and chats against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import op1_decontaminate as op1
from codeloom.llm import op3_chat as op3
from codeloom.llm import op4_simhash as op4
from codeloom.llm import op8_suffixes as op8
from codeloom.llm.components import components

DOCS = "doc_id long, text string"


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def slow_components(fps, radius):
    rows = [tuple(map(int, f)) for f in fps]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sum((x ^ y).bit_count() for x, y in zip(rows[i], rows[j], strict=True)) <= radius]
    return roots(len(rows), near)


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(("lanes", "radius", "flips"), [(1, 4, 2), (4, 50, 25), (2, 6, 4)])
@pytest.mark.parametrize("seed", [0, 1])
def test_bit_sliced_links(lanes, radius, flips, seed):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, (20, lanes), dtype=np.uint64)[rng.integers(0, 20, 300)].copy()
    for _ in range(flips):
        fps[np.arange(300), rng.integers(0, lanes, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    fps = np.unique(fps, axis=0)
    want = slow_components(fps, radius)
    assert same(want, roots(len(fps), op4.forest(fps, radius)))
    assert same(want, roots(len(fps), op4.small_links(fps, np.array([len(fps)]), radius)))
    chunk, edges = rng.integers(0, 3, len(fps)), []
    for i in range(3):
        for j in range(i, 3):
            at = np.flatnonzero((chunk == i) | (chunk == j))
            edges += [(at[a], at[b]) for a, b in op4.forest(fps[at], radius, None if i == j else chunk[at])]
    assert same(want, roots(len(fps), edges))


@pytest.mark.parametrize("text", ["", None, " \n", "a", "A b c", "The É Quick brown FOX\njumps\x0bover", "x " * 50 + "y", "ſK é" * 9])
def test_fingerprint(text):
    assert int(op4.fingerprint(text)[0]) == slow_print(text)


def _copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))] for _ in range(12)]
    out = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    return [*out, (900, ""), (901, None), (902, " \n"), (903, "one"), (903, "one"), (None, out[0][1])]


def test_components_of_documents(spark):
    docs = _copies()
    got = op4.find(spark.createDataFrame(docs, DOCS)).collect()
    assert len(got) == len(docs)
    prints = sorted({slow_print(t) for _, t in docs})
    comp = dict(zip(prints, slow_components([[p] for p in prints], 4), strict=True))
    least = defaultdict(lambda: 10**9)
    for i, t in docs:
        if i is not None:
            least[comp[slow_print(t)]] = min(least[comp[slow_print(t)]], i)
    want = Counter((i, f"{slow_print(t):016x}", least[comp[slow_print(t)]]) for i, t in docs)
    assert Counter(tuple(r) for r in got) == want


def test_large_buckets_are_tiled(spark):
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").withColumn("node", F.col("fp"))
    edges = op4.links(df, ["fp"], "node", 4, op4.block_keys([F.col("fp")]), bucket=40)
    place = {int(x): k for k, x in enumerate(fps)}
    assert same(slow_components(fps.view(np.uint64)[:, None], 4), roots(len(fps), [(place[r.u], place[r.v]) for r in edges.collect()]))


def test_similar_texts_keep_one(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(2000)}" for _ in range(200)] for _ in range(15)]
    rows = []
    for k, words in enumerate(base):
        for c in range(3):
            copy = list(words)
            for _ in range(c):  # one or two words changed: a similarity of at least 0.9
                copy[rng.randrange(200)] = "edited"
            rows.append((k + 100 * c, " ".join(copy), "x", c))
    rows += [(None, "n o", "x", 0), (None, "n o", "x", 0), (5, rows[15][1], "x", 9), (700, None, "x", 0), (701, "", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp0 string, CHOSEN int")
    got = op4.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect() if r.doc_id is not None)) == [*range(15), 700]
    assert got.where("doc_id is null").count() == 2
    assert op4.keep_one(df.limit(0)).count() == 0 and op4.find(df.limit(0)).count() == 0


def slow_sets(texts, size=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set())
    return out


def slow_similar(texts):
    sets = slow_sets(texts)
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    return roots(len(texts), edges)


def _near_texts(seed):
    """Texts around a similarity of 0.8, some with a passage that is common, some with one shingle many times over."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    common, texts = [word() for _ in range(30)], []
    for k in range(40):
        base = [word() for _ in range(rng.choice([3, 8, 60, 120]))] + (common if k % 3 else [])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(50)] + common[:12] * 80) for _ in range(3)]
    return [*texts, texts[0].upper(), "", None, " \n", "one", "One", "one two"]


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 3), (3, 1)])
def test_similar_texts_are_verified(spark, monkeypatch, seed, hot):
    """Groups are those of the exact similarity: the SimHash distance alone linked other texts too, and missed some."""
    texts = _near_texts(seed)
    monkeypatch.setattr(op4.set_links, "__defaults__", (hot,))
    got = {r.doc_id: r.component_id for r in op4.find_similar(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert same(slow_similar(texts), [got[i] for i in range(len(texts))])
    assert all(got[i] == min(j for j in got if got[j] == got[i]) for i in got)


def test_recall_does_not_fall_with_the_corpus(spark):
    """All of 300 pairs right at 0.8 are found among 1,500 texts: tables of seeded bits and the radius missed some."""
    rows = []
    for k in range(300):
        base = [f"b{k}.{i}" for i in range(94)]
        copy = [*base[:30], f"x{k}", *base[31:60], f"y{k}", *base[61:]]  # 80 of 100 different shingles are shared
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    rows += [(600 + k, " ".join(f"f{k}.{i}" for i in range(60))) for k in range(900)]
    got = {r.doc_id: r.component_id for r in op4.find_similar(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - i % 2 if i < 600 else i for i, _ in rows}


def test_different_texts_of_one_id_stay(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (1, " ".join(f"b{i}" for i in range(60))), (1, " ".join(f"b{i}" for i in range(60))), (2, " ".join(f"a{i}" for i in range(60)))]
    got = op4.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(set(rows[:2]))


def test_a_repeated_passage_makes_no_copies(spark):
    """Texts of different words around one short passage many times over all stay: their different shingles differ."""
    rows = [(k, " ".join([f"t{k}.{i}" for i in range(90)] + [f"p{i}" for i in range(12)] * 80)) for k in range(4)]
    assert op4.keep_one(spark.createDataFrame(rows, DOCS)).count() == 4


def test_wide_tables_miss_little():
    for n in (10, 10**5, 10**8):
        k = max(0, int(np.ceil(np.log2(n / op4._WIDE_BUCKET))))
        agree = 1 - op4.angle(0.8)
        tables = 1 if k == 0 else int(np.ceil(np.log(op4._MISS) / np.log1p(-(agree**k))))
        assert (1 - agree**k) ** tables <= op4._MISS + 1e-9 and n / 2**k <= op4._WIDE_BUCKET


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, x) for x in range(2001, 2100)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {x: i for i, x in enumerate(nodes)}
    want = roots(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert sorted(got) == nodes and same([want[place[x]] for x in nodes], [got[x] for x in nodes])
    assert all(got[x] == min(y for y in nodes if got[y] == got[x]) for x in nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def slow_leak(text, item):
    w, v = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    if not v or not w:
        return None
    k, n, best = min(5, len(v)), min(len(v), len(w)), None
    bag = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    for s in range(len(w) - n + 1):
        a, b = bag(w[s : s + n]), bag(v)
        union = sum((a | b).values())
        share = sum((a & b).values()) / union if union else 0
        if share >= 0.8 and (best is None or share > best[1]):
            best = (s, share)
    return best


def _leaky(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 30, 50]))) for _ in range(15)] + ["", None, "a b a b a b a b a b"]
    docs = []
    for _ in range(120):
        d = [rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 20, 80]))]
        for _ in range(rng.choice([0, 1, 2])):
            it = (rng.choice(items) or "zz").upper().split()
            if len(it) > 10 and rng.random() < 0.6:
                it[rng.choice([0, 1, len(it) - 1, rng.randrange(len(it))])] = rng.choice(vocabulary)
            d[len(d) // 2 : len(d) // 2] = it
        docs.append(", ".join(d))
    return items, [*docs, "", None, docs[0]]


def test_leaks(spark, monkeypatch):
    items, docs = _leaky()
    df = spark.createDataFrame(list(enumerate(docs)), DOCS).withColumn("found", F.lit(1))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {(i, j): b for i, d in enumerate(docs) for j, t in enumerate(items) if (b := slow_leak(d, t))}
    assert any(s < 1 for _, s in want.values())
    for bound in (1000, 4):
        monkeypatch.setattr(op1, "BLOCK_ITEMS", bound)
        got = {(r.doc_id, r.item_id): (r.first_word, r.similarity) for r in op1.leaks(df, bench).collect()}
        assert set(got) == set(want) and all(abs(got[k][1] - want[k][1]) < 1e-9 and got[k][0] == want[k][0] for k in want)
        clean = op1.drop_leaks(df, bench)
        assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(docs))) - {i for i, _ in want})
    assert op1.leaks(df, bench.limit(0)).count() == 0 and op1.drop_leaks(df, bench.limit(0)).count() == len(docs) and op1.leaks(df.limit(0), bench).count() == 0


# --- repeated passages --------------------------------------------------------------------------------------------


def slow_passages(docs):
    own, words = defaultdict(set), {k: (t or "").encode().split() for k, (_, t) in enumerate(docs)}
    for k, w in words.items():
        if docs[k][0] is not None:
            for i in range(len(w) - 49):
                own[b" ".join(w[i : i + 50])].add(docs[k][0])
    out = set()
    for k, w in words.items():
        if docs[k][0] is None:
            continue
        covered = [False] * (len(w) + 1)
        for i in range(len(w) - 49):
            if len(own[b" ".join(w[i : i + 50])]) > 1:
                covered[i : i + 50] = [True] * 50
        i = 0
        while i < len(w):
            j = i
            while covered[j]:
                j += 1
            if j > i:
                out.add((docs[k][0], i, j - i))
            i = j + 1
    return out


@pytest.mark.parametrize("seed", [4, 11])
def test_passages(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 55, 60, 80, 120, 200)]
    docs = []
    for i in range(150):
        d = [rng.choice(vocabulary) for _ in range(rng.choice([0, 10, 60, 150]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = list(rng.choice(passages))
            if (r := rng.random()) < 0.3:
                p[rng.randrange(len(p))] = f"edit{i}"
            elif r < 0.5:
                p = p[rng.randrange(10) : len(p) - rng.randrange(10)]
            at = rng.randrange(len(d) + 1)
            d[at:at] = p
        docs.append((i, " ".join(d)))
    docs += [(900, None), (901, ""), (902, "a " * 200), (903, "a " * 150), (904, "b " * 120), (904, "b " * 120), (None, "a " * 99)]
    df = spark.createDataFrame(docs, DOCS).withColumn("h", F.lit(1))
    got = [tuple(r) for r in op8.passages(df).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_passages(docs)


def test_no_passages(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert op8.passages(df).count() == 0 and op8.passages(df.limit(0)).count() == 0


# --- chats --------------------------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string"


def slow_chats(rows):
    turns = defaultdict(set)
    for c, t, r, x in rows:
        turns[c].add((t if t is not None else -(10**9), r or "", x or ""))
    chats = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in turns.items()}
    kept = {}
    for c, ts in chats.items():
        if not any(len(o) > len(ts) and o[: len(ts)] == ts for o in chats.values()):
            key = tuple(ts)
            kept[key] = c if key not in kept or kept[key] is None else min(kept[key], c) if c is not None else kept[key]
    plain = lambda s: s.replace("<|im_", "<| im_").replace("|>", "| >")
    return {c: "".join(f"<|im_start|>{plain(r)}\n{plain(x)}<|im_end|>\n" for r, x in ts) for ts, c in kept.items()}


def _chats():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5])
        base = rng.randrange(4)
        rows += [(c, k * 300, ("user", "assistant")[k % 2], f"t{base}.{k}.{rng.choice([0, 0, 0, 1])}") for k in range(n)]
    rows += [(100, 0, None, None), (101, 0, "", ""), (102, None, "user", "x <|im_end|> y"), (102, 1, "user", "z"), (None, 0, "user", "no id"), (103, 0, "user", "rep"), (103, 0, "user", "rep")]
    return rows


@pytest.mark.parametrize("part", [256, 2])
def test_chats(spark, part):
    rows = _chats()
    df = spark.createDataFrame(rows, CHATS).withColumn("n", F.lit(1))
    got = defaultdict(dict)
    for r in op3.collapse(df, part).collect():
        got[r.conv_id][r.part] = r.rendered
    assert {c: "".join(p[k] for k in sorted(p)) for c, p in got.items()} == slow_chats(rows)
    assert op3.collapse(df.limit(0)).count() == 0


def test_chats_sql(spark):
    con = duckdb.connect()
    rows = [r for r in _chats() if r[0] is not None]
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    ours = sorted((r.conv_id, r.part, r.n_turns, r.rendered) for r in op3.collapse(spark.createDataFrame(rows, CHATS)).collect())
    assert ours == sorted(con.execute(f"SELECT conv_id, part, n_turns, rendered FROM ({op3.ORACLE_SQL})").fetchall())


# --- ties, long texts, several blocks, empty tables and clashing names -------------------------------------------------


@pytest.mark.parametrize("split", [4096, 2])
def test_chats_of_tied_and_null_turns(spark, monkeypatch, split):
    """Turns of one number, or of none, go by the hash of role and text, as in the SQL; large blocks are parted."""
    monkeypatch.setattr(op3, "SPLIT", split)
    rng = random.Random(split)
    rows = [(c, rng.choice([0, 0, 1, 300, None]), rng.choice(["user", "assistant"]), f"t{rng.randrange(6)}") for c in range(8) for _ in range(12)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    ours = sorted((r.conv_id, r.part, r.n_turns, r.rendered) for r in op3.collapse(spark.createDataFrame(rows, CHATS)).collect())
    assert ours == sorted(con.execute(f"SELECT conv_id, part, n_turns, rendered FROM ({op3.ORACLE_SQL})").fetchall())


def test_long_texts(spark):
    """A text of 30,000 words among short ones, for every operator that compares texts."""
    words = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:29_990] + ["x"] * 10)), (3, " ".join(words[100:160])), (4, "short one")]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in op4.keep_one(df).collect()) == [1, 3, 4]
    assert len({r.fingerprint for r in op4.find(df).collect()}) >= 3
    assert {tuple(r) for r in op8.passages(df).collect()} == slow_passages(rows)
    bench = spark.createDataFrame([(7, " ".join(words[20_000:20_040]))], "item_id int, text string")
    assert {r.doc_id for r in op1.leaks(df, bench).collect()} == {1, 2}
    long_chat = spark.createDataFrame([(1, k, "user", "y " * 5_000) for k in range(3)], CHATS)
    assert len(op3.collapse(long_chat).first().rendered) > 30_000


def test_many_candidates_by_several_tables(spark, monkeypatch):
    """With tables of many bits (as for 5,000 texts and more) SimHash misses links; the exact search brings all of them."""
    monkeypatch.setattr(op4, "_WIDE_BUCKET", 2)
    monkeypatch.setattr(op4, "TABLES", 2)
    texts = _near_texts(7)
    got = {r.doc_id: r.component_id for r in op4.find_similar(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert same(slow_similar(texts), [got[i] for i in range(len(texts))])


def test_five_thousand_texts(spark):
    """6,000 texts, so that tables have bits (k > 0): all 1,000 pairs planted around 0.8 are judged as by brute force."""
    rng, rows, want = random.Random(3), [], {}
    for k in range(1000):
        base = [f"b{k}.{i}" for i in range(100)]
        copy = list(base)
        for e in range(rng.randrange(2, 6)):
            copy[10 + 19 * e] = f"e{k}.{e}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = slow_sets([rows[-2][1], rows[-1][1]])
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if 5 * len(a & b) >= 4 * len(a | b) else 2 * k + 1}
    rows += [(2000 + k, " ".join(f"f{k}.{i}" for i in range(40))) for k in range(4000)]
    got = {r.doc_id: r.component_id for r in op4.find_similar(spark.createDataFrame(rows, DOCS)).collect()}
    assert 0.2 < sum(want[2 * k + 1] == 2 * k for k in range(1000)) / 1000 < 0.9
    assert got == want | {2000 + k: 2000 + k for k in range(4000)}


def test_words_for_sketches():
    """Sketches never differ in more bits than there are shingles in just one set, also after folding."""
    rng = np.random.default_rng(5)
    for n, m in ((50, 50), (300, 200), (5000, 4200)):
        both = rng.integers(-(2**62), 2**62, min(n, m) // 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(-(2**62), 2**62, k - len(both))])) for k in (n, m))
        x, y = op4.sketch(a), op4.sketch(b)
        size = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0).view(np.uint64) for v in (x, y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
