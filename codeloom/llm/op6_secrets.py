"""Secret scanning in native expressions: fixed patterns, and a battery of randomness tests.

Patterns give the base spans: assignments to telling names, access-key ids, long hexadecimal runs.
Positions come from splitting a text at a pattern: gaps and matches alternate, so a fold over both
yields every match's place in one pass over the text.

Other runs of 20 or more token characters are candidates. Each one's encoding (hex, base32, base36, base62, base64) is
inferred, and a battery of three tests asks whether its symbols could be drawn at random from that alphabet:
chi-squared uniformity, runs above and below the middle, and serial correlation. What the battery rejects is no secret.

Failing to reject randomness proves nothing about a short token, so false discoveries are bounded from the other side.
The null hypothesis is structured text: words, numbers and separators, as a chain of characters whose bigrams come from a
small word list. The likelihood ratio of this chain to a uniform draw of the alphabet bounds the p-value of a token (by
Markov's inequality a structured token has a ratio of p or less with a probability of p at most), and the control of
Benjamini and Hochberg over all candidates of a length class of the corpus, from a histogram of bounded size, decides: of
what it reports as random, ``Q`` at most is structured text by mistake.

Texts never move: one pass finds base spans and candidates with their p-values, which are written without the texts.

Defined cases: a null text is empty; an empty one has no spans (the hash is that of the empty string); long texts are
scanned whole; repeated rows are scanned alike; an empty table gives an empty result; columns called ``base`` or ``spans``
stay, and the new ones get the next free names.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, let

# The base patterns, in the order of their kinds.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: False discoveries among reported tokens at most, and the battery's level.
Q = 0.01
LEVEL = 0.001
#: Lower ends of the length classes, each with its own false-discovery control.
CLASSES = (20, 28, 40, 56, 80)
#: p-values are counted by their order of magnitude, in steps of a twentieth down to 10**-16.
BINS = 320
_ALPHABETS = (
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[0-9A-Za-z+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
# Words that letter bigrams are counted in, of common prose and of names in code, in four languages.
WORDS = """
the and that have with this from they would there their what about which when make like time just know take people into year your good
some could them other than then look only come over think also back after work first well even want because any these give most
account action address agent analysis application archive array async average backend base batch before binary block boolean branch
browser buffer build button cache callback category change channel check class client cluster color column command commit component config
connection constant container content context control controller copy count create cursor customer data database date debug default
delete deploy description design detail device dialog directory display document domain download draft driver editor element email
engine entity entry environment error event example export factory feature field file filter final folder format frame function
gateway group handler header height helper history image implementation import index input instance integration interface item job
kernel label layer layout length level library license limit link list loader local location logger login machine manager mapping
master message metadata method migration model module monitor name network node notification number object offset operation option
order output package page parameter parser partition password path pattern payment pipeline plugin policy port position prefix
process product profile project property protocol provider proxy query queue random range read record reference region register
release remote render report repository request resource response result return role route rule runtime sample schedule schema
screen script search section security sequence server service session setting shape signature simple size snapshot socket source
standard state static status storage stream string structure style submit summary support system table target task template test
text thread thumbnail ticket title token toolbar topic trace transaction transform type unit update upload user utility validate
value variable vector version video view virtual warehouse warning web widget window worker wrapper write zone
und der die das nicht werden haben eine einen durch schule strasse gesellschaft verwaltung zeitung wissenschaft
les des une dans pour avec est sont plus cette histoire gouvernement question travail
los las una para con por como pero esta historia gobierno tambien desde trabajo
""".split()
#: Chances in structured text: from a letter, digit or separator to each, that a letter keeps the case of the letter before
#: it, and the weight of a letter's frequency against its bigrams.
TO = {"letter": (0.86, 0.05, 0.09), "digit": (0.12, 0.74, 0.14), "separator": (0.78, 0.20, 0.02)}
SAME_CASE = 0.92
SMOOTH = 12.0
_KINDS = "letter", "digit", "separator"
#: States of the chain: lower-case letters, upper-case letters, digits, separators.
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_STATES = 54
_SPAN = "array<struct<start:bigint,kind:int,stop:bigint,text:string>>"


def spans(text: Column, pattern: str, kind: int, hint: str | None = None, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches; with ``least``, of those whose group 1 is that long."""
    shown = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else F.lit(None).cast("array<string>")
    # As arguments of one fold, gaps and matches are worked out once a text.
    steps = F.zip_with(F.split(text, pattern, -1), F.zip_with(shown, group, lambda a, b: F.struct(a.alias("m"), b.alias("g"))) if least else shown, lambda a, b: F.struct(a.alias("gap"), b.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        m = x["hit"]["m"] if least else x["hit"]
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(m), F.lit(0))
        good = m.isNotNull() & (F.length(x["hit"]["g"]) >= least if least else F.lit(True))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), m.alias("text"))
        return F.struct(stop.alias("at"), F.when(good, F.array_append(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(_SPAN)
    found = F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, F.lit(hint or pattern)), found).otherwise(none)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""

    def part(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly

    return F.when(z >= 0, part(z)).otherwise(1 - part(-z))


def _values(token: Column) -> Column:
    """The token's symbols as places in its inferred alphabet, and the alphabet's size: struct (v, k)."""

    def of(alphabet: str) -> Column:
        places = F.transform(F.split(F.rtrim(token, F.lit("=")), ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
        return F.struct(F.filter(places, lambda v: v > 0).alias("v"), F.lit(float(len(alphabet))).alias("k"))

    out = of(_ALPHABETS[-1][2])
    for _, pattern, alphabet in reversed(_ALPHABETS[:-1]):
        out = F.when(F.regexp_like(token, F.lit(pattern)), of(alphabet)).otherwise(out)
    return out


def p_random(token: Column) -> Column:
    """The battery's p-value: small if the token's symbols are no random draw from its alphabet."""

    def battery(x: Column) -> Column:
        v, k = x["v"], x["k"]
        n = F.size(v).cast("double")
        # Squared counts add up to the number of equal ordered pairs; a place's count is met count times.
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(v, lambda y: y == d)).cast("double"), F.lit(2.0)))
        chi, df = squares * k / n - n, k - 1
        # Wilson and Hilferty: the cube root of chi-squared is nearly normal.
        p_chi = _tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(v, lambda y: y > k / 2)).cast("double")
        low = n - high
        runs = 1 + F.size(F.filter(pairs, lambda y: (y["a"] > k / 2) != (y["b"] > k / 2)))
        mean_runs = 1 + 2 * high * low / n
        spread = F.sqrt(F.greatest(2 * high * low * (2 * high * low - n) / (n * n * (n - 1)), F.lit(1e-12)))
        p_runs = F.when((high == 0) | (low == 0), F.pow(F.lit(0.5), n - 1)).otherwise(2 * _tail(F.abs(runs - mean_runs) / spread))
        mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
        total = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
        cross = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + (y["a"] - mean) * (y["b"] - mean))
        r = F.when(total > 0, cross / total).otherwise(1.0)
        p_serial = 2 * _tail(F.abs(r + 1 / n) * F.sqrt(n))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    return F.when(F.size(_values(token)["v"]) >= CLASSES[0] - 4, let(_values(token), battery)).otherwise(0.0)


def length_class(token: Column) -> Column:
    """Number of the token's length class."""
    out = F.lit(0)
    for k, least in enumerate(CLASSES[1:], 1):
        out = F.when(F.length(token) >= least, k).otherwise(out)
    return out


@cache
def structured() -> tuple[float, ...]:
    """Logarithms of the chances from state to state in structured text, row by row."""
    pairs = Counter(p for w in WORDS for p in zip(w, w[1:], strict=False))
    after, single = Counter(c for w in WORDS for c in w[:-1]), Counter("".join(WORDS))
    total = sum(single.values())

    def kind(state: int) -> str:
        return _KINDS[(state >= 52) + (state >= 53)]

    def chance(i: int, j: int) -> float:
        to = TO[kind(i)][_KINDS.index(kind(j))]
        if kind(j) != "letter":
            return to / (10 if kind(j) == "digit" else 5)
        b = _LOWER[j % 26]
        often = (single[b] + 1) / (total + 26)
        if kind(i) != "letter":
            return to * often * (0.7 if j < 26 else 0.3)
        a = _LOWER[i % 26]
        # A capital begins a word, so what follows a small letter in capitals isn't its bigram; small after capital is.
        follows = (pairs[a, b] + SMOOTH * often) / (after[a] + SMOOTH)
        if (i < 26) == (j < 26):
            return to * SAME_CASE * follows
        return to * (1 - SAME_CASE) * (often if i < 26 else follows) if i < 26 else to * 0.5 * follows

    return tuple(math.log(chance(i, j)) for i in range(_STATES) for j in range(_STATES))


def log_p(token: Column) -> Column:
    """The common logarithm of the p-value under structured text: 0 at most, the lower the less like words and numbers."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in structured())), ",").cast("array<double>")

    def state(c: Column) -> Column:
        letter = F.instr(F.lit(_LOWER + _LOWER.upper()), c)
        return F.when(letter > 0, letter - 1).when(F.instr(F.lit("0123456789"), c) > 0, 52).otherwise(53)

    def ratio(states: Column) -> Column:
        pairs = F.zip_with(F.slice(states, F.lit(1), F.size(states) - 1), F.slice(states, F.lit(2), F.size(states) - 1), lambda i, j: i * _STATES + j)
        words = F.aggregate(pairs, F.lit(0.0), lambda a, at: a + F.get(table, at))
        return words + F.size(pairs) * F.log(_size(token))

    states = F.transform(F.split(F.rtrim(token, F.lit("=")), ""), state)
    return F.least(F.lit(0.0), let(states, ratio) / math.log(10))


def _size(token: Column) -> Column:
    """Symbols of the token's inferred alphabet."""
    out = F.lit(float(len(_ALPHABETS[-1][2])))
    for _, pattern, alphabet in reversed(_ALPHABETS[:-1]):
        out = F.when(F.regexp_like(token, F.lit(pattern)), float(len(alphabet))).otherwise(out)
    return out


def _bin(power: Column) -> Column:
    """The bin of a p-value's common logarithm: 0 for the smallest ones."""
    return F.greatest(F.lit(0), F.floor((F.greatest(power, F.lit(-16.0)) + 16) * (BINS / 16))).cast("int")


def candidates(text: Column, base: Column) -> Column:
    """Runs of token characters outside the base spans that the battery doesn't reject, with the bin of their p-value."""
    free = F.filter(spans(text, CANDIDATE, KINDS.index("random")), lambda x: ~F.exists(base, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])))

    def judged(x: Column) -> Column:
        word = F.rtrim(x["text"], F.lit("="))
        b = F.when(p_random(x["text"]) >= LEVEL, _bin(log_p(word))).otherwise(BINS)
        return x.withField("c", length_class(x["text"])).withField("b", b)

    return F.transform(free, judged)


def thresholds(found: DataFrame, more: str) -> dict[int, int]:
    """By length class the number of lowest bins that are random: Benjamini-Hochberg on the histogram of all candidates."""
    rows = found.select(F.explode(f"`{more}`").alias("x")).groupBy("x.c", "x.b").count().collect()
    out: dict[int, int] = {}
    for c in {r["c"] for r in rows}:
        counts = {r["b"]: r["count"] for r in rows if r["c"] == c}
        total, so_far, out[c] = sum(counts.values()), 0, 0
        for b in range(BINS + 1):
            so_far += counts.get(b, 0)
            # The bin's upper end must be at most Q times the share of p-values up to it.
            if counts.get(b) and 10 ** ((b + 1) * 16 / BINS - 16) <= Q * so_far / total:
                out[c] = b + 1
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with arrays of (start, kind, stop, text) in order: base spans, then all spans.

    They are called ``base`` and ``spans``, or the next free names; they are the last two columns.
    """
    keep = docs.columns if keep is None else keep
    base, more, name = fresh(docs, "base"), fresh(docs, "more"), fresh(docs, "spans")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.array_sort(F.concat(spans(t, ASSIGN, 0, ASSIGN_HINT, least=6), spans(t, ACCESS, 1), spans(t, HEX, 2)))
    kept = [F.col(f"`{c}`") for c in keep]
    out = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])], found.alias(base))
    out = cut(out.select(*kept, base, candidates(t, F.col(f"`{base}`")).alias(more)))
    limit = thresholds(out, more)

    def random(x: Column) -> Column:
        bins = F.lit(0)
        for c, n in limit.items():
            bins = F.when(x["c"] == c, n).otherwise(bins)
        return x["b"] < bins

    plain = F.transform(F.filter(F.col(f"`{more}`"), random), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["text"].alias("text")))
    return out.select(*kept, base, F.array_sort(F.concat(F.col(f"`{base}`"), plain)).alias(name))


def joined(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def count(found: Column, kind: str) -> Column:
    """How many of the spans are of this kind."""
    return F.size(F.filter(found, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and a digest of the base spans, and all spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    counts = [count(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
