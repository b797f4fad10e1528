"""Operator 4: secret scan by patterns and a battery of randomness tests.

Base patterns are found leftmost and non-overlapping, kind by kind, and short matches dropped afterwards.
The battery adds tokens that look random without any keyword. Of each token the encoding is inferred from
its characters. A token whose mix of character classes no random string of that encoding would have (dates,
paths, identifiers with many separators) is none. For the others, under the hypothesis that it is made of
names or words in that alphabet, three tests give p-values: chi-squared uniformity over the alphabet (words
favour few letters), runs of character classes, or of vowels and consonants in letters of one case (words
change class rarely, and vowel to consonant often), and serial correlation of vowels (words alternate). They
are combined by Cauchy's method, which holds for tests that depend on each other. The tokens of the whole
corpus are then judged together by a false-discovery rate that weights longer tokens, which can prove more,
above shorter ones: p-values are counted by BINS steps to a power of ten, rounded up, so the counts are few
whatever the corpus, and the largest step that holds the rate is the threshold for every document.

Numbers, and tokens of letters or digits fewer than 20, are never added: they prove too little.

Edge cases: null and empty texts have no spans (the hash is that of the empty string); repeated rows give
equal rows, and each counts as a test; extra columns are ignored; texts of any length are read whole; an empty
table gives an empty result. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: The base patterns, their least lengths and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Encodings by size of alphabet: the characters.
ALPHABETS = (
    ("digits", re.compile(r"[0-9]+"), 10), ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), ("letters", re.compile(r"[a-z]+|[A-Z]+"), 26), ("base32", re.compile(r"[A-Z2-7]+=*"), 32),
    ("base36", re.compile(r"[A-Z0-9]+|[a-z0-9]+"), 36), ("base62", re.compile(r"[A-Za-z0-9]+"), 62), ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), 64),
)
#: Under the words hypothesis: chance that two letters are equal; rate of class changes with one case and with two; rate of changes between vowels and consonants, and correlation of neighbouring vowels.
EQUAL, CHANGES, MIXED_CHANGES, VOWEL_CHANGES, CORRELATION = 0.058, 0.2, 0.33, 0.6, -0.3
#: Least chance of a token's mix of classes if it were random; rate of false discoveries; characters of weight 1; steps of p-values to a power of ten.
LEAST_MIX, RATE, LENGTH_UNIT, BINS = 1e-3, 0.01, 32, 100
VOWELS = frozenset("aeiouAEIOU")


def _normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _above(x: float, k: int) -> float:
    """Chance that a chi-squared value with k degrees of freedom exceeds x, by the cube root's near normality."""
    return 1.0 if x <= 0 else _normal_below(-((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))


def combined(ps: list[float]) -> float:
    """One p-value of several, which may depend on each other."""
    t = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-3)) * math.pi) for p in ps) / len(ps)
    return 0.5 - math.atan(t) / math.pi if t < 1e6 else 1 / (math.pi * t)


def encoding(token: str) -> tuple[str, int]:
    return next(((n, k) for n, p, k in ALPHABETS if p.fullmatch(token)), ("base64", 64))


def _kinds(body: str) -> list[str]:
    return ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in body]


def _mix(kind: list[str], name: str, k: int) -> float:
    """Chance of a mix of classes as far from the encoding's as this one."""
    digits = {"hex": 10, "base32": 6, "base36": 10, "base62": 10, "base64": 10}.get(name, 0)
    shares = {"d": digits, "s": k - 62} if k >= 62 else {"d": digits}
    shares |= {"u": 26, "l": 26} if k >= 62 else {"letter": k - digits}
    count = {c: 0 for c in shares}
    for c in kind:
        c = c if c in shares else "letter"
        count[c] = count.get(c, 0) + 1
    shares = {c: n for c, n in shares.items() if n}
    n = len(kind)
    x2 = sum((count[c] - n * m / k) ** 2 / (n * m / k) for c, m in shares.items())
    return _above(x2, len(shares) - 1) if len(shares) > 1 else 1.0


def p_value(token: str) -> float:
    """How likely a name or word in the token's alphabet would look as random as this; small for random tokens."""
    body = token.rstrip("=")
    n, (name, k) = len(body), encoding(token)
    kind = _kinds(body)
    if n < 8 or name == "digits" or _mix(kind, name, k) < LEAST_MIX:
        return 1.0
    counts: dict[str, int] = {}
    for c in body:
        counts[c] = counts.get(c, 0) + 1
    # chi-squared against uniform: about k - 1 if random, and more for each character if a word
    x2 = k / n * sum(v * v for v in counts.values()) - n
    excess = max(0.5, EQUAL * k - 1)
    ps = [_normal_below((x2 - (k - 1) - excess * n) / math.sqrt(2 * (k - 1) + 4 * excess * n))]
    vowel = [c in VOWELS for c in body if c.isalpha()]
    m = len(vowel) - 1
    turns = sum(a != b for a, b in zip(vowel, vowel[1:], strict=False))
    if len(set(kind)) > 1:
        rate = MIXED_CHANGES if {"u", "l"} <= set(kind) else CHANGES
        changes = sum(a != b for a, b in zip(kind, kind[1:], strict=False))
        ps.append(1 - _normal_below((changes - 0.5 - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate))))
    if m > 0 and k in (26, 32, 36):
        ps.append(_normal_below((turns + 0.5 - m * VOWEL_CHANGES) / math.sqrt(m * VOWEL_CHANGES * (1 - VOWEL_CHANGES))))
    share = sum(vowel) / max(len(vowel), 1)
    if m >= 8 and 0 < share < 1 and k > 16:
        r = sum((a - share) * (b - share) for a, b in zip(vowel, vowel[1:], strict=False)) / (m * share * (1 - share))
        ps.append(1 - _normal_below((r - CORRELATION) * math.sqrt(m)))
    return combined(ps)


def step(p: float) -> int:
    """The p-value in BINS steps to a power of ten, rounded up to the next larger one."""
    return min(15 * BINS, int(-math.log10(min(max(p, 1e-15), 1.0)) * BINS))


def weight(length: int) -> float:
    return min(2.0, length / LENGTH_UNIT)


def least_step(counts: dict[int, int], rate: float = RATE) -> int:
    """The lowest step of weighted p-values that the false-discovery rate accepts; above all steps if none."""
    total, seen, least = sum(counts.values()), 0, 15 * BINS + 1
    for s in sorted(counts, reverse=True):
        seen += counts[s]
        if 10 ** (-s / BINS) <= rate * seen / total:
            least = s
    return least


def discoveries(found: list[tuple[int, int, float]], rate: float = RATE) -> list[tuple[int, int]]:
    """Spans kept at the false-discovery rate; weights follow the length and have mean 1."""
    if not found:
        return []
    mean = sum(weight(b - a) for a, b, _ in found) / len(found)
    steps = [step(p * mean / weight(b - a)) for a, b, p in found]
    least = least_step({s: steps.count(s) for s in steps}, rate)
    return [(a, b) for (a, b, _), s in zip(found, steps, strict=True) if s >= least]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted. Runs of hex digits are matched from their least length on, which gives the same spans as dropping short ones."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of tokens that no base span covers."""
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    return [(a, b, p_value(text[a:b])) for a, b in found if not any(s <= a and b <= e for s, _, e in base)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = pa.struct([("a", pa.int64()), ("k", pa.int32()), ("b", pa.int64())])
_TOKEN = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("p", pa.float64())])


def scanned(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, counts by kind, the hash of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                rows.append((hashlib.sha256(_joined(base).encode()).hexdigest(), [dict(zip("akb", x, strict=True)) for x in base], [dict(zip("abp", x, strict=True)) for x in tokens(text, base)]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.list_(_SPAN), pa.list_(_TOKEN)), strict=True))], ["doc_id", "base_sha256", "base", "tokens"])

    schema = "doc_id long, base_sha256 string, base array<struct<a:long,k:int,b:long>>, tokens array<struct<a:long,b:long,p:double>>"
    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    weighed = lambda t: F.least(F.lit(2.0), (t["b"] - t["a"]) / F.lit(LENGTH_UNIT))
    each = found.select(F.explode("tokens").alias("t")).select(weighed(F.col("t")).alias("w"), F.col("t.p").alias("p"))
    mean = each.agg(F.avg("w")).first()[0] or 1.0
    stepped = lambda p, w: F.least(F.lit(15 * BINS), F.floor(-F.log10(F.least(F.lit(1.0), F.greatest(F.lit(1e-15), p * F.lit(mean) / w))) * BINS).cast("int"))
    counts = {r["s"]: r["count"] for r in each.groupBy(stepped(F.col("p"), F.col("w")).alias("s")).count().collect()}  # 15 BINS + 1 rows at most
    least = least_step(counts, rate)
    more = F.transform(F.filter("tokens", lambda t: stepped(t["p"], weighed(t)) >= least), lambda t: F.struct(t["a"].alias("a"), F.lit(3).alias("k"), t["b"].alias("b")))
    spans = F.array_sort(F.concat("base", more))
    name = F.array(*(F.lit(k) for k in KINDS))
    of = lambda k: F.size(F.filter("all", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")
    return found.select("doc_id", "base_sha256", spans.alias("all")).select("doc_id", *(of(k) for k in range(4)), "base_sha256", text.alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
