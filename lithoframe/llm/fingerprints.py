"""Operator 3: document fingerprints by a randomised edit embedding.

A walk reads a text: at step j it emits the character under it and goes on by a random bit that depends on
j and the character alone. All texts share the bits, so texts at a small edit distance fall into step again
after an edit and emit strings at a small Hamming distance. A fingerprint samples the emitted string at
fixed steps, SAMPLES of them in each of two windows: the steps that a text of up to 2^L characters needs,
where L is the level of the text's length, and those of level L - 1, so that texts of neighbouring levels
share a window. Steps after the end of the walk are marked. Likeness is the share of equal samples, less
what chance gives; across levels it is scaled by the lengths.

near_pairs and near_classes find alike fingerprints: bands of sampled positions, bit by bit of the same embedding,
make candidates, and all members of a band are verified by their likeness.

Documents are walked side by side; the last few long ones one by one. Whole texts are read.

Edge cases: a null text is empty; the empty text has a fingerprint of its own; equal texts have equal
fingerprints; a table of one row has itself as the next document; rows of equal ids are ordered by their
text; a row without doc_id comes first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, table
from .components import components
from .flat import mix64

SAMPLES = 128
#: Bands and the samples in each; times that a large band is cut by further samples; members of a band that one task compares.
BANDS, PER_BAND, FINER, BUCKET = 20, 8, 3, 1000
#: Share of equal samples of unrelated prose: equal characters, and equal digits of unequal ones.
CHANCE = 0.12
PERIOD = 1024
#: Characters that are walked side by side, at most, unless one text is longer.
TOGETHER = 24 << 20
FEW = 40
END = "."

_rng = np.random.Generator(np.random.PCG64(91))
_BITS = _rng.integers(0, 2, (PERIOD, 256)).astype(np.int32)
_BITS[:, 0] = 0  # code 0 is the end of a text
_BIT_ROWS = [r.astype(np.uint8).tobytes() for r in _BITS]
_DIGIT = _rng.integers(0, 16, (SAMPLES, 256)).astype(np.uint8)
_DIGIT[:, 0] = 16
_HEX = np.frombuffer(b"0123456789abcdef" + END.encode(), np.uint8)
_BAND = np.stack([_rng.permutation(SAMPLES)[:PER_BAND] for _ in range(BANDS)])
_FINER = [np.stack([_rng.permutation(SAMPLES)[:PER_BAND] for _ in range(BANDS // 2)]) for _ in range(FINER)]


def level(n: int) -> int:
    return max(1, (n - 1).bit_length()) if n > 1 else 1


def steps(lv: int) -> np.ndarray:
    """The sampled steps of a window, ascending."""
    return np.sort(np.random.Generator(np.random.PCG64(lv)).integers(0, 2 << lv, SAMPLES))


_STEPS = [steps(lv) for lv in range(48)]


def _codes(text: str) -> np.ndarray:
    """A byte for each code point, never 0."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((cp ^ (cp >> 8) * np.uint32(31)) % 255 + 1).astype(np.uint8)


def _walk(texts: list[str]) -> list[str]:
    codes = [_codes(t) for t in texts]
    size = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-size, kind="stable")
    buf = np.zeros(int(size.sum()) + len(texts), np.uint8)
    first = np.zeros(len(texts), np.int64)
    at = 0
    for i in order.tolist():
        buf[at : at + size[i]] = codes[i]
        first[i] = at
        at += int(size[i]) + 1
    lv = np.array([level(int(n)) for n in size])
    out = np.full((len(texts), 2, SAMPLES), 16, np.uint8)
    # which samples fall on which step, for each level in use, as (step, level, window, sample)
    todo: dict[int, list[tuple[int, int, int]]] = {}
    for v in np.unique(lv).tolist():
        for w in (0, 1):
            for s, j in enumerate(_STEPS[v - w]):
                todo.setdefault(int(j), []).append((v, w, s))
    rows = order[size[order] > 0]
    pos = first[rows].astype(np.int64)
    own = lv[rows]
    j = 0
    while len(rows) > FEW:
        c = buf[pos]
        for v, w, s in todo.get(j, ()):
            m = own == v
            out[rows[m], w, s] = _DIGIT[s][c[m]]
        pos += _BITS[j & (PERIOD - 1)][c]
        j += 1
        if not j & 63:
            live = buf[pos] > 0
            if not live.all():
                rows, pos, own = rows[live], pos[live], own[live]
    raw = buf.tobytes()
    for r, p, v in zip(rows.tolist(), pos.tolist(), own.tolist(), strict=True):
        marks = sorted({int(x) for w in (0, 1) for x in _STEPS[v - w] if x >= j})
        i = j
        for m in marks:
            while i < m and raw[p]:
                stop = min(m, (i | (PERIOD - 1)) + 1)
                for bits in _BIT_ROWS[i & (PERIOD - 1) : (i & (PERIOD - 1)) + stop - i]:
                    p += bits[raw[p]]
                i = stop
            if not raw[p]:
                break
            i = m
            for w in (0, 1):
                for s in np.flatnonzero(_STEPS[v - w] == m).tolist():
                    out[r, w, s] = _DIGIT[s][raw[p]]
    signs = _HEX[out]
    return [f"{n:x}:{signs[i, 0].tobytes().decode()}:{signs[i, 1].tobytes().decode()}" for i, n in enumerate(size.tolist())]


def fingerprints(texts: list[str]) -> list[str]:
    """Of every text: its length in hexadecimal, and the samples of its level and of the one below."""
    out: list[str] = []
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= TOGETHER):
            total += len(texts[hi])
            hi += 1
        out += _walk(texts[lo:hi])
        lo = hi
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1."""
    if a == b:
        return 1.0
    (n, a0, a1), (m, b0, b1) = a.split(":"), b.split(":")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    scale = 1.0
    if level(n) == level(m):
        x, y = a0, b0
    elif level(n) == level(m) + 1:
        x, y, scale = a1, b0, m / n
    elif level(m) == level(n) + 1:
        x, y, scale = a0, b1, n / m
    else:
        return 0.0
    p, q = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    there = (p != ord(END)) | (q != ord(END))
    if not there.any():
        return 0.0
    share = float((p == q)[there].mean())
    return scale * max(0.0, (share - CHANCE) / (1 - CHANCE))


def _signs(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the samples as characters: (text, window, sample)."""
    parts = [p.split(":") for p in prints]
    signs = np.frombuffer("".join(a + b for _, a, b in parts).encode(), np.uint8).reshape(len(prints), 2, SAMPLES)
    return np.array([int(n, 16) for n, _, _ in parts], np.int64), signs


def likenesses(i: int, js: np.ndarray, size: np.ndarray, lv: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """likeness() of text i and each of js."""
    out = np.zeros(len(js))
    for up in (-1, 0, 1):  # level of i less that of j
        at = np.flatnonzero((lv[i] - lv[js] == up) & (size[js] > 0) & (size[i] > 0))
        if not len(at):
            continue
        x, y = signs[i, int(up > 0)], signs[js[at], int(up < 0)]
        there = (x != ord(END)) | (y != ord(END))
        total = there.sum(1)
        share = ((x == y) & there).sum(1) / np.maximum(total, 1)
        scale = np.minimum(size[js[at]], size[i]) / np.maximum(size[js[at]], size[i]) if up else 1.0
        out[at] = np.where(total > 0, scale * np.maximum(0.0, (share - CHANCE) / (1 - CHANCE)), 0.0)
    out[(size[js] == size[i]) & (signs[js] == signs[i]).all((1, 2))] = 1.0
    return out


def band_keys(prints: list[str], among: np.ndarray = _BAND, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every band of every text, in both windows; bands that only tell the end of a text have none."""
    if not prints:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, signs = _signs(prints)
    lv = np.array([level(int(n)) for n in size])
    text, key = [], []
    for w in (0, 1):
        for b, at in enumerate(among):
            own = np.ascontiguousarray(signs[:, w][:, at])
            some = np.flatnonzero((own != ord(END)).any(1))
            low = np.zeros(len(some), np.uint64)
            for c in own[some].astype(np.uint64).T:
                low = low * np.uint64(31) + (c - np.uint64(45))  # signs are 0-9, a-f and the end mark
            text.append(some)
            key.append(mix64(low ^ mix64(((lv[some] - w).astype(np.uint64) << np.uint64(40)) | np.uint64(b << 20 | salt))).view(np.int64))
    return np.concatenate(text), np.concatenate(key)


def bands(fingerprint: str) -> list[int]:
    """Keys of a fingerprint's bands; fingerprints that share one are candidates."""
    return band_keys([fingerprint])[1].tolist()


def _edited(text: str, nxt: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + nxt[:q] if q else text


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STEP_SCHEMA = SCHEMA + ", part int, edge string, text string"


def _rows(ids: list, texts: list[str], last: str | None) -> list[tuple]:
    """Result rows of texts; last follows them, or the last of them only is followed."""
    nxt = texts[1:] + ([last] if last is not None else [])
    own = texts[: len(nxt)]
    edited = [_edited(a, b) for a, b in zip(own, nxt, strict=True)]
    prints = fingerprints(own + ([last] if last is not None else texts[-1:]) + edited)
    k = len(own)
    out = []
    for i in range(k):
        f, g, e = prints[i], prints[i + 1], prints[k + 1 + i]
        out.append((ids[i], len(own[i]), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(), f, e, likeness(f, e), likeness(f, g)))
    return out


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_LINK = pa.schema([("doc_id", pa.int64()), ("other", pa.int64()), ("likeness", pa.float64())])
_ARROW_STEP = pa.schema([*_ARROW, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint and that of its edited text; the next document is that of the next doc_id."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            if not ids:
                continue
            if first:
                yield _batch([(ids[0], None, None, None, None, None, None, part, "first", texts[0])], _ARROW_STEP)
                first = False
            if held:
                ids, texts = [held[0], *ids], [held[1], *texts]
            lo = 0
            while lo < len(ids) - 1:
                hi, total = lo, 0
                while hi < len(ids) - 1 and (hi == lo or total < TOGETHER // 2):
                    total += len(texts[hi])
                    hi += 1
                yield _batch([(*r, part, None, None) for r in _rows(ids[lo:hi], texts[lo:hi], texts[hi])], _ARROW_STEP)
                lo = hi
            held = (ids[-1], texts[-1])
        if held:
            yield _batch([(held[0], None, None, None, None, None, None, part, "last", held[1])], _ARROW_STEP)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                out += _rows([i], [t], n)
            yield _batch(out, _ARROW)

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = stored(one.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(walk, _STEP_SCHEMA))
    # one row a partition from here on: the first text of the next partition that has rows follows the last of this one
    firsts = cut.where("edge = 'first'").select("part", F.col("text").alias("next"))
    order = firsts.withColumn("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())))
    ends = cut.where("edge = 'last'").select("doc_id", "text", "part").join(order, "part").select("doc_id", "text", "next")
    return cut.where("edge IS NULL").select(*_ARROW.names).unionByName(ends.mapInArrow(close, SCHEMA))


def _keyed(rows: DataFrame, salt: int) -> DataFrame:
    """(key, node) for rows (node, fingerprint), or refined keys for rows (node, fingerprint, key)."""
    fine = "key" in rows.columns
    among = _FINER[salt] if fine else _BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy()
            text, key = band_keys(b.column(1).to_pylist(), among, salt)
            if fine:
                key = mix64(key.view(np.uint64) + mix64(b.column(2).to_numpy().view(np.uint64))[text]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[text])], ["key", "node"])

    return rows.mapInArrow(run, "key long, node long")


def _linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links that connect the members (bucket, part, node, fingerprint) of each bucket; part 0 meets part 1 only, if there are two."""

    def links(rows: list[tuple]) -> list[tuple[int, int, float]]:
        nodes, part = [r[2] for r in rows], np.array([r[1] for r in rows])
        size, signs = _signs([r[3] for r in rows])
        lv = np.array([level(int(n)) for n in size])
        up, out = np.arange(len(rows)), []
        for i in range(len(rows) - 1):
            js = np.flatnonzero(up[i + 1 :] != up[i]) + i + 1
            js = js[part[js] != part[i]] if part[-1] else js
            like = likenesses(i, js, size, lv, signs) if len(js) else np.zeros(0)
            for k in np.flatnonzero(like >= least).tolist():
                j = int(js[k])
                if up[i] != up[j]:
                    up[up == up[j]] = up[i]
                    out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j]), float(like[k])))
        return out

    now, rows = None, []
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "part", "node", "fingerprint")), strict=True):
            if row[0] != now:
                out += links(rows) if len(rows) > 1 else []
                now, rows = row[0], []
            rows.append(row)
        yield _batch(out, _LINK)
    yield _batch(links(rows) if len(rows) > 1 else [], _LINK)


def near_pairs(prints: DataFrame, least: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, other, likeness): verified links that connect all alike fingerprints that share a band.

    Equal fingerprints are one class, whose least doc_id stands for it (rows without doc_id have none). A band's
    members are all compared, but for those connected already. Bands beyond `bucket` members are cut by further
    samples, FINER times over; what is larger still is compared block by block, so that no member is left out.
    """
    classes = stored(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node")))
    now, found = classes, []
    for salt in range(len(_FINER) + 1):
        keys = stored(_keyed(now.select("node", "fingerprint", *(["key"] if salt else [])), salt - 1 if salt else 0))
        full = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        met = stored(keys.join(small(full), "key").distinct().join(classes, "node"))
        found.append(met.where(F.col("n") <= bucket).select(F.col("key").alias("bucket"), F.lit(0).alias("part"), "node", "fingerprint"))
        now = met.where(F.col("n") > bucket)
        if not now.limit(1).count():
            break
    else:
        blocks = F.ceil(2 * F.col("n") / bucket).cast("long")
        dealt = now.withColumn("p", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("p")))
        # each block meets itself and the blocks after it
        pairs = dealt.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))).withColumn("lo", F.least("own", "to")).withColumn("hi", F.greatest("own", "to"))
        found.append(pairs.select(F.xxhash64("key", "lo", "hi").alias("bucket"), ((F.col("own") == F.col("hi")) & (F.col("lo") < F.col("hi"))).cast("int").alias("part"), "node", "fingerprint"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "part", "node")
    links = dealt.mapInArrow(lambda it: _linked(it, least), "doc_id long, other long, likeness double")
    return links.groupBy("doc_id", "other").agg(F.max("likeness").alias("likeness"))


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, class_id): the least doc_id of all that links of near fingerprints connect."""
    prints = stored(fingerprinted(docs).select("doc_id", "fingerprint"))
    links = near_pairs(prints, least).select(F.col("doc_id").alias("u"), F.col("other").alias("v"))
    node = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    named = node.join(components(links), "node", "left").select("fingerprint", "n", F.coalesce("component", "node").alias("class_id"))
    return prints.join(named.drop("n"), "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of the operator as a query: every document with its class of near fingerprints."""
    return near_classes(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
