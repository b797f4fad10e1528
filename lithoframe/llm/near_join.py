"""Operator 6: exact Jaccard join of word-shingle sets, as components of the links.

The Jaccard distance 1 - |x & y| / |x | y| is a metric, so with a pivot p two documents can only link
(distance <= r) if |d(x, p) - d(y, p)| <= r. Texts that share nothing are all at distance 1 from almost any
pivot, so pivots drawn from the corpus alone would replicate every document to every region. The join
therefore makes its regions in two steps, both exact:

1. Regions. Shingles are dealt by hash into cells, and a document sends its first cells, a few more than
   the shingles in which it can differ from a partner; so two linked documents agree in a whole non-empty
   cell that both send. Equal cells join documents into a region (components over stars of cells, without
   listing pairs). A document with too few non-empty cells for that argument sends all of its cells and can
   only be missed against another such one; those also share prefix tokens.
2. Inside a region, pivots: distances to the pivot order the documents, triangle-inequality windows keep
   those that can link, a Voronoi split with boundary documents replicated (nearest pivot within 2r)
   recurses, and what is left is compared exactly. Documents already known to be connected are not
   compared again. Regions beyond BLOCK documents are worked in blocks: first each block with the region's
   pivot; then only documents outside the region's largest component meet the other blocks, and only
   blocks whose ranges of distances and sizes can link.

Equal sets are one node throughout, so copies cost nothing beyond the first scan.

Edge cases: null, empty and white texts have the empty set and link with nothing; a text of 1 to k-1 words
has the whole sequence as its one shingle; repeated rows are copies (one row each in the result), and rows of
one id with different texts are documents that share a smallest id; a row without doc_id gets the component
of its set, or null if no row with an id has that set; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, table
from .components import components
from .flat import chunks, mix64, shingles, tidied, words

#: Documents of a region that one task holds.
BLOCK = 512
#: Sets that are so common that their rows are not shuffled: fewer than so many.
COMMON = 20_000
SALT = np.uint64(0x9E3779B97F4A7C15)


class Threshold:
    """Link if den * |x & y| >= num * |x | y|; the size classes and cell counts that follow from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]  # first size of each class; a document links with sizes of its own class and the two beside it

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def size_class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def differ(self, a: int, b: int) -> int:
        """Shingles in which two linked documents of a and b shingles can differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    @staticmethod
    def sent(apart: int) -> int:
        """Cells that a document sends which can differ from a partner in so many shingles: one more, and some as cells can be empty."""
        return apart + 1 + (apart + 1) // 12 + 1

    def top(self, c: int) -> int:
        """Largest size of class c."""
        while len(self.bounds) <= c + 1:
            self.size_class(self.bounds[-1])
        return self.bounds[c + 1] - 1

    def partner(self, n: int) -> int:
        return n * self.den // self.num

    def own(self, n: int) -> int:
        """Most differences to a partner of the same class or the one above."""
        return self.differ(n, self.partner(n))

    def below(self, n: int, c: int) -> int:
        """Most differences to a partner of class c, the one below; 0 also if no size of it can link."""
        most = self.top(c)
        return self.differ(n, most) if self.den * most >= self.num * n else 0

    def cells(self, c: int) -> int:
        """Cells of configuration c, which serves pairs of class c and pairs of classes c and c + 1."""
        return self.sent(max(self.own(self.top(c)), self.differ(self.top(c + 1), self.top(c))))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix64(s ^ SALT), dtype=np.uint64)
        b = np.add.reduce(mix64(s * np.uint64(3) + SALT), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, off in chunks(column):
        _, _, doc, h = words(data, off)
        yield from shingles(doc, h, len(off) - 1, k)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and the 128-bit hash (a, b) of each document's set."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = [], [], []
            for s in _text_sets(batch.column(1), k):
                x, y = _set_hash(s) if len(s) else (0, 0)
                n.append(len(s))
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "n_shingles", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long")


def keys_of(s: np.ndarray, t: Threshold) -> list[np.ndarray]:
    """The cells that a set sends, and prefix tokens if it has few: two linked, unequal sets share one."""
    n, c, out, weak = len(s), t.size_class(len(s)), [], False
    mixed = mix64(s + SALT)
    for config, apart in ((c, t.own(n)), (c - 1, t.below(n, c - 1) if c else 0)):
        if not apart:  # only equal sets can link
            continue
        m = t.cells(config)
        cell = (((mixed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, cell, mix64(mixed))
        full = np.flatnonzero(np.bincount(cell, minlength=m))
        first = full[full < t.sent(apart)]
        if len(first) <= apart:
            weak = True  # its partner may have the cell in common among all of them
        else:
            full = first
        out.append(mix64(total[full] + mix64(full.astype(np.uint64) + np.uint64((config + 1) << 40))))
    if weak:
        need = -(-t.num * n // t.den)
        out.append(mix64(np.sort(mixed)[: n - need + 1] ^ np.uint64(0x5851F42D4C957F2D)))
    return out


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, a): the keys of every set, each set once for a batch."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = Threshold(num, den), set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                keys, nodes = [], []
                for s in _text_sets(batch.column(0)[lo : lo + 1000], k):
                    if not len(s) or (h := _set_hash(s)) in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(h)
                    for x in keys_of(s, t):
                        keys.append(x)
                        nodes.append(np.full(len(x), h[0], np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "a"])

    return docs.select("text").mapInArrow(run, "key long, a long")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _common(s: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of s with each of sets, all sorted and distinct."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
    hit = np.concatenate(([0], np.cumsum(s[at] == flat)))
    ends = np.cumsum([len(x) for x in sets])
    return hit[ends] - hit[ends - [len(x) for x in sets]]


def voronoi_links(sets: list[np.ndarray], t: Threshold, forest: Forest, members: np.ndarray, other: np.ndarray | None = None, leaf: int = 24) -> list[tuple[int, int]]:
    """Links that connect the members (with other: only members against other), by pivots, recursively and exactly."""
    r, out = 1 - t.num / t.den + 1e-9, []
    size = np.array([len(x) for x in sets])
    todo = [(members, other)]
    while todo:
        own, against = todo.pop()
        rest = own if against is None else np.concatenate([own, against])
        if len(rest) < 2 or (against is not None and not (len(own) and len(against))):
            continue
        if len(rest) <= leaf or len({forest.find(i) for i in rest.tolist()}) <= 2:
            pass
        else:
            # two pivots far from each other; both are compared with everything first
            p = int(rest[0])
            dp = _distances(p, rest, sets, size, t, forest, out)
            q = int(rest[int(np.argmax(dp))])
            dq = _distances(q, rest, sets, size, t, forest, out)
            near_p, near_q = dp <= dq + 2 * r, dq <= dp + 2 * r
            if max(near_p.sum(), near_q.sum()) <= 0.8 * len(rest):
                k = len(own)
                for near in (near_p, near_q):
                    todo.append((own[near[:k]], None if against is None else against[near[k:]]))
                continue
            order = np.argsort(dp, kind="stable")
            _windows(rest[order], dp[order], sets, size, t, r, forest, out, None if against is None else np.isin(rest[order], own))
            continue
        _windows(rest, np.zeros(len(rest)), sets, size, t, r, forest, out, None if against is None else np.isin(rest, own))
    return out


def _distances(p: int, rest: np.ndarray, sets, size, t: Threshold, forest: Forest, out: list) -> np.ndarray:
    common = _common(sets[p], [sets[i] for i in rest.tolist()])
    for i in rest[t.linked(common, size[p], size[rest])].tolist():
        if forest.union(p, i):
            out.append((p, i))
    return 1 - common / (size[p] + size[rest] - common)


def _windows(rest: np.ndarray, d: np.ndarray, sets, size, t: Threshold, r: float, forest: Forest, out: list, is_own: np.ndarray | None) -> None:
    """rest in order of the distance d to a pivot: compare those within r of each other that are not connected yet."""
    ids = rest.tolist()
    for i, x in enumerate(ids[:-1]):
        hi = int(np.searchsorted(d, d[i] + r, "right"))
        js = np.arange(i + 1, hi)
        if is_own is not None:
            js = js[is_own[js] | is_own[i]]
        if not len(js):
            continue
        n = size[x]
        ok = (t.den * np.minimum(size[rest[js]], n) >= t.num * np.maximum(size[rest[js]], n))
        root = forest.find(x)
        js = [j for j in js[ok].tolist() if forest.find(ids[j]) != root]
        for lo in range(0, len(js), 64):
            part = [ids[j] for j in js[lo : lo + 64] if forest.find(ids[j]) != forest.find(x)]
            if part:
                common = _common(sets[x], [sets[j] for j in part])
                for j in np.array(part)[t.linked(common, n, size[part])].tolist():
                    if forest.union(x, j):
                        out.append((x, j))


def _grouped(batches: Iterator[pa.RecordBatch], k: int):
    """Consecutive rows of equal (region, block) as (region, block, rows, sets); columns: region, block, node, role, set hash, others, and text."""
    now, rows, sets = None, [], []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in b.schema.names if c != "text"]
        text = b.column("text")
        for row, s in zip(zip(*cols, strict=True), (s for lo in range(0, b.num_rows, 500) for s in _text_sets(text[lo : lo + 500], k)), strict=True):
            if _set_hash(s)[0] != row[4]:  # another text under the same id
                continue
            if row[:2] != now:
                if rows:
                    yield now, rows, sets
                now, rows, sets = row[:2], [], []
            rows.append(row)
            sets.append(s)
    if rows:
        yield now, rows, sets


def _edges(pairs, region: int) -> pa.RecordBatch:
    u, v, w = (zip(*pairs, strict=True)) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.float64()), pa.array([region] * len(u), pa.int64())], ["u", "v", "d", "region"])


@tidied
def _within(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Each block with its pivot (role 0). Rows u = v carry the distance d to the pivot."""
    t = Threshold(num, den)
    for (region, _), rows, sets in _grouped(batches, k):
        forest, out, at = Forest(len(rows)), [], {}
        for i, r in enumerate(rows):
            forest.union(at.setdefault(r[5], i), i)  # connected before
        if rows[0][3] == 0:
            size = np.array([len(s) for s in sets])
            d = _distances(0, np.arange(len(rows)), sets, size, t, forest, out)
            found = [(r[2], r[2], float(x)) for r, x in zip(rows, d.tolist(), strict=True) if r[3]]
        else:
            found = []
        out += voronoi_links(sets, t, forest, np.arange(len(rows)))
        yield _edges(found + [(rows[i][2], rows[j][2], 0.0) for i, j in out], region)


@tidied
def _across(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: rows of role 0 against those of role 1; comp connects what is connected already."""
    t = Threshold(num, den)
    for (region, _), rows, sets in _grouped(batches, k):
        forest, first, at = Forest(len(rows)), {}, {}
        for i, r in enumerate(rows):
            forest.union(first.setdefault(r[5], i), i)
            forest.union(at.setdefault(r[2], i), i)
        role = np.array([r[3] for r in rows])
        out = voronoi_links(sets, t, forest, np.flatnonzero(role == 0), np.flatnonzero(role == 1))
        yield _edges([(rows[i][2], rows[j][2], 0.0) for i, j in out], region)


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links at Jaccard >= num/den on k-word shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(document_sets(docs, k))
    node = sets.where("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("node IS NOT NULL")
    node = stored(node)
    stars = signatures(docs, k, num, den)
    least = F.first("a").over(Window.partitionBy("key").orderBy("a"))
    stars = stored(stars.select("a", least.alias("least")).where("a <> least").groupBy("least", "a").agg(F.lit(1).alias("one")).select(F.col("least").alias("u"), F.col("a").alias("v")))
    region = stored(components(stars).withColumnRenamed("node", "a").withColumnRenamed("component", "region"))
    vast = stored(region.groupBy("region").count().where(F.col("count") > block).select("region"))
    work = stored(node.join(small(region), "a").select("region", "node", "n_shingles", "a").withColumn("comp", F.col("node")))

    def sized(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot")).where("n > 1")
        return stored(rows.join(small(sizes), "region"))

    blocks = F.ceil(F.col("n") / block)

    def dealt(held: DataFrame) -> DataFrame:
        """Rows of each region in blocks, the pivot of a large one (role 0) in all of its blocks."""
        pivots = held.where((F.col("n") > block) & (F.col("node") == F.col("pivot"))).select("region", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), "node", F.lit(0).alias("role"), "a", "comp")
        return held.select("region", F.pmod(F.xxhash64("node"), blocks).alias("block"), "node", F.lit(1).alias("role"), "a", "comp").unionByName(pivots)

    schema = "u long, v long, d double, region long"

    def read(rows: DataFrame) -> DataFrame:
        """rows with the texts of their nodes, dealt by region and block."""
        met = docs.join(small(stored(rows)), F.col("doc_id") == F.col("node")).select(*rows.columns, "text")
        return met.repartition("region", "block").sortWithinPartitions("region", "block", "role", "node")

    first = stored(read(dealt(sized(work))).mapInArrow(lambda it: _within(it, k, num, den), schema))
    edges = first.where("u <> v").select("u", "v")
    if vast.limit(1).count():
        # Chains of shared passages can tie many documents together. What the blocks of such a region have left
        # unconnected is read star by star: every pair that shares a cell meets in the star of the cell's least set.
        own = work.join(small(vast), "region").join(small(components(edges).withColumnRenamed("component", "c")), "node", "left").select("node", "n_shingles", "a", F.coalesce("c", "node").alias("comp"))
        own = stored(own)
        star = stars.join(small(own.select(F.col("a").alias("u"))), "u")
        rows = star.select(F.col("u").alias("region"), F.col("v").alias("a")).unionByName(star.select(F.col("u").alias("region"), F.col("u").alias("a")).distinct()).join(small(own), "a")
        # a star's size, its pivot, and whether it connects anything new, in one pass and one join
        star_of = rows.groupBy("region").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot"), (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").drop("mixed")
        held = stored(rows.join(small(stored(star_of)), "region").select("region", "node", "n_shingles", "a", "comp", "n", "pivot"))
        first = stored(read(dealt(held)).mapInArrow(lambda it: _within(it, k, num, den), schema))
        edges = edges.unionByName(first.where("u <> v").select("u", "v"))
        large = held.where(F.col("n") > block).drop("comp")
    else:
        large = None
    if large is not None and large.limit(1).count():
        comp = components(edges).withColumnRenamed("component", "comp")
        # a node can be in several regions: its distance is the one to the pivot of the region
        far = large.join(first.where("u = v").groupBy(F.col("u").alias("node"), "region").agg(F.min("d").alias("d")), ["node", "region"]).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        far = stored(far.withColumn("step", F.floor(F.col("d") * 50).cast("long")))
        most = far.groupBy("region", "comp").count().groupBy("region").agg(F.max(F.struct("count", "comp"))["comp"].alias("giant"))
        far = far.join(small(most), "region")

        def cut(df: DataFrame, name: str) -> DataFrame:
            """Blocks of about `block` documents of like distance to the pivot."""
            whole = df.groupBy("region").agg(F.ceil(F.count("*") / block).cast("long").alias("p"))
            near = df.join(small(whole), "region").withColumn("range", F.floor(F.col("step") * F.col("p") / 51).cast("long"))
            count = near.groupBy("region", "range").agg(F.ceil(F.count("*") / block).cast("long").alias("pieces"))
            return near.join(small(count), ["region", "range"]).withColumn(name, F.concat_ws(":", F.col("range").cast("string"), F.pmod(F.xxhash64("node"), F.col("pieces")).cast("string")))

        def ranges(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("region", name).agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("n_shingles").alias("s0"), F.max("n_shingles").alias("s1"))

        rest, every = cut(far.where("comp <> giant"), "xb"), cut(far, "yb")
        x, y = ranges(rest, "xb").alias("x"), ranges(every, "yb").alias("y")
        r = 1 - num / den + 1e-9
        # ranges of distance and size decide which blocks can link
        can = x.join(y, F.col("x.region") == F.col("y.region")).where(
            (F.col("x.d0") <= F.col("y.d1") + r) & (F.col("y.d0") <= F.col("x.d1") + r) & (F.col("x.s0") * num <= F.col("y.s1") * den) & (F.col("y.s0") * num <= F.col("x.s1") * den)
        ).select(F.col("x.region").alias("region"), "xb", "yb", F.concat_ws("|", "xb", "yb").alias("block"))
        can = stored(can)
        one = rest.join(small(can), ["region", "xb"]).select("region", "block", "node", F.lit(0).alias("role"), "a", "comp")
        two = every.join(small(can), ["region", "yb"]).select("region", "block", "node", F.lit(1).alias("role"), "a", "comp")
        second = stored(read(one.unionByName(two)).mapInArrow(lambda it: _across(it, k, num, den), schema))
        edges = edges.unionByName(second.select("u", "v"))
    final = components(edges)
    named = stored(node.join(small(final), "node", "left").select("a", "b", "n_shingles", "copies", F.coalesce("component", "node").alias("component_id")))
    key = ["a", "b", "n_shingles"]
    # a set that more than one row in COMMON has is one of fewer than COMMON sets: its copies stay where they are
    common = F.broadcast(named.where((F.col("copies") > block) & (F.col("copies") * COMMON > sets.count())).drop("copies"))
    some = sets.where("n_shingles > 0")
    rare = some.join(common.drop("component_id"), key, "left_anti").join(named.drop("copies"), key, "left")
    out = some.join(common, key).select(rare.columns).unionByName(rare).unionByName(sets.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")).select(rare.columns))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
