"""Box sets, compaction, hashes and mip levels against plain Python."""

import random

import numpy as np

from lithoframe.operators import bake


def test_box_sets(spark):
    r = random.Random(3)
    rows = []
    for key in range(5):
        for seq in range(60):
            x, y = r.randrange(1000), r.randrange(1000)
            rows.append((key, seq, x, y, x + r.randrange(-3, 90), y + r.randrange(90)))
    df = spark.createDataFrame(rows, "key long, seq long, x0 long, y0 long, x1 long, y1 long").repartition(3)
    got = {}
    for x in bake.box_sets(df).orderBy("key", "ord").collect():
        got.setdefault(x.key, []).append(tuple(x)[2:])
    for key in range(5):
        own = [x[2:] for x in rows if x[0] == key]
        assert got[key] == bake.box_set(own) and len(got[key]) <= bake.BOXES
        for b in own:
            assert b[0] > b[2] or any(k[0] <= b[0] and k[1] <= b[1] and k[2] >= b[2] and k[3] >= b[3] for k in got[key])
    assert bake.box_set([(0, 0, 1, 1), (0, 0, 1, 1), (5, 5, 4, 9), (0, 0, 9, 9), (20, 0, 21, 1)]) == [(0, 0, 9, 9), (20, 0, 21, 1)]
    far = [(0, 0, 1, 1), (100, 0, 101, 1), (200, 0, 201, 1), (300, 0, 301, 1), (302, 0, 303, 1)]
    assert bake.box_set(far) == [*far[:3], (300, 0, 303, 1)]


def members(rows):
    return sorted((x.parent, x.child, x.rot, x.flip, x.px + i * x.vax, x.py + j * x.vby) for x in rows for i in range(x.na) for j in range(x.nb))


def test_compaction_conserves_members(spark):
    r = random.Random(4)
    rows = [(1, 7, 100 + 30 * i, 50 + 20 * j, 0, 0, 1, 1, 0, 0) for i in range(12) for j in range(9)]
    rows += [(1, 7, r.randrange(5000, 9000), r.randrange(5000, 9000), 0, 0, 1, 1, 0, 0) for _ in range(40)]
    rows += [(1, 7, 100, 50, 1, 0, 1, 1, 0, 0), (2, 7, 5, 5, 0, 0, 3, 2, 90, 110)]
    df = spark.createDataFrame(rows, "parent long, child long, px long, py long, rot int, flip int, na long, nb long, vax long, vby long").repartition(3)
    got = bake.compacted(df, 20).collect()
    assert members(got) == members(df.collect()) and len(got) <= 45 and any(x.na * x.nb == 108 for x in got)
    assert members(bake.compacted(df, 500).collect()) == members(df.collect())


def test_hash_and_mip_levels(spark):
    def plain(*values):
        h = 0xCBF29CE484222325
        for v in values:
            for b in (v % 2**64).to_bytes(8, "little"):
                h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    df = spark.createDataFrame([(1, -5), (2**62, 0), (-(2**63), 77)], "a long, b long")
    assert [x.h for x in df.select("a", bake.fnv1a(df.a, df.b).alias("h")).collect()] == [plain(1, -5), plain(2**62, 0), plain(-(2**63), 77)]
    r, whole = np.random.default_rng(2), bake.TEX**2
    grid = r.integers(0, whole, (19, 21)) * (r.random((19, 21)) < 0.6)
    texels = spark.createDataFrame([(1, int(x), int(y), int(grid[y, x])) for y in range(19) for x in range(21) if grid[y, x]], "layer int, cx long, cy long, covered long")
    got = {(x.level, x.cx, x.cy): x.v for x in bake.mip_levels(texels, 21, 19).collect()}
    now, k = grid / whole, 0
    while True:
        for y in range(now.shape[0]):
            for x in range(now.shape[1]):
                assert got.get((k, x, y), 0) == min(255, int(now[y, x] * 255 + 0.5))
        if max(now.shape) <= 8:
            break
        h, w = now.shape[0] // 2, now.shape[1] // 2
        now, k = now[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean((1, 3)), k + 1
    assert max(level for level, _, _ in got) == k
