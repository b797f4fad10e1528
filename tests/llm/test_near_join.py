import random
import re

import numpy as np
import pytest

from lithoframe.llm.near_join import Forest, Threshold, keys_of, near_components, voronoi_links


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            a = len(sets[x] & sets[y])
            if a and den * a >= num * (len(sets[x]) + len(sets[y]) - a):
                p, q = find(x), find(y)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n, most):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(vocab) for _ in range(30))
    out, bases = [], [[rng.choice(vocab) for _ in range(rng.randint(1, most))] for _ in range(n // 8)]
    for i in range(n):
        w = list(rng.choice(bases[:2] if i % 3 == 0 else bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, len(w) // 20])):
            j = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and j < len(w):
                w[j] = rng.choice(vocab)
            else:
                w.insert(j, rng.choice(vocab))
        t = " ".join(w)
        out.append((i, t.upper() if i % 11 == 0 else t + ("\n" + line if i % 7 == 0 else "")))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "One"), (n + 5, "two words"), (n + 6, "words two")]


@pytest.mark.parametrize("k,num,den,block,most", [(3, 90, 100, 512, 60), (5, 80, 100, 16, 300), (3, 90, 100, 8, 200)])
def test_components_equal_brute_force(spark, k, num, den, block, most):
    rows = corpus(k + block, 260, most)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(df, k, num, den, block).collect()}
    assert got == brute(rows, k, num, den)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (5, "A b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in near_components(df).orderBy("doc_id").collect()] == [(3, 2, 3), (3, 2, 3), (5, 2, 3)]
    assert near_components(df.limit(0)).count() == 0


def test_rows_without_id_long_texts_and_common_sets(spark):
    """Rows without doc_id keep their set's component; a set that most rows have, and very long near copies."""
    rng = random.Random(6)
    long = [str(rng.randrange(9000)) for _ in range(60000)]
    near = long[:30000] + ["odd"] + long[30000:]
    rows = [(i, "the very same eight words in each row") for i in range(10, 60)]
    rows += [(None, "the very same eight words in each row"), (None, "words of a row without an id"), (None, None), (70, " ".join(long)), (71, " ".join(near)), (72, " ".join(long[:40000])), (73, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS a", "2 AS node", "3 AS n_shingles")
    got = near_components(df, 3, 90, 100, block=8).collect()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert len(got) == len(rows)
    assert all(by[i, 6] == 10 for i in range(10, 60))
    assert {r.component_id for r in got if r.doc_id in (70, 71)} == {70} and {r.component_id for r in got if r.doc_id in (72, 73)} == {72, 73}
    assert sorted((r.n_shingles, r.component_id or -1) for r in got if r.doc_id is None) == [(0, -1), (5, -1), (6, 10)]


def test_linked_sets_share_a_key():
    """Sets of every size, up to the most that linked ones can differ."""
    rng, met, none = np.random.default_rng(1), 0, [np.zeros(0, np.uint64)]
    for num, den in ((80, 100), (90, 100)):
        t = Threshold(num, den)
        for n in [*range(1, 13), 15, 20, 25, 30, 40, 50, 75, 100, 150, 300, 800, 2500]:
            for _ in range(150 if n < 400 else 30):
                x = rng.integers(1, 2**63, n, dtype=np.uint64)
                y = np.concatenate([x[rng.integers(0, max(1, n // 5) + 1) :], rng.integers(1, 2**63, rng.integers(0, max(1, n // 4) + 2), dtype=np.uint64)])
                a, b = np.unique(x), np.unique(y)
                c = len(np.intersect1d(a, b))
                if len(b) and not c == len(a) == len(b) and den * c >= num * (len(a) + len(b) - c):
                    met += 1
                    assert len(np.intersect1d(np.concatenate(keys_of(a, t) or none), np.concatenate(keys_of(b, t) or none)))
    assert met > 1500


def test_voronoi_links_by_themselves():
    rng = np.random.default_rng(2)
    base = [rng.choice(3000, 80, replace=False) for _ in range(6)]
    sets = []
    for i in range(300):
        s = base[i % 6].copy()
        s[: rng.integers(0, 9)] += 5000
        sets.append(np.unique(s).astype(np.uint64))
    t, a, b = Threshold(9, 10), Forest(300), Forest(300)
    voronoi_links(sets, t, a, np.arange(300))
    for x in range(300):
        for y in range(x):
            c = len(np.intersect1d(sets[x], sets[y]))
            if 10 * c >= 9 * (len(sets[x]) + len(sets[y]) - c):
                b.union(x, y)
    assert [a.find(i) for i in range(300)] == [b.find(i) for i in range(300)]
