"""Banding and verification against comparing every two fingerprints."""

import random

import numpy as np
import pytest

from lithoframe.llm import fingerprints as fp


def prose(r, n):
    return " ".join("".join(r.choice(["ka", "to", "ri", "men", "sol", "va", "ner", "il"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def changed(r, t, k):
    t = list(t)
    for _ in range(k):
        i = r.randrange(len(t))
        t[i : i + r.randrange(2)] = r.choice("abcdefgh ")
    return "".join(t)


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_likenesses_equal_likeness():
    r = random.Random(2)
    texts = [prose(r, r.randrange(0, 80)) for _ in range(40)]
    prints = fp.fingerprints(texts + [changed(r, t + " ", 3) for t in texts])
    size, signs = fp._signs(prints)
    lv = np.array([fp.level(int(n)) for n in size])
    js = np.arange(len(prints))
    for i in range(len(prints)):
        assert np.allclose(fp.likenesses(i, js, size, lv, signs), [fp.likeness(prints[i], p) for p in prints])


@pytest.mark.parametrize("bucket", [1000, 6])
def test_recall_among_strangers(spark, bucket):
    """Groups of near copies among strangers: at least nine of ten alike pairs are in one class, and no link is false."""
    r = random.Random(bucket)
    texts = [prose(r, r.randrange(20, 200)) for _ in range(700)]
    for t in texts[:120]:
        texts += [changed(r, t, r.randrange(1, 4 + len(t) // 80)) for _ in range(3)]
    prints = fp.fingerprints(texts)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)] + [(5000, prints[3]), (None, prints[4])], "doc_id long, fingerprint string")
    got = fp.near_pairs(df, bucket=bucket).collect()
    assert all(x.other < x.doc_id and abs(fp.likeness(prints[x.doc_id], prints[x.other]) - x.likeness) < 1e-9 and x.likeness >= 0.8 for x in got)
    size, signs = fp._signs(prints)
    lv = np.array([fp.level(int(n)) for n in size])
    alike = [(i, j) for i in range(len(prints)) for js in [np.arange(i + 1, len(prints))] for j in js[fp.likenesses(i, js, size, lv, signs) >= 0.8].tolist()]
    own = roots(len(prints), [(x.other, x.doc_id) for x in got])
    assert len(alike) > 250 and sum(own[a] == own[b] for a, b in alike) >= 0.9 * len(alike)


def test_classes_of_copies_and_edge_cases(spark):
    r = random.Random(3)
    base = prose(r, 120)
    rows = [(i, base) for i in range(5, 25)] + [(30, changed(r, base, 2)), (31, prose(r, 90)), (32, None), (33, ""), (None, base), (34, "x" * 50000), (34, "x" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'c' AS fingerprint", "1 AS node", "2 AS key")
    got = sorted(((x.doc_id or -1), x.class_id) for x in fp.near_classes(df).collect())
    assert got == sorted([(-1, 5), *((i, 5) for i in range(5, 25)), (30, 5), (31, 31), (32, 32), (33, 32), (34, 34), (34, 34)])
    assert fp.near_classes(df.limit(0)).count() == 0
