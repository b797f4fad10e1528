"""The query against brute force: every window of every item at every place of every document."""

import random

import numpy as np

from lithoframe.llm import decontam as dc

MARKS = (dc.NUMBER, dc.NAME, dc.UNIT)


def tokens(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return [(t.tolist(), v.tolist()) for _, t, v in dc.readings(raw, np.array([0, len(raw)]))]


def longest(it, iv, dt, dv):
    """Tokens of the longest consistent chain, over all places where a window of the item stands in the document."""
    w = min(dc.WINDOW, len(it))
    diagonals = {}
    literal = [t not in MARKS for t in it]
    if w < dc.WINDOW and sum(literal) < dc.MIN_LITERAL:
        return 0
    for j in range(len(it) - w + 1):
        if sum(literal[j : j + w]) < min(dc.MIN_LITERAL, w):
            continue
        for i in range(len(dt) - w + 1):
            if it[j : j + w] == dt[i : i + w]:
                diagonals.setdefault(i - j, []).append((j, w))
    a = [np.array(x, np.uint64) for x in (it, iv, dt, dv)]
    return max((dc.consistent(a[0][at], a[1][at], a[2][to], a[3][to])[0] for at, to in dc.chained_runs(diagonals)), default=0)


def brute(docs, items):
    out = {}
    for d, text in docs:
        for k, item in items:
            for (dt, dv), (it, iv) in zip(tokens(text), tokens(item), strict=True):
                n = longest(it, iv, dt, dv) if it and text is not None and item is not None else 0
                if n and (n >= min(dc.LONG, len(it)) or (n >= dc.WINDOW and 2 * n >= len(it))):
                    out[d, k] = max(out.get((d, k), 0), n)
                    break
    return out


def test_equals_brute_force(spark):
    r = random.Random(31)
    words = "the a of river market paid for boxes apples she travelled and then bought many old lamps near station every morning".split()
    names = "James Maria Berlin London Anna Peter".split()
    make = lambda n: " ".join(r.choice(words) if x < 0.7 else r.choice(names) if x < 0.85 else f"{r.randrange(90)} km" if x < 0.9 else str(r.randrange(900)) for x in (r.random() for _ in range(n)))
    items = [(i, ". ".join(make(r.randrange(3, 14)).capitalize() for _ in range(r.randrange(1, 4)))) for i in range(25)]
    items += [(3, items[3][1]), (25, None), (26, ""), (27, "two words"), (None, items[5][1])]

    def changed(text):
        out = []
        for w in text.split():
            w = r.choice(names) if w in names and r.random() < 0.5 else str(r.randrange(900)) if w.isdigit() and r.random() < 0.5 else w
            out += [w, r.choice(words)] if r.random() < 0.03 else [w]
        return " ".join(out)

    docs = []
    for d in range(70):
        parts = [make(r.randrange(0, 40))]
        for _ in range(r.randrange(0, 3)):
            t = changed(r.choice(items[:25])[1])
            parts += [t.upper() if r.random() < 0.2 else t, make(r.randrange(0, 30))]
        docs.append((d, " ".join(parts)))
    docs += [docs[4], (5, docs[8][1]), (90, None), (91, ""), (None, docs[7][1]), (92, make(20000) + " " + items[1][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, h string").repartition(4)
    bench = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 40
    for most in (dc.WINDOW_ROWS, 0):  # broadcast, and both sides shuffled
        rows = dc.contaminated(df, bench, most).collect()
        assert len(rows) == len({(x.doc_id, x.item_id) for x in rows})
        assert {(x.doc_id, x.item_id): x.n_tokens for x in rows} == want
    assert dc.contaminated(df, bench.limit(0)).count() == 0 == dc.contaminated(df.limit(0), bench).count()


def test_pairs_are_judged_one_at_a_time():
    """Python objects of all pairs of a batch at once took as much memory as a worker may have."""
    import tracemalloc

    import pyarrow as pa

    words = [int(x) for x in np.arange(1, 9) * 10**17]
    hits = [{"i": 3 * x, "j": x % 50, "token": words, "value": words, "dv": words} for x in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "doc_key": [1] * 300, "item_id": [2] * 300, "reading": pa.array([0] * 300, pa.int32()), "n_item": pa.array([60] * 300, pa.int32()), "hits": [hits] * 300})
    want = dc.cover(60, [(x["i"], x["j"], x["token"], x["value"], x["dv"]) for x in hits])
    tracemalloc.start()
    rows = next(iter(dc._judged(iter([batch])))).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["n_tokens"], r["n_slots"]) for r in rows] == [want] * (300 if want[0] >= dc.LONG else 0)
    assert most < 3 << 20
