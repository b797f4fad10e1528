import hashlib
import random

import duckdb

from lithoframe.llm.line_dedup import SQL, LineIndex, dedup_lines


def test_equals_sql_and_plain_python(spark, tmp_path):
    rng = random.Random(1)
    shared = [("A Shared Line of more than forty characters " + "xyz" * i) for i in range(6)]
    rows = []
    for i in range(60):
        ls = [rng.choice([" ", "\t", ""]) + rng.choice(shared) + rng.choice(["  ", "\r", "\x0b"]) if rng.random() < 0.6 else rng.choice(["short", "", "É" * 41, "own line of document %d that is rather long indeed" % i]) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(ls), "c"))
    rows += [(60, None, "c"), (61, "", "c"), (62, "\n\n", "c"), (63, shared[0].lower(), "c"), (None, shared[0], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_lines(df).collect())
    held, key = {}, lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    want = []
    for i, t, _ in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if i is None or len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        want.append((-1 if i is None else i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    assert got == sorted(want)
    path = str(tmp_path / "d.parquet")
    df.toPandas().to_parquet(path)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM '{path}'")
        assert sorted((-1 if a is None else a, b, n, h) for a, b, n, h in c.execute(SQL).fetchall()) == got
    assert dedup_lines(df.limit(0)).count() == 0


def test_runs_share_no_key_and_hold_the_largest_document(spark):
    rng = random.Random(8)
    held, index = {}, LineIndex(buckets=3)
    for batch in range(7):  # of descending ids
        rows = [(1000 - 100 * batch - rng.randrange(100), h := int(rng.random() ** 2 * 40), -h) for _ in range(120)]
        for d, h, _ in rows:
            held.setdefault(h, set()).add(d)
        index.add(spark.createDataFrame(rows + rows[:5] + [(None, 1, -1)], "doc_id long, h1 long, h2 long"))
        runs = [r for level in index.levels for r in level]
        assert all(len(level) < index.fanout for level in index.levels)
        keys = [r.h1 for run in runs for r in run.collect()]
        assert len(keys) == len(set(keys)) and set(keys) == set(held)
    for least in (1, 5, 30):
        assert {(r.h1, r.last_doc) for r in index.frequent(least).collect()} == {(h, max(d)) for h, d in held.items() if len(d) >= least}
    a, b = index.levels[0][0], index.levels[1][0]
    plan = a.join(b.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert LineIndex().frequent() is None


def test_batches_change_nothing(spark):
    line = "a line that is certainly longer than forty characters"
    df = spark.createDataFrame([(i, f"{line} {i % 3}\nown {i}") for i in range(40)] * 2, "doc_id long, text string")
    want = sorted(map(tuple, dedup_lines(df, batches=1).collect()))
    assert sorted(map(tuple, dedup_lines(df, batches=6).collect())) == want and sum(r[3] for r in want) == 74
