"""Each stage of the pipeline against brute force, and the whole of it on a small corpus with edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lithoframe.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def prose(r, n):
    return " ".join("".join(r.choice(["ka", "to", "ri", "men", "sol", "va", "ner", "il", "am"]) for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables: good and bad texts, copies, near copies, common lines, benchmark passages, and odd rows."""
    r, at = random.Random(9), tmp_path_factory.mktemp("corpus")
    bench = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30))) for i in range(8)]
    line = "Copyright notice and navigation of this particular site, all rights reserved."
    rows, labels = [], []
    for i in range(240):
        good = i % 4 != 0
        text = "\n".join([prose(r, r.randrange(20, 90)) for _ in range(3)] + ([line] if i % 5 == 0 else [])) if good else " ".join(r.choice(["BUY!!!", "$$$", "###", "click|here", "WIN@@", "%%%"]) for _ in range(60))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    texts = dict(rows)
    rows += [(300 + i, texts[i]) for i in (1, 2, 3, 5)]  # copies
    rows += [(310 + i, texts[i].replace(".", ". so", 1)) for i in (6, 7, 9)]  # near copies
    rows += [(400 + i, prose(r, 40) + " " + t + " " + prose(r, 40)) for i, t in bench]
    rows += [(500, None), (501, ""), (None, prose(r, 50)), (502, prose(r, 9000)), (503, "\n\n"), (310 + 6, texts[6].replace(".", ". so", 1))]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    for name, data, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return str(at), docs, bench


def key(r):
    return tuple(str(x) for x in r)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_every_stage_and_the_whole(spark, corpus):
    sf, rows, bench = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    # 1: what the classifier rejects goes, rows are untouched
    kept = stages["quality classifier"](spark, docs, sf)
    assert kept.schema.names == docs.schema.names
    first = sorted(map(tuple, kept.collect()), key=key)
    good = {d for d, *_ in rows if d is not None and d < 240 and d % 4}
    assert {x[0] for x in first} >= good and not {x[0] for x in first} & {d for d in range(240) if not d % 4}
    assert set(first) <= set(rows)
    scores = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), quality.remainder(quality.F.col("doc_id"), 3) != 1), "doc_id").collect()}
    assert {x[0] for x in first} == {d for d, s in scores.items() if s >= 0.5}
    # 2: the common line stays in the largest document only
    second = sorted(map(tuple, stages["line dedup"](spark, kept, sf).collect()), key=key)
    line = "Copyright notice and navigation of this particular site, all rights reserved."
    largest = max(d for d, t, *_ in first if d is not None and line in (t or "").split("\n"))
    assert len(second) == len(first)
    held = {}
    for d, t, *_ in first:
        for x in {x.strip().lower() for x in (t or "").split("\n")}:
            if d is not None and len(x) >= 40:
                held.setdefault(x, set()).add(d)
    want = []
    for d, t, a, b, _ in first:
        keep = [x for x in (t or "").split("\n") if d is None or len(held.get(x.strip().lower(), ())) < 5 or max(held[x.strip().lower()]) == d]
        want.append((d, "\n".join(keep), a, b, len("\n".join(keep))))
    assert second == sorted(want, key=key)
    assert [x[0] for x in second if line in x[1].split("\n")] == [largest]
    # 3: one document of each group stays
    third = sorted(map(tuple, stages["n-gram Jaccard join"](spark, spark.createDataFrame(second, SCHEMA), sf).collect()), key=key)
    least = {}
    sets = [(x, shingles(x[1])) for x in second]
    up = {i: i for i in range(len(sets))}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j][1]) >= 80 * len(s | sets[j][1]):
                up[find(i)] = find(j)
    for i, (x, s) in enumerate(sets):
        if x[0] is not None:
            least[find(i)] = min(least.get(find(i), x[0]), x[0])
    assert third == sorted([x for i, (x, s) in enumerate(sets) if x[0] is None or not s or least[find(i)] == x[0]], key=key)
    # 4: documents with benchmark passages go, all others stay
    fourth = sorted(map(tuple, stages["benchmark decontamination"](spark, spark.createDataFrame(third, SCHEMA), sf).collect()), key=key)
    assert fourth == [x for x in third if not any(t in (x[1] or "") for _, t in bench)] and len(fourth) < len(third)
    # 5: all pieces of all documents
    packed = stages["best-fit packing"](spark, spark.createDataFrame(fourth, SCHEMA), sf).collect()
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d, t, *_ in fourth:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        k = -(-len(ids) // 1024)
        cuts = [0, *(len(ids) - 1024 * (k - 1 - p) for p in range(k))]
        pieces += [(d, p, a, b - a, zlib.crc32(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(x)[:5] for x in packed), key=key) == sorted(pieces, key=key)
    # the whole is the stages one after another
    whole = cp.run(spark, sf).collect()
    assert sorted((tuple(x)[:5] for x in whole), key=key) == sorted(pieces, key=key)


def test_stages_on_empty_tables_and_clashing_columns(spark, corpus):
    sf, *_ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    more = docs.selectExpr("*", "1 AS score", "'x' AS component_id", "2 AS n_lines", "3 AS h1", "4 AS item_id", "5 AS length", "6 AS node")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns and out.schema["score"].dataType == more.schema["score"].dataType, name
        assert out.where("score = 1 AND component_id = 'x' AND n_lines = 2 AND h1 = 3 AND item_id = 4 AND length = 5 AND node = 6").count() == out.count() > 0, name
    assert cp.STAGES[-1][1](spark, more, sf).columns[:4] == ["doc_id", "piece", "start", "length"]
