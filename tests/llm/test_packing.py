import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lithoframe.llm.packing import pack, plan

TOK = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing by plain search: the number of bins of each remaining room."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_equals_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist()
        histogram = {n: lengths.count(n) for n in set(lengths)}
        used, ranks = {}, {}
        for n, lo, hi, seq, per, off in plan(histogram, capacity):
            assert lo == ranks.get(n, 0)
            ranks[n] = hi
            for r in range(lo, hi):
                used.setdefault(seq + (r - lo) // per, []).append((off + (r - lo) % per * n, n))
        assert ranks == histogram
        for places in used.values():
            at = 0
            for off, n in sorted(places):
                assert off == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, capacity)


def test_pack_round_trip(spark):
    texts = [None, "", "a b", "It's don't", "x " * 5000, "é日本 \n\n tail  ", "a b", " \n ", "w" * 3000, "<|endoftext|>", "a<|endoftext|>b c<|endoftext", "tail of it", "<|endoftext|> <|endoftext|>x"]
    rows = [(i % 9 if i else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    got = pack(df, TOK).collect()
    tok = Tokenizer.from_file(TOK)
    want = []
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        k = -(-len(ids) // 1024)
        cuts = [0, *(len(ids) - 1024 * (k - 1 - p) for p in range(k))]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 1024
    assert pack(df.limit(0), TOK).count() == 0


def test_few_pieces_are_not_dealt_over_many_tasks(spark, monkeypatch):
    from lithoframe.llm import packing

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    df = spark.createDataFrame([(i, "a b " * (i % 7)) for i in range(90)], "doc_id long, text string").repartition(3)
    try:
        for k, v in zip(before, ("40", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        one = pack(df, TOK)
        assert one.rdd.getNumPartitions() == 1
        assert sorted(r.doc_id for r in one.collect()) == list(range(90))
        monkeypatch.setattr(packing, "TASK_ROWS", 10)
        assert pack(df, TOK).rdd.getNumPartitions() == 9
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_encoder_equals_the_library_and_stays_small(monkeypatch):
    """Many different words, with the known ones dropped again and again."""
    import random

    import pyarrow as pa

    from lithoframe.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 200_000)
    monkeypatch.setattr(bpe, "CHUNK", 20_000)
    r, enc, tok = random.Random(4), bpe.Encoder(TOK), Tokenizer.from_file(TOK)
    letters, most = "abcdeéß  \n'1!<|>", 0
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(400))) + r.choice(["", "<|endoftext|>", "日"]) for _ in range(900)]
    for i, ids in enc.encode(pa.array(texts)):
        assert ids.tolist() == tok.encode(texts[i], add_special_tokens=False).ids
        most = max(most, enc._size())
    assert most < 600_000
    assert [len(x) for _, x in enc.encode(pa.array(["a<|endoftext|>b"]))] == [3]
