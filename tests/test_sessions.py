"""Session ledgers, alone and as state of a stream."""

import json
import os

import pytest

from lithoframe.streaming.sessions import REQUESTS, Ledger, ProtocolError, updates

PAGES = [(p, p, 10) for p in range(5)]


def test_prefix_commit_and_rollback():
    g = Ledger(100)
    assert g.answer(1, PAGES, 25)["new"] == [0, 1]
    with pytest.raises(ProtocolError):
        g.answer(2, PAGES)
    g.acknowledge(0)  # the client never applied it
    u = g.answer(2, PAGES, 5)
    assert u["new"] == [0] and u["deferred"] == 4 and u["partial"]
    g.acknowledge(2)
    assert g.used == {0: 2} and g.held == 10
    g.acknowledge(2)  # again: nothing
    with pytest.raises(ProtocolError):
        g.acknowledge(9)
    with pytest.raises(ProtocolError):
        g.answer(2, PAGES)


def test_eviction_spares_the_view_and_reset_keeps_generations():
    g = Ledger(30)
    for gen, pages in ((1, [(1, 0, 10)]), (2, [(2, 0, 10)]), (3, [(1, 0, 10), (3, 0, 10)])):
        g.request(gen, gen - 1, False, pages, 0)
    u = g.request(4, 3, False, [(4, 0, 10), (5, 0, 10), (2, 0, 10)], 0)
    assert u["evict"] == [1, 3] and u["projected_bytes"] == 30
    again = Ledger.load(g.dump(), 30)
    again.reset()
    assert not again.used and again.last == 4
    before = g.dump()
    with pytest.raises(ProtocolError):
        g.request(4, 4, False, [], 0)
    assert g.dump() == before


def test_stream_equals_the_table(spark, tmp_path):
    rows = []
    for s in ("a", "b"):
        for gen in range(1, 7):
            rows.append({"session": s, "gen": gen, "ack": None if gen == 1 else gen - 1 - (gen == 4), "reset": gen == 5, "pages": [{"page": (gen * k) % 7, "prio": k, "bytes": 10 + k} for k in range(4)], "stream_bytes": 25})
    (tmp_path / "in").mkdir()
    for gen in range(1, 7):
        (tmp_path / "in" / f"{gen}.json").write_text("\n".join(json.dumps(r) for r in rows if r["gen"] == gen))
        os.utime(tmp_path / "in" / f"{gen}.json", (gen * 1000, gen * 1000))  # files arrive in this order
    want = sorted(map(str, updates(spark.read.schema(REQUESTS).json(str(tmp_path / "in")), 40).collect()))
    stream = updates(spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 2).json(str(tmp_path / "in")), 40)
    got = []
    q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(want) == 12 and sorted(map(str, got)) == want
