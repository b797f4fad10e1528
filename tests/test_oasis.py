"""The layout file reader and writer: round trips, and bytes written out by hand."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lithoframe.sources import oasis
from lithoframe.sources.oasis import MAGIC, ONE, Bytes, encode, gdelta, parse, sint, string, uint

START = MAGIC + b"\x01" + string("1.0") + b"\x00" + uint(1000) + b"\x01"


@given(st.integers(-(2**62), 2**62), st.integers(-(2**62), 2**62))
def test_numbers(a, b):
    assert Bytes(uint(abs(a))).uint() == abs(a)
    assert Bytes(sint(a)).sint() == a
    assert Bytes(gdelta(a, b)).gdelta() == (a, b)


SAMPLE = [
    {"kind": "cell", "cell": "TOP"},
    {"kind": "place", "cell": "TOP", "child": "A", "rot": 3, "flip": 1, "x": -5, "y": 7, "rep": (1, 3, 2, 10, 1, -2, 20, None)},
    {"kind": "place", "cell": "TOP", "child": "A", "rot": 0, "flip": 0, "x": -5, "y": 9, "rep": ONE},
    {"kind": "cell", "cell": "A"},
    *({"kind": "rect", "cell": "A", "layer": 1, "dt": 0, "x": i, "y": -i, "w": 10 + i % 3, "h": 4, "rep": (2, 3, 1, 0, 0, 0, 0, [(0, 0), (5, -1), (6, 6)])} for i in range(40)),
    {"kind": "poly", "cell": "A", "layer": 2**32 - 1, "dt": 5, "x": 1, "y": 1, "pts": [(1, 1), (9, 1), (4, 8)], "rep": ONE},
    {"kind": "path", "cell": "A", "layer": 3, "dt": 0, "x": 0, "y": 0, "pts": [(0, 0), (50, 0), (50, 70)], "hw": 4, "es": -3, "ee": 9, "rep": (1, 1, 4, 0, 0, 0, 12, None)},
    {"kind": "text", "cell": "A", "layer": 63, "dt": 63, "x": 3, "y": 4, "s": "PIN_é", "rep": ONE},
]


def test_round_trip_is_exact():
    data = encode(SAMPLE)
    assert parse(data)[0] == SAMPLE
    assert parse(data)[1].ids[34] == 1  # the long body is compressed
    assert parse(data)[1].unit == 1000


def test_implicit_polygon_and_late_names():
    # CELL by number, polygon of list type 0: deltas 10, 20 close over (0, 20); names follow
    body = b"\x0d\x00" + b"\x15" + bytes([0b00111011]) + uint(4) + uint(2) + uint(0) + uint(2) + sint(10) + sint(20) + sint(100) + sint(200)
    got = parse(START + body + b"\x03" + string("X") + b"\x02")[0]
    assert got[0]["cell"] == "X" and got[1]["pts"] == [(100, 200), (110, 200), (110, 220), (100, 220)]


def test_vertical_first_and_octangular_lists():
    assert Bytes(uint(1) + uint(2) + sint(5) + sint(7)).points(True) == [(0, 0), (0, 5), (7, 5), (7, 0)]
    assert Bytes(uint(3) + uint(2) + uint(2 << 3 | 4) + uint(3 << 3 | 2)).points(False) == [(0, 0), (2, 2), (-1, 2)]
    assert Bytes(uint(5) + uint(2) + gdelta(1, 2) + gdelta(1, 1)).points(False) == [(0, 0), (1, 2), (3, 5)]


def test_relative_places_and_squares():
    body = b"\x0e" + string("X") + b"\x10" + b"\x14" + bytes([0b11011011]) + uint(1) + uint(0) + uint(6) + sint(5) + sint(5) + b"\x14" + bytes([0b00010000]) + sint(3)
    got = parse(START + body + b"\x02")[0]
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in got[1:]] == [(5, 5, 6, 6), (8, 5, 6, 6)]


@pytest.mark.parametrize("body", [b"\x12", b"\x17", b"\x21", b"\x14\x00", b"\x0d\x05\x02", b"\x0e"])
def test_what_is_not_supported_is_an_error(body):
    with pytest.raises(ValueError):
        parse(START + b"\x0e" + string("X") + body)


def test_circle_is_exact_on_its_axes():
    for r in (1, 2, 7, 100, 10**6):
        pts = oasis.circle(r)
        assert 4 <= len(pts) <= 64 and len(set(pts)) == len(pts)
        assert {(r, 0), (0, r), (-r, 0), (0, -r)} <= set(pts)


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "a.oas").write_bytes(encode(SAMPLE))
    rows = oasis.read(spark, str(tmp_path))
    found = {(r.kind, r.layer): (r.records, r.members) for r in oasis.inventory(spark, str(tmp_path)).collect()}
    assert found[("rect", 1)] == (40, 120) and found[("place", None)] == (2, 7) and found[("text", 63)] == (1, 1)
    assert [r.cell for r in oasis.top_cell(rows).collect()] == ["TOP"]
    again = parse(bytes(oasis.encode_table(rows).first().content))[0]
    assert sorted(repr(sorted(r.items())) for r in again) == sorted(repr(sorted(r.items())) for r in SAMPLE)
    (tmp_path / "b.oas").write_bytes(b"junk")
    with pytest.raises(Exception, match="not an OASIS file"):
        oasis.read(spark, str(tmp_path)).collect()
