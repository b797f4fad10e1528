"""What users type; rounds; the command line."""

import json

import pytest

from lithoframe.__main__ import main
from lithoframe.operators import requests as r


def test_boxes_places_views_and_error_lists():
    assert r.box_in_dbu("2,1,0.0005,0.0015", 0.001) == (0, 2, 2000, 1000)  # halves to even, corners in order
    for bad in ("1,2,1,3", "1,2,3", "a,b,c,d", "1,2,1.0004,9"):
        with pytest.raises(ValueError):
            r.box_in_dbu(bad, 0.001)
    assert r.place("1 2,3") == [1, 2, 3] and r.place("-1,2.5") == [-1, 2.5]
    for bad in ("1", "1,2,0", "1,2,3,4", "x,1"):
        with pytest.raises(ValueError):
            r.place(bad)
    assert r.view_of((-1.9996, 0.9999, 3, 4), 1000, 2, 3) == r.View((-1999, 999, 3000, 4000), 1500, 0.002)
    assert [r.error_numbers(t, 9) for t in ("all", "3", "2-5", "7-40", " 9 ")] == [(1, 9), (3, 3), (2, 5), (7, 9), (9, 9)]
    for bad in ("0", "10", "5-2", "x", "3-", "-4", "12-20", ""):
        with pytest.raises(ValueError):
            r.error_numbers(bad, 9)
    with pytest.raises(ValueError):
        r.error_numbers("all", 0)


def test_rounds():
    g = r.Rounds()
    assert g.next() == 4 * r.MIB
    g.ended(4 * r.MIB, 0.25)
    assert g.next() == 8 * r.MIB
    g.ended(r.MIB, 100)  # too little to tell
    assert g.next() == 8 * r.MIB
    g.ended(8 * r.MIB, 1000)
    assert g.next() == r.LEAST_ROUND
    g.ended(10**12, 1)
    assert g.next() == r.MOST_ROUND
    for _ in range(3):
        g.ended(0, 1)
    assert g.next() == 0


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "flat_view" in capsys.readouterr().out.split()
    assert main(["sql", "flat_view"]) == 0 and "flat_rect" in capsys.readouterr().out
    assert main(["run", "no_such", "/nowhere"]) == 2
    assert main(["run", "drc_rules", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 3
    (tmp_path / "d").write_text("#IFDEF A\nLAYER M 1\n#ENDIF\nM.1 { INT M < 2 }\n")
    capsys.readouterr()
    assert main(["deck", str(tmp_path / "d"), "-D", "A"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["layers"] == {"M": [[1, None]]} and out["checks"]["M.1"]["bounds"][0]["value"] == 2
