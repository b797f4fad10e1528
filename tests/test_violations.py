"""The violation reader: the awkward files it must take, cuts inside files, and a pack of them."""

import random

import pytest

from lithoframe.sources import violations

TEXT = """
TOP 1000
A.1
2 2 2 Jan 1
first line
second line
p 1 4
0 0
1000 0

1000 -2000
0 -2000
e 2 2
0 0 0 500
100 0 100 500\r
A.1
1 1 1 Jan 1
p 1 3
0 0
10 0
NO.COUNT
x 1 1
5 5
p 1 1
7 7
__RVE_ERROR_TAG2__
1 1 0
p 1 1
9 9
FAKE_RDBS
1 1 0
e 1 1
1 2 3 4
EMPTY_RDBS
0 0 1 x
about
ZERO.1
0 0 0 t
CUT.1
1 1 0
p 1 4
1 1
2 2
"""


def test_parse():
    top, precision, checks = violations.parse(TEXT)
    assert (top, precision) == ("TOP", 1000.0)
    assert [(c.name, c.declared, len(c.errors)) for c in checks] == [("A.1", 2, 2), ("A.1", 1, 1), ("NO.COUNT", None, 1), ("FAKE_RDBS", 1, 1), ("ZERO.1", 0, 0), ("CUT.1", 1, 1)]
    assert checks[0].descr == ["first line", "second line"]
    assert checks[0].errors[0] == ("p", [(0, 0), (1, 0), (1, -2), (0, -2)]) and checks[0].errors[1][1] == [(0, 0), (0, 0.5), (0.1, 0), (0.1, 0.5)]
    assert checks[1].descr == [] and len(checks[1].errors[0][1]) == 2 and len(checks[5].errors[0][1]) == 2
    assert violations.parse("T\n")[1] == 1000.0 and violations.parse("T -4\n")[1] == 1000.0
    with pytest.raises(ValueError):
        violations.parse("\n \n")


def test_files_and_pack(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.db").write_text(TEXT, newline="")
    (tmp_path / "in" / "b.db").write_text("OTHER 2000\nB\n1 1 0\np 1 1\n4000 2000\n")
    rows = violations.read(spark, str(tmp_path / "in"))
    violations.pack(rows, str(tmp_path / "pack"))
    checks, errors = violations.open_pack(spark, str(tmp_path / "pack"))
    a = errors.where("path LIKE '%a.db'").orderBy("global_no").collect()
    assert [(r.global_no, r.local_no, r.name) for r in a] == [(1, 1, "A.1"), (2, 2, "A.1"), (3, 1, "A.1"), (4, 1, "NO.COUNT"), (5, 1, "FAKE_RDBS"), (6, 1, "CUT.1")]
    assert (a[0].x0, a[0].y0, a[0].x1, a[0].y1) == (0, -2, 1, 0) and checks.count() == 7
    assert errors.where("path LIKE '%b.db'").first().x0 == 2.0
    (tmp_path / "in" / "c.db").write_text(" \n\n")
    with pytest.raises(Exception, match="the file is empty"):
        violations.read(spark, str(tmp_path / "in")).collect()


def random_file(r):
    out = [r.choice(["", "TOP 1000", "T 2000"]) or "\nTOP"]
    for k in range(r.randrange(3, 25)):
        n = r.randrange(0, 4)
        out.append(r.choice([f"R.{k}", "M1 space", f"X{k}_RDBS", "__RVE_NOTE__"]))
        if r.random() < 0.9:
            out.append(f"{r.randrange(9)} 3 {n} Nov 3")
            out += [r.choice(["about it", "", "A.HEAD", "4 5 6", "see rule\n2 2 1 x", "p.3 of the manual"]) for _ in range(n)]
        for _ in range(r.randrange(0, 7)):
            m = r.randrange(0, 4)
            out.append(f"{r.choice('peppx')} {r.randrange(9)} {m}")
            out += [" ".join(str(r.randrange(-999, 999)) for _ in range(r.choice([2, 4]))) for _ in range(max(0, m - r.choice([0, 0, 0, 1])))]
            out += [""] * r.choice([0, 0, 1])
    return r.choice(["\n", "\r\n"]).join(out) + r.choice(["", "\n"])


def test_parts_of_files_equal_one_pass(spark, tmp_path):
    """Splits of a few bytes and parts of a few lines give what parse() gives, descriptions that look like checks included."""
    r, want = random.Random(5), {}
    for i in range(12):
        text = random_file(r)
        (tmp_path / f"{i}.db").write_text(text, newline="")
        top, precision, checks = violations.parse(text)
        rows, number = [], 0
        for k, c in enumerate(checks):
            rows.append((top, precision, k, c.name, "\n".join(c.descr), c.declared, 0, None, None, None))
            for e, (kind, points) in enumerate(c.errors, 1):
                number += 1
                rows.append((top, precision, k, c.name, "\n".join(c.descr), c.declared, e, number, kind, points))
        want[i] = rows
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split, lines in (("128m", 50_000), ("300b", 3)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = {}
            for x in violations.read(spark, str(tmp_path), lines).collect():
                got.setdefault(int(x.path.rsplit("/", 1)[1][:-3]), []).append((*x[1:10], None if x.pts is None else [(p.x, p.y) for p in x.pts]))
            assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, v in want.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_pack_or_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.db").write_text(TEXT, newline="")
    src, to = str(tmp_path / "in"), str(tmp_path / "pack")
    want = sorted((r.global_no, r.kind) for r in violations.errors(violations.read(spark, src)).collect())
    _, errors, note = violations.open_results(spark, src, to)
    assert "cannot be used" in note and sorted((r.global_no, r.kind) for r in errors.collect()) == want
    violations.pack(violations.read(spark, src), to, src)
    checks, errors, note = violations.open_results(spark, src, to)
    assert note is None and checks.count() == 6 and sorted((r.global_no, r.kind) for r in errors.collect()) == want
    (tmp_path / "in" / "b.db").write_text("T 1000\nX\np 1 1\n1 1\n")
    _, errors, note = violations.open_results(spark, src, to)
    assert "other files" in note and errors.count() == len(want) + 1
