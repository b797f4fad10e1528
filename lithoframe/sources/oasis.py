"""Hierarchical layout files (the public OASIS stream format) as tables, and back.

read() gives one row per record: kind, cell, layer, dt, x, y, and what the kind needs (w and h; points; placed
cell, rotation, mirror; text; path half-width and extensions) with its repetition kept compressed. Files are read
by Spark's binary reader, one task each, so a corpus of files is parallel; a single file is limited to the 2 GB of
that reader. Records with free magnification or angle, trapezoids and extension geometry are an error, as are
unresolved names. write() makes one file per top cell in the tasks that hold its rows.

Files of another format are an error that names the path; Spark's binary reader skips files of no bytes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"%SEMI-OASIS\r\n"
POINTS = "array<struct<x:bigint,y:bigint>>"
REP = f"struct<kind:tinyint,na:bigint,nb:bigint,vax:bigint,vay:bigint,vbx:bigint,vby:bigint,pts:{POINTS}>"
SCHEMA = f"path string, kind string, cell string, layer bigint, dt bigint, x bigint, y bigint, w bigint, h bigint, pts {POINTS}, child string, rot int, flip int, hw bigint, es bigint, ee bigint, s string, rep {REP}"
FIELDS = ("kind", "cell", "layer", "dt", "x", "y", "w", "h", "pts", "child", "rot", "flip", "hw", "es", "ee", "s", "rep")
ONE = (0, 1, 1, 0, 0, 0, 0, None)
EAST_FIRST = ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1))
#: A cell's body of this many bytes or more is written compressed.
COMPRESS = 64


class Bytes:
    """Primitive values at a moving place of a buffer."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("the file ends inside a record")
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends inside a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    def sint(self) -> int:
        u = self.uint()
        return -(u >> 1) if u & 1 else u >> 1

    def string(self) -> str:
        return self.take(self.uint()).decode("utf-8")

    def real(self, kind: int | None = None) -> float:
        kind = self.uint() if kind is None else kind
        if kind > 7:
            raise ValueError(f"real of unknown type {kind}")
        if kind == 6:
            return struct.unpack("<f", self.take(4))[0]
        if kind == 7:
            return struct.unpack("<d", self.take(8))[0]
        a = self.uint()
        value = a / self.uint() if kind > 3 else (1 / a if kind > 1 else float(a))
        return -value if kind & 1 else value

    def gdelta(self) -> tuple[int, int]:
        u = self.uint()
        if u & 1:
            return (-(u >> 2) if u & 2 else u >> 2), self.sint()
        dx, dy = EAST_FIRST[u >> 1 & 7]
        return dx * (u >> 4), dy * (u >> 4)

    def repetition(self, before):
        kind = self.uint()
        if kind == 0:
            if before is None:
                raise ValueError("a repetition is reused before any was given")
            return before
        if kind in (1, 2, 3):
            n = [self.uint() + 2 for _ in range(2 if kind == 1 else 1)]
            d = [self.uint() for _ in n]
            if kind == 1:
                return (1, n[0], n[1], d[0], 0, 0, d[1], None)
            return (1, n[0], 1, d[0], 0, 0, 0, None) if kind == 2 else (1, 1, n[0], 0, 0, 0, d[0], None)
        if kind in (4, 5, 6, 7):
            n, grid, at, pts = self.uint() + 1, 1, 0, [(0, 0)]
            if kind in (5, 7):
                grid = self.uint()
            for _ in range(n):
                at += self.uint() * grid
                pts.append((at, 0) if kind < 6 else (0, at))
            return (2, len(pts), 1, 0, 0, 0, 0, pts)
        if kind == 8:
            n, m = self.uint() + 2, self.uint() + 2
            return (1, n, m, *self.gdelta(), *self.gdelta(), None)
        if kind == 9:
            n = self.uint() + 2
            return (1, n, 1, *self.gdelta(), 0, 0, None)
        if kind in (10, 11):
            n, grid = self.uint() + 1, 1
            if kind == 11:
                grid = self.uint()
            x, y, pts = 0, 0, [(0, 0)]
            for _ in range(n):
                dx, dy = self.gdelta()
                x, y = x + dx * grid, y + dy * grid
                pts.append((x, y))
            return (2, len(pts), 1, 0, 0, 0, 0, pts)
        raise ValueError(f"repetition of unknown type {kind}")

    def points(self, closed: bool) -> list[tuple[int, int]]:
        """Vertices relative to the first, which is (0, 0)."""
        kind, n = self.uint(), self.uint()
        x = y = vx = vy = 0
        out = [(0, 0)]
        for i in range(n):
            if kind in (0, 1):
                step = self.sint()
                dx, dy = (step, 0) if i % 2 == kind else (0, step)
            elif kind in (2, 3):
                u, bits = self.uint(), kind
                dx, dy = (c * (u >> bits) for c in EAST_FIRST[u & (1 << bits) - 1])
            elif kind in (4, 5):
                dx, dy = self.gdelta()
                if kind == 5:
                    dx, dy = vx, vy = vx + dx, vy + dy
            else:
                raise ValueError(f"point list of unknown type {kind}")
            x, y = x + dx, y + dy
            out.append((x, y))
        if closed and kind in (0, 1) and n:
            # an even count ends across the first axis; the implied vertex turns back along it
            if n % 2:
                raise ValueError("an implicitly closed polygon needs an even count of deltas")
            out.append((0, y) if kind == 0 else (x, 0))
        return out


def circle(r: int) -> list[tuple[int, int]]:
    """Inscribed polygon of 64 corners from +x, counter-clockwise; equal neighbours are one."""
    out: list[tuple[int, int]] = []
    for k in range(64):
        c, s = (round(math.cos(a * math.pi / 32), 15) for a in (k, k - 16))
        p = tuple(int(math.copysign(math.floor(abs(v * r) + 0.5), v)) for v in (c, s))
        if not out or out[-1] != p:
            out.append(p)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


class Reader:
    """One pass over a file; names given by number are looked up when all is read."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise ValueError("not an OASIS file")
        self.src = Bytes(data, len(MAGIC))
        self.names: dict[str, dict[int, str]] = {"cell": {}, "text": {}}
        self.auto: Counter = Counter()
        self.layer_rules: list[tuple[str, float, float, float, float]] = []
        self.unit, self.ids, self.ended = 0.0, Counter(), False
        self.m: dict = {}
        self.cell = None

    def _start_cell(self, name) -> None:
        self.cell, self.m = name, {"gx": 0, "gy": 0, "px": 0, "py": 0, "tx": 0, "ty": 0, "relative": False}

    def _modal(self, key: str, given, read):
        if given:
            self.m[key] = read()
        if self.m.get(key) is None:
            raise ValueError(f"{key} is used before it was given")
        return self.m[key]

    def _place(self, axis: str, given) -> int:
        if given:
            v = self.src.sint()
            self.m[axis] = self.m[axis] + v if self.m["relative"] else v
        return self.m[axis]

    def _rep(self, given):
        if not given:
            return ONE
        self.m["rep"] = self.src.repetition(self.m.get("rep"))
        return self.m["rep"]

    def _interval(self) -> tuple[float, float]:
        kind = self.src.uint()
        if kind == 0:
            return 0, math.inf
        if kind > 4:
            raise ValueError(f"interval of unknown type {kind}")
        a = self.src.uint()
        return {1: (0, a), 2: (a, math.inf), 3: (a, a)}.get(kind) or (a, self.src.uint())

    def _property(self) -> None:
        b, src = self.src.byte(), self.src
        if b & 4:
            src.uint() if b & 2 else src.string()
        if b & 8:
            return
        n = b >> 4
        for _ in range(src.uint() if n == 15 else n):
            kind = src.uint()
            if kind < 8:
                src.real(kind)
            elif kind == 9:
                src.sint()
            elif kind in (10, 11, 12):
                src.take(src.uint())
            elif kind < 16:
                src.uint()
            else:
                raise ValueError(f"property value of unknown type {kind}")

    def _row(self, kind: str, **values) -> dict:
        if self.cell is None:
            raise ValueError("an element stands outside of a cell")
        return {"kind": kind, "cell": self.cell, **values}

    def _layered(self, b: int) -> dict:
        return {"layer": self._modal("layer", b & 1, self.src.uint), "dt": self._modal("dt", b & 2, self.src.uint)}

    def _at(self, b: int, x: int, y: int, rep: int) -> dict:
        return {"x": self._place("gx", b & x), "y": self._place("gy", b & y), "rep": self._rep(b & rep)}

    def _name(self, kind: str, numbered) -> object:
        return (kind, self.src.uint()) if numbered else self.src.string()

    def records(self) -> Iterator[dict]:
        """Rows as they stand; names given by number are (table, number) pairs until resolved()."""
        outer: list[Bytes] = []
        while not self.ended:
            if outer and self.src.at == len(self.src.data):
                self.src = outer.pop()
                continue
            src = self.src
            code = src.uint()
            self.ids[code] += 1
            if code == 0:
                continue
            if code == 1:
                src.string()
                self.unit = src.real()
                if src.uint() == 0:
                    for _ in range(12):
                        src.uint()
            elif code == 2:
                self.ended = True
            elif code in (3, 4, 5, 6):
                table, name = ("cell", "text")[code > 4], src.string()
                self.names[table][src.uint() if code in (4, 6) else self.auto[table]] = name
                self.auto[table] += 1
            elif code in (7, 8, 9, 10):
                src.take(src.uint())
                if code in (8, 10):
                    src.uint()
            elif code in (11, 12):
                self.layer_rules.append((src.string(), *self._interval(), *self._interval()))
            elif code in (13, 14):
                self._start_cell(self._name("cell", code == 13))
                yield self._row("cell")
            elif code in (15, 16):
                self.m["relative"] = code == 16
            elif code == 17:
                b = src.byte()
                child = self._modal("child", b & 128, lambda b=b: self._name("cell", b & 64))
                yield self._row("place", child=child, rot=b >> 1 & 3, flip=b & 1, x=self._place("px", b & 32), y=self._place("py", b & 16), rep=self._rep(b & 8))
            elif code == 19:
                b = src.byte()
                text = self._modal("text", b & 64, lambda b=b: self._name("text", b & 32))
                layer, dt = self._modal("text layer", b & 1, src.uint), self._modal("text type", b & 2, src.uint)
                yield self._row("text", s=text, layer=layer, dt=dt, x=self._place("tx", b & 16), y=self._place("ty", b & 8), rep=self._rep(b & 4))
            elif code == 20:
                b = src.byte()
                row = self._layered(b)
                w = self._modal("w", b & 64, src.uint)
                if b & 128:
                    self.m["h"] = w
                h = self._modal("h", b & 32 and not b & 128, src.uint)
                yield self._row("rect", **row, w=w, h=h, **self._at(b, 16, 8, 4))
            elif code == 21:
                b = src.byte()
                row = self._layered(b)
                shape = self._modal("polygon", b & 32, lambda: src.points(True))
                at = self._at(b, 16, 8, 4)
                yield self._row("poly", **row, **at, pts=[(at["x"] + x, at["y"] + y) for x, y in shape])
            elif code == 22:
                b = src.byte()
                row = self._layered(b)
                hw = self._modal("half-width", b & 64, src.uint)
                if b & 128:
                    scheme = src.uint()
                    for key, how in (("es", scheme >> 2 & 3), ("ee", scheme & 3)):
                        if how:
                            self.m[key] = 0 if how == 1 else hw if how == 2 else src.sint()
                spine = self._modal("path", b & 32, lambda: src.points(False))
                at = self._at(b, 16, 8, 4)
                es, ee = self._modal("es", False, None), self._modal("ee", False, None)
                yield self._row("path", **row, **at, hw=hw, es=es, ee=ee, pts=[(at["x"] + x, at["y"] + y) for x, y in spine])
            elif code == 27:
                b = src.byte()
                row = self._layered(b)
                r = self._modal("radius", b & 32, src.uint)
                at = self._at(b, 16, 8, 4)
                yield self._row("poly", **row, **at, pts=[(at["x"] + x, at["y"] + y) for x, y in circle(r)])
            elif code == 28:
                self._property()
            elif code == 29:
                pass
            elif code in (30, 31):
                src.uint()
                src.take(src.uint())
                if code == 31:
                    src.uint()
            elif code == 32:
                src.uint()
                src.take(src.uint())
            elif code == 34:
                if src.uint() != 0:
                    raise ValueError("a compressed block of unknown method")
                size, packed = src.uint(), src.uint()
                body = zlib.decompress(src.take(packed), -15)
                if len(body) != size:
                    raise ValueError("a compressed block has not the size it states")
                outer.append(src)
                self.src = Bytes(body)
            else:
                raise ValueError(f"record {code} is not supported")

    def resolved(self, row: dict) -> dict:
        for key in ("cell", "child", "s"):
            v = row.get(key)
            if isinstance(v, tuple):
                table, number = v
                if number not in self.names[table]:
                    raise ValueError(f"{table} name {number} is not given")
                row[key] = self.names[table][number]
        return row


def parse(data: bytes) -> tuple[list[dict], Reader]:
    reader = Reader(data)
    rows = list(reader.records())
    return [reader.resolved(r) for r in rows], reader


def members(rep) -> int:
    return rep[1] * rep[2]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of every file below path, of kind cell, place, text, rect, poly or path."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    found, _ = parse(bytes(row.content))
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{row.path}: {e}") from e
                for lo in range(0, len(found), 10_000):
                    yield _frame(row.path, found[lo : lo + 10_000])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _frame(path: str, rows: list[dict]):
    import pandas as pd

    names = ("kind", "na", "nb", "vax", "vay", "vbx", "vby", "pts")

    def points(pts):
        return None if pts is None else [{"x": x, "y": y} for x, y in pts]

    def value(row: dict, key: str):
        v = row.get(key)
        if key == "pts":
            return points(v)
        if key == "rep" and v is not None:
            return dict(zip(names, (*v[:7], points(v[7])), strict=True))
        return v

    integer = ("layer", "dt", "x", "y", "w", "h", "rot", "flip", "hw", "es", "ee")
    columns = {k: pd.Series([value(r, k) for r in rows], dtype="Int64" if k in integer else object) for k in FIELDS}
    return pd.DataFrame({"path": [path] * len(rows), **columns})


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Records, members and repetitions by kind and layer of each file."""
    rows = read(spark, path)
    n = F.when(F.col("rep").isNull(), 1).otherwise(F.col("rep.na") * F.col("rep.nb"))
    return rows.groupBy("path", "kind", "layer", "dt").agg(F.count("*").alias("records"), F.sum(n).alias("members"), F.sum((F.col("rep.kind") > 0).cast("long")).alias("repeated"))


def top_cell(rows: DataFrame) -> DataFrame:
    """(path, cell): the one cell of each file that none places; none or several are an error."""
    cells = rows.where("kind = 'cell'").select("path", "cell").distinct()
    placed = rows.where("kind = 'place'").select("path", F.col("child").alias("cell")).distinct()
    tops = cells.join(placed, ["path", "cell"], "left_anti").groupBy("path").agg(F.min("cell").alias("cell"), F.count("*").alias("n"))
    files = rows.select("path").distinct().join(tops, "path", "left")
    checked = F.when(F.col("n") == 1, F.col("cell")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": not exactly one top cell"))))
    return files.select("path", checked.cast("string").alias("cell"))


# --- writing


def uint(n: int) -> bytes:
    if n < 0:
        raise ValueError("a negative number where the format has none")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def sint(n: int) -> bytes:
    return uint(-n << 1 | 1 if n < 0 else n << 1)


def string(s: str) -> bytes:
    b = s.encode()
    return uint(len(b)) + b


def gdelta(x: int, y: int) -> bytes:
    return uint(abs(x) << 2 | (2 if x < 0 else 0) | 1) + sint(y)


def _write_rep(rep) -> bytes:
    kind, na, nb, vax, vay, vbx, vby, pts = rep
    if kind == 2:
        steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(pts, pts[1:], strict=False)]
        return uint(10) + uint(len(steps) - 1) + b"".join(gdelta(*s) for s in steps)
    if na > 1 and nb > 1:
        return uint(8) + uint(na - 2) + uint(nb - 2) + gdelta(vax, vay) + gdelta(vbx, vby)
    if na == 1 and vbx == 0 and vby >= 0:
        return uint(3) + uint(nb - 2) + uint(vby)
    n, v = (na, (vax, vay)) if na > 1 else (nb, (vbx, vby))
    return uint(9) + uint(n - 2) + gdelta(*v)


def _write_points(pts) -> bytes:
    steps = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(pts, pts[1:], strict=False)]
    return uint(4) + uint(len(steps)) + b"".join(gdelta(*s) for s in steps)


class Body:
    """A cell's records, each value only where it differs from the one before."""

    def __init__(self) -> None:
        self.out, self.m = bytearray(), {"gx": 0, "gy": 0, "px": 0, "py": 0, "tx": 0, "ty": 0}

    def _new(self, key: str, value) -> bool:
        differs = self.m.get(key) != value
        self.m[key] = value
        return differs

    def add(self, row: dict) -> None:
        kind, rep = row["kind"], row.get("rep") or ONE
        repeated = members(rep) > 1
        parts: list[tuple[int, bytes]] = []

        def field(bit: int, key: str, value, encoded) -> None:
            if self._new(key, value):
                parts.append((bit, encoded(value)))

        first = 0
        if kind == "place":
            code, (x, y, r) = 17, (32, 16, 8)
            first = row["rot"] << 1 | row["flip"]
            field(128, "child", row["child"], string)
            axes = "px", "py"
        elif kind == "text":
            code, (x, y, r) = 19, (16, 8, 4)
            field(64, "text", row["s"], string)
            field(1, "text layer", row["layer"], uint)
            field(2, "text type", row["dt"], uint)
            axes = "tx", "ty"
        else:
            code, (x, y, r) = {"rect": 20, "poly": 21, "path": 22}[kind], (16, 8, 4)
            axes = "gx", "gy"
            field(1, "layer", row["layer"], uint)
            field(2, "dt", row["dt"], uint)
            if kind == "rect":
                field(64, "w", row["w"], uint)
                field(32, "h", row["h"], uint)
            else:
                if kind == "path":
                    field(64, "hw", row["hw"], uint)
                    ends = row["es"], row["ee"]
                    field(128, "ends", ends, lambda e: uint(15) + sint(e[0]) + sint(e[1]))
                x0, y0 = row["pts"][0]
                field(32, kind, [(a - x0, b - y0) for a, b in row["pts"]], _write_points)
        at = row["pts"][0] if kind in ("poly", "path") else (row["x"], row["y"])
        field(x, axes[0], at[0], sint)
        field(y, axes[1], at[1], sint)
        if repeated:
            parts.append((r, uint(0) if self.m.get("rep") == rep else _write_rep(rep)))
            self.m["rep"] = rep
        info = first
        for bit, _ in parts:
            info |= bit
        self.out += bytes([code, info]) + b"".join(b for _, b in parts)


def encode(rows: list[dict], unit: int = 1000) -> bytes:
    """One file: the rows in their order within each cell, cells in order of their first row."""
    cells: dict[str, Body] = {}
    for row in rows:
        body = cells.setdefault(row["cell"], Body())
        if row["kind"] != "cell":
            body.add(row)
    for row in rows:
        if row["kind"] == "place" and row["child"] not in cells:
            raise ValueError(f"cell {row['child']} is placed but not given")
    out = bytearray(MAGIC + b"\x01" + string("1.0") + uint(0) + uint(unit) + uint(1))
    for name, body in cells.items():
        out += b"\x0e" + string(name)
        if len(body.out) >= COMPRESS:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = packer.compress(bytes(body.out)) + packer.flush()
            out += b"\x22" + uint(0) + uint(len(body.out)) + uint(len(packed)) + packed
        else:
            out += body.out
    # the last record takes 256 bytes: its code, twelve table offsets (none), a padding string, no validation
    head = b"\x02" + bytes(12)
    pad = 256 - len(head) - 1 - 2
    return bytes(out + head + bytes([pad & 127 | 128, pad >> 7]) + bytes(pad) + b"\x00")


def _plain(row: dict) -> dict:
    """A row as records() gives it, from one of a frame."""
    integer = ("layer", "dt", "x", "y", "w", "h", "rot", "flip", "hw", "es", "ee")
    d = {k: v for k, v in row.items() if v is not None}
    d |= {k: int(d[k]) for k in integer if k in d}
    if "pts" in d:
        d["pts"] = [(int(p["x"]), int(p["y"])) for p in d["pts"]]
    if (r := d.get("rep")) is not None:
        d["rep"] = (*(int(r[k]) for k in ("kind", "na", "nb", "vax", "vay", "vbx", "vby")), None if r["pts"] is None else [(int(p["x"]), int(p["y"])) for p in r["pts"]])
    return d


def encode_table(rows: DataFrame, unit: int = 1000) -> DataFrame:
    """(path, content) of one file for each value of path. A file's rows meet in one task, as a file is one stream."""
    columns = [k for k in FIELDS if k in rows.columns]

    def run(frame):
        import pandas as pd

        at = {k: frame[k].tolist() for k in columns}
        plain = [_plain({k: at[k][i] for k in columns if k == "pts" or k == "rep" or not pd.isna(at[k][i])}) for i in frame.sort_values(["cell", "kind"], kind="stable").index]
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [encode(plain, unit)]})

    return rows.groupBy("path").applyInPandas(run, "path string, content binary")
