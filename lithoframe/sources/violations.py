"""Rule-check results in their ASCII form as tables, and a Parquet pack of them.

Files are read by splits. Every line gets a type from its looks alone: blank, numbers, the head of a record, or
other. A record's head can only follow whole records or a check's description, wherever it stands, so a split may be
cut before any of them; a line of other text before a line of counts looks like a check's head, and a cut before
it is verified afterwards: if the part before still wanted lines of description, the file is parsed again in one
part. Parts are parsed on their own and number their checks and errors from nothing; the numbers in the file
follow from the counts of the parts before.

checks() has a row per kept check, errors() a row per kept error with its number in the file and in its check, its
points in micrometres and its box. Sections __RVE_*__ are dropped with their records and use no numbers; sections
*_RDBS are dropped only when they hold no error. Records of a kind other than p and e lose their coordinates. A
file of blank lines is an error that names the path; a missing or bad precision is 1000.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import checkpointed

POINTS = "array<struct<x:double,y:double>>"
#: Lines after which a part ends at the next head of a record.
PART_LINES = 50_000

BLANK, NUMBERS, RECORD, OTHER = range(4)
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TYPES = re.compile(rf"\s*(?:(?P<blank>$)|(?P<numbers>{_NUMBER}(?:\s+{_NUMBER})+\s*$)|(?P<record>[^\W\d_]\s+-?\d+\s+-?\d+(?:\s|$)))")
_COUNTS = re.compile(r"\s*[-+]?\d+\s+[-+]?\d+\s+[-+]?\d+(?:\s|$)")


def line_type(line: str) -> int:
    m = _TYPES.match(line)
    return OTHER if m is None else BLANK if m["blank"] is not None else NUMBERS if m["numbers"] is not None else RECORD


def leading_counts(line: str) -> list[int]:
    out = []
    for t in line.split():
        if not re.fullmatch(r"[-+]?\d+", t):
            break
        out.append(int(t))
    return out


@dataclass
class Check:
    """A check of a part; name None: the one that the part before left open."""

    name: str | None
    declared: int | None = None
    descr: list[str] = field(default_factory=list)
    errors: list[tuple[str, list[tuple[float, float]]]] = field(default_factory=list)

    def kept(self) -> bool:
        if self.name.startswith("__RVE_") and self.name.endswith("__"):
            return False
        return bool(self.errors) or not self.name.endswith("_RDBS")


class Part:
    """Lines between two cuts, with tables of where the next line of each sort is."""

    def __init__(self, rows: list[str]):
        self.rows, self.type = rows, [line_type(r) for r in rows]
        self.full = [i for i, t in enumerate(self.type) if t != BLANK]
        self.numbers = [i for i, t in enumerate(self.type) if t == NUMBERS]
        self.breaks = [i for i, t in enumerate(self.type) if t > NUMBERS]

    def _next(self, where: list[int], at: int) -> int:
        k = bisect_left(where, at)
        return where[k] if k < len(where) else len(self.rows)

    def record(self, at: int) -> tuple[int, str, list[tuple[float, float]]]:
        """End, kind and points of the record at a line: its lines of numbers up to the next line that is none."""
        kind, _, want = self.rows[at].split()[:3]
        lo, hi = bisect_left(self.numbers, at), bisect_left(self.numbers, self._next(self.breaks, at + 1))
        own = self.numbers[lo : min(hi, lo + max(int(want), 0))]
        flat = [[float(t) for t in self.rows[i].split()] for i in own]
        return (own[-1] if own else at) + 1, kind.lower(), [(x[k], x[k + 1]) for x in flat for k in range(0, len(x) - 1, 2)]

    def checks(self, at: int = 0) -> tuple[list[Check], int]:
        """The checks from a line on, and the lines of counts and description that the last one still wants."""
        out: list[Check] = []
        missing = 0
        while (at := self._next(self.full, at)) < len(self.rows):
            if self.type[at] == RECORD:
                if not out:
                    out.append(Check(None))
                at, kind, points = self.record(at)
                if points and kind in ("p", "e"):
                    out[-1].errors.append((kind, points))
                continue
            out.append(check := Check(self.rows[at].strip()))
            at += 1
            counts = leading_counts(self.rows[at]) if at < len(self.rows) else []
            missing = int(at >= len(self.rows))  # its counts may stand behind the cut
            if counts:
                check.declared, wanted = counts[0], counts[2] if len(counts) > 2 else 0
                heads = (i for i in range(at + 1, len(self.rows)) if self.type[i] == RECORD)
                end = min(at + 1 + max(wanted, 0), next(heads, len(self.rows)) if wanted > 0 else at + 1)
                check.descr = [r.strip() for r in self.rows[at + 1 : end]]
                missing = wanted - len(check.descr) if end == len(self.rows) else 0
                at = end
        return out, missing


def heading(line: str) -> tuple[str, float]:
    """Top cell and precision of a file's first line."""
    top, *rest = line.split()
    precision = float(rest[0]) if rest and re.fullmatch(_NUMBER, rest[0]) else 0.0
    return top, precision if precision > 0 else 1000.0


def parse(text: str) -> tuple[str, float, list[Check]]:
    """Top cell, precision and the checks that are kept, in the file's order."""
    rows = [r.rstrip("\r") for r in text.split("\n")]
    first = next((i for i, r in enumerate(rows) if r.strip()), None)
    if first is None:
        raise ValueError("the file is empty")
    top, precision = heading(rows[first])
    found = [c for c in Part(rows[first + 1 :]).checks()[0] if c.name is not None and c.kept()]
    for c in found:
        c.errors = [(kind, [(x / precision, y / precision) for x, y in points]) for kind, points in c.errors]
    return top, precision, found


_LINE = "path string, start bigint, n bigint, part bigint, line string"
_ROW = f"path string, start bigint, part bigint, c int, name string, descr string, declared bigint, e bigint, kind string, pts {POINTS}, missing bigint"


def _cut(part_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of a split with their number and the part that they are in; part 0 goes on with the split before."""
        now, n, part, since, last = None, 0, 0, 0, None
        for b in batches:
            out = []
            for path, start, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                line = line.rstrip("\r")
                if (path, start) != now:
                    if last is not None:
                        out.append(last)
                    now, n, part, since, last = (path, start), 0, 0, 0, None
                kind = line_type(line)
                if last is not None and line_type(last[4]) == OTHER and last[2] > 0 and _COUNTS.match(line):
                    part, since = part + 1, 1  # the line before looks like a check's head: it begins a part
                    last = (*last[:3], part, last[4])
                elif kind == RECORD and since >= part_lines:
                    part, since = part + 1, 0
                if last is not None:
                    out.append(last)
                last, n, since = (path, start, n, part, line), n + 1, since + 1
            if out:
                yield _arrow(out, _LINE)
        if last is not None:
            yield _arrow([last], _LINE)

    return run


_TYPE = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), POINTS: pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))}


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPE[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks (e 0) and errors (e from 1) of each part; lines come sorted by part and place."""

    def rows_of(key: tuple, lines: list[str]) -> list[tuple]:
        found, missing = Part(lines).checks()
        out = []
        c = 0
        for check in found:
            c += check.name is not None
            out.append((*key, c, check.name, "\n".join(check.descr), check.declared, 0, None, None, missing))
            out += [(*key, c, None, None, None, e, kind, [{"x": x, "y": y} for x, y in points], 0) for e, (kind, points) in enumerate(check.errors, 1)]
        return out

    now, lines = None, []
    for b in batches:
        for path, start, part, line in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (path, start, part) != now:
                if lines and (out := rows_of(now, lines)):
                    yield _arrow(out, _ROW)
                now, lines = (path, start, part), []
            lines.append(line)
    if lines and (out := rows_of(now, lines)):
        yield _arrow(out, _ROW)


def read(spark: SparkSession, path: str, part_lines: int = PART_LINES) -> DataFrame:
    """Every check (local_no 0) and its errors (from 1)."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("line"))
    lines = checkpointed(text.mapInArrow(_cut(part_lines), _LINE))
    place = F.struct("start", "n")
    head = lines.groupBy("path").agg(F.min(F.when(F.trim("line") != "", F.struct("start", "n", "line"))).alias("h"))
    empty = head.where("h IS NULL").select("path").limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0].path}: the file is empty")
    head = checkpointed(head.select("path", F.struct("h.start", "h.n").alias("at"), "h.line"))
    # part 0 of a split belongs to the last part of the splits before it; a row for each split
    splits = lines.groupBy("path", "start").agg(F.max("part").alias("most"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("most") > 0, F.struct(F.col("start").alias("s"), F.col("most").alias("k"))), True).over(before)
    splits = splits.select("path", "start", F.coalesce(own, F.struct(F.lit(-1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("k"))).alias("own"))
    body = lines.join(head.select("path", "at"), "path").where(place > F.col("at")).drop("at").join(splits, ["path", "start"])
    body = body.select("path", F.when(F.col("part") > 0, F.col("start")).otherwise(F.col("own.s")).alias("s"), F.when(F.col("part") > 0, F.col("part")).otherwise(F.col("own.k")).alias("k"), "start", "n", "line")

    def parts(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("path", "s", "k").sortWithinPartitions("path", "s", "k", "start", "n")
        return checkpointed(dealt.select("path", "s", "k", "line").mapInArrow(_parsed, _ROW))

    found = parts(body)
    last = found.groupBy("path").agg(F.max(F.struct("start", "part")).alias("end"))
    torn = checkpointed(found.where("missing > 0").join(last, "path").where(F.struct("start", "part") < F.col("end")).select("path").distinct())
    if torn.limit(1).count():  # a description that looks like a check: these files in one part each
        whole = body.join(torn, "path").withColumn("s", F.lit(-1).cast("bigint")).withColumn("k", F.lit(0).cast("bigint"))
        found = checkpointed(found.join(torn, "path", "left_anti").unionByName(parts(whole)))
    # numbers of checks and errors in the file, from the counts of the parts before; a row for each part and check
    seen = Window.partitionBy("path").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    names = found.groupBy("path", "start", "part").agg(F.max("c").alias("names"))
    names = names.withColumn("before", F.coalesce(F.sum("names").over(seen), F.lit(0))).drop("names")
    each = found.join(names, ["path", "start", "part"]).withColumn("check", F.col("c") + F.col("before")).where("check > 0")
    sized = each.groupBy("path", "check", "start", "part").agg(F.max("name").alias("name"), F.max("e").alias("errors"), F.max("descr").alias("descr"), F.max("declared").alias("declared"))
    whole = sized.groupBy("path", "check").agg(F.max("name").alias("name"), F.max("descr").alias("descr"), F.max("declared").alias("declared"), F.sum("errors").alias("errors"))
    kept = whole.where(~F.col("name").rlike("^__RVE_.*__$") & ((F.col("errors") > 0) | ~F.col("name").endswith("_RDBS")))
    of_file = Window.partitionBy("path").orderBy("check")
    kept = kept.withColumn("check_id", F.row_number().over(of_file).cast("bigint") - 1).withColumn("first", F.coalesce(F.sum("errors").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = checkpointed(kept.drop("errors"))
    inside = Window.partitionBy("path", "check").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sized.select("path", "check", "start", "part", F.coalesce(F.sum("errors").over(inside), F.lit(0)).alias("skip"))
    heads = head.select("path", F.split(F.trim("line"), r"\s+").alias("w")).select("path", F.col("w")[0].alias("top"), F.when(F.get("w", F.lit(1)).rlike(f"^{_NUMBER}$"), F.get("w", F.lit(1)).try_cast("double")).alias("p"))
    heads = heads.select("path", "top", F.when(F.col("p") > 0, F.col("p")).otherwise(F.lit(1000.0)).alias("precision"))
    base = ["path", "top", "precision", "check_id", "name", "descr", "declared"]
    errors = each.where("e > 0").drop("name", "descr", "declared").join(offset, ["path", "check", "start", "part"]).join(kept, ["path", "check"]).join(heads, "path")
    local = F.col("skip") + F.col("e")
    points = F.transform("pts", lambda p: F.struct((p["x"] / F.col("precision")).alias("x"), (p["y"] / F.col("precision")).alias("y")))
    errors = errors.select(*base, local.alias("local_no"), (F.col("first") + local).alias("global_no"), "kind", points.alias("pts"))
    zero = kept.join(heads, "path").select(*base, F.lit(0).cast("bigint").alias("local_no"), F.lit(None).cast("bigint").alias("global_no"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast(POINTS).alias("pts"))
    return zero.unionByName(errors)


def checks(rows: DataFrame) -> DataFrame:
    return rows.where("local_no = 0").select("path", "top", "precision", "check_id", "name", "descr", "declared")


def errors(rows: DataFrame) -> DataFrame:
    def bound(fn, axis: str):
        return fn(F.transform("pts", lambda p: p[axis])).alias

    return rows.where("local_no > 0").select(
        "path", "check_id", "name", "local_no", "global_no", "kind", "pts",
        bound(F.array_min, "x")("x0"), bound(F.array_min, "y")("y0"), bound(F.array_max, "x")("x1"), bound(F.array_max, "y")("y1"),
    )


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of the files at a path; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def pack(rows: DataFrame, to: str, source: str | None = None) -> None:
    """checks and errors as Parquet below `to`; errors in ranges of file and number, so statistics prune windows.

    source: the path that the rows were read from; its fingerprint is kept beside them.
    """
    found = errors(rows)
    found.repartitionByRange("path", "global_no").sortWithinPartitions("path", "global_no").write.mode("overwrite").parquet(f"{to}/errors")
    checks(rows).write.mode("overwrite").parquet(f"{to}/checks")
    if source is not None:
        fingerprint(rows.sparkSession, source).coalesce(1).write.mode("overwrite").parquet(f"{to}/source")


def open_results(spark: SparkSession, path: str, packed: str) -> tuple[DataFrame, DataFrame, str | None]:
    """(checks, errors, note): the pack if it was made from these very files, else the files themselves and a note why."""
    try:
        was, now = spark.read.parquet(f"{packed}/source"), fingerprint(spark, path)
        stale = was.exceptAll(now).unionByName(now.exceptAll(was)).limit(1).count()
        if not stale:
            return (*open_pack(spark, packed), None)
        why = "was made from other files"
    except (AnalysisException, ValueError) as e:
        why = f"cannot be used ({str(e).splitlines()[0][:120]})"
    rows = read(spark, path)
    return checks(rows), errors(rows), f"{packed} {why}; the text of {path} is read instead"


def open_pack(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """(checks, errors) of a pack; columns that are missing or of another type are an error."""
    found = spark.read.parquet(f"{at}/checks"), spark.read.parquet(f"{at}/errors")
    for df, need in zip(found, ({"check_id": "bigint", "name": "string", "declared": "bigint"}, {"check_id": "bigint", "local_no": "bigint", "global_no": "bigint", "kind": "string", "x0": "double"}), strict=True):
        have = dict(df.dtypes)
        if bad := [k for k, t in need.items() if have.get(k) != t]:
            raise ValueError(f"{at} is no pack of violations: {bad}")
    return found
