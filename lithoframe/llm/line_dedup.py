"""Operator 9: line deduplication over levelled sorted runs of line hashes, DataFrame functions only.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. A key of at least
min_chars code points that min_docs documents hold loses its lines everywhere but in the largest doc_id
holding it.

Documents come in batches of descending doc_id, so the first batch that holds a key has its largest document.
The index is a list of levels of runs: tables of (key hash, largest document, documents), sorted by hash and
bucketed by hash in one number of buckets. A batch is aggregated to its own keys and merge-anti-joined with
every run; what is left are new keys, a run of level 0, and the other keys only add to the counts of keys that
a run has. FANOUT runs of a level are compacted into one of the next, with the counts that came in since. Runs
share no key, so a key is in one run at any time and is rewritten a logarithmic number of times. As runs and
batches are bucketed alike, these joins move no rows. At the end the runs are merged with the counts left, and
the lines of all batches are joined with the frequent keys.

Text is never exploded for the result: a document gets the set of its own dropped hashes, and an array
filter leaves its other lines in place. The sets are broadcast if all of them together are BROADCAST_ROWS
hashes at most, else documents and sets meet by doc_id.

A key that very many documents hold is aggregated before it is bucketed, and its lines meet the frequent keys
by broadcast or in a skew join that splits them.

Edge cases: a null or empty text is one empty line; a row without doc_id counts for no key and loses
nothing; repeated rows of an id are one document; a key held only by one document stays however often it
repeats there; documents may end up empty; extra columns are carried along, those named n_lines and n_dropped
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_dir, small, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
#: Lines for a bucket of the runs: as many as a task sorts with ease, fewer while there are idle cores.
BUCKET_LINES, LEAST_BUCKET_LINES = 4_000_000, 100_000
#: The white space that is stripped, the letters that are lower-cased.
WHITE, UPPER, LOWER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


class LineIndex:
    """Levels of sorted runs (h1, h2, last_doc, n_docs) without a key in common, and counts of later batches."""

    def __init__(self, buckets: int = 8, fanout: int = FANOUT):
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[DataFrame]] = []
        self.more: list[DataFrame] = []

    def _run(self, df: DataFrame) -> DataFrame:
        """df as a table in the shared folder, bucketed and sorted by key."""
        spark, name = df.sparkSession, f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        return spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), whose documents are all below those of earlier batches."""
        once = batch.where("doc_id IS NOT NULL").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        keys = once.groupBy("h1", "h2").agg(F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"))
        runs = [r for level in self.levels for r in level]
        own = self._run(keys.repartition(self.buckets, "h1", "h2"))
        if runs:
            new = own
            for r in runs:
                new = new.join(r.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            new = self._run(new)
            self.more.append(stored(own.join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(None).cast("long").alias("last_doc"), "n_docs")))
            own = new
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(own)
            if len(self.levels[level]) < self.fanout:
                return
            own, self.levels[level] = self._compacted(self.levels[level]), []
            level += 1

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        """One run of some runs, with the counts that have come in for their keys; counts for keys elsewhere stay."""
        out = self._merged(runs)
        if self.more and len(runs) == sum(map(len, self.levels)):  # all counts are for these keys
            out, self.more = self._merged([out, *self.more]), []
        return self._run(out.repartition(self.buckets, "h1", "h2"))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("h1", "h2").agg(F.max("last_doc").alias("last_doc"), F.sum("n_docs").alias("n_docs"))

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return self._merged([*runs, *self.more]).where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc") if runs else None


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines, n_dropped."""
    k = F.col("k")
    each = (
        docs.select("doc_id", F.explode(lines(F.col("text"))).alias("line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select("doc_id", F.xxhash64(k).alias("h1"), F.xxhash64(k, F.lit(1)).alias("h2"))
    )
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    of = F.lit(0)
    for c in sorted(set(cuts)):
        of = of + (F.col("doc_id") <= c).cast("int")
    held = stored(each.withColumn("batch", F.coalesce(of, F.lit(0))), "batch")
    n, cores = held.count(), docs.sparkSession.sparkContext.defaultParallelism
    index = LineIndex(max(1, -(-n // BUCKET_LINES), min(cores, -(-n // LEAST_BUCKET_LINES))))
    for b in range(len(set(cuts)) + 1):
        index.add(held.where(F.col("batch") == b))
    hot = small(stored(index.frequent(min_docs)))
    dropped = stored(held.join(hot, ["h1", "h2"]).where(F.col("doc_id") < F.col("last_doc")).select("doc_id", "h1"))
    drops = dropped.groupBy("doc_id").agg(F.collect_set("h1").alias("__drops"))
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        drops = F.broadcast(drops)
    parts = F.col("__lines")
    kept = F.filter(parts, lambda x: ~((F.length(x) >= min_chars) & (F.length(key(x)) >= min_chars) & F.array_contains(F.col("__drops"), F.xxhash64(key(x)))))
    return (
        docs.join(drops, "doc_id", "left")
        .withColumn("__lines", lines(F.col("text")))
        .withColumn("__kept", F.when(F.col("__drops").isNull(), parts).otherwise(kept))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", (F.size("__lines") - F.size("__kept")).cast("long"))
        .withColumn("text", F.when(F.col("__drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("__kept", "\n")))
        .drop("__lines", "__kept", "__drops")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = f"""
lines AS (SELECT doc_id, row_id, pos, parts[pos] AS line,
            translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
     FROM (SELECT doc_id, row_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split_docs)),
hot AS (SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
kept AS (SELECT l.doc_id, l.row_id, count(*) AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL AND l.doc_id < h.last_doc) AS n_dropped,
            coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(h.k IS NOT NULL AND l.doc_id < h.last_doc, false)), '') AS text
     FROM lines l LEFT JOIN hot h ON l.k = h.k GROUP BY l.doc_id, l.row_id)
"""

SQL = f"""
WITH split_docs AS (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
{LINES_SQL}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept
"""
