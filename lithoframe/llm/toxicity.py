"""Operator 8: toxicity scores from a learnt lexicon, matched by Levenshtein automata.

The lexicon holds words, and stems with any ending, whose documents are labelled toxic nearly always. The
words form a trie; the Levenshtein automata of all of them, intersected with the trie, are one
deterministic automaton, which reads all words of a chunk of documents side by side: a table lookup a
character. Its states are made when a word first needs them and dropped when there are too many. Short words must match exactly, longer ones within one edit, long ones within two. Around each
match a window of characters is read: quotation marks on both sides, or reporting words before it, mark a
quotation, and forms of address mark abuse. A logistic model of these counts gives the score.

Labels are learnt from SAMPLE rows at most, chosen by a hash of the id; the lexicon has all words that their
different texts bear out. Every document is scored over its whole text.

Edge cases: null and empty texts have no matches and get the score of such documents; repeated rows get
equal scores; without labels, or with labels of one kind, the score is the smoothed share of label 1; null
labels are not learnt from; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .flat import chunks
from .quality import remainder, sample

SAMPLE = 20_000
#: Documents an entry of the lexicon must have been seen in, and share of them that is toxic.
LEAST_DOCS, LEAST_SHARE = 4, 0.95
STEMS = (4, 5, 6)
CONTEXT = 48
#: Marks of quotation; reporting words; forms of address.
QUOTES = "\"“”„«»‘’‹›"
REPORTS = ("said", "says", "called", "quote", "quoted", "wrote", "term", "word", "sagte", "nannte", "wort", "dijo", "palabra", "dit", "mot")
ADDRESS = ("you", "your", "youre", "du", "dein", "dich", "ihr", "tu", "ton", "vous", "usted", "eres")

_CP = 0x250
_LOW = np.arange(0x110000, dtype=np.uint32)
_LOW[:_CP] = [ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_CP)]
_IN = np.ones(0x110000, bool)
_IN[:_CP] = [chr(c).isalnum() for c in range(_CP)]
_IN[0x2000:0x2070] = _IN[0x3000:0x3003] = False


class Automaton:
    """All words of a lexicon within their edits, and stems with any ending, as one table.

    States are sets of (trie node, edits); step[state, class of character] is the next one, 0 is dead and -1
    not made yet. best[state] is 1 + the least edits of a word that ends there, 0 if none does. A state is made
    when a word comes to it, so the size of the lexicon is not bounded; beyond `most` states, or CELLS of the
    table, all are dropped and made anew.
    """

    CELLS = 16_000_000
    #: Words read between two looks at the size.
    TOGETHER = 50_000

    def __init__(self, terms: list[str], stems: list[str] = (), most: int = 60_000):
        self.terms = terms
        children, depth_edits, ends = [{}], [0], {}
        for word, is_stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            node, allow = 0, 0 if is_stem or len(word) < 5 else 1 if len(word) < 9 else 2
            depth_edits[0] = max(depth_edits[0], allow)
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    depth_edits.append(0)
                node = children[node][c]
                depth_edits[node] = max(depth_edits[node], allow)
            ends.setdefault(node, []).append((allow, is_stem))
        alphabet = sorted({c for kids in children for c in kids})
        self.cls = np.zeros(0x110000, np.uint16)
        for i, c in enumerate(alphabet, 1):
            self.cls[ord(c)] = i
        top = -1  # any ending of a stem

        def closed(found: dict[int, int]) -> frozenset:
            todo = list(found.items())
            while todo:  # a character of the word left out
                node, e = todo.pop()
                if node == top or found[node] < e:
                    continue
                for kid in children[node].values():
                    if e + 1 <= depth_edits[kid] and found.get(kid, 9) > e + 1:
                        found[kid] = e + 1
                        todo.append((kid, e + 1))
            if top in found:
                return frozenset([(top, 0)])
            return frozenset(found.items())

        def move(state: frozenset, c: str | None) -> frozenset:
            found: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if node == top or e <= depth_edits[node]:
                    found[node] = min(found.get(node, 9), e)

            for node, e in state:
                if node == top:
                    put(top, 0)
                    continue
                kid = children[node].get(c) if c else None
                if kid is not None:
                    put(kid, e)
                    if e == 0 and any(s for _, s in ends.get(kid, ())):
                        put(top, 0)
                put(node, e + 1)
                for k in children[node].values():
                    put(k, e + 1)
            return closed(found)

        def best(state: frozenset) -> int:
            fit = [e for node, e in state if node != top and any(e <= a and not s for a, s in ends.get(node, ()))]
            return 1 if any(n == top for n, _ in state) else 1 + min(fit) if fit else 0

        self._move, self._best, self._start, self._alphabet = move, best, closed({0: 0}), [None, *alphabet]
        self.most = max(2, min(most, self.CELLS // len(self._alphabet)))
        self._reset()

    def _reset(self) -> None:
        self._states, self._known = [frozenset(), self._start], {frozenset(): 0, self._start: 1}
        self.step = np.full((1024, len(self._alphabet)), -1, np.int32)
        self.step[0] = 0
        self.best = np.zeros(1024, np.int8)
        self.best[1] = self._best(self._start)

    def _make(self, state: int, c: int) -> None:
        nxt = self._move(self._states[state], self._alphabet[c])
        if nxt not in self._known:
            self._known[nxt] = n = len(self._states)
            self._states.append(nxt)
            if n == len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.best = np.concatenate([self.best, np.zeros_like(self.best)])
            self.best[n] = self._best(nxt)
        self.step[state, c] = self._known[nxt]

    def run(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """best of each word text[start:end] (lower-cased code points)."""
        out = np.zeros(len(start), np.int8)
        for i in range(0, len(start), self.TOGETHER):
            if len(self._states) > self.most:
                self._reset()
            part = slice(i, i + self.TOGETHER)
            out[part] = self._run(text, start[part], end[part])
        return out

    def _run(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int8)
        alive, state, at = np.arange(len(start)), np.ones(len(start), np.int32), start.copy()
        while len(alive):
            done = at >= end[alive]
            if done.any():
                out[alive[done]] = self.best[state[done]]
                alive, state, at = alive[~done], state[~done], at[~done]
                continue
            c = self.cls[text[at]]
            nxt = self.step[state, c]
            if (new := nxt < 0).any():
                width = len(self._alphabet)
                for k in np.unique(state[new].astype(np.int64) * width + c[new]).tolist():
                    self._make(*divmod(k, width))
                nxt = self.step[state, c]
            state, at = nxt, at + 1
            live = state > 0
            if not live.all():
                alive, state, at = alive[live], state[live], at[live]
        return out


NAMES = ("matched", "edited", "edited_short", "quoted", "address", "rate", "any")


class Matcher:
    def __init__(self, terms: list[str], stems: list[str]):
        self.words = Automaton(terms, stems)
        self.reports, self.address = set(REPORTS), set(ADDRESS)
        self.quotes = np.zeros(0x110000, bool)
        self.quotes[[ord(c) for c in QUOTES]] = True

    def spans(self, data: np.ndarray, off: np.ndarray):
        """doc, start, end, edits, quoted, addressed of every match; starts and ends in code points of the chunk; words of each document."""
        text = data.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        off = heads[off]
        low = _LOW[cp]
        inside = _IN[cp]
        n = len(cp)
        prev = np.zeros(n, bool)
        prev[1:] = inside[:-1]
        filled = off[:-1] < off[1:]
        prev[off[:-1][filled]] = False
        start = np.flatnonzero(inside & ~prev)
        nxt = np.zeros(n, bool)
        nxt[:-1] = inside[1:]
        nxt[off[1:][filled] - 1] = False
        end = np.flatnonzero(inside & ~nxt) + 1
        doc = np.searchsorted(off[:-1], start, "right") - 1
        count = np.bincount(doc, minlength=len(off) - 1)
        hit = self.words.run(low, start, end)
        at = np.flatnonzero(hit)
        quote = np.concatenate(([0], np.cumsum(self.quotes[cp])))
        lo, hi = np.maximum(start[at] - CONTEXT, off[doc[at]]), np.minimum(end[at] + CONTEXT, off[doc[at] + 1])
        quoted = (quote[start[at]] > quote[lo]) & (quote[hi] > quote[end[at]])
        addressed = np.zeros(len(at), bool)
        for i, (a, b, s, e) in enumerate(zip(lo.tolist(), hi.tolist(), start[at].tolist(), end[at].tolist(), strict=True)):
            before = "".join(c if c.isalnum() else " " for c in text[a:s].lower()).split()
            after = "".join(c if c.isalnum() else " " for c in text[e:b].lower()).split()
            quoted[i] |= bool(self.reports.intersection(before[-4:]))
            addressed[i] = bool(self.address.intersection(before[-4:] + after[:4]))
        return doc[at], start[at] - off[doc[at]], end[at] - off[doc[at]], hit[at] - 1, quoted, addressed, count

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not len(data):
            return np.zeros((n, len(NAMES)))
        doc, start, end, edits, quoted, addressed, count = self.spans(data, off)
        per = lambda flag: np.bincount(doc[flag], minlength=n).astype(float)
        plain, long = ~quoted, end - start >= 7
        exact, edited = per(plain & (edits == 0)), per(plain & (edits > 0) & long)
        short = per(plain & (edits > 0) & ~long)
        total = exact + edited  # a longer misspelt term counts like the term; the labels may take from that by the second column
        return np.column_stack([np.log1p(total), np.log1p(edited), np.log1p(short), np.log1p(per(quoted)), np.log1p(per(addressed & plain)), np.minimum(1, 20 * total / np.maximum(count, 1)), total > 0])


@lru_cache(2)
def matcher(terms: tuple[str, ...], stems: tuple[str, ...]) -> Matcher:
    return Matcher(list(terms), list(stems))


def lexicon(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems of docs (doc_id, y, text) that toxic documents hold and others hardly ever."""
    # copies would pass their own words off as terms: of equal texts with equal labels one is read
    once = docs.groupBy(F.xxhash64("text"), F.length("text"), "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    bag = docs.join(once, "doc_id").select("doc_id", "y", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("bag"))
    each = bag.select("doc_id", "y", F.explode("bag").alias("w")).where("length(w) BETWEEN 3 AND 40")
    stem = F.explode(F.filter(F.transform(F.array(*(F.lit(n) for n in STEMS)), lambda n: F.when(F.length("w") > n, F.col("w").substr(F.lit(1), n))), lambda s: s.isNotNull()))

    def kept(df: DataFrame, least: int) -> list:
        return df.where((F.col("toxic") >= least) & (F.col("toxic") >= LEAST_SHARE * F.col("docs"))).orderBy(F.desc("toxic"), "w").collect()

    by_word = kept(each.groupBy("w").agg(F.sum("y").alias("toxic"), F.count("*").alias("docs")), LEAST_DOCS)
    found = each.select("doc_id", "y", "w", stem.alias("s")).groupBy(F.col("s").alias("w")).agg(F.count_distinct(F.when(F.col("y") == 1, F.col("doc_id"))).alias("toxic"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("w").alias("endings"))
    stems: dict[str, None] = {}
    begins = lambda w: any(w[:n] in stems for n in STEMS)
    for s in sorted((r["w"] for r in kept(found.where("endings >= 3"), LEAST_DOCS + 2)), key=lambda s: (len(s), s)):
        if not begins(s):
            stems[s] = None
    return [r["w"] for r in by_word if not begins(r["w"])], list(stems)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights, the last of them the constant, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Toxicity:
    def __init__(self, terms: list[str], stems: list[str], weights: np.ndarray | None = None):
        self.terms, self.stems, self.weights, self._matcher = terms, stems, weights, None

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}  # each worker builds the automaton, once for all its tasks

    @property
    def matcher(self) -> Matcher:
        self._matcher = self._matcher or matcher(tuple(self.terms), tuple(self.stems))
        return self._matcher

    def features(self, column: pa.Array) -> np.ndarray:
        x = [self.matcher.features(d, o) for _, _, d, o in chunks(column)]
        return np.concatenate(x) if x else np.zeros((0, len(NAMES)))

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.features(column)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE) -> Toxicity:
    chosen = F.broadcast(sample(labels, "toxic", learn, rows))  # `rows` rows of two numbers at most
    own = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    model = Toxicity(*lexicon(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, i].astype(float)) for i in range(len(NAMES)))], ["doc_id", "y", *NAMES])

    found = own.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, " + ", ".join(f"{n} double" for n in NAMES)).orderBy("doc_id").toPandas()
    model.weights = logistic(found.iloc[:, 2:].to_numpy(float).reshape(-1, len(NAMES)), found["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
