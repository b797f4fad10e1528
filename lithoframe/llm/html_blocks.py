"""Operator 10: main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of tags,
classes and ids above it. A bidirectional LSTM in numpy reads, for each block, a vector of hashed path
parts, hashed words and a few measures (length, share of link text, punctuation, place in the page); its
two directions give every block the whole page as context, and each block is labelled as article or not.
The network is trained here, on pages that a generator writes in many layouts with known labels; the
weights are the same in every run and go to the workers with the function.

Scripts, styles, templates, comments and form controls are never text. A page is read once from left to right
in time linear in its length, however broken its markup; paths hold every open element.

Edge cases: null and empty html give an empty text; unclosed and stray tags are tolerated, a p ends at the next
block and an open head at the first element or text that cannot be in it; a < that no > follows is text; from a
tag whose quotes never close on, tags end at the first >; character references are decoded (also without a
semicolon, as browsers do), broken ones stay as they are; repeated rows give equal rows; very long pages are
read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .flat import words

#: Fixed values of HTML: block-level elements, elements without content, elements whose content is not text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("template select option".split())
LITERAL = frozenset("script style textarea title iframe noembed noframes xmp".split())
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
SCOPES = frozenset("table td th caption button object marquee template html".split())
CLOSES_P = BLOCKS - {"body", "html", "noscript"}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])", re.I | re.A) for n in LITERAL}
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

PATH, WORDS, MEASURES = 251, 32, 8
INPUT, HIDDEN = PATH + WORDS + MEASURES, 16


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[int, ...]):
        self.path, self.text, self.linked = path, [], 0


@lru_cache(maxsize=20_000)
def _bucket(part: str) -> int:
    return zlib.crc32(part.encode()) % PATH


@lru_cache(maxsize=20_000)
def _parts(name: str, attributes: str) -> tuple[int, ...]:
    """Buckets of a tag and of the words in its class, id and role."""
    out = [_bucket(name)]
    for _, a, b, c in _NAMES.findall(attributes):
        out += [_bucket("." + w) for w in _PART.findall((a or b or c).lower())]
    return tuple(out)


class _Open:
    """The open elements: their names, and the distinct path buckets down to each (PATH at most, shared where a child adds none)."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[tuple[int, ...]] = [()]
        self.count: dict[str, int] = {}
        self.ps: list[int] = []
        self.scopes: list[int] = []
        self.links = self.raw = 0

    def push(self, name: str, parts: tuple[int, ...]) -> None:
        path = self.paths[-1]
        new = [p for p in parts if p not in path]
        if name == "p":
            self.ps.append(len(self.names))
        elif name in SCOPES:
            self.scopes.append(len(self.names))
        self.names.append(name)
        self.paths.append((*path, *dict.fromkeys(new)) if new else path)
        self.count[name] = self.count.get(name, 0) + 1
        self.links += name == "a"
        self.raw += name in RAW

    def pop(self, name: str) -> None:
        """Close the last open element of that name and all inside it; nothing if there is none."""
        if not self.count.get(name):
            return
        while True:
            n = self.names.pop()
            self.paths.pop()
            self.count[n] -= 1
            self.links -= n == "a"
            self.raw -= n in RAW
            if n == "p":
                self.ps.pop()
            elif n in SCOPES:
                self.scopes.pop()
            if n == name:
                return

    def closes_p(self) -> bool:
        return bool(self.ps) and (not self.scopes or self.scopes[-1] < self.ps[-1])


def blocks(page: str) -> list[tuple[tuple[int, ...], str, float]]:
    """(path buckets, text, share of link text) of each leaf block with text, in page order."""
    out, now, opened = [], None, _Open()
    tag_at, last = _TAG, page.rfind(">")

    def text(s: str) -> None:
        nonlocal now
        if opened.raw or not s:
            return
        if now is None:
            if s.isspace():
                return
            if opened.count.get("head"):
                opened.pop("head")
            now = Block(opened.paths[-1])
        now.text.append(s)
        if opened.links:
            now.linked += len(s)

    def flush() -> None:
        nonlocal now
        if now is not None:
            raw = "".join(now.text)
            t = " ".join(html.unescape(raw).split())
            if t:
                out.append((now.path, t, now.linked / len(raw)))
            now = None

    at, look = 0, page.find("<")
    while 0 <= look:
        c = page[look + 1 : look + 2]
        if c in ("!", "?") and c:
            text(page[at:look])
            mark, skip = ("-->", 4) if page.startswith("<!--", look) else ("]]>", 9) if page.startswith("<![CDATA[", look) else (">", 2)
            end = page.find(mark, look + skip)
            at = len(page) if end < 0 else end + len(mark)
            look = page.find("<", at)
            continue
        m = tag_at.match(page, look) if look < last else None
        if m is None:
            if look > last:
                break  # no tag can follow
            if tag_at is _TAG and _PLAIN_TAG.match(page, look):
                tag_at = _PLAIN_TAG
            else:
                look = page.find("<", look + 1)
            continue
        text(page[at:look])
        at, name = m.end(), m[2].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            text(" ")
        if m[1]:
            opened.pop(name)
        else:
            if opened.count.get("head") and name not in IN_HEAD:
                opened.pop("head")
            if name in CLOSES_P and opened.closes_p():
                opened.pop("p")
            if name == "li" and opened.names and opened.names[-1] == "li":
                opened.pop("li")
            if name in LITERAL:  # its content is not markup
                found = _ENDS[name].search(page, at)
                end = page.find(">", found.end()) if found else -1
                at = len(page) if end < 0 else end + 1
                if name != "textarea":
                    flush()
            elif name not in VOID and not m[3].endswith("/"):
                opened.push(name, _parts(name, m[3]))
        look = page.find("<", at)
    text(page[at:])
    flush()
    return out


def vectors(pages: list[list[tuple[tuple[int, ...], str, float]]]) -> list[np.ndarray]:
    """For each page, a row for each of its blocks."""
    found = [b for page in pages for b in page]
    n = len(found)
    x = np.zeros((n, INPUT), np.float32)
    if n:
        raw = [t.encode("utf-8", "surrogatepass") for _, t, _ in found]
        size = np.array([len(r) for r in raw], np.int64)
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))
        _, _, doc, h = words(data, off)
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        bucket = np.bincount(doc * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        x[:, PATH : PATH + WORDS] = bucket / np.sqrt(count)[:, None]
        deep = [len(p) for p, _, _ in found]
        x[np.repeat(np.arange(n), deep), np.array([b for p, _, _ in found for b in p], np.int64)] = 1
        points = np.concatenate(([0], np.cumsum(np.isin(data, np.frombuffer(b".,;", np.uint8)))))
        per = [len(page) for page in pages]
        place = (np.arange(n) - np.repeat(np.cumsum(per) - per, per)) / np.repeat(np.maximum(per, 1), per)
        first, last = data[off[:-1]], data[off[1:] - 1]
        x[:, PATH + WORDS :] = np.column_stack([
            np.log1p(size) / 6, [f for _, _, f in found], np.isin(last, np.frombuffer(b".!?", np.uint8)), (points[off[1:]] - points[off[:-1]]) / size * 10,
            place, 1 - place, np.log1p(count) / 5, (first >= 65) & (first <= 90),
        ])
    return np.split(x, np.cumsum([len(page) for page in pages])[:-1]) if pages else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM with one output a block; batches are padded at the end, mask marks blocks."""

    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"wx{d}": w(INPUT, 4 * HIDDEN), f"wh{d}": w(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"wo": w(2 * HIDDEN + INPUT, 1), "bo": np.zeros(1, np.float32)}

    def _direction(self, x: np.ndarray, mask: np.ndarray, d: str, trace: list | None):
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        pre = x @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.p[f"wh{d}"]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = f * c + i * g
            h2 = o * np.tanh(c2)
            if trace is not None:
                trace.append((k, h, c, i, f, o, g, c2, m))
            h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, k] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, traces: tuple[list, list] | None = None):
        f = self._direction(x, mask, "f", traces and traces[0])
        b = self._direction(x, mask, "b", traces and traces[1])
        both = np.concatenate([f, b, x], 2)
        return _sigmoid((both @ self.p["wo"] + self.p["bo"])[..., 0]), both

    def _back(self, x: np.ndarray, dout: np.ndarray, d: str, trace: list, grad: dict) -> None:
        wh = self.p[f"wh{d}"]
        n, t, _ = x.shape
        dh_next, dc_next = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz_all = np.zeros((n, t, 4 * HIDDEN), np.float32)
        for k, h, c, i, f, o, g, c2, m in reversed(trace):
            dh = dout[:, k] + dh_next
            th = np.tanh(c2)
            dh2 = m * dh
            dc = m * dc_next + dh2 * o * (1 - th**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh2 * th * o * (1 - o), dc * i * (1 - g**2)], 1)
            dz_all[:, k] = dz
            grad[f"wh{d}"] += h.T @ dz
            dh_next = dz @ wh.T + (1 - m) * dh
            dc_next = dc * f + (1 - m) * dc_next
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"wx{d}"] += x.reshape(-1, INPUT).T @ flat
        grad[f"b{d}"] += flat.sum(0)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, size: int = 50, rate: float = 0.01, seed: int = 3) -> Labeller:
        rng = np.random.Generator(np.random.PCG64(seed))
        mean, var = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(pages) // size)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), size):
                part = [pages[i] for i in order[lo : lo + size]]
                x, mask = padded([a for a, _ in part])
                y = np.zeros(mask.shape, np.float32)
                for i, (_, t) in enumerate(part):
                    y[i, : len(t)] = t
                traces: tuple[list, list] = ([], [])
                p, both = self.forward(x, mask, traces)
                ds = ((p - y) * mask / mask.sum())[..., None]
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["wo"] = both.reshape(-1, both.shape[2]).T @ ds.reshape(-1, 1)
                grad["bo"] = ds.sum((0, 1))
                dboth = ds @ self.p["wo"].T
                self._back(x, dboth[..., :HIDDEN], "f", traces[0], grad)
                self._back(x, dboth[..., HIDDEN : 2 * HIDDEN], "b", traces[1], grad)
                step += 1
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (1 - 0.95 * step / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks are article, page by page; pages of like length share a batch."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= 8192:
                hi += 1
            part = order[lo:hi]
            p, _ = self.forward(*padded([pages[i] for i in part]))
            for k, i in enumerate(part):
                out[i] = p[k, : len(pages[i])] >= 0.5
            lo = hi
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask = np.zeros((len(xs), t, INPUT), np.float32), np.zeros((len(xs), t), np.float32)
    for i, a in enumerate(xs):
        x[i, : len(a)], mask[i, : len(a)] = a, 1
    return x, mask


#: Class names that pages use for what is not the article, and for it.
ASIDE = {
    "nav": "nav menu navbar topbar breadcrumb breadcrumbs links sitemap", "header": "header masthead top logo banner site-header", "footer": "footer bottom copyright legal site-footer",
    "aside": "sidebar aside related widget recommended popular rail", "ad": "ad ads advert advertisement sponsored promo promotion sponsor", "notice": "notice cookie cookies consent gdpr alert popup modal",
    "form": "form search newsletter subscribe login signup", "comments": "comments comment replies reply discussion disqus", "share": "share social tags meta byline tools",
}
ARTICLE = "content post article entry story main body text article-body post-content entry-content".split()


class Pages:
    """Writes pages in many layouts."""

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(x) for x in ("bcdfghklmnprstvw", "aeiouéüñ", "nrstl ")).strip() for _ in range(90)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        style, s = self.style, self.words(1, 14)
        s = s.upper() if style == "caps" else s.capitalize()
        if style == "marks":
            s = " ".join(w + self.r.choice(["***", "%%%", "&amp;&amp;", "!!", "|"]) for w in s.split())
        if self.r.random() < 0.08:
            s += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 4)}'
        if self.r.random() < 0.08:
            s = f"<b>{s}</b>"
        return s + self.r.choice([".", ".", ".", "!", "?", ",", "", "<br>"])

    def paragraph(self, lo: int = 1, hi: int = 9) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))

    def named(self, kind: str) -> str:
        names = ASIDE[kind].split()
        n = names[0] if self.r.random() < 0.4 else self.r.choice(names)
        return f'{self.r.choice(["class", "class", "id"])}="{n}{self.r.choice(["", "", " box", "-1", " w-2"])}"'

    def off(self, kind: str) -> str:
        """Something that is not the article."""
        r, tag = self.r, {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if r.random() < 0.3 and kind != "form":
            tag = r.choice(["div", "section"])
        attributes = f" {self.named(kind)}" if tag in ("div", "section") or r.random() < 0.5 else ""
        link = lambda: f'<a href="/{r.randint(0, 99)}">{self.words(1, 4)}</a>'
        if kind == "nav" or (kind in ("aside", "footer", "header", "share") and r.random() < 0.5):
            inside = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.7 else " | ".join(link() for _ in range(r.randint(2, 7)))
        elif kind == "form":
            inside = f'<label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(3, 9)}.</p>" if r.random() < 0.5 else "")
        elif kind == "comments":
            inside = f"<h3>{self.words(1, 2)}</h3>" + "".join(f'<{t} class="comment"><p>{self.paragraph(1, 4)}</p></{t}>' for t in r.choices(["div", "li"], k=r.randint(1, 5)))
        elif kind == "footer":
            inside = f"&copy; {self.words(1, 3)} &middot; {self.paragraph(1, 2)}"
        elif kind == "notice" and r.random() < 0.15:
            return f"<noscript>{r.choice(['<p>{}</p>', '{}', '<div>{}</div>']).format(self.paragraph(1, 2))}</noscript>"
        else:
            inside = (f"<h3>{self.words(1, 4)}</h3>" if r.random() < 0.3 else "") + r.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(self.paragraph(1, 3))
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(1, 12).upper() if self.style == 'caps' else self.words(1, 12)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.78:
                out.append(f"<p>{self.paragraph()}" + ("</p>" if r.random() < 0.85 else ""))
            elif x < 0.84:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif x < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.94:
                out.append(f"<blockquote>{self.paragraph(1, 3)}</blockquote>")
            elif x < 0.97:
                out.append(f"<pre>{self.words(2, 12)}</pre>")
            else:
                out.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
        return "".join(out)

    def deep(self, inside: str) -> str:
        """inside below some more elements."""
        names = self.r.choices(["container", "wrapper", "page", "layout", "row", "col", "inner"], k=self.r.randint(2, 9))
        return "".join(f'<div class="{n}">' for n in names) + inside + "</div>" * len(names)

    def page(self) -> str:
        """html in which the characters 1 and 0 stand where the article starts and ends."""
        r = self.r
        self.style = r.choice(["plain", "plain", "plain", "caps", "marks"])
        tag, attributes = r.choice([("article", ""), ("article", f' class="{r.choice(ARTICLE)}"'), ("main", ""), ("div", f' class="{r.choice(ARTICLE)}"'), ("div", f' id="{r.choice(ARTICLE)}"'), ("section", f' class="{r.choice(ARTICLE)}"')])
        before = [self.off(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5]
        after = [self.off(k) for k in ("share", "comments", "aside", "ad", "nav", "form", "footer") if r.random() < 0.45]
        inner = self.article()
        if r.random() < 0.25:
            cut = inner.find("</p>") + 4
            if cut > 3:
                inner = inner[:cut] + "\x00" + self.off(r.choice(["ad", "share", "form"])) + "\x01" + inner[cut:]
        body = f"<{tag}{attributes}>\x01{inner}\x00</{tag}>"
        if r.random() < 0.4:
            body = f'<div class="{r.choice(["container", "wrapper", "page", "layout", "row"])}">{body}{"".join(after[:1])}</div>'
            after = after[1:]
        if r.random() < 0.25:
            body = self.deep(body)
        if after and r.random() < 0.2:
            after[-1] = self.deep(after[-1])
        page = f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
        return page


def training(n: int = 2000, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of written pages. A mark turns into a block of its own that says where the article starts and ends."""
    write, out = Pages(seed), []
    for _ in range(n):
        marked = blocks(write.page().replace("\x01", "<hr>\x01<hr>").replace("\x00", "<hr>\x02<hr>"))
        inside, found, label = False, [], []
        for b in marked:
            if b[1] in "\x01\x02":
                inside = b[1] == "\x01"
            else:
                found.append(b)
                label.append(inside)
        if found:
            out.append((found, np.array(label, np.float32)))
    return list(zip(vectors([f for f, _ in out]), [y for _, y in out], strict=True))


@lru_cache(maxsize=1)
def trained() -> Labeller:
    return Labeller().train(training())


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    out: list[str] = []
    for lo in range(0, len(pages), 400):
        found = [blocks(p) for p in pages[lo : lo + 400]]
        for b, keep in zip(found, model.label(vectors(found)), strict=True):
            out.append("\n\n".join(t for (_, t, _), k in zip(b, keep.tolist(), strict=True) if k))
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts([t or "" for t in b.column(2).to_pylist()], model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
