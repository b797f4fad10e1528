"""Scans, classifiers and extraction against brute force, held-out accuracy and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lithoframe.llm import decontam, fingerprints, flat, html_blocks, licenses, quality, secrets, toxicity
from lithoframe.llm.gam import AdditiveModel

EDGES = [None, "", " \n\t ", "x", "é日本\U0001f600", "a" * 70_000, "same text twice", "same text twice"]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "other", 7) for i, t in enumerate(EDGES)], "doc_id long, text string, score string, n_chars int").repartition(3)


def column(texts):
    return pa.array(texts, pa.string())


def test_words_and_shingles_equal_plain_python():
    texts = EDGES + ["One two  Three\x0bfour", " lead and trail ", "É É é"]
    for _, _, data, off in flat.chunks(column(texts), 64):
        start, end, doc, h = flat.words(data, off)
        assert len(np.unique(h)) == len({bytes(data[a:b]).lower() for a, b in zip(start, end, strict=True)})
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [[w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    got = [s for _, _, data, off in flat.chunks(column(texts)) for s in flat.shingles(*flat.words(data, off)[2:], len(off) - 1, 2)]
    for w, s in zip(want, got, strict=True):
        assert len(s) == (len({tuple(w[i : i + 2]) for i in range(len(w) - 1)}) if len(w) > 1 else len(w))


# --- 2: licences


def test_license_scan_equals_brute_force(spark, edges):
    r = random.Random(4)
    rows = []
    for i in range(40):
        words = [f"w{r.randrange(50)}" for _ in range(r.randrange(60))]
        name, text = r.choice(list(licenses.TEMPLATES.items()))
        t = text.upper().split() if i % 2 else text.split()
        if i % 5 == 0 and len(t) > 20:
            t[10] = "changed"
        rows.append((i, " ".join(words[:20]) + "\n" + " ".join(t) + ".\n" + " ".join(words[20:]), name))
    got = {(x.doc_id, x.license) for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert {(i, n) for i, _, n in rows} <= got

    def bag(words):
        return Counter(zip(words, words[1:], strict=False))

    norm = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    for i, t, _ in rows:
        w = norm(t)
        for name, text in licenses.TEMPLATES.items():
            b = bag(norm(text))
            n = sum(b.values())
            best = max((2 * sum((bag(w[a : a + k]) & b).values()) / (k - 1 + n) for k in range(max(2, int(n * 0.6)), int(n * 1.6) + 2) for a in range(max(1, len(w) - k + 1))), default=0) if len(w) < 90 else 0
            if best >= licenses.LEAST + 0.1:
                assert (i, name) in got
            if (i, name) in got and len(w) < 90:
                assert best >= licenses.LEAST - 1e-9
    assert licenses.scanned(edges).count() == 0 == licenses.scanned(edges.limit(0)).count()


# --- 3: fingerprints


def test_fingerprints_of_the_next_document(spark, edges):
    r = random.Random(2)
    rows = [(i * 3, " ".join(r.choice(["alpha", "beta", "gamma", "de", "é"]) + str(r.randrange(90)) for _ in range(r.randrange(1, 300)))) for i in range(90)] + [(1, None), (2, ""), (4, "z")]
    got = {x.doc_id: x for x in fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    order = sorted(rows)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x.fingerprint == fingerprints.fingerprints([t])[0] and x.edited_fingerprint == fingerprints.fingerprints([edited])[0]
        if len(t) > 400:
            assert x.near_edited > 0.5 > x.near_next
    assert len(got) == len(rows)
    out = fingerprints.fingerprinted(edges).collect()
    assert len(out) == len(EDGES) and len({x.fingerprint for x in out if x.n_chars == 15}) == 1
    assert fingerprints.fingerprinted(edges.limit(0)).count() == 0


def test_walk_equals_one_by_one_and_follows_edits():
    def plain(text):
        c = fingerprints._codes(text)
        lv, out = fingerprints.level(len(c)), []
        path, p = [], 0
        for j in range(2 << lv):
            path.append(int(c[p]) if p < len(c) else 0)
            if p < len(c):
                p += int(fingerprints._BITS[j % fingerprints.PERIOD][c[p]])
        for w in (0, 1):
            out.append("".join("." if not path[j] else f"{fingerprints._DIGIT[s][path[j]]:x}" for s, j in enumerate(fingerprints._STEPS[lv - w])))
        return f"{len(c):x}:{out[0]}:{out[1]}"

    r = random.Random(9)
    texts = ["", "a", "ab", *("".join(r.choice("etaoin shrdlu") for _ in range(r.randrange(1, 900))) for _ in range(60))]
    assert fingerprints.fingerprints(texts) == [plain(t) for t in texts]
    t = texts[-1] * 4
    near = t[:50] + "!!" + t[50:300] + t[303:]
    a, b, c = fingerprints.fingerprints([t, near, texts[-2] * 4])
    assert fingerprints.likeness(a, b) > 0.8 > 0.3 > fingerprints.likeness(a, c)
    assert set(fingerprints.bands(a)) & set(fingerprints.bands(b))


def test_near_pairs(spark):
    r = random.Random(5)
    base = ["".join(r.choice("etaoin shrdlu") for _ in range(800)) for _ in range(5)]
    rows = [(i, b) for i, b in enumerate(base)] + [(10 + i, b[:100] + "x" + b[100:]) for i, b in enumerate(base)] + [(20, base[0])]
    df = fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = {(x.other, x.doc_id) for x in fingerprints.near_pairs(df).collect()}
    assert pairs == {(i, 10 + i) for i in range(5)}


# --- 4: secrets


def test_secret_scan_equals_the_patterns(spark, edges):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    r = random.Random(8)
    bits = ["token=", "Secret: ", "AKIA", "password = '", "api_key\":", "abcdef0123456789", "deadbeef", "XYZ9", "=", " ", "\n", "é", "API_KEY=short", "ſecret=abcdefghijklmnop", "passwd:password: abcdefghijkl"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(40)))) for i in range(300)]
    for x in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, spans = rows[x.doc_id][1], []
        for k, (name, p) in enumerate(kinds):
            for m in p.finditer(text):
                if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k]:
                    spans.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
        base = ",".join(s for _, _, s in sorted(spans))
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(x.spans.split(","))
    out = {x.doc_id: x for x in secrets.scanned(edges).collect()}
    assert len(out) == len(EDGES) - 0 and out[0].spans == "" and out[5].n_hex == 1
    assert secrets.scanned(edges.limit(0)).count() == 0


def test_battery_tells_random_tokens_from_words():
    r = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_tokens = ["".join(r.choice(alphabet) for _ in range(r.randrange(24, 60))) for _ in range(200)]
    words = ["internationalisation_of_the_user_interface", "ThisIsACamelCaseIdentifierName", "some-long-url-slug-with-many-words", "CONSTANT_NAME_IN_UPPER_CASE_LETTERS", "donaudampfschifffahrtsgesellschaft", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "--------------------------------"]
    assert sum(bool(secrets.discoveries([(0, len(t), secrets.p_value(t))])) for t in random_tokens) > 190
    assert not any(secrets.discoveries([(0, len(t), secrets.p_value(t))]) for t in words)


def test_battery_by_encoding_and_over_the_corpus(spark):
    """Random tokens of every encoding among words; dates and identifiers stay; one threshold for all documents."""
    r = random.Random(4)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = ["2024-06-11T15-30-12Z-build-1042-rc1", "550e8400-e29b-41d4-a716-446655440000", "rechtsschutzversicherungsgesellschaft", "org/apache/commons/lang3/StringUtils", "12345678901234567890123", "aaaaaaaaaaaaaaaaaaaaaaaa", "antidisestablishmentarianism"]
    rows, random_at = [], {}
    for i, (alphabet, least) in enumerate(((upper + lower + digits + "+/", 0.95), (upper + lower + digits, 0.95), (lower + digits, 0.7), (upper + "234567", 0.7), ("0123456789ABCDEF", 0.7), (lower, 0.7))):
        for j in range(60):
            random_at[100 * i + j] = least
            rows.append((100 * i + j, f"keep {''.join(r.choice(alphabet) for _ in range(48))} here"))
    rows += [(1000 + i, f"some text with {r.choice(plain)} in it") for i in range(300)] + [(2000, " ".join(plain)), (2001, None)]
    got = {x.doc_id: x for x in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i in range(6):
        own = [d for d in random_at if d // 100 == i]
        hit = [got[d].spans in ("random:5:53", "assign:5:53", "hex:5:53") for d in own]
        assert sum(hit) >= random_at[own[0]] * len(own), (i, sum(hit))
    assert not any(x.n_random for d, x in got.items() if d >= 1000)
    steps = {secrets.step(p): n for p, n in ((1e-9, 3), (0.0101, 5), (0.5, 92))}
    assert secrets.least_step(steps) == secrets.step(1e-9) and secrets.least_step({}) > secrets.step(0)


def test_license_scan_reads_across_gaps(spark):
    rows, want = [], {}
    for i, name in enumerate(("MIT", "Apache-2.0 header", "BSD-2-Clause", "GPL-3.0 header", "ISC")):
        w = re.findall(r"[^\W_]+", licenses.TEMPLATES[name])
        half, n = len(w) // 2, len(w) - 1
        rows += [(2 * i, " ".join(["before", *w[:half], *"five words from somewhere else".split(), *w[half:], "after"]))]
        want[2 * i, name] = 2 * (n - 1) / (n + n + 5)
        rows += [(2 * i + 1, " ".join([*w[:half], *"five words from somewhere else".split(), *w[half + 5 :]]))]
        want[2 * i + 1, name] = 2 * (n - 6) / (n + n)
    got = {(r.doc_id, r.license): r.dice for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got.get(k) for k, v in want.items() if v >= licenses.LEAST} == {k: pytest.approx(v) for k, v in want.items() if v >= licenses.LEAST}


# --- 5: decontamination


def test_decontamination(spark, edges):
    items = [(1, "A train travels 120 km in 3 hours from Berlin to Madrid while the other train waits at the old station. How fast is it?"), (2, "What is the capital city of the largest island"), (3, None), (4, "six literal words make one item")]
    changed = "A train travels 95 km in 2 hours from Oslo to Vienna while the other train waits at the old station. How fast is it?"
    inconsistent = "If Ann has 5 apples and Ann eats 5 of the red ones, how many green ones are left over for Bob"
    items.append((5, inconsistent))
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    docs = [(0, "Intro text. " + items[0][1] + " Some more."), (1, "intro, " + changed.upper() + " " + changed), (2, "The capital city is large."), (3, "x " + items[3][1] + " y"), (4, items[1][1]), (5, inconsistent.replace("Ann", "Eve").replace("Bob", "Max").replace("5", "8")), (6, "a train travels far. how fast is it"), (7, None)]
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1), (1, 1), (3, 4), (4, 2), (5, 5)}
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, most=0).collect()} == got
    assert decontam.contaminated(edges, bench).count() == 0 == decontam.contaminated(edges, bench.limit(0)).count()


def test_slots_must_map_one_to_one():
    def read(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return decontam.templates(raw, np.array([0, len(raw)]))[1:]

    it, iv = read("take 5 then 5 again and 7 at last")
    for text, n in (("take 8 then 8 again and 9 at last", 9), ("take 8 then 6 again and 9 at last", 6), ("take 8 then 8 again and 8 at last", 6)):
        dt, dv = read(text)
        assert (dt == it).all() and decontam.consistent(it, iv, dt, dv)[0] == n


# --- 7 and 8: classifiers


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    m = AdditiveModel(pairs=2).fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    assert len(m.grids) == 2 and {m.grids[0][0], m.grids[0][1]} == {0, 1}


def test_quality_held_out(spark, edges):
    sf = "/root/testdata/sf0.01"
    out = quality.op7_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r[0] == r[1] for r in rows) / len(rows) > 0.93
    assert out.count() == 1000
    model = quality.fit(edges, labels.limit(0), quality.F.lit(True))
    scored = quality.score(edges, model, "doc_id", "n_chars").collect()
    assert len(scored) == len(EDGES) and all(x.score == 0.5 for x in scored)
    assert quality.score(edges.limit(0), model, "doc_id").count() == 0


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(d[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(6)
    terms = ["idiot", "scum", "worthless", "loser", "dis", "disgusting"]
    auto = toxicity.Automaton(terms, ["lowei"])
    words = [*terms, "loweixyz", "lowei", "lowe"]
    for _ in range(1500):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randrange(2)] = r.choice(["", "x", "s", "t"])
        words.append("".join(w) or "q")
    text = np.array([ord(c) for c in "".join(words)], np.uint32)
    end = np.cumsum([len(w) for w in words])
    got = auto.run(text, end - [len(w) for w in words], end)
    for w, g in zip(words, got.tolist(), strict=True):
        fit = [e for t in terms if (e := edit_distance(t, w)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)] + [0] * w.startswith("lowei")
        assert g == (1 + min(fit) if fit else 0), (w, g, fit)


def test_levenshtein_automaton_of_a_large_lexicon():
    r = random.Random(8)
    terms = sorted({"".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randrange(4, 13))) for _ in range(600)})
    words = []
    for w in r.sample(terms, 150):
        i = r.randrange(len(w))
        words += [w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[::-1]]
    text = np.array([ord(c) for c in "".join(words)], np.uint32)
    end = np.cumsum([len(w) for w in words])
    want = []
    for w in words:
        fit = [e for t in terms if abs(len(t) - len(w)) <= 2 and (e := edit_distance(t, w)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
        want.append(1 + min(fit) if fit else 0)
    for most in (60_000, 50):
        auto = toxicity.Automaton(terms, most=most)
        auto.TOGETHER = 40  # states are dropped between the blocks
        assert auto.run(text, end - [len(w) for w in words], end).tolist() == want


def test_lexicon_is_not_capped(spark):
    rows = [(i, 1, " ".join(f"{c}{d}{n}term" for c in "abcdefghij" for d in "klmnopqrst" for n in "uvwxyz")) for i in range(5)]
    rows = [(i, y, f"{t} own{i}") for i, y, t in rows]
    words, _ = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, y int, text string"))
    assert len(words) == 600


def test_lexicon_reads_every_different_text(spark):
    common = "alpha beta gamma delta"  # shared by all, so that the texts agree in their least word hash
    rows = [(i, int(i % 6 == 0), f"{common} own{i}" + " blaggard" * (i % 6 == 0)) for i in range(60)]
    rows += [(100 + i, 1, f"{common} copied") for i in range(9)]
    words, stems = toxicity.lexicon(spark.createDataFrame(rows, "doc_id long, y int, text string"))
    assert (words, stems) == (["blaggard"], [])


def test_toxicity_on_planted_words(spark, edges):
    r = random.Random(3)
    vocab = [f"{a}{b}" for a in ("ner", "tol", "sim", "kad", "vor") for b in ("an", "est", "il", "o", "uk", "ita")]
    rows = []
    for i in range(600):
        w = [r.choice(vocab) for _ in range(r.randrange(5, 60))]
        toxic = i % 5 == 0
        for _ in range(r.randrange(1, 4) * toxic):
            w.insert(r.randrange(len(w)), r.choice(["blaggard", "frobnitz", "dreckmensch"]))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9999, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.F.col("doc_id") < 400)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 400)
    odd = model.score(column(["you are a blagard and a frobniz frobnitzz", "kadan norest", '"blaggard" he said', None]))
    assert odd[0] > odd[2] and odd[1] < 0.5 and odd[3] < 0.5
    out = toxicity.score(edges, model).collect()
    assert len(out) == len(EDGES) and all(x.score < 0.5 for x in out)
    assert toxicity.score(edges.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), labels.limit(0), toxicity.F.lit(True))
    assert all(x.score == 0.5 for x in toxicity.score(edges, none).collect())


def test_decontamination_of_opening_names_other_case_and_insertions(spark):
    names = "James has 3 dogs. James has 2 cats. James buys 5 fish. James gives 1 dog away. How many pets does James have?"
    mixed = "The river Thames flows past Oxford and then past London before it meets the wide grey sea near Southend."
    plain = "every green kettle sings softly while seven tired sailors carry heavy wooden boxes over narrow bridges towards quiet harbours before winter storms arrive from distant frozen northern islands"
    w = plain.split()
    split = " ".join([*w[:9], "very", *w[9:12], "odd", *w[12:20], "old", *w[20:]])
    bench = spark.createDataFrame([(1, names), (2, mixed), (3, plain)], "item_id long, text string")
    docs = [names.replace("James", "Maria"), mixed.upper(), mixed.lower(), split, "Maria has nothing in common with any of these questions at all, and neither has London."]
    got = {(r.doc_id, r.item_id): r.n_tokens for r in decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 2), (3, 3)}
    assert got[0, 1] == 23 and got[3, 3] >= 17


# --- 10: extraction


def test_labeller_gradient_is_right():
    m = html_blocks.Labeller(1)
    rng = np.random.default_rng(0)
    x, mask = html_blocks.padded([rng.random((5, html_blocks.INPUT)).astype(np.float32), rng.random((3, html_blocks.INPUT)).astype(np.float32)])
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    y = (rng.random(mask.shape) > 0.5).astype(float)
    loss = lambda: float((-(y * np.log(p := m.forward(x, mask)[0]) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())
    traces = ([], [])
    p, both = m.forward(x, mask, traces)
    ds = ((p - y) * mask / mask.sum())[..., None]
    grad = {k: np.zeros_like(v) for k, v in m.p.items()}
    d = ds @ m.p["wo"].T
    m._back(x, d[..., : html_blocks.HIDDEN], "f", traces[0], grad)
    m._back(x, d[..., html_blocks.HIDDEN : 2 * html_blocks.HIDDEN], "b", traces[1], grad)
    for k, i in (("whf", (3, 7)), ("wxb", (10, 40)), ("bf", (20,)), ("whb", (1, 60))):
        old = m.p[k][i]
        m.p[k][i] = old + 1e-3
        up = loss()
        m.p[k][i] = old - 1e-3
        down = loss()
        m.p[k][i] = old
        assert abs((up - down) / 2e-3 - grad[k][i]) < 2e-4


def test_extraction(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav class="menu"><a href="/">Home</a> | <a>About</a></nav><div class="cookie">We use cookies.</div><article><h1>The &lt;Title&gt;</h1><p>First   para &amp; more,\n<b>bold</b> text that goes on.<br>Next line.<p>Second caf&eacute; para with enough words in it.</p><script>var x = "</p>";</script><!-- <p>no</p> --></article><div class="comments"><p>I am a reader.</p></div><footer>&copy; me</footer></body>'
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<"), (None, "z", "<div"), (1, "u", page)]
    got = html_blocks.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    want = "The <Title>\n\nFirst para & more, bold text that goes on. Next line.\n\nSecond café para with enough words in it."
    assert [x.text for x in got if x.page_id == 1] == [want, want] and all(x.n_chars == len(x.text) for x in got)
    assert {x.text for x in got if x.page_id in (2, 3)} == {""} and len(got) == 6
    held = html_blocks.training(120, seed=77)
    right = [(g == (y > 0.5)) for g, (_, y) in zip(html_blocks.trained().label([x for x, _ in held]), held, strict=True)]
    assert np.concatenate(right).mean() > 0.99
