"""The scan against every span of every document, at the threshold itself."""

import random
from collections import Counter

from lithoframe.llm import licenses

OWN = {"short": "one two three four five six seven", "long": "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "again": "one two one two one two three"}


def best_span(words, template):
    want, n, best = Counter(zip(template, template[1:], strict=False)), len(template) - 1, 0.0
    pairs = list(zip(words, words[1:], strict=False))
    for i in range(len(pairs)):
        left, common = dict(want), 0
        for j in range(i, len(pairs)):
            if left.get(pairs[j], 0):
                left[pairs[j]] -= 1
                common += 1
            best = max(best, 2 * common / (j + 1 - i + n))
    return best


def test_equals_every_span_at_the_threshold(spark):
    r = random.Random(17)
    rows = []
    for i in range(400):
        words = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(list(OWN.values())).split()
            for _ in range(r.randrange(0, 5)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = r.choice([["stray"], ["two", "odd"], [], ["one"]])
            words += w + [r.choice(["x", "one", "beta"])] * r.randrange(0, 4)
        rows.append((i, " ".join(words), "clash"))
    rows += [rows[3], (None, rows[5][1], "clash"), (900, None, "c"), (901, "", "c")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(3), OWN).collect()
    want = {}
    for i, t, _ in rows:
        for name, text in OWN.items():
            d = best_span((t or "").split(), text.split())
            if d >= licenses.LEAST - 1e-12:
                want[i, name] = round(d, 9)
    assert {(x.doc_id, x.license): round(x.dice, 9) for x in got} == want and len(got) == len(want)
    assert sum(abs(d - licenses.LEAST) < 1e-9 for d in want.values()) > 3


def test_templates_find_themselves_and_keep_clear_of_prose(spark):
    names = list(licenses.TEMPLATES)
    rows = [(i, "Some words before. " + licenses.TEMPLATES[n].upper() + " And after.") for i, n in enumerate(names)]
    rows += [(100, "this is a story of the software that was free for all the people in the town, without any of the usual terms " * 50)]
    got = {(x.doc_id, x.license) for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, n) for i, n in enumerate(names)} <= got and not any(d == 100 for d, _ in got)
