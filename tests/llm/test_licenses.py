import random

import brute
import pytest
from strandline.llm import licenses as lic

WORDS = lambda t: brute.ALNUM.findall((t or "").translate(brute.LOWER))


def plain(docs, templates, contained, block):
    sets, out = {k: set(WORDS(t)) for k, t in templates.items()}, []
    for i, text in docs:
        ws, base = WORDS(text), []
        for p, label in lic.PHRASES.items():
            p = p.split()
            base += [(k, label) for k in range(len(ws) - len(p) + 1) if ws[k : k + len(p)] == p]
        labels, score = {x for _, x in base}, float(bool(base))
        for line in (text or "").split("\n"):
            x = WORDS(line)
            for part in [x] if len(x) <= block else [x[k : k + block] for k in range(0, len(x), block // 2)]:
                for label, t in sets.items():
                    if len(t & set(part)) >= contained * len(t) - 1e-9:
                        labels.add(label)
                        score = max(score, len(t & set(part)) / len(t))
        at = [k for k, _ in base]
        out.append((i, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lic, "BLOCK", 16)
    r = random.Random(seed)
    pool = WORDS(" ".join(lic.TEMPLATES.values())) + ["x", "É", "yy"]
    docs = []
    for i in range(120):
        t = [r.choice(pool) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t) + 1)
            x = r.choice([*lic.TEMPLATES.values(), "Apache License", "MIT\nlicense", "CC-BY cc by", "the GNU General Public License"]).split()
            if r.random() < 0.5 and len(x) > 4:
                del x[r.randrange(len(x))]
            t[k:k] = x
        docs.append((i, "".join(x + r.choice([" "] * 9 + ["\n", ", "]) for x in t)))
    docs += [(500, None), (501, ""), (502, "apache"), (503, "license"), (504, "mit license " * 5000)] + docs[:2]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as labels").repartition(2)
    got = sorted((tuple(x) for x in lic.scan(df).collect()), key=lambda x: (x[0], x[1]))
    want = sorted(plain(docs, lic.TEMPLATES, lic.CONTAINED, 16), key=lambda x: (x[0], x[1]))
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert [x[-1] for x in got] == pytest.approx([x[-1] for x in want])
    assert len({x[6] for x in got}) > 10


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
