import random
import re
from collections import Counter

import numpy as np
import pytest

from typetrace.llm import collocations as co


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least=10, top=2000):
    count, words = {}, Counter()
    for text, lang in rows:
        f = count.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            f.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rank = []
        for p, a in found.items():
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, n, p.decode(), -a, l, r, words[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(rank)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["Ärger", "É", "é", "New", "york"]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rnd.randrange(200)):
            text += rnd.choice(["of the old town", "hot dog", "a a a a", "New York Times", *rnd.choices(words, k=6)]) + rnd.choice([" ", "  ", "\t", ". ", ", ", "\r\n", " - "])
        rows.append((text, rnd.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" .\n", None), ("x y z " * 60_000, "en"), ("same same. " * 30, "xx")] + [("twice said line", "yy")] * 12


def rows_for(corpus):
    return [(i, t, lang, "s") for i, (t, lang) in enumerate(corpus)]


def test_phrases_match_a_plain_count(docs_of, corpus):
    assert got(co.collocations(docs_of(rows_for(corpus)))) == plain(corpus)


def test_bursts_spills_and_blocks_change_nothing(docs_of, corpus, monkeypatch):
    """Functions sent to workers carry no module state, so the counter is held to the same here, in this process."""
    import pyarrow as pa

    from typetrace.llm import textbytes as tb

    for name, value in (("BURST", 8), ("HELD", 300), ("NAMED", 60), ("BLOCK", 50)):
        monkeypatch.setattr(co, name, value)
    counter, total = co.Counter(4), Counter()
    runs = 0
    for at in range(0, len(corpus), 10):
        some = corpus[at:at + 10]
        for batch in [*counter.add(*tb.utf8(pa.array([t for t, _ in some], pa.string())), pa.array([g or "und" for _, g in some])), *(counter.close() if at + 10 >= len(corpus) else ())]:
            runs += 1
            for k in range(batch.num_rows):
                for r in co.merged(pa.Table.from_batches([batch.slice(k, 1)]), 1).to_pylist():
                    total[r["lang"], r["phrase"]] += r["n"]
    want = Counter()
    for text, lang in corpus:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want[lang or "und", None] += len(w)
            want.update((lang or "und", " ".join(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert +total == +want and runs > 50


def test_tries_keep_order(monkeypatch):
    monkeypatch.setattr(co, "BURST", 16)
    rnd = np.random.default_rng(1)
    root, want = co.Node(0, 0, 1 << co.ID_BITS * 3), Counter()
    for _ in range(30):
        ids = rnd.integers(1, 12, (400, 3)) * rnd.integers(1, 3, (400, 1))
        phrase, n = np.unique((ids[:, 0] << 2 * co.ID_BITS) + (ids[:, 1] << co.ID_BITS) + ids[:, 2], return_counts=True)
        root.add(phrase, n)
        want.update(dict(zip(phrase.tolist(), n.tolist())))
    runs = list(root.runs())
    phrase = np.concatenate([p for p, _ in runs])
    assert (np.diff(phrase) > 0).all() and dict(zip(phrase.tolist(), np.concatenate([n for _, n in runs]).tolist())) == want
    assert root.size() == len(phrase) and any(isinstance(c, co.Node) for c in root.children)
    spilled = list(root.spill(100))
    assert sum(len(p) for p, _ in spilled) >= 100 and root.size() == len(phrase) - sum(len(p) for p, _ in spilled)


def test_top_and_ties(docs_of):
    rows = [(" . ".join(f"a{i} b{i}" for i in range(40)), "en")] * 10
    found = got(co.collocations(docs_of(rows_for(rows)), top=7))
    assert found == plain(rows, top=7) and len(found) == 7


def test_whole_numbers_beyond_64_bits(spark):
    a = 3_037_000_500_123
    df = spark.range(1).selectExpr(f"{a}L AS a", f"{a + 7}L AS l", f"{a * 3}L AS r")
    from pyspark.sql import functions as F
    assert df.select(co._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // ((a + 7) * a * 3)


def test_empty_table(docs_of):
    assert co.collocations(docs_of([(1, "a")]).filter("false")).collect() == []
