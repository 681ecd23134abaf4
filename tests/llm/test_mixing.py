import random
import re

from typetrace.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share by weight, cap, and share the excess anew."""
    sources = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target = {s: 0.0 for s in sources}
    left, free = 1.5 * sum(sizes.values()), list(sources)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def some_docs(n=900, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rnd.choice(["a", "b", "Ä", None, "tiny" if i % 50 == 1 else "c"])
        text = rnd.choice([None, "", " \t\n"]) if i % 40 == 0 else " ".join(["wörd"] * rnd.randrange(1, 300))
        rows.append((i, text, "en", source))
    return rows


def check(rows, got):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    target = plain_targets(size)
    taken, largest = {}, {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source]
        assert abs(r.target - target[r.source]) <= 1e-6 * max(1, target[r.source])
        assert r.taken == r.size * r.copies and r.copies in (0, 1, 2)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_targets_and_rounding(docs_of):
    rows = some_docs()
    check(rows, mixing.mix_sources(docs_of(rows), fan=8).collect())


def test_reruns_agree_whatever_the_partitions(docs_of):
    docs = docs_of(some_docs(300))
    one, two = (sorted(map(tuple, mixing.mix_sources(d, fan=8).select("doc_id", "taken").collect())) for d in (docs, docs.repartition(7, "text")))
    assert one == two


def test_the_draw_is_fair(docs_of):
    docs = docs_of([(i, "w " * 10, "en", "s") for i in range(40)] + [(100 + i, "w " * 10, "en", "t") for i in range(40)])
    mean = sum(r.copies for seed in range(12) for r in mixing.mix_sources(docs, seed=seed).filter("source = 't'").filter("doc_id < 110").collect()) / 120
    assert abs(mean - 1.0) < 0.25  # s is capped at 2, so t gets 1


def test_repeated_rows_share_their_copies(docs_of):
    rows = [(i % 30, "w " * (1 + i % 30 % 7), "en", "s" if i % 30 % 2 else None) for i in range(90)]
    got = mixing.mix_sources(docs_of(rows), fan=4).collect()
    assert len(got) == 90
    assert len({(r.doc_id, r.copies) for r in got}) == 30


def test_rows_are_repeated_whole(docs_of):
    docs = docs_of(some_docs(200))
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    words = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {i: n for i, n in words.items() if n}


def test_empty_and_wordless_tables(docs_of):
    docs = docs_of(some_docs(5))
    assert mixing.mix_sources(docs.filter("false")).collect() == []
    got = mixing.mix_sources(docs_of([(1, None), (2, " ")])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]
