import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemill.llm import ngram_join


def brute(rows, k=5):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = list(sets)
    comp = {i: i for i in ids}
    again = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while again:
        again = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                again = True
    return sorted((i, len(sets[i]), comp[i]) for i in ids)


def made():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    base = [[word() for _ in range(r.randint(20, 160))] for _ in range(25)]
    rows, i = [], 0
    for b in base:
        for _ in range(r.randint(1, 14)):
            w = list(b)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w) + (" " + passage if r.random() < 0.2 else "")))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t "), (i + 3, "One two"), (i + 4, "one  TWO"), (i + 5, "one two three"), (i + 6, "x " * 9000), (i + 7, "x " * 30), (i + 8, "É a b c d"), (i + 9, "é a b c d")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(1000, 1_000_000, 13), (3, 400, 1)])
def test_brute(spark, monkeypatch, limits):
    for name, v in zip(("TRIE_SETS", "TRIE_SHINGLES", "HOT"), limits, strict=True):
        monkeypatch.setattr(ngram_join, name, v)
    rows = made()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = sorted(map(tuple, ngram_join.link(docs).collect()))
    assert got == brute(rows)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link(none).count() == 0
    twice = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.link(twice).collect())) == [(3, 2, 3), (3, 2, 3), (5, 2, 3)]


def test_trie_finds_what_sets_say():
    import numpy as np

    r = random.Random(1)
    sets = []
    for _ in range(120):
        base = sets[r.randrange(len(sets))] if sets and r.random() < 0.7 else set(r.sample(range(5000), r.randint(3, 60)))
        s = set(base)
        for _ in range(r.randint(0, 5)):
            s.add(r.randrange(5000))
            s.discard(r.choice(sorted(s)))
        sets.append(s or {1})
    find, used = ngram_join.joined(list(range(120)), [np.array(sorted(s), np.uint64) for s in sets], 80)
    for a, b in used:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert find(a) == find(b)


def test_tasks_send_and_hold_little(spark, monkeypatch):
    """Long documents of one task: batches of bounded size go to the executor, and counting takes little beside the sets held."""
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, row)) for row in r.integers(0, 1 << 40, (500, 5000)).tolist()]
    texts[1] = texts[0] + " x"

    def checked(run, *_):
        def wrapped(batches):
            for out in run(batches):
                assert len(out) <= 130_000
                yield out

        return wrapped

    monkeypatch.setattr(ngram_join, "frugal", checked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(docs).collect()}
    assert got == {i: 0 if i == 1 else i for i in range(500)}

    class Task:
        def mapInPandas(self, run, schema):
            return run

    batch = pd.DataFrame({"_id": range(500), "_text": texts})
    tracemalloc.start()
    try:
        for _ in ngram_join.surveyed(Task(), 5)([batch]):
            pass
        assert tracemalloc.get_traced_memory()[1] < 60e6  # of these 20 MB are the sets
    finally:
        tracemalloc.stop()
