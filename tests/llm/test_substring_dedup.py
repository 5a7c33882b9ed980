import hashlib
import random

import pytest

from tidemill.llm import substring_dedup


def brute(rows, window):
    docs = sorted((i, (t or "").encode().split()) for i, t in rows)
    first, out = {}, {}
    for i, w in docs:
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), (i, j))
    for i, w in docs:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (i, j):
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return sorted((i, *v) for i, v in out.items())


def made(seed):
    r = random.Random(seed)
    words = [f"w{x}" for x in range(40)]
    passages = [[r.choice(words) for _ in range(r.randint(15, 60))] for _ in range(8)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 40))]
        rows.append((i * 3, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1, None), (2, ""), (4, "x " * 500), (5, "x " * 500), (7, "x  " * 30), (8, "ü " * 19), (10, rows[5][1]), (11, rows[5][1]), (9999, rows[5][1] + " tail")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "shard", "seed"), [(20, 1000, 1), (20, 3, 2), (9, 1000, 3)])
def test_brute(spark, monkeypatch, window, shard, seed):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", 500)
    rows = made(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(5)
    got = sorted(map(tuple, substring_dedup.dedup(docs, window, digests=True).collect()))
    assert got == brute(rows, window)


def test_carry_and_edges(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "z a b c d e y", "x"), (None, "a b c d e f g", "x"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = {r.doc_id: (r.text, r.kept) for r in substring_dedup.dedup(docs, 5 + 4 - 1 - 1, carry=True).collect()}
    assert out == {1: ("a b c d e f g", "x"), 2: ("z a b c d e y", "x"), None: ("a b c d e f g", "x"), 3: (None, None)}
    assert substring_dedup.dedup(docs.limit(0), 20, digests=True).count() == 0
    spans = {r.doc_id: (r.spans, r.kept) for r in substring_dedup.dedup(spark.createDataFrame([(1, "s " + "a b c d e f g h i j"), (2, "q a b c d e f g h i j r")], "doc_id long, text string"), 8).collect()}
    assert spans == {1: ([], "s a b c d e f g h i j"), 2: ([1, 11], "q r")}


def test_carry_keeps_white_space_and_names(spark):
    shared = " ".join(f"w{i}" for i in range(8))
    rows = [(1, f"a\n\tb {shared}\n\nz", 7), (2, f"c  d\t{shared} \n e\x0bf ", None), (3, f" {shared} ", 2**60 + 1), (4, "x\ny", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long").toDF("doc_id", "text", "gone")
    out = {r.doc_id: (r.text, r.gone) for r in substring_dedup.dedup(docs, 8, carry=True).collect()}
    assert out == {1: (rows[0][1], 7), 2: ("c  d\te\x0bf ", None), 3: ("", 2**60 + 1), 4: ("x\ny", 5)}


def test_reference(spark):
    docs = spark.createDataFrame([(1, "p a b c d e q a b c d"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in substring_dedup.matched(docs, spark.createDataFrame([("x a b c d e y",), (None,)], "text string"), 4).collect()}
    assert got == {1: [1, 6, 7, 11], 2: []}
    with pytest.raises(ValueError):
        substring_dedup.matched(docs, docs, 4, most_words=5)
