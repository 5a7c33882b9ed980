import re

import pytest
from pyspark.sql import functions as F

from tidemill.llm import source_mix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: source -> words; shares the excess again until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level >= most * sizes[s]]
        if not over:
            return t | {s: w[s] * level for s in open_}
        for s in over:
            t[s] = most * sizes[s]
            left -= t[s]
            open_.remove(s)
    return t


def check(rows, got, near=0.02):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORDS.findall(text or ""))
    want = brute_targets(sizes)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len(WORDS.findall(t or ""))) for i, t, _ in rows)
    by_id = {i: s for i, _, s in rows}
    for r in got:
        assert r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(want[by_id[r.doc_id]], rel=1e-9, abs=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if by_id[r.doc_id] == s) - t) <= max(2, near * t)


def test_mix(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 61), f"s{i % 5}" if i % 7 else None) for i in range(600)]
    rows += [(1000 + i, "a b c d e", "big") for i in range(900)]  # one source with a third of all, all of one size
    rows += [(2000, None, "s0"), (2001, "", "s1"), (2002, "\x0b \t", "none"), (2003, "x y", "é"), (2004, "word " * 3000, "s2")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = source_mix.mix(docs, [3, 1, 2]).collect()
    check(rows, got)
    again = source_mix.mix(docs.repartition(7), [3, 1, 2]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    # the rates are exponential in size below the cap
    import math

    small = {(r.size, r.rate) for r in got if r.doc_id < 600 and r.doc_id % 5 == 0 and r.doc_id % 7 and 0 < r.rate < 2 and r.size}
    if len(small) > 2:
        slopes = [math.log(x) / s for s, x in small]
        assert max(slopes) - min(slopes) < 1e-4
    carried = source_mix.mix(docs, [3, 1, 2], carry=True)
    assert carried.columns == docs.columns + ["_copies"]
    assert {(r.doc_id, r._copies) for r in carried.collect()} == {(r.doc_id, r.copies) for r in got}


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mix.mix(docs, [3, 1, 2]).count() == 0
    one = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    got = source_mix.mix(one, [3, 1, 2]).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], source_mix.mix(docs, [3, 1, 2]).collect())
    assert docs.filter(F.col("text").isNull()).count() == 0


def test_rates_are_those_of_a_plain_solver(spark):
    import math

    rows = [(i, "w " * (1 + (i * 7919) % 97), f"s{i % 3}") for i in range(900)] + [(5000 + i, "w " * 700, "s1") for i in range(40)]
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [3, 1, 2]).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(rows[r.doc_id][2] if r.doc_id < 900 else "s1", []).append(r.size)
    targets = brute_targets({s: sum(x) for s, x in sizes.items()})
    for s, own in sizes.items():
        if targets[s] >= 2 * sum(own):
            continue
        mean, lo, hi = sum(own) / len(own), -100.0, 100.0
        rate = lambda lam, n: min(2.0, math.exp(min(lam * n / mean, 4)))  # noqa: B023, E731
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(n * rate(lam, n) for n in own) < targets[s] else (lo, lam)
        mine = [r for r in got if r.size in own and r.source_size == sum(own)]
        assert mine and all(abs(r.rate - rate(lam, r.size)) < 1e-5 for r in mine)
        assert sum(abs(r.copies - r.rate) >= 1 for r in mine) <= 6 and abs(sum(r.copies for r in mine) - sum(r.rate for r in mine)) < 8
