import math
import random

import numpy as np
import pytest

from tidemill.llm import mtree, multi_index, vectors


def usable(v, zero):
    return v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def made(n=700):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(n)]
    rows += [(n + i, [0.5] * 6) for i in range(150)]  # one frequent vector
    rows += [(2000, None), (2040, [1.0, None, 0, 0, 0, 0]), (2080, [math.nan] * 6), (2120, [math.inf] * 6), (2100, [0.0] * 6), (2200, [1.0] * 5), (None, [1.0] * 6), (2300, []), (100, rows[7][1])]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def brute(rows, every, top, whole):
    rows = [(i, v) for i, v in rows if i is not None and usable(v, whole)]
    vec = [[math.floor(256 * x) for x in v] if whole else v for _, v in rows]
    out = []
    for (i, _), q in zip(rows, vec, strict=True):
        if i % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for (j, _), v in zip(rows, vec, strict=True) if j != i))
            out.append((i, [(j, -x) for x, j in s[:top]]))
    return out


@pytest.fixture
def frame(spark):
    rows = made()
    r = random.Random(1)
    r.shuffle(rows)
    return rows, spark.createDataFrame([(*x, 3, 4) for x in rows], "vec_id long, embedding array<float>, score int, grp string").repartition(3)


def test_mtree(frame, monkeypatch):
    for name, v in (("CHUNK", 200), ("BLOCK", 7), ("UNIT", 150)):
        monkeypatch.setattr(vectors, name, v)
    monkeypatch.setattr(mtree, "PAGE", 10)
    rows, df = frame
    got = {}
    for x in sorted(mtree.search(df, 50).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute(rows, 50, 5, True)
    ids = [i for i, _ in want]
    for i, w in want:
        if ids.count(i) == 1:
            assert got[i] == w
    assert set(got) == set(ids)


def test_mtree_avoids_distances():
    r = np.random.default_rng(2)
    centres = r.integers(-4000, 4000, (40, 6))
    x = (centres[r.integers(0, 40, 4000)] + r.integers(-20, 20, (4000, 6))).astype(np.int64)
    longest = int((x * x).sum(axis=1).max())
    own = np.arange(0, 4000, 200)
    for far in (0, 1 << 53):  # in doubles, and in whole numbers
        block = mtree.Block(x[own], own, longest + far, 5)
        page = mtree.build(mtree.lifted(x, longest + far), np.arange(4000), mtree.lifted(x, longest + far)[0], r)
        mtree.find([(page, mtree.lifted(x, longest + far)[0], np.inf)], block)
        for j, i in enumerate(own.tolist()):
            s = x @ x[i]
            best = sorted((-int(s[k]), k) for k in range(4000) if k != i)[:5]
            assert list(zip((-block.score[j]).tolist(), block.vec[j].tolist(), strict=True)) == best
        assert far or block.computed < 20 * 4000 * 0.6


def test_multi_index_is_exact_with_all_cells(frame, monkeypatch):
    for name, v in (("CHUNK", 200), ("BLOCK", 7), ("UNIT", 150)):
        monkeypatch.setattr(vectors, name, v)
    rows, df = frame
    got = {}
    for x in sorted(multi_index.search(df, 20, share=1.0, centroids=8).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute(rows, 20, 20, False)
    ids = [i for i, _ in want]
    for i, w in want:
        if ids.count(i) == 1:
            assert [s for _, s in got[i]] == pytest.approx([s for _, s in w], abs=1e-12)
            if len({round(s, 9) for _, s in w}) == 20:
                assert [j for j, _ in got[i]] == [j for j, _ in w]


def recall(df, every=20):
    got = {}
    for x in multi_index.search(df, every).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    rows = df.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows.embedding.to_list()).astype(float), rows.vec_id.to_numpy()
    found = total = 0
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[ids == ids[i]] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        found, total = found + len(best & got[ids[i]]), total + 20
    return found / total


def test_recall(spark):
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_on_many_vectors(spark, uneven):
    """20,000 vectors of one length, or of log-normal lengths."""
    r = np.random.default_rng(8)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if uneven:
        x *= np.exp(r.normal(0, 0.7, (len(x), 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(df, 200) >= 0.9


def test_pairs_come_by_distance():
    r = np.random.default_rng(1)
    a, b, counts = r.random(9), r.random(7), r.integers(0, 5, (9, 7))
    for most in (1, 20, 60, 1000):
        m, rank = multi_index.visited(a, b, counts, most)
        taken = {(i, j) for i in range(9) for j in range(7) if rank[j] < m[i]}
        order = sorted(((a[i] + b[j], i, j) for i in range(9) for j in range(7)))
        want, total = set(), 0
        for _, i, j in order:
            if total >= most:
                break
            want.add((i, j))
            total += counts[i, j]
        assert taken == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.search(df, 50).count() == 0 and multi_index.search(df, 20).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert mtree.search(one, 50).count() == 0 and multi_index.search(one, 20).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in mtree.search(two, 50).collect()] == [(0, 1, 5, 512 * 256)] and [tuple(x) for x in multi_index.search(two, 20).collect()] == [(0, 1, 5, 2.0)]


def test_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e6] * 100), (50, [-1e6] * 100)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too long"):
        mtree.search(df, 50)
    low = spark.createDataFrame([(0, [9e5] * 20), (50, [-9e5] * 20), (7, [9e5] * 19 + [1.0])], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in mtree.search(low, 50).collect()}
    a = 256 * 900_000
    assert got == {(0, 1): (7, 19 * a * a + a * 256), (0, 2): (50, -20 * a * a), (50, 1): (7, -19 * a * a - a * 256), (50, 2): (0, -20 * a * a)}


def test_ids_that_repeat_leave_their_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.1 * i]) for i in range(60)] + [(7, [-1.0, 0.5]), (9, [-2.0, 0.5])], "vec_id long, embedding array<double>")
    assert {x.vec_id for x in multi_index.search(df, 20, top=2).collect()} == {7, 9}
