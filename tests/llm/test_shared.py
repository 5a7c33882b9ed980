import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import shared


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbB éü\t\n\x0b\x1c ", max_size=12), max_size=8))
def test_word_hashes_tell_words_apart(texts):
    raw = [t.encode() for t in texts]
    words = [[w for w in re.findall(rb"[^\x20\x09-\x0D]+", t)] for t in raw]
    h, first = shared.word_hashes(raw)
    assert [b - a for a, b in zip(first[:-1], first[1:], strict=True)] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(h) == len(flat) and len(set(h.tolist())) == len(set(flat)) and len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat))
    low = shared.word_hashes(raw, lower=True)[0]
    assert len(set(low.tolist())) == len({bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in flat})


def test_run_hashes_and_slices():
    r = random.Random(0)
    w = np.array([r.randrange(3) for _ in range(60)], np.uint64)
    for k in (1, 2, 5):
        h = shared.run_hashes(w, k).tolist()
        runs = [tuple(w[i : i + k].tolist()) for i in range(len(w) - k + 1)]
        assert len(set(zip(h, runs, strict=True))) == len(set(runs)) == len(set(h))
    assert len(shared.run_hashes(w, 61)) == 0
    texts = [b"x" * n for n in (5, 50, 1, 1, 200, 3)]
    cut = list(shared.slices(texts, 40))
    assert cut[0][0] == 0 and cut[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, i) for i in range(2001, 2200)] + [(7000, 7000)]
    up, find, union = shared.union_find()
    for a, b in edges:
        union(a, b)
    r.shuffle(edges)
    got = {x.node: x.comp for x in shared.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_loses_none(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "x")
    df = spark.range(20000).withColumn("id", F.when(F.col("id") % 11 != 0, F.col("id")))
    may = shared.maybe_in(ids, "x")
    kept, out = may(df, F.col("id")), may(df, F.col("id"), anti=True)
    want = {i for i in range(0, 5000, 7) if i % 11}
    have = {r.id for r in kept.collect()}
    assert want <= have and len(have) < len(want) + 50 and kept.count() + out.count() == 20000


def test_some_rows(spark):
    df = spark.range(20000)
    assert shared.some_rows(df, ["id"], 30000).count() == 20000 and 800 < shared.some_rows(df, ["id"], 1000).count() < 1200


def test_few_tables_stay_in_the_shared_folder(spark, tmp_path, monkeypatch):
    """Only those that a query's result reads are left when it is returned, and none after clean()."""
    import os

    import corpus_pipeline
    from tidemill.functions import steps
    from tidemill.llm import queries

    steps.clean(spark)
    monkeypatch.setattr(steps, "shared_dir", lambda spark: f"file://{tmp_path}")
    most = {"op2_language_id": 0, "op3_mtree": 3, "op4_quality": 0, "op5_source_mix": 3, "op7_substring_dedup": 2, "op8_multi_index": 2, "op9_ngram_join": 2, "pipeline": 1}
    for name, n in most.items():
        run = corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name]
        out = run(spark, "/root/testdata/sf0.001")
        left = os.listdir(tmp_path)
        assert len(left) <= n, (name, left)
        assert out.count() > 0
        steps.clean(spark)
        assert os.listdir(tmp_path) == [], name


def test_columns_by_place(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Text int, _score int, _SCORE_ int")
    plain, (text,) = shared.numbered(df, "text")
    assert plain.columns == ["c0", "c1", "c2"] and text == "c0" and shared.unused("_score", df) == "_score__" and shared.unused("x", df) == "x"
