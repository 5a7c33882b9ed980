import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import language_id

ORDER = 3


def brute_model(texts, order):
    """P(char | context) of interpolated Kneser-Ney, from dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        x = [32] * (order - 1) + language_id.codes(t).tolist()
        if len(x) > order - 1:
            counts[order].update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, types = {}, defaultdict(int), defaultdict(int)
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for g, v in c.items():
            total[k, g[:-1]] += v
            types[k, g[:-1]] += 1
    return counts, discount, total, types


def prob(model, g, floor):
    counts, discount, total, types = model
    k = len(g)
    if k == 0:
        return floor
    h = (k, g[:-1])
    lower = prob(model, g[1:], floor)
    if not total[h]:
        return lower
    return max(counts[k][g] - discount[k], 0) / total[h] + discount[k] * types[h] / total[h] * lower


def made():
    r = random.Random(2)
    kinds = {"aa": "abcde", "bb": "cdefg", "cc": "xyzüé"}
    rows = []
    for i in range(240):
        lang = r.choice(list(kinds))
        rows.append((i, " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(3, 30))), lang))
    return rows + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "aa"), (1003, "abc dea", None), (1004, "xyz " * 60000, "cc")]


def test_model_is_kneser_ney(spark):
    rows = made()[:60]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", ORDER)
    alphabet = {c for _, t, _ in rows for c in language_id.codes(t).tolist()}
    r = random.Random(1)
    for i, lang in enumerate(model.langs):
        brute = brute_model([t for _, t, x in rows if x == lang], ORDER)
        floor = 1 / (len(alphabet) + 1)
        for _ in range(60):
            g = tuple(r.choice(sorted(alphabet)) for _ in range(ORDER))
            got = math.exp(model.logs([np.array([c], np.uint32) for c in g])[0][i])
            assert abs(got - prob(brute, g, floor)) < 1e-5, (lang, g)


def test_identify(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") % 3 != 1).collect()}
    assert set(got) == {r[0] for r in rows}
    held = [(r[2], got[r[0]]) for r in rows if r[0] % 3 == 1 and r[0] < 1000]
    assert all(g.held_out for _, g in held) and sum(x == g.lang_pred for x, g in held) >= 0.95 * len(held)
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[1003].lang_pred in ("aa", "bb") and got[1004].lang_pred == "cc" and all(0 <= g.score <= 1 for g in got.values())


def test_rejects_what_no_model_knows(spark):
    rows = made()[:200] + [(5000, "щжф ывап олдж " * 20, None), (5001, "qqqq wwww rrrr " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") < 5000).collect()}
    assert not got[5000].accepted and not got[5001].accepted
    assert sum(r.accepted for i, r in got.items() if i < 5000) > 190


def test_tables_too_large_for_a_broadcast_lose_no_run(spark, monkeypatch):
    r = random.Random(5)
    wide = [(2**60 + i, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(500)), "zz") for i in range(40)]  # 20,000 runs, each about once
    docs = spark.createDataFrame(made() + wide, "doc_id long, text string, lang string").repartition(3)
    learn = F.col("doc_id") % 3 != 1
    want = {r.doc_id: r for r in language_id.identify(docs, learn).collect()}
    monkeypatch.setattr(language_id, "MODEL_CELLS", 1)  # 10,000 rows of an order
    got = {r.doc_id: r for r in language_id.identify(docs, learn).collect()}
    assert set(got) == set(want) and len(got) == docs.count()
    for i, w in want.items():
        assert (got[i].held_out, got[i].lang_pred, got[i].accepted) == (w.held_out, w.lang_pred, w.accepted), i
        assert abs(got[i].score - w.score) < 1e-4, i


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(one, F.lit(True)).first().lang_pred == "und"


def test_given_table(spark):
    from tidemill.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out and lang is not null")
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_scores_are_calibrated(spark):
    """Short texts of two alike languages: the mean score of rows that weren't learned is near the share of right ones."""
    r = random.Random(4)
    weights = {"aa": (6, 5, 4, 3, 2, 1), "bb": (3, 4, 3, 4, 3, 4)}
    text = lambda x: " ".join("".join(r.choices("abcdef", weights[x], k=r.randint(2, 6))) for _ in range(r.randint(1, 12)))
    rows = [(i, text(x), x) for i, x in enumerate(r.choices(["aa", "bb"], k=6000))]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 3 != 1).filter("held_out").collect()
    truth = {i: x for i, _, x in rows}
    right = sum(g.lang_pred == truth[g.doc_id] for g in got) / len(got)
    assert 0.6 < right < 0.97 and abs(sum(g.score for g in got) / len(got) - right) < 0.02


def test_what_calibrates_is_not_counted(spark):
    rows = spark.createDataFrame([(f"text {i // 2}", "aa") for i in range(4000)] + [(f"few {i}", "bb") for i in range(10)], "_text string, _lang string")
    counted, spared = language_id.apart(rows)
    a, b = {r._text for r in counted.collect()}, {r._text for r in spared.collect()}
    assert not a & b and counted.count() + spared.count() == 4010 and 60 < len(b) < 140 and {f"few {i}" for i in range(10)} <= a
