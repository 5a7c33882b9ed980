import corpus_pipeline
from tidemill.llm import queries
from tidemill.llm.shared import kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on what the one before kept, held against the operators' own brute-force tests' rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]

    good = kept(stage["quality classifier"](spark, docs, SF), "test")
    want = {r.doc_id for r in queries.op4_quality(spark, SF).filter("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == want and 0 < len(want) < docs.count()

    from test_ngram_join import brute

    alone = kept(stage["n-gram Jaccard join"](spark, good, SF), "test")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert alone.columns == docs.columns and sorted(r.doc_id for r in alone.collect()) == sorted(i for i, _, c in brute(rows) if i == c)

    import hashlib

    from test_substring_dedup import brute as brute_windows

    clean = kept(stage["substring dedup"](spark, alone, SF), "test")
    rows = [(r.doc_id, r.text) for r in alone.collect()]
    lost = {i: gone for i, _, gone, _ in brute_windows(rows, 20)}
    got = {r.doc_id: (hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest(), r.n_chars == len(r.text)) for r in clean.collect()}
    assert clean.columns == docs.columns and got == {i: (h, True) for i, _, _, h in brute_windows(rows, 20)}
    whole = dict(rows)
    assert all(r.text == whole[r.doc_id] for r in clean.collect() if not lost[r.doc_id])  # line breaks too

    from test_source_mix import WORDS, brute_targets

    mixed = kept(stage["mixing sources to target weights"](spark, clean, SF), "test")
    sizes, taken, times = {}, {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORDS.findall(r.text))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(WORDS.findall(r.text))
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 0.06 * t

    import public_tokenizers
    import tiktoken

    from tidemill.llm.byte_bpe import read_ranks

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = stage["byte-level BPE encoding and decoding"](spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(out) == sum(times.values())
    for r in out:
        assert r.n_tokens == len(own.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


NAMES = "_id _later gone doc _bits _word _kept _len _h _m _size _total _score _copies _copy c0 kept rep fp a b n words runs _rank _t".split()


def test_stages_carry_columns_of_any_name(spark):
    """Nulls, repeats, an empty text, and columns named like those that operators use."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.select(*docs.columns, *[(F.col("doc_id") * 2**50 + i).alias(n) for i, n in enumerate(NAMES)])
    odd = [(None, None), (None, "no id here"), (9001, None), (9002, ""), (9003, "word " * 300), (9003, "word " * 300)]
    extra = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema if f.name not in ("doc_id", "text")])
    docs = kept(docs.unionAll(extra), "test")
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert rows and stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "byte-level BPE encoding and decoding":
            assert len(rows) == 66
            continue
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        for r in rows:
            assert all(r[n] == given[r.doc_id][n] for n in NAMES), (name, r.doc_id)
        if name == "n-gram Jaccard join":
            ids = [r.doc_id for r in rows]
            assert ids.count(9003) == 1 and ids.count(None) == 2 and {9001, 9002} <= set(ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0
