"""The corpus pipeline: five stages over documents, each an operator of tidemill.llm. Each is written and reread before the next.

documents has doc_id, text and source; further columns, whatever their names and types, are carried along, and n_chars follows the text where it
is there. Null and empty texts: scored like any text by the first stage, linked with nothing, losing nothing, of size 0 (one copy), encoded as
no ids. Rows without an id are kept by the stages that look for copies. Of rows that repeat an id and its text one stays; rows of one id with
other texts are documents of their own to all stages but the n-gram join, which asks that an id has one text: there they are kept or
dropped together. Ties of the mix go by hashes of ids, then of texts. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.steps import scratch
from tidemill.llm import byte_bpe, ngram_join, quality, source_mix, substring_dedup
from tidemill.llm.queries import fold, table
from tidemill.llm.shared import kept, maybe_in, numbered


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs, labels, learn=fold(5) != 0, carry=True)
    return scored.filter(scored[scored.columns[-1]] >= 0.3).drop(scored.columns[-1])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of rows that repeat an id and its text, one."""
    groups = kept(ngram_join.link(docs.select("doc_id", "text"), k=5, threshold=80), "pipeline-links")
    later = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_later"))
    plain, (own, text) = numbered(docs, "doc_id", "text")
    left = plain.join(later, F.col(own) == F.col("_later"), "left_anti")
    twice = groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_twice")
    some = maybe_in(twice, "_twice")
    again = F.row_number().over(Window.partitionBy(own, F.md5(text)).orderBy(F.xxhash64(text)))
    # rows that repeat an id and a text are as good as each other, so any order will do
    once = some(left, F.col(own)).withColumn("_row", again).filter((F.col("_row") == 1) | F.col(own).isNull()).drop("_row")
    return some(left, F.col(own), anti=True).unionAll(once).toDF(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that start earlier in the corpus, other texts as they were; n_chars follows."""
    out = substring_dedup.dedup(docs, window=20, carry=True)
    plain, (text,) = numbered(out, "text")
    chars = [F.length(text).cast(f.dataType).alias(f"c{i}") if f.name == "n_chars" else F.col(f"c{i}") for i, f in enumerate(docs.schema)]
    return plain.select(*chars).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    plain = source_mix.mix(docs, weights=[3, 1, 2], share=1.5, most=2, carry=True)
    plain, copies = plain.toDF(*(f"c{i}" for i in range(len(plain.columns)))), f"c{len(docs.columns)}"
    each = plain.filter(F.col(copies) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return each.drop("_copy", copies).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded bytes' digests of each document of the mix."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: A trained classifier and a rounded optimum are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as last:
        for _, stage in STAGES[:-1]:
            with scratch(spark) as only:  # a stage's own tables go when its documents are written
                docs = only(kept(stage(spark, docs, sf_dir), "pipeline"))
        last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
