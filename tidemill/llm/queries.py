"""The registered queries of this subpackage, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.session import ensure_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemill.llm import byte_bpe

    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def fold(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 p (chosen) and 2 p + 1 (rejected) as pairs; masks as start-end of the characters they count, by commas."""
    from tidemill.llm import preference

    out = preference.adjacent(table(spark, sf_dir, "conversations"))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", flat("chosen_spans").alias("chosen_mask"), flat("rejected_spans").alias("rejected_mask"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemill.llm import token_count

    return token_count.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"), learn=fold(3) != 1)


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import mtree

    return mtree.search(table(spark, sf_dir, "embeddings"), every=50, top=5)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import multi_index

    return multi_index.search(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=fold(5) != 0, threshold=0.3)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import source_mix

    return source_mix.mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import ngram_join

    return ngram_join.link(table(spark, sf_dir, "documents"), k=5, threshold=80)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import substring_dedup

    return substring_dedup.dedup(table(spark, sf_dir, "documents"), window=20, digests=True)


QUERIES = {"op1_preference": op1_preference, "op6_token_count": op6_token_count, "op2_language_id": op2_language_id, "op3_mtree": op3_mtree, "op4_quality": op4_quality, "op8_multi_index": op8_multi_index, "op7_substring_dedup": op7_substring_dedup, "op9_ngram_join": op9_ngram_join, "op5_source_mix": op5_source_mix, "op10_byte_bpe": op10_byte_bpe}
#: The words of each document, in order (DuckDB has no lower() for A-Z alone, hence translate).
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLE: dict[str, str] = {
    "op9_ngram_join": f"""
with recursive docs as (select doc_id, {_FOLDED} as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes sa on sa.doc_id = a.doc_id join sizes sb on sb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, sa.n, sb.n
  having 100 * count(*) >= 80 * (sa.n + sb.n - count(*))
),
reach as (select doc_id as a, doc_id as b from docs union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.b) as component_id
from docs d left join sizes s on s.doc_id = d.doc_id join reach r on r.a = d.doc_id
group by d.doc_id, s.n
""",
    "op7_substring_dedup": f"""
with docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from docs where len(w) >= 20)),
ranked as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as r from windows),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from ranked where r > 1),
lost as (select doc_id, list(j) as js, count(*) as n from gone group by doc_id),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as j from docs where len(w) > 0),
left_ as (select words.doc_id, string_agg(x, ' ' order by words.j) as t from words anti join gone on gone.doc_id = words.doc_id and gone.j = words.j group by words.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(l.n, 0)::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from docs d left join lost l on l.doc_id = d.doc_id left join left_ k on k.doc_id = d.doc_id
""",
    "op3_mtree": """
with vecs as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from vecs q join vecs c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5
""",
    "op1_preference": r"""
with t as (
  select conv_id >> 1 as pair_id, conv_id % 2 as side, turn, role, text, row_number() over (partition by conv_id order by turn, role, text) as i,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) as r
  from conversations where conv_id is not null
),
placed as (
  select *, coalesce(sum(length(r)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0)::bigint as pos from t
),
pairs as (select pair_id, max(case when side = 0 then i end) as na, max(case when side = 1 then i end) as nb from t group by pair_id having na is not null and nb is not null),
differ as (select a.pair_id, min(a.i) as i from t a join t b on a.pair_id = b.pair_id and a.i = b.i and a.side = 0 and b.side = 1 where a.role is distinct from b.role or a.text is distinct from b.text group by a.pair_id),
cut as (select p.pair_id, coalesce(d.i - 1, least(na, nb)) as n from pairs p left join differ d using (pair_id))
select c.pair_id, c.n::int as prompt_turns,
  coalesce(string_agg(case when side = 0 and i <= n then r end, '' order by i), '') as prompt,
  coalesce(string_agg(case when side = 0 and i > n then r end, '' order by i), '') as chosen,
  coalesce(string_agg(case when side = 1 and i > n then r end, '' order by i), '') as rejected,
  coalesce(string_agg(case when side = 0 and i > n and role = 'assistant' then (pos + 14)::varchar || '-' || (pos + length(r))::varchar end, ',' order by i), '') as chosen_mask,
  coalesce(string_agg(case when side = 1 and i > n and role = 'assistant' then (pos + 14)::varchar || '-' || (pos + length(r))::varchar end, ',' order by i), '') as rejected_mask
from cut c join placed using (pair_id) group by c.pair_id, c.n
""",
}
