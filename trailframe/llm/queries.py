"""Registered queries of this subpackage, one ``opN_<name>`` per operator,
each over its whole table with production parameters, and the DuckDB SQL of
those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import (ann, chat, jaccard, langid, lexical, neardup, packing, pii, quality,
                            sentencepiece_codec, spelling, substring, token_counts)
from trailframe.llm.common import crc_mod, prepare, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.teaching(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chat.digests(chat.with_control_case(spark, table(spark, sf_dir, "conversations")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    spans, _ = pii.personal_data(table(spark, sf_dir, "documents"))
    return pii.digests(spans)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality, op2_near_duplicates, op3_token_counts, op4_sentencepiece, op5_chat_format, op6_language_id,
    op7_ngram_jaccard, op8_packing, op9_nearest, op10_substring_dedup, op11_personal_data,
    op12_ranked_search, op13_spelling_variants)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ESC = chat.CONTROL_BODIES.replace("'", "''")
SQL = {
    "op5_chat_format": rf"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
           union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(x, '([<\[])(\\*)({_ESC})', '\1\2\\\3', 'g') ex,
             regexp_replace(r, '([<\[])(\\*)({_ESC})', '\1\2\\\3', 'g') er,
             lag(r) over (partition by conv_id order by turn nulls first, r, x) pr,
             row_number() over (partition by conv_id order by turn nulls first, r, x) k from c)
select conv_id, count(*) n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by k)) turns_sha256,
  cast(coalesce(sum(length(x)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(x, '' order by k) filter (where r = 'assistant'), '')) loss_sha256,
  cast(sum(length(ex) + case when pr is distinct from r or k = 1 then {len(chat.TURN + chat.TEXT + chat.END)} + length(er)
           else {len(chat.PART)} end) as bigint) formatted_chars
from e group by conv_id""",
    "op12_ranked_search": f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, {_AZ}), '{_TERM}') t
           from documents where text is not null),
d2 as (select r, doc_id, t, cast(len(t) as bigint) n from d where len(t) > 0),
s as (select cast(count(*) as bigint) nd, cast(sum(n) as bigint) l from d2),
tf as (select r, term, cast(count(*) as bigint) tf from (select r, unnest(t) term from d2) group by all),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '{_TERM}')) term
      from benchmark where text is not null),
w as (select term, cast(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) as bigint) w
      from tf, s where term in (select term from q) group by term, nd),
p as (select item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) as bigint) score
      from q join w using (term) join tf using (term) join d2 using (r), s group by item_id, r),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) rank
      from p join d2 using (r) where score > 0)
select item_id, cast(rank as int) rank, doc_id, score from k where rank <= 50""",
}
