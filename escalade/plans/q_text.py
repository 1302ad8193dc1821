"""Registered queries: text functions (F1-F5, F11, F16) over conversations and response pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions import text as X
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx
from escalade.sources.tables import load

RP = ["response_pairs"]


def _toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda t: t <> '')"


def _wset(x: str) -> str:
    return f"list_distinct({_toks(f'lower({x})')})"


_F1_SQL = """
select conv_id as request_id, p as prompt,
       case when coalesce(length(p), 0) = 0 then 'no_user_message' end as error
from (select conv_id, arg_max(text, turn) filter (where role = 'user') as p from conversations group by conv_id) t"""


@register("F1_last_user_message", _F1_SQL)
def f1(spark, sf):
    conv = load(spark, sf, "conversations")
    return X.last_user_message_flat(conv, "conv_id", "turn").withColumnRenamed("conv_id", "request_id")


@register("F1_last_user_message_array", _F1_SQL)
def f1_array(spark, sf):
    req = fx.chat_requests(spark, sf, with_messages=True)
    p = X.last_user_message("messages")
    return req.select("request_id", p.alias("prompt"),
                      F.when(F.coalesce(F.length(p), F.lit(0)) == 0, F.lit("no_user_message")).alias("error"))


@register("F2_token_usage", with_views(RP, f"""
select pair_id, len({_toks('prompt')})::bigint as prompt_tokens,
       len({_toks('weak_response')})::bigint as completion_tokens,
       (len({_toks('prompt')}) + len({_toks('weak_response')}))::bigint as total_tokens
from response_pairs"""))
def f2(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return rp.select("pair_id", X.token_usage("prompt", "weak_response").alias("u")).select("pair_id", "u.*")


@register("F3_adequacy_label", with_views(RP, f"""
select pair_id,
       case when length(coalesce(weak_response, '')) < 50 then 0
            when len({_wset('weak_response')}) = 0 then 0
            when len(list_intersect({_wset('weak_response')}, {_wset('strong_response')})) / len({_wset('weak_response')}) > 7e-1 then 1
            else 0 end::bigint as label
from response_pairs"""))
def f3(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return rounded(rp.select("pair_id", X.adequacy_label("weak_response", "strong_response").alias("label")))


@register("F4_word_containment", with_views(RP, f"""
select pair_id,
       round(case when len({_wset('weak_response')}) = 0 then null
             else len(list_intersect({_wset('weak_response')}, {_wset('strong_response')})) / len({_wset('weak_response')}) end, 6)
         as containment
from response_pairs"""))
def f4(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return rounded(rp.select("pair_id", X.word_containment("weak_response", "strong_response").alias("containment")))


@register("F5_char_length", with_views(RP, """
select pair_id, length(prompt)::bigint as prompt_chars, length(weak_response)::bigint as weak_chars,
       length(strong_response)::bigint as strong_chars
from response_pairs"""))
def f5(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return rp.select("pair_id", X.char_length("prompt").alias("prompt_chars"),
                     X.char_length("weak_response").alias("weak_chars"),
                     X.char_length("strong_response").alias("strong_chars"))


def _encode_sql(max_length: int) -> str:
    b = max_length - 3
    hi, lo = (b + 1) // 2, b // 2
    return with_views(RP, f"""
select pair_id, ka::bigint as n_prompt, kb::bigint as n_response,
       array_to_string(list_concat(['[CLS]'], list_slice(p, 1, ka), ['[SEP]'], list_slice(r, 1, kb), ['[SEP]'],
                                   list_transform(range({b} - ka - kb), lambda x: '[PAD]')), ' ') as tokens,
       repeat('1', ka + kb + 3) || repeat('0', {b} - ka - kb) as attention_mask
from (select *,
             (case when la + lb <= {b} then la when la <= {hi} then la when lb <= {lo} then {b} - lb else {hi} end)::int as ka,
             (case when la + lb <= {b} then lb when la <= {hi} then {b} - la when lb <= {lo} then lb else {lo} end)::int as kb
      from (select *, len(p) as la, len(r) as lb
            from (select pair_id, {_toks('prompt')} as p, {_toks('strong_response')} as r from response_pairs) t) a) b""")


def _encode(spark, sf, max_length):
    """Every token and the whole mask."""
    rp = fx.response_pairs(spark, sf)
    e = rp.select("pair_id", X.encode_pair("prompt", "strong_response", max_length).alias("e"))
    return rounded(e.select("pair_id", F.col("e.n_prompt").alias("n_prompt"), F.col("e.n_response").alias("n_response"),
                            F.array_join("e.tokens", " ").alias("tokens"),
                            F.array_join(F.transform("e.attention_mask", lambda m: m.cast("string")), "").alias("attention_mask")))


@register("F11_encode_pair", _encode_sql(512))
def f11(spark, sf):
    return _encode(spark, sf, 512)


@register("F11_encode_pair_truncating", _encode_sql(64))
def f11_short(spark, sf):
    return _encode(spark, sf, 64)


@register("F16_assemble_messages", """
select conv_id as request_id, count(*)::bigint as n_messages,
       string_agg(role || chr(31) || text, chr(30) order by turn) as messages
from conversations group by conv_id""")
def f16(spark, sf):
    """All messages in order, with roles and contents."""
    m = X.assemble_messages(load(spark, sf, "conversations"), "conv_id", "turn")
    return m.select(F.col("conv_id").alias("request_id"), F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(chr(31)), x["content"])), chr(30)).alias("messages"))


@register("X2_word_set_intersection", with_views(RP, f"""
select pair_id, len({_wset('weak_response')})::bigint as n_a, len({_wset('strong_response')})::bigint as n_b,
       len(list_intersect({_wset('weak_response')}, {_wset('strong_response')}))::bigint as n_common
from response_pairs"""))
def x2(spark, sf):
    rp = fx.response_pairs(spark, sf)
    return rp.select("pair_id", X.word_set_overlap("weak_response", "strong_response").alias("o")).select("pair_id", "o.*")
