"""Registered queries: score functions, pooling and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions import scores as S
from escalade.operators import datasets as D
from escalade.operators import losses as L
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx

SP = ["scored_pairs"]


@register("F6_compare_responses", with_views(SP, """
select pair_id, case when score_preferred > score_non_preferred then 'a' else 'b' end as preferred,
       round(abs(score_preferred - score_non_preferred), 6) as confidence
from scored_pairs"""))
def f6(spark, sf):
    s = fx.scored_pairs(spark, sf).select("pair_id", S.compare_responses("score_preferred", "score_non_preferred")
                                          .alias("c"))
    return rounded(s.select("pair_id", "c.preferred", "c.confidence"))


@register("F7_preference_probability", with_views(SP, """
select pair_id, round(1e0 / (1e0 + exp(score_non_preferred - score_preferred)), 6) as p_ab,
       round(1e0 / (1e0 + exp(score_preferred - score_non_preferred)), 6) as p_ba
from scored_pairs"""))
def f7(spark, sf):
    s = fx.scored_pairs(spark, sf)
    return rounded(s.select("pair_id", S.preference_probability("score_preferred", "score_non_preferred").alias("p_ab"),
                            S.preference_probability("score_non_preferred", "score_preferred").alias("p_ba")))


@register("F13_binary_prediction", with_views(["scored"], """
select doc_id, case when pred > 5e-1 then 1e0 else 0e0 end as prediction from scored"""))
def f13(spark, sf):
    return fx.scored(spark, sf).select("doc_id", S.binary_prediction("pred").alias("prediction"))


_POOL_SQL = {
    "cls": "arg_min(v, pos)",
    "mean": "sum(v * mask) / greatest(sum(mask), 1e-9)",
    "max": "max(case when mask = 0 then -1e9 else v end)",
}
for _strategy, _agg in _POOL_SQL.items():
    def _make(strategy):
        def build(spark, sf):
            return rounded(S.pool_hidden_states(fx.hidden_states(spark, sf), strategy))
        return build
    register(f"F12_pool_{_strategy}", with_views(["hidden_states"], f"""
select id::bigint as id, dim, round({_agg}, 6) as pooled from hidden_states group by id, dim"""))(_make(_strategy))


_BCE = ("w * -(label * greatest(ln(pred), -1e2) + (1 - label) * greatest(ln(1e0 - pred), -1e2))")


@register("A17_weighted_bce", with_views(["scored"], f"""
select round(avg({_BCE}), 6) as loss, count(*)::bigint as n
from (select *, case when label = 1 then 2e0 else 1e0 end as w from scored where pred is not null) s"""))
def a17(spark, sf):
    return rounded(L.weighted_bce(fx.scored(spark, sf), "pred", "label", pos_weight=2.0))


_BT = "ln(1e0 + exp(-abs(d))) + greatest(-d, 0e0)"


@register("A18_bradley_terry_loss", with_views(SP, f"""
select round(avg({_BT}), 6) as loss, count(*)::bigint as n
from (select score_preferred - score_non_preferred - 25e-2 as d from scored_pairs) s"""))
def a18(spark, sf):
    return rounded(L.bradley_terry_loss(fx.scored_pairs(spark, sf), margin=0.25))


@register("A19_margin_ranking_loss", with_views(SP, """
select round(avg(greatest(1e-1 - (score_preferred - score_non_preferred), 0e0)), 6) as loss, count(*)::bigint as n
from scored_pairs"""))
def a19(spark, sf):
    return rounded(L.margin_ranking_loss(fx.scored_pairs(spark, sf), margin=0.1))


@register("A20_combined_loss", with_views(["scored", "scored_pairs"], f"""
select round(1e0 * a + 5e-1 * p, 6) as total_loss, round(a, 6) as adequacy_loss, round(p, 6) as pairwise_loss
from (select avg({_BCE}) as a from (select *, 1e0 as w from scored where pred is not null) s) x,
     (select avg({_BT}) as p from (select score_preferred - score_non_preferred as d from scored_pairs) t) y"""))
def a20(spark, sf):
    return rounded(L.combined_loss(fx.scored(spark, sf), fx.scored_pairs(spark, sf), wa=1.0, wp=0.5))


@register("A21_binary_metrics", with_views(["scored"], f"""
select round(avg({_BCE}), 6) as loss, round(avg(case when (case when pred > 5e-1 then 1e0 else 0e0 end) = label
                                                then 1e0 else 0e0 end), 6) as accuracy, count(*)::bigint as n
from (select *, 1e0 as w from scored where pred is not null) s"""))
def a21(spark, sf):
    return rounded(L.binary_metrics(fx.scored(spark, sf)))


@register("A21_binary_metrics_batched", with_views(["scored"], f"""
select round(avg(l), 6) as loss, round(avg(c), 6) as accuracy, count(*)::bigint as n
from (select b, avg({_BCE}) as l,
             avg(case when (case when pred > 5e-1 then 1e0 else 0e0 end) = label then 1e0 else 0e0 end) as c
      from (select *, 1e0 as w, (row_number() over (order by doc_id) - 1) // 16 as b from scored) s
      group by b) t"""))
def a21_batched(spark, sf):
    b = D.assign_batches(fx.scored(spark, sf), ["doc_id"], 16)
    return rounded(L.binary_metrics(b, batch="batch_id"))


def _sequences(spark, sf):
    """Token sequences as the encoder takes them (F11: 512 places, mask 0 on padding), each token with a vector of three numbers."""
    from escalade.functions.text import encode_pair
    e = fx.response_pairs(spark, sf).select("pair_id", encode_pair("prompt", "strong_response", 512).alias("e"))
    vectors = F.transform("e.tokens", lambda t, i: F.array(F.length(t).cast("double"), F.ascii(t).cast("double"), ((i * 7) % 11).cast("double")))
    return e.select("pair_id", vectors.alias("hidden"), F.col("e.attention_mask").alias("mask"))


def _pooled_sql(agg: str) -> str:
    from escalade.plans.q_text import _encode_sql
    return f"""
with coded as ({_encode_sql(512)}),
places as (select pair_id, unnest(range(512)) as pos, unnest(string_split(tokens, ' ')) as t, unnest(string_split(attention_mask, ''))::int as mask from coded),
hidden as (select pair_id, pos, mask, unnest([0, 1, 2]) as dim, unnest([length(t), ascii(t), (pos * 7) % 11])::double as v from places)
select pair_id, dim::bigint as dim, round({agg}, 6) as pooled from hidden group by pair_id, dim"""


for _strategy, _agg in _POOL_SQL.items():
    def _make_arr(strategy):
        def build(spark, sf):
            p = _sequences(spark, sf).select("pair_id", F.posexplode(S.pool_arrays("hidden", "mask", strategy)).alias("dim", "pooled"))
            return rounded(p.select("pair_id", F.col("dim").cast("bigint").alias("dim"), "pooled"))
        return build
    register(f"F12_pool_{_strategy}_array", _pooled_sql(_agg))(_make_arr(_strategy))
