"""Registered queries: prompts, training-set construction, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.functions.hashing import hash32, hash32_sql
from escalade.functions.ordinals import global_ordinals
from escalade.operators import datasets as D
from escalade.operators import prompts as P
from escalade.operators.reports import label_distribution
from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx
from escalade.sources.tables import load

RP = ["response_pairs"]


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _p1_sql(seed: int = 0) -> str:
    flat, offsets, lengths = P._flat_templates()
    cat = f"({hash32_sql('doc_id', seed)} % 4)"
    within = f"({hash32_sql('doc_id', seed + 1)} % {_list_int(lengths)}[{cat} + 1])"
    tpl = f"{_list(flat)}[{_list_int(offsets)}[{cat} + 1] + {within} + 1]"
    a_idx = f"({hash32_sql('doc_id', seed + 2)} % 8)"
    b_idx = f"(({a_idx} + 1 + {hash32_sql('doc_id', seed + 3)} % 7) % 8)"
    concept = f"{_list(P.CONCEPTS)}[{a_idx} + 1]"
    task = f"{_list(P.TASKS)}[({hash32_sql('doc_id', seed + 2)} % 6) + 1]"
    item_b = f"{_list(P.CONCEPTS)}[{b_idx} + 1]"
    err = "'" + P.ERROR_TEXT.replace("'", "''") + "'"
    prompt = tpl
    for ph, val in (("{concept}", concept), ("{task}", task), ("{item_a}", concept), ("{item_b}", item_b),
                    ("{error}", err)):
        prompt = f"replace({prompt}, '{ph}', {val})"
    return f"select doc_id as ord, {_list(P.CATEGORIES)}[{cat} + 1] as category, {prompt} as prompt from documents"


def _list_int(values) -> str:
    return "[" + ", ".join(str(int(v)) for v in values) + "]"


@register("P1_generate_prompts", _p1_sql(0))
def p1(spark, sf):
    return P.generate_prompts(load(spark, sf, "documents").select("doc_id"), "doc_id", seed=0)


@register("S2_load_prompts", "select doc_id as ord, text as prompt from documents")
def s2(spark, sf):
    return P.load_prompts(load(spark, sf, "documents"), "text", None, order_by="doc_id")


@register("L1_head_n", "select doc_id as ord, text as prompt from documents order by doc_id limit 100")
def l1(spark, sf):
    return P.load_prompts(load(spark, sf, "documents"), "text", 100, order_by="doc_id")


@register("P2_drop_failed", with_views(["collected"], """
select pair_id, prompt, weak_response, strong_response from collected where error is null"""))
def p2(spark, sf):
    return D.drop_failed(fx.collected(spark, sf))


@register("P2_failed", with_views(["collected"], """
select pair_id, substr(prompt, 1, 50) as prompt_head, error from collected where error is not null"""))
def p2_failed(spark, sf):
    return D.failed(fx.collected(spark, sf))


_F3 = r"""case when length(coalesce(weak_response, '')) < 50 then 0
            when len(W) = 0 then 0
            when len(list_intersect(W, S)) / len(W) > 7e-1 then 1 else 0 end"""
_WS_CTE = r"""select *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(weak_response, '')), '\s+'), lambda t: t <> '')) as W,
       list_distinct(list_filter(regexp_split_to_array(lower(coalesce(strong_response, '')), '\s+'), lambda t: t <> '')) as S
from response_pairs"""


@register("P3_adequacy_dataset", with_views(RP, f"""
select pair_id, prompt, weak_response, ({_F3})::bigint as label from ws""", extra=[("ws", _WS_CTE)]))
def p3(spark, sf):
    return rounded(D.adequacy_dataset(fx.response_pairs(spark, sf), "heuristic", keep=("pair_id",)))


@register("P3_adequacy_manual", with_views(RP, """
select pair_id, prompt, weak_response, 0::bigint as label from response_pairs"""))
def p3_manual(spark, sf):
    return rounded(D.adequacy_dataset(fx.response_pairs(spark, sf), "manual", keep=("pair_id",)))


@register("P4_pairwise_dataset", with_views(RP, """
select pair_id, prompt, weak_response as response_a, strong_response as response_b, 'b' as preference
from response_pairs"""))
def p4(spark, sf):
    return D.pairwise_dataset(fx.response_pairs(spark, sf), keep=("pair_id",))


@register("P5_to_adequacy_samples", with_views(RP, f"""
select pair_id, prompt, weak_response as response, ({_F3})::double as label from ws""", extra=[("ws", _WS_CTE)]))
def p5(spark, sf):
    ad = D.adequacy_dataset(fx.response_pairs(spark, sf), "heuristic", keep=("pair_id",))
    return D.to_adequacy_samples(ad, keep=("pair_id",))


@register("P7_orient_pairs", with_views(RP, """
select pair_id, prompt, strong_response as response_preferred, weak_response as response_non_preferred
from response_pairs"""))
def p7(spark, sf):
    return D.orient_pairs(D.pairwise_dataset(fx.response_pairs(spark, sf), keep=("pair_id",)), keep=("pair_id",))


@register("X1_combine_datasets", with_views(RP, f"""
select pair_id, 'adequacy' as type, 0::bigint as part, 2e0 as weight, prompt, weak_response as response,
       ({_F3})::double as label, null::varchar as response_preferred, null::varchar as response_non_preferred from ws
union all
select pair_id, 'pairwise', 1::bigint, 1e0, prompt, null, null, strong_response, weak_response from response_pairs""",
                                              extra=[("ws", _WS_CTE)]))
def x1(spark, sf):
    rp = fx.response_pairs(spark, sf)
    ad = D.to_adequacy_samples(D.adequacy_dataset(rp, "heuristic", keep=("pair_id",)), keep=("pair_id",))
    pw = D.orient_pairs(D.pairwise_dataset(rp, keep=("pair_id",)), keep=("pair_id",))
    return rounded(D.combine_datasets(ad, pw, adequacy_weight=2.0))


@register("A4_label_distribution", with_views(RP, f"""
select ({_F3})::bigint as label, count(*)::bigint as count from ws group by 1""", extra=[("ws", _WS_CTE)]))
def a4(spark, sf):
    ad = D.adequacy_dataset(fx.response_pairs(spark, sf), "heuristic")
    return rounded(label_distribution(ad, "label"))


_D1 = with_views(RP, """
select pair_id, prompt, weak_response, strong_response, (row_number() over (order by pair_id) - 1)::bigint as ord,
       case when row_number() over (order by pair_id) - 1 < cast(trunc(count(*) over () * 9e-1) as bigint)
            then 'train' else 'val' end as split
from response_pairs""")


@register("D1_prefix_split", _D1)
def d1(spark, sf):
    return D.prefix_split(fx.response_pairs(spark, sf), ["pair_id"], 0.9)


@register("D2_random_split_exact", with_views(RP, f"""
select pair_id, prompt, weak_response, strong_response,
       case when row_number() over (order by {hash32_sql('pair_id', 42)}, pair_id) - 1
                 < cast(trunc(count(*) over () * 9e-1) as bigint) then 'train' else 'val' end as split
from response_pairs"""))
def d2(spark, sf):
    return D.random_split_exact(fx.response_pairs(spark, sf), "pair_id", 0.9, seed=42)


@register("D3_shuffle_epochs", with_views(RP, f"""
select pair_id, prompt, weak_response, strong_response, 0::bigint as epoch, (row_number() over (order by {hash32_sql('pair_id', 42 * 1009)}, pair_id) - 1)::bigint as pos
from response_pairs
union all
select pair_id, prompt, weak_response, strong_response, 1, (row_number() over (order by {hash32_sql('pair_id', 42 * 1009 + 1)}, pair_id) - 1)::bigint
from response_pairs"""))
def d3(spark, sf):
    rp = fx.response_pairs(spark, sf)
    parts = []
    for epoch in (0, 1):
        o = global_ordinals(rp, [hash32(F.col("pair_id"), 42 * 1009 + epoch), F.col("pair_id")], name="pos")
        parts.append(o.select(*rp.columns, F.lit(epoch).cast("bigint").alias("epoch"), "pos"))
    return parts[0].unionByName(parts[1])


@register("D4_assign_batches", with_views(RP, """
select pair_id, prompt, weak_response, strong_response, (row_number() over (order by pair_id) - 1)::bigint as ord,
       ((row_number() over (order by pair_id) - 1) // 16)::bigint as batch_id
from response_pairs"""))
def d4(spark, sf):
    return D.assign_batches(fx.response_pairs(spark, sf), ["pair_id"], 16)


@register("D5_collate", with_views(RP, """
select batch_id, count(*)::bigint as batch_rows, string_agg(pair_id::varchar, ',' order by pair_id) as pair_ids,
       string_agg(prompt, chr(30) order by pair_id) as prompts, string_agg(weak_response, chr(30) order by pair_id) as responses
from (select *, (row_number() over (order by pair_id) - 1) // 32 as batch_id from response_pairs) b
group by batch_id"""))
def d5(spark, sf):
    """Whole batches: their ids and texts in row order."""
    rows = fx.response_pairs(spark, sf).select("pair_id", "prompt", "weak_response")
    c = D.collate(D.assign_batches(rows, ["pair_id"], 32), ["pair_id", "prompt", "weak_response"])
    return c.select("batch_id", F.col("batch_rows").cast("bigint").alias("batch_rows"),
                    F.array_join(F.transform("pair_id", lambda x: x.cast("string")), ",").alias("pair_ids"),
                    F.array_join("prompt", chr(30)).alias("prompts"), F.array_join("weak_response", chr(30)).alias("responses"))


@register("A22_dataset_sizes", with_views(RP, """
select kind, split, count(*)::bigint as rows
from (select case when row_number() over (order by pair_id) - 1 < cast(trunc(count(*) over () * 9e-1) as bigint)
                  then 'train' else 'val' end as split from response_pairs) s
cross join (select 'adequacy' as kind union all select 'pairwise') k
group by kind, split"""))
def a22(spark, sf):
    rp = fx.response_pairs(spark, sf)
    ad = D.adequacy_dataset(rp, keep=("pair_id",)).withColumn("kind", F.lit("adequacy"))
    pw = D.pairwise_dataset(rp, keep=("pair_id",)).withColumn("kind", F.lit("pairwise"))
    # the sets as they are written: split with all their columns, then counted
    both = D.prefix_split(ad, ["pair_id"], 0.9).unionByName(D.prefix_split(pw, ["pair_id"], 0.9), allowMissingColumns=True)
    return D.dataset_sizes(both)


@register("P6_manual_labels", with_views(RP, """
select pair_id, prompt, weak_response, strong_response, case when pair_id % 3 = 0 then (length(prompt) % 2) else 0 end::bigint as label
from response_pairs"""))
def p6(spark, sf):
    """Human labels where there are any (here every third pair has one), zero elsewhere."""
    pairs = fx.response_pairs(spark, sf)
    said = pairs.where(F.col("pair_id") % 3 == 0).select("pair_id", (F.length("prompt") % 2).alias("label"))
    return rounded(D.manual_labels(pairs, said))
