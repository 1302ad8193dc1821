"""Registered queries: readers and table profiling (S1, S7, S8). Writers (S3, S4, S9) are covered by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from escalade.plans.catalog import register, rounded
from escalade.plans.oracle_views import with_views
from escalade.sources import fixtures as fx
from escalade.sources import io as IO
from escalade.sources.tables import load

EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@register("S1_read_table", "select doc_id, text, lang, source, n_chars from documents")
def s1(spark, sf):
    return IO.read_table(spark, f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@register("S1_read_csv_split", "select doc_id, text, source from documents where text is not null and doc_id is not null")
def s1_csv(spark, sf):
    """Documents (quotes, line breaks and all) written as CSV and read back in parallel, records cut by quote parity."""
    from escalade.session import scratch_path
    path = scratch_path(spark, "documents") + ".csv"
    docs = load(spark, sf, "documents").where("text is not null and doc_id is not null")
    IO.write_table(docs.select("doc_id", "text", "source"), path)
    return IO.read_table(spark, path, docs.select("doc_id", "text", "source").schema)


@register("S7_normalize_routing_results", with_views(["routing_results"], """
select request_id, weak_input::bigint as weak_input, weak_output::bigint as weak_output,
       strong_input::bigint as strong_input, strong_output::bigint as strong_output,
       round(cost_usd, 9) as cost_usd, round(weak_quality_score, 6) as weak_quality_score
from routing_results"""))
def s7(spark, sf):
    n = IO.normalize_routing_results(fx.routing_results(spark, sf))
    return rounded(n.select("request_id", *[F.col(f"tokens_used.{f}").alias(f) for f in IO.TOKEN_FIELDS],
                            "cost_usd", "weak_quality_score"), ("cost_usd",))


@register("S8_profile_table", " union all ".join(
    f"select {i}::bigint as position, '{c}' as column, count(*)::bigint as n_rows, "
    f"(count(*) - count({c}))::bigint as n_null from events" for i, c in enumerate(EVENT_COLUMNS)))
def s8(spark, sf):
    p = IO.profile_table(load(spark, sf, "events").select(*EVENT_COLUMNS))
    return rounded(p.select("position", "column", "n_rows", "n_null"))


# ---------------------------------------------------------------- write -> read round trips (derived data only)

def _rp_datasets(spark, sf):
    from escalade.operators import datasets as D
    rp = fx.response_pairs(spark, sf)
    return D.adequacy_dataset(rp), D.pairwise_dataset(rp)


_LABEL = """case when length(coalesce(weak_response, '')) < 50 then 0 when len(W) = 0 then 0
             when len(list_intersect(W, S)) / len(W) > 7e-1 then 1 else 0 end"""
_WS = r"""
select *, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(weak_response, '')), '\s+'), lambda t: t <> '')) as W,
       list_distinct(list_filter(regexp_split_to_array(lower(coalesce(strong_response, '')), '\s+'), lambda t: t <> '')) as S
from response_pairs"""
_P5_NO_KEY = with_views(["response_pairs"], f"select prompt, weak_response as response, ({_LABEL})::double as label from ws", extra=[("ws", _WS)])


@register("S3_S5_adequacy_csv_round_trip", _P5_NO_KEY)
def s3_s5(spark, sf):
    """S3 writes the adequacy set as CSV (quoted, multi-line texts), S5 reads it back typed as samples."""
    from escalade.session import scratch_path
    ad, _ = _rp_datasets(spark, sf)
    path = scratch_path(spark, "adequacy") + ".csv"
    IO.write_table(ad, path)
    return IO.read_adequacy(spark, path)


@register("S3_S6_pairwise_jsonl_round_trip", with_views(["response_pairs"], """
select prompt, strong_response as response_preferred, weak_response as response_non_preferred from response_pairs"""))
def s3_s6(spark, sf):
    """S3 writes the pairwise set as JSON Lines, S6 reads it back oriented."""
    from escalade.session import scratch_path
    _, pw = _rp_datasets(spark, sf)
    path = scratch_path(spark, "pairwise") + ".jsonl"
    IO.write_table(pw, path)
    return IO.read_pairwise(spark, path)


@register("S4_write_datasets", with_views(["response_pairs"], rf"""
select s.pair_id, kind, split, prompt, weak_response as response, case when kind = 'pairwise' then strong_response end as other,
       case when kind = 'adequacy' then label end::bigint as label
from (select w.*, case when row_number() over (order by pair_id) - 1 < cast(trunc(count(*) over () * 9e-1) as bigint)
                       then 'train' else 'val' end as split, {_LABEL} as label from ws w) s
cross join (select 'adequacy' as kind union all select 'pairwise') k""", extra=[("ws", _WS)]))
def s4(spark, sf):
    """Both datasets split (D1) and written partitioned by split; every row read back from the files."""
    from escalade.operators import datasets as D
    from escalade.session import scratch_path
    rp = fx.response_pairs(spark, sf)
    out = IO.write_datasets(D.adequacy_dataset(rp, keep=("pair_id",)), D.pairwise_dataset(rp, keep=("pair_id",)),
                            scratch_path(spark, "datasets"))
    ad, pw = spark.read.parquet(out["adequacy"]), spark.read.parquet(out["pairwise"])
    ad = ad.select("pair_id", F.lit("adequacy").alias("kind"), "split", "prompt", F.col("weak_response").alias("response"),
                   F.lit(None).cast("string").alias("other"), F.col("label").cast("bigint").alias("label"))
    pw = pw.select("pair_id", F.lit("pairwise").alias("kind"), "split", "prompt", F.col("response_a").alias("response"),
                   F.col("response_b").alias("other"), F.lit(None).cast("bigint").alias("label"))
    return ad.unionByName(pw)


@register("S8_sample_rows", "select event_id, event_type, value from events order by event_id limit 5")
def s8_sample(spark, sf):
    return IO.sample_rows(load(spark, sf, "events").select("event_id", "event_type", "value"), 5, ["event_id"])
