"""DuckDB text of the fixture views (FIXTURES.md §3), composed as CTEs in front of each oracle query.

The driver registers only the raw tables as views, so every oracle string carries the derived views it needs
in a WITH clause; :func:`with_views` resolves the dependencies in order.
"""

from __future__ import annotations

K = "cast(json_extract_string(props, '$.k') as int)"
TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "collected": ((), """
select pair_id, prompt,
       case when pair_id % 17 = 0 then '' else weak end as weak_response,
       case when pair_id % 17 = 0 then '' else strong end as strong_response,
       case when pair_id % 17 = 0 then 'timeout' end as error
from (select conv_id * 4294967296 + turn as pair_id, text as prompt, ntext as strong,
             case (conv_id + turn) % 3
               when 0 then substr(ntext, 1, cast(floor(length(ntext) * 8e-1) as int))
               when 1 then substr(ntext, 1, 40)
               else text end as weak
      from (select conv_id, turn, role, text,
                   lead(role) over (partition by conv_id order by turn) as nrole,
                   lead(text) over (partition by conv_id order by turn) as ntext
            from conversations) t
      where role = 'user' and nrole = 'assistant') p"""),
    "response_pairs": (("collected",), """
select pair_id, prompt, weak_response, strong_response from collected where error is null"""),
    "chat_requests": ((), """
select conv_id as request_id, 'smart-router' as model,
       (conv_id % 25) / 1e1 as temperature, 1e0 as top_p,
       cast(case when conv_id % 9 = 0 then 0 else 256 end as int) as max_tokens,
       false as stream,
       case conv_id % 10 when 0 then 'weak' when 1 then 'strong' when 2 then 'medium' end as force_model,
       conv_id % 7 = 0 as disable_evaluator
from (select distinct conv_id from conversations) c"""),
    "routing_results": ((), f"""
select request_id, ts, model_used, k, weak_input, weak_output, strong_input, strong_output,
       (weak_input * 5e-1 + weak_output * 15e-1 + strong_input * 1e1 + strong_output * 3e1) / 1e6 as cost_usd,
       value * 2e1 as latency_ms,
       case model_used when 'weak' then (60 + 4e-1 * k) / 1e2 when 'weak_then_strong' then 6e-1 * k / 1e2 end as weak_quality_score,
       case when model_used = 'strong' then (100 + k) / 2e2 else k / 2e2 end as routing_score,
       concat(event_type, repeat(' w', k)) as response
from (select *,
             case when model_used = 'strong' then 0 else 100 + k end as weak_input,
             case when model_used = 'strong' then 0 else 200 + 2 * k end as weak_output,
             case when model_used = 'weak' then 0 else 100 + k end as strong_input,
             case when model_used = 'weak' then 0 else 300 + 3 * k end as strong_output
      from (select event_id as request_id, cast(ts as timestamp) as ts, value, event_type,
                   case event_type when 'purchase' then 'strong' when 'error' then 'weak_then_strong' else 'weak' end as model_used,
                   {K} as k
            from events) a) b"""),
    "scored": ((), """
select doc_id, (n_chars % 100) / 99e0 as pred, quality as label from documents join labels using (doc_id)"""),
    "scored_pairs": (("response_pairs",), """
select pair_id, (length(strong_response) % 100) / 99e0 as score_preferred,
       (length(weak_response) % 100) / 99e0 as score_non_preferred
from response_pairs"""),
    "train_history": (("routing_results",), """
select k as epoch, round(avg(latency_ms), 6) as val_loss from routing_results group by k"""),
    "prices": ((), """
select 'weak' as model, 5e-1 as input_per_m, 15e-1 as output_per_m
union all select 'strong', 1e1, 3e1"""),
    "hidden_states": ((), """
select id, pos, cast(dim as bigint) as dim, cast(v as double) as v, mask
from (select label as id, vec_id as pos, case when vec_id % 5 = 0 then 0 else 1 end as mask,
             unnest(range(len(embedding))) as dim, unnest(embedding) as v from embeddings) e"""),
    "battles": ((), """
select vec_id as battle_id, embedding, case when label < 5 then 1 else 0 end as strong_wins
from embeddings where vec_id % 10 <> 0"""),
    "queries": ((), """
select vec_id as query_id, embedding from embeddings where vec_id % 10 = 0"""),
    "chunks": ((), f"""
select id, cast(seq as bigint) as seq, concat(word, ' ') as content, case when seq = 0 then 'assistant' end as role
from (select id, unnest(range(len(tokens))) as seq, unnest(tokens) as word
      from (select conv_id * 4294967296 + turn as id, {TOKENS} as tokens from conversations where role = 'assistant') a) b"""),
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views: list[str] | tuple[str, ...], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH v1 AS (...), v2 AS (...), <extra ctes> <body>``."""
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(list(views))]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in (extra or [])]
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
