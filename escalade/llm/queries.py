"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.llm import block_ann, budget_mix, decontaminate, html_blocks, jaccard_join, license_scan, line_dedup, norm_topk, ordinal_quality, periodic_runs, ppm, prefix_trie, url_reputation
from escalade.llm.common import table, words_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------------------------------------------------------- 1

#: The rules of the contract.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules, else its host's reputation. A page shows the document whose number its
    path carries; that document's labels are the page's outcome (bad: low quality or toxic)."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.select(url_reputation.host_of(F.col("url")).alias("host"),
                         F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1)
                         .try_cast("bigint").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    outcomes = shown.join(labels, "doc_id").select("host", "bad")
    out = url_reputation.judge_urls(pages, outcomes, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "n", F.round("bad_rate", 6).alias("bad_rate"),
                      F.round("bad_bound", 6).alias("bad_bound"))


def _op1_sql() -> str:
    fits = lambda r: (lambda h, p: f"((host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}'))")(*r.split("/", 1))
    longest = sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for r, _ in longest)
    by_rule = " ".join(f"when rule = '{r}' then '{v}'" for r, v in URL_RULES)
    strength = lambda rows, parent: f"""(select 1 / greatest(least(coalesce(case when sum(base) > 0 then sum(top) / sum(base) end,
        {url_reputation.RHO_MIN}), {url_reputation.RHO_MAX}), {url_reputation.RHO_MIN}) - 1 from (
        select k2 - kk * kk / nn - r * (1 - r) * (m - 1) as top, r * (1 - r) * (nn - n2 / nn - (m - 1)) as base from (
          select count(*) m, sum(n)::double nn, sum(k)::double kk, sum(k * k / n) k2, sum(n * n)::double n2,
            sum(k) / sum(n) r from {rows} where n > 0 group by {parent})))"""  # noqa: E731
    two = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)
    return f"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
outcomes as (
  select p.host, case when l.quality = 0 or l.toxic = 1 then 1 else 0 end as bad
  from (select host, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) as bigint) doc_id from parts) p
  join labels l on l.doc_id = p.doc_id),
counted as (select host, sum(n)::bigint n, sum(k)::bigint k from (
  select distinct host, 0 n, 0 k from parts union all select host, 1, bad from outcomes) group by host),
bare as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as b from counted),
split as (select *, string_split(b, '.') as l, case when b = '' then false else regexp_matches(b, '^[0-9.]+$') end as ip from bare),
two as (select *, len(l) >= 2 and array_to_string(l[-2:], '.') in ({two}) as t from split),
hosts as (select host, n, k,
  case when ip then b when t then array_to_string(l[-2:], '.') else l[-1] end as suffix,
  case when ip or len(l) <= (case when t then 3 else 2 end) then b when t then array_to_string(l[-3:], '.')
    else array_to_string(l[-2:], '.') end as domain from two),
domains as (select suffix, domain, sum(n) n, sum(k) k from hosts group by all),
suffixes as (select suffix, sum(n) n, sum(k) k from domains group by all),
lev as (select sum(n) nn, sum(k) kk,
  {strength('(select *, 1 as one from suffixes)', 'one')} ms, {strength('domains', 'suffix')} md, {strength('hosts', 'domain')} mh
  from suffixes),
above as (select h.host, h.n, h.k, mh, md, d.n as dn, d.k as dk,
  (ms * case when nn > h.n then (kk - h.k) / (nn - h.n) else 0.1 end + s.k - h.k) / (ms + s.n - h.n) as sr
  from hosts h join domains d using (suffix, domain) join suffixes s using (suffix), lev),
h as (select host, n, k, mh * r + k as a, mh * (1 - r) + n - k as bb from (select *, (md * sr + dk - k) / (md + dn - n) as r from above)),
v as (select host, n, a / (a + bb) as bad_rate,
  a / (a + bb) - 1.645 * sqrt(a / (a + bb) * (1 - a / (a + bb)) / (a + bb + 1)) as bad_bound from h),
ruled as (select *, case {rule} end as rule from parts)
select page_id, host, path, rule,
  case {by_rule} when bad_bound > 0.5 then 'block' else 'allow' end as verdict,
  n::bigint as n, round(bad_rate, 6) as bad_rate, round(bad_bound, 6) as bad_bound
from ruled join v using (host)"""


ORACLES["op1_url_reputation"] = _op1_sql()


# ---------------------------------------------------------------------------------------------------------------- 2

@query
def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return budget_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# ---------------------------------------------------------------------------------------------------------------- 3

@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals, or nearly equals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLES["op3_line_dedup"] = r"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as line_no from documents where text is not null),
words as (select doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w != '') as w
  from lines),
firsts as (select w, len(w) as n, min((doc_id, line_no)) as pos from words
  where regexp_matches(line, '(?:[^\p{L}\p{N}]*[\p{L}\p{N}]){10}') group by w),
cut as (select pos, n, p, w, list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, n)) as v
  from (select *, unnest(range(1, n + 1)) as p from firsts where n >= 5) where not regexp_matches(w[p], '\p{N}')),
near as (
  select a.pos as pos from cut a join cut b on a.v = b.v and a.p = b.p and a.n = b.n and b.pos < a.pos
  union select a.pos from cut a join firsts b on a.v = b.w and b.n >= 5 and b.pos < a.pos
  union select b.pos from cut a join firsts b on a.v = b.w and b.n >= 5 and a.pos < b.pos),
judged as (select l.doc_id, l.line_no, l.line,
    f.pos is not null and ((l.doc_id, l.line_no) != f.pos or f.pos in (select pos from near)) as gone
  from words l left join firsts f on l.w = f.w)
select d.doc_id, coalesce(count(line_no), 0)::bigint as n_lines, coalesce(sum(gone::int), 0)::bigint as n_removed,
  case when any_value(d.text) is null then null else
    coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '') end as text
from documents d left join judged j on j.doc_id = d.doc_id group by d.doc_id"""


# ---------------------------------------------------------------------------------------------------------------- 4

@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, test item) with a substitution-tolerant overlap."""
    out = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", *[F.col(c).cast("bigint").alias(c) for c in ("item_tokens", "matched", "best_window", "start")])


# By another way than the query: 13 tokens with two replaced hold four equal ones in a row, so places with equal
# four-token runs are the candidates, and each diagonal is judged by the definition.
ORACLES["op4_decontaminate"] = r"""
with docs as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w != '') as d
  from documents where text is not null),
items as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w != '') as t
  from benchmark where text is not null),
dgrams as (select doc_id, d, i, d[i] || ' ' || d[i + 1] || ' ' || d[i + 2] || ' ' || d[i + 3] as g
  from (select *, unnest(range(1, len(d) - 2)) as i from docs where len(d) >= 5)),
igrams as (select item_id, t, j, t[j] || ' ' || t[j + 1] || ' ' || t[j + 2] || ' ' || t[j + 3] as g
  from (select *, unnest(range(1, len(t) - 2)) as j from items where len(t) >= 5)),
diagonals as (select distinct doc_id, d, item_id, t, i - j as start from dgrams join igrams using (g)),
cells as (select doc_id, item_id, start, len(t) as n, unnest(range(1, len(t) + 1)) as k,
    list_transform(range(1, len(t) + 1), lambda x: case when x + start >= 1 and d[x + start] = t[x] then 1 else 0 end) as eq
  from diagonals),
sums as (select doc_id, item_id, start, n, list_sum(eq) as matched,
    max(list_sum(list_slice(eq, k, k + least(n, 13) - 1))) as best_window
  from cells where k + least(n, 13) - 1 <= n group by all),
good as (select *, row_number() over (partition by doc_id, item_id order by matched desc, best_window desc, start, n desc) as r
  from sums where best_window >= case when n < 13 then n else 11 end)
select doc_id, item_id, n::bigint as item_tokens, matched::bigint as matched, best_window::bigint as best_window,
  start::bigint as start from good where r = 1"""


# ---------------------------------------------------------------------------------------------------------------- 5

@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.join_sets(table(spark, sf_dir, "documents"))


# By another way than the query: every pair with a common shingle is counted.
ORACLES["op5_jaccard_join"] = r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w != '') as w from documents),
shingles as (select distinct doc_id, s from (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from words)),
sizes as (select w.doc_id, count(s) as n from words w left join shingles s on s.doc_id = w.doc_id group by w.doc_id),
links as (select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id != b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(id, root) as (select doc_id, doc_id from documents union select l.b, r.root from reach r join links l on l.a = r.id and r.root < l.b)
select s.doc_id, s.n::bigint as n_shingles, min(root)::bigint as component_id from sizes s join reach r on r.id = s.doc_id group by s.doc_id, s.n"""


# ---------------------------------------------------------------------------------------------------------------- 6

def document_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings of the labelled documents: 2 good and not toxic, 1 one of the two, 0 neither."""
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


@query
def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability of the top grade and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    model = ordinal_quality.train(docs, document_grades(spark, sf_dir), grades=3)
    return ordinal_quality.score(docs, model, keep_grade=2)


# ---------------------------------------------------------------------------------------------------------------- 7

@query
def op7_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return block_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLES["op7_block_ann"] = """
with good as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x != 0)) > 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from good q join good c on q.vec_id % 20 = 0 and q.vec_id != c.vec_id and len(q.v) = len(c.v)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
  from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20"""


# ---------------------------------------------------------------------------------------------------------------- 8

@query
def op8_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


# ---------------------------------------------------------------------------------------------------------------- 9

@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------------------------------------------- 10

@query
def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the byte model and by unigrams, learned from four of five folds."""
    return ppm.score(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------------------------------------------- 11

@query
def op11_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20, on components floor(64 x)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", norm_topk.whole_numbers(F.col("embedding"), 64).alias("vec"))
    return norm_topk.top_products(rows, F.col("vec_id") % 20 == 0, k=20)


ORACLES["op11_norm_topk"] = """
with good as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from good q join good c on q.vec_id % 20 = 0 and q.vec_id != c.vec_id and len(q.v) = len(c.v)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
  from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20"""


# --------------------------------------------------------------------------------------------------------------- 12

def rebuilt_turns(turns, members):
    """The contract's conversations, from numbered turns and (conv, n) of every conversation: the first h turns of the first
    conversation of the hundred, then the own ones behind the first h."""
    h, base = (F.crc32(F.col("conv").cast("string")) % 6), F.col("conv") - F.col("conv") % 100
    heads = members.select(F.col("conv").alias("to"), h.alias("h"), base.alias("conv")).filter("h > 0")
    shared = turns.filter("pos <= 5").join(heads, "conv").filter("pos <= h").select(F.col("to").alias("conv"), "pos", "k1", "k2", "chars")
    # where the first of the hundred has fewer than h turns, the own ones move up
    short = (members.select("conv", h.alias("h"), base.alias("base"))
             .join(members.filter("n < 5").select(F.col("conv").alias("base"), "n"), "base", "left")
             .join(members.select(F.col("conv").alias("base"), F.lit(1).alias("is_there")), "base", "left")
             .select("conv", (F.col("h") - F.when(F.col("is_there").isNull(), 0).otherwise(F.least("h", F.coalesce("n", "h")))).alias("less"))
             .filter("less > 0"))
    own = turns.filter(F.col("pos") > h).join(short, "conv", "left").select(
        "conv", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "k1", "k2", "chars")
    return shared.unionByName(own)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with the totals of its subtree."""
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")).checkpoint()
    members = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    return prefix_trie.prefix_trie(rebuilt_turns(turns, members), members)


# By another way than the query: nodes are lists of turns, totals sum the distinct nodes on the paths of a node's members.
ORACLES["op12_prefix_trie"] = r"""
with base as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as l from conversations where conv_id is not null group by conv_id),
coded as (select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''),
    lambda c: [unicode(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, case when xor(a, x) & 1 = 1 then 3988292384::bigint else 0 end)), 4294967295::bigint) % 6 as h from base),
rebuilt as (select a.conv_id, list_concat(coalesce(list_slice(b.l, 1, a.h), []), list_slice(a.l, a.h + 1, len(a.l))) as l
  from coded a left join base b on b.conv_id = a.conv_id - a.conv_id % 100),
paths as (select conv_id, d, case when d = 0 then [] else list_slice(l, 1, d) end as p, len(l) as n
  from (select *, unnest(range(len(l) + 1)) as d from rebuilt)),
nodes as (select d, p, min(conv_id) as v, count(*) as n, (count(*) - 1) * coalesce(length(p[d].t), 0) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends
  from paths group by d, p),
up as (select a.*, b.v as pv from nodes a left join nodes b on b.d = a.d - 1 and b.p = list_slice(a.p, 1, a.d - 1)),
kids as (select pv as v, d - 1 as d, count(*) as c from up where d > 0 group by all),
named as (select q.conv_id, q.d, u.v, u.saved, coalesce(k.c, 0) as c from paths q join up u on u.d = q.d and u.p = q.p
  left join kids k on k.v = u.v and k.d = u.d),
below as (select distinct a.v, a.d, b.v as bv, b.d as bd, b.saved, b.c from named a join named b on a.conv_id = b.conv_id and a.d <= b.d),
total as (select v, d, count(*) filter (c = 0) as n_leaves, sum(saved) as saved from below group by v, d)
select u.v as conv_id, u.d::bigint as depth, u.pv as parent_conv_id, u.n::bigint as n_convs, coalesce(k.c, 0)::bigint as n_children,
  t.n_leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, u.ends as ends_sha256
from up u join total t on t.v = u.v and t.d = u.d left join kids k on k.v = u.v and k.d = u.d"""


# --------------------------------------------------------------------------------------------------------------- 13

def planted_text(docs: DataFrame) -> DataFrame:
    """doc_id and the contract's text of a document: in one of ten, the words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    # what is used again is a column of its own: an expression would split the text anew at each use
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"))
    docs = docs.select("*", F.when(F.size("words") > 0, F.size("words")).alias("n"))
    docs = docs.select("*", (g % F.col("n")).cast("int").alias("a"))
    docs = docs.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int").alias("p"))
    words, n, a, p = (F.col(x) for x in ("words", "n", "a", "p"))
    # all slices of one array: a lambda would look words up one by one
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return docs.select("doc_id", F.when(n.isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in every document, and digests of all runs and of the text without their repeats."""
    found = periodic_runs.find_periodic_runs(planted_text(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"),
        best["p"].alias("period"), F.floor(-1000 * best["l"] / best["p"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
