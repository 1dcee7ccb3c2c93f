"""The corpus operators as queries of (spark, sf_dir), with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import modest_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, expected_grade, top_probability) of the documents selected for quality, of all documents."""
    from .quality import fit, select

    docs = table(spark, sf_dir, "documents")
    return select(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, cross_entropy, accepted) of every document."""
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified overlap of a document with a benchmark item, in tokens."""
    from .decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tokens(table: str, key: str) -> str:
    return f"select distinct {key}, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') as t from {table} where text is not null"


def _op3_sql() -> str:
    from .decontaminate import MASKS, SPAN

    masks = ", ".join(f"({k}, [{', '.join(str(j) for j, bit in enumerate(m) if bit == '1')}])" for k, m in enumerate(MASKS))
    seeds = f"select {{key}}, m, p, list_transform(off, lambda x: t[p + 1 + x]) as seed from (select *, unnest(range(greatest(0, len(t) - {SPAN - 1}))) as p from {{table}}), masks"
    return f"""
with d as ({_tokens("documents", "doc_id")}), i as ({_tokens("benchmark", "item_id")}), masks(m, off) as (values {masks}),
dw as ({seeds.format(key="doc_id", table="d")}), iw as ({seeds.format(key="item_id", table="i")}),
short as (select doc_id, item_id, p as g from (select *, unnest(range(len(t))) as p from d where len(t) > 0) w join i on w.t[p + 1 : p + len(i.t)] = i.t where len(i.t) between 6 and {SPAN - 1}),
diagonals as (select distinct doc_id, item_id, dw.p - iw.p as g from dw join iw using (m, seed) union select * from short),
cells as (select doc_id, item_id, g, a, d.t[a + g + 1] = i.t[a + 1] as eq, len(i.t) as size from (select doc_id, item_id, g, unnest(range(greatest(0, -g), least(len(i.t), len(d.t) - g))) as a from diagonals join d using (doc_id) join i using (item_id)) join d using (doc_id) join i using (item_id)),
sums as (select *, sum(case when eq then 1 else -2 end) over w as total, sum(eq::int) over w as matches, min(a) over (partition by doc_id, item_id, g) as since from cells window w as (partition by doc_id, item_id, g order by a)),
gains as (select *, least(0, min(total) over (partition by doc_id, item_id, g order by a)) as least from sums),
ends as (select doc_id, item_id, g, since, size, max(total - least) as gain, arg_min(struct_pack(a, least, matches), (-(total - least), a)) as e from gains group by all),
lows as (select ends.*, s.a as low, s.matches as had from ends left join sums s on s.doc_id = ends.doc_id and s.item_id = ends.item_id and s.g = ends.g and s.total = ends.e.least and s.a <= ends.e.a),
firsts as (select doc_id, item_id, g, since, size, gain, e, min(low) as low, min_by(had, low) as had from lows group by all),
starts as (select *, case when e.least = 0 then since else low + 1 end as b, case when e.least = 0 then 0 else had end as before from firsts)
select doc_id, item_id, (b + g)::bigint as start, b::bigint as item_start, (e.a + 1 - b)::bigint as length, (e.matches - before)::bigint as matched
from starts where gain > 0 and e.matches - before >= least(12, greatest(1, ceil(0.8 * size)))
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret of every document, by kind, place and digest."""
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


#: The kinds of secrets that have no checksum, as (before the secret, secret, after it) without look-around; SQL can't check the others'.
PLAIN_SECRETS = {
    "access_key_id": ("(?:^|[^A-Z0-9])", "A[KS]IA[A-Z2-7]{16}", "(?:[^A-Z0-9]|$)"),
    "chat_token": ("", "xox[abpr]-[0-9]{8,14}-[0-9A-Za-z-]{16,}", ""),
    "payment_key": ("", "[sr]k_live_[0-9A-Za-z]{20,}", ""),
    "maps_key": ("", "AIza[0-9A-Za-z_-]{35}", "(?:[^0-9A-Za-z_-]|$)"),
    "assigned": ("(?i:token|secret|passwd|password|api[_-]?key|access_key)[A-Za-z0-9_-]{0,40}[\"'']?[ \\t]{0,4}(?:=|:|:=|=>)[ \\t]{0,4}[\"'']?", "[A-Za-z0-9+/_.=-]{16,}", "(?:[\"'']|[\\s,;]|$)"),
}


def _op4_sql() -> str:
    parts = []
    for kind, (before, secret, after) in PLAIN_SECRETS.items():
        p = f"'({before})({secret}){after}'"
        varied = "where len(list_distinct(string_split(lower(secret), ''))) >= 7 and regexp_matches(secret, '[0-9]')" if kind == "assigned" else ""
        parts.append(f"""
select doc_id, '{kind}' as kind, (since + length(regexp_extract(m, {p}, 1)))::bigint as start, (since + length(regexp_extract(m, {p}, 1)) + length(secret))::bigint as "end", sha256(secret) as digest from (
  select doc_id, ms[k] as m, regexp_extract(ms[k], {p}, 2) as secret, list_sum(list_transform(gaps[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : k - 1], lambda x: length(x))), 0) as since from (
    select doc_id, gaps, ms, unnest(range(1, len(ms) + 1)) as k from (select doc_id, string_split_regex(text, {p}) as gaps, regexp_extract_all(text, {p}, 0) as ms from documents where text is not null) where len(ms) > 0)) {varied}""")
    return f"with found as ({' union all '.join(parts)}) select * from found f where not exists (select 1 from found g where g.doc_id = f.doc_id and g.start < f.start and g.\"end\" > f.start)"


#: Rules of the URL filter: (host and path, action).
URL_RULES = [(f"{host}.example.{tld}/", "block") for host in ("ads-track", "casino-win", "tionsh", "ththan") for tld in ("com", "net", "org")] + [
    ("blog.casino-win.example.com/en/", "allow"),
    ("tionsh.example.net/en/", "allow"),
    ("www.ththan.example.com/", "allow"),
    ("example.org/de/", "block"),
    ("ththre.example.com/fr/825", "block"),
    ("m.example.net/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, action, rule) of every page."""
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "pattern string, action string"))


OP5_SQL = f"""
with rules(rule, action) as (values {", ".join(f"('{p}', '{a}')" for p, a in URL_RULES)}),
cut as (
  select distinct url,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) as query
  from pages),
split as (select url, host, case when p = '' then '/' else p end as path, query from cut where host <> ''),
suffixes as (
  select url, path, query, host as suffix from split
  union
  select url, path, query, array_to_string(string_split(host, '.')[k:], '.') from split, range(1, 64) r(k)
  where k < len(string_split(host, '.')) and not regexp_matches(host, '^[0-9.]+$')),
expressions as (
  select url, suffix || path || query as e from suffixes
  union select url, suffix || path from suffixes
  union select url, suffix || array_to_string(string_split(path, '/')[1:k], '/') || '/' from suffixes, range(1, 64) r(k) where k < len(string_split(path, '/'))
  union select url, suffix || '/' from suffixes where not contains(path, '/')),
best as (
  select url, action, rule, row_number() over (partition by url order by instr(rule, '/') desc, length(rule) desc, action, rule) as n
  from expressions join rules on e = rule)
select page_id, pages.url, coalesce(action, 'allow') as action, rule from pages left join best on pages.url = best.url and n = 1
"""


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id): each near duplicate with the document of its group that stays."""
    from .simhash_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.filter("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under the unbounded n-grams of all other documents."""
    from .suffix_lm import score_each

    return score_each(table(spark, sf_dir, "documents"))


#: Share of each source in the mix, relative to others; those not named have 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 1.5}
MIX_SHARE = 0.4


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that fill the budgets of their sources."""
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, weights=MIX_WEIGHTS, budget_share=MIX_SHARE, length="n_tokens").select("doc_id", "source", "n_tokens")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, neighbor_id, rank, similarity): ten neighbours of every embedding; the similarity in hundredths, as it is of single precision."""
    from .nn_descent import neighbours

    found = neighbours(table(spark, sf_dir, "embeddings"))
    return found.withColumn("similarity", F.floor(F.col("similarity").cast("double") * 100 + 0.123).cast("bigint"))


#: Brute force, which the graph search equals where one block holds all nodes; beyond, its recall is measured.
OP9_SQL = """
with pairs as (select a.vec_id, b.vec_id as neighbor_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by vec_id order by s desc, neighbor_id) as n from pairs)
select vec_id, neighbor_id, n::int as rank, floor(s * 100 + 0.123)::bigint as similarity from ranked where n <= 10
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, end, is_first) of every passage of 50 tokens or more that repeats across documents."""
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "is_first")


def _op10_sql(least: int = 50) -> str:
    return f"""
with d as ({_tokens("documents", "doc_id")}),
w as (select doc_id, p, array_to_string(t[p + 1 : p + {least}], ' ') as run from (select *, unnest(range(greatest(0, len(t) - {least - 1}))) as p from d)),
tied as (select run, min(doc_id) as least from w group by run having count(distinct doc_id) > 1),
places as (select doc_id, p, doc_id = least as is_first from w join tied using (run)),
heads as (select *, coalesce(p > lag(p) over s + {least}, true)::int as head from places window s as (partition by doc_id, is_first order by p)),
islands as (select *, sum(head) over (partition by doc_id, is_first order by p) as island from heads)
select doc_id, min(p)::bigint as start, (max(p) + {least})::bigint as "end", is_first from islands group by doc_id, is_first, island
"""


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _op3_sql(), "op4_secret_scan": _op4_sql(), "op5_url_filter": OP5_SQL, "op9_nearest_neighbours": OP9_SQL, "op10_suffix_dedup": _op10_sql()}
