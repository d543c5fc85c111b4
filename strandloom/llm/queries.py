"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, divergence, jaccard, langid, line_dedup, packing, sharding, substring, topk, toxicity, url_filter, warc
from .common import table

#: The rules of the URL query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), shingle=4, percent=85).drop("key", "group")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("spans")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    files = warc.normalise(warc.write_archives(table(spark, sf_dir, "pages"), folder), folder)
    return warc.read_archives(files, folder).drop("uri")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, width=64)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, terms=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_exact_topk, op3_url_filters, op4_best_fit_packing, op5_toxicity, op6_jaccard_join, op7_language_id, op8_warc, op9_substring_dedup, op10_decontamination, op11_centroid_clustering, op12_sharding, op13_source_divergence)}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_exact_topk": """
with fine as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
asked as (select vec_id, v, min(r) as r from fine where vec_id % 50 = 0 group by vec_id, v),
scored as (select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from asked q join fine c on q.r <> c.r and len(q.v) = len(c.v)),
ranked as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
""",
    "op3_url_filters": f"""
with urls as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (select page_id, {_LOWER.format("coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '')")} as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from urls),
rules(h, p, verdict) as (values {_RULES}),
fits as (select page_id, host, path, h || p as rule, verdict, row_number() over (partition by page_id order by length(h) + length(p) desc, length(h) desc) as r
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select a.page_id, a.host, a.path, f.rule, coalesce(f.verdict, 'allow') as verdict from parts a left join fits f on f.page_id = a.page_id and f.r = 1
""",
    "op6_jaccard_join": f"""
with recursive words as (select row_number() over () as r, doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
sets as (select distinct r, doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as s from words),
sizes as (select r, count(*) as n from sets group by r),
common as (select a.r as x, b.r as y, count(*) as c from sets a join sets b on a.s = b.s and a.r < b.r group by 1, 2),
links as (select x, y from common join sizes a on a.r = x join sizes b on b.r = y where 100 * c >= 85 * (a.n + b.n - c)),
reach as (select r, r as q from words union select reach.r, e.y from reach join (select x, y from links union all select y, x from links) e on e.x = reach.q)
select w.doc_id, coalesce(s.n, 0)::bigint as n_shingles, case when s.n is null then w.doc_id else m.component_id end as component_id from words w left join sizes s on s.r = w.r
join (select reach.r, min(d.doc_id) as component_id from reach join words d on d.r = reach.q group by 1) m on m.r = w.r
""".replace("\\\\", "\\"),
    "op8_warc": """
with body as (select page_id, coalesce(html, '') as b from pages),
rows as (select page_id, octet_length(encode(b))::bigint as payload_bytes, sha256(b) as payload_digest, min(page_id) over (partition by b) as first, octet_length(encode(b)) >= 100 and page_id is not null and row_number() over (partition by b order by page_id nulls last) > 1 as again from body)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to from rows
""",
    "op11_centroid_clustering": clustering.sql(40, 5, 256, 64),
    "op13_source_divergence": divergence.SQL,
    "op9_substring_dedup": """
with texts as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
windows as (select r, i, list_aggregate(w[i : i + 34], 'string_agg', ' ') as s from (select r, w, unnest(range(1, len(w) - 33)) as i from texts where len(w) >= 35)),
hot as (select r, i from windows where s in (select s from windows group by s having count(*) > 1)),
gone as (select distinct r, i + j as i from hot, range(35) t(j)),
words as (select r, doc_id, w, unnest(range(1, len(w) + 1)) as i from texts)
select t.doc_id, len(t.w)::bigint as n_words, coalesce(k.n, 0)::bigint as n_removed, sha256(case when len(t.w) = 0 then '' else coalesce(k.body, '') end) as kept_sha256
from texts t left join (select words.r, count(gone.i) as n, string_agg(w[words.i], ' ' order by words.i) filter (gone.i is null) as body from words left join gone on gone.r = words.r and gone.i = words.i group by words.r) k using (r)
""".replace("\\\\", "\\"),
}
