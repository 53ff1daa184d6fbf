"""The registered query of each training-data operator, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, kmeans, licenses, lines, minhash, mixing, packing, quality, repeats, resampling, rules, store, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.Settings(percent=85))


#: Sets of shingles, pairs that share one with how many, and what links reach.
ORACLE_SQL["op7_minhash"] = r"""
with recursive w as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select r, doc_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w
), x as (
  select doc_id, len(g) as n, unnest(g) as sh from s
), p as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from x a join x b on a.sh = b.sh and a.doc_id <> b.doc_id group by all
), l as (select distinct a, b from p where 100 * c >= 85 * (na + nb - c)),
t as (
  select a as doc_id, a as c from l
  union
  select l.b, t.c from t join l on l.a = t.doc_id
), m as (select doc_id, min(c) as component_id from t group by doc_id)
select doc_id, len(g)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept from s left join m using (doc_id)
"""


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = store.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.classify(docs, labels)


#: The rules (host, path, verdict) that the query is given.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(store.table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE_SQL["op6_url_filter"] = r"""
with rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r
  from pages
), parsed as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest
), rules(rh, rp, rv) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
  select page_id, host, path, rh || rp as rule, rv,
         row_number() over (partition by page_id, host, path order by length(rh || rp) desc, length(rh) desc) as k
  from parsed join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select p.page_id, coalesce(p.host, '') as host, coalesce(p.path, '') as path, f.rule, coalesce(f.rv, 'allow') as verdict
from parsed p left join fits f on f.k = 1 and f.page_id = p.page_id and f.host = p.host and f.path = p.path
"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(pages, store.new_path(spark, "warc"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op4_warc"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, octet_length(encode(h)) as n, sha256(h) as d, min(page_id) over (partition by h) as f from p)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> f then f end as refers_to
from q
"""


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(store.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE_SQL["op1_quality_rules"] = r"""
with d as (
  select doc_id, coalesce(source, '') as host, text as raw, coalesce(text, '') as t from documents
), w as (
  select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as ls, t, host, raw from d
), g as (
  select doc_id, i, list_slice(ws, i, i + 7) as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)
), r as (
  select doc_id, i, lead(i) over (partition by doc_id order by i) as j
  from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1
), rep as (
  select doc_id, sum(case when j is null then 8 else least(8, j - i) end) as n from r group by doc_id
), l as (
  select host, raw, doc_id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n,
         trim(regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as nl
  from (select host, raw, doc_id, unnest(ls) as x from w where raw is not null)
), size as (
  select host, count(distinct raw) as texts from d group by host
), often as (
  select host, nl from (select host, nl, count(distinct raw) as k from l where n > 0 group by host, nl) join size using (host) where k > 10 and 100 * k > 5 * texts
), lost as (
  select doc_id, sum(n) as n from l join often using (host, nl) where n > 0 group by doc_id
), m as (
  select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
         cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost.n, 0) as bigint) as lost_words
  from w left join rep using (doc_id) left join lost using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
         and not (lost_words > 0 and (n_words - lost_words < 20 or 100 * lost_words > 80 * n_words)) as kept, lost_words
from m
"""


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, store.table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE_SQL["op8_decontamination"] = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bg as (
  select distinct item_id, n, list_slice(w, i, i + n - 1) as g
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from bw where len(w) > 0)
), dg as (
  select doc_id, n, i, list_slice(w, i, i + n - 1) as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from bg) where len(w) >= n)
), occ as (
  select doc_id, item_id, i, n from dg join bg using (n, g)
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id
), it as (
  select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids
  from (select distinct doc_id, cast(item_id as varchar) as x from occ) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join it using (doc_id)
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(store.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan(docs, licenses.known_licenses(spark))
    return out.withColumn("notices", F.array_join("notices", ","))


@query
def op5_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(store.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("repeats"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.cluster(store.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    rows = [(c, found.inertias[c], sum(found.inertias), digests[c]) for c in range(len(digests))]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(named), "cluster").select(  # a row a centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _clustering_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds: every vector against every centroid, all distances."""
    parts = [f"""
with recursive u as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from (select * from embeddings where len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)
), rows as materialized (
  select row_number() over () as r, vec_id, v from u
), c0 as materialized (
  select row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v as m from rows
  order by c limit {k}
)"""]  # fmt: skip
    distance = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        parts.append(f"""
, a{i} as materialized (
  select r, vec_id, v, d.c as c, d.d as d
  from (select r, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': cast({distance} as bigint), 'c': c}}) as d from rows, c{i} group by r)
)""")
        if i < rounds:
            parts.append(f"""
, s{i} as (
  select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as i from a{i}) group by c, i
), c{i + 1} as materialized (
  select c{i}.c, coalesce(q.m, c{i}.m) as m
  from c{i} left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from s{i} group by c) q on q.c = c{i}.c
)""")
    parts.append(f"""
select vec_id, cast(a.c as integer) as cluster, d as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia,
       cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} a join c{rounds} k on a.c = k.c
""")
    return "".join(parts)


ORACLE_SQL["op11_centroid_clustering"] = _clustering_sql()


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settings = packing.Settings(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(store.table(spark, sf_dir, "documents").select("doc_id", "text"), settings)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resampling.resample(docs, store.table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum takes a step for each bit: a word's byte is mixed in before its first one.
ORACLE_SQL["op13_importance_resampling"] = r"""
with w as (
  select d, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from (select true as d, row_number() over () as r, doc_id, text from documents union all select false, row_number() over (), null, text from benchmark)
), f as materialized (
  select d, r, f, count(*) as n from (select d, r, unnest(ws) as f from w) group by d, r, f
), b as materialized (
  select f, (4294967295 - list_reduce(
           list_prepend(4294967295, flatten(list_transform(range(len(x) // 2), lambda i: [cast('0x' || x[2 * i + 1:2 * i + 2] as bigint), 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384))) % 10000 as b
  from (select f, hex(encode(f)) as x from (select distinct f from f))
), s as (
  select b, coalesce(sum(n) filter (d), 0) as s, coalesce(sum(n) filter (not d), 0) as t from f join b using (f) group by b
), g as (
  select b, cast(floor(1000 * ln((cast(t + 1 as double) * (sum(s) over () + 10000)) / (cast(s + 1 as double) * (sum(t) over () + 10000)))) as bigint) as g from s
), m as (
  select r, sum(n) as n, sum(n * g) as x from f join b using (f) join g using (b) where d group by r
), q as (
  select w.r, doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce((x - ((x % n) + n) % n) // n, 0) as bigint) as weight,
         cast('0x' || sha256('2024:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) as h
  from w left join m on m.r = w.r where d
), z as (
  select r, doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double))) as bigint) as score from q
), k as (
  select r, row_number() over (order by score desc, doc_id nulls first, n_features, weight) as rank from z where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from k) then rank end as rank
from z left join k using (r)
"""
