"""Registered queries over the driver's tables and their DuckDB twins: the operators that
the document rules use, on ordinary tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import bags, budget, forest, names, phrases, relations, scan
from .plans import evidence, policy
from .plans.document_rules import ranked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def anti_orphan_definition(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return relations.anti_ref(orders, lines, ["key"]).select(F.col("key").alias("o_orderkey"), "o_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anti_orphan_definition(spark, sf_dir)


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return relations.anti_ref(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), ["doc_id"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return relations.dup_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _flags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    return lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'")


_BAGS = """
with a as (select l_partkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1),
b as (select l_partkey, count(*) as n from lineitem where l_returnflag = 'A' group by 1)
"""


@query(_BAGS + "select l_partkey, a.n - coalesce(b.n, 0) as n from a left join b using (l_partkey) where a.n > coalesce(b.n, 0)")
def bag_difference(spark: SparkSession, d: str) -> DataFrame:
    return bags.bag_difference(*_flags(spark, d), ["l_partkey"])


@query(_BAGS + "select l_partkey, least(a.n, b.n) as n from a join b using (l_partkey)")
def bag_intersection(spark: SparkSession, d: str) -> DataFrame:
    return bags.bag_intersection(*_flags(spark, d), ["l_partkey"])


@query(_BAGS + "select l_partkey, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from a full join b using (l_partkey)")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    return bags.bag_union(*_flags(spark, d), ["l_partkey"])


@query("""
select case when grouping(source) = 0 then 'source' else 'lang' end as grouping, coalesce(source, lang) as value,
       count(*) as docs, sum(n_chars)::bigint as chars
from documents group by grouping sets ((source), (lang))
""")
def grouping_sets_metrics(spark: SparkSession, d: str) -> DataFrame:
    return relations.grouped_metrics(read(spark, d, "documents"), ["source", "lang"], [F.count("*").alias("docs"), F.sum("n_chars").alias("chars")])


@query("""
select a.event_id as first_id, b.event_id as second_id from events a join events b
on a.user_id = b.user_id and (a.ts, a.event_id) < (b.ts, b.event_id) and b.ts - a.ts <= interval 10 minute
""")
def range_self_join(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", "user_id", "ts")
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    pairs = relations.near_pairs(
        events, ["user_id"], "ts", F.col("b_ts") <= F.col("a_ts") + F.expr("interval 10 minutes"), [], F.floor(second / 600), "event_id"
    )
    return pairs.select(F.col("a_event_id").alias("first_id"), F.col("b_event_id").alias("second_id"))


@query("""
select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over
  (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_signup from events
""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    out = relations.carry_forward(read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], value, "last_signup")
    return out.select("event_id", "last_signup")


@query("""
with r as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(c) over (partition by user_id order by ts, event_id) as run from r),
t as (select user_id, run::bigint as run, event_type, count(*) as n from s group by all)
select user_id, run, event_type, n, lead(event_type) over (partition by user_id order by run) as next_event_type from t
""")
def islands_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return relations.islands(read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")


@query("""
with a(event_type, allowed) as (values ('click', 500), ('view', 300), ('signup', 20)),
r as (select event_id, event_type, row_number() over (partition by event_type order by event_id) as k from events)
select event_id, event_type from r left join a using (event_type) where k > coalesce(allowed, 0)
""")
def counted_allowance(spark: SparkSession, d: str) -> DataFrame:
    allowed = spark.createDataFrame([("click", 500), ("view", 300), ("signup", 20)], "event_type string, allowed long")
    return bags.counted_allowance(read(spark, d, "events").select("event_id", "event_type"), allowed, "event_type", [F.col("event_id")])


@query("""
with k as (select event_type, user_id, event_id from events where event_id % 2 = 0), i as (select event_id, event_type, user_id from events where event_id % 2 = 1),
e as (select i.*, row_number() over (partition by event_type, user_id order by event_id) as nth from i),
en as (select event_type, user_id, count(*) as n from k group by all), ln as (select event_type, count(*) as n from k group by all),
x as (select e.*, coalesce(nth <= en.n, false) as ex from e left join en using (event_type, user_id)),
u as (select event_type, count(*) as n from x where ex group by all),
y as (select x.*, row_number() over (partition by event_type, ex order by event_id) as k from x)
select event_id, event_type, user_id,
       case when ex then 'exact' when k <= coalesce(ln.n, 0) - coalesce(u.n, 0) then 'loose' else 'new' end as level
from y left join ln using (event_type) left join u using (event_type)
""")
def two_level_inherit(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("event_id", "event_type", "user_id")
    known, items = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return bags.two_level_inherit(items, known, ["event_type", "user_id"], ["event_type"], [F.col("event_id")])


@query("""
with l as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as k from orders where o_orderstatus = 'F'),
a as (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by o_orderkey) as k from orders where o_orderstatus = 'O')
select o_orderpriority, k, l.o_orderkey as lost_o_orderkey, a.o_orderkey as added_o_orderkey from l full join a using (o_orderpriority, k)
""")
def pair_lost_added(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return bags.pair_lost_added(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), ["o_orderpriority"], "o_orderkey")


@query("""
with a as (select l_linenumber, l_partkey as p, l_suppkey as s, l_orderkey as ord from lineitem where l_orderkey % 2 = 0 qualify row_number() over (partition by l_linenumber, l_orderkey order by l_partkey, l_suppkey) = 1),
b as (select l_linenumber, l_partkey as p, l_suppkey as s, l_orderkey as ord from lineitem where l_orderkey % 2 = 1 qualify row_number() over (partition by l_linenumber, l_orderkey order by l_partkey, l_suppkey) = 1),
r1 as (select l_linenumber, x.ord as s_ord, y.ord as e_ord, 0 as round from
  (select *, row_number() over (partition by l_linenumber, p order by ord) as k from a) x join
  (select *, row_number() over (partition by l_linenumber, p order by ord) as k from b) y using (l_linenumber, p, k)),
a2 as (select * from a where (l_linenumber, ord) not in (select (l_linenumber, s_ord) from r1)),
b2 as (select * from b where (l_linenumber, ord) not in (select (l_linenumber, e_ord) from r1))
select * from r1 union all
select l_linenumber, x.ord, y.ord, 1 from
  (select *, row_number() over (partition by l_linenumber, s order by ord) as k from a2) x join
  (select *, row_number() over (partition by l_linenumber, s order by ord) as k from b2) y using (l_linenumber, s, k)
""")
def match_texts(spark: SparkSession, d: str) -> DataFrame:
    # all rows: even orders are the source, odd ones the edit
    lines = read(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_orderkey").alias("ord")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    lines = lines.select("l_linenumber", "ord", F.col("m.l_partkey").alias("p"), F.col("m.l_suppkey").alias("s"))
    return bags.match_texts(lines.where("ord % 2 = 0"), lines.where("ord % 2 = 1"), ["l_linenumber"], [("p", "p"), ("s", "s")])


@query("""
with a as (select l_linenumber, l_partkey as p, l_suppkey as s, l_orderkey as ord from lineitem where l_linestatus = 'F' qualify row_number() over (partition by l_linenumber, l_orderkey order by l_partkey, l_suppkey) = 1),
b as (select l_linenumber, l_partkey as p, l_suppkey as s, l_orderkey as ord from lineitem where l_linestatus = 'O' qualify row_number() over (partition by l_linenumber, l_orderkey order by l_partkey, l_suppkey) = 1),
r1 as (select l_linenumber, x.ord as s_ord, y.ord as e_ord, 0 as round from
  (select *, row_number() over (partition by l_linenumber, p order by ord) as k from a) x join
  (select *, row_number() over (partition by l_linenumber, p order by ord) as k from b) y using (l_linenumber, p, k)),
a2 as (select * from a where not exists (select 1 from r1 where r1.l_linenumber = a.l_linenumber and s_ord = a.ord)),
b2 as (select * from b where not exists (select 1 from r1 where r1.l_linenumber = b.l_linenumber and e_ord = b.ord))
select * from r1 union all
select l_linenumber, x.ord, y.ord, 1 from
  (select *, row_number() over (partition by l_linenumber, s order by ord) as k from a2) x join
  (select *, row_number() over (partition by l_linenumber, s order by ord) as k from b2) y using (l_linenumber, s, k)
""")
def match_texts_whole(spark: SparkSession, d: str) -> DataFrame:
    """match_texts over all of lineitem: one line status is the source, the other the edit."""
    lines = read(spark, d, "lineitem").groupBy("l_linestatus", "l_linenumber", F.col("l_orderkey").alias("ord"))
    lines = lines.agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    lines = lines.select("l_linestatus", "l_linenumber", "ord", F.col("m.l_partkey").alias("p"), F.col("m.l_suppkey").alias("s"))
    source, edited = (lines.where(F.col("l_linestatus") == x).drop("l_linestatus") for x in "FO")
    return bags.match_texts(source, edited, ["l_linenumber"], [("p", "p"), ("s", "s")])


@query(r"""
select md5(t) as digest, n from (select trim(regexp_replace(text, '\s+', ' ', 'g')) as t, count(*) as n from documents where text is not null group by 1) where n > 1
""")
def normalized_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").where("text is not null").select(F.md5(T.squeezed(F.col("text"))).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")


@query("""
select link, count(*) as n from (select unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages) group by 1
""")
def markup_links(spark: SparkSession, d: str) -> DataFrame:
    links = read(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("link").agg(F.count("*").alias("n"))


@query("select doc_id, sha256(text) as digest from documents")
def body_digest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::bigint as n from documents")
def substring_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("select r_name as root, n_name as node, 1 as depth from region join nation on n_regionkey = r_regionkey union all select r_name, r_name, 0 from region")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    start = region.select(F.col("r_name").alias("doc"), F.col("r_name").alias("node"))
    edges = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("doc"), F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    back = edges.select("doc", F.col("dst").alias("src"), F.col("src").alias("dst"))  # cycles end
    return relations.reachable(start, edges.unionByName(back)).withColumnRenamed("doc", "root")


@query("""
with a as (select year(l_shipdate) as y, count(*) as n from lineitem where l_returnflag = 'R' group by 1), b as (select year(l_shipdate) as y, count(*) as n from lineitem where l_returnflag = 'A' group by 1)
select y::int as y, coalesce(a.n, 0) as n_before, coalesce(b.n, 0) as n_after, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full join b using (y)
""")
def delta_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.year("l_shipdate").alias("y"), "l_returnflag")
    return relations.delta_counts(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["y"])


@query("""
with q as (select year(l_shipdate) as y, sum(l_quantity)::bigint as n from lineitem group by 1)
select a.y::int as y, a.n as before, b.n as after, 100 * b.n < 95 * a.n as lost from q a join q b on b.y = a.y + 1
""")
def volume_ratio(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").cast("long").alias("n"))
    later = q.select((F.col("y") - 1).alias("y"), F.col("n").alias("after"))
    return q.withColumnRenamed("n", "before").join(later, "y").withColumn("lost", 100 * F.col("after") < 95 * F.col("before"))


@query("select count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'never') as never from events")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return relations.severity_summary(read(spark, d, "events"), "event_type", ["click", "signup", "never"])


@query("""
select l_orderkey, l_linenumber, count(*) as n, case when o_orderkey is null then 'order' when c_custkey is null then 'customer' when n_nationkey is null then 'nation' end as failed
from lineitem left join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P' left join customer on c_custkey = o_custkey and c_acctbal > 0 left join nation on n_nationkey = c_nationkey and n_regionkey <> 2
group by all
""")
def first_failing_hop(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    customer = read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    nation = read(spark, d, "nation").where("n_regionkey <> 2").select("n_nationkey")
    # the later hops hang on the order alone: its lines don't travel by keys that are null where a hop failed
    orders = relations.first_failing_hop(orders, [
        (customer, F.col("c_custkey") == F.col("o_custkey"), "c_custkey", "customer"),
        (nation, F.col("n_nationkey") == F.col("c_nationkey"), "n_nationkey", "nation"),
    ]).select("o_orderkey", F.col("failed").alias("later"))
    # partitions are not put together by their few bytes, which are many rows in a task's memory
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").repartition(many, "l_orderkey")
    out = relations.first_failing_hop(lines, [(orders, F.col("o_orderkey") == F.col("l_orderkey"), "o_orderkey", "order")])
    out = out.withColumn("failed", F.coalesce("failed", "later"))
    return out.groupBy("l_orderkey", "l_linenumber", "failed").agg(F.count("*").alias("n"))


@query("select d.doc_id, coalesce(quality, case when n_chars < 100 then 0 end, 1)::int as quality from documents d left join labels l on l.doc_id = d.doc_id")
def precedence_coalesce(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") < 100, 0), F.lit(1)).alias("quality"))


@query("""
select o_orderkey, sum(round(l_extendedprice * 100))::bigint as cents, any_value(round(o_totalprice * 100))::bigint as declared
from orders join lineitem on l_orderkey = o_orderkey group by 1 having sum(round(l_extendedprice * 100))::bigint <> any_value(round(o_totalprice * 100))::bigint
""")
def sum_vs_declared(spark: SparkSession, d: str) -> DataFrame:
    sums = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    orders = read(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("declared"))
    return orders.join(sums, "o_orderkey").where("cents <> declared")


@query("select p_brand, p_partkey, rank::int as rank from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part) where rank <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return relations.topk(part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).drop("p_retailprice")


_RULES = [(0, "%9%", "nine"), (1, "%8%", "eight"), (2, "%k%", "other")]


@query("""
with r(ord, pat, rule) as (values (0, '%9%', 'nine'), (1, '%8%', 'eight'), (2, '%k%', 'other'))
select event_id, arg_min(rule, ord) as rule from events left join r on props like pat group by 1
""")
def first_match_theta(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "ord int, pat string, rule string")
    return relations.first_match(read(spark, d, "events").select("event_id", "props"), rules, F.expr("props like pat"), ["event_id"], "ord", "rule")


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def contained_text(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark is a stated query set against all texts, in blocks of a bounded size."""
    items = read(spark, d, "benchmark").where("text <> ''").select("item_id", "text")
    return relations.contained(read(spark, d, "documents").select("doc_id", "text"), items, "text").select("doc_id", "item_id")


@query(r"""
with v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark), t as (select conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from conversations)
select w, count(*) as n, count(distinct conv_id) as convs from t where w in (select w from v) group by 1
""")
def token_semi_join(spark: SparkSession, d: str) -> DataFrame:
    words = lambda df, *c: df.select(*c, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    vocabulary = words(read(spark, d, "benchmark")).distinct()
    return words(read(spark, d, "conversations"), "conv_id").join(vocabulary, "w", "left_semi").groupBy("w").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("convs"))


@query("select event_id, (props::json->>'k')::bigint as k from events")
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select conv_id, role, string_agg(text, ' ' order by turn, text) as said from conversations group by 1, 2")
def conversation_views(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(turns, lambda x: x["text"]), " ").alias("said"))


@query("""
with f as (select o_orderpriority, case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end as r from orders where o_totalprice > 200000)
select o_orderpriority, count(*) filter (r = 3) as error, count(*) filter (r = 2) as warn, count(*) filter (r = 1) as info, max(r) as worst_rank,
       case max(r) when 3 then 'error' when 2 then 'warn' else 'info' end as worst from f group by 1
""")
def worst_by_group(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warn").otherwise("info")
    rows = ranked(read(spark, d, "orders").where("o_totalprice > 200000").select("o_orderpriority", severity.alias("severity")))
    return policy.summarize(rows, "o_orderpriority")


@query("""
select c_nationkey, case when count(distinct c_mktsegment) = 1 then min(c_mktsegment) else '[' || string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) || ']' end as segments
from customer group by 1
""")
def fold_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("x"))
    return rows.select("c_nationkey", V.folded(F.col("x")).alias("segments"))


@query("""
with r as (select s_nationkey, s_name, row_number() over (partition by s_nationkey order by s_name) as k, count(*) over (partition by s_nationkey) as n from supplier)
select s_nationkey, string_agg(s_name, ', ' order by s_name) filter (k <= 3) || case when max(n) > 3 then ' and ' || (max(n) - 3) || ' more' else '' end as names from r group by 1
""")
def names_and_more(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("x"))
    return rows.select("s_nationkey", V.names_and_more(F.col("x"), 3).alias("names"))


@query("""
with f as (select user_id, event_type, min((ts, event_id)) as seen from events group by 1, 2)
select user_id, string_agg(event_type, '>' order by seen) as kinds from f group by 1
""")
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    told = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))
    rows = read(spark, d, "events").groupBy("user_id").agg(told.alias("x"))
    return rows.select("user_id", F.array_join(F.array_distinct(F.transform("x", lambda e: e["event_type"])), ">").alias("kinds"))


@query("""
select o_orderkey, sum(round(o_totalprice * 100)::bigint) over (partition by o_custkey order by o_orderkey)::bigint as total from orders
""")
def running_size(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return relations.running_total(rows, ["o_custkey"], "o_orderkey", "cents").select("o_orderkey", "total")


@query("""
select o_orderkey, case when count(*) over (partition by o_custkey, o_orderstatus) > 1
  then o_orderstatus || '[' || row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) || ']' else o_orderstatus end as step from orders
""")
def sibling_paths(spark: SparkSession, d: str) -> DataFrame:
    return relations.sibling_index(read(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_orderkey", "step")


@query("""
with s as (select p_brand, p_type, p_partkey as ord, p_partkey % 97 as x, p_size as y, p_partkey % 53 as cx, p_size % 29 as cy from part),
p as (select a.ord as first_ord, b.ord as second_ord, least(a.x + a.cx, b.x + b.cx) - greatest(a.x, b.x) as w, least(a.y + a.cy, b.y + b.cy) - greatest(a.y, b.y) as h,
             least(a.cx * a.cy, b.cx * b.cy) as area from s a join s b using (p_brand, p_type) where a.ord < b.ord)
select first_ord, second_ord, w::double * h / area as share from p where w > 0 and h > 0 and area > 0
""")
def rectangle_overlap(spark: SparkSession, d: str) -> DataFrame:
    shapes = read(spark, d, "part").select(
        "p_brand", "p_type", F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 97).alias("x"), F.col("p_size").cast("long").alias("y"),
        (F.col("p_partkey") % 53).alias("cx"), (F.col("p_size") % 29).cast("long").alias("cy"),
    )
    pairs = relations.rectangles_overlap(shapes, ["p_brand", "p_type"], "ord")
    return pairs.select(F.col("a_ord").alias("first_ord"), F.col("b_ord").alias("second_ord"), "share")


@query("""
with t as (select c_custkey from customer where c_acctbal > 0)
select o_orderkey from orders where o_custkey not in (from t) and o_custkey + 1 not in (from t)
""")
def any_candidate(spark: SparkSession, d: str) -> DataFrame:
    rels = read(spark, d, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") + 1).alias("candidates"))
    targets = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("name"))
    return relations.any_candidate(rels, ["o_orderkey"], "candidates", targets, "name").select("o_orderkey")


@query("""
with s as (select distinct user_id, event_id from events), r as (select user_id, event_id, event_type, event_id as value from events),
e as (select s.user_id, s.event_id, t.event_type, r.value from s join (select distinct user_id, event_type from r) t using (user_id) left join r using (user_id, event_id, event_type)),
w as (select user_id, event_id, event_type, last_value(value ignore nulls) over (partition by user_id, event_type order by event_id rows between unbounded preceding and current row) as value from e)
select * from w where value is not null
""")
def inherited_slots(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("user_id", "event_id", "event_type")
    refs = events.withColumn("value", F.col("event_id"))
    return relations.inherited(events.select("user_id", "event_id").distinct(), refs, ["user_id"], "event_id", ["event_type"], "value")


@query("""
with t as (select conv_id, string_split(max(text) filter (turn = 0), ' ') as a, string_split(max(text) filter (turn = 1), ' ') as b from conversations group by 1)
select conv_id, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) as ahead,
       len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: list_reverse(a)[1:i] = list_reverse(b)[1:i])) as behind from t where a is not null and b is not null
""")
def common_ends(spark: SparkSession, d: str) -> DataFrame:
    words = lambda k: F.split(F.max(F.when(F.col("turn") == k, F.col("text"))), " ")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(words(0).alias("a"), words(1).alias("b")).where("a is not null and b is not null")
    ends = [T.common_prefix(f(F.col("a")), f(F.col("b"))).cast("long").alias(n) for n, f in (("ahead", lambda c: c), ("behind", F.reverse))]
    return rows.select("conv_id", *ends)


@query("select doc_id, case when length(text) > 60 then substr(text, 1, 57) || '...' else text end as said from documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), 60).alias("said"))


@query("""
select p_partkey, case when p_size <= 25 then -1 else greatest(0.0, (p_retailprice / 50 - (p_size - 25)) / (p_size - 25)) end as ratio, (p_partkey * 1000)::double / 12700.0 as pt,
       case when p_size - 25 >= 20 or p_partkey % 40 - 10 >= 20 or p_size - 25 + 5 <= 0 or p_partkey % 40 - 10 + 5 <= 0 then 'outside'
            when p_size - 25 < 0 or p_partkey % 40 - 10 < 0 or p_size - 25 + 5 > 20 or p_partkey % 40 - 10 + 5 > 20 then 'over' end as off from part
""")
def measures(spark: SparkSession, d: str) -> DataFrame:
    box = (F.col("p_size") - 25).cast("long")
    ratio = V.overflow_ratio(F.col("p_retailprice") / 50, box)
    x, y, five, twenty = box, F.col("p_partkey") % 40 - 10, F.lit(5), F.lit(20)
    return read(spark, d, "part").select(
        "p_partkey", F.when(ratio == float("inf"), F.lit(-1.0)).otherwise(ratio).alias("ratio"), V.points((F.col("p_partkey") * 1000).cast("double")).alias("pt"),
        V.off_slide(x, y, five, five, twenty, twenty).alias("off"),
    )


@query("""
select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P", count(*) as total from orders group by 1
""")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return relations.outcome_counts(read(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("""
with t as (select doc_id, string_split(text, chr(10)) as r from documents where text is not null),
i as (select doc_id, len(r) as n, list_filter(range(1, len(r) + 1), lambda i: trim(r[i], ' ') <> '') as full_at from t)
select doc_id, case when len(full_at) = 0 then n else full_at[1] - 1 end as above, case when len(full_at) = 0 then 0 else n - full_at[-1] end as below from i
""")
def blank_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", V.blank_edges(F.split("text", "\n")).alias("e"))
    return rows.select("doc_id", F.col("e.above").cast("long").alias("above"), F.col("e.below").cast("long").alias("below"))


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def first_of_equal(spark: SparkSession, d: str) -> DataFrame:
    return relations.first_of_equal(read(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_type"], "event_id")


@query("""
with f as (select 'c' || o_custkey || '/' || o_orderstatus || '.docx' as doc, case when o_orderpriority like '1%' then 'AAA001' else 'BBB001' end as code, o_orderkey from orders)
select o_orderkey, case when code = 'AAA001' and doc like '%/F.docx' then 'ignore AAA001 in */F.docx: known'
                        when doc like 'c1/%' then 'ignore * in c1/: all of it' end as suppressed,
       case when code = 'BBB001' then 'info' else 'error' end as severity from f
""")
def policy_rules(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit("c"), F.col("o_custkey"), F.lit("/"), F.col("o_orderstatus"), F.lit(".docx"))
    code = F.when(F.col("o_orderpriority").startswith("1"), "AAA001").otherwise("BBB001")
    rows = ranked(read(spark, d, "orders").select("o_orderkey", doc.alias("doc"), code.alias("code"), F.lit("error").alias("severity")))
    ignores = (policy.Ignore("AAA001", "known", "*/F.docx"), policy.Ignore("*", "all of it", "c1/"))
    return policy.apply_policy(rows, policy.Policy({"BBB001": "info"}, ignores)).select("o_orderkey", "suppressed", "severity")


def order_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the form of findings: a customer is a file."""
    code = F.when(F.col("o_orderstatus") == "F", "AAA001").when(F.col("o_orderstatus") == "O", "BBB001").otherwise("XML001")
    severity = F.when(F.col("o_orderstatus") == "F", "error").otherwise("warn")
    return ranked(read(spark, d, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("doc"), code.alias("code"), severity.alias("severity"), F.lit(None).cast("string").alias("where"),
        F.lit("p.xml").alias("part"), F.col("o_orderpriority").alias("subject"), F.col("o_orderkey").cast("string").alias("message"),
    ))


FINDINGS_SQL = """
with f as (select 'c' || o_custkey as doc, case o_orderstatus when 'F' then 'AAA001' when 'O' then 'BBB001' else 'XML001' end as code,
  case o_orderstatus when 'F' then 'error' else 'warn' end as severity, 'p.xml' as part, o_orderpriority as subject, o_orderkey::varchar as message from orders)
"""


@query(FINDINGS_SQL + """, d as (select distinct doc from f)
select doc, code, message, case when code = 'AAA001' then case when subject = '1-URGENT' then 'declared' else 'any' end end as expected from f
union all select doc, 'EXP001', 'expected finding did not occur: AAA001 subject=1-URGENT (declared)', null from d where doc not in (select doc from f where code = 'AAA001' and subject = '1-URGENT')
union all select doc, 'EXP001', 'expected finding did not occur: CCC001 (third)', null from d where doc like 'c1%'
""")
def expectations(spark: SparkSession, d: str) -> DataFrame:
    found = order_findings(spark, d)
    wanted = (policy.parse_expectation("aaa001:subject=1-URGENT"), policy.Expectation("AAA001", {}, "any", required=False), policy.Expectation("CCC001", {}, "third", "c1*"))
    return policy.expect(found, wanted, found.select("doc").distinct()).select("doc", "code", "message", "expected")


@query(FINDINGS_SQL + "select doc || '::' || code || '::p.xml::sha256=' || sha256(subject) as fingerprint, count(*) as allowed from f group by 1")
def baseline_counts(spark: SparkSession, d: str) -> DataFrame:
    return policy.make_baseline(order_findings(spark, d))


@query(FINDINGS_SQL + """
select doc, code, '{"ruleId":"' || code || '","level":"' || case severity when 'warn' then 'warning' else severity end || '","message":{"text":"' || message
  || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || doc || '"}}}],"properties":{"severity":"' || severity || '","part":"p.xml"}}' as result from f
""")
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return policy.sarif_results(order_findings(spark, d))


@query(FINDINGS_SQL + """, i as (select doc, severity, code, '{"code":"' || code || '","severity":"' || severity || '","message":"' || message || '","part":"p.xml","subject":"' || subject || '"}' as item, message, subject from f)
select doc, '{"file":"' || doc || '","summary":{"error":' || count(*) filter (severity = 'error') || ',"warn":' || count(*) filter (severity = 'warn') || ',"info":0},"findings":['
  || string_agg(item, ',' order by severity, code, message, subject) || ']}' as report from i group by doc
""")
def json_reports(spark: SparkSession, d: str) -> DataFrame:
    return policy.json_report(order_findings(spark, d))


@query(FINDINGS_SQL + "select doc, rpad(upper(severity), 5, ' ') || '  ' || code || '  ' || message || '  [p.xml]' as line from f")
def human_lines(spark: SparkSession, d: str) -> DataFrame:
    return policy.human_report(order_findings(spark, d))


@query(FINDINGS_SQL + "select doc, not bool_or(code = 'XML001') as comparable from f group by 1")
def comparable_files(spark: SparkSession, d: str) -> DataFrame:
    found = order_findings(spark, d)
    return policy.comparable(found, found.select("doc").distinct())


@query(FINDINGS_SQL + "select coalesce(bool_or(severity = 'error'), false) as failed from f")
def run_outcome(spark: SparkSession, d: str) -> DataFrame:
    return policy.fails(order_findings(spark, d))


@query("""
with m as (
  select user_id, event_id, ts, case event_type when 'view' then 1 when 'purchase' then -1 else 0 end as v from events
), s as (
  select *, row_number() over w as n, sum(v) over w as s from m window w as (partition by user_id order by ts, event_id)
), d as (
  select *, s - v - least(0, coalesce(min(s) over (partition by user_id order by n rows between unbounded preceding and 1 preceding), 0)) as before from s
), l as (select *, before + case when v = 1 then 1 else 0 end as level from d)
select event_id, n, level::bigint as level, case when level > 0 then (select max(b.n) from l b where b.user_id = l.user_id and b.level = l.level and b.v = 1 and b.n <= l.n) end as owner from l
""")
def nested_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Views open a bracket of their user, purchases close the last open one."""
    events = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    mark = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "purchase", "end")
    out = scan.brackets(events, ["user_id"], [F.col("ts"), F.col("event_id")], mark)
    return out.select("event_id", "n", "level", "owner")


@query("""
with recursive l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null
), r as (
  select doc_id, pos, length(line) <= 500 as taken, 500 - case when length(line) <= 500 then length(line) else 0 end as rest from l where pos = 0
  union all
  select l.doc_id, l.pos, length(line) <= rest, rest - case when length(line) <= rest then length(line) else 0 end from r join l on l.doc_id = r.doc_id and l.pos = r.pos + 1
)
select doc_id, count(*) as n_lines, count(*) filter (taken) as n_taken, 500 - min(rest) as used, min(pos) filter (not taken) as first_passed from r group by doc_id
""")
def line_budget(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document that fit in a budget of characters, given out in their order."""
    docs = read(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.length("line").alias("cost"))
    out = budget.within_budget(lines, ["doc_id"], ["pos"], "cost", 500)
    return out.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("taken").alias("n_taken"), F.sum(F.when(F.col("taken"), F.col("cost")).otherwise(0)).alias("used"),
        F.min(F.when(~F.col("taken"), F.col("pos").cast("long"))).alias("first_passed"),
    )


@query(r"""
with recursive t as (
  select conv_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
         lead(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) over (partition by conv_id order by turn) as g from conversations
), u as (select conv_id, turn, w[1:3] as w, g from t where g is not null),
r as (
  select conv_id, turn, w, g, 0 as k, 0 as met from u
  union all
  select conv_id, turn, w, g, k + 1, met + case when met < len(w) and g[k + 1] = w[met + 1] then 1 else 0 end from r where k < len(g)
)
select conv_id, turn, met = len(w) as whole, (len(g) - met)::bigint as n_extra from r where k = len(g)
""")
def kept_openings(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first three words of a turn come in the next turn in their order, and how
    many of its words are others."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("g"))
    both = turns.join(after, ["conv_id", "turn"]).withColumn("s", budget.surplus(F.slice("w", 1, 3), F.col("g")))
    return both.select("conv_id", "turn", "s.whole", F.size("s.extra").cast("long").alias("n_extra"))


@query("""
with recursive n as (
  select event_id as node, case event_type when 'signup' then null when 'error' then event_id + user_id % 3 else event_id - 1 - user_id % 7 end as parent from events
), s as (
  select n.node, n.parent, case when n.parent is null then 'top' when p.node is null then 'orphan' else 'below' end as state from n left join n p on p.node = n.parent
), t as (
  select node, node as root, 0 as depth from s where state <> 'below'
  union all
  select s.node, t.root, t.depth + 1 from t join s on s.parent = t.node and s.state = 'below'
)
select s.node as event_id, t.root, t.depth::bigint as depth, case when t.node is null then 'cycle' else s.state end as state from s left join t on t.node = s.node
""")
def event_trees(spark: SparkSession, d: str) -> DataFrame:
    """Events below an earlier one, or, errors, below a later one, which may close a cycle."""
    late, early = F.expr("event_id + user_id % 3"), F.expr("event_id - 1 - user_id % 7")
    parent = F.when(F.col("event_type") == "error", late).when(F.col("event_type") != "signup", early)
    nodes = read(spark, d, "events").select(F.col("event_id").alias("node"), parent.alias("parent"))
    return forest.rooted(nodes, []).select(F.col("node").alias("event_id"), "root", "depth", "state")


@query("""
with u as (select event_id, event_type, user_id, row_number() over (partition by event_type, user_id order by event_id) as use, max(user_id) over (partition by event_type) as top from events)
select event_id, event_type, user_id, case when use > 1 then top + sum((use > 1)::int) over (partition by event_type order by event_id) end::bigint as fresh from u
""")
def fresh_user_ids(spark: SparkSession, d: str) -> DataFrame:
    """Within a type of event, repeated user ids get new numbers above all, without gaps."""
    events = read(spark, d, "events").select("event_id", "event_type", "user_id")
    return forest.fresh_ids(events, ["event_type"], "user_id", [F.col("event_id")])


@query(r"""
with w as (
  select distinct w as word from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as w from documents)
), s as (
  select word, regexp_replace(regexp_replace(regexp_replace(word, '[^\p{Nd}\p{Lu}]', 'l', 'g'), '\p{Lu}', 'U', 'g'), '\p{Nd}', 'd', 'g') as shape,
         regexp_full_match(word, '[0-9A-Za-z]*') and length(word) >= 4 as plain from w
), p as (
  select shape, count(*) as n, count(*) filter (plain) as taken, sha256('quill:' || shape) as h,
         list_reduce(list_prepend(cast(1 as hugeint), list_transform(string_split(shape[1:10], ''), lambda c: case when c = 'd' then cast(10 as hugeint) else 26 end)), lambda a, b: a * b) as size
  from s group by shape
), q as (
  select shape, size, least(size, n + taken) as tried, 1 + 130 * (cast('0x' || h[1:15] as hugeint) % greatest(size // 130, 1)) as factor, cast('0x' || h[16:30] as hugeint) % size as shift from p
), e as (
  select shape, j, (factor * j + shift) % size as v, size from (select shape, size, factor, shift, unnest(range(cast(tried as bigint))) as j from q)
), f as (
  select shape, j, array_to_string(list_transform(range(1, least(10, length(shape)) + 1), lambda i:
    substr(case shape[i] when 'd' then '0123456789' when 'U' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else 'abcdefghijklmnopqrstuvwxyz' end,
      cast(1 + (v // cast(round(pow(26, length(replace(shape[i + 1:10], 'd', ''))) * pow(10, length(regexp_replace(shape[i + 1:10], '[^d]', '', 'g')))) as hugeint)) % (case shape[i] when 'd' then 10 else 26 end) as bigint), 1)), '') as front
  from e
), k as (
  select distinct shape, word[1:10] as front from s where plain
), g as (
  select shape, front, row_number() over (partition by shape order by j) as k from f where not exists (select 1 from k where k.shape = f.shape and k.front = f.front)
), m as (select shape, count(*) as m from g group by shape),
r as (
  select word, s.shape, m.m, sha256('quill' || word) as o, row_number() over (partition by s.shape order by sha256('quill' || word)) as nth from s left join m on m.shape = s.shape
)
select word, g.front || array_to_string(list_transform(range(11, length(r.shape) + 1), lambda i:
         substr(case r.shape[i] when 'd' then '0123456789' when 'U' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else 'abcdefghijklmnopqrstuvwxyz' end,
           1 + cast('0x' || substr(r.o, 1 + (2 * (i - 11)) % 64, 2) as bigint) % (case r.shape[i] when 'd' then 10 else 26 end), 1)), '') as name, nth > m as collides
from r join g on g.shape = r.shape and g.k = (nth - 1) % m + 1
""")
def word_names(spark: SparkSession, d: str) -> DataFrame:
    """A new name of the same shape for every word of the documents."""
    docs = read(spark, d, "documents").where("text is not null")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return names.renamed(words, "quill")


@query(r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ws from documents where text is not null
), b as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ws from benchmark
), p as (select item_id, ws[1:2 + len(ws) % 5] as ph from b where len(ws) > 0),
g as (select doc_id, ws, unnest(ws) as w, unnest(range(len(ws))) as pos from d)
select distinct doc_id, item_id, pos::int as pos from g join p on g.w = ph[1] where ws[pos + 1:pos + len(ph)] = ph
""")
def leaked_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Places of the documents that hold the opening words (two to six) of a benchmark item."""
    docs = read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), phrases.tokens(F.col("text")).alias("words"))
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("phrase"), phrases.tokens(F.col("text")).alias("w"))
    items = items.select("phrase", F.slice("w", F.lit(1), 2 + F.size("w") % 5).alias("words"))
    return phrases.occurrences(docs, items).select(F.col("id").alias("doc_id"), F.col("phrase").alias("item_id"), F.col("at").alias("pos"))


@query(r"""
with e as (
  select doc_id as doc, 'low' as code from labels where quality = 0 union select doc_id, 'toxic' from labels where toxic = 1
), f as (
  select doc_id as doc, 'low' as code from documents where n_chars < 300 or text like '%###%'
  union select doc_id, 'toxic' from documents where regexp_matches(text, '[!?]{2}') union select doc_id, 'repeated' from documents where starts_with(text, '  ')
), m as (
  select coalesce(e.code, f.code) as code, count(*) filter (e.code is not null and f.code is not null) as tp,
         count(*) filter (e.code is null) as fp, count(*) filter (f.code is null) as fn
  from e full join f on e.doc = f.doc and e.code = f.code group by 1
)
select r.code, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn,
       case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end as recall
from (values ('low'), ('toxic'), ('repeated'), ('never')) r(code) left join m using (code)
""")
def rule_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How plain tests of the documents meet their labels."""
    labels, docs = read(spark, d, "labels"), read(spark, d, "documents")
    pairs = lambda df, test, code: df.where(test).select(F.col("doc_id").alias("doc"), F.lit(code).alias("code"))
    expected = pairs(labels, "quality = 0", "low").unionByName(pairs(labels, "toxic = 1", "toxic"))
    found = pairs(docs, "n_chars < 300 or text like '%###%'", "low").unionByName(pairs(docs, F.col("text").rlike("[!?]{2}"), "toxic"))
    found = found.unionByName(pairs(docs, F.col("text").startswith("  "), "repeated"))
    rules = spark.createDataFrame([(c,) for c in ("low", "toxic", "repeated", "never")], "code string")
    return evidence.rule_metrics(expected, found, rules)
