"""Queries over key-value tables, seeds and rotations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlab.operators import comparison as B
from skeinlab.operators import keyvalues as KV
from skeinlab.plans.registry import Registry
from skeinlab.plans.thread_queries import _id, _ref
from skeinlab.runtime import clean_id, own_id, read_table, ref_id, ref_type, salted_join

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql
_POST, _COMMENT, _PARENT = _id("post_id"), _id("comment_id"), _ref("parent_id")

_VERSIONS = f"""p as (select {_POST} k, cast(score as varchar) s, retrieved_at t from posts), o as (select k, arg_min(coalesce(s, '-'), (t, coalesce(s, '-'))) v from p where k is not null group by 1),
n as (select k, arg_max(coalesce(s, '-'), (t, coalesce(s, '-'))) v from p where k is not null group by 1 having count(*) > 1)"""


def _versions(spark, d):
    p = read_table(spark, d, "posts").select(own_id("post_id").alias("k"), F.coalesce(F.col("score").cast("string"), F.lit("-")).alias("s"), F.col("retrieved_at").alias("t")).where("k is not null")
    order = F.struct("t", "s")
    g = p.groupBy("k").agg(F.min_by("s", order).alias("first"), F.max_by("s", order).alias("last"), F.count("*").alias("n"))
    return g.select("k", F.col("first").alias("value")), g.where("n > 1").select("k", F.col("last").alias("value"))


@query(f"with {_VERSIONS} select k, o.v as old_value, n.v as new_value from o join n using (k) where o.v <> n.v")
def value_changes(spark, d):
    old, new = _versions(spark, d)
    return KV.changes(old.join(new.select("k"), "k", "left_semi"), new, ["k"])


@query(f"with {_VERSIONS} select k, coalesce(n.v, o.v) as value from o left join n using (k)")
def merged_values(spark, d):
    return KV.merged(*_versions(spark, d), ["k"])


@query("""with t as (select distinct model, product_category c from thread_metrics_summary where model is not null), k as (select model, case when c is null or c = 'laptops' then '' else c end v from t)
select distinct model as k, 'unknown' as problem from k where model not in ('real', 'sim-alder', 'sim-none') union all select x, 'missing' from (values ('real'), ('sim-none')) r(x) where not exists (select 1 from k where k.model = x and v <> '')""")
def invalid_keys(spark, d):
    t = read_table(spark, d, "thread_metrics_summary").where("model is not null").select(F.col("model").alias("k"), F.when(F.coalesce("product_category", F.lit("laptops")) == "laptops", "").otherwise(F.col("product_category")).alias("value"))
    allowed = spark.createDataFrame([("real", True), ("sim-alder", False), ("sim-none", True)], "k string, required boolean")
    return KV.invalid(t, allowed, "k")


@query("""with seed as (select * from (values ('sim-alder', 'paper', 1), ('sim-alder', 'community', 2), ('other', 'paper', 3)) s(model, tier, total)), c as (select model, 'paper' tier, cast(count(*) as int) total from thread_metrics_summary where model like 'sim%' group by 1)
select * from seed where not exists (select 1 from c where c.model = seed.model and c.tier = seed.tier) union all select * from c""")
def seed_override(spark, d):
    seed = spark.createDataFrame([("sim-alder", "paper", 1), ("sim-alder", "community", 2), ("other", "paper", 3)], "model string, tier string, total int")
    found = read_table(spark, d, "thread_metrics_summary").where(F.col("model").startswith("sim")).groupBy("model").agg(F.count("*").cast("int").alias("total")).withColumn("tier", F.lit("paper"))
    return B.override(seed, found.select("model", "tier", "total"))


@query(f"""with a as (select {_POST} k, count(*) n from comments group by 1), b as (select {_POST} k from posts group by 1) select (select count(*) from a join b using (k)) as in_both,
(select count(*) from a where k is not null and k not in (select k from b where k is not null)) as only_comments, (select count(*) from b where k is not null and k not in (select k from a where k is not null)) as only_posts""")
def set_operations(spark, d):
    a, b = (read_table(spark, d, t).select(own_id("post_id").alias("k")).where("k is not null").distinct() for t in ("comments", "posts"))
    sides = a.withColumn("c", F.lit(1)).join(b.withColumn("p", F.lit(1)), "k", "full")
    return sides.agg(F.count_if(F.expr("c is not null and p is not null")).alias("in_both"), F.count_if(F.expr("p is null")).alias("only_comments"), F.count_if(F.expr("c is null")).alias("only_posts"))


@query(f"""with c as (select distinct {_POST} p, {_COMMENT} c, author from comments) select p as post_id, count(distinct author) as n_authors, count(*) as n_rows from c where p is not null group by 1""")
def authors_per_thread(spark, d):
    c = read_table(spark, d, "comments").select(own_id("post_id").alias("post_id"), own_id("comment_id").alias("c"), "author").where("post_id is not null").distinct()
    per = c.groupBy("post_id", "author").agg(F.count("*").alias("n"))  # twice aggregated: no thread's authors meet in one task before they are counted
    return per.groupBy("post_id").agg(F.count("author").alias("n_authors"), F.sum("n").alias("n_rows"))


@query(f"""with c as (select {_COMMENT} id, arg_min({_PARENT}, (retrieved_at, {_PARENT})) filter (where {_PARENT} is not null) parent, min(lower(author)) author from comments group by 1)
select a.id as comment_id from c a join c b on a.parent = 't1_' || b.id or a.parent = b.id where a.author = b.author and a.id <> b.id""")
def self_replies(spark, d):
    c = read_table(spark, d, "comments").select(own_id("comment_id").alias("id"), clean_id("parent_id").alias("ref"), F.lower("author").alias("author"), "retrieved_at").where("id is not null")
    one = c.groupBy("id").agg(F.min_by("ref", F.when(F.col("ref").isNotNull(), F.struct("retrieved_at", "ref"))).alias("ref"), F.min("author").alias("author"))
    named = one.where(F.coalesce(ref_type(F.col("ref")) != "t3", F.lit(True))).select("id", "author", ref_id(F.col("ref")).alias("parent")).where("parent is not null")
    up = one.select(F.col("id").alias("parent"), F.col("author").alias("above"))
    return salted_join(named, up, "parent", "inner").where("author = above and id <> parent").select(F.col("id").alias("comment_id"))


@query("""with e as (select user_id, event_type, min(ts) t from events group by all), r as (select user_id, event_type, row_number() over (partition by user_id order by t, event_type) k from e)
select a.user_id, a.k, string_agg(b.event_type, ',' order by b.k) as earlier from r a left join r b on a.user_id = b.user_id and b.k < a.k group by all""")
def earlier_values(spark, d):
    """What came before each first occurrence: an ordered union over the rows above."""
    e = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_type")
    above = F.collect_list("event_type").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return e.select("user_id", F.row_number().over(w).alias("k"), F.nullif(F.array_join(above, ","), F.lit("")).alias("earlier"))


@query("select event_id, ['calm', 'blunt', 'curious'][(row_number() over (partition by user_id order by ts, event_id) - 1) % 3 + 1] as target from events")
def rotated_targets(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read_table(spark, d, "events").select("event_id", F.element_at(F.array(F.lit("calm"), F.lit("blunt"), F.lit("curious")), F.pmod(k, F.lit(3)) + 1).alias("target"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) % 2 = 0")
def parsed_properties(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read_table(spark, d, "events").select("event_id", k.alias("k")).where("k % 2 = 0")


@query("""with p as (select product_category c, product_id, price, avg(price) over (partition by product_category) a, rank() over (partition by product_category order by price desc) r from products where price is not null)
select c as product_category, product_id, round(price - a, 4) as above_mean from p where r <= 3""")
def top_priced(spark, d):
    w = Window.partitionBy("product_category")
    p = read_table(spark, d, "products").where("price is not null").withColumn("a", F.avg("price").over(w)).withColumn("r", F.rank().over(w.orderBy(F.desc("price"))))
    return p.where("r <= 3").select("product_category", "product_id", F.round(F.col("price") - F.col("a"), 4).alias("above_mean"))


@query("""select n_name as nation, date_trunc('year', o_orderdate) as year, count(distinct o_orderkey) as n_orders, cast(round(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))), 2) as double) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey group by all""")
def revenue_by_nation(spark, d):
    li, o, c, n = (read_table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per = li.groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("r"))  # before the join: one row per order
    j = per.join(o, per.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("year")).agg(F.count("*").alias("n_orders"), F.round(F.sum("r"), 2).cast("double").alias("revenue"))


@query("""with c as (select trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g')) t, model from example_thread_format), n as (select model, count(*) n, count(*) filter (where t = '') blank, max(length(t)) longest from c group by 1) select * from n""")
def text_profile(spark, d):
    c = read_table(spark, d, "example_thread_format").select("model", F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")).alias("t"))
    return c.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("t") == "").alias("blank"), F.max(F.length("t")).alias("longest"))
