"""Queries on joins of scores, profiles, posts and products, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions import text as X
from skeinlab.operators import enrichment as E
from skeinlab.operators import threads as T
from skeinlab.plans.registry import Registry
from skeinlab.plans.thread_queries import GENERATED, _generated, _id, _ref
from skeinlab.runtime import own_id, read_table
from skeinlab.streaming import events as V

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql


@query(f"""with {GENERATED}, s as (select thread_id, comment_id, max(struct_pack(o := likes, p := round(dislikes / 10.0, 3))).p p from
(select run_id || '/' || cast(post_id as varchar) thread_id, cast(comment_id as varchar) comment_id, coalesce(likes, 0) likes, coalesce(dislikes, 0) dislikes from example_thread_format where comment_id is not null) group by all)
select g.thread_id, g.comment_id, s.p as score from g join s using (thread_id, comment_id)""")
def attached_scores(spark, d):
    """Dislikes stand in for a model's scores, likes for the order in which they came."""
    rows = read_table(spark, d, "example_thread_format").where("comment_id is not null")
    thread = F.concat_ws("/", "run_id", F.col("post_id").cast("string")).alias("thread_id")
    scores = rows.select(thread, F.col("comment_id").cast("string").alias("comment_id"), F.coalesce("likes", F.lit(0)).alias("at"), F.round(F.coalesce("dislikes", F.lit(0)) / 10.0, 3).alias("score"))
    return E.attach_scores(_generated(spark, d).select("thread_id", "comment_id"), scores, "at")


@query("""select e.event_id, coalesce(c.c_name, 'user_' || e.user_id) as author, coalesce(round(c.c_acctbal)::bigint, 0) as author_karma from events e left join customer c on c.c_custkey = e.user_id""")
def authors_of_events(spark, d):
    profiles = read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.round("c_acctbal").cast("long").alias("karma"))
    return E.with_profiles(read_table(spark, d, "events").select("event_id", "user_id"), profiles).select("event_id", "author", "author_karma")


_ORD = f"po as (select {_id('post_id')} id, row_number() over (order by min(created_utc), {_id('post_id')}) ordinal from posts where {_id('post_id')} is not null group by 1)"


@query(f"""with {_ORD}, c as (select distinct {_id('comment_id')} comment_id, {_id('post_id')} source_post from comments)
select c.comment_id, c.source_post, coalesce(po.ordinal, (select max(ordinal) from po)) as post, po.ordinal is null as late from c left join po on po.id = c.source_post""")
def comments_of_posts(spark, d):
    posts = read_table(spark, d, "posts").groupBy(own_id("post_id").alias("id")).agg(F.min("created_utc").alias("t")).where("id is not null")
    from skeinlab.operators.prefix import running_totals

    placed = running_totals(posts.select(F.struct(F.col("t").isNull().alias("n"), "t", "id").alias("at"), F.lit(0).alias("all"), F.lit(1).cast("long").alias("one")), ["all"], "at", ["one"])
    ordinals = placed.select("at.id", (F.col("before_one") + 1).alias("ordinal"))
    c = read_table(spark, d, "comments").select(own_id("comment_id").alias("comment_id"), own_id("post_id").alias("source_post")).distinct()
    return E.attach_to_posts(c, ordinals)


@query("""with k as (select trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) k, max(struct_pack(product_id, title)) p from products group by 1)
select o.product_id as opinion, k.p.product_id as product_id, k.p.title as product_title from products o join k on k.k = trim(regexp_replace(lower(coalesce(o.title, '')), '\\s+', ' ', 'g')) where k.k <> ''""")
def product_opinions(spark, d):
    p = read_table(spark, d, "products")
    spelled = p.select(F.col("product_id").alias("opinion"), F.concat(F.lit("  "), F.upper("title"), F.lit(" ")).alias("product_title"))
    return E.opinions_on_products(spelled, p).select("opinion", "product_id", "product_title")


@query("""with pr as (select product_id, row_number() over (order by product_id) - 1 i from (select distinct product_id from products where product_id is not null)), pool as materialized (select * from pr where i < 60), size as (select count(*) n from pool),
u as (select c_custkey profile from customer), t as (select unnest(range(3)) place),
x as (select u.profile, t.place, (u.profile + t.place) % (select n from size) i from u, t) select x.profile, x.place, pool.product_id from x join pool using (i)""")
def rotated_products(spark, d):
    from pyspark.sql import Window

    pool = read_table(spark, d, "products").where("product_id is not null").select("product_id").distinct().select("product_id", (F.row_number().over(Window.orderBy("product_id")) - 1).alias("position"))  # 200 rows, fixed
    return E.rotated_products(read_table(spark, d, "customer").select(F.col("c_custkey").alias("profile")), pool, 3)


@query(f"""with {GENERATED}, s as (select thread_id, count(*) filter (where parent_id is null) t, count(*) filter (where parent_id is not null) n, max(d) d from (select g.*, case when parent_id is null then 0 when parent_id in ('1', '2') then 1 else 2 end d from g) group by 1)
select thread_id, case when t <= 1 and n >= 1 then 'buried' when t <= 1 then 'few_answers' when t >= 2 and n = 0 then 'no_replies' when d >= 2 then 'reply_chain' else '' end as note from s""")
def thread_notes(spark, d):
    """Depths are told by the parent's number, as a stand-in for the thread's own."""
    g = _generated(spark, d)
    depth = F.when(F.col("parent_id").isNull(), 0).when(F.col("parent_id").isin("1", "2"), 1).otherwise(2)
    s = g.groupBy("thread_id").agg(F.count_if(F.col("parent_id").isNull()).alias("t"), F.count_if(F.col("parent_id").isNotNull()).alias("n"), F.max(depth).alias("d"))
    return s.select("thread_id", E.structure_note(F.col("t"), F.col("n"), F.col("d")).alias("note"))


@query("""with f as (select distinct run_id || '/' || cast(post_id as varchar) thread_id, comment_id, parent_comment_id p, depth from example_thread_format),
k as (select thread_id, count(comment_id) n, count(comment_id) filter (where p is null or p = 0) t, count(comment_id) filter (where p is not null and p <> 0) e, max(coalesce(depth, 0)) filter (where comment_id is not null) deep from f where thread_id is not null group by 1),
s as (select count(*) tp, sum(t) tl, sum(e) ne, count(*) filter (where t >= 2 and e = 0) fl, count(*) filter (where deep >= 2) bu from k)
select case when tp <= 0 then 'balanced' when tl <= tp or ne > greatest(1, tl) then 'top_level' when fl >= 1 and ne < greatest(1, fl) then 'reply' when bu >= greatest(1, tp // 2) then 'top_level' else 'balanced' end as structure_preference from s""")
def structure_preference(spark, d):
    rows = read_table(spark, d, "example_thread_format").select(F.concat(F.col("run_id"), F.lit("/"), F.col("post_id").cast("string")).alias("thread_id"), "comment_id", F.col("parent_comment_id").cast("string").alias("parent_id"), "depth").where("thread_id is not null").distinct()
    return E.structure_preference(T.thread_counters(rows.select("thread_id"), rows.where("comment_id is not null")))


@query("""with done as (select distinct user_id, event_type from events where cast(ts as date) = (select min(cast(ts as date)) from events))
select event_id from events e where user_id is not null and not exists (select 1 from done where done.user_id = e.user_id and done.event_type = e.event_type)""")
def pending_inputs(spark, d):
    """Events of users and types that the first day has none of."""
    e = read_table(spark, d, "events").where("user_id is not null").withColumn("day", F.to_date("ts"))
    first = e.agg(F.min("day").alias("day"))
    return E.pending(e, e.join(F.broadcast(first), "day"), ["user_id", "event_type"]).select("event_id")  # first is one row


@query(f"""with x as (select {_id('comment_id')} comment_id, min(struct_pack(a := coalesce(score, -2147483648), c := created_utc)) r, {_id('post_id')} thread_id from comments where comment_id is not null and created_utc is not null group by all)
select thread_id, comment_id, row_number() over (partition by thread_id order by r.a desc, r.c desc, comment_id) as place from x""")
def feed_order(spark, d):
    c = read_table(spark, d, "comments").where("comment_id is not null and created_utc is not null").groupBy(own_id("comment_id").alias("comment_id"), own_id("post_id").alias("thread_id")).agg(F.min(F.struct(F.coalesce("score", F.lit(-2147483648)).alias("score"), F.col("created_utc").alias("created"))).alias("r"))
    return E.by_score_and_time(c.select("comment_id", "thread_id", "r.score", "r.created")).select("thread_id", "comment_id", "place")


@query("""with p as (select product_id, '```json' || chr(10) || '{"id": ' || product_id || ', "tags": [1, 2,], }' || chr(10) || '```' raw from products) select product_id, product_id as parsed, 2 as n_tags from p""")
def tolerant_json(spark, d):
    raw = F.concat(F.lit('```json\n{"id": '), F.col("product_id").cast("string"), F.lit(', "tags": [1, 2,], }\n```'))
    j = X.json_object(raw)
    tags = F.from_json(F.get_json_object(j, "$.tags"), "array<int>")
    return read_table(spark, d, "products").select("product_id", F.get_json_object(j, "$.id").cast("long").alias("parsed"), F.size(tags).alias("n_tags"))


@query("select product_id, least(greatest(coalesce(price, 50), 20), 200) as bounded, case when rating is null or isnan(rating) then 'n/a' else printf('%.2f', rating) end as shown from products")
def bounded_and_shown(spark, d):
    return read_table(spark, d, "products").select("product_id", X.bounded(F.col("price"), 20, 200, 50).alias("bounded"), X.shown(F.col("rating"), 2).alias("shown"))


@query("""with w as (select date_trunc('hour', ts) h, event_type, count(*) n from events group by all), m as (select max(ts) m from events) select h as window_start, event_type, n from w, m where h + interval 1 hour <= m.m - interval 2 hours""")
def stream_closed_windows(spark, d):
    """In append mode a window comes out once the watermark, two hours behind, has passed it."""
    # nothing after the last trigger moves the watermark, so a second run over no new files puts the windows out
    stream = V.open_table(spark, d, "events")
    out = V.run_to_table(V.window_counts(stream, "1 hour", late="2 hours"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
