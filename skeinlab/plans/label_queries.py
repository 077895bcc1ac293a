"""Queries over scored comments, vectors, products and events, each with its SQL.

The test data has no model scores, so a formula over counts stands in for a provider; it exercises the aggregates and
says nothing about texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlab.functions.text import brand_of_url, word_count
from skeinlab.operators import calibration as C
from skeinlab.operators import labels as L
from skeinlab.operators import selection as P
from skeinlab.operators import threads as T
from skeinlab.operators import vectors as E
from skeinlab.plans.registry import Registry
from skeinlab.plans.thread_queries import GENERATED, _id, _words
from skeinlab.runtime import own_id, read_table
from skeinlab.sources import writers as K
from skeinlab.streaming import events as X

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql
PRIMES = (3, 5, 7, 11, 13, 17)


def _r(df, digits=6):
    return df.select(*[(F.round(F.col(c) + 1e-10, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scored(spark, d):
    c = T.generated_comments(read_table(spark, d, "example_thread_format"))
    h = F.coalesce("likes", F.lit(0)) * 37 + F.coalesce("dislikes", F.lit(0)) * 11 + word_count("text") * 13 + F.length("text")
    return c.withColumn("h", h).withColumn("ord", F.col("comment_id").cast("int")).withColumn("w", word_count("text"))


_S = f"{GENERATED}, s as (select *, coalesce(likes, 0) * 37 + coalesce(dislikes, 0) * 11 + {_words('text')} * 13 + length(text) h, cast(comment_id as int) ord, {_words('text')} w from g)"


def _a(e, name):
    return f"round({e} + 1e-10, 6) + 0.0 as {name}"


@query(f"""with {_S}, p as (select c.thread_id, c.comment_id, (c.h % 101) / 100.0 x, case c.h % 3 when 0 then 'agree' when 1 then 'neutral' else 'disagree' end as lab from s c join s q on q.thread_id = c.thread_id and q.comment_id = c.parent_id),
t as (select *, row_number() over (partition by thread_id order by x desc, comment_id) k from p)
select thread_id, count(*) as pair_count, {_a('avg(x)', 'mean_disagree_probability')}, {_a("avg((lab = 'disagree')::int)", 'hard_disagree_rate')}, count(*) filter (where lab = 'agree') as n_agree, count(*) filter (where lab = 'neutral') as n_neutral,
count(*) filter (where lab = 'disagree') as n_disagree, string_agg(comment_id, ',' order by k) filter (where k <= 5) as top_pairs from t group by 1""")
def stance_rates(spark, d):
    s = _scored(spark, d)
    pairs = s.join(s.select("thread_id", F.col("comment_id").alias("parent_id")), ["thread_id", "parent_id"])
    k = F.col("h") % 3
    pairs = pairs.select("thread_id", "comment_id", (F.col("h") % 101 / 100.0).alias("p_disagree"), F.when(k == 0, "agree").when(k == 1, "neutral").otherwise("disagree").alias("label"))
    return _r(L.stance(pairs))


@query(f"""with {_S}, x as (select thread_id, (h % 101) / 100.0 p from s) select thread_id, count(*) filter (where p >= 0.5) as story_count, count(*) filter (where p < 0.5) as not_story_count, {_a('avg((p >= 0.5)::int)', 'story_rate')},
{_a('avg(p)', 'mean_story_probability')}, {_a('median(p)', 'median_story_probability')}, {_a('max(p)', 'max_story_probability')}, {_a('min(p)', 'min_story_probability')} from x group by 1""")
def story_rates(spark, d):
    return _r(L.story(_scored(spark, d).withColumn("p_story", F.col("h") % 101 / 100.0)))


@query(f"""with {_S}, x as (select thread_id, 'e' || (h % 7) lab, 1 + h % 3 nl, ord, lag('e' || (h % 7)) over (partition by thread_id order by ord) prev from s),
c as (select thread_id, lab, count(*) n, min(ord) f, sum(count(*)) over (partition by thread_id) t from x group by thread_id, lab),
e as (select thread_id, -sum(n / t * ln(n / t)) + 0.0 h, arg_min(lab, (-n, f)) dom, max(n / t) share from c group by 1)
select e.thread_id, {_a('any_value(e.h)', 'emotion_entropy')}, any_value(e.dom) as dominant_emotion, {_a('any_value(e.share)', 'dominant_emotion_share')}, {_a('avg(nl)', 'avg_labels_per_comment')},
{_a('coalesce(avg(case when prev is not null then (prev <> lab)::int end), 0)', 'emotion_shift_rate')}, {_a('any_value(e.h) / ln(28)', 'emotion_entropy_normalized')} from x join e using (thread_id) group by e.thread_id""")
def emotion_profile(spark, d):
    s = _scored(spark, d).select("thread_id", F.concat(F.lit("e"), (F.col("h") % 7).cast("string")).alias("label"), (1 + F.col("h") % 3).alias("n_labels"), "ord")
    return _r(L.emotion(s))


_POL = ("polite", "somewhat_polite", "neutral", "impolite")


@query(f"with {_S} select thread_id, " + ", ".join(f"count(*) filter (where h % 4 = {i}) as {x}_count, {_a(f'avg((h % 4 = {i})::int)', x + '_rate')}" for i, x in enumerate(_POL)) + " from s group by 1")
def politeness_rates(spark, d):
    lab = F.element_at(F.array(*[F.lit(x) for x in _POL]), (F.col("h") % 4 + 1).cast("int"))
    return _r(L.politeness(_scored(spark, d).withColumn("label", lab)))


_TOX = ", ".join(f"((h * {k}) % 101) / 101.0 as {t}" for k, t in zip(PRIMES, L.TOXICITY))
_TOXES = (*L.TOXICITY, "aggression_score")


def _toxic(spark, d):
    return _scored(spark, d).select("thread_id", "comment_id", *[(F.col("h") * k % 101 / 101.0).alias(t) for k, t in zip(PRIMES, L.TOXICITY)])


@query(f"with {_S}, x as (select thread_id, {_TOX} from s), y as (select *, ({' + '.join(L.TOXICITY)}) / 6 aggression_score from x) select thread_id, "
       + ", ".join(f"{_a(f'avg({t})', t + '_mean')}, {_a(f'max({t})', t + '_max')}, {_a(f'quantile_cont({t}, 0.9)', t + '_p90')}" for t in _TOXES) + " from y group by 1")
def toxicity_profile(spark, d):
    return _r(L.toxicity(_toxic(spark, d)))


_SOME = [f"{t}_{s}" for t in ("toxicity", "threat", "aggression_score") for s in ("mean", "max", "p90")]


@query(f"with {_S}, x as (select thread_id, {_TOX} from s), y as (select *, ({' + '.join(L.TOXICITY)}) / 6 aggression_score from x), t as (select thread_id, count(*) n, "
       + ", ".join(f"avg({t}) {t}_mean, max({t}) {t}_max, quantile_cont({t}, 0.9) {t}_p90" for t in ("toxicity", "threat", "aggression_score")) + " from y group by 1), u as ("
       + " union all ".join(f"select '{m}' metric, n, {m} v from t" for m in _SOME) + f") select metric, count(*) as threads, {_a('avg(v)', 'mean')}, {_a('median(v)', 'median')}, {_a('max(v)', 'most')}, {_a('sum(v * n) / sum(n)', 'weighted_mean')} from u group by 1")
def overall_rollup(spark, d):
    x = _toxic(spark, d)
    t = L.toxicity(x).join(x.groupBy("thread_id").agg(F.count("*").alias("n")), "thread_id")
    return _r(L.overall(t, _SOME, "n"))


@query(f"""with {_S}, a as (select thread_id, count(*) n, avg((h % 101) / 100.0) p from s group by 1), b as (select thread_id, count(*) k, max(w) w from s where h % 2 = 0 group by 1)
select coalesce(a.thread_id, b.thread_id) as thread_id, coalesce(a.n, b.k) as comment_count, {_a('a.p', 'mean_story_probability')}, b.w as longest from a full join b on a.thread_id = b.thread_id""")
def wide_metric_join(spark, d):
    s = _scored(spark, d)
    a = s.groupBy("thread_id").agg(F.count("*").alias("comment_count"), F.avg(F.col("h") % 101 / 100.0).alias("mean_story_probability"))
    b = s.where("h % 2 = 0").groupBy("thread_id").agg(F.count("*").alias("comment_count"), F.max("w").alias("longest"))
    return _r(L.wide([a, b]))


def _vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("label").cast("string").alias("thread_id"), F.col("vec_id").alias("vec_id"), F.col("embedding").alias("vector"))


@query("""with v as (select cast(label as varchar) t, vec_id, list_transform(embedding, lambda x: x::double) e from embeddings), n as (select t, vec_id, e, sqrt(list_dot_product(e, e)) z from v),
p as (select a.t, least(1, greatest(-1, list_dot_product(a.e, b.e) / (greatest(a.z, 1e-12) * greatest(b.z, 1e-12)))) c from n a join n b on a.t = b.t and a.vec_id < b.vec_id), r as (select *, row_number() over (partition by t order by c desc) k from p)
select t as thread_id, count(*) as pairs, round(avg(c), 6) as mean_cosine, round(min(c), 6) as min_cosine, round(avg(c) filter (where k <= 10), 6) as top_k_mean_cosine, round(max(c), 6) as max_cosine, round(median(c), 6) as median_cosine, round(quantile_cont(c, 0.9), 6) as p90_cosine from r group by 1""")
def semantic_uniformity(spark, d):
    x = E.pair_cosines(_vectors(spark, d))
    return x.select("thread_id", "pairs", *[F.round(c, 6).alias(c) for c in x.columns if c.endswith("cosine")])


_SHOTS = "which camera has decent battery and good grip for travelling"


@query(f"""with p as (select {_id('post_id')} post_id, arg_min(struct_pack(subreddit, title, selftext), (retrieved_at, title)) r from posts group by 1),
c as (select {_id('post_id')} post_id, {_id('comment_id')} cid, min(body) b, min(score) s from comments where body is not null group by all),
k as (select post_id, list(b order by cid) bs from c group by 1),
t as (select p.post_id, r.subreddit, r.title, r.selftext body, coalesce(k.bs, []) bs from p left join k using (post_id) where p.post_id is not null),
x as (select *, concat_ws(chr(10), subreddit, title, body, array_to_string(bs[1:4], ' ')) txt from t),
z as (select post_id, title, body, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(txt), '[a-z0-9]+'), lambda w: length(w) >= 2)), {_SHOTS.split()!r})) + least(len(bs), 4) * 0.5 + case when contains(concat_ws(chr(10), title, body), '?') then 0.5 else 0 end score from x),
s1 as (select *, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) tt, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) bb from z),
dd as (select * from s1 qualify row_number() over (partition by lower(case when length(tt) > 100 then rtrim(tt[1:99]) || '…' else tt end), lower(case when length(bb) > 140 then rtrim(bb[1:139]) || '…' else bb end) order by score desc, md5(post_id), post_id) = 1)
select post_id as thread_id, round(score, 3) as score, row_number() over (order by score desc, md5(post_id), post_id) as place from dd order by score desc, md5(post_id), post_id limit 8""")
def few_shot_examples(spark, d):
    p = read_table(spark, d, "posts").select(own_id("post_id").alias("thread_id"), "subreddit", "title", "selftext", "retrieved_at").where("thread_id is not null")
    p = p.groupBy("thread_id").agg(F.min_by(F.struct("subreddit", "title", "selftext"), F.struct("retrieved_at", "title")).alias("r")).select("thread_id", "r.subreddit", "r.title", F.col("r.selftext").alias("body"))
    c = read_table(spark, d, "comments").where("body is not null").groupBy(own_id("post_id").alias("thread_id"), own_id("comment_id").alias("cid")).agg(F.min("body").alias("b"))
    in_part = Window.partitionBy("thread_id", F.pmod(F.xxhash64("cid"), F.lit(64))).orderBy("cid")  # the first four of each part of a thread, then of the thread
    few = c.withColumn("n", F.row_number().over(in_part)).where("n <= 4").groupBy("thread_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("cid", "b"))), 1, 4).alias("found"))
    k = few.select("thread_id", F.transform("found", lambda x: x.b).alias("comments"))
    return P.few_shot(p.join(k, "thread_id", "left"), _SHOTS).select("thread_id", F.round("score", 3).alias("score"), "place")


@query("""with p as (select product_id, price, row_number() over (order by price, product_id) - 1 i, count(*) over () n from products where price is not null), k as (select unnest(range(20)) k)
select product_id, round(price, 2) as price from p join k on p.i = floor(k.k * p.n / 20)""")
def stratified_sample(spark, d):
    return P.stratified(read_table(spark, d, "products"), "price", "product_id", 20).select("product_id", F.round("price", 2).alias("price"))


@query()
def weighted_sample(spark, d):
    return P.weighted_sample(read_table(spark, d, "products").select("product_id", F.col("review_count").cast("double").alias("weight")), "weight", 20, 11)


@query("select event_type, cast(floor(value / 10) as bigint) as batch, count(*) as n from events group by all")
def delay_batches(spark, d):
    return P.batches(read_table(spark, d, "events"), "value", 10.0).groupBy("event_type", "batch").agg(F.count("*").alias("n"))


@query("""with u as (select product_id, case product_id % 4 when 0 then 'https://www.Chase.com/cards/' when 1 then 'http://current.com' when 2 then 'https://delta.com/x?y=1' else 'https://unknown.example/' end url, brand from products)
select product_id, coalesce(nullif(brand, ''), case product_id % 4 when 0 then 'Chase' when 1 then 'Current' when 2 then 'Delta' end) as brand, case product_id % 4 when 0 then 'Chase' when 1 then 'Current' when 2 then 'Delta' end as url_brand from u""")
def brand_from_url(spark, d):
    k = F.col("product_id") % 4
    url = F.when(k == 0, "https://www.Chase.com/cards/").when(k == 1, "http://current.com").when(k == 2, "https://delta.com/x?y=1").otherwise("https://unknown.example/")
    p = read_table(spark, d, "products")
    return p.select("product_id", F.coalesce(F.nullif("brand", F.lit("")), brand_of_url(url)).alias("brand"), brand_of_url(url).alias("url_brand"))


_PRODUCTS = "select product_id, nullif(trim(title), '') as title, nullif(trim(brand), '') as brand, price, case when length(coalesce(description, '')) > 500 then substring(description, 1, 500) || '...' else coalesce(description, '') end as description, rating, review_count, array_to_string(list_filter(coalesce(features, []), lambda x: x is not null and x <> '')[1:6], '|') as features from products"


@query(_PRODUCTS)
def normalized_products(spark, d):
    p = read_table(spark, d, "products")
    about = F.coalesce("description", F.lit(""))
    return p.select(
        "product_id", F.nullif(F.trim("title"), F.lit("")).alias("title"), F.nullif(F.trim("brand"), F.lit("")).alias("brand"), "price",
        F.when(F.length(about) > 500, F.concat(F.substring(about, 1, 500), F.lit("..."))).otherwise(about).alias("description"), "rating", "review_count",
        F.array_join(F.slice(F.filter(F.coalesce("features", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), 1, 6), "|").alias("features"),
    )


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, round(arg_max(value, (ts, event_id)), 6) as value, max(ts) as ts from events group by 1")
def latest_upsert(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return C.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", F.round("value", 6).alias("value"), "ts")


@query("""with l as (select user_id, max(struct_pack(ts, event_id)) filter (where event_type = 'purchase') x from events group by 1)
select e.user_id, count(*) filter (where l.x is null or struct_pack(ts, event_id) > l.x) as misses from events e join l using (user_id) group by 1""")
def trailing_misses(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "purchase").alias("won"))
    return C.trailing_misses(e, "user_id", "at", "won")


@query("""with p(name, first, last) as (values ('early', 0, 3), ('middle', 4, 6), ('late', 7, 9)) select event_id, coalesce(p.name, 'late') as phase from events left join p on hour(ts) between p.first and p.last""")
def phase_ranges(spark, d):
    phases = spark.createDataFrame([("early", 0, 3), ("middle", 4, 6), ("late", 7, 9)], "name string, first int, last int")
    e = read_table(spark, d, "events").select("event_id", F.hour("ts").alias("h"))
    return C.in_range(e, "h", phases, "late").select("event_id", F.col("name").alias("phase"))


@query("select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as last_type, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) + 0.0 as change from events")
def change_from_previous(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("last_type"), (F.round(F.col("value") - F.lag("value").over(w), 6) + 0.0).alias("change"))


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_window_counts(spark, d):
    out = X.run_to_table(X.window_counts(X.open_table(spark, d, "events"), late="3650 days"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with l as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from l)
select min(ts) as session_start, user_id, count(*) as n from s group by user_id, k""")
def session_windows(spark, d):
    e = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.sessions(e).select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), "user_id", "n")


@query("select count(*) as n_keys from (select distinct user_id, event_type from events)")
def stream_first_seen(spark, d):
    out = X.run_to_table(X.first_seen(X.open_table(spark, d, "events"), ["user_id", "event_type"], "3650 days").select("user_id", "event_type", "ts"))
    return out.agg(F.count("*").alias("n_keys"))


@query("""with recursive o as (select user_id, ts, row_number() over (partition by user_id order by ts) k from events),
a as (select user_id, ts, ts last from o where k = 1 union all select a.user_id, n.ts, n.ts from a, lateral (select min(o.ts) ts from o where o.user_id = a.user_id and o.ts >= a.last + interval 60 minutes) n where n.ts is not null) select user_id, ts from a""")
def stream_cooldown(spark, d):
    out = X.run_to_table(X.cooled(X.open_table(spark, d, "events")))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("select model, count(*) as n_threads, sum(n) as n_lines from (select run_id || '/' || cast(post_id as varchar) t, any_value(model) as model, count(distinct coalesce(comment_id, -1)) n from example_thread_format group by 1) group by 1")
def markdown_export(spark, d):
    """Lines of the Markdown page of every thread, counted per model."""
    rows = read_table(spark, d, "example_thread_format").withColumn("thread_id", F.concat_ws("/", "run_id", F.col("post_id").cast("string"))).dropDuplicates(["thread_id", "comment_id"])
    posts = rows.where("comment_id is null")
    lines = K.markdown_lines(posts, rows.where("comment_id is not null").withColumn("ord", F.col("comment_id")).withColumn("depth", F.coalesce("depth", F.lit(0))))
    models = rows.groupBy("thread_id").agg(F.min("model").alias("model"))
    return lines.where("line is not null").join(models, "thread_id").groupBy("model").agg(F.countDistinct("thread_id").alias("n_threads"), F.count("*").alias("n_lines"))
