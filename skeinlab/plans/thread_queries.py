"""Queries over threads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions import text as X
from skeinlab.operators import diversity as V
from skeinlab.operators import threads as T
from skeinlab.plans.registry import Registry
from skeinlab.runtime import own_id, read_table

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql


def _crawled(spark, d):
    return T.crawled_comments(read_table(spark, d, "comments"))


def _generated(spark, d):
    return T.generated_comments(read_table(spark, d, "example_thread_format"))


def _rounded(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _ref(c):
    """A reference, compared without case and blanks around."""
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def _id(c):
    """The id that an id or reference names: t1_x and t3_x name x."""
    return f"nullif(case when {_ref(c)}[1:3] in ('t1_', 't3_') then {_ref(c)}[4:] else {_ref(c)} end, '')"


def _clean(c):
    t = f"trim(regexp_replace(coalesce({c}, ''), '{X.BLANKS}', ' ', 'g'))"
    return f"case when lower({t}) in ('[deleted]', '[removed]', 'deleted', 'removed') then '' else {t} end"


def _words(c):
    return f"(case when {c} = '' then 0 else len(string_split({c}, ' ')) end)"


CRAWLED = f"""c0 as (select {_id('post_id')} thread_id, {_id('comment_id')} comment_id, {_id('parent_id')} parent_id,
  case {_ref('parent_id')}[1:3] when 't1_' then 't1' when 't3_' then 't3' end parent_type,
  author, {_clean('body')} as text, created_utc created, retrieved_at, post_title title from comments),
c as (select * from c0 where comment_id is not null and {_words('text')} >= 2 qualify row_number() over (partition by comment_id order by retrieved_at, text, coalesce(title, '')) = 1)"""

GENERATED = f"""g0 as (select run_id || '/' || cast(post_id as varchar) thread_id, cast(comment_id as varchar) comment_id, cast(parent_comment_id as varchar) parent_id, author,
  {_clean('content')} as text, model, product_category, likes, dislikes from example_thread_format where comment_id is not null),
g as (select * from g0 where {_words('text')} >= 2 qualify row_number() over (partition by thread_id, comment_id order by parent_id nulls first, author nulls first, text, model nulls first, product_category nulls first, likes nulls first, dislikes nulls first) = 1)"""

OVERLAP = """list_filter(list_transform(string_split(trim(regexp_replace(lower(replace(text, '’', '''')), '%s', ' ', 'g')), ' '),
  lambda w: regexp_replace(regexp_replace(w, '[^\\p{L}\\p{N}'']+', '', 'g'), '^''+|''+$', '', 'g')), lambda w: length(w) >= 3 and not list_contains([%s], w))""" % (
    X.BLANKS, ", ".join(f"'{w}'" for w in X.STOPWORDS)
)

TREE = """kept as (select k.thread_id, k.comment_id, p.comment_id parent from {c} k left join {c} p on p.thread_id = k.thread_id and p.comment_id = k.parent_id),
walk as (select thread_id, comment_id, comment_id root, 1 depth from kept where parent is null
  union all select k.thread_id, k.comment_id, w.root, w.depth + 1 from kept k join walk w on w.thread_id = k.thread_id and w.comment_id = k.parent),
d as (select k.*, w.depth, w.root from kept k left join walk w using (thread_id, comment_id))"""


@query(f"with {CRAWLED} select thread_id, comment_id, text, {_words('text')} as words from c")
def thread_comments(spark, d):
    return _crawled(spark, d).select("thread_id", "comment_id", "text", X.word_count("text").alias("words"))


@query(f"""with {CRAWLED}, w as (select thread_id, {_words('text')} w from c)
select thread_id, count(*) as comment_count, round(avg(w), 6) as length_mean, round(stddev_pop(w), 6) + 0.0 as length_std,
round(quantile_cont(w, 0.75) - quantile_cont(w, 0.25), 6) + 0.0 as length_iqr, round(coalesce(stddev_pop(w) / nullif(avg(w), 0), 0), 6) + 0.0 as length_cv from w group by 1""")
def thread_length_stats(spark, d):
    return _rounded(T.length_stats(_crawled(spark, d)))


@query(f"with recursive {CRAWLED}, {TREE.format(c='c')} select thread_id, coalesce(max(depth), 0) as max_depth, round(coalesce(avg(depth), 0), 6) as avg_depth from d group by 1")
def thread_depth(spark, d):
    return _rounded(T.depth_stats(T.depths(_crawled(spark, d))))


@query(f"""with recursive {CRAWLED}, {TREE.format(c='c')}, b as (select thread_id, parent, count(*) n from d where parent is not null group by all)
select d.thread_id, round(coalesce(avg(b.n), 0), 6) as avg_branching_factor from (select distinct thread_id from d) d left join b using (thread_id) group by 1""")
def thread_branching(spark, d):
    return _rounded(T.branching(T.depths(_crawled(spark, d))))


_VIRALITY = """up as (select thread_id, comment_id v, comment_id x, 0 k from d where depth is not null
  union all select up.thread_id, up.v, d.parent, up.k + 1 from up join d on d.thread_id = up.thread_id and d.comment_id = up.x where d.parent is not null),
dist as (select a.thread_id, a.v v, b.v w, min(a.k + b.k) k from up a join up b on a.thread_id = b.thread_id and a.x = b.x and a.v < b.v group by all),
vir as (select t.thread_id, round(coalesce(avg(dist.k), 0), 6) as structural_virality from (select distinct thread_id from d) t left join dist using (thread_id) group by 1)"""


@query(f"with recursive {GENERATED}, {TREE.format(c='g')}, {_VIRALITY} select thread_id, structural_virality from vir")
def structural_virality(spark, d):
    """Against the mean over all pairs of comments, by brute force."""
    return _rounded(T.structural_virality(_generated(spark, d)))


@query(f"""with recursive {GENERATED}, {TREE.format(c='g')}, {_VIRALITY}, w as (select thread_id, {_words('text')} w from g),
l as (select thread_id, count(*) as comment_count, round(stddev_pop(w), 6) + 0.0 as length_std, round(quantile_cont(w, 0.75) - quantile_cont(w, 0.25), 6) + 0.0 as length_iqr,
  round(coalesce(stddev_pop(w) / nullif(avg(w), 0), 0), 6) + 0.0 as length_cv from w group by 1),
s as (select thread_id, coalesce(max(depth), 0) as max_depth, round(coalesce(avg(depth), 0), 6) as avg_depth from d group by 1),
b0 as (select thread_id, parent, count(*) n from d where parent is not null group by all), b as (select thread_id, avg(n) n from b0 group by 1)
select l.*, s.max_depth, s.avg_depth, round(coalesce(b.n, 0), 6) as avg_branching_factor, vir.structural_virality from l join s using (thread_id) left join b using (thread_id) join vir using (thread_id)""")
def thread_structure(spark, d):
    return _rounded(T.thread_structure(_generated(spark, d)))


@query(f"""with {CRAWLED}, p as (select c.thread_id, c.comment_id, c.parent_id, p.text parent_text, c.text reply_text, 'comment' parent_kind from c join c p on p.comment_id = c.parent_id where c.parent_type = 't1' or c.parent_type is null
  union all select thread_id, comment_id, parent_id, {_clean('title')}, text, 'post' from c where parent_type = 't3' or (parent_type is null and parent_id = thread_id and parent_id not in (select comment_id from c)))
select * from p where {_words('parent_text')} >= 3 and {_words('reply_text')} >= 2""")
def reply_pairs(spark, d):
    return T.reply_pairs(_crawled(spark, d))


def _post_titles():
    return f"(select {_id('post_id')} post_id, min(struct_pack(a := retrieved_at is null, b := retrieved_at, c := title is null, title)).title title from posts group by 1)"


@query(f"select {_id('c.comment_id')} as comment_id, {_id('c.post_id')} as post_id, coalesce(p.title, '') as title from comments c left join {_post_titles()} p on p.post_id = {_id('c.post_id')}")
def comment_post_titles(spark, d):
    return T.comments_with_titles(read_table(spark, d, "comments"), read_table(spark, d, "posts"))


_BLEU_TOKENS = "list_transform(regexp_extract_all(text, '%s'), lambda w: lower(w))" % X.BLEU_TOKEN.replace("'", "''")
_SELF_BLEU = f"""t as (select thread_id, comment_id, {_BLEU_TOKENS} t from g),
n as (select thread_id, comment_id, len(t) n from t),
grams as (select thread_id, comment_id, k.k, array_to_string(t[i.i : i.i + k.k - 1], chr(1)) gram, count(*) c from t, (values (1), (2), (3), (4)) k(k), generate_series(1, len(t) - k.k + 1) i(i) group by all),
o as (select a.thread_id, a.comment_id a, b.comment_id b, a.k, sum(least(a.c, b.c)) o from grams a join grams b on a.thread_id = b.thread_id and a.k = b.k and a.gram = b.gram and a.comment_id < b.comment_id group by all),
p as (select x.thread_id, x.comment_id a, y.comment_id b, x.n na, y.n nb from n x join n y on x.thread_id = y.thread_id and x.comment_id < y.comment_id),
q as (select p.*, m.m, s.side, case s.side when 1 then na else nb end h, case s.side when 1 then nb else na end r from p, (values (2), (3), (4)) m(m), (values (1), (2)) s(side)),
e as (select q.thread_id, q.a, q.b, q.m, q.side, q.h, q.r, sum(ln((coalesce(o.o, 0) + 1.0) / (greatest(q.h - k.k + 1, 0) + 1.0)) / q.m) l
  from q join (values (1), (2), (3), (4)) k(k) on k.k <= q.m left join o on o.thread_id = q.thread_id and o.a = q.a and o.b = q.b and o.k = k.k group by all),
bleu as (select thread_id, a, b, m, avg(case when h = 0 or r = 0 then 0 else (case when h > r then 1 else exp(1 - r / h) end) * exp(l) end) v from e group by all)"""


@query(f"""with {GENERATED}, {_SELF_BLEU}, z as (select thread_id, count(*) n, avg(n) mt, median(n) md from n group by 1)
select z.thread_id, z.n as comment_count, z.n * (z.n - 1) / 2 as pair_count, round(coalesce(avg(v) filter (where m = 2), 0), 6) as self_bleu_2, round(coalesce(avg(v) filter (where m = 3), 0), 6) as self_bleu_3,
round(coalesce(avg(v) filter (where m = 4), 0), 6) as self_bleu_4, round(mt, 6) as mean_comment_tokens, round(md, 6) as median_comment_tokens
from z left join bleu using (thread_id) group by z.thread_id, z.n, mt, md""")
def self_bleu(spark, d):
    return _rounded(V.self_bleu(_generated(spark, d)))


@query(f"""with {GENERATED}, {_SELF_BLEU}, s as (select thread_id, a comment_id, m, v from bleu union all select thread_id, b, m, v from bleu)
select n.thread_id, n.comment_id, count(*) over (partition by n.thread_id) as n, round(coalesce(avg(v) filter (where m = 2), 0), 6) as self_bleu_2, round(coalesce(avg(v) filter (where m = 3), 0), 6) as self_bleu_3,
round(coalesce(avg(v) filter (where m = 4), 0), 6) as self_bleu_4 from n left join s using (thread_id, comment_id) group by n.thread_id, n.comment_id""")
def comment_self_bleu(spark, d):
    return _rounded(V.comment_self_bleu(_generated(spark, d)))


_REPEATED = """, n as (select thread_id, count(*) n from g group by 1),
k as (select thread_id, term, count(distinct comment_id) docs, count(*) total from u group by all),
r as (select k.*, row_number() over (partition by k.thread_id order by docs desc, total desc, {tie} term desc) place from k join n using (thread_id)
  where docs >= (case when n < 6 then 2 else 3 end) and total >= (case when n < 6 then 2 else 3 end))
select thread_id, place, term, docs, total from r where place <= {limit}"""


@query(f"with {GENERATED}, u as (select thread_id, comment_id, unnest({OVERLAP}) term from g)" + _REPEATED.format(tie="", limit=7))
def repeated_terms(spark, d):
    return V.repeated_terms(_generated(spark, d))


@query(f"""with {GENERATED}, o as (select thread_id, comment_id, {OVERLAP} t from g),
u as (select thread_id, comment_id, array_to_string(t[i.i : i.i + k.k - 1], ' ') term from o, (values (2), (3)) k(k), generate_series(1, len(t) - k.k + 1) i(i)
  where len(list_filter(t[i.i : i.i + k.k - 1], lambda w: not list_contains([{', '.join(f"'{w}'" for w in X.LOW_SIGNAL)}], w))) > 0)""" + _REPEATED.format(tie="len(string_split(term, ' ')) desc,", limit=5))
def repeated_phrases(spark, d):
    return V.repeated_phrases(_generated(spark, d))


@query(f"""with {GENERATED}, o as (select thread_id, {OVERLAP} t from g), f as (select thread_id, array_to_string(t[1:6], ' ') o, count(*) c from o where len(t) > 0 group by all)
select n.thread_id, round(coalesce(max(f.c) / n.n, 0), 6) as opening_ratio from (select thread_id, count(*) n from g group by 1) n left join f using (thread_id) group by n.thread_id, n.n""")
def opening_ratio(spark, d):
    return _rounded(V.opening_ratio(_generated(spark, d)))


@query(f"""with {GENERATED}, o as (select thread_id, comment_id, list_distinct({OVERLAP}) t from g),
j as (select a.thread_id, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) v from o a join o b on a.thread_id = b.thread_id and a.comment_id < b.comment_id where len(a.t) > 0 and len(b.t) > 0)
select n.thread_id, round(coalesce(avg(j.v), 0), 6) as token_jaccard from (select distinct thread_id from g) n left join j using (thread_id) group by 1""")
def token_jaccard(spark, d):
    return _rounded(V.mean_overlap(_generated(spark, d)))


_STYLE = " union all ".join(f"select thread_id, '{s}' as signal from c where regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for s, p in X.STYLE_PATTERNS.items())


@query(f"""with {CRAWLED}, s as ({_STYLE} union all select thread_id, 'short blunt replies' from c where len(regexp_extract_all(lower(text), '[a-z0-9'']+')) <= 12)
select thread_id, signal, count(*) as n, row_number() over (partition by thread_id order by count(*) desc, signal) as place from s group by 1, 2""")
def style_signals(spark, d):
    return V.style_signals(_crawled(spark, d))


def _stored(spark, d):
    rows = read_table(spark, d, "example_thread_format").select(F.concat_ws("/", "run_id", F.col("post_id").cast("string")).alias("thread_id"), "comment_id", F.col("parent_comment_id").cast("string").alias("parent_id"), "depth").distinct()
    return rows.where("comment_id is null").select("thread_id"), rows.where("comment_id is not null")


@query("""with r as (select distinct run_id || '/' || cast(post_id as varchar) thread_id, comment_id, parent_comment_id p, depth from example_thread_format),
t as (select distinct thread_id from r where comment_id is null),
s as (select t.thread_id, count(r.comment_id) n, count(*) filter (where r.comment_id is not null and (p is null or p = 0)) top, count(*) filter (where r.comment_id is not null and p is not null and p <> 0) nested,
  coalesce(max(coalesce(r.depth, 0)), 0) deep from t left join r on r.thread_id = t.thread_id and r.comment_id is not null group by 1)
select count(*) as total_posts, count(*) filter (where n <= 1) as sparse_posts, sum(n) as total_comments, sum(top) as top_level_comments, sum(nested) as nested_comments,
count(*) filter (where deep >= 2) as buried_threads, count(*) filter (where top >= 2 and nested = 0) as flat_threads, max(deep) as max_depth from s""")
def thread_counters(spark, d):
    return T.thread_counters(*_stored(spark, d))


@query("""with r as (select product_id, post_id, row_number() over (partition by product_id order by coalesce(is_relevant, false) desc, search_rank nulls last, num_comments desc nulls last, score desc nulls last, post_id) ordinal
  from (select distinct product_id, post_id, is_relevant, search_rank, num_comments, score from posts)) select product_id, post_id, ordinal from r where ordinal <= 10""")
def ranked_posts(spark, d):
    p = read_table(spark, d, "posts").select("product_id", "post_id", "is_relevant", "search_rank", "num_comments", "score").distinct()
    return T.ranked_posts(p, 10).select("product_id", "post_id", "ordinal")


@query(f"""with r as (select distinct {_id('post_id')} post_id, {_id('comment_id')} comment_id, depth, score, created_iso from comments),
o as (select *, row_number() over (partition by post_id order by depth nulls last, score desc nulls last, created_iso nulls last, comment_id) ordinal from r) select post_id, comment_id, ordinal from o where ordinal <= 5""")
def ranked_comments(spark, d):
    c = read_table(spark, d, "comments").select(own_id("post_id").alias("post_id"), own_id("comment_id").alias("comment_id"), "depth", "score", "created_iso").distinct()
    return T.ranked_comments(c, 5).select("post_id", "comment_id", "ordinal")


@query(f"""with recursive {GENERATED}, {TREE.format(c='g')}, m as (select thread_id, max(depth) deep, count(depth) n from d group by 1) select thread_id, n as n_nested, deep as levels from m where n > 0""")
def nested_reply_trees(spark, d):
    """The nested JSON holds every reached comment, as deep as the tree."""
    n = T.nested_replies(_generated(spark, d))
    opened = F.size(F.regexp_extract_all("tree", F.lit('"comment_id":'), F.lit(0)))
    steps = F.regexp_extract_all("tree", F.lit(r'"replies":\[|\]\}'), F.lit(0))
    level = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), lambda a, s: F.when(s == "]}", F.struct((a.at - 1).alias("at"), a.most.alias("most"))).otherwise(F.struct((a.at + 1).alias("at"), F.greatest(a.most, a.at + 1).alias("most"))), lambda a: a.most)
    return n.select("thread_id", opened.alias("n_nested"), level.alias("levels"))


@query(f"select product_id, case when length(t) > 60 then concat(rtrim(substring(t, 1, 59)), '…') else t end as short_text, trim(regexp_replace(regexp_replace(lower(coalesce(brand, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as label, "
       f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda w: length(w) >= 2))) as terms from (select *, trim(regexp_replace(coalesce(description, ''), '{X.BLANKS}', ' ', 'g')) t from products)")
def text_functions(spark, d):
    p = read_table(spark, d, "products")
    return p.select("product_id", X.truncate("description", 60).alias("short_text"), F.trim(X.canonical_label(F.coalesce("brand", F.lit("")))).alias("label"), F.sort_array(X.retrieval_tokens("title")).alias("terms"))
