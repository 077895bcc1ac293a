"""Queries of the general training-data problems (references, hierarchies) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.operators import hierarchy as H
from skeinlab.operators import references as R
from skeinlab.runtime import read_table


def _tables(spark, d, *names):
    return [read_table(spark, d, n) for n in names]


def p1_found(spark, d):
    return R.dangling_references(*_tables(spark, d, "comments", "posts", "removals")).select("ref_field", "comment_id", "kind")


def p1_counts(spark, d):
    return R.dangling_counts(R.dangling_references(*_tables(spark, d, "comments", "posts", "removals")))


def p2_found(spark, d):
    return H.hierarchy_problems(*_tables(spark, d, "comments", "posts"))


def p2_paths(spark, d):
    h = H.hierarchy(*_tables(spark, d, "comments", "posts"))
    return h.select("comment_id", "root", "depth", "state", F.concat_ws("/", "path").alias("path"))


def p2_descendants(spark, d):
    return H.descendants(H.hierarchy(*_tables(spark, d, "comments", "posts")))


def queries():
    return {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_paths, p2_descendants)}


def _clean(c):
    return f"nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"


def _named(c):
    return f"nullif(regexp_replace({_clean(c)}, '^t[13]_', ''), '')"


def _type(c):
    return f"case when {_clean(c)} like 't1\\_%' escape '\\' then 't1' when {_clean(c)} like 't3\\_%' escape '\\' then 't3' end"


_P1 = f"""
with c as (select {_clean('comment_id')} comment_id, min(retrieved_at) seen, strftime(to_timestamp(min(created_utc)) at time zone 'UTC', '%Y-%m') as month
           from comments group by 1 having {_clean('comment_id')} is not null),
r as (select distinct 'parent_id' ref_field, {_clean('comment_id')} comment_id, {_type('parent_id')} t, {_named('parent_id')} id from comments
      union select distinct 'post_fullname', {_clean('comment_id')}, {_type('post_fullname')}, {_named('post_fullname')} from comments),
k as (select {_clean('comment_id')} id, 't1' t, min(retrieved_at) first from comments group by 1
      union all select {_clean('post_id')}, 't3', min(retrieved_at) from posts group by 1),
n0 as (select distinct {_type('fullname')} t, {_named('fullname')} id from removals),
n as (select id, t from n0 where t is not null and id is not null
      union select n0.id, x.t from n0 cross join (values ('t1'), ('t3')) x(t) where n0.t is null and n0.id is not null
        and (exists (select 1 from k where k.id = n0.id and k.t = x.t) or not exists (select 1 from k where k.id = n0.id))),
rr as (select ref_field, comment_id, id, t, t bare from r where t is not null and id is not null
       union all select r.ref_field, r.comment_id, r.id, x.t, null from r cross join (values ('t1'), ('t3')) x(t) where r.t is null and r.id is not null
        and (exists (select 1 from k where k.id = r.id and k.t = x.t) or not exists (select 1 from k where k.id = r.id))),
per as (select rr.ref_field, rr.comment_id, rr.id, rr.bare, bool_or(n.id is not null) gone, bool_or(k.id is not null) there, min(k.first) first
        from rr left join n on n.id = rr.id and n.t = rr.t left join k on k.id = rr.id and k.t = rr.t group by all),
f as (select per.ref_field, per.comment_id, c.month, max(case when gone then 3 when not there then 2 when first > c.seen then 1 else 0 end) s
      from per join c using (comment_id) group by all)
"""

_P2 = f"""
with recursive one as (select {_clean('comment_id')} comment_id, arg_min({_clean('parent_id')}, retrieved_at) filter (where {_clean('parent_id')} is not null) ref,
                arg_min(depth, retrieved_at) filter (where depth is not null) stored
         from comments group by 1 having {_clean('comment_id')} is not null),
ps as (select distinct {_clean('post_id')} id from posts),
a as (select comment_id, stored, {_type('ref')} t, {_named('ref')} id from one),
nodes as (select a.comment_id, a.stored, c.comment_id parent, case when c.comment_id is null then ps.id end post
          from a left join a c on c.comment_id = a.id and coalesce(a.t, 't1') = 't1' left join ps on ps.id = a.id and coalesce(a.t, 't3') = 't3'),
up as (select comment_id v, parent x from nodes where parent is not null
       union select up.v, nodes.parent from up join nodes on nodes.comment_id = up.x where nodes.parent is not null),
loops as (select v from up where v = x),
bad as (select distinct v from up where x in (select v from loops)),
high as (select n.comment_id, n.stored, coalesce(u.d, 0) d, coalesce(t.post, n.post) post
         from nodes n left join (select v, count(*) d from up group by 1) u on u.v = n.comment_id
         left join (select up.v, nodes.post from up join nodes on nodes.comment_id = up.x where nodes.parent is null) t on t.v = n.comment_id),
states as (select comment_id, stored, d, post, case when comment_id in (select v from loops) then 'cycle' when comment_id in (select v from bad) then 'below_cycle'
           when post is null then 'orphan' else 'tree' end state from high)
"""


def oracle_sql():
    kind = "case s when 3 then 'removed' when 2 then 'missing' else 'late' end"
    return {
        "p1_found": _P1 + f"select ref_field, comment_id, {kind} as kind from f where s > 0",
        "p1_counts": _P1 + f"select ref_field, month, {kind} as kind, count(*) as n_references from f where s > 0 group by all",
        "p2_found": _P2 + "select comment_id, case when state = 'tree' then 'depth' else state end as kind from states where state in ('cycle', 'below_cycle') or (state = 'tree' and stored <> d)",
        "p2_descendants": _P2 + """, tree as (select comment_id, d from states where state in ('tree', 'orphan'))
            select up.x as comment_id, up.v as descendant, cast(t.d - a.d as int) as distance from up join tree t on t.comment_id = up.v join tree a on a.comment_id = up.x""",
        "p2_paths": _P2 + """, path as (select up.v, string_agg(up.x, '/' order by s.d) p from up join states s on s.comment_id = up.x group by 1)
            select comment_id, case when state = 'tree' then post end as root, case when state in ('tree', 'orphan') then cast(d as int) end as depth, state,
            case when state in ('tree', 'orphan') then coalesce(p, '') else '' end as path from states left join path on path.v = comment_id""",
    }
