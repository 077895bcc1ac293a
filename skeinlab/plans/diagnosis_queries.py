"""Queries on single threads, candidates and iterations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions.metrics import CORE, GROUPS
from skeinlab.operators import calibration as C
from skeinlab.operators import diagnosis as D
from skeinlab.operators import labels as L
from skeinlab.operators import twosample as S
from skeinlab.plans.metric_queries import _GS, _TIER, BEFORE, EVAL, KEYS, QUANT, ROBUST, SIDES, _dev, _evaluated, _r, _robust, _run, _table
from skeinlab.plans.registry import Registry
from skeinlab.plans.thread_queries import GENERATED, _generated

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql
FOCUS = ["self_bleu_4", "length_cv", "structural_virality"]


@query(f"""with {GENERATED}, s as (select thread_id, comment_id, list_distinct(string_split(lower(text), ' ')) ws from g),
p as (select a.thread_id, len(list_intersect(a.ws, b.ws)) k, len(a.ws) n, len(b.ws) m from s a join s b on a.thread_id = b.thread_id and cast(a.comment_id as int) < cast(b.comment_id as int)),
x as (select thread_id, k / n pr, k / m re, 2 * k / (n + m) f from p), t as (select thread_id, count(*) c from g group by 1),
y as (select thread_id, count(*) pc, avg(pr) p, avg(re) r, avg(f) f, median(f) md, quantile_cont(f, 0.9) p90, min(f) mi, max(f) ma, list_avg(list_sort(list(f), 'DESC')[1:3]) tk from x group by 1)
select thread_id, c as comment_count, coalesce(pc, 0) as pair_count, {', '.join(f'round(coalesce({a}, 0), 6) as {b}' for a, b in (('p', 'mean_precision'), ('r', 'mean_recall'), ('f', 'mean_f1'), ('md', 'median_f1'), ('tk', 'top_k_mean_f1'), ('p90', 'p90_f1'), ('mi', 'min_f1'), ('ma', 'max_f1')))}
from t left join y using (thread_id)""")
def pair_score_aggregates(spark, d):
    """Words in common stand in for the model's scores."""
    c = _generated(spark, d)
    s = c.select("thread_id", F.col("comment_id").cast("int").alias("i"), F.array_distinct(F.split(F.lower("text"), " ")).alias("ws"))
    a, b = s.select("thread_id", F.col("i").alias("ia"), F.col("ws").alias("wa")), s.select("thread_id", F.col("i").alias("ib"), F.col("ws").alias("wb"))
    k, n, m = F.size(F.array_intersect("wa", "wb")), F.size("wa"), F.size("wb")
    pairs = a.join(b, "thread_id").where("ia < ib").select("thread_id", (k / n).alias("precision"), (k / m).alias("recall"), (2 * k / (n + m)).alias("f1"))
    return _r(L.pair_scores(pairs, c, 3))


_ROW = "first as (select domain, model, min(thread_id) tid from t where model <> 'real' and thread_id <> '__summary_mean__' group by all), one as (select t.* from t join first on t.domain = first.domain and t.model = first.model and t.thread_id = first.tid)"


def _one_thread(spark, d):
    """The thread of the least id of each domain and model, as metric values; of several rows the least value."""
    t = _table(spark, d).where("model <> 'real' and thread_id <> '__summary_mean__'")
    first = t.groupBy("domain", "model").agg(F.min("thread_id").alias("thread_id"))
    return S.metric_values(t.join(first, ["domain", "model", "thread_id"]), ["domain", "model"]).groupBy(*KEYS).agg(F.min("value").alias("value"))


@query(f"""with {SIDES}, {QUANT}, {_ROW}, v as (select domain, model, metric, min(value + 0.0) value from (unpivot (select * from one) on {', '.join(D.S.METRICS)} into name metric value value) where isfinite(value) group by all),
x as (select v.*, q.rmed, abs(v.value - q.rmed) dv from v join q using (domain, model, metric)),
y as (select x.domain, x.model, x.metric, x.value, x.rmed, (count(*) filter (where abs(b.value - x.rmed) >= x.dv) + 1) / (count(*) + 1) p, (count(*) filter (where b.value < x.value) + count(*) filter (where b.value <= x.value) + max((b.value = x.value)::int)) * 50.0 / count(*) pct
from x join b on b.domain = x.domain and b.model = x.model and b.metric = x.metric and b.is_real = 1 group by all)
select domain, model, metric, round(value, 6) + 0.0 as generated_value, round(rmed, 6) + 0.0 as real_median, round(p, 6) as empirical_p_value, round(pct, 6) as percentile,
case when p >= 0.05 then 'within_baseline' when value > rmed then 'too_high' else 'too_low' end as direction, case when p < 0.05 then 'fail' else 'pass' end as diagnosis_flag from y""")
def thread_diagnosis(spark, d):
    run = _run(spark, d)
    return _r(D.diagnose_rows(_one_thread(spark, d), run, _dev(run)))


_CORE = ", ".join(f"'{m}'" for m in CORE)


@query(f"""with {EVAL}, ce as (select distinct domain, model from ev), wn as (select ce.*, unnest([{_CORE}]) metric from ce),
x as (select wn.*, coalesce(ev.w, 'inf'::double) ew, coalesce(qe, 'inf'::double) eq, coalesce(fail, 'inf'::double) ef, coalesce(abs(gap), 'inf'::double) eg, coalesce(abs(delta), 'inf'::double) ed, coalesce((smed > r90 or smed < r10)::int, 1) o
from wn left join ev on ev.domain = wn.domain and ev.model = wn.model and ev.metric = wn.metric)
select domain, model, count(*) as n_metrics, sum(o) as out_of_range, round(avg(ew), 6) as mean_wasserstein, round(avg(eq), 6) as mean_quantile_error, round(avg(ef), 6) as mean_empirical_fail_rate, round(avg(eg), 6) as mean_abs_median_gap, round(avg(ed), 6) as mean_abs_cliffs_delta from x group by all""")
def target_summary(spark, d):
    run = _run(spark, d)
    return _r(D.target_summary(D.metric_rows(_evaluated(spark, d, run), _robust(spark, d, run), list(CORE))))


@query()
def target_summary_with_tests(spark, d):
    """With the passes of both tests; SQL has no error function for them."""
    run = _run(spark, d)
    e = C.group_evaluation(run, _dev(run), with_p=True)
    return _r(D.target_summary(D.metric_rows(e, _robust(spark, d, run), list(CORE))))


@query(f"with {EVAL} select domain, model, round(avg(abs(delta)), 6) as mean_abs_cliffs_delta, round(avg(fail), 6) as overall_fail_rate, count(*) filter (where abs(z) > 1.959963984540054) as metrics_sig_different from ev group by all")
def selection_summary(spark, d):
    return _r(D.selection_summary(_evaluated(spark, d)))


@query(f"""with {ROBUST}, s as (select domain, model, count(*) n, avg((status <> 'in_range')::int) f, avg(pd) pd, avg(zc) z, count(*) filter (where status = 'too_high') hi, count(*) filter (where status = 'too_low') lo from rb group by all)
select domain, model, n as n_metrics, round(f, 6) as quantile_fail_rate, round(pd, 6) as mean_percentile_distance, round(z, 3) as mean_abs_robust_z, hi as n_too_high, lo as n_too_low from s""")
def candidate_scores(spark, d):
    run = _run(spark, d)
    c = D.candidate_scores(_robust(spark, d, run), _evaluated(spark, d, run))
    return _r(c.withColumn("mean_abs_robust_z", F.round("mean_abs_robust_z", 3)).select("domain", "model", "n_metrics", "quantile_fail_rate", "mean_percentile_distance", "mean_abs_robust_z", "n_too_high", "n_too_low"))


_OF = "case " + " ".join(f"when starts_with(metric, '{b}') then '{m}'" for b, m in D.MEASURES) + " else 'metric' end"
_WAY = "case when abs(z) > 1.959963984540054 and delta > 0 then 'generated_higher' when abs(z) > 1.959963984540054 then 'generated_lower' else 'similar' end"


@query(f"""with {EVAL} select domain, model, metric, case when {_TIER} = 'acceptable' then 'Within acceptable range of real baseline.' when {_WAY} = 'generated_higher' then 'Generated discussions have ' || {_OF} || ' values too high compared to real.'
when {_WAY} = 'generated_lower' then 'Generated discussions have ' || {_OF} || ' values too low compared to real.' else 'Generated discussions deviate from real baseline on ' || {_OF} || '.' end as text from ev""")
def metric_interpretation(spark, d):
    run = _run(spark, d)
    e = _evaluated(spark, d, run)
    t = C.severity(_robust(spark, d, run), e).join(e.select(*KEYS, "direction"), KEYS)
    return t.select(*KEYS, D.interpretation_text(F.col("metric"), F.col("direction"), F.col("tier")).alias("text"))


@query(f"""with {EVAL}, vio as (select c.domain, c.model, (abs(c.delta) > greatest(1.5 * abs(r.delta), abs(r.delta) + 0.05))::int + (c.w > greatest(1.5 * r.w, r.w + 0.05))::int k from ev c join ev r on r.domain = c.domain and r.metric = c.metric and r.model = '{BEFORE}' where c.model <> '{BEFORE}'),
nv as (select domain, model, sum(k) n from vio group by all),
key as (select domain, model, round(avg(abs(delta)), 9) de, round(avg(w), 9) w, [{', '.join(f"coalesce(max(case when metric = '{m}' then round({c}, 9) end), 'inf'::double)" for m in FOCUS for c in ('abs(delta)', 'w', 'abs(gap)'))}] fo from ev where model <> '{BEFORE}' group by all)
select domain, arg_min(model, (coalesce(n, 0), de, w, fo, model)) as model, min(struct_pack(v := coalesce(n, 0), d := de, w, fo, model)).v::bigint as violations, round(min(struct_pack(v := coalesce(n, 0), d := de, w, fo, model)).d, 6) as mean_abs_cliffs_delta,
round(min(struct_pack(v := coalesce(n, 0), d := de, w, fo, model)).w, 6) as mean_wasserstein from key left join nv using (domain, model) group by 1""")
def phase_choice(spark, d):
    e = _evaluated(spark, d)
    other, before = e.where(F.col("model") != BEFORE), e.where(F.col("model") == BEFORE)
    n = C.regression_guard(other, before).groupBy("domain", "model").agg(F.count("*").alias("n"))
    return _r(D.phase_choice(other, n, FOCUS))


def _nine(scores):
    return scores.select(*[F.round(c, 9).alias(c) if c in D.WORSE else F.col(c) for c in scores.columns])


_WG = f"{ROBUST}, {_GS}, wg as (select domain, model, metric_group, round(f, 9) f, round(pd, 9) pd, round(z, 9) z, row_number() over (partition by domain, model order by round(f, 9) desc, round(pd, 9) desc, round(z, 9) desc, metric_group) place from gs)"


@query(f"with {_WG} select domain, model, metric_group, place from wg")
def worst_groups(spark, d):
    return D.worst_groups(_nine(C.group_scores(_robust(spark, d)))).select("domain", "model", "metric_group", "place")


@query(f"with {_WG}, o as (select domain, model, list(metric_group order by place) l from wg group by all), k as (select *, unnest([{', '.join(f'{chr(39)}{g}{chr(39)}' for g in GROUPS)}]) g, generate_subscripts([{', '.join(f'{chr(39)}{g}{chr(39)}' for g in GROUPS)}], 1) i from o) "
       "select domain, model, array_to_string(l || coalesce(list(g order by i) filter (where not list_contains(l, g)), []), ',') as families from k group by domain, model, l")
def family_order(spark, d):
    return D.family_order(_nine(C.group_scores(_robust(spark, d))), list(GROUPS)).select("domain", "model", F.array_join("families", ",").alias("families"))


@query(f"""with {_WG}, fr as (select domain, metric_group, min(struct_pack(f, pd, z, model)) m from wg group by all), al as (select domain, model, round(avg((status <> 'in_range')::int), 9) f, round(avg(pd), 9) pd from rb group by all), be as (select domain, arg_min(model, (f, pd, model)) model from al group by 1),
c as (select be.domain, be.model own, wg.metric_group, wg.place, fr.m.model other from be join wg on wg.domain = be.domain and wg.model = be.model join fr on fr.domain = be.domain and fr.metric_group = wg.metric_group where fr.m.model <> be.model and (fr.m.f, fr.m.pd, fr.m.z) < (wg.f, wg.pd, wg.z)),
x as (select domain, min(struct_pack(place, other, metric_group)) c from c where domain <> 'laptops' group by 1)
select be.domain, coalesce(x.c.other, be.model) as model, case when x.c is null then 'global_best' else 'challenger_root' end as root, x.c.metric_group as metric_group from be left join x using (domain)""")
def search_roots(spark, d):
    """Every domain but one is taken to have gone three iterations without a win."""
    robust = _robust(spark, d)
    scores = _nine(C.group_scores(robust))
    overall = robust.groupBy("domain", "model").agg(F.round(F.avg((F.col("status") != "in_range").cast("double")), 9).alias("f"), F.round(F.avg("percentile_distance"), 9).alias("pd"))
    best = overall.groupBy("domain").agg(F.min(F.struct("f", "pd", "model")).alias("k")).select("domain", "k.model")
    misses = best.select("domain", F.when(F.col("domain") == "laptops", 1).otherwise(3).alias("misses"))
    return D.search_roots(scores, best, C.frontier(scores), misses)


@query(f"""with {_WG}, bw as (select domain, metric_group, min(struct_pack(f, pd, z, model)).model win from wg group by all), x as (select wg.*, wg.model = bw.win won from wg join bw using (domain, metric_group))
select metric_group as family, count(*) as attempts, count(*) filter (where won) as wins, round(avg(won::int), 6) as win_rate, min(struct_pack(f, pd, z, domain, model)).domain as best_iteration, min(struct_pack(f, pd, z, domain, model)).model as best_candidate from x group by 1""")
def family_learning(spark, d):
    """Metric groups are the families, domains the iterations, and the frontier's candidates the winners."""
    scores = _nine(C.group_scores(_robust(spark, d)))
    wins = C.frontier(scores).select("domain", "metric_group", F.col("model").alias("win"))
    log = scores.join(wins, ["domain", "metric_group"]).select(F.col("metric_group").alias("family"), F.col("domain").alias("iteration"), F.col("model").alias("candidate"), (F.col("model") == F.col("win")).alias("won"), *D.WORSE)
    return _r(D.family_learning(log))


@query("""with c as (select model, scored_on, count(*) n from thread_metrics_summary where model is not null and scored_on is not null group by all), r as (select *, sum(n) over (partition by model order by scored_on) s from c)
select model, cast(scored_on as varchar) as scored_on, n, s::bigint as so_far from r where s - n < 40""")
def batches_until_enough(spark, d):
    t = _table(spark, d).sparkSession.read.parquet(f"{d}/thread_metrics_summary.parquet").where("model is not null and scored_on is not null")
    c = t.groupBy("model", "scored_on").agg(F.count("*").alias("n"))
    return D.until_enough(c, "model", "scored_on", "n", 40).select("model", F.col("scored_on").cast("string").alias("scored_on"), "n", "so_far")
