"""Queries over scored threads: two-sample statistics, comparison, boards, calibration; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions.metrics import CORE, FAMILIES, GROUPS, METRICS, SELECTION
from skeinlab.operators import calibration as C
from skeinlab.operators import comparison as B
from skeinlab.operators import diagnosis as D
from skeinlab.operators import twosample as S
from skeinlab.plans.registry import Registry
from skeinlab.runtime import Scratch, read_table

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql
KEYS = ["domain", "model", "metric"]
BEFORE, AFTER = "sim-alder", "sim-birch"


def _table(spark, d):
    return read_table(spark, d, "thread_metrics_summary").withColumnRenamed("product_category", "domain").where("model is not null and domain is not null")


def _values(spark, d):
    return S.metric_values(_table(spark, d), ["domain", "model"])


def _run(spark, d):
    return Scratch(spark, "run").cut(S.ordered(S.sides(_values(spark, d)), KEYS))


def _dev(run):
    return Scratch(run.sparkSession, "dev").cut(S.deviations(run, KEYS))


def _r(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LONG = f"""t as (select * exclude (product_category), product_category as domain from thread_metrics_summary where model is not null and product_category is not null),
l as (select domain, model, metric, value + 0.0 as value from (unpivot (select domain, model, thread_id, {', '.join(METRICS)} from t where coalesce(thread_id, '') <> '__summary_mean__')
  on {', '.join(METRICS)} into name metric value value) where value is not null and isfinite(value))"""
SIDES = f"""{LONG}, cells as (select distinct domain, model from l where model <> 'real'),
b as (select l.domain, cells.model, l.metric, l.value, 1 as is_real from l join cells on cells.domain = l.domain where l.model = 'real' union all select domain, model, metric, value, 0 from l where model <> 'real'),
n as (select domain, model, metric, sum(is_real) n, count(*) - sum(is_real) m from b group by all having sum(is_real) > 0 and sum(is_real) < count(*))"""
COUNTS = f"""{SIDES}, c as (select domain, model, metric, value, sum(is_real) cr, count(*) - sum(is_real) cs from b join n using (domain, model, metric) group by all),
w as (select c.*, n.n, n.m, sum(cr) over (partition by domain, model, metric order by value) ar, sum(cs) over (partition by domain, model, metric order by value) as_, lead(value) over (partition by domain, model, metric order by value) nx from c join n using (domain, model, metric)),
dist as (select domain, model, metric, max(n) real_n, max(m) sim_n, sum(value * cr) / max(n) real_mean, sum(value * cs) / max(m) sim_mean,
  sum(cr * (ar - cr + as_ - cs + (cr + cs + 1) / 2)) - max(n) * (max(n) + 1) / 2 u, sum((cr + cs)::double * (cr + cs) * (cr + cs) - (cr + cs)) ties, max(abs(ar / n - as_ / m)) ks, sum(coalesce(abs(ar / n - as_ / m) * (nx - value), 0)) wasserstein from w group by all),
dd as (select *, 2 * u / (real_n * sim_n) - 1 delta, (greatest(u, real_n * sim_n - u) - real_n * sim_n / 2 - 0.5) / nullif(sqrt(real_n * sim_n / 12 * (real_n + sim_n + 1 - ties / ((real_n + sim_n) * (real_n + sim_n - 1)))), 0) z from dist)"""


def _q(side, p, name):
    return f"quantile_cont(value, {p}) filter (where is_real = {side}) as {name}"


QUANT = f"""q as (select domain, model, metric, {_q(1, 0.5, 'rmed')}, {_q(0, 0.5, 'smed')}, {_q(1, 0.1, 'r10')}, {_q(1, 0.9, 'r90')}, {_q(1, 0.025, 'rlo')}, {_q(1, 0.975, 'rhi')} from b join n using (domain, model, metric) group by all),
dev as (select domain, model, metric, abs(value - rmed) dv, is_real, value from b join q using (domain, model, metric)),
mad as (select domain, model, metric, median(dv) filter (where is_real = 1) mad from dev group by all),
pe as (select d.domain, d.model, d.metric, d.dv, count(*) filter (where d.is_real = 0) k, max(n.n) nn, sum(count(*) filter (where d.is_real = 1)) over (partition by d.domain, d.model, d.metric order by d.dv desc) ge from dev d join n using (domain, model, metric) group by d.domain, d.model, d.metric, d.dv),
emp as (select domain, model, metric, sum(case when (ge + 1) / (nn + 1) < 0.05 then k else 0 end) / sum(k) as fail from pe where k > 0 group by all)"""


@query(f"with {LONG} select domain, model, metric, count(*) as n, round(sum(value), 4) + 0.0 as total from l group by all")
def metric_unpivot(spark, d):
    return _values(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


@query(f"with {LONG} select domain, model, metric, round(avg(value) + 1e-10, 6) + 0.0 as mean from l group by all union all select null, null, metric, round(avg(value) + 1e-10, 6) + 0.0 from l group by metric")
def summary_mean_rows(spark, d):
    g = _values(spark, d).groupingSets([["domain", "model", "metric"], ["metric"]], "domain", "model", "metric").agg((F.round(F.avg("value") + 1e-10, 6) + 0.0).alias("mean"))
    return g.select("domain", "model", "metric", "mean")


@query(f"with {LONG} select domain, metric, round(median(value), 6) + 0.0 as median, round(avg(value), 6) + 0.0 as mean, round(stddev_pop(value), 6) + 0.0 as std, "
       + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) + 0.0 as p{p}" for p in (10, 25, 75, 90)) + ", round(min(value), 6) + 0.0 as least, round(max(value), 6) + 0.0 as most, count(*) as n from l where model = 'real' group by all")
def real_baseline(spark, d):
    v = _values(spark, d).where("model = 'real'").withColumnRenamed("value", "v").groupBy("domain", "metric", F.col("v").alias("value")).agg(F.count("*").alias("n"))
    run = Scratch(spark, "baseline").cut(S.running_totals(v, ["domain", "metric"], "value", ["n"]))
    q = S.side_quantiles(run, ["domain", "metric"], "n", {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    x, n = F.col("value"), F.col("n")
    mean = F.sum(x * n) / F.sum("n")
    first = run.groupBy("domain", "metric").agg(mean.alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("n").alias("n"))
    second = run.join(first.select("domain", "metric", "mean"), ["domain", "metric"]).groupBy("domain", "metric").agg(F.sqrt(F.sum((x - F.col("mean")) ** 2 * n) / F.sum("n")).alias("std"))
    return _r(first.join(second, ["domain", "metric"]).join(q, ["domain", "metric"]).select("domain", "metric", "median", "mean", "std", "p10", "p25", "p75", "p90", "least", "most", "n"))


@query(f"with {COUNTS} select domain, model, metric, real_n, sim_n, round(u, 3) as u, round(z, 6) + 0.0 as z from dd")
def mann_whitney_u(spark, d):
    x = S.distances(_run(spark, d), KEYS)
    return x.select(*KEYS, "real_n", "sim_n", F.round("u", 3).alias("u"), (F.round("z", 6) + 0.0).alias("z"))


@query(f"with {COUNTS} select domain, model, metric, round(ks, 6) as ks, round(wasserstein, 6) as wasserstein, round(delta, 6) + 0.0 as cliffs_delta, case when abs(delta) < 0.147 then 'negligible' when abs(delta) < 0.33 then 'small' when abs(delta) < 0.474 then 'medium' else 'large' end as band from dd")
def two_sample_distances(spark, d):
    x = S.distances(_run(spark, d), KEYS)
    return _r(x.select(*KEYS, "ks", "wasserstein", "cliffs_delta", S.interpretation(F.col("cliffs_delta")).alias("band")))


def _grid_sql(grid):
    diffs = " + ".join(f"abs(quantile_cont(value, {p}) filter (where is_real = 1) - quantile_cont(value, {p}) filter (where is_real = 0))" for p in grid)
    return f"({diffs}) / {len(grid)}"


@query(f"with {SIDES} select domain, model, metric, round({_grid_sql(S.GRID_21)}, 6) as quantile_error from b join n using (domain, model, metric) group by all")
def quantile_error_21(spark, d):
    return _r(S.quantile_error(_run(spark, d), KEYS, S.GRID_21))


@query(f"with {SIDES} select domain, model, metric, round({_grid_sql(S.GRID_5)}, 6) as quantile_error from b join n using (domain, model, metric) group by all")
def quantile_error_5(spark, d):
    return _r(S.quantile_error(_run(spark, d), KEYS, S.GRID_5))


@query(f"with {SIDES}, {QUANT} select domain, model, metric, round(avg(case when value < rlo or value > rhi then 1.0 else 0.0 end), 6) as empirical_fail_rate from b join q using (domain, model, metric) where is_real = 0 group by all")
def fail_rate_interval(spark, d):
    return _r(S.interval_fail_rate(_run(spark, d), KEYS).where("empirical_fail_rate is not null"))


@query(f"with {SIDES}, {QUANT} select domain, model, metric, round(dv, 9) as deviation, k as n_sim, round((ge + 1) / (nn + 1), 9) as p from pe where k > 0")
def empirical_p(spark, d):
    return _r(S.empirical_p(_dev(_run(spark, d)), KEYS), 9)


@query(f"with {SIDES}, {QUANT} select domain, model, metric, round(fail, 6) as empirical_fail_rate from emp")
def fail_rate_empirical(spark, d):
    return _r(S.empirical_fail_rate(_dev(_run(spark, d)), KEYS))


@query(f"with {COUNTS} select domain, model, metric, round(value, 9) as value, cs as n_sim, round((ar - cr + ar + case when cr > 0 then 1 else 0 end) * 50.0 / n, 9) as percentile from w where cs > 0")
def percentile_rank(spark, d):
    return _r(S.percentile_ranks(_run(spark, d), KEYS).where("percentile is not null").select(*KEYS, "value", "n_sim", "percentile"), 9)


@query(f"with {SIDES}, {QUANT} select domain, model, metric, round(rmed, 6) + 0.0 as real_median, round(smed, 6) + 0.0 as sim_median, round(mad, 6) as mad, round(smed - rmed, 6) + 0.0 as median_gap, round((smed - rmed) / (mad + 1e-9), 3) + 0.0 as mad_normalized_gap from q join mad using (domain, model, metric)")
def median_gaps(spark, d):
    run = _run(spark, d)
    g = S.median_gaps(run, _dev(run), KEYS).withColumn("mad_normalized_gap", F.round("mad_normalized_gap", 3))
    return _r(g)


_COMPARE = f"{COUNTS}, {QUANT}, cmp as (select dd.*, q.rmed, q.smed from dd join q using (domain, model, metric) where real_n >= 2 and sim_n >= 2), cp as (select *, coalesce(not (abs(z) >= 1.959963984540054), true) pass, case when abs(delta) < 0.147 then 'negligible' when abs(delta) < 0.33 then 'small' when abs(delta) < 0.474 then 'medium' else 'large' end band from cmp)"


@query(f"""with {_COMPARE}, f as (select domain, model, metric, avg(case when value < rlo or value > rhi then 1.0 else 0.0 end) fr from b join q using (domain, model, metric) where is_real = 0 group by all),
e as (select domain, model, metric, {_grid_sql(S.GRID_21)} qe from b join n using (domain, model, metric) group by all)
select domain, model, metric, real_n, sim_n, round(real_mean, 6) + 0.0 as real_mean, round(rmed, 6) + 0.0 as real_median, round(sim_mean, 6) + 0.0 as sim_mean, round(smed, 6) + 0.0 as sim_median,
round(delta, 6) + 0.0 as cliffs_delta, round(abs(delta), 6) as abs_cliffs_delta, band as cliffs_delta_interpretation, round(wasserstein, 6) as wasserstein, round(qe, 6) as quantile_error, round(fr, 6) as empirical_fail_rate from cp join f using (domain, model, metric) join e using (domain, model, metric)""")
def compare_table(spark, d):
    c = B.comparison(_run(spark, d), with_p=False)
    return _r(c.select(*KEYS, "real_n", "sim_n", "real_mean", "real_median", "sim_mean", "sim_median", "cliffs_delta", "abs_cliffs_delta", "cliffs_delta_interpretation", "wasserstein", "quantile_error", "empirical_fail_rate"))


@query()
def compare_p_values(spark, d):
    return _r(S.p_values(S.distances(_run(spark, d), KEYS)).select(*KEYS, "mwu_p_value", "ks_p_value"), 9)


def _compared(spark, d):
    return Scratch(spark, "compared").cut(B.comparison(_run(spark, d), with_p=False))


@query(f"""with {_COMPARE} select domain, model, count(*) as n_metrics, round(avg(pass::int), 6) as similarity_ratio, round(avg(abs(delta)), 6) as mean_abs_delta, round(avg(wasserstein), 6) as mean_wasserstein,
{', '.join(f"count(*) filter (where band = '{x}') as n_{x}" for x in ('negligible', 'small', 'medium', 'large'))} from cp group by all""")
def similarity_ratio(spark, d):
    return _r(B.similarity(_compared(spark, d)))


_IN_CORE = "metric in (" + ", ".join(f"'{m}'" for m in CORE) + ")"
_PASSED = f"pc as (select domain, model, count(*) filter (where pass and {_IN_CORE}) passed from cp group by all)"


@query(f"with {_COMPARE}, {_PASSED} select domain, model, passed, 16 as of from pc")
def pass_counts(spark, d):
    return B.pass_counts(_compared(spark, d))


_FAM = "fam(metric, family) as (values " + ", ".join(f"('{m}', '{f}')" for f, ms in FAMILIES.items() for m in ms) + ")"


@query(f"with {_COMPARE}, {_FAM} select model, family, round(avg(wasserstein), 6) as w1, round(avg(abs(delta)), 6) as cliffs from cp join fam using (metric) group by all")
def family_means(spark, d):
    return _r(B.family_means(_compared(spark, d)))


_FLOOR = {"Diversity": (0.016, 0.060), "Tone": (0.034, 0.071), "Structure": (0.165, 0.100), "Content": (0.074, 0.098), "Toxicity": (0.004, 0.043)}


@query(f"with {_COMPARE}, {_FAM}, floor(family, w0, c0) as (values {', '.join(f'({chr(39)}{f}{chr(39)}, {a}::double, {b}::double)' for f, (a, b) in _FLOOR.items())}), m as (select model, family, avg(wasserstein) w1, avg(abs(delta)) c from cp join fam using (metric) group by all) select model, family, round(w1 / w0, 1) as w1_ratio, round(c / c0, 1) as cliffs_ratio from m join floor using (family)")
def noise_ratios(spark, d):
    floor = spark.createDataFrame([(f, *x) for f, x in _FLOOR.items()], "family string, w1 double, cliffs double")
    return B.noise_ratio(B.family_means(_compared(spark, d)), floor)


@query(f"""with {_COMPARE}, {_PASSED}, m as (select model, sum(passed) total, count(distinct domain) n_domains, max(passed) best from pc group by 1)
select model, total, n_domains, round(100.0 * total / 80, 1) as percent, 'heat-' || cast((select max(x) from (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (10), (12), (14), (15), (16)) v(x) where x <= best) as varchar) as best_class,
case when n_domains = 5 then row_number() over (partition by n_domains = 5 order by total desc, model) end as place from m""")
def leaderboard(spark, d):
    return B.board(_compared(spark, d))


_CELLS = "cl as (select distinct domain, model from t)"
_MISSING = f"core(metric) as (values {', '.join(f'({chr(39)}{m}{chr(39)})' for m in CORE)}), miss as (select cl.domain, cl.model, core.metric from cl, core where not exists (select 1 from l where l.domain = cl.domain and l.model = cl.model and l.metric = core.metric))"


@query(f"with {LONG}, {_CELLS}, {_MISSING} select * from miss")
def missing_core_metrics(spark, d):
    return B.missing_core(_values(spark, d), _table(spark, d))


@query(f"""with {LONG}, {_CELLS}, {_MISSING}, s as (select cl.domain, cl.model, (select count(*) from t where t.domain = cl.domain and t.model = cl.model and trim(thread_id) <> '' and thread_id <> '__summary_mean__') n from cl)
select domain, model, 'error' as level, 'unknown domain ' || domain as msg from cl where domain not in ('credit_cards', 'cameras', 'cell_phones', 'headphones', 'laptops')
union all select domain, model, 'error', 'only ' || n || ' usable threads' from s where n < 50 union all select domain, model, 'warning', count(*) || ' core metrics missing' from miss group by domain, model""")
def submission_issues(spark, d):
    return B.submission_issues(_table(spark, d), _values(spark, d))


@query("""with t as (select * from thread_metrics_summary where model is not null and product_category is not null), s as (select model, product_category, count(*) filter (where trim(thread_id) <> '' and thread_id <> '__summary_mean__') n from t group by all)
select model from s group by 1 having min(n) >= 50 and bool_and(product_category in ('credit_cards', 'cameras', 'cell_phones', 'headphones', 'laptops'))""")
def accepted_models(spark, d):
    t = _table(spark, d)
    return B.accepted_models(B.submission_issues(t, _values(spark, d)), t)


@query("select product_category as domain, model, count(*) as n from thread_metrics_summary where thread_id not like '~_~_summary%' escape '~' group by all")
def counts_per_domain_model(spark, d):
    t = read_table(spark, d, "thread_metrics_summary")
    return t.where(~F.col("thread_id").startswith("__summary")).groupBy(F.col("product_category").alias("domain"), "model").agg(F.count("*").alias("n"))


ROBUST = f"""{SIDES}, {QUANT}, rank as (select domain, model, metric, avg(case when value <= smed then 1.0 else 0.0 end) pr from b join q using (domain, model, metric) where is_real = 1 group by all),
rb as (select domain, model, metric, smed, r10, rmed, r90, pr, abs(pr - 0.5) * 2 pd, (smed - rmed) / (mad + 1e-9) z, least(abs((smed - rmed) / (mad + 1e-9)), 5.0) zc,
  case when smed > r90 then 'too_high' when smed < r10 then 'too_low' else 'in_range' end status from q join mad using (domain, model, metric) join rank using (domain, model, metric))"""


def _robust(spark, d, run=None):
    run = _run(spark, d) if run is None else run
    return Scratch(spark, "robust").cut(C.robust_status(run, _dev(run)))


@query(f"with {ROBUST} select domain, model, metric, round(smed, 6) + 0.0 as sim_median, round(r10, 6) + 0.0 as real_p10, round(r90, 6) + 0.0 as real_p90, round(pr, 6) as percentile_rank, round(pd, 6) + 0.0 as percentile_distance, round(z, 3) + 0.0 as robust_z, round(zc, 3) + 0.0 as abs_robust_z_clipped, status from rb")
def robust_status(spark, d):
    r = _robust(spark, d).select(*KEYS, "sim_median", "real_p10", "real_p90", "percentile_rank", "percentile_distance", F.round("robust_z", 3).alias("robust_z"), F.round("abs_robust_z_clipped", 3).alias("abs_robust_z_clipped"), "status")
    return _r(r)


def _dim(of, name):
    return f"{name}(metric, g) as (values " + ", ".join(f"('{m}', '{g}')" for g, ms in of.items() for m in ms) + ")"


_GS = f"{_dim(GROUPS, 'gr')}, gs as (select domain, model, g metric_group, count(*) metric_count, avg((status <> 'in_range')::int) f, avg(pd) pd, avg(zc) z from rb join gr using (metric) group by all)"


@query(f"with {ROBUST}, {_GS} select domain, model, metric_group, metric_count, round(f, 6) as quantile_fail_rate, round(pd, 6) as mean_percentile_distance, round(z, 3) as mean_abs_robust_z from gs")
def group_scores(spark, d):
    return _r(C.group_scores(_robust(spark, d)).withColumn("mean_abs_robust_z", F.round("mean_abs_robust_z", 3)))


@query(f"with {ROBUST}, {_dim(SELECTION, 'se')} select domain, model, g as family, count(*) filter (where status <> 'in_range') as out_of_range, round(avg(pd), 6) as mean_distance, round(max(pd), 6) as max_distance, round(avg(abs(z)), 3) as mean_z, round(max(abs(z)), 3) as max_z from rb join se using (metric) group by all")
def selection_scores(spark, d):
    s = C.selection_scores(_robust(spark, d))
    return _r(s.withColumn("mean_z", F.round("mean_z", 3)).withColumn("max_z", F.round("max_z", 3)))


_ORDER = ", ".join(f"coalesce(max(case when g = '{f}' then round({c}::double, 9) end), {0 if c == 'out_of_range' else chr(39) + 'inf' + chr(39) + '::double'}) as {f}_{c}" for f, c in C.ORDER)


@query(f"""with {ROBUST}, {_dim(SELECTION, 'se')}, s as (select domain, model, g, count(*) filter (where status <> 'in_range') out_of_range, avg(pd) mean_distance, max(pd) max_distance, avg(abs(z)) mean_z, max(abs(z)) max_z from rb join se using (metric) group by all),
k as (select domain, model, {_ORDER} from s group by all), o as (select domain, model, round(avg((status <> 'in_range')::int), 9) f, round(avg(pd), 9) pd, round(avg(zc), 9) z from rb group by all)
select domain, model, row_number() over (partition by domain order by {', '.join(f'{f}_{c}' for f, c in C.ORDER)}, f, pd, z, model) as place from k join o using (domain, model)""")
def candidate_rank(spark, d):
    return C.candidate_ranking(_robust(spark, d)).select("domain", "model", "place")


@query(f"with {ROBUST}, {_GS} select domain, metric_group, arg_min(model, (round(f, 9), round(pd, 9), round(z, 9), model)) as model from gs group by all")
def frontier_best(spark, d):
    g = C.group_scores(_robust(spark, d))
    for c in ("quantile_fail_rate", "mean_percentile_distance", "mean_abs_robust_z"):
        g = g.withColumn(c, F.round(c, 9))
    return C.frontier(g).select("domain", "metric_group", "model")


EVAL = f"{COUNTS}, {QUANT}, rank as (select domain, model, metric, avg(case when value <= smed then 1.0 else 0.0 end) pr from b join q using (domain, model, metric) where is_real = 1 group by all), qe as (select domain, model, metric, {_grid_sql(S.GRID_5)} qe from b join n using (domain, model, metric) group by all), ev as (select domain, model, metric, real_mean, sim_mean, -delta delta, ks, wasserstein w, qe, fail, smed - rmed gap, (smed - rmed) / (mad + 1e-9) mg, z, pr, smed, r10, r90 from dd join q using (domain, model, metric) join mad using (domain, model, metric) join emp using (domain, model, metric) join qe using (domain, model, metric) join rank using (domain, model, metric))"


def _evaluated(spark, d, run=None):
    run = _run(spark, d) if run is None else run
    return Scratch(spark, "evaluated").cut(C.group_evaluation(run, _dev(run), with_p=False))


@query(f"with {EVAL} select domain, model, metric, round(delta, 6) + 0.0 as cliffs_delta, round(w, 6) as wasserstein, round(qe, 6) as quantile_error, round(gap, 6) + 0.0 as median_gap, round(fail, 6) as empirical_fail_rate, case when abs(z) > 1.959963984540054 and delta > 0 then 'generated_higher' when abs(z) > 1.959963984540054 then 'generated_lower' else 'similar' end as direction from ev")
def group_evaluation(spark, d):
    return _r(_evaluated(spark, d).select(*KEYS, "cliffs_delta", "wasserstein", "quantile_error", "median_gap", "empirical_fail_rate", "direction"))


_TIER = "case when smed > r90 or smed < r10 then (case when abs(pr - 0.5) * 2 >= 0.75 or abs(mg) >= 2.5 or fail > 0.5 or abs(delta) >= 0.474 then 'critical' else 'secondary' end) when abs(pr - 0.5) * 2 >= 0.4 or abs(mg) >= 1.0 or fail >= 0.2 or abs(delta) >= 0.33 then 'secondary' else 'acceptable' end"


@query(f"with {EVAL} select domain, model, metric, {_TIER} as tier, row_number() over (partition by domain, model order by case {_TIER} when 'critical' then 0 when 'secondary' then 1 else 2 end, round(abs(pr - 0.5) * 2, 9) desc, round(abs(mg), 3) desc, metric) as place from ev")
def severity_tiers(spark, d):
    run = _run(spark, d)
    return D.by_severity(C.severity(_robust(spark, d, run), _evaluated(spark, d, run))).select(*KEYS, "tier", "place")


_BA = f"""{EVAL}, ba as (select x.domain, x.metric, abs(x.delta) - abs(y.delta) rd, x.w - y.w rw, x.qe - y.qe rq, abs(x.gap) - abs(y.gap) rg, abs(x.mg) - abs(y.mg) rm, x.fail - y.fail rf, abs(x.real_mean - x.sim_mean) - abs(x.real_mean - y.sim_mean) rn, x.delta bd, y.delta ad, x.w bw, y.w aw, x.fail bf, y.fail af
  from ev x left join ev y on y.domain = x.domain and y.metric = x.metric and y.model = '{AFTER}' where x.model = '{BEFORE}')"""


def _before_after(spark, d):
    e = _evaluated(spark, d)
    return C.before_after(e.where(F.col("model") == BEFORE), e.where(F.col("model") == AFTER))


@query(f"with {_BA} select domain, metric, round(rd, 6) + 0.0 as abs_delta_reduction, round(rw, 6) + 0.0 as wasserstein_reduction, round(rq, 6) + 0.0 as quantile_error_reduction, round(rf, 6) + 0.0 as fail_rate_reduction, round(rn, 6) + 0.0 as mean_gap_reduction, coalesce(rd > 0, false) and coalesce(rf > 0, false) as improved from ba")
def before_after(spark, d):
    return _r(_before_after(spark, d).select("domain", "metric", "abs_delta_reduction", "wasserstein_reduction", "quantile_error_reduction", "fail_rate_reduction", "mean_gap_reduction", "improved"))


@query(f"""with {_BA} select domain, round(avg(abs(bd)), 6) as abs_delta_before, round(avg(abs(ad)), 6) as abs_delta_after, round(avg(bw), 6) as wasserstein_before, round(avg(aw), 6) as wasserstein_after, round(avg(bf), 6) as fail_rate_before, round(avg(af), 6) as fail_rate_after,
round(1 - avg(af), 6) as pass_rate_after, count(*) filter (where rd > 0 and rf > 0) as n_improved, count(*) filter (where rw > 0) as n_closer_by_wasserstein, count(*) filter (where rq > 0) as n_closer_by_quantile_error, count(*) filter (where rn > 0) as n_closer_by_mean_gap,
count(*) filter (where rg > 0) as n_closer_by_abs_median_gap, count(*) filter (where rm > 0) as n_closer_by_abs_mad_gap from ba group by 1""")
def before_after_summary(spark, d):
    return _r(C.before_after_summary(_before_after(spark, d)))


@query(f"""with {EVAL}, s as (select domain, model, metric, 'abs_cliffs_delta' statistic, abs(delta) x from ev union all select domain, model, metric, 'wasserstein', w from ev)
select c.domain, c.model, c.metric, c.statistic, round(c.x, 6) as value, round(greatest(1.5 * r.x, r.x + 0.05), 6) as limit, round(c.x / greatest(1.5 * r.x, r.x + 0.05), 6) as severity
from s c join s r on r.domain = c.domain and r.metric = c.metric and r.statistic = c.statistic and r.model = '{BEFORE}' where c.model <> '{BEFORE}' and c.x > greatest(1.5 * r.x, r.x + 0.05)""".replace(" as limit", ' as "limit"'))
def regression_guard(spark, d):
    e = _evaluated(spark, d)
    return _r(C.regression_guard(e.where(F.col("model") != BEFORE), e.where(F.col("model") == BEFORE)))


_STATS = ("delta", "w", "qe", "fail", "gap", "mg", "ks")


@query(f"""with {EVAL}, j as (select c.domain, c.model, c.metric, ({' or '.join(f'coalesce(abs(c.{s}) > abs(r.{s}) + 1e-9, false)' for s in _STATS)}) up, ({' or '.join(f'coalesce(abs(c.{s}) < abs(r.{s}) - 1e-9, false)' for s in _STATS)}) down
  from ev c join ev r on r.domain = c.domain and r.metric = c.metric and r.model = '{BEFORE}' where c.model <> '{BEFORE}') select domain, model, metric, case when down and not up then 'improved' when up and not down then 'worsened' else 'mixed' end as change from j""")
def change_labels(spark, d):
    e = _evaluated(spark, d)
    return C.change_labels(e.where(F.col("model") != BEFORE), e.where(F.col("model") == BEFORE))


@query()
def bootstrap_interval(spark, d):
    side = F.when(F.col("model") == BEFORE, "before").when(F.col("model") == AFTER, "after").when(F.col("model") == "real", "real")
    v = _values(spark, d).select("domain", "metric", side.alias("side"), "value").where(F.col("side").isNotNull() & F.col("metric").isin(*CORE))
    return _r(S.bootstrap_reduction(v, sorted(CORE)))
