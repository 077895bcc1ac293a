"""Queries of the training-data problems for text and models, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.llm import abuse, bpe, components, overlaps, packing, percentiles, segmentation, spans
from skeinlab.runtime import Scratch, read_table


def p3_found(spark, d):
    return components.related_posts(components.assign_splits(read_table(spark, d, "comments")))


def p3_splits(spark, d):
    return components.assign_splits(read_table(spark, d, "comments"))


def p4_found(spark, d):
    return overlaps.overlap_pairs(overlaps.split_overlaps(read_table(spark, d, "comments"), read_table(spark, d, "splits")))


def p4_counts(spark, d):
    return overlaps.overlap_counts(overlaps.split_overlaps(read_table(spark, d, "comments"), read_table(spark, d, "splits")))


def p4_coverage(spark, d):
    return spans.coverage_report(spans.coverage(read_table(spark, d, "comments"), read_table(spark, d, "splits")))


def _abuse_scores(spark, d):
    texts = abuse.all_texts(read_table(spark, d, "comments"), read_table(spark, d, "example_thread_format"))
    return abuse.score_texts(texts, abuse.model_of(read_table(spark, d, "abuse_labels"), texts))


def p5_found(spark, d):
    return abuse.abusive_records(_abuse_scores(spark, d))


def p5_scores(spark, d):
    return abuse.record_scores(_abuse_scores(spark, d)).select("table_name", "record_id", F.round("score", 4).alias("score"))


def p5_rates(spark, d):
    return abuse.abuse_rates(_abuse_scores(spark, d))


def p6_percentiles(spark, d):
    found = percentiles.percentiles(percentiles.value_counts(read_table(spark, d, "thread_metrics_summary")))
    return found.select("model", "product_category", "metric", "n", *[(F.round(f"p{p}", 6) + 0.0).alias(f"p{p}") for p in percentiles.PERCENTS], "max_error")


def p7_ids(spark, d):
    return bpe.encode_documents(read_table(spark, d, "documents"))


def p7_decoded(spark, d):
    ids = bpe.encode_documents(read_table(spark, d, "documents"))
    return ids.select("doc_id", bpe.decode_column("ids").alias("text"))


def p8_containers(spark, d):
    return packing.pack_documents(read_table(spark, d, "documents"))


def p9_pieces(spark, d):
    return segmentation.split_documents(read_table(spark, d, "documents"))


def p8_fill(spark, d):
    fill = packing.container_fill(packing.pack_documents(read_table(spark, d, "documents")))
    return fill.select(*[F.round(c, 4).alias(c) if t == "double" else c for c, t in fill.dtypes])


def p8_faults(spark, d):
    return packing.faults(packing.pack_documents(read_table(spark, d, "documents")))


def p9_rebuilt(spark, d):
    documents = read_table(spark, d, "documents")
    return segmentation.rebuilt(documents, Scratch(spark, "pieces").cut(segmentation.split_documents(documents)))


def queries():
    every = (p3_found, p3_splits, p4_found, p4_counts, p4_coverage, p5_found, p5_scores, p5_rates, p6_percentiles, p7_ids, p7_decoded, p8_containers, p8_fill, p8_faults, p9_pieces, p9_rebuilt)
    return {f.__name__: f for f in every}


_P3 = """
with recursive e as (
  select distinct nullif(regexp_replace(lower(trim(post_id)), '^t3_', ''), '') p,
         nullif(regexp_replace(regexp_replace(lower(regexp_replace(author, '^\\s+|\\s+$', '', 'g')), '^/?u/', ''), '^\\s+|\\s+$', '', 'g'), '') a from comments),
g as (select p, a from e where p is not null and a is not null and a not in ('[deleted]', 'deleted', '[removed]', 'removed')),
h as (select a, min(p) m from g group by 1 having count(*) > 1),
star as (select distinct g.p x, h.m y from g join h using (a) where g.p <> h.m),
both_ways as (select x, y from star union select y, x from star),
walk as (select distinct x p, x r from both_ways union select walk.p, both_ways.y from walk join both_ways on both_ways.x = walk.r)
select p as post_id, min(r) as group_id from walk group by 1
"""


def oracle_sql():
    long = " union all ".join(f"select model, product_category, '{m}' as metric, {m} + 0.0 as v from t" for m in percentiles.METRICS)
    ps = ", ".join(f"round(quantile_cont(v, {p / 100}), 6) + 0.0 as p{p}" for p in percentiles.PERCENTS)
    return {
        "p3_found": _P3,
        "p6_percentiles": f"with t as (select distinct * from thread_metrics_summary where thread_id is null or thread_id <> '__summary_mean__'), l as ({long}) "
        f"select model, product_category, metric, count(*) as n, {ps}, 0.0::double as max_error from l where v is not null and isfinite(v) group by all",
        "p8_faults": "select doc_id, 0 as wrong_parts, 0 as gaps from documents",
        "p9_rebuilt": "select doc_id, text from documents where text is not null",
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
