"""The metric table's columns and the dimensions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUMMARY_ID = "__summary_mean__"
TEXT_COLUMNS = ("thread_id", "thread_title", "dominant_emotion")

# Metric names, their families, groups and selection families, and the domains.
FAMILIES = {
    "Diversity": ("self_bleu_4", "semantic_mean_cosine", "self_bertscore_mean_f1"),
    "Tone": ("hard_disagree_rate", "polite_rate", "impolite_rate", "neutral_rate"),
    "Structure": ("length_cv", "avg_depth", "structural_virality"),
    "Content": ("mean_story_probability", "emotion_entropy"),
    "Toxicity": ("toxicity_mean", "severe_toxicity_mean", "obscene_mean", "threat_mean"),
}
DOMAINS = ("credit_cards", "cameras", "cell_phones", "headphones", "laptops")
TOXICITY = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "aggression_score")
GROUPS = {
    "semantic_diversity": (
        "self_bleu_2", "self_bleu_3", "self_bleu_4", "self_bertscore_mean_f1", "self_bertscore_median_f1", "self_bertscore_top_k_mean_f1",
        "semantic_mean_cosine", "semantic_median_cosine", "semantic_top_k_mean_cosine", "semantic_p90_cosine",
    ),
    "story_anecdote": ("mean_story_probability",),
    "tone_civility": tuple(f"{t}_{s}" for t in TOXICITY if t != "severe_toxicity" for s in ("mean", "max", "p90")),
    "length_variation": ("length_std", "length_iqr", "length_cv"),
    "structure": ("comment_count", "pair_count", "max_depth", "avg_depth", "avg_branching_factor", "structural_virality"),
}
SELECTION = {
    "semantic_core": ("self_bleu_4", "self_bertscore_mean_f1", "semantic_mean_cosine"),
    "engagement_core": ("mean_story_probability", "avg_depth", "structural_virality"),
    "length_core": ("length_cv",),
    "guardrail_core": ("toxicity_mean", "aggression_score_mean"),
}
METRICS = (
    "comment_count", "pair_count", "mean_disagree_probability", "hard_disagree_rate", "self_bleu_2", "self_bleu_3", "self_bleu_4",
    "self_bertscore_mean_precision", "self_bertscore_mean_recall", "self_bertscore_mean_f1", "self_bertscore_median_f1", "self_bertscore_top_k_mean_f1",
    "semantic_mean_cosine", "semantic_median_cosine", "semantic_top_k_mean_cosine", "semantic_p90_cosine", "story_count", "not_story_count", "story_rate",
    "mean_story_probability", "emotion_entropy", "emotion_entropy_normalized", "avg_labels_per_comment", "emotion_shift_rate", "dominant_emotion_share",
    "polite_rate", "somewhat_polite_rate", "neutral_rate", "impolite_rate", "length_std", "length_iqr", "length_cv", "max_depth", "avg_depth",
    "avg_branching_factor", "structural_virality", *(f"{t}_{s}" for t in TOXICITY for s in ("mean", "max", "p90")),
)
#: Threads of a submission at least, and core metrics of a (model, domain) cell.
MIN_THREADS = 50
CORE = tuple(m for ms in FAMILIES.values() for m in ms)


def dimension(spark: SparkSession, of: dict[str, tuple], name: str) -> DataFrame:
    """(metric, name), a small table of fixed size."""
    return spark.createDataFrame([(m, g) for g, ms in of.items() for m in ms], f"metric string, {name} string")
