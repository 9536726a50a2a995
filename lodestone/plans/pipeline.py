"""The matching pipeline from records to clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lodestone.functions.attributes import with_attributes
from lodestone.operators import blocking, classify, matching, scoring
from lodestone.operators.profile import truth_pairs
from lodestone.operators.semantic import SemanticEncoder
from lodestone.storage import materialize


@dataclass
class Run:
    records: DataFrame
    scored: DataFrame
    clusters: DataFrame
    counts: dict
    tiers: classify.TierThresholds
    report: classify.ClassifierReport | None


def run(records: DataFrame, labels: DataFrame | None = None, model=None, families: list[str] | None = None, encoder: SemanticEncoder | None = None, vectors: DataFrame | None = None, model_name: str = "gradient_boosting", iterations: int = 200) -> Run:
    """Normalize, extract, block, score, classify, cluster and tier.

    With labels a classifier is trained and thresholds are tuned on records that
    the test side doesn't hold; with a model its fixed thresholds are used; with
    neither the fused score and its fallback thresholds.
    """
    attributed = materialize(with_attributes(records), "run-records")
    pairs = blocking.candidate_pairs(blocking.build_blocks(attributed, families), families=families)
    scored = materialize(scoring.score_pairs(attributed, pairs, vectors, encoder), "run-scored")
    report, edge, score = None, None, "match_probability"
    if labels is not None:
        model, report = classify.train(scored, labels, model_name, iterations=iterations)
        scored = materialize(classify.predict_proba(model, scored, "match_probability"), "run-predicted")
        sides = labels.join(classify.group_sides(labels), "gt_group").where("side <> 'test'").select("rid")
        edge, sweep = matching.tune_edge_threshold(scored, attributed, truth_pairs(labels), sides)
        tiers = classify.tiers_from_sweep(sweep, edge)
    elif model is not None:
        scored = materialize(classify.predict_proba(model, scored, "match_probability"), "run-predicted")
        tiers = classify.pretrained_tiers()
        edge = tiers.medium
    else:
        tiers, score = classify.fallback_tiers(), "fused"
        edge = tiers.medium
    clusters, counts = matching.run_matching(scored, attributed, tiers.high, tiers.medium, edge, score)
    return Run(attributed, scored, clusters, counts, tiers, report)

