"""Human review: queue, decisions, labels, and what they change.

Decisions are a table (seq, item_id, cluster_id, action, reviewer, ts, comment,
members, original_members, score); the later row wins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import settings as S
from lodestone.operators.classify import train, tune_threshold
from lodestone.operators.order import with_rank

APPROVE, REJECT, EDIT = "approve", "reject", "edit"
SCHEMA = "seq long, item_id long, cluster_id long, action string, reviewer string, ts string, comment string, members array<long>, original_members array<long>, score double"


def build_queue(clusters: DataFrame, threshold: float, tiers: tuple[str, ...] = ("MEDIUM", "UNKNOWN"), limit: int | None = None) -> DataFrame:
    """Clusters to review, the most uncertain first (ties by cluster_id); a limit of 0 or None is none."""
    gap = F.abs(F.col("min_score") - threshold)
    rows = clusters.where(F.col("tier").isin(*tiers)).withColumn("uncertainty", gap)
    if limit:
        rows = rows.orderBy("uncertainty", "cluster_id").limit(limit)
    told = rows.select(F.col("cluster_id").cast("long").alias("cluster_id"), "members", "tier", F.col("min_score").alias("score"), "uncertainty", "cpses", F.col("tier_reason").alias("reason"))
    return with_rank(told, ["uncertainty", "cluster_id"], "item_id").select("item_id", *told.columns)


def decision(seq: int, item, action: str, reviewer: str, comment: str = "", corrected: list[int] | None = None, ts: str | None = None) -> tuple:
    """A validated decision on a queue item, as a row of ``SCHEMA``."""
    if action not in (APPROVE, REJECT, EDIT):
        raise ValueError(f"unknown action {action!r}")
    if not reviewer or not reviewer.strip():
        raise ValueError("a decision needs a reviewer")
    if action == EDIT and not corrected:
        raise ValueError("an edit must give the corrected members")
    members = list(corrected) if action == EDIT else list(item["members"])
    return (seq, item["item_id"], item["cluster_id"], action, reviewer.strip(), ts or dt.datetime.now(dt.timezone.utc).isoformat(), comment, members, list(item["members"]), float(item["score"]))


def append_decisions(spark: SparkSession, rows: list[tuple], path: str) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def labelled_pairs(decisions: DataFrame) -> DataFrame:
    """(seq, a, b, label): approve 1 for all pairs, reject 0 for the original's, edit 1 among kept and 0 from kept to removed."""
    kept = F.array_sort(F.array_distinct("members"))
    old = F.array_sort(F.array_distinct("original_members"))
    pair = lambda x, y, v: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(v).alias("label"))
    within = lambda arr, v: F.flatten(F.transform(arr, lambda x: F.transform(F.filter(arr, lambda y: y > x), lambda y: pair(x, y, v))))
    across = F.flatten(F.transform(kept, lambda x: F.transform(F.array_except(old, kept), lambda y: pair(x, y, 0))))
    rows = F.when(F.col("action") == APPROVE, within(kept, 1)).when(F.col("action") == REJECT, within(old, 0)).otherwise(F.concat(within(kept, 1), across))
    return decisions.select("seq", F.explode(rows).alias("p")).select("seq", "p.a", "p.b", "p.label")


def decisions_to_labels(decisions: DataFrame) -> DataFrame:
    """(a, b, label): the last label of each pair."""
    return labelled_pairs(decisions).groupBy("a", "b").agg(F.max_by("label", F.struct("seq", "label")).alias("label"))


def apply_decisions(clusters: DataFrame, decisions: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Clusters after the last decision on each: rejected ones go, others are HIGH; an edit trims members and edges.

    With ``records``, owners, the cross flag and the fewest known attributes of an
    edited cluster are told anew.
    """
    last = decisions.groupBy("cluster_id").agg(F.max_by(F.struct("action", "reviewer", "ts", "members"), "seq").alias("d")).select(F.col("cluster_id").alias("_c"), "d")
    rows = clusters.join(last, F.col("cluster_id") == F.col("_c"), "left")
    act = F.col("d.action")
    edited = act == EDIT
    rows = rows.where(act.isNull() | (act != REJECT))
    keep = F.array_sort(F.array_distinct("d.members"))
    edges = F.filter("edges", lambda e: F.array_contains("d.members", e["a"]) & F.array_contains("d.members", e["b"]))
    rows = rows.withColumns({"members": F.when(edited, keep).otherwise(F.col("members")), "edges": F.when(edited, edges).otherwise(F.col("edges"))}).where(~F.coalesce(edited, F.lit(False)) | (F.size("members") > 1))
    w = F.transform("edges", lambda e: e["w"])
    some = F.coalesce(edited, F.lit(False)) & (F.size("edges") > 0)
    mean = F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / F.size("edges")
    none = F.coalesce(edited, F.lit(False)) & (F.size("edges") == 0)
    rows = rows.withColumns({
        "mean_score": F.when(some, mean).when(none, F.col("min_score")).otherwise(F.col("mean_score")),
        "min_score": F.when(some, F.array_min(w)).otherwise(F.col("min_score")),
        "size": F.size("members"),
        "tier": F.when(act.isNotNull(), F.lit("HIGH")).otherwise(F.col("tier")),
        "tier_reason": F.when(act.isNotNull(), F.format_string("Confirmed by %s at %s (%s).", "d.reviewer", "d.ts", "d.action")).otherwise(F.col("tier_reason")),
    }).drop("_c", "d")
    if records is None:
        return rows
    info = rows.select("cluster_id", F.explode("members").alias("rid")).join(records.select("rid", F.col(S.OWNER).alias("o"), "n_known_attributes"), "rid")
    fresh = info.groupBy("cluster_id").agg(F.sort_array(F.collect_set("o")).alias("_o"), F.min("n_known_attributes").cast("int").alias("_k"))
    return rows.join(fresh, "cluster_id", "left").withColumns({"cpses": F.col("_o"), "is_cross_cpse": F.size("_o") > 1, "min_known_attrs": F.col("_k")}).drop("_o", "_k").select(*clusters.columns)


def recalibrate_threshold(scored: DataFrame, decisions: DataFrame, current: float, score: str = "match_probability") -> float:
    """A quarter of the way to the best F1 on the labels; unchanged under 100 labels or with one class."""
    labels = decisions_to_labels(decisions)
    if labels.count() < S.MIN_LABELS:
        return current
    rows = labels.join(scored.select("a", "b", F.col(score).alias("p")), ["a", "b"])
    if rows.select("label").distinct().count() < 2:
        return current
    return (1 - S.BLEND) * current + S.BLEND * tune_threshold(rows)[0]


def retrain_with_feedback(scored: DataFrame, labels: DataFrame, decisions: DataFrame, feedback_weight: int = 5, **kw):
    """Training with the reviewers' labels in place, weighted; weights touch training rows only."""
    given = decisions_to_labels(decisions).withColumnRenamed("label", "reviewer_label")
    rows = scored.join(given, ["a", "b"], "left").withColumn("feedback_weight", F.when(F.col("reviewer_label").isNotNull(), F.lit(float(feedback_weight))).otherwise(1.0))
    return train(rows.withColumn("reviewer_label", F.coalesce("reviewer_label", F.lit(-1))), labels, reviewer="reviewer_label", weight="feedback_weight", **kw)


def measure_improvement(before: dict, after: dict, n_decisions: int, n_labelled_pairs: int, threshold_before: float, threshold_after: float) -> dict[str, float]:
    out = {"n_decisions": n_decisions, "n_labelled_pairs": n_labelled_pairs, "threshold_before": threshold_before, "threshold_after": threshold_after}
    for k in ("precision", "recall", "f1"):
        out |= {f"{k}_before": before.get(k, 0.0), f"{k}_after": after.get(k, 0.0)}
    return out | {"delta_f1": out["f1_after"] - out["f1_before"]}


def simulate_reviews(queue: DataFrame, labels: DataFrame, n: int = 25, reviewer: str = "sim.reviewer", ts: str = "1970-01-01T00:00:00+00:00") -> DataFrame:
    """Decisions from the truth on the first n items: approve one group, reject where no group has two, else keep the most common (smallest name on ties)."""
    rows = queue.where(F.col("item_id") < n).select("*", F.explode("members").alias("rid")).join(labels.select("rid", "gt_group"), "rid", "left")
    groups = rows.groupBy("item_id", "gt_group").agg(F.sort_array(F.collect_list("rid")).alias("m"))
    best = groups.groupBy("item_id").agg(F.min(F.struct(-F.size("m"), "gt_group", "m"))["m"].alias("correct"))
    out = queue.join(best, "item_id")
    k = F.size("correct")
    action = F.when(k == F.size("members"), F.lit(APPROVE)).when(k < 2, F.lit(REJECT)).otherwise(EDIT)
    return out.select(
        F.col("item_id").alias("seq"), "item_id", "cluster_id", action.alias("action"), F.lit(reviewer).alias("reviewer"), F.lit(ts).alias("ts"), F.lit("Simulated decision derived from ground truth.").alias("comment"),
        F.when(action == EDIT, F.col("correct")).otherwise(F.col("members")).alias("members"), F.col("members").alias("original_members"), "score",
    )
