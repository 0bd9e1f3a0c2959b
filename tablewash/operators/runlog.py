"""Scoring logs of cleaning runs: (run_id, step, action_type, column, valid, cost,
initial_budget, quality), any number of runs of any length. (run_id, step) identifies a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.errors import require_columns
from tablewash.operators.ordered import Running, running
from tablewash.operators.quality import clamp

# Reward scale and penalties, weights of the final score.
REWARD_SCALE = 10.0
INVALID_PENALTY, DROP_PENALTY, REDUNDANT_PENALTY = 0.5, 0.3, 0.1
DROP_TOLERANCE = 0.001
QUALITY_WEIGHT, VALIDATION_WEIGHT, EFFICIENCY_WEIGHT, ACTION_WEIGHT, SCHEMA_WEIGHT = 0.40, 0.20, 0.15, 0.10, 0.15
DEDUP = "drop_duplicates"

LOG_COLUMNS = ("run_id", "step", "action_type", "column", "valid", "cost", "initial_budget", "quality")


def score_steps(log: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per step: ``best_before`` (best quality so far, from 0), ``gain`` over it, ``used`` budget
    up to here, ``redundant``, ``penalty`` and ``reward``. Long runs are cut into buckets of steps
    with the state carried across, so a run may hold any share of the log."""
    require_columns(log, *LOG_COLUMNS)
    walked = running(log, ["step"], [
        Running("best", "max_before", F.col("quality")),
        Running("used", "sum", F.col("cost")),
        Running("previous_action", "previous", F.col("action_type")),
    ], partition_by=["run_id"], buckets=buckets)
    walked = running(walked, ["step"], [Running("earlier", "rank")],
                     partition_by=["run_id", "action_type", "column"], buckets=buckets)
    # A second deduplication is fair unless it directly follows the first.
    repeated = F.when(F.col("action_type") == DEDUP, F.coalesce(F.col("previous_action") == DEDUP, F.lit(False)))
    best = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0))
    drop = F.col("best_before") - F.col("quality")
    penalty = (
        F.when(~F.col("valid"), INVALID_PENALTY)
        .when(F.col("quality") < F.col("best_before") - DROP_TOLERANCE, DROP_PENALTY + drop)
        .when(F.col("redundant"), REDUNDANT_PENALTY).otherwise(0.0)
    )
    share = F.col("cost") / F.greatest(F.col("initial_budget"), F.lit(1))
    return (
        walked.withColumns({"best_before": best, "redundant": repeated.otherwise(F.col("earlier") > 0)})
        .withColumn("gain", F.greatest(F.col("quality") - F.col("best_before"), F.lit(0.0)))
        .withColumn("penalty", penalty)
        .withColumn("reward", F.round(F.col("gain") * REWARD_SCALE, 6) - F.round("penalty", 6) - F.round(share, 6))
        .drop("best", "earlier", "previous_action")
    )


def action_quality(log: DataFrame) -> DataFrame:
    """Per run 1 - repeated/all, where every repetition of an action on a column counts. Steps
    are counted per action and column before they meet in their run."""
    kinds = log.groupBy("run_id", "action_type", "column").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("run_id").agg(
        F.sum("n").alias("steps"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
        (1 - (F.sum("n") - F.count(F.lit(1))) / F.sum("n")).alias("action_quality"))


def efficiency(log: DataFrame) -> DataFrame:
    """Per run the unused share of the budget."""
    used, budget = F.sum("cost"), F.max("initial_budget")
    return log.groupBy("run_id").agg(
        used.alias("budget_used"), budget.alias("initial_budget"),
        F.when(budget > 0, 1 - used / budget).otherwise(F.lit(1.0)).alias("efficiency"))


def final_scores(log: DataFrame, results: DataFrame) -> DataFrame:
    """Per run the final score, and the ``weighted`` sum it is rounded from. ``results`` has (run_id, quality, validation, schema_accuracy) of
    each run's last table."""
    parts = results.join(efficiency(log), "run_id").join(action_quality(log), "run_id")
    score = sum(
        (F.lit(w) * clamp(F.col(c)) for c, w in (
            ("quality", QUALITY_WEIGHT), ("validation", VALIDATION_WEIGHT), ("efficiency", EFFICIENCY_WEIGHT),
            ("action_quality", ACTION_WEIGHT), ("schema_accuracy", SCHEMA_WEIGHT))),
        start=F.lit(0.0),
    )
    return parts.withColumn("weighted", score).withColumn("score", clamp(F.col("weighted")))


def leaderboard(scores: DataFrame) -> DataFrame:
    """One line per run, as in a report."""
    return scores.select(
        "run_id", F.round("score", 3).alias("score"), F.round("quality", 3).alias("quality"),
        F.round("validation", 3).alias("validation"), F.round("efficiency", 3).alias("efficiency"),
        "steps", F.concat_ws("/", F.col("budget_used").cast("string"), F.col("initial_budget").cast("string")).alias("budget"))


def average_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("runs"), clamp(F.avg("score")).alias("average_score"))
