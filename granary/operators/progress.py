"""A training run's steps: what each step triggers, and whether a saved progress record is one of a whole update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_steps(log: DataFrame, evaluation: int, checkpoint: int, diagnostics: int) -> DataFrame:
    """run, step, validates, saves, diagnoses for every step of (run, step); a run's last step always validates and never saves in between."""
    step, last = F.col("step"), F.col("step") == F.col("last_step")
    rows = log.select("run", "step").join(log.groupBy("run").agg(F.max("step").alias("last_step")), "run")
    saves = (step % checkpoint == 0) & ~last if checkpoint else F.lit(False)
    return rows.select("run", "step", ((step % evaluation == 0) | last).alias("validates"), saves.alias("saves"), ((step == 1) | last | (step % diagnostics == 0)).alias("diagnoses"))


def progress_faults(progress: DataFrame, *, steps_per_epoch: int, accumulation: int, tokens_per_step: int, total: int) -> DataFrame:
    """Adds `fault`, null for records (epoch, next_batch, global_step, tokens_seen, clipped_steps) of a completed update."""
    c = F.col
    fault = (
        F.when((c("global_step") < 0) | (c("global_step") > total), "step")
        .when((c("next_batch") % accumulation != 0) | (c("next_batch") < 0) | (c("next_batch") >= steps_per_epoch * accumulation), "cursor")
        .when(c("global_step") != c("epoch") * steps_per_epoch + F.floor(c("next_batch") / accumulation), "position")
        .when(c("clipped_steps") > c("global_step"), "clipped")
        .when(c("tokens_seen") != c("global_step") * tokens_per_step, "tokens")
    )
    return progress.withColumn("fault", fault)
