"""The queue of lots to process: gates, order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READY = "ready"


def queue(workspaces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lots of the queue that can run, lowest number first: ready ones with a template.

    chosen: name, template_id of what was queued; a lot queued twice is there once.
    """
    picked = chosen.where(F.coalesce("template_id", F.lit("")) != "").groupBy("name").agg(F.min("template_id").alias("template_id"))
    return workspaces.where(F.col("status") == READY).join(picked, "name").orderBy("lot_number", "name")


def gate(status: Column, has_outputs: Column, confirmed: Column, threshold: Column) -> Column:
    """Why a lot may not run, null if it may (P28): the first of unknown, incomplete, unconfirmed, threshold."""
    return (
        F.when(status.isNull(), F.lit("Lot not found"))
        .when(status != READY, F.lit("Lot is incomplete and cannot be processed"))
        .when(F.coalesce(has_outputs, F.lit(False)) & ~F.coalesce(confirmed, F.lit(False)), F.lit("Lot already has generated outputs and requires confirmation"))
        .when(F.coalesce((threshold < 0) | (threshold > 1), F.lit(True)), F.lit("paperThreshold must be between 0 and 1"))
    )


def queue_counts(results: DataFrame) -> DataFrame:
    """One row: runs that went well, that failed, and that replaced outputs (A25). results: status, had_outputs."""
    status = F.col("status")
    return results.agg(
        F.count_if(status == "success").alias("success_count"),
        F.count_if(status == "error").alias("failure_count"),
        F.count_if("had_outputs").alias("regenerate_count"),
    )
