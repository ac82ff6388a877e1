"""Job vocabulary, lifecycle states and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfield.functions.clean import coded

# Fixed values that results must agree with.
JOB_KINDS = {
    "collection": "collection", "collect_race": "collection", "preprocess_race": "collection", "enrichment": "enrichment", "enrich_race": "enrichment",
    "analysis": "analysis", "prediction": "prediction", "improvement": "improvement", "batch": "batch", "batch_collect": "batch", "full_pipeline": "batch",
}
DISPATCH_ACTIONS = {
    "collect_race": "collect_race", "collection": "collect_race", "preprocess_race": "preprocess_race", "enrich_race": "enrich_race", "enrichment": "enrich_race",
    "analysis": "analysis", "prediction": "prediction", "improvement": "improvement", "batch_collect": "batch_collect", "batch": "batch_collect", "full_pipeline": "full_pipeline",
}
LIFECYCLE = {
    "pending": "pending", "queued": "queued", "processing": "processing", "running": "processing", "retrying": "processing",
    "completed": "completed", "failed": "failed", "cancelled": "cancelled",
}
TERMINAL = ["completed", "failed", "cancelled"]


def _known(c: Column, codes: dict, what: str, strict: bool) -> Column:
    found = coded(c, codes)
    if not strict:
        return found
    return F.when(c.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)).cast("string"))


def job_kind(c: Column, *, strict: bool = False) -> Column:
    """The job kind of an alias; an unknown one is null, or an error if ``strict``."""
    return _known(c, JOB_KINDS, "job kind", strict)


def dispatch_action(c: Column, *, strict: bool = False) -> Column:
    """The action of an alias; an unknown one is null, or an error if ``strict``."""
    return _known(c, DISPATCH_ACTIONS, "job kind", strict)


def lifecycle(c: Column) -> Column:
    """The lifecycle state of an alias, null if unknown."""
    return coded(c, LIFECYCLE)


def shadow(c: Column, normalised: Column) -> Column:
    """The normalised value, or the raw one where it is unknown."""
    return F.coalesce(normalised, c)


def progress(status: Column, kind: Column, finished_steps: Column) -> Column:
    """0 to 100 by state; pipelines count their finished steps."""
    running = F.when((kind == "full_pipeline") & finished_steps.isNotNull(), 10 + 30 * finished_steps).otherwise(50)
    return F.when(status == "completed", 100).when(status == "queued", 5).when(status == "processing", running).otherwise(0)


def cancelled(status: Column) -> Column:
    """The state after a cancel request: terminal states stay."""
    return F.when(status.isin(TERMINAL), status).otherwise("cancelled")


def usage_outcome(status_code: Column) -> Column:
    """success below 400."""
    return F.when(status_code < 400, "success").otherwise("failure")
