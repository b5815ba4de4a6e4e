"""Status log, stage decisions, latest-state views and the stage funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.schemas import FLAG_DEFAULTS, FLAGS, QUARANTINED, STATUS_RANK, status_rank, with_flag_defaults


def status_transition(passed: Column, stage: str) -> Column:
    """`<stage>_passed` or `<stage>_rejected`; an unknown outcome is a rejection."""
    return F.when(passed, F.lit(f"{stage}_passed")).otherwise(F.lit(f"{stage}_rejected"))


def status_latest(log: DataFrame) -> DataFrame:
    """Furthest status per post; a replayed message cannot move a post back.

    Of two outcomes of one stage the rejection is the later word. Payloads that did not decode have no
    post and so no row here; `stage_funnel` counts them.
    """
    order = F.struct(F.coalesce(status_rank(F.col("status")), F.lit(-1)), "status")
    known = log.where("post_id IS NOT NULL")
    return known.groupBy("post_id").agg(F.max_by("status", order).alias("status"))


def latest_rows(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of an append-only change table (upsert by last version).

    An aggregate, not a window: a key changed very often is reduced before the shuffle.
    """
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
    return newest.select(*keys, "row.*").drop(version)


def stage_funnel(posts: DataFrame) -> DataFrame:
    """Posts per source and status, one column per status; quarantined payloads may have a null source."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in [*STATUS_RANK, QUARANTINED]]
    return posts.groupBy("source").agg(*counts)


def active_subscribers(subscribers: DataFrame) -> DataFrame:
    return subscribers.where("status = 'active'")


def subscriber_upsert(profiles: DataFrame, seen: DataFrame) -> DataFrame:
    """Profiles plus a default one for every sender seen for the first time.

    Flags that an older table lacks, or leaves null, get their defaults.
    """
    profiles = with_flag_defaults(profiles)
    senders = seen.select("platform", "external_id").distinct()
    joined = profiles.join(senders, ["platform", "external_id"], "full_outer")
    flags = [F.coalesce(F.col(f), F.lit(FLAG_DEFAULTS[f])).alias(f) for f in FLAGS]
    return joined.select(
        "platform", "external_id", F.coalesce("status", F.lit("active")).alias("status"), *flags
    )


def attach_attributes(posts: DataFrame, attributes: DataFrame) -> DataFrame:
    """Posts with an `attributes` struct, null where none was extracted."""
    packed = attributes.select(
        "post_id", F.struct("duration", "work_type", "payment", "address").alias("attributes")
    )
    return posts.join(packed, "post_id", "left")
