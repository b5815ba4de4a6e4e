"""Record schemas, value domains and subscriber flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WALL_SCHEMA = (
    "id BIGINT, owner_id BIGINT, from_id BIGINT, date BIGINT, text STRING, is_pinned INT, "
    "marked_as_ads INT, attachments ARRAY<STRUCT<type: STRING, photo: STRUCT<sizes: "
    "ARRAY<STRUCT<url: STRING, width: INT, height: INT>>>>>, source_id BIGINT"
)
CHAT_SCHEMA = (
    "chat_id BIGINT, id BIGINT, raw_text STRING, date TIMESTAMP, sender_id BIGINT, "
    "chat_username STRING, has_action BOOLEAN, has_sticker BOOLEAN, has_document BOOLEAN, "
    "has_video BOOLEAN"
)
ATTRIBUTES_TYPE = "STRUCT<duration: STRING, work_type: STRING, payment: STRING, address: STRING>"
PAYLOAD_SCHEMA = (
    "id STRING, source STRING, text STRING, source_post_url STRING, source_chat_url STRING, "
    f"attachments ARRAY<STRING>, attributes {ATTRIBUTES_TYPE}"
)
SAMPLES_SCHEMA = "post_id STRING, source_id STRING, source STRING, text STRING, label STRING"

# The domains and flag defaults the stored records use.
SOURCES = ["tg", "vk"]
DURATIONS = ["permanent", "full_shift", "short_task", "vahta", "unknown"]
WORK_TYPES = ["loader", "handyman", "specialist", "unknown"]
STATUS_RANK = {
    "new": 0,
    "coarse_filter_rejected": 1,
    "coarse_filter_passed": 1,
    "ml_filter_rejected": 2,
    "ml_filter_passed": 2,
    "attributes_extracted": 3,
}
QUARANTINED = "quarantined"  # status of a payload that does not decode
FLAG_DEFAULTS = {
    "src_vk": True,
    "src_tg": True,
    "payment_required": False,
    "address_required": False,
    "wt_loader": True,
    "wt_handyman": True,
    "wt_specialist": True,
    "wt_unknown": True,
    "dur_short_task": True,
    "dur_full_shift": True,
    "dur_permanent": True,
    "dur_vahta": True,
    "dur_unknown": True,
}
FLAGS = list(FLAG_DEFAULTS)


def status_rank(status: Column) -> Column:
    """Position of a status in the life of a post; later stages are higher."""
    pairs = [F.lit(x) for item in STATUS_RANK.items() for x in item]
    return F.element_at(F.create_map(*pairs), status)


def with_flag_defaults(df):
    """Fill flags that an older subscriber table lacks or leaves null."""
    out = df
    for flag, default in FLAG_DEFAULTS.items():
        value = F.coalesce(F.col(flag), F.lit(default)) if flag in df.columns else F.lit(default)
        out = out.withColumn(flag, value)
    return out
