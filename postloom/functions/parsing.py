"""Columns for stage payloads, model replies and bot callbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import strip_spaces
from postloom.schemas import DURATIONS, PAYLOAD_SCHEMA, SOURCES, WORK_TYPES

# Reply strings that mean "not given".
NULL_STRINGS = [
    "null",
    "none",
    "-",
    "не указано",
    "не указан",
    "не удалось определить",
    "не удалось однозначно определить",
]
REPLY_SCHEMA = "duration STRING, work_type STRING, payment STRING, address STRING"
CORRUPT = "_corrupt"


def parse_enum(value: Column, domain: list[str]) -> Column:
    """Domain value in lower case, else `unknown`."""
    key = F.lower(strip_spaces(value))
    return F.when(key.isin(domain), key).otherwise(F.lit("unknown"))


def clean_optional(value: Column) -> Column:
    """Trimmed string; empty and null-like strings become null."""
    text = strip_spaces(value)
    return F.when((text == "") | F.lower(text).isin(NULL_STRINGS), F.lit(None)).otherwise(text)


def parse_reply(reply: Column) -> Column:
    """Model reply text to a struct of attributes plus `valid`.

    `valid` is false where the reply is not a JSON object; its fields are then null.
    """
    parsed = F.from_json(
        reply, f"{REPLY_SCHEMA}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT}
    )
    valid = F.coalesce(parsed.isNotNull() & parsed[CORRUPT].isNull(), F.lit(False)) & F.coalesce(
        strip_spaces(reply).startswith("{"), F.lit(False)
    )

    def good(value: Column) -> Column:
        return F.when(valid, value)

    return F.struct(
        valid.alias("valid"),
        good(parse_enum(parsed["duration"], DURATIONS)).alias("duration"),
        good(parse_enum(parsed["work_type"], WORK_TYPES)).alias("work_type"),
        good(clean_optional(parsed["payment"])).alias("payment"),
        good(clean_optional(parsed["address"])).alias("address"),
    )


def encode_payload(post: Column) -> Column:
    """Post struct to JSON, nulls kept."""
    return F.to_json(post, {"ignoreNullFields": "false"})


def decode_payload(payload: Column) -> Column:
    """JSON to a post struct plus `error`, null for a good record.

    Missing keys and values outside the domains are errors, so that bad records
    can go to a quarantine table instead of stopping the stage.
    """
    post = F.from_json(
        payload, f"{PAYLOAD_SCHEMA}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT}
    )
    keys = F.json_object_keys(payload)
    attributes = F.get_json_object(payload, "$.attributes")
    attribute_keys = F.json_object_keys(attributes)
    required = ["id", "source", "text", "source_post_url", "source_chat_url", "attachments", "attributes"]
    inner = ["duration", "work_type", "payment", "address"]

    def lacks(names: list[str], present: Column) -> Column:
        wanted = F.array(*[F.lit(n) for n in names])
        return F.coalesce(F.size(F.array_except(wanted, present)) > 0, F.lit(True))

    def outside(value: Column, domain: list[str]) -> Column:
        return ~F.coalesce(value.isin(domain), F.lit(False))

    has_attributes = attributes.isNotNull()
    error = (
        F.when(post.isNull() | post[CORRUPT].isNotNull() | keys.isNull(), F.lit("not a JSON object"))
        .when(lacks(required, keys), F.lit("missing key"))
        .when(post["id"].isNull(), F.lit("no id"))
        .when(post["attachments"].isNull(), F.lit("no attachments"))
        .when(outside(post["source"], SOURCES), F.lit("unknown source"))
        .when(has_attributes & lacks(inner, attribute_keys), F.lit("missing key"))
        .when(has_attributes & outside(post["attributes"]["duration"], DURATIONS), F.lit("unknown duration"))
        .when(has_attributes & outside(post["attributes"]["work_type"], WORK_TYPES), F.lit("unknown work type"))
    )
    return F.struct(post.alias("post"), error.alias("error"))


def callback_number(data: Column, prefix: str) -> Column:
    """N of a `cat<N>`, `f<N>` or `opt<N>` callback, null for other data and beyond 64 bits."""
    digits = F.regexp_extract(strip_spaces(F.coalesce(data, F.lit(""))), f"^{prefix}([0-9]+)$", 1)
    return digits.try_cast("bigint")


def callback_data(payload: Column) -> Column:
    """Callback string inside a `{"d": …}` payload, '' where there is none."""
    return F.coalesce(F.get_json_object(payload, "$.d"), F.lit(""))


def is_start_payload(payload: Column) -> Column:
    """Payload is an object whose command is `start`."""
    return F.coalesce(F.get_json_object(payload, "$.command") == "start", F.lit(False))
