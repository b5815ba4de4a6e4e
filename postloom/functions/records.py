"""Columns that flatten wall records and chat messages into post rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import strip_spaces


def wall_owner(owner_id: Column, source_id: Column) -> Column:
    """Owner named by the record, else the registry id it was read from."""
    return F.coalesce(owner_id.cast("bigint"), source_id.cast("bigint"))


def nullable_author(author_id: Column) -> Column:
    return author_id.cast("bigint")


def wall_url(owner_id: Column, item_id: Column) -> Column:
    return F.concat(F.lit("https://vk.com/wall"), owner_id.cast("string"), F.lit("_"), item_id.cast("string"))


def chat_url(chat_id: Column, username: Column, item_id: Column) -> Column:
    """Public link by username, else the private link by bare chat number."""
    bare = F.replace(
        F.replace(chat_id.cast("string"), F.lit("-100"), F.lit("")), F.lit("-"), F.lit("")
    )
    place = F.when(F.length(username) > 0, username).otherwise(F.concat(F.lit("c/"), bare))
    return F.concat(F.lit("https://t.me/"), place, F.lit("/"), item_id.cast("string"))


def best_photo_urls(attachments: Column) -> Column:
    """URL of the largest rendition of every photo, in order; the first wins a tie.

    A photo whose largest rendition has no URL is left out.
    """

    def largest(att: Column) -> Column:
        ranked = F.transform(
            att["photo"]["sizes"],
            lambda s, i: F.struct(
                (
                    F.coalesce(s["width"], F.lit(0)).cast("bigint")
                    * F.coalesce(s["height"], F.lit(0)).cast("bigint")
                ).alias("area"),
                (-i).alias("first"),
                s["url"].alias("url"),
            ),
        )
        return F.array_max(ranked)["url"]

    photos = F.filter(
        F.coalesce(attachments, F.array()),
        lambda a: (a["type"] == "photo") & (F.size(a["photo"]["sizes"]) > 0),
    )
    return F.filter(F.transform(photos, largest), lambda u: F.length(u) > 0)


def has_text(text: Column) -> Column:
    """Wall rule: spaces count as text."""
    return F.coalesce(text != "", F.lit(False))


def not_ads(marked: Column) -> Column:
    return F.coalesce(marked, F.lit(0)) != 1


def processable_chat(text: Column, action: Column, sticker: Column, document: Column, video: Column) -> Column:
    """Chat rule: real text, no service action, no sticker, documents only as video."""
    no = F.lit(False)
    return (
        (strip_spaces(F.coalesce(text, F.lit(""))) != "")
        & ~F.coalesce(action, no)
        & ~F.coalesce(sticker, no)
        & (~F.coalesce(document, no) | F.coalesce(video, no))
    )


def long_enough(text: Column, minimum: int = 30) -> Column:
    """At least `minimum` code points."""
    return F.coalesce(F.length(text) >= minimum, F.lit(False))
