"""Queries on status, attributes, publishing and subscriber delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions.records import long_enough
from postloom.operators import delivery as d
from postloom.operators import status as st
from postloom.plans import bindings as b
from postloom.plans.bindings import Tables, sql
from postloom.schemas import DURATIONS, FLAG_DEFAULTS, FLAGS, QUARANTINED, STATUS_RANK, WORK_TYPES

_PA = (b.POSTS_SQL, b.ATTRIBUTES_SQL)


def _posts(t: Tables):
    return st.attach_attributes(b.posts(t), b.attributes(t)).withColumn("attachments", b.photos())


def _bodies(t: Tables):
    body = d.format_post(*[F.col(c) for c in ("source", "text", "source_chat_url", "source_post_url", "attributes")])
    return _posts(t).withColumn("body", body)


def _label_sql(column: str, labels: dict, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"coalesce(CASE {column} {cases} END, {default})"


_UNKNOWN = f"'{d.UNKNOWN_TEXT}'"
BODY_SQL = f"""bodies AS (SELECT p.*, duration, work_type, payment, address, {b.PHOTOS_SQL.replace('post_id', 'p.post_id')} AS photos,
  '{d.HEADER}' || chr(10) || chr(10) || '🕒 Длительность - ' || {_label_sql('duration', d.DURATION_LABELS, _UNKNOWN)} || chr(10)
  || '🔨 Характер работы - ' || {_label_sql('work_type', d.WORK_TYPE_LABELS, _UNKNOWN)} || chr(10)
  || '💵 Оплата - ' || coalesce(nullif(payment, ''), {_UNKNOWN}) || chr(10)
  || '📍 Адрес - ' || coalesce(nullif(address, ''), {_UNKNOWN}) || chr(10) || chr(10) || 'Исходный текст:' || chr(10)
  || text || chr(10) || chr(10) || 'Источник - ' || {_label_sql('source', d.SOURCE_LABELS, 'source')} || ', ' || source_chat_url || chr(10)
  || 'Исходная публикация - ' || source_post_url AS body
  FROM posts p LEFT JOIN attributes a ON a.post_id = p.post_id)"""


def formatted(t: Tables):
    return _bodies(t).select("post_id", "body")


def summaries(t: Tables):
    return b.subscribers(t).select("external_id", d.settings_summary().alias("summary"))


def _summary_sql() -> str:
    lines = [
        """'1) Источники: ' || CASE WHEN src_vk AND src_tg THEN 'VK и Telegram' WHEN src_vk THEN 'только VK'
           WHEN src_tg THEN 'только Telegram' ELSE '—' END"""
    ]
    for number, (label, flag, yes, no) in enumerate(d.SUMMARY_LABELS, start=2):
        lines.append(f"'{number}) {label}: ' || CASE WHEN {flag} THEN '{yes}' ELSE '{no}' END")
    return sql(b.SUBSCRIBERS_SQL, body="SELECT external_id, " + " || chr(10) || ".join(lines) + " AS summary FROM subscribers")


def categories(t: Tables):
    named = {"source": "Источник заявок", "pay": "Оплата и адрес", "work": "Характер работы", "time": "Длительность"}
    return b.subscribers(t).select("external_id", *[d.category_summary(c).alias(k) for k, c in named.items()])


def _yes(number: int, label: str, flag: str) -> str:
    return f"'{number}) {label}: ' || CASE WHEN {flag} THEN 'да' ELSE 'нет' END"


CATEGORIES_SQL = sql(
    b.SUBSCRIBERS_SQL,
    body=f"""SELECT external_id, '1) Источники: ' || CASE WHEN src_vk AND src_tg THEN 'VK и Telegram' WHEN src_vk THEN 'только VK'
        WHEN src_tg THEN 'только Telegram' ELSE '—' END AS source,
      '1) Оплата: ' || CASE WHEN payment_required THEN 'только с указанной оплатой' ELSE 'с оплатой и без' END || chr(10) ||
        '2) Адрес: ' || CASE WHEN address_required THEN 'только с указанным адресом' ELSE 'с адресом и без' END AS pay,
      {_yes(1, 'Заявки для разнорабочих', 'wt_handyman')} || chr(10) || {_yes(2, 'Заявки для грузчиков', 'wt_loader')} || chr(10) ||
        {_yes(3, 'Заявки для узких специалистов', 'wt_specialist')} || chr(10) ||
        {_yes(4, 'Заявки с неопределённым характером работы', 'wt_unknown')} AS work,
      {_yes(1, 'Короткие разовые заявки', 'dur_short_task')} || chr(10) || {_yes(2, 'Разовые на целую смену', 'dur_full_shift')} || chr(10) ||
        {_yes(3, 'Постоянная работа', 'dur_permanent')} || chr(10) || {_yes(4, 'Вахта', 'dur_vahta')} || chr(10) ||
        {_yes(5, 'Заявки с неопределённой длительностью', 'dur_unknown')} AS time
    FROM subscribers""",
)


def policy(t: Tables):
    return _posts(t).where(d.publish_policy(F.col("attributes.duration"))).select("post_id", "source")


POLICY_SQL = sql(
    *_PA,
    body="""SELECT p.post_id, source FROM posts p LEFT JOIN attributes a ON a.post_id = p.post_id
      WHERE coalesce(duration, '') NOT IN ('permanent', 'vahta')""",
)

# ---- status --------------------------------------------------------------------------------


def _log(t: Tables):
    """Every post's decisions, with the first stage replayed at the end."""
    posts = b.posts(t)
    coarse = long_enough(F.col("text"))
    new = posts.select("post_id", F.lit("new").alias("status"))
    first = posts.select("post_id", st.status_transition(coarse, "coarse_filter").alias("status"))
    ml = posts.where(coarse).select(
        "post_id", st.status_transition(F.col("post_id") % 3 != 0, "ml_filter").alias("status")
    )
    done = posts.where(coarse & (F.col("post_id") % 3 != 0)).select(
        "post_id", F.lit("attributes_extracted").alias("status")
    )
    return new.unionByName(first).unionByName(ml).unionByName(done).unionByName(first)


def transitions(t: Tables):
    return b.posts(t).select(
        "post_id", st.status_transition(long_enough(F.col("text")), "coarse_filter").alias("status")
    )


def latest_status(t: Tables):
    return st.status_latest(_log(t))


def funnel(t: Tables):
    return st.stage_funnel(_log(t).join(b.posts(t).select("post_id", "source"), "post_id"))


LATEST_SQL = sql(
    b.POSTS_SQL,
    body="""SELECT post_id, CASE WHEN length(text) < 30 THEN 'coarse_filter_rejected'
      WHEN post_id % 3 = 0 THEN 'ml_filter_rejected' ELSE 'attributes_extracted' END AS status FROM posts""",
)
FUNNEL_SQL = sql(
    b.POSTS_SQL,
    """log AS (SELECT source, 'new' AS status FROM posts
      UNION ALL SELECT source, CASE WHEN length(text) >= 30 THEN 'coarse_filter_passed' ELSE 'coarse_filter_rejected' END
        FROM posts, (VALUES (1), (2)) twice(i)
      UNION ALL SELECT source, CASE WHEN post_id % 3 <> 0 THEN 'ml_filter_passed' ELSE 'ml_filter_rejected' END
        FROM posts WHERE length(text) >= 30
      UNION ALL SELECT source, 'attributes_extracted' FROM posts WHERE length(text) >= 30 AND post_id % 3 <> 0)""",
    body="SELECT source, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in [*STATUS_RANK, QUARANTINED])
    + " FROM log GROUP BY 1",
)


def upserts(t: Tables):
    """Attributes written per post in several batches: events as changes of their user."""
    changes = t.events.select(
        F.col("user_id").alias("post_id"),
        F.col("event_id").alias("batch"),
        F.expr(b.listed("event_id % 5", DURATIONS)).alias("duration"),
        F.expr(b.listed("event_id % 4", WORK_TYPES)).alias("work_type"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN props END").alias("payment"),
    )
    return st.latest_rows(changes, ["post_id"], "batch")


UPSERTS_SQL = f"""SELECT user_id AS post_id, {b.listed('event_id % 5', DURATIONS)} AS duration,
    {b.listed('event_id % 4', WORK_TYPES)} AS work_type, CASE WHEN event_id % 3 <> 0 THEN props END AS payment
  FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)"""


def attached(t: Tables):
    return _posts(t).select(
        "post_id", "source", *[F.col(f"attributes.{c}").alias(c) for c in ("duration", "work_type", "payment", "address")]
    )


# ---- subscribers ---------------------------------------------------------------------------


def actives(t: Tables):
    return st.active_subscribers(b.subscribers(t)).select("platform", "external_id")


def upsert_subscribers(t: Tables):
    seen = t.events.select(
        F.when(F.col("user_id") % 2 == 0, F.lit("vk")).otherwise(F.lit("tg")).alias("platform"),
        F.col("user_id").alias("external_id"),
    )
    out = st.subscriber_upsert(b.subscribers(t), seen)
    return out.select("platform", "external_id", "status", *[F.col(f).cast("int").alias(f) for f in FLAGS])


UPSERT_SUBSCRIBERS_SQL = sql(
    b.SUBSCRIBERS_SQL,
    "seen AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'vk' ELSE 'tg' END AS platform, user_id AS external_id FROM events)",
    body="SELECT platform, external_id, coalesce(status, 'active') AS status, "
    + ", ".join(f"CAST(coalesce({f}, {str(v).lower()}) AS INT) AS {f}" for f, v in FLAG_DEFAULTS.items())
    + " FROM subscribers FULL JOIN seen USING (platform, external_id)",
)

MATCH_SQL = f"""matches AS (
  SELECT p.post_id, s.platform, s.external_id
  FROM (SELECT p.*, coalesce(work_type, 'unknown') AS w, coalesce(duration, 'unknown') AS dur, payment, address
    FROM posts p LEFT JOIN attributes a ON a.post_id = p.post_id) p, subscribers s
  WHERE s.status = 'active'
    AND CASE p.source WHEN 'vk' THEN src_vk WHEN 'tg' THEN src_tg ELSE true END
    AND (NOT payment_required OR coalesce(payment, '') <> '')
    AND (NOT address_required OR coalesce(address, '') <> '')
    AND CASE w {" ".join(f"WHEN '{w}' THEN wt_{w}" for w in WORK_TYPES)} END
    AND CASE dur {" ".join(f"WHEN '{x}' THEN dur_{x}" for x in DURATIONS)} END)"""
_MATCH = (*_PA, b.SUBSCRIBERS_SQL, MATCH_SQL)


def _matches(t: Tables):
    posts = _posts(t).select("post_id", "source", "attributes")
    return d.match_subscribers(posts, b.subscribers(t))


def match_counts(t: Tables):
    """Matched posts per subscriber: the predicate applied to every pair of classes."""
    posts = _posts(t).select("post_id", "source", "attributes")
    return d.match_summary(posts, b.subscribers(t))


# ---- outboxes ------------------------------------------------------------------------------


def outbox_tg(t: Tables):
    out = d.channel_outbox_tg(_bodies(t), "@channel")
    return out.select(
        "post_id",
        "destination",
        "text",
        F.concat_ws(",", "photos").alias("photos"),
        "method",
    )


OUTBOX_TG_SQL = sql(
    *_PA,
    BODY_SQL,
    body=f"""SELECT post_id, '@channel' AS destination, substr(body, 1, {d.TEXT_LIMIT}) AS text,
      array_to_string(photos[1:{d.PHOTO_LIMIT}], ',') AS photos,
      CASE n_photos WHEN 0 THEN 'sendMessage' WHEN 1 THEN 'sendPhoto' ELSE 'sendMediaGroup' END AS method
    FROM bodies WHERE coalesce(duration, '') NOT IN ('permanent', 'vahta')""",
)


def outbox_vk(t: Tables):
    out = d.channel_outbox_vk(_bodies(t), 77, can_upload=True)
    return out.withColumn("photos", F.concat_ws(",", "photos"))


OUTBOX_VK_SQL = sql(
    *_PA,
    BODY_SQL,
    body="""SELECT post_id, CAST(-77 AS BIGINT) AS owner_id, body AS text, array_to_string(photos, ',') AS photos
      FROM bodies WHERE coalesce(duration, '') NOT IN ('permanent', 'vahta')""",
)


def outbox_bot(t: Tables):
    shown = {"text_md5": F.md5("text"), "photos": F.size("photos").cast("bigint")}
    return d.bot_outbox(_bodies(t), b.subscribers(t), shown)


def deliveries_bot(t: Tables):
    """Every message of both bots with its method, state and send time."""
    posts = b.posts(t).select("post_id", "at_us", b.photos().alias("attachments"))
    return d.bot_deliveries(posts, _matches(t))


DELIVERIES_BOT_SQL = sql(
    *_MATCH,
    """queue AS (SELECT platform, external_id, post_id, at_us, CASE platform WHEN 'tg' THEN 50000 ELSE 100000 END AS gap,
      CASE n_photos WHEN 0 THEN 'sendMessage' WHEN 1 THEN 'sendPhoto' ELSE 'sendMediaGroup' END AS method,
      row_number() OVER (PARTITION BY platform ORDER BY at_us, post_id, external_id) AS n FROM matches JOIN posts USING (post_id))""",
    body="""SELECT platform, external_id, post_id, method, 'pending' AS state,
      gap * n + max(at_us - gap * n) OVER (PARTITION BY platform ORDER BY n ROWS UNBOUNDED PRECEDING) AS send_us FROM queue""",
)

OUTBOX_BOT_SQL = sql(
    *_MATCH,
    BODY_SQL,
    body=f"""SELECT platform, external_id, post_id, md5(substr(body, 1, {d.TEXT_LIMIT})) AS text_md5,
      least(n_photos, {d.PHOTO_LIMIT}) AS photos FROM matches JOIN bodies USING (post_id)""",
)


def photo_limit(t: Tables):
    capped = F.slice(b.photos(), 1, d.PHOTO_LIMIT)
    return b.posts(t).select("post_id", F.size(capped).cast("bigint").alias("n"), F.concat_ws(",", capped).alias("photos"))


def text_limit(t: Tables):
    cut_text = F.substring("text", 1, d.TEXT_LIMIT)
    return b.posts(t).select("post_id", F.length(cut_text).cast("bigint").alias("n"), F.md5(cut_text).alias("text_md5"))


def pace(t: Tables):
    return d.pacing(b.items(t), "event_type", "at_us", "id", 600_000_000)


def pace_one_channel(t: Tables):
    """All posts into one channel, one per second."""
    queue = b.posts(t).withColumn("channel", F.lit("@channel"))
    return d.pacing(queue, "channel", "at_us", "post_id", 1_000_000)


def pace_sql(head: str, table: str, key: str, item: str, gap: int) -> str:
    return sql(
        head,
        f"""numbered AS (SELECT {key}, at_us, {item}, row_number() OVER (PARTITION BY {key} ORDER BY at_us, {item}) AS n FROM {table})""",
        body=f"""SELECT {key}, at_us, {item}, {gap} * n + max(at_us - {gap} * n) OVER (
          PARTITION BY {key} ORDER BY at_us, {item} ROWS UNBOUNDED PRECEDING) AS send_us FROM numbered""",
    )


QUERIES = {
    "format_post": (formatted, sql(*_PA, BODY_SQL, body="SELECT post_id, body FROM bodies")),
    "settings_summary": (summaries, _summary_sql()),
    "settings_categories": (categories, CATEGORIES_SQL),
    "publish_policy": (policy, POLICY_SQL),
    "status_transition": (
        transitions,
        """SELECT doc_id AS post_id, CASE WHEN length(text) >= 30 THEN 'coarse_filter_passed'
           ELSE 'coarse_filter_rejected' END AS status FROM documents""",
    ),
    "status_latest": (latest_status, LATEST_SQL),
    "stage_funnel": (funnel, FUNNEL_SQL),
    "upsert_attributes": (upserts, UPSERTS_SQL),
    "attach_attributes": (
        attached,
        sql(
            *_PA,
            body="""SELECT p.post_id, source, duration, work_type, payment, address
              FROM posts p LEFT JOIN attributes a ON a.post_id = p.post_id""",
        ),
    ),
    "active_subscribers": (
        actives,
        sql(b.SUBSCRIBERS_SQL, body="SELECT platform, external_id FROM subscribers WHERE status = 'active'"),
    ),
    "subscriber_upsert": (upsert_subscribers, UPSERT_SUBSCRIBERS_SQL),
    "match_subscribers": (_matches, sql(*_MATCH, body="SELECT post_id, platform, external_id FROM matches")),
    "subscriber_match": (
        match_counts,
        sql(
            *_MATCH,
            body="""SELECT platform, external_id, count(*) AS posts, min(post_id) AS first_post, max(post_id) AS last_post
              FROM matches GROUP BY 1, 2""",
        ),
    ),
    "channel_outbox_tg": (outbox_tg, OUTBOX_TG_SQL),
    "channel_outbox_vk": (outbox_vk, OUTBOX_VK_SQL),
    "bot_outbox": (outbox_bot, OUTBOX_BOT_SQL),
    "bot_deliveries": (deliveries_bot, DELIVERIES_BOT_SQL),
    "photos_limit": (
        photo_limit,
        sql(
            b.POSTS_SQL,
            body=f"""SELECT post_id, least(n_photos, {d.PHOTO_LIMIT}) AS n,
              array_to_string(({b.PHOTOS_SQL})[1:{d.PHOTO_LIMIT}], ',') AS photos FROM posts""",
        ),
    ),
    "text_limit": (
        text_limit,
        f"""SELECT doc_id AS post_id, least(length(text), {d.TEXT_LIMIT}) AS n,
            md5(substr(text, 1, {d.TEXT_LIMIT})) AS text_md5 FROM documents""",
    ),
    "pacing": (pace, pace_sql(b.EVENTS_SQL, "items", "event_type", "id", 600_000_000)),
    "pacing_one_channel": (
        pace_one_channel,
        pace_sql(
            b.POSTS_SQL + ", queue AS (SELECT *, '@channel' AS channel FROM posts)", "queue", "channel", "post_id", 1_000_000
        ),
    ),
}
