"""The ingest job over some polls: cursors, source and text dedup by arrival, publishing, repeated runs, one id type."""

from postloom.operators.ingest_job import PostStore, ingest_wall
from postloom.schemas import WALL_SCHEMA

HOUR = 3600


def _wall(spark, rows):
    full = [(i, -7, 5, at, text, None, ads, None, 1) for i, at, text, ads in rows]
    return spark.createDataFrame(full, WALL_SCHEMA)


HOUR_US = HOUR * 1_000_000


def _registry(spark):
    return spark.createDataFrame(
        [("vk", 1, "t", "u", True, None), ("vk", 2, "t", "u", False, 3)],
        "platform string, source_id long, title string, url string, is_active boolean, last_seen_id long",
    )


def test_polls(spark, tmp_path):
    registry, store = _registry(spark), PostStore(spark, str(tmp_path))
    first = [(1, 0, "need two people", None), (2, HOUR // 2, "need two people", None), (3, HOUR, "other", 1), (4, HOUR, "", None)]
    for _ in range(2):
        assert {r.item_id for r in ingest_wall(_wall(spark, first), registry, store, 1, 20 * HOUR_US).collect()} == {1}
    assert [(r.source_id, r.last_seen_id) for r in store.read("cursors").collect()] == [(1, 4)]
    # 5 and 6 repeat a text stored within the hour, whenever they were published; 2 lies behind the cursor
    second = [*first, (5, HOUR, "Need two people!", None), (6, 19 * HOUR, "need two people", None), (7, 9 * HOUR, "late", None)]
    for _ in range(2):
        assert {r.item_id for r in ingest_wall(_wall(spark, second), registry, store, 2, 21 * HOUR_US).collect()} == {7}
    # the hour after the first poll is over
    third = [*second, (8, 21 * HOUR, "need two people", None), (9, 21 * HOUR, "late", None)]
    assert {r.item_id for r in ingest_wall(_wall(spark, third), registry, store, 3, 21 * HOUR_US + 1).collect()} == {8}
    posts = store.read("posts").collect()
    assert sorted(r.item_id for r in posts) == [1, 7, 8] and len({r.post_id for r in posts}) == 3
    assert {r.created_at.hour for r in posts} == {20, 21} and store.read("details").count() == 3
    assert ingest_wall(_wall(spark, third), registry, store, 4, 30 * HOUR_US).count() == 0
    published = spark.read.parquet(f"{tmp_path}/stage/new")
    assert sorted(r.post_id for r in published.collect()) == sorted(r.post_id for r in posts)


def test_a_backlog_fetched_at_once_is_one_arrival(spark, tmp_path):
    rows = [(1, 9 * HOUR, "same", None), (2, 4 * HOUR, "same", None), (3, 0, "SAME!", None), (4, 0, "unlike", None)]
    kept = ingest_wall(_wall(spark, rows), _registry(spark), PostStore(spark, str(tmp_path)), 1, 50 * HOUR_US)
    assert {r.item_id for r in kept.collect()} == {3, 4}


def test_look_back_over_the_turn_of_a_month(spark, tmp_path):
    registry, store = _registry(spark), PostStore(spark, str(tmp_path))
    new_month = 31 * 24 * HOUR_US
    assert ingest_wall(_wall(spark, [(1, 0, "same", None)]), registry, store, 1, new_month - 1).count() == 1
    again = _wall(spark, [(2, 0, "same", None)])
    assert ingest_wall(again, registry, store, 2, new_month + HOUR_US - 1).count() == 0
    assert ingest_wall(_wall(spark, [(3, 0, "same", None)]), registry, store, 3, new_month + HOUR_US).count() == 1


def test_without_a_poll_time_a_text_comes_again_after_an_hour(spark, tmp_path):
    registry, store = _registry(spark), PostStore(spark, str(tmp_path))
    rows = [(1, 0, "same", None), (2, HOUR, "same", None), (3, HOUR + 1, "SAME!", None), (4, 0, "unlike", None)]
    for _ in range(2):
        assert {r.item_id for r in ingest_wall(_wall(spark, rows), registry, store, 1, None).collect()} == {1, 3, 4}
    assert sorted(r.at_us for r in store.read("posts").collect()) == [0, 0, (HOUR + 1) * 1_000_000]
    # stored texts count within the hour of a record's own time
    more = [*rows, (5, 2 * HOUR + 1, "same", None), (6, 2 * HOUR + 2, "same", None)]
    assert {r.item_id for r in ingest_wall(_wall(spark, more), registry, store, 2, None).collect()} == {6}
