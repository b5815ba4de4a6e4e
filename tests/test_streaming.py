"""Streams: results equal the batch operators, restarts lose and repeat nothing."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import learn
from postloom.operators.profiles import profile_fold
from postloom.operators.status import status_latest
from postloom.operators.suppress import suppress_repeats
from postloom.schemas import FLAGS
from postloom.streaming import stages
from postloom.streaming.dedup import arrival_instant, dedup_batches, last_kept, stream_dedup_1h
from postloom.streaming.changes import ChangeStore
from postloom.streaming.profiles import profile_batches, profile_store

MINUTE = 60_000_000


def arrivals(n, seed):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.randrange(8 * MINUTE)
        rows.append((rng.choice(["a", "a", "a", "b", f"r{i % 30}"]), at, i))
    return rows


def test_dedup_over_batches_equals_one_pass(spark, tmp_path):
    schema = "text_hash string, at_us bigint, item_id bigint"
    rows = arrivals(600, 4)
    want = {r.item_id for r in suppress_repeats(spark.createDataFrame(rows, schema), "text_hash", "at_us", "item_id").collect()}
    source, stateful = str(tmp_path / "in"), str(tmp_path / "stateful")
    for i in range(0, 600, 150):
        spark.createDataFrame(rows[i : i + 150], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        dedup_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        timed = spark.readStream.schema(schema).parquet(source).select("*", arrival_instant())
        stages.start_append(stream_dedup_1h(timed), stateful, str(tmp_path / "cp2"), True, None).awaitTermination()
    for path in (f"{tmp_path}/out/kept", stateful):
        out = [r.item_id for r in spark.read.parquet(path).collect()]
        assert len(out) == len(set(out)) and set(out) == want, path


def test_dedup_state_is_freed_and_nulls_are_equal(spark, tmp_path):
    schema = "text_hash string, at_us bigint, item_id bigint"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hour = 60 * MINUTE
    batches = [
        [(None, 0, 1), ("a", 0, 2), *[(f"r{i}", i, 100 + i) for i in range(50)]],
        [(None, MINUTE, 3), ("a", 2 * hour, 4), ("b", hour, 5)],
        [("a", 2 * hour - MINUTE, 6), ("late", 0, 7), ("b", 10 * hour, 8)],  # out of order, and a new hash far behind
        [("a", 10 * hour, 9), ("r1", 10 * hour, 10)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        dedup_batches(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp"), every=2).awaitTermination()
    kept = {r.item_id for r in spark.read.parquet(f"{out}/kept").collect()}
    assert kept == {1, 2, 4, 5, 7, 8, 9, 10, *range(100, 150)}
    held = {r.text_hash: r.at_us for r in last_kept(spark, out, 2).current().collect()}
    assert held == {"a": 10 * hour, "b": 10 * hour, "r1": 10 * hour}


def test_change_store_writes_what_a_batch_touches(spark, tmp_path):
    initial = spark.createDataFrame([(None, 1), ("a", 1), ("b", 1), ("b", 2), ("c", 1)], "k string, v int")
    store = ChangeStore(spark, str(tmp_path), ["k"], initial, every=3)
    want = {(None, 1), ("a", 1), ("b", 1), ("b", 2), ("c", 1)}

    def rows(of):
        return {tuple(r) for r in of.collect()}

    changes = [({None}, {(None, 5)}), ({"b"}, set()), ({"b", "d"}, {("b", 7), ("d", 8), ("d", 9)}), ({"a"}, {("a", 3)}), (set(), set())]
    for number, (keys, new) in enumerate(changes):
        touched = spark.createDataFrame([(k,) for k in keys], "k string")
        for _ in range(2):  # a replay replaces the change and sees the state before it
            before = store.current(number, touched)
            assert rows(before) == {r for r in want if r[0] in keys}
            store.write(number, spark.createDataFrame(sorted(new), "k string, v int"), touched)
        assert spark.read.parquet(f"{tmp_path}/rows/version={number}").count() == len(new)
        want = {r for r in want if r[0] not in keys} | new
        assert store.compact(number) == (number == 2)
        assert rows(store.current()) == want


def test_profiles_over_batches_equal_one_fold(spark, tmp_path):
    rng = random.Random(9)
    data = ["save", "pause", "start", "menu", "reconf_all", "reconf_one", "f3", "f12"] + ["opt1", "opt2", "opt3"] * 4
    rows = [("vk", rng.randrange(12), i, "message" if i % 40 == 0 else "callback", "/start" if i % 40 == 0 else rng.choice(data)) for i in range(900)]
    schema = "platform string, external_id bigint, seq bigint, kind string, data string"
    none = spark.createDataFrame([], "platform string, external_id bigint, status string, " + ", ".join(f"{f} boolean" for f in FLAGS))
    folded = profile_fold(spark.createDataFrame(rows, schema), none)
    columns, want = folded.columns, sorted(map(str, folded.collect()))
    source = str(tmp_path / "in")
    for i in range(0, 900, 300):
        spark.createDataFrame(rows[i : i + 300], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        profile_batches(stream, none, str(tmp_path / "out"), str(tmp_path / "cp"), every=2).awaitTermination()
    got = profile_store(spark, none, str(tmp_path / "out")).current()
    assert sorted(map(str, got.select(columns).collect())) == want


def _posts(spark, path, ids):
    text = F.when(F.col("id") % 5 == 0, F.lit("short")).otherwise(F.concat(F.lit("a text that is quite long enough "), "id"))
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", F.lit("vk").alias("source"), text.alias("text"))
    rows.write.mode("append").parquet(path)


def _publish(spark, source, root):
    posts = spark.readStream.schema("id bigint, source string, text string").parquet(source)
    nothing = F.lit(None).cast("struct<duration:string,work_type:string,payment:string,address:string>")
    record = F.struct(
        "id", "source", "text", F.lit("p").alias("source_post_url"), F.lit("c").alias("source_chat_url"),
        F.array().cast("array<string>").alias("attachments"), nothing.alias("attributes"),
    )
    stages.publish_stage(posts.select(record.alias("post")), root).awaitTermination()


def test_chain_survives_restarts_and_bad_payloads(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "stages")
    _posts(spark, source, range(20))
    _publish(spark, source, root)
    spark.createDataFrame([("not json", None, "new", True)], stages.DECISION_SCHEMA).write.mode("append").partitionBy("passed").parquet(f"{root}/bad")

    def broken(df):
        return df.withColumn("passed", F.raise_error(F.lit("stage down")).cast("boolean")).withColumn("status", F.lit("x"))

    with pytest.raises(Exception, match="stage down"):
        stages.run_stage(spark, root, "new", "coarse", broken).awaitTermination()
    stages.run_stage(spark, root, "new", "coarse", stages.coarse_decision).awaitTermination()
    _posts(spark, source, range(20, 30))
    _publish(spark, source, root)
    stages.run_stage(spark, root, "new", "coarse", stages.coarse_decision).awaitTermination()
    log = stages.status_log(spark, root, ["new", "coarse"])
    assert log.count() == 60
    latest = {r.post_id: r.status for r in status_latest(log).collect()}
    assert latest == {str(i): f"coarse_filter_{'rejected' if i % 5 == 0 else 'passed'}" for i in range(30)}
    stages.run_stage(spark, root, "bad", "bad_out", stages.coarse_decision).awaitTermination()
    quarantined = spark.read.parquet(f"{root}/bad_out").collect()
    assert [(r.status, r.payload, str(r.passed)) for r in quarantined] == [("quarantined", "not json", "false")]


def test_fan_out_is_independent(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "stages")
    _posts(spark, source, range(10))
    _publish(spark, source, root)

    def fails(posts):
        raise RuntimeError("consumer down")

    started = stages.fan_out(spark, root, {"good": lambda p: p.select("id"), "bad": fails}, source="new")
    started["good"].awaitTermination()
    with pytest.raises(Exception, match="consumer down"):
        started["bad"].awaitTermination()
    assert spark.read.parquet(f"{root}/out/good").count() == 10
    stages.fan_out(spark, root, {"bad": lambda p: p.select("id")}, source="new")["bad"].awaitTermination()
    assert spark.read.parquet(f"{root}/out/bad").count() == 10


def test_classifier_round_trip_and_stage(spark, tmp_path):
    good, bad = "нужен грузчик на смену оплата сразу", "продам диван недорого самовывоз сегодня"
    rows = [(i, f"{good if i % 2 else bad} {i % 5}", i % 2) for i in range(40)]
    samples = spark.createDataFrame(rows, "doc bigint, text string, label int")
    counts, folds = learn.prepare(samples, 2)
    for name in learn.CANDIDATES:
        if name == "nb":
            model = learn.fit_and_tune(samples, name, k=2)
        else:
            model = learn.train(name, counts, folds.select("doc", "label"))
            model.metadata = {"model": name}
        path = str(tmp_path / name)
        learn.save_bundle(model, path)
        loaded = learn.load_bundle(spark, path)
        assert loaded.threshold == model.threshold and loaded.metadata["model"] == name
        scored = learn.ml_filter(samples, loaded, "doc").collect()
        assert len(scored) == 40 and all(r.relevant == (r.label == 1) for r in scored), name
        # a text without any known term gets the prior
        unknown = spark.createDataFrame([(1, "zzz")], "post_id bigint, text string")
        assert 0 < learn.score_posts(unknown, loaded).first().score < 1
    source, root = str(tmp_path / "in"), str(tmp_path / "stages")
    texts = spark.createDataFrame([(1, good + " один"), (2, bad + " два")], "id bigint, text string").withColumn("source", F.lit("vk"))
    texts.select("id", "source", "text").write.parquet(source)
    _publish(spark, source, root)
    stages.run_scored_stage(spark, root, "new", "ml", loaded).awaitTermination()
    out = {r.post_id: r.status for r in spark.read.parquet(f"{root}/ml").collect()}
    assert out == {"1": "ml_filter_passed", "2": "ml_filter_rejected"}


def test_stream_tables_read_a_file_and_a_folder_of_files(spark, tmp_path):
    from postloom.plans import streams
    from postloom.plans.bindings import Tables

    rows = spark.createDataFrame([(i, f"text {i}", "en", f"src{i % 3}") for i in range(40)], "doc_id long, text string, lang string, source string")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "file" / "documents.parquet")
    for kind in ("folder", "file"):
        found = streams.replayed(Tables(spark, f"{tmp_path}/{kind}"))
        assert sorted(r.post_id for r in found.collect()) == list(range(40)), kind
