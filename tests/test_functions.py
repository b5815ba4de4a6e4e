"""Edge cases of the column functions."""

import hashlib
import json
import re

import pytest
import unicodedata

from pyspark.sql import functions as F

from postloom.functions import parsing, records, text
from postloom.functions.times import aware_to_utc, epoch_micros, epoch_to_utc, micros_to_utc
from postloom.operators import delivery as d
from postloom.operators import features
from postloom.operators.features import char_term_counts, word_term_counts


def values(spark, inputs, build, schema="v string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.select(build(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_normalize_and_hash(spark):
    inputs = ["Нужен ГРУЗЧИК, 2 чел.!", "a_b__c", "x²½", "éte", "🙂🙂", "", "   \t"]
    want = [
        "".join(c for c in s.lower() if unicodedata.category(c)[0] in "LN") for s in inputs
    ]
    assert values(spark, inputs, text.normalize_text) == want
    assert values(spark, inputs, text.text_hash) == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    # texts of symbols only share the hash of the empty text
    assert want[4] == want[5] == ""


def test_clean_text(spark):
    inputs = [None, "", "A B", "z​w‏x﻿", "\x1c a\t\nb c ", "\u0085x　"]
    want = []
    for s in inputs:
        s = (s or "").replace(" ", " ")
        s = re.sub("[​-‏﻿]", "", s).lower()
        want.append(re.sub(r"\s+", " ", s).strip())
    assert values(spark, inputs, text.clean_text) == want


def test_word_and_char_terms(spark):
    docs = spark.createDataFrame([(1, "Да a bb ccc bb"), (2, "x"), (3, "")], "doc int, text string")
    words = {(r.doc, r.term): r.tf for r in word_term_counts(docs).collect()}
    assert words == {
        (1, "да"): 1, (1, "bb"): 2, (1, "ccc"): 1, (1, "да bb"): 1, (1, "bb ccc"): 1, (1, "ccc bb"): 1,
    }
    grams: dict = {}
    for doc, body in [(1, "да a bb ccc bb"), (2, "x")]:
        for word in body.split():
            w = f" {word} "
            for n in (3, 4, 5):
                if n > max(3, len(w)):
                    continue
                for i in range(max(1, len(w) - n + 1)):
                    key = (doc, w[i : i + n])
                    grams[key] = grams.get(key, 0) + 1
    assert {(r.doc, r.term): r.tf for r in char_term_counts(docs).collect()} == grams


def test_grams_of_repeated_ids_many_characters_and_long_texts(spark, monkeypatch):
    many = "".join(chr(0x4E00 + i) for i in range(5000))
    rows = [(1, "ab a\0b"), (1, "ab 😀ё"), (None, "ab"), (None, "cd"), (2, many), (3, None)]
    docs = spark.createDataFrame(rows, "doc int, text string")
    want: dict = {}
    for doc, body in rows:
        for word in (body or "").split():
            for n in (3, 4, 5):
                for i in range(len(word) + 3 - n):
                    key = (doc, f" {word} "[i : i + n])
                    want[key] = want.get(key, 0) + 1
    found = char_term_counts(docs).collect()
    assert len(found) == len(want) and {(r.doc, r.term): r.tf for r in found} == want

    def counted(texts):
        terms, tf = features._gram_counts(texts)
        return dict(zip(terms.to_pylist(), tf.tolist()))

    texts = ["да a bb ccc bb", "", "x"]
    at_once = counted(texts)
    monkeypatch.setattr(features, "LONG", 3)
    assert counted(texts) == at_once


def test_terms_are_counted_without_a_table_of_a_tasks_terms(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc int, text string")
    for counts in (char_term_counts(docs), word_term_counts(docs), features.term_counts(docs)):
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        # the texts of an id are gathered; their terms are not grouped
        assert plan.count("Aggregate [") == 1 and "collect_list" in plan


def test_extraction_of_one_partition_runs_in_many_tasks(spark):
    from postloom.operators.extract import extract_rules

    one = spark.range(40).selectExpr("id AS post_id", "'вахта, 3000 руб.' AS text").coalesce(1)
    found = extract_rules(one)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert one.rdd.getNumPartitions() == 1 < parts == found.rdd.getNumPartitions()
    assert {(r.duration, r.payment) for r in found.collect()} == {("vahta", "3000 руб.")} and found.count() == 40


def test_totals_are_those_of_the_single_values(spark):
    rows = [(d, b, f"t{(d * i) % 7}", 1 + (d + i) % 3) for d in range(6) for b in ("word", "char") for i in range(3)]
    counts = spark.createDataFrame(rows, "doc int, block string, term string, tf long").groupBy("doc", "block", "term").agg(F.max("tf").alias("tf"))
    vocabulary = features.doc_frequency(counts, 6)
    want = features.tfidf(counts, vocabulary).groupBy("doc", "block").agg(F.count("*"), F.max("value"), F.sum("value"))
    got = {(r[0], r[1]): r[2:] for r in features.tfidf_totals(counts, vocabulary).collect()}
    assert got and {k: pytest.approx(v, abs=1e-12) for k, v in got.items()} == {(r[0], r[1]): r[2:] for r in want.collect()}


def test_times(spark):
    assert [str(v) for v in values(spark, [0, 86399, 1704067207, -1], epoch_to_utc, "v bigint")] == [
        "1970-01-01 00:00:00",
        "1970-01-01 23:59:59",
        "2024-01-01 00:00:07",
        "1969-12-31 23:59:59",
    ]
    us = [0, 1, 1_704_067_207_179_575, -1, -86_400_000_000]
    assert values(spark, us, lambda c: epoch_micros(micros_to_utc(c)), "v bigint") == us
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = values(spark, ["2024-03-10T12:00:00.5+03:00", "2024-07-01T00:00:00Z"], aware_to_utc)
        assert [str(v) for v in out] == ["2024-03-10 09:00:00.500000", "2024-07-01 00:00:00"]
        assert values(spark, us, lambda c: epoch_micros(micros_to_utc(c)), "v bigint") == us
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_chat_urls(spark):
    df = spark.createDataFrame(
        [(-1001234, "news"), (-1001234, ""), (-1001234, None), (-77, None), (5, None)], "c bigint, u string"
    )
    got = [r[0] for r in df.select(records.chat_url(F.col("c"), F.col("u"), F.lit(9))).collect()]
    assert got == [
        "https://t.me/news/9", "https://t.me/c/1234/9", "https://t.me/c/1234/9", "https://t.me/c/77/9", "https://t.me/c/5/9",
    ]


def test_best_photo(spark):
    schema = "v array<struct<type:string,photo:struct<sizes:array<struct<url:string,width:int,height:int>>>>>"

    def photo(*sizes):
        return ("photo", (list(sizes),))

    inputs = [
        None,
        [],
        [photo(("a", 2, 2), ("b", 4, 1), ("c", 1, 1))],  # tie: the first
        [photo(("a", None, 9), ("b", 1, 1))],  # missing width counts as 0
        [photo(("", 9, 9), ("b", 1, 1))],  # largest has no url: dropped
        [photo(), ("photo", None), ("video", ([("v", 9, 9)],)), photo(("x", 1, 1)), photo(("y", 1, 1))],
    ]
    assert values(spark, inputs, records.best_photo_urls, schema) == [[], [], ["a"], ["b"], [], ["x", "y"]]


def test_filters(spark):
    assert values(spark, [None, "", "   ", "x"], records.has_text) == [False, False, True, True]
    assert values(spark, [0, 1, None], records.not_ads, "v int") == [True, False, True]
    assert values(spark, ["x" * 29, "x" * 30, "🙂" * 30, None], records.long_enough) == [False, True, True, False]
    rows = [
        ("hi", None, None, None, None, True),
        (" ", None, None, None, None, False),
        (None, None, None, None, None, False),
        ("hi", True, None, None, None, False),
        ("hi", None, True, None, None, False),
        ("hi", None, None, True, None, False),
        ("hi", None, None, True, True, True),
    ]
    df = spark.createDataFrame(rows, "t string, a boolean, s boolean, d boolean, v boolean, want boolean")
    got = df.select(records.processable_chat(*[F.col(c) for c in "tasdv"]).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_replies(spark):
    inputs = [
        '{"duration": "FULL_SHIFT", "work_type": " Loader ", "payment": 500, "address": "не указано"}',
        '{"duration": "weekly", "payment": "  "}',
        "{}",
        "oops",
        '{"duration": ',
        "[1]",
        None,
    ]
    got = values(spark, inputs, parsing.parse_reply)
    assert [tuple(r) for r in got] == [
        (True, "full_shift", "loader", "500", None),
        (True, "unknown", "unknown", None, None),
        (True, "unknown", "unknown", None, None),
        (False, None, None, None, None),
        (False, None, None, None, None),
        (False, None, None, None, None),
        (False, None, None, None, None),
    ]
    null_like = ["None", " - ", "NULL", "не удалось определить", "500/2", " x "]
    assert values(spark, null_like, parsing.clean_optional) == [None, None, None, None, "500/2", "x"]


def test_payload_round_trip_and_quarantine(spark):
    good = {
        "id": 7, "source": "vk", "text": "Привет", "source_post_url": "u", "source_chat_url": "c",
        "attachments": ["p"], "attributes": None,
    }
    attrs = {"duration": "vahta", "work_type": "loader", "payment": None, "address": None}
    inputs = [
        good,
        {**good, "attributes": attrs},
        {**good, "source": "ok"},
        {k: v for k, v in good.items() if k != "text"},
        {**good, "attributes": {**attrs, "duration": "weekly"}},
        {**good, "attributes": {k: v for k, v in attrs.items() if k != "address"}},
        {**good, "attachments": None},
    ]
    texts = [json.dumps(v, ensure_ascii=False) for v in inputs] + ["nope"]
    got = values(spark, texts, parsing.decode_payload)
    assert [r.error for r in got] == [
        None, None, "unknown source", "missing key", "unknown duration", "missing key", "no attachments", "not a JSON object",
    ]
    again = values(spark, texts[:2], lambda c: parsing.encode_payload(parsing.decode_payload(c)["post"].dropFields("_corrupt")))
    assert [json.loads(a) for a in again] == [{**i, "id": str(i["id"])} for i in inputs[:2]]


def test_callbacks(spark):
    df = spark.createDataFrame([("cat3",), (" f11 ",), ("opt2",), ("optx",), ("f99999999999",), ("f" + "9" * 20,), (None,)], "d string")
    got = df.select(*[parsing.callback_number(F.col("d"), p) for p in ("cat", "f", "opt")]).collect()
    assert [tuple(r) for r in got] == [
        (3, None, None), (None, 11, None), (None, None, 2), (None, None, None), (None, 99_999_999_999, None), (None, None, None), (None, None, None),
    ]
    start = ['{"command": "start"}', '{"command": "go"}', "[]", "x", None]
    assert values(spark, start, parsing.is_start_payload) == [True, False, False, False, False]


def test_policy_and_message(spark):
    attrs = "struct<duration:string,work_type:string,payment:string,address:string>"
    rows = [
        (1, ("permanent", "loader", None, None)),
        (2, ("vahta", "loader", None, None)),
        (3, ("full_shift", "handyman", "", "ул. 1")),
        (4, None),
    ]
    df = spark.createDataFrame(rows, f"post_id int, attributes {attrs}")
    passed = df.where(d.publish_policy(F.col("attributes.duration"))).select("post_id").collect()
    assert sorted(r[0] for r in passed) == [3, 4]
    body = df.where("post_id = 3").select(
        d.format_post(F.lit("tg"), F.lit("T"), F.lit("chat"), F.lit("post"), F.col("attributes"))
    ).first()[0]
    assert body == (
        "Новая заявка!\n\n🕒 Длительность - Разовая заявка на целую смену\n🔨 Характер работы - Разнорабочий\n"
        "💵 Оплата - не удалось определить\n📍 Адрес - ул. 1\n\nИсходный текст:\nT\n\n"
        "Источник - Telegram, chat\nИсходная публикация - post"
    )


def test_outboxes(spark):
    rows = [(n, "я" * (4090 + n), [f"u{i}" for i in range(k)], None) for n, k in [(6, 0), (7, 1), (8, 2), (9, 11)]]
    attrs = "struct<duration:string,work_type:string,payment:string,address:string>"
    df = spark.createDataFrame(rows, f"post_id int, body string, attachments array<string>, attributes {attrs}")
    tg = {r.post_id: r for r in d.channel_outbox_tg(df, "@c").collect()}
    assert [len(tg[i].text) for i in (6, 7, 8)] == [4096, 4096, 4096]
    assert [tg[i].method for i in (6, 7, 8, 9)] == ["sendMessage", "sendPhoto", "sendMediaGroup", "sendMediaGroup"]
    assert len(tg[9].photos) == 10
    vk = {r.post_id: r for r in d.channel_outbox_vk(df, 5, True).collect()}
    assert len(vk[8].text) == 4098 and len(vk[9].photos) == 11 and vk[9].owner_id == -5
    assert all(r.photos == [] for r in d.channel_outbox_vk(df, 5, False).collect())


def test_extraction_rules(spark):
    from postloom.operators.extract import extract_rules

    ads = {
        "нужны люди, 3000/8": ("full_shift", "unknown"),
        "работа 8-17, уборка": ("full_shift", "handyman"),
        "надо успеть за три дня": ("full_shift", "unknown"),
        "занести штукатурку на 3 этаж, 500/2": ("short_task", "loader"),
        "16 часов подряд": ("full_shift", "unknown"),
        "3-4 часа, вынести мусор": ("short_task", "loader"),
        "нужен штукатур на постоянку": ("permanent", "specialist"),
        "вахтой 30 дней, монолитчики": ("vahta", "specialist"),
        "разгрузить и убрать": ("unknown", "unknown"),
        "": ("unknown", "unknown"),
    }
    df = spark.createDataFrame(list(enumerate(ads)), "post_id long, text string")
    got = {r.post_id: (r.duration, r.work_type) for r in extract_rules(df).collect()}
    assert got == dict(enumerate(ads.values()))
