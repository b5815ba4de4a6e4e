"""Operators against brute force and on edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from postloom.functions.times import HOUR_US
from postloom.operators import delivery as d
from postloom.operators import evaluate as ev
from postloom.operators import ingest, status
from postloom.operators.ordered import RUN, row_numbers, scan, split_runs
from postloom.operators.profiles import KEYS, profile_fold
from postloom.operators.suppress import SAME, chunk_steps, composed, suppress_repeats
from postloom.schemas import DURATIONS, FLAG_DEFAULTS, FLAGS, WORK_TYPES
from postloom.sources.files import scan_samples_csv
from postloom.streaming.profiles import apply_event, new_profile

MINUTE = 60_000_000
HOUR_US = 60 * MINUTE


def kept_by_loop(rows, span=HOUR_US):
    last, kept = {}, set()
    for k, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or us > last[k] + span:
            last[k] = us
            kept.add(i)
    return kept


def test_suppression_bounds(spark):
    at = [0, 40 * MINUTE, 80 * MINUTE, 140 * MINUTE, 140 * MINUTE + 1_000_000]
    df = spark.createDataFrame([("h", us, i) for i, us in enumerate(at)], "k string, us bigint, i bigint")
    for parts in (1, 5):
        got = {r.i for r in suppress_repeats(df, "k", "us", "i", parts=parts).collect()}
        assert got == {0, 2, 4}, parts


@pytest.mark.parametrize("seed,gap,hot", [(1, 3 * MINUTE, 7), (2, 25 * MINUTE, 3), (3, MINUTE // 60, 50), (4, 90 * MINUTE, 2)])
def test_suppression_equals_loop(spark, seed, gap, hot):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(1200):
        # random, regular and bursty arrivals; repeated instants
        at += rng.choice([0, gap, gap, rng.randrange(2 * gap + 1), gap // 7 + 1])
        rows.append((rng.choice(["hot", "hot", "hot", "b", f"rare{i % 40}"]), at, i))
    df = spark.createDataFrame(rows, "k string, us bigint, i bigint")
    want = kept_by_loop(rows)
    assert {r.i for r in suppress_repeats(df, "k", "us", "i").collect()} == want
    assert {r.i for r in suppress_repeats(df, "k", "us", "i", parts=hot * 5).collect()} == want


def test_chunk_functions_compose_to_the_fold():
    import numpy as np

    rng = np.random.default_rng(4)
    for span in (10, 3, 40):
        us = np.cumsum(rng.integers(1, 9, 60))
        first, second, third = us[:25], us[25:27], us[27:]

        def fold(part, last):
            for x in part:
                last = x if x > last + span else last
            return last

        f = composed(composed(chunk_steps(first, span), chunk_steps(second, span)), chunk_steps(third, span))
        for entry in range(-60, int(us[0])):
            found = f[1][np.searchsorted(f[0], entry, side="right")]
            assert (entry if found == SAME else found) == fold(us, entry)


@pytest.mark.parametrize("gap", [30 * MINUTE, HOUR_US // 7, HOUR_US, HOUR_US + 1])
def test_suppression_of_fixed_gaps_and_any_key_type(spark, gap, monkeypatch):
    from postloom.operators import suppress

    rounds = []
    monkeypatch.setattr(suppress, "cut", lambda df, keep=suppress.cut: rounds.append(1) or keep(df))
    rows = [(k, i * gap, i + 1000 * j) for j, k in enumerate([7, None, 9]) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, us bigint, i bigint")
    got = {r.i for r in suppress_repeats(df, "k", "us", "i", parts=40).collect()}
    assert got == kept_by_loop(rows)
    assert len(rounds) <= 2 + 6  # two cuts and log2 of the chunks of a key


def test_scan_is_split_and_exact(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice([None, "a", "b"]), i, rng.randrange(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    runs = split_runs(df, ["k"], ["i"], 6)
    assert runs.where("k = 'hot'").select(RUN).distinct().count() > 2
    values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    for inclusive in (True, False):
        got = {r.i: (r.s, r.m) for r in scan(runs, ["k"], ["i"], values, inclusive).collect()}
        seen: dict = {}
        for k, i, v in rows:
            if inclusive:
                seen.setdefault(k, []).append(v)
            so_far = seen.get(k, [])
            assert got[i] == ((sum(so_far), max(so_far)) if so_far else (None, None))
            if not inclusive:
                seen.setdefault(k, []).append(v)
    ranked = row_numbers(df, [], [F.col("i").desc()]).orderBy("rn").collect()
    assert [r.i for r in ranked] == list(range(2999, -1, -1)) and ranked[0].rn == 1


def test_pacing_equals_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(10_000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "dest string, at bigint, i bigint")
    got = {r.i: r.send_us for r in d.pacing(df, "dest", "at", "i", 40).collect()}
    last: dict = {}
    for dest, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        last[dest] = max(at, last[dest] + 40) if dest in last else at
        assert got[i] == last[dest]


def test_wall_cursor(spark):
    rows = [(1, i, int(i == 3), None) for i in range(1, 9)]  # never read, item 3 pinned
    rows += [(2, i, int(i in (2, 7)), 5) for i in range(1, 9)]  # read up to 5, 2 and 7 pinned
    df = spark.createDataFrame(rows, "source_id int, id int, is_pinned int, last_seen_id int")

    def ids(out):
        got: dict = {}
        for r in out.collect():
            got.setdefault(r.source_id, set()).add(r.id)
        return got

    assert ids(ingest.new_since_cursor_wall(df, page=3)) == {1: {3, 8, 7}, 2: {6, 7, 8}}
    # three looked at: pinned 7, pinned 2 (old), then 8
    assert ids(ingest.new_since_cursor_wall(df, page=3, depth=3)) == {1: {3, 8, 7}, 2: {7, 8}}
    assert ids(ingest.new_since_cursor_chat(df.drop("is_pinned"), 2)) == {1: {8, 7}, 2: {6, 7}}


def test_cursors(spark):
    reg = spark.createDataFrame(
        [(1, True, None), (2, True, 9), (3, False, None), (4, True, None)], "source_id int, is_active boolean, last_seen_id int"
    )
    items = spark.createDataFrame([(1, 5), (1, 7), (2, 8), (3, 4)], "source_id int, id int")

    def cursors(df):
        return [r.last_seen_id for r in df.orderBy("source_id").collect()]

    assert cursors(ingest.cursor_advance(reg, items)) == [7, 9, 4, None]
    assert cursors(ingest.cursor_seed(reg, items)) == [7, 9, None, None]
    assert cursors(ingest.cursor_seed(reg, items, only_null=False)) == [7, 8, None, None]
    closed = spark.createDataFrame([(1,), (1,)], "source_id int")
    assert [r.is_active for r in ingest.deactivate_sources(reg, closed).orderBy("source_id").collect()] == [False, True, False, True]


def test_lookback_equals_pairs(spark):
    rng = random.Random(8)
    span = 100

    def batch(n, at):
        return [(rng.choice("xyz"), rng.randrange(at), i) for i in range(n)]

    history, new = batch(25, 3000), batch(200, 3000) + [("x", 0, 900), ("q", 5, 901)]
    schema = "text_hash string, at_us bigint, i bigint"
    out = ingest.dedup_text_lookback(spark.createDataFrame(new, schema), spark.createDataFrame(history, schema), span)
    want = {i for h, at, i in new if not any(h == g and at - span <= t <= at for g, t, _ in history)}
    assert {r.i for r in out.collect()} == want


def test_source_dedup(spark):
    batch = spark.createDataFrame([(1, 1, 5), (1, 1, 3), (1, 2, 9), (2, 1, 4)], "o int, i int, at int")
    seen = spark.createDataFrame([(2, 1)], "o int, i int")
    got = ingest.dedup_source_key(batch, seen, ["o", "i"], ["at"]).collect()
    assert sorted((r.o, r.i, r["at"]) for r in got) == [(1, 1, 3), (1, 2, 9)]


def test_status_never_moves_back(spark):
    log = [(1, "new"), (1, "ml_filter_passed"), (1, "coarse_filter_passed"), (2, "new"), (2, "coarse_filter_rejected"), (2, "new")]
    got = status.status_latest(spark.createDataFrame(log, "post_id int, status string")).collect()
    assert {r.post_id: r.status for r in got} == {1: "ml_filter_passed", 2: "coarse_filter_rejected"}


def test_matching_equals_every_pair(spark):
    rng = random.Random(11)
    users = []
    for i in range(60):
        flags = {f: rng.random() < 0.7 for f in FLAGS}
        users.append({"platform": "vk", "external_id": i, "status": rng.choice(["active", "active", "paused"]), **flags})
    users += [
        {"platform": "tg", "external_id": 100 + i, "status": "active", **FLAG_DEFAULTS, off: not FLAG_DEFAULTS[off]}
        for i, off in enumerate(FLAGS)
    ]
    posts = []
    for i in range(120):
        attrs = None if i % 10 == 0 else (
            rng.choice(DURATIONS), rng.choice(WORK_TYPES), rng.choice([None, "", "500"]), rng.choice([None, "", "ул."])
        )
        posts.append((i, rng.choice(["vk", "tg", "ok"]), attrs))
    schema = "post_id int, source string, attributes struct<duration:string,work_type:string,payment:string,address:string>"
    flags = ", ".join(f"{f} boolean" for f in FLAGS)
    order = ["platform", "external_id", "status", *FLAGS]
    people = spark.createDataFrame([tuple(u[c] for c in order) for u in users], f"platform string, external_id int, status string, {flags}")
    want = set()
    for i, source, attrs in posts:
        duration, work, payment, address = attrs or ("unknown", "unknown", None, None)
        for u in users:
            if (
                u["status"] == "active"
                and u.get(f"src_{source}", True)
                and (payment or not u["payment_required"])
                and (address or not u["address_required"])
                and u[f"wt_{work}"]
                and u[f"dur_{duration}"]
            ):
                want.add((i, u["external_id"]))
    for per_salt in (4096, 40):
        out = d.match_subscribers(spark.createDataFrame(posts, schema), people, posts_per_salt=per_salt).collect()
        assert len(out) == len(want) and {(r.post_id, r.external_id) for r in out} == want


def _fold_by_loop(events, start):
    states = {}
    for who, seq, kind, data in sorted(events, key=lambda e: e[1]):
        if kind == "callback" and data.strip().startswith("f") and data.strip()[1:].isdigit() and int(data.strip()[1:]) > 11:
            continue
        states[who] = apply_event(states.get(who) or start.get(who) or new_profile(), kind, data)
    return states


WORDS = ["save", "pause", "start", "menu", "settings", "cancel", "reconf_all", "reconf_one", "support", "cat1", "edit", "?"]


@pytest.mark.parametrize("seed", [1, 2])
def test_profile_fold_equals_replay(spark, seed):
    rng = random.Random(seed)
    events, seq = [], 0
    scripts = {
        "pass": ["reconf_all", "opt3"] + ["opt2"] * 11 + ["save"],
        "half": ["reconf_all", "opt1", "opt2", "cancel"],
        "one": ["reconf_one", "f5", "opt2", "save"],
        "range": ["f3", "opt9", "opt3", "opt2", "opt1", "save"],
        "beyond": ["f12"],
        "paused": ["pause", "start"],
        "open": ["reconf_all", "opt2", "f7", "opt2"],
    }
    for who, steps in scripts.items():
        for data in steps:
            events.append((who, seq, "callback", data))
            seq += 1
    for i in range(3000):
        kind = "message" if rng.random() < 0.05 else "callback"
        data = rng.choice(["/start", " Старт ", "hi"]) if kind == "message" else rng.choices(
            [rng.choice(WORDS), f"opt{rng.randrange(5)}", f" f{rng.randrange(14)} ", "reconf_all", "save"], [3, 12, 2, 1, 1]
        )[0]
        events.append(("hot" if rng.random() < 0.4 else f"u{i % 25}", seq, kind, data))
        seq += 1
    names = {who: n for n, who in enumerate(sorted({e[0] for e in events}))}
    rows = [("vk", names[w], s, k, x) for w, s, k, x in events]
    df = spark.createDataFrame(rows, "platform string, external_id int, seq bigint, kind string, data string")
    flags = ", ".join(f"{f} boolean" for f in FLAGS)
    known = {**FLAG_DEFAULTS, "dur_vahta": False}
    base = spark.createDataFrame(
        [("vk", names["hot"], "paused", *known.values()), ("tg", 1, "paused", *known.values())],
        f"platform string, external_id int, status string, {flags}",
    )
    start = {"hot": {**new_profile(), "status": "paused", "flags": known}}
    want = _fold_by_loop(events, start)
    got = {(r.platform, r.external_id): r for r in profile_fold(df, base).collect()}
    assert ("vk", names["beyond"]) not in got and got.pop(("tg", 1)).status == "paused"
    assert len(got) == len(want)
    for who, p in want.items():
        r = got[("vk", names[who])]
        assert r.status == p["status"], who
        assert {f: r[f] for f in FLAGS} == p["flags"], who
        assert (r.wizard_step, r.wizard_mode, r.wizard_draft) == (p["step"], p["mode"], p["draft"]), who
    assert KEYS == ["platform", "external_id"]


def test_samples_csv(spark, tmp_path):
    long = "x" * 30
    body = (
        "﻿post_id,source_id,source,text,label\n"
        f' 1 ,s,vk,{long}, 1 \n2,s,vk,{long},2\n3,s,vk,{long},\n4,s,vk,{"x" * 29},0\n'
        f'5,s,tg,"{long}\nsays ""hi"", ok",0\n'
    )
    path = tmp_path / "s.csv"
    path.write_text(body, encoding="utf-8")
    got = {r.post_id: (r.source, r.text, r.label) for r in scan_samples_csv(spark, str(path)).collect()}
    assert got == {"1": ("VK", long, 1), "5": ("TG", f'{long}\nsays "hi", ok', 0)}


def test_thresholds(spark):
    schema = "score double, label int"
    tied = spark.createDataFrame([(0.3, 0), (0.7, 1)], schema)
    best = ev.threshold_macro_f1(tied).first()
    assert (round(best.threshold, 6), best.macro_f1) == (0.31, 1.0)
    assert ev.threshold_macro_f1(tied.where("score > 1")).first().threshold == 0.5
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 1), (0.2, 0)], schema)
    got = ev.threshold_target_precision(rows, 0.7).first()
    assert (got.threshold, got.recall) == (0.7, 1.0)
    none = spark.createDataFrame([(0.9, 0), (0.1, 0)], schema)
    assert ev.threshold_target_precision(none, 0.5).first().threshold == 0.5


def test_report_zero_division(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    got = {r["row"]: r for r in ev.classification_report(rows).collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.0, 0.0, 0.0, 2)
    assert got["accuracy"].f1 == 0.333 and got["macro avg"].recall == 0.5


def test_folds_are_stratified(spark):
    rows = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(103)], "doc int, label int")
    sizes = ev.cv_folds(rows).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_profile_fold_resumes_a_stored_wizard(spark):
    from postloom.operators.profiles import profile_fold
    from postloom.schemas import FLAG_DEFAULTS, FLAGS

    columns = "platform string, external_id string, status string, " + ", ".join(f"{f} boolean" for f in FLAGS)
    columns += ", wizard_step int, wizard_mode string, wizard_draft map<string,boolean>"
    flags = [FLAG_DEFAULTS[f] for f in FLAGS]
    draft = {"payment_required": True}
    stored = [("vk", i, "active", *flags, step, mode, draft if mode else None) for i, step, mode in
              (("a", 3, "all"), ("b", 3, "pick"), ("c", 3, "all"), ("d", None, None), ("e", 3, "all"))]
    events = [("vk", "a", 1, "callback", "opt2"), ("vk", "a", 2, "callback", "save"), ("vk", "b", 1, "callback", "opt2"),
              ("vk", "b", 2, "callback", "save"), ("vk", "d", 1, "callback", "opt2"), ("vk", "e", 1, "callback", "opt2")]
    events = spark.createDataFrame(events, "platform string, external_id string, seq long, kind string, data string")
    found = {r.external_id: r for r in profile_fold(events, spark.createDataFrame(stored, columns)).collect()}
    for i in "ab":
        assert (found[i].payment_required, found[i].wt_handyman, found[i].wizard_step) == (True, False, None)
    assert (found["c"].wizard_step, found["c"].wizard_mode, found["c"].wizard_draft) == (3, "all", draft)
    assert found["d"].wizard_step is None
    assert (found["e"].wizard_step, found["e"].wizard_draft) == (4, draft | {"wt_handyman": False})


def test_null_hashes_equal_each_other_in_the_look_back(spark):
    schema = "text_hash string, at_us bigint, i bigint"
    history = spark.createDataFrame([(None, 0, 0)], schema)
    new = spark.createDataFrame([(None, 50, 1), (None, 101, 2), ("a", 50, 3)], schema)
    assert {r.i for r in ingest.dedup_text_lookback(new, history, 100).collect()} == {2, 3}


def test_older_subscriber_tables_get_flag_defaults(spark):
    old = spark.createDataFrame([("vk", 1, "paused", False, None)], "platform string, external_id long, status string, src_vk boolean, payment_required boolean")
    seen = spark.createDataFrame([("vk", 1), ("tg", 2)], "platform string, external_id long")
    rows = {r.external_id: r for r in status.subscriber_upsert(old, seen).collect()}
    assert rows[1].status == "paused" and rows[1].src_vk is False and rows[2].status == "active"
    assert all(rows[1][f] == v for f, v in FLAG_DEFAULTS.items() if f != "src_vk") and all(rows[2][f] == v for f, v in FLAG_DEFAULTS.items())


def _pairs(spark):
    posts = spark.createDataFrame([(i, i % 7 * 1000, ["u"] * (i % 3)) for i in [*range(30), 4, 4]], "post_id long, at_us long, attachments array<string>")
    found = [(p, plat, e) for p in [*range(30), 4, 30] for plat, n in (("tg", 5), ("vk", p % 3)) for e in range(n)]
    return posts, spark.createDataFrame(found, "post_id long, platform string, external_id long")


def test_bot_deliveries_equal_pacing_of_all_pairs(spark):
    posts, matches = _pairs(spark)
    gaps = {"tg": 300, "vk": 70}
    size = {r.post_id: len(r.attachments) for r in posts.collect()}
    queue = [(r.platform, p.at_us, r.post_id, r.external_id) for r in matches.collect() for p in posts.collect() if p.post_id == r.post_id]
    want, free = [], dict.fromkeys(gaps, -(2**60))
    for platform, at, post, external in sorted(queue):
        free[platform] = max(free[platform] + gaps[platform], at)
        method = ["sendMessage", "sendPhoto", "sendMediaGroup"][min(size[post], 2)]
        want.append((platform, external, post, method, "pending", free[platform]))
    assert sorted(tuple(r) for r in d.bot_deliveries(posts, matches, gaps).collect()) == sorted(want)


def test_expanded_subscribers_are_not_broadcast(spark, tmp_path):
    flags = ["src_vk", "src_tg", "payment_required", "address_required", *(f"wt_{w}" for w in WORK_TYPES), *(f"dur_{x}" for x in DURATIONS)]
    people = spark.createDataFrame([("tg", i, "active", *[True] * 2, *[False] * 2, *[True] * (len(flags) - 4)) for i in range(50)],
        "platform string, external_id long, status string, " + ", ".join(f"{f} boolean" for f in flags))
    posts = spark.createDataFrame([(1, "vk", None)], "post_id long, source string, attributes struct<duration:string,work_type:string,payment:string,address:string>")
    people.write.parquet(f"{tmp_path}/people")  # a small file, from which Spark estimates the expanded rows
    found = d.match_subscribers(posts, spark.read.parquet(f"{tmp_path}/people"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50


def _people(spark, n):
    flags = ["src_vk", "src_tg", "payment_required", "address_required", *(f"wt_{w}" for w in WORK_TYPES), *(f"dur_{x}" for x in DURATIONS)]
    rows = [("tg" if i % 3 else "vk", i if i else None, "active", *[(i >> k) % 3 != 1 for k in range(len(flags))]) for i in range(n)]
    return spark.createDataFrame(rows, "platform string, external_id long, status string, " + ", ".join(f"{f} boolean" for f in flags))


def test_blocks_hold_the_pairs_and_few_rows_are_copied(spark):
    attributes = [None, (DURATIONS[0], WORK_TYPES[0], "1", "x"), ("no such", WORK_TYPES[0], "1", "x")]
    posts = [(i % 300 if i else None, ("vk", "tg", "rss")[i % 3], attributes[i % 7 // 3]) for i in range(330)]
    posts = spark.createDataFrame(posts, "post_id long, source string, attributes struct<duration:string,work_type:string,payment:string,address:string>")
    people = _people(spark, 200)
    whole = sorted(map(tuple, d.match_subscribers(posts, people).collect()), key=str)
    rows = d.match_blocks(posts, people, posts_per_salt=1).collect()
    assert whole and sorted(((p.post_id, r.platform, x.external_id) for r in rows for p in r.posts for x in r.takers), key=str) == whole
    assert sum(len(r.posts) + len(r.takers) for r in rows) < len(whole) / 5
    assert len(rows) > len(d.match_blocks(posts, people).collect())


def test_cuts_of_a_hot_class_copy_fewer_rows_than_salts():
    cuts = d._cuts({0: 500_000, 1: 10}, {0: 800_000, 1: 10, 2: 5}, 100, 1)
    i, j = cuts[0]
    assert i * j >= 400 and cuts[1] == (1, 1) and set(cuts) == {0, 1}
    # a salt for every 4096 posts copied each subscriber a hundred times
    assert 500_000 * j + 800_000 * i < 800_000 * 100 / 2
