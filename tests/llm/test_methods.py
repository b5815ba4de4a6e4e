"""The methods themselves: decoders, lattices, links, folds and models against plain forms."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import chat, lattice, lm, mixing, pieces, secrets, toxicity
from postloom.llm.graph import components
from postloom.llm.words import mix
from tests.llm import brute


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = brute.components({n for e in links for n in e}, links)
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(got) == {n for a, b in links if a != b for n in (a, b)}


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 8))
    found = lattice.decode_e8(x)
    assert len(lattice.ROOTS) == 240
    for y, p in zip(x, found):
        others = ((p + lattice.ROOTS - y) ** 2).sum(axis=1)
        assert ((p - y) ** 2).sum() <= others.min() + 1e-9


def test_recall_of_vector_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [base]
    for cosine in (0.905, 0.93, 0.97, 0.995):
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(axis=1, keepdims=True) * base
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        rows.append(cosine * base + math.sqrt(1 - cosine**2) * side)
    x = np.concatenate(rows)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice.link_vectors(table).collect()}
    assert all(n <= close[i].sum() for i, n in got.items())
    assert sum(got.values()) >= 0.9 * close.sum()


def test_weak_parts_need_each_other(spark):
    key, host = "Zx8kQ2mN7pL4vB9sT3wY6", "https://db.example.org/login"
    texts = [
        f"client_id: alice99 and {key} at {host}",
        f"only {key} here",
        f"client_id: alice99 alone at {host}",
        f"client_id: alice99 {'far away ' * 100} {key}",
        f"token = abcdef123456 then {host} and user=bob",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: sorted(texts[r.doc_id][s.start:s.end] for s in r.linked) for r in secrets.find_secrets(docs).collect()}
    assert found[0] == sorted([key, "client_id: alice99", host])
    assert found[1] == found[2] == found[3] == []
    assert found[4] == sorted([host, "user=bob"])


def test_hidden_words_are_restored():
    words = "the idiot said that this moron is a trash clown and that scum is stupid and good in the end " * 50
    model = toxicity.log_model(toxicity.bigram_counts([words]).reshape(28, 28))
    hidden = ["an 1d10t", "m o r o n here", "tr@@sh", "$cum!!", "cl0wwwwn", "the end", "stuuuupid"]
    assert toxicity.restore(hidden, model) == ["an idiot", "moron here", "trash", "scum!!", "clown", "the end", "stupid"]
    assert toxicity.restore([None, "", "plain text | with | bars"], model) == ["", "", "plain text | with | bars"]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    model = toxicity.log_model(rng.integers(0, 50, (28, 28)))
    for s in ("1d10t", "$t0p", "a1i", "b@d"):
        options = [[(c, 0.0)] if c.isalpha() else [(c, toxicity.COST_SELF)] + [(x, toxicity.COST_LETTER) for x in toxicity.LOOKALIKES[c]] for c in s]
        for j, c in enumerate(s):
            if c in toxicity.LOOKALIKES and 0 < j < len(s) - 1:
                options[j][0] = (c, toxicity.COST_INSIDE)

        def cost(path):
            codes = [26, *[ord(x) - 97 if x.isalpha() else 26 for x, _ in path], 26]
            return sum(model[a, b] for a, b in zip(codes, codes[1:])) - sum(w for _, w in path)

        best = max(itertools.product(*options), key=cost)
        assert toxicity.decode([s], model) == ["".join(x for x, _ in best)]


def test_segmentations_are_a_sample_without_replacement():
    vocabulary, n = pieces.loaded(pieces.default_model()), 20_000
    batch = pieces.Batch(vocabulary, ["thou"] * n, mix(np.arange(n, dtype=np.uint64)))
    found, bounds = batch.samples(2)
    p = {tuple(batch.ids(e)): math.exp(l) for paths in found for e, l, _ in paths}
    pairs = Counter(tuple(tuple(batch.ids(e)) for e, _, _ in paths) for paths in found)
    for (a, b), times in pairs.most_common(4):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(times / n - want) < 5 * math.sqrt(want / n)
    assert all(x[0][2] >= x[1][2] >= bound for x, bound in zip(found, bounds))


def test_network_gradients_and_total_probability():
    rng = np.random.default_rng(0)
    net = lm.Network.first(rng.integers(1, 9, lm.SYMBOLS).astype(float))
    before, target = rng.integers(0, lm.SYMBOLS, (2, 5, 3))
    fresh, live = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    fresh[0] = fresh[3, 1] = True
    live[4, 2] = False
    h = np.zeros((3, lm.HIDDEN))
    _, grad, _ = lm.train_window(net.w, net.edges, h, before, target, fresh, live)
    for name, at in [("U", (3, 20)), ("W", (2, 40)), ("b", (5,)), ("C", (1, 2)), ("E", (int(before[1, 0]), 4)), ("o", (int(target[0, 0]),)), ("O", (int(target[1, 1]), 3))]:
        side = []
        for eps in (1e-5, -1e-5):
            w = {k: v.copy() for k, v in net.w.items()}
            w[name][at] += eps
            side.append(lm.train_window(w, net.edges, h, before, target, fresh, live)[0])
        assert grad[name][at] == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-3, abs=1e-8)
    each = np.arange(lm.SYMBOLS)
    total = np.exp(lm.log_likelihood(net, each, np.ones(lm.SYMBOLS, np.int64))).sum()
    assert total == pytest.approx(1, rel=1e-4)


def test_state_is_carried_over_windows(monkeypatch):
    net = lm.Network.first(np.ones(lm.SYMBOLS))
    symbols, sizes = np.arange(300) % 50, np.array([200, 100])
    whole = lm.log_likelihood(net, symbols, sizes)
    monkeypatch.setattr(lm, "SCORE_WINDOW", 7)
    monkeypatch.setattr(lm, "LANES", 1)
    assert lm.log_likelihood(net, symbols, sizes) == pytest.approx(whole, rel=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_sorting(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["hot", "b", "c", None, ""][int(rng.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    want = Counter(brute.mix(rows))
    assert all(r.taken == r.size * want[r.doc_id] for r in got)
    assert sum({r.source_size: r.target for r in got}.values()) <= 1.5 * sum(r.size for r in got) + 1e-6


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 1, "open", 0, "user", None), (1, 2, "delta", 0, None, "hel"), (1, 3, "delta", 0, None, "lo"),
        (1, 4, "open", 1, "assistant", None), (1, 5, "delta", 1, None, "wrong"), (1, 6, "regenerate", 1, None, None),
        (1, 7, "delta", 1, None, "right"), (1, 8, "edit", 0, None, "bye"), (1, 9, "delta", 0, None, "!"), (2, 1, "open", 0, "user", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg long, role string, text string")
    folded = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.fold_events(events).collect()}
    assert folded == {1: [("user", "bye!"), ("assistant", "right")], 2: [("user", "")]}


def test_template_is_reversible(spark):
    turns = [("user", "a<|b|>[x]\\l</s>"), ("assistant", "\\p\\\\s|"), ("tool|>", "")]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role: string, text: string>>").withColumn("f", chat.render(F.col("turns")))
    row = df.select("f", chat.parse(F.col("f")).alias("back"), chat.loss_spans(F.col("f")).alias("spans")).first()
    assert [tuple(t) for t in row.back] == turns
    assert [row.f[s.start:s.start + s.length] for s in row.spans] == ["\\bp\\b\\bs\\p"]


def test_network_learns_from_all_training_texts(spark, monkeypatch):
    paths, work_path = [], lm.work_path
    monkeypatch.setattr(lm, "work_path", lambda *a: paths.append(work_path(*a)) or paths[-1])
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"))
    found = lm.score_documents(docs, learn=F.col("doc_id") % 3 != 0)
    assert found.count() == 3000
    assert len(paths) == 1
    trained = spark.read.parquet(paths[0]).select("key", (F.length("symbols") / 2).alias("n")).agg(F.count_distinct("key"), F.sum("n")).first()
    assert tuple(trained) == (2000, 6000)


def test_symbols_grow_with_the_training_words():
    assert [lm.symbols_for(n) for n in (0, 10**5, 16 * 10**6, 5 * 10**9, 10**13)] == [1024, 1024, 1024, 8192, 65536]
    for symbols in (2048, 4096, 8192):
        net = lm.Network.first(np.arange(symbols, 0, -1.0))
        each = np.arange(symbols)
        assert np.exp(lm.log_likelihood(net, each, np.ones(symbols, np.int64))).sum() == pytest.approx(1, rel=1e-4)


def test_long_stretches_are_restored(monkeypatch):
    words = "the idiot said that this moron is a trash clown and that scum is stupid and good in the end " * 50
    model = toxicity.log_model(toxicity.bigram_counts([words]).reshape(28, 28))
    hidden = [" ".join("idiot" * 6), "st" + "u" * 50 + "pid", "1d10t." * 12]
    want = [" ".join(["idiot"] * 6), "stupid", "idiot." * 12]
    assert toxicity.restore(hidden, model) == want
    monkeypatch.setattr(toxicity, "WINDOW", 7)
    assert toxicity.restore(hidden, model) == want
    assert len(toxicity.restore(["-" * 100_000 + "a1" + "-" * 100_000 + "b"], model)) == 1


def test_spaced_leet_and_doubled_lookalikes_are_restored():
    words = "the idiot said that this dumbass is an ass and shit is a mess and this moron is less and good " * 50
    model = toxicity.log_model(toxicity.bigram_counts([words]).reshape(28, 28))
    hidden = ["s h 1 t", "1.d.1.0.t", "i--d--i--o--t", "i  d  i  o  t", "a$$", "dumba$$", "an @$$ here", "m o r o n  i s", "1 2 3 4"]
    want = ["shit", "idiot", "idiot", "idiot", "ass", "dumbass", "an ass here", "moron  i s", "1 2 3 4"]
    assert toxicity.restore(hidden, model) == want
