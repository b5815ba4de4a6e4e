"""Structure repair, ranked search and repeated passages against plain models, and their defined cases."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import repair, repeats, search

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20_000
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# structure repair


def cheapest(rows):
    """(cost, audit) by listing edit strings in the order of cost and letters."""
    heap = [(0, "", 0, "")]
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        to = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, to))
        if i < len(rows):
            letter, bad, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not bad:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, to))
                if letter == to or (letter == "s" and state == ""):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, letter))


def plain_repair(rows):
    """The whole report of (turn, role, text) rows, by loops."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, faults = set(), [], Counter()
    for _, role, text in rows:
        rest = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = cheapest(judged)
    lines, state, at = [], "", iter(rows)
    for e in audit:
        to = "a" if state == "u" else "u"
        if e != "I":
            _, role, text = next(at)
        name = {"a": "assistant:", "u": "user:"}[to]
        if e == "K":
            lines.append(f"{role}:{text}")
            state = role[:1]
        elif e != "D":
            lines.append(name + (text if e == "R" else ""))
            state = to
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_auction_equals_listing_all_edits():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(7))]
        rows = [(x, bad, cut and not bad) for x, bad, cut in rows]
        codes = bytes(repair.letter_state(x) | repair.BAD * bad | repair.TRUNCATED * cut for x, bad, cut in rows)
        assert repair.repair(codes) == cheapest(rows), rows


def test_prices_of_parts_compose():
    rng = random.Random(5)
    for _ in range(60):
        codes = bytes(rng.choice([0, 2, 3, 4, 10, 11, 18, 19]) for _ in range(rng.randrange(1, 150)))
        cut = rng.randrange(len(codes) + 1)
        tail, _ = repair.backward(codes[cut:], repair.FINAL) if cut < len(codes) else (repair.FINAL, None)
        matrix = [repair.backward(codes[:cut], tuple(0 if x == q else repair.FAR for x in range(4)))[0] for q in range(4)] if cut else None
        whole, _ = repair.backward(codes, repair.FINAL)
        if matrix:
            assert whole == tuple(min(matrix[q][s] + tail[q] for q in range(4)) for s in range(4))


SCHEMA = "conv_id long, turn long, role string, text string, conv string, bare int, placed string, kind int, cost string"


def test_repair_equals_plain_model(spark):
    rng = random.Random(7)
    said = ["Yes.", "No", "", " \t", "Why?", "ok.", "é!", "a.\n", "x" * 3000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(7)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([*said, None])))
    frame = spark.createDataFrame([(*r, "c", 1, "p", 2, "x") for r in rows], SCHEMA)
    found = repair.repair_conversations(frame).collect()
    want = {c: plain_repair([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert {r.conv_id: tuple(r[c] for c in REPORT) for r in found} == want and len(found) == len(want)


def test_repair_of_a_conversation_over_many_tasks(spark):
    rng = random.Random(11)
    rows = [(5, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}.", f"{t}"])) for t in range(9000)]
    rows += [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (9, 0, "user", "Hi.")]
    present = rows + [(7, 3, "user", "gone")]
    frame = spark.createDataFrame([(*r, "c", 1, "p", 2, "x") for r in present], SCHEMA).repartition(5)
    from pyspark.sql import functions as F

    found = {r.conv_id: r for r in repair.repair_conversations(frame, F.col("conv_id") != 7).collect()}
    assert sorted(found) == [1, 5, 7, 9]
    assert (found[1].cost, found[1].audit) == (0, "KK") and (found[9].cost, found[9].audit) == (2, "KI")
    assert (found[7].cost, found[7].audit, found[7].repaired_sha256) == (0, "", EMPTY_HASH)
    _, _, *report = repair._report(5, False, [r[1:] for r in rows if r[0] == 5])
    assert [found[5][c] for c in REPORT] == report[1:]


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=50):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    n, size = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in wanted.items():
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // size if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)}
    return out


def ranked(frame):
    return {tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()}


def test_search_equals_plain_scores(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["Étude", "ÉTUDE", "a_b", "x-1", "\U0001f600", "İ", "q\x00r"]
    docs = [(i if i % 37 else None, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 400])))) for i in range(400)]
    docs += [(7, "w1 w1 w2"), (7, "w1 w1 w2"), (8, "w1 w1 w2"), (9, None), (10, ""), (11, " .,! "), (12, LONG)]
    items = [(1, "w1 W2 w3!"), (2, None), (3, "none of these"), (4, " ".join(words)), (None, "w5"), (None, "w6"), (5, "alpha"), (6, "w1 w2 étude ÉTUDE")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, sketch string, item_id int").repartition(3)
    q = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, terms string, doc_id int")
    assert ranked(search.search(search.SketchIndex(d), q)) == plain_search(docs, items)


def test_search_index_has_small_rows_in_small_files(spark):
    text = "alpha beta gamma " * 600  # 10,200 characters
    docs = spark.createDataFrame([(i, text) for i in range(2000)], "doc_id long, text string").coalesce(1)
    rows = search.SketchIndex(docs).rows
    held = rows.select(F.size("ids").alias("n"), F.input_file_name().alias("file")).collect()
    assert sum(r.n for r in held) == 2000 and max(r.n for r in held) * len(text) <= search.ROW_CHARS + len(text)
    assert max(Counter(r.file for r in held).values()) <= search.FILE_ROWS


def test_search_skips_documents_but_never_a_result():
    rng = np.random.default_rng(4)
    terms = np.sort(rng.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    n = 600
    doc, place = np.nonzero(rng.random((n, 500)) < 0.05)
    times, norms = rng.integers(1, 5, len(doc)), rng.integers(50, 300, n)
    impacts = search.impact(times, norms[doc])
    row = type("Row", (), {
        "ids": np.arange(n), "bare": np.zeros(n, bool), "norms": norms, "sizes": np.bincount(doc, minlength=n), "terms": terms.tobytes(),
        "places": place.astype(np.uint32).tobytes(), "times": times.astype(np.uint32).tobytes(),
        "sketch": search.fold(search.coordinate(terms)[place], doc, impacts, n).tobytes(),
    })
    block = search.Block([(0, terms[:20]), (1, terms[50:55])])
    block.weights = rng.integers(1000, 9000, len(block.terms))
    best = [search.Best(50) for _ in block.of]
    scored = search.rank_batch(row, block, block.by_coordinate(), best)
    assert scored < 2 * n
    for own, top in zip(block.of, best):
        weights = dict(zip(block.terms[own].tolist(), block.weights[own].tolist()))
        exact = np.zeros(n, np.int64)
        np.add.at(exact, doc, impacts * np.array([weights.get(t, 0) for t in terms.tolist()])[place])
        order = np.lexsort((np.arange(n), -exact))[:50]
        assert top.ids.tolist() == order.tolist() and top.scores.tolist() == exact[order].tolist()


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert search.search(search.SketchIndex(none), items).count() == 0
    docs = spark.createDataFrame([(1, "w1 w2")], "doc_id long, text string")
    assert search.search(search.SketchIndex(docs), items.limit(0)).count() == 0


# repeated passages


def test_cover_is_a_perfect_difference_set():
    differences = Counter((a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER if a != b)
    assert set(differences) == set(range(1, repeats.PERIOD)) and set(differences.values()) == {1}


def plain_removal(texts, window=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = b"\x01" * window
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def removal(frame):
    return Counter(tuple(r) for r in repeats.remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_repeats_equal_brute_force(spark):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefgh éü\U0001f600") for _ in range(n))

    passage = [noise(n) for n in (300, 395, 399, 400, 401, 450, 700, 2000)]
    texts = [noise(rng.randrange(900)) + p + noise(rng.randrange(900)) for p in passage for _ in range(3)]
    texts += ["x" * 399, "x" * 400, "x" * 401, "ab" * 300, "ab" * 300, passage[-1], passage[-1][500:], None, "", None, "short", "short"]
    texts += [noise(1200) + passage[3] + passage[5] + passage[3], ("line " * 80)[:399] + "y", ("line " * 80)[:399] + "z", ("line " * 81)]
    rows = [(i if i % 11 else None, t, "x", b"d", 1) for i, t in enumerate(texts)]
    rows.append((3, noise(700), "x", b"d", 1))  # an id that repeats with another text
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, body binary, part int").repartition(3)
    want = Counter((r[0], *p) for r, p in zip(rows, plain_removal([r[1] for r in rows])))
    assert removal(frame) == want


def test_repeats_of_long_texts_over_segments(spark):
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, 2_300_000, dtype=np.uint8)).decode()
    piece = long[repeats.SEGMENT - 900:repeats.SEGMENT + 700]
    rows = [(1, long), (2, "q" * 50 + piece + "Q" * 50), (3, LONG)]
    found = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_removed, found[1].n_spans) == (1600, 1) and (found[2].n_removed, found[2].n_spans) == (1600, 1)
    assert found[2].kept_sha256 == hashlib.sha256(b"q" * 50 + b"Q" * 50).hexdigest()
    assert found[3].n_removed == found[3].n_bytes and found[3].kept_sha256 == EMPTY_HASH


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_repeats_of_nothing(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(frame) == Counter((i, 0, 0, 0, EMPTY_HASH) for i, _ in rows)
