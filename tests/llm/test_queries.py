"""The queries of the subpackage against SQL or brute force, over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from postloom.llm import queries
from tests.llm import brute
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
WITH_SQL = sorted(k for k, (_, text) in queries.QUERIES.items() if text)


def rows(spark, name, folder=FOLDER):
    return queries.QUERIES[name][0](spark, folder).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, name):
    query, text = queries.QUERIES[name]
    ok, note = compare(query(spark, FOLDER), connect(FOLDER), text)
    assert ok, note


def test_every_operator_is_registered():
    assert {int(m[1]) for k in queries.QUERIES if (m := re.match(r"op(\d+)_", k))} == set(range(1, 14))


def test_language_held_out(spark, docs):
    found = rows(spark, "op1_language")
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)


def test_secret_spans(spark, docs):
    for r in rows(spark, "op3_secrets"):
        want = brute.secret_spans(docs[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == want
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k + ":") for s in want) for k in ("assign", "access", "hex")]


def test_jaccard_equals_brute_force(spark, docs):
    want = brute.jaccard([(i, d.text) for i, d in docs.items()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op4_jaccard")} == want


def test_toxicity_held_out(spark):
    folder = FOLDER.replace("0.001", "0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = rows(spark, "op5_toxicity", folder)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in found)
    flagged = [r for r in found if r.held_out and r.predicted and r.doc_id in labels]
    bad = [r for r in found if r.held_out and labels.get(r.doc_id)]
    assert sum(labels[r.doc_id] for r in flagged) >= 0.9 * len(flagged)
    assert sum(r.predicted for r in bad) >= 0.6 * len(bad)


def test_segmentations_round_trip(spark, docs):
    found = rows(spark, "op6_pieces")
    assert all(r.exact and 0 <= r.inclusion <= 1 and r.log_inclusion <= 0 for r in found)
    by = Counter(r.doc_id for r in found)
    assert set(by) == set(docs) and max(by.values()) == 2
    assert len({(r.doc_id, r.ids_sha256) for r in found}) == len(found)
    assert {tuple(r) for r in found} == {tuple(r) for r in rows(spark, "op6_pieces")}


def test_language_model_counts(spark, docs):
    counts, n_docs, words = Counter(), 0, {}
    for i, d in docs.items():
        words[i] = brute.WORD.findall(brute.lowered(d.text))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words[i])
            n_docs += 1
    total, distinct = sum(counts.values()) + n_docs, len(counts) + 1
    found = rows(spark, "op8_lm")
    for r in found:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words[r.doc_id])
        base += math.log10((n_docs + 1) / (total + distinct + 1))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.train_tokens) == (len(words[r.doc_id]) + 1, total)
        assert r.n_known == sum(counts[w] > 0 for w in words[r.doc_id]) + 1
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pipeline_stages_equal_their_models(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("n_chars", "hash")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, FOLDER)
        after = docs.collect()
        if name != "pieces":
            assert docs.columns == ["doc_id", "text", "lang", "source", "hash"]
            assert set(map(tuple, after)) <= set(map(tuple, before))
        kept = sorted(r.doc_id for r in after)
        if name == "language":
            assert len(kept) >= 0.98 * len(before)
        elif name == "exact_dedup":
            first = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
            assert kept == sorted(first.values())
        elif name == "near_dedup":
            assert kept == sorted(i for i, (_, c) in brute.jaccard([(r.doc_id, r.text) for r in before]).items() if i == c)
        elif name == "mixing":
            assert Counter(kept) == Counter(brute.mix([(r.doc_id, r.text, r.source) for r in before]))
        else:
            assert set(kept) == {r.doc_id for r in before} and all(r.exact for r in after)
        docs = spark.createDataFrame(after, docs.schema)
