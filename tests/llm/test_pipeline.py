"""The pipeline stage by stage, each on its own input, against SQL, brute force and the sums that must hold."""

import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from siltstone.llm.common import table, written
from siltstone.llm.shingles import shingle_set, similar

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of each stage, and the last one's output."""
    out = [table(spark, DIR, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR), name))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_but_the_last_stage_keep_the_columns(inputs):
    assert [x.columns for x in inputs[:-1]] == [inputs[0].columns] * 5


def test_classifier_drops_what_it_rejects_and_nothing_else(spark, inputs):
    labels = table(spark, DIR, "labels")
    kept = {r.doc_id for r in quality_classifier.classify(inputs[0], labels).filter("kept").collect()}
    assert sorted(rows(inputs[1])) == sorted(r for r in rows(inputs[0]) if r[0] in kept) and kept
    bad = {r.doc_id for r in labels.filter("quality = 0 or toxic = 1").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    assert len(bad & kept) <= 0.1 * len(bad) and len(good & kept) >= 0.95 * len(good)


def test_lines_by_sql(inputs):
    documents = inputs[1].toArrow()  # noqa: F841  DuckDB reads it by name
    want = {r[0]: (r[1], r[2]) for r in duckdb.sql(f"SELECT doc_id, text, n_chars FROM ({line_dedup.SQL})").fetchall()}
    assert {r.doc_id: (r.text, r.n_chars) for r in inputs[2].collect()} == want


def test_one_document_of_each_near_duplicate_group(inputs):
    docs = sorted((r.doc_id, shingle_set(r.text, near_dedup.SHINGLE)) for r in inputs[2].collect())
    least = {d: d for d, _ in docs}
    links = [(a, b) for i, (a, x) in enumerate(docs) for b, y in docs[:i] if len(x) and len(y) and similar(x, y, 80)]
    for _ in range(len(docs)):
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert sorted(rows(inputs[3])) == sorted(r for r in rows(inputs[2]) if least[r[0]] == r[0])


def test_mix_takes_what_is_planned(inputs):
    plan = {r.doc_id: r for r in mixing.mix(inputs[3]).collect()}
    text = {r.doc_id: (r.text or "").split() for r in inputs[3].collect()}
    taken = Counter()
    for r in inputs[4].collect():
        words = (r.text or "").split()
        assert " ".join(words) in " ".join(text[r.doc_id]) and r.n_chars == len(r.text)
        taken[r.doc_id] += len(words)
    assert {d: n for d, n in taken.items() if n} == {d: r.taken for d, r in plan.items() if r.taken}


def test_pieces_hold_every_token_once(inputs):
    tokens = packing.WordTokens(packing.default_tokenizer())
    want = Counter()
    for r in inputs[4].collect():
        ids, _ = tokens.encode([r.text])
        want[r.doc_id] += len(ids)
    pieces, fill, got = inputs[5].collect(), Counter(), Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        fill[p.sequence_id] += p.length
        assert 0 <= p.start and p.start + p.length <= p.doc_tokens and 0 <= p.ids_crc32 < 2**32
    assert got == want and all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    for s in list(fill)[:20]:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    one = next(p for p in pieces if p.start == 0 and p.length == p.doc_tokens)
    texts = [r.text for r in inputs[4].filter(inputs[4].doc_id == one.doc_id).collect()]
    assert one.ids_crc32 in {zlib.crc32(tokens.encode([t])[0].astype("<u4").tobytes()) for t in texts}


def test_a_clashing_column_changes_nothing(spark, inputs):
    docs = inputs[0].selectExpr("*", "1 as n_dropped", "'old' as kept", "0.5 as host_rate", "2 as size")
    stages = dict(corpus_pipeline.STAGES)
    for name, k in (("quality_classifier", 0), ("line_dedup", 1), ("near_dedup", 2), ("mix_sources", 3)):
        given = inputs[k].selectExpr("*", "1 as n_dropped", "'old' as kept", "0.5 as host_rate", "2 as size")
        out = stages[name](spark, given, DIR)
        assert out.columns == docs.columns and out.count() == inputs[k + 1].count()
