"""Token counts and cross-tokenizer alignment against the libraries run on whole texts."""

from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from random import Random

import numpy as np
import pytest

from siltstone.llm import token_alignment as L
from siltstone.llm import token_counts as T

POOL = ["a", "é", "1", "²", "½", "!", "'", "'s", "'re", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "_", "<|endoftext|>", "<|endof", "́", "\U0001f600", "՘", "꟎", "中", "\U00020000",
        "​", "﻿", "x", " Hello", "\r", "\x00", " ", "ab", "10", "٣", "Ⅷ", "ﬁ", "①", "▁", "<0x0A>", "<s>", " the", "ing", "qz"]


def mixed_texts(n, seed=1):
    r = Random(seed)
    return ["".join(r.choice(POOL) for _ in range(r.randrange(60))) for _ in range(n)] + [None, "", " ", "   ", "x" * 5000, "ab " * 3000, " " * 999]


@pytest.fixture(scope="module")
def proven():
    return T.proof(T.default_vocabulary())


@lru_cache
def library():
    return T._tokenizer(T.default_vocabulary())


def library_count(text):
    return len(library().encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("piece", [1 << 20, 12])
def test_counts_equal_the_library(proven, piece, monkeypatch):
    monkeypatch.setattr(T, "PIECE", piece)
    counter, texts = T.TokenCounter(T.default_vocabulary(), proven), mixed_texts(4000)
    whole = [len(e.ids) for e in counter.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [n for a in range(0, len(texts), 37) for n in counter.count(texts[a : a + 37])] == whole


def test_every_proven_string_is_one_token_and_the_cache_is_bounded(proven, monkeypatch):
    counter = T.TokenCounter(T.default_vocabulary(), proven)
    assert len(proven.whole) > 45_000 and counter.count(sorted(proven.whole)) == [1] * len(proven.whole)
    monkeypatch.setattr(T, "CACHE", 50)
    for t in mixed_texts(200, 3):
        assert counter.count([t]) == [library_count(t)] and len(counter.merged) <= 50


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        T.proof(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_of_a_table_keep_its_columns(spark):
    rows = [(None if i % 5 == 0 else i % 7, t, "old") for i, t in enumerate(mixed_texts(120, 2))]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, n_tokens string").repartition(3)
    got = T.token_counts(docs, T.default_vocabulary(), limit=3)
    assert got.columns == ["doc_id", "text", "n_tokens", "n_bytes", "n_tokens_", "over_limit"] and got.count() == len(rows) + 9
    for r in got.collect():
        assert (r.n_tokens, r.n_bytes, r.n_tokens_, r.over_limit) == ("old", len((r.text or "").encode()), library_count(r.text), library_count(r.text) > 3)
    assert T.token_counts(docs.limit(0), T.default_vocabulary()).collect() == []


def whole_alignment(texts):
    """Rows by the two libraries on whole texts and loops over all pairs of tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = L.default_vocabularies()
    a_of, b_of = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a_of.encode_special_tokens = True
    alphabet, ids = L.byte_alphabet(), a_of.get_vocab()
    a_bytes = {i: bytes(alphabet.get(c, 0) for c in s) for s, i in ids.items()}
    rows, counts = [], Counter()
    for t in texts:
        a, b = (a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)) if t else ([], [])
        names = [b_of.id_to_piece(i) for i in b]
        bb = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names, strict=True)]
        aa = [a_bytes[i] for i in a]
        if not t or not b"".join(aa) == b"".join(bb) == f" {t}".encode():
            rows.append((0, 0, 0, "", []))
            continue
        spans = lambda parts: [(e - len(p), e) for p, e in zip(parts, accumulate(map(len, parts)), strict=True)]
        sa, sb = spans(aa), spans(bb)
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        both = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, at = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in zip(a, sa, strict=True) if at < x[1] <= e) + "|" + ",".join(str(i) for i, x in zip(b, sb, strict=True) if at < x[1] <= e))
            at = e
        counts.update(links)
        rows.append((len(a), len(b), len(groups), sha256(";".join(groups).encode()).hexdigest(), links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(na, nb, ng, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for na, nb, ng, h, x in rows]


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def alignment_texts():
    r = Random(5)
    prose = [" ".join(r.choice(("thorreou", "ing", "the", "naïve", "l’eau", "x=1;", "foo_bar", "日本語", "Ünïcode", "it's", "\nNew", "line\n", "", "aaaa" * r.randrange(9))) for _ in range(r.randrange(90))) for _ in range(60)]
    return mixed_texts(250, 4)[:-3] + ["x" * 300, "ab " * 200, " " * 99] + prose + prose[:9] + ["▁", "a ▁b", "<|endoftext|> the", "the <s> </s>", "a\r\nb ;\r c"]


@pytest.mark.parametrize(("buckets", "share", "chunk"), [(1, 8_000_000, 2_000_000), (7, 300, 500)])
def test_alignment_equals_brute_force(spark, monkeypatch, buckets, share, chunk):
    monkeypatch.setattr(L, "BUCKET", share)
    monkeypatch.setattr(L, "CHUNK", chunk)
    texts = alignment_texts()
    rows = [(i if i % 3 else None, t, i, "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, alignment long, n_best string").repartition(3)
    got = L.align(docs, *L.default_vocabularies(), buckets=buckets)
    assert got.columns == ["doc_id", "alignment", "n_best", "n_a", "n_b", "n_groups", "n_links", "n_best_", "count_sum", "groups_sha256"]
    assert [tuple(r[3:]) for r in sorted(got.collect(), key=lambda r: r.alignment)] == whole_alignment(texts)
    assert L.align(docs.limit(0), *L.default_vocabularies()).collect() == []


def test_stretches_encode_as_whole_texts_do():
    of, texts = L.Aligner(*L.default_vocabularies()), alignment_texts()
    assert of.cut is not None
    by_stretch = [x[:5] for t in texts for x in of.align([t])]
    of.cut = None
    of._forget()
    assert by_stretch == [x[:5] for x in of.align(texts)]


def test_a_frequent_id_is_dealt_over_buckets_with_its_counts():
    layout = L.Layout([(1, 10), (5, 1000), (9, 10)], 10)
    keys = np.full(1000, 5 << 16, np.uint32)
    bucket = layout.bucket(keys, np.arange(1000, dtype=np.int64))
    assert layout.count == 10 and set(bucket.tolist()) == set(range(10)) and np.bincount(bucket).max() < 160
    assert (layout.first[5], layout.last[5]) == (0, 9) and bucket.min() >= layout.first[5] and bucket.max() <= layout.last[5]
