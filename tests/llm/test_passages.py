"""Passage links against all pairs of stretches."""

from random import Random

import numpy as np
import pytest

from siltstone.llm import passage_windows as P
from siltstone.llm.shingles import shingle_codes, shingle_hashes, word_codes, word_hashes

K, WORDS, LEAST = 5, 50, 46


def words(r: Random, n: int) -> list[str]:
    return [f"{r.randrange(10**6):x}" for _ in range(n)]


def planted(trials: int, seed: int = 5):
    """Per trial: a document with only 44 of 50 words of a passage, two with all of it, and a chain of edited copies."""
    r, out = Random(seed), []
    for _ in range(trials):
        passage, longer = words(r, WORDS), words(r, 80)
        for body in (passage[3:47], passage, passage):
            out.append(" ".join(words(r, r.randrange(30)) + body + words(r, r.randrange(30))))
        for edit in range(4):
            copy = list(longer)
            for at in range(edit):
                copy[9 + 13 * at] = "edited"
            out.append(" ".join(words(r, r.randrange(30)) + copy + words(r, r.randrange(30))))
    return out


def similar_stretches(texts: list[str]):
    """{document: starts of stretches that an earlier document has exactly}, the same for similar ones, and the pairs of documents."""
    tokens = [shingle_hashes(word_hashes(t), K) for t in texts]
    where: dict[int, list[tuple[int, int]]] = {}
    for d, x in enumerate(tokens):
        for q, h in enumerate(x.tolist()):
            where.setdefault(h, []).append((d, q))
    exact, near, pairs = {}, {}, set()
    for d, x in enumerate(tokens):
        shifts = {(e, q - p) for p, h in enumerate(x.tolist()) for e, q in where[h] if e < d}
        for e, shift in shifts:
            y = tokens[e]
            for p in range(len(x) - LEAST + 1):
                if 0 <= p + shift <= len(y) - LEAST:
                    a, b = set(x[p : p + LEAST].tolist()), set(y[p + shift : p + shift + LEAST].tolist())
                    if 100 * len(a & b) >= 80 * len(a | b):
                        near.setdefault(d, set()).add(p), pairs.add((d, e))
                        if a == b:
                            exact.setdefault(d, set()).add(p)
    return tokens, exact, near, pairs


def covered(links, found):
    """Starts of `found` that are inside a link, but for the tokens in which similar stretches may differ."""
    inside = {d: set() for d in found}
    for r in links:
        if r.doc_id in inside:
            inside[r.doc_id] |= set(range(r.start - 5, r.start + r.n_words - K + 1 - LEAST + 6))
    return sum(len(ps & inside[d]) for d, ps in found.items()), sum(map(len, found.values()))


@pytest.fixture(scope="module")
def trial(spark):
    texts = planted(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return texts, P.passage_links(docs).collect()


def test_every_link_holds(trial):
    texts, links = trial
    tokens = [shingle_hashes(word_hashes(t), K) for t in texts]
    for r in links:
        a = set(tokens[r.doc_id][r.start : r.start + r.n_words - K + 1].tolist())
        b = set(tokens[r.other_id][r.other_start : r.other_start + r.other_words - K + 1].tolist())
        assert (len(a & b), len(a | b)) == (r.shared, r.together) and 100 * r.shared >= 80 * r.together
        assert r.n_words >= WORDS and r.other_id < r.doc_id


def test_no_exact_passage_is_lost_behind_a_partial_one(trial):
    texts, links = trial
    _, exact, near, pairs = similar_stretches(texts)
    assert covered(links, exact) == (sum(map(len, exact.values())),) * 2
    got, every = covered(links, near)
    assert got >= 0.97 * every
    assert all(any((r.doc_id, r.other_id) == (7 * t + 2, 7 * t + 1) for r in links) for t in range(40))


def test_classes_are_the_components_of_the_links(trial):
    texts, links = trial
    pairs = {(r.doc_id, r.other_id) for r in links}
    least = {d: d for p in pairs for d in p}
    for _ in range(10):
        for d, e in pairs:
            least[d] = least[e] = min(least[d], least[e])
    assert {r.doc_id: r.class_id for r in links} == {d: least[d] for d, _ in pairs}
    due = similar_stretches(texts)[3]
    assert sum(least.get(d) == least.get(e) for d, e in due) >= 0.98 * len(due)


def test_near_recall_on_the_given_documents(spark):
    """One edit in passages cut out of the given documents."""
    r = Random(3)
    source = [x.text.split() for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 800").orderBy("doc_id").select("text").limit(150).collect()]
    texts, n = [], 0
    for i, w in enumerate(source):
        if len(w) < 120:
            continue
        a, length = r.randrange(len(w) - 100), r.choice((54, 60, 80))
        copy = w[a : a + length]
        copy[length // 2] = "edited"
        texts += [" ".join(w), " ".join(words(r, 20) + copy + words(r, 20))]
        n += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = P.passage_links(docs).collect()
    _, _, near, _ = similar_stretches(texts)
    due = {d for d in near if d % 2}
    assert len(due) > 60 and len(due & {x.doc_id for x in links}) >= 0.9 * len(due)


def test_ids_repeated_null_and_of_text(spark):
    texts = planted(2)
    named = [("b", texts[1]), ("b", texts[2]), ("a", texts[2]), (None, texts[2]), ("c", None), ("d", "")]
    links = P.passage_links(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in links} == {("b", "a")} and {r.class_id for r in links} == {"a"}
    swapped = P.passage_links(spark.createDataFrame([(2, texts[2]), (1, texts[1]), (2, "other words"), (1, "some words")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.class_id) for r in swapped} == {(2, 1, 1)}


def test_distinct_counts_and_prefix_places():
    x = np.array([1, 2, 1, 3, 2, 2, 9], np.uint64)
    assert P.distinct_counts(x, np.arange(4), 4).tolist() == [len(set(x[p : p + 4].tolist())) for p in range(4)]
    r = np.random.default_rng(1)
    rank, use, least = r.permutation(30), r.random(30) < 0.4, 10
    w = np.where(use, 10, 0)
    p, q = P.prefix_places(rank, use, w, np.arange(21), np.full(21, 10), least, 80)
    want = {(s, int(s + a)) for s in range(21) for i, a in enumerate(np.argsort(rank[s : s + 10])) if use[s + a] and 10 - i >= -(-80 * 20 // 180)}
    assert set(zip(p.tolist(), q.tolist(), strict=True)) == want


def test_stretches_like_the_one_before():
    r = np.random.default_rng(3)
    for _ in range(50):
        x = r.integers(0, 4, int(r.integers(5, 30))).astype(np.uint64)
        sets = [set(x[p : p + 5].tolist()) for p in range(len(x) - 4)]
        assert P.like_the_one_before(x, 5).tolist() == [bool(p and sets[p] == sets[p - 1]) for p in range(len(sets))]


def test_one_word_over_and_over(spark):
    """Texts whose stretches are all alike: linked, and not once a word."""
    texts = ["a " * 300, "b c " * 200, "a " * 200 + "x y", "b c " * 90, "z"]
    links = P.passage_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in links} == {(2, 0), (3, 1)}


def test_similar_starts_against_sets():
    r = np.random.default_rng(7)
    for top in (6, 1000):
        for _ in range(60):
            y = r.integers(0, top, 40).astype(np.uint64) if top == 6 else r.permutation(top)[:40].astype(np.uint64)
            x = np.concatenate([y[5:20], r.integers(1000, 1003, 1).astype(np.uint64), y[20:33]])
            for shift in (-3, 0, 4, 5, 6):
                want = [a for a in range(len(x) - 9) if 0 <= a + shift <= len(y) - 10 and 100 * len(set(x[a : a + 10]) & set(y[a + shift : a + shift + 10])) >= 80 * len(set(x[a : a + 10]) | set(y[a + shift : a + shift + 10]))]
                assert P.similar_starts(x, y, shift, 10, 80).tolist() == want


def test_a_link_with_the_first_partner_does_not_stand_for_others(spark):
    """A passage is similar to two others, which are not similar to each other; each of these may have a partner of its own."""
    r, texts = Random(9), []
    for t in range(40):
        passage = words(r, WORDS)
        one, two = list(passage), list(passage)
        one[11], two[37] = "edited", "altered"
        for body in (one, two, *([two] if t % 2 else []), passage):
            texts.append(" ".join(words(r, 20) + body + words(r, 20)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    links = P.passage_links(docs).collect()
    of = {d: r.class_id for r in links for d in (r.doc_id, r.other_id)}
    due = similar_stretches(texts)[3]
    assert len(due) >= 100 and sum(of.get(d, -1) == of.get(e, -2) for d, e in due) >= 0.93 * len(due)
    tokens = [shingle_hashes(word_hashes(t), K) for t in texts]
    for r in links:
        a, b = (set(tokens[x][p : p + n - K + 1].tolist()) for x, p, n in ((r.doc_id, r.start, r.n_words), (r.other_id, r.other_start, r.other_words)))
        assert (len(a & b), len(a | b)) == (r.shared, r.together) and 100 * r.shared >= 80 * r.together


def test_runs_of_similar_starts_are_all_found():
    y = np.arange(60, dtype=np.uint64)
    x = y.copy()
    x[25:32] = np.arange(100, 107, dtype=np.uint64)
    starts = P.similar_starts(x, y, 0, 10, 80)
    assert (np.diff(starts) > 1).sum() == 1
    got = {a for s, e, *_ in P.similar_runs(x, y, starts, 0, 10, 80) for a in range(s, e - 9)}
    assert got == set(starts.tolist())


def test_prefixes_and_counts_of_stretches():
    """Against brute force, with repeated tokens and without; of prefixes, only ranks that several occurrences hold are made."""
    r = np.random.default_rng(5)
    for n, kinds in ((6, 50), (6, 4), (11, 400), (30, 9), (40, 4000)):
        for _ in range(20):
            x, least = r.integers(0, kinds, n), 6
            stretches = [sorted(set(x[a : a + least].tolist())) for a in range(n - least + 1)]
            assert P.distinct_counts(x, np.arange(len(stretches)), least).tolist() == [len(y) for y in stretches]
            want = {t for y in stretches for t in y[: len(y) - -(-len(y) * 80 // 100) + 1]}
            low = int(r.integers(0, kinds + 1))
            assert P.prefix_ranks(x, least, 80).tolist() == sorted(want)
            assert P.prefix_ranks(x, least, 80, low).tolist() == sorted(t for t in want if t >= low)
            assert P.distinct(x).tolist() == sorted(set(x.tolist())) and P.all_distinct(x) == (len(set(x.tolist())) == n)


def test_copies_take_the_prefix_of_the_first(monkeypatch):
    """Of occurrences with the same stretches, one prefix is made for all."""
    k, least, calls, real = 5, 6, [], P.prefix_ranks
    monkeypatch.setattr(P, "prefix_ranks", lambda *a: calls.append(1) or real(*a))
    tokens, n = np.arange(100, 106, dtype=np.uint64), 9
    one = lambda x, kind: np.full(n, x, kind)
    columns = [one(7, np.uint64), np.arange(n), *(one(x, np.uint32) for x in (3, 0, 0, 0, 0)), one(1, np.uint8), np.arange(n)]
    blobs = [x for _, x in P.ragged(np.zeros(n, np.int64), columns, [tokens] * n)]
    found = [x for b in P._repair(iter([P._rows([(0, P.AROUND, None, x) for x in blobs])]), k, least, 80) for x in b.to_pylist()]
    assert {x["doc_id"] for x in found} == set(range(1, n)) and {x["other_id"] for x in found} == {0}
    assert len(calls) == 1


def test_codes_of_words_and_shingles_tell_the_same_words_apart():
    """Words of all lengths about 8 and 16 bytes, at the ends of a text, in any case, split as bytes are."""
    r = np.random.default_rng(9)
    words = [bytes(r.choice(list(b"aB\xc3\x00"), n).astype(np.uint8)) for n in range(1, 40) for _ in range(20)] + [b"a", b"a\x00", b"abcdefgh", b"abcdefgh\x00"]
    text = b"\t".join(words) + b" \x0b\x0c\r\n" + b" ".join(words)
    split, codes = text.lower().split(), word_codes(text).tolist()
    assert len(split) == len(codes) and len(set(split)) == len(set(codes)) == len(set(zip(split, codes, strict=True)))
    assert len(word_codes(None)) == len(word_codes("")) == len(word_codes(" \n")) == 0 and word_codes("É a")[1] == word_codes("A")[0]
    for k in (1, 5, 2000):
        other = shingle_hashes(word_hashes(text), k).tolist()
        mine = shingle_codes(text, k).tolist()
        assert len(mine) == len(other) and len(set(mine)) == len(set(other)) == len(set(zip(mine, other, strict=True)))
