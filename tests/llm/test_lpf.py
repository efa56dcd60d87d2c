"""LPF arrays against their definition, and the substring operator against all windows, long texts included."""

import hashlib
from random import Random

import numpy as np

from siltstone.llm import substring_dedup as S


def test_longest_previous_factors_by_definition():
    r = np.random.default_rng(2)
    for _ in range(60):
        n, least = int(r.integers(1, 40)), int(r.integers(1, 6))
        rows = r.integers(0, 2, (n, 6), dtype=np.uint8)
        place = r.permutation(n)
        order = np.lexsort([place, *(rows[:, j] for j in range(5, -1, -1))])
        got = S.longest_previous_factors(S.lcp_of(rows[order]), place[order], least)
        for k, i in enumerate(order):
            want = max([int(np.argmax(np.append(rows[i] != rows[j], True))) for j in range(n) if place[j] < place[i]], default=0)
            assert got[k] == want if want >= least else got[k] < least


def brute(rows, length=100):
    """(n_bytes, n_removed, n_spans, sha256) by document: windows are kept with their first place."""
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for p in range(len(raw) - length + 1):
            w = hashlib.blake2b(raw[p : p + length], digest_size=12).digest()
            if first.setdefault(w, (d, p)) != (d, p):
                gone[p] += 1
                gone[min(p + length, len(raw))] -= 1
        hit = np.cumsum(gone)[: len(raw)] > 0
        spans = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
        out[d] = (len(raw), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest())
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.substring_dedup(docs, **options).collect()}
    assert got == brute(rows)


def passages(seed=3):
    """Common phrases in changing surroundings, so that one anchor has many of them, and exact and shifted copies."""
    r = Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    phrase, long = text(12), text(60)
    rows = [text(r.choice((3, 30, 90))) for _ in range(25)]
    rows += [f"{text(r.randint(0, 9))} {phrase} {text(r.randint(0, 9))}" for _ in range(40)]
    rows += [f"{text(5)} {long} {text(4)}" for _ in range(6)] + [long[k:] for k in range(0, 40, 7)]
    return rows + [rows[2], rows[2] + "x", None, "", "z" * 700, "yx" * 200]


def test_operator_against_all_windows(spark):
    rows = list(enumerate(passages()))
    check(spark, rows)
    check(spark, rows, wide=1)


def test_text_beyond_one_part(spark):
    r = Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(190_000))
    assert len(long) > S.PART
    copied = long[S.PART - 3000 : S.PART + 3000]
    check(spark, [(1, "start " + copied[:500]), (2, long), (3, "x" + copied), (4, long[-900:])])
