"""Repeated and null ids, clashing columns and empty tables, for every operator; and parts against their definitions."""

import math
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import html_extract, line_dedup, mixing, near_dedup, packing, passage_windows, quality_classifier, quality_rules, substring_dedup, webp
from siltstone.llm.common import free_name
from siltstone.llm.shingles import shingle_set, similar

CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, host_rate double, posterior int, n_lines int, n_dropped int, d int, u int, label int, media binary, feature int"


def clash_rows(seed=2):
    """Forty rows: half without an id, the others of three ids; equal and different texts, nulls, empty ones."""
    r = Random(seed)
    texts = [" ".join(r.choice(("alpha", "beta", "gamma", "delta", "rho", "tau")) + str(r.randrange(40)) for _ in range(r.randrange(80))) for _ in range(12)] + [None, "", "x y z"]
    return [(None if i % 2 else i % 3, r.choice(texts), ("en", None)[i % 2], ("s1", "s2", None)[i % 3], 5, 1, "old", 0.5, 9, 7, 8, 1, 2, 3, None, 4) for i in range(40)]


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame(clash_rows(), CLASH).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i % 3, i % 2, (i // 2) % 2) for i in range(6)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


def words(t):
    return len((t or "").split())


def test_free_name(spark):
    df = spark.range(1).withColumn("A", F.lit(1)).withColumn("a_", F.lit(1))
    assert (free_name(df, "a"), free_name(df, "b")) == ("a__", "b")


def test_mix_of_repeated_ids_takes_what_is_planned(clash):
    taken = sum(r.taken for r in mixing.mix(clash).collect())
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns
    assert sum(words(r.text) for r in out.collect()) == taken > 0
    assert Counter(r.taken for r in mixing.mix(clash.repartition(7)).collect()) == Counter(r.taken for r in mixing.mix(clash).collect())


def test_classifier_keeps_input_columns(clash, labels):
    kept = quality_classifier.keep_good(clash, labels)
    assert kept.columns == clash.columns and {r.kept for r in kept.collect()} <= {"old"}
    judged = quality_classifier.classify(clash, labels)
    assert {"kept", "kept_", "host_rate_", "posterior_", "path_rate"} <= set(judged.columns) and judged.count() == 40


def test_lines_keep_input_columns(clash):
    out = line_dedup.line_dedup(clash)
    assert [c for c in out.columns if c in clash.columns] == clash.columns and {"n_lines_", "n_dropped_"} <= set(out.columns)
    assert {(r.n_lines, r.n_dropped) for r in out.collect()} == {(7, 8)}


def test_salted_lists_drop_the_same_lines(spark):
    r = Random(1)
    line = lambda: f"line {r.randrange(40)}"
    docs = spark.createDataFrame([(i, "\n".join(line() for _ in range(9)), ("s1", None)[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    a = {x.doc_id: (x.text, x.n_dropped) for x in line_dedup.line_dedup(docs).collect()}
    b = {x.doc_id: (x.text, x.n_dropped) for x in line_dedup.line_dedup(docs, most=0).collect()}
    assert a == b and any(n for _, n in a.values())


def test_hosts_of_many_bytes_are_salted_with_the_same_result(spark, monkeypatch):
    """One host with most rows, copies of one text among them, and a null host; salts by their bytes."""
    rows = [(i, "menu line\nown words %d\nfoot line" % (i % 7 if i < 60 else i), "big" if i < 90 else ("small", None)[i % 2]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plain = {tuple(r) for r in line_dedup.line_dedup(docs).collect()}
    monkeypatch.setattr(line_dedup, "SALT_BYTES", 200)
    salted = line_dedup.line_dedup(docs, most=0)
    assert {tuple(r) for r in salted.collect()} == plain and salted.count() == 120
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan


def test_pages_with_a_text_column(spark):
    pages = spark.createDataFrame([(1, "u", "<html><body><article><p>" + "Some words of the story. " * 30 + "</p></article></body></html>", "old"), (2, "u", None, None)], "page_id long, url string, html string, text string")
    out = html_extract.extract_pages(pages).orderBy("page_id").collect()
    assert out[0].text == "old" and out[0].text_.startswith("Some words") and out[1].text_ == ""


def test_rules_and_others_take_every_input(clash, labels):
    good = labels.select("doc_id", (F.col("quality") == 1).alias("good"))
    assert quality_rules.judge(clash, good).count() == 40
    assert webp.media_digests(clash).count() == 40
    assert packing.pack(clash, packing.default_tokenizer()).filter("start = 0").count() >= 40
    assert substring_dedup.substring_dedup(clash).count() == 40
    assert passage_windows.passage_links(clash).filter("doc_id is null").count() == 0


def components(rows, k):
    """Smallest id reachable for each row, over rows of their own; null ids apart."""
    sets = [shingle_set(t, k) if d is not None else () for d, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i]) and len(sets[j]) and similar(sets[i], sets[j], 80):
                group[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, None if d is None else min(x for x in least[root(i)] if x is not None)) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_of_repeated_ids_whatever_their_order(spark):
    b = " ".join(f"w{i}" for i in range(60))
    a = b + " tail"
    rows = [(1, b), (2, "z z z q w e r t y"), (2, a), (None, a), (3, a), (3, ""), (4, None)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), k=4).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == Counter(components(order, 4))
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    named = near_dedup.near_duplicates(spark.createDataFrame([("b", b), ("a", a)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in named} == {("a", "a"), ("b", "a")}
    assert near_dedup.one_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4  # a's component, z, the empty and the null text


def test_blocks_of_a_frequent_token_meet_once_each(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = Random(6)
    rows = [(t, u, r.randrange(20, 30), r.randrange(6), r.randrange(3)) for t, n in ((7, 30), (8, 3), (9, 1)) for u in range(n)]
    got = [tuple(x) for x in near_dedup.met(spark.createDataFrame(rows, "token long, u long, n long, i long, c long"), 80).collect()]
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and y[1] < x[1] and x[4] != y[4] and 180 * min(x[2] - x[3], y[2] - y[3]) >= 80 * (x[2] + y[2])}
    assert len(got) == len(set(got)) and set(got) == want


def test_binomial_tail_against_its_sum():
    r = Random(4)
    for _ in range(200):
        n = r.randrange(1, 400)
        k, p = r.randrange(n), r.uniform(0.001, 0.999)
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.tail(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-14)
    # a wide tail, of which the last 2000 terms are not all
    n, k, p = 40_000_000, 2_000_000, 0.05
    assert quality_rules.tail(k, n, p) == pytest.approx(0.5, abs=1e-3)
    assert quality_rules.tail(k, n, quality_rules.upper_bound(k, n, 0.01)) == pytest.approx(0.01, rel=1e-4)


def test_cutoffs_against_brute_force(spark):
    """Verdicts by hand: halves and scales from the rows, every cutoff tried with binomial sums."""
    r = Random(12)
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        text = " ".join(r.choice(("word", "other", "thing", "AAA" if bad else "more", "#$%" if bad else "less")) + str(r.randrange(500)) for _ in range(60))
        rows.append((i, text, ("en", "de", "xx")[0 if i < 600 else 1 if i < 890 else 2]))
    docs = spark.createDataFrame([*rows, *((1000 + i, rows[i][1], rows[i][2]) for i in range(5))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 3 != 0) for i in range(900)], "doc_id long, good boolean")
    got = {x.doc_id: x for x in quality_rules.judge(docs, labels).collect()}
    half = {x.doc_id: x.h for x in docs.select("doc_id", F.expr(f"pmod(xxhash64({quality_rules.SEED}, xxhash64(text)), 2)").alias("h")).collect()}
    value = {}
    for i, x in got.items():
        safe = lambda a, b: a / b if b else 0.0
        value[i] = dict(symbols=safe(x.n_symbols, x.word_chars), repeats=safe(x.n_repeat_words, x.n_words), dup_lines=safe(x.n_dup_lines, x.n_lines), capitals=safe(x.n_capitals, x.word_chars), long_words=safe(x.word_chars, x.n_words))
        text = next(t for j, t, _ in rows if j == i % 1000)
        assert x.n_symbols == sum(text.count(c) for c in "#*$%&|<>") and x.n_words == len(text.split())
    train = [i for i in range(900) if i % 3 and half[i] == 0 and not got[i].base_failed]
    scale = {}
    for rule in quality_rules.RULES:
        ordered = sorted(value[i][rule] for i in train)
        scale[rule] = max(ordered[math.ceil(0.995 * len(ordered)) - 1], 0.01)
    severity = {i: max(value[i][k] / scale[k] for k in scale) for i in value}
    strata = defaultdict(lambda: ([], []))
    for i, _, lang in rows:
        if half[i] == 1 and not got[i].base_failed:
            strata[lang][i % 3 == 0].append(severity[i])
    cut = {}
    for lang, (good, bad) in strata.items():
        below = lambda k, n, p: math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        valid = []
        for c in reversed(quality_rules.CUTOFFS):
            k = sum(s > c for s in good)
            # the bound is at most alpha where the tail at alpha is at most the error
            if not good or k == len(good) or below(k, len(good), 0.05) > 0.05 / len(strata):
                break
            valid.append(c)
        if valid:
            most = sum(s > valid[-1] for s in bad)
            cut[lang] = next(c for c in valid if sum(s > c for s in bad) >= 0.98 * most)
    assert "en" in cut and "xx" not in cut
    for i, x in got.items():
        assert x.severity == pytest.approx(severity[i]) and (x.cutoff is None or x.cutoff == cut[x.stratum])
        assert x.kept == (not x.base_failed and not severity[i] > cut.get(x.stratum, math.inf) * (1 + 1e-9))


def test_site_posteriors_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, ("h1", "h2", None)[int(r.integers(3))], ("p", None)[int(r.integers(2))], float(r.normal(-2, 2)), float(r.normal(-3, 1))) for i in range(300)]
    scores = spark.createDataFrame(rows, "doc_id long, source string, lang string, _qc_low double, _qc_toxic double")
    sites, rate = quality_classifier.site_posteriors(scores, "source", "lang")
    got = {x.doc_id: x for x in quality_classifier._posterior(scores, sites, rate, "source", "lang", 1.0, 0.25).collect()}
    sig = lambda z: 1 / (1 + math.exp(-z))
    bad = {i: 1 - (1 - sig(a)) * (1 - sig(b)) for i, _, _, a, b in rows}
    mean = sum(bad.values()) / len(bad)

    def strength(groups, at):
        n = sum(len(g) for g in groups)
        v = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, at))
        w, p = sum(m * (1 - m) for m in at), sum(len(g) * m * (1 - m) for g, m in zip(groups, at))
        return min(1e6, max(5, p / n / max((v - w) / n, 1e-9) - 1))

    hosts, paths = defaultdict(list), defaultdict(list)
    for i, h, p, _, _ in rows:
        hosts[h].append(bad[i]), paths[h, p].append(bad[i])
    k = strength(list(hosts.values()), [mean] * len(hosts))
    host = {h: (k * mean + sum(g)) / (k + len(g)) for h, g in hosts.items()}
    k = strength(list(paths.values()), [host[h] for h, _ in paths])
    path = {x: (k * host[x[0]] + sum(g)) / (k + len(g)) for x, g in paths.items()}
    odds = lambda q: math.log(q / (1 - q))
    for i, h, p, _, _ in rows:
        want = sig(odds(bad[i]) + min(1, max(-1, odds(path[h, p]) - odds(mean))))
        assert got[i]._qc_posterior == pytest.approx(want, rel=1e-9) and got[i]._qc_kept == (want < 0.25)


def test_taken_words_against_a_walk_around_the_ring(spark):
    """One shard a source: seats by the highest quotients one by one, words taken block after block."""
    r = Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randrange(60))), ("a", "b", "c", None)[min(3, i % 5)]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(docs).collect()}
    order = {x.doc_id: (x.h, x.doc_id) for x in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h")).collect()}
    names = ["a", "b", "c", None]
    sizes = [sum(words(t) for _, t, s in rows if s == n) for n in names]
    targets, weights, open_, left = [0.0] * 4, [1, 2, 3, 1], [0, 1, 2, 3], sum(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            targets = [share.get(i, t) for i, t in enumerate(targets)]
            break
        for i in over:
            targets[i] = 3 * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in over]
    block = int(max(1, min(256, min(targets) // 200)))
    seats = [0] * 4
    for _ in range(round(sum(targets) / block)):
        free = [i for i in range(4) if seats[i] < 3 * sizes[i] // block]
        best = max(free, key=lambda i: (targets[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    start = {x.i: x.h for x in spark.createDataFrame([(i,) for i in range(4)], "i long").select("i", F.expr(f"xxhash64({mixing.SEED}, i, cast(0 as long))").alias("h")).collect()}
    for i, n in enumerate(names):
        ring = [d for d in sorted((d for d, _, s in rows if s == n), key=order.get) for _ in range(got[d].size)]
        at = block * (start[i] % max(1, len(ring) // block))
        taken = Counter(ring[(at + k) % len(ring)] for k in range(seats[i] * block))
        for d, _, s in rows:
            if s == n:
                assert (got[d].taken, got[d].source_size) == (taken[d], sizes[i]) and got[d].target == pytest.approx(targets[i])


def test_seats_of_many_sources():
    r = np.random.default_rng(2)
    w, caps = r.random(500), r.integers(0, 9, 500)
    got = mixing.sainte_lague(w, 700, caps)
    want = np.zeros(500, int)
    for _ in range(700):
        q = np.where(want < caps, w / (2 * want + 1), -1)
        want[int(np.argmax(q))] += 1
    assert got.tolist() == want.tolist()


def test_a_vocabulary_that_joins_words_is_refused(tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "plain.json")
    Tokenizer(models.WordLevel({"[UNK]": 0, "a b": 2}, unk_token="[UNK]")).save(path)
    with pytest.raises(ValueError):
        packing.checked(path)
    packing.checked(packing.default_tokenizer())


def test_all_short_combinations_fill_the_window():
    a = packing.combinations(2048, 12, 4)
    want = {x for n in range(1, 5) for x in _sorted(12, n) if sum(x) > 10}
    assert {tuple(sorted(b + 1 for b in range(12) for _ in range(int(a[b, j])))) for j in range(a.shape[1])} == want


def _sorted(top, n, least=1):
    if not n:
        yield ()
        return
    for b in range(least, top + 1):
        for rest in _sorted(top - b, n - 1, b):
            yield (b, *rest)
