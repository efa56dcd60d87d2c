"""Each operator against brute force, round trips or held-out accuracy on small inputs with nulls, ties and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pytest

from siltstone.llm import html_extract, line_dedup, mixing, near_dedup, packing, passage_windows, quality_classifier, quality_rules, substring_dedup, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _x int"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, empty and null texts, odd bytes and a very long one."""
    r = Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 7)))
    words = [word() for _ in range(400)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, line = text(70), text(9)
    out = [text(r.choice((5, 40, 120, 300))) for _ in range(n)]
    out += [out[3], out[3], out[4] + " tail", f"{text(30)} {passage} {text(20)}", f"{text(10)} {passage} {text(40)}"]
    edited = text(300).split()
    for k in range(4):
        copy = list(edited)
        copy[10 * k + 5] = "changed"
        out.append(" ".join(copy))
    out += ["", None, "  \n ", "a" * 400, "ab" * 300, text(6000)] + [f"{text(12)}\n{line}\n{text(8)}" for _ in range(12)]
    return [(i, t, ("en", "de", None)[i % 3], ("s1", "s1", "s2", None)[i % 4], len(t or ""), 7) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_targets_stop_at_three_times_the_source():
    t = mixing.capped_targets([10, 1000, 1000], [1, 2, 3])
    assert t[0] == 30 and abs(sum(t) - 2010) < 1e-6 and abs(t[2] / t[1] - 1.5) < 1e-9


def test_sainte_lague_takes_the_highest_quotients():
    r = Random(2)
    for _ in range(50):
        w, seats = [r.randint(1, 90) for _ in range(r.randint(1, 7))], r.randint(0, 40)
        got = [0] * len(w)
        for _ in range(seats):
            got[max(range(len(w)), key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague(w, seats, [10**6] * len(w)).tolist() == got


def test_mix(docs, rows, nothing):
    got = mixing.mix(docs, shard_words=900).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), shard_words=900).collect()), key=str)
    size = {i: len(words_of(t)) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in got} == size and all(0 <= r.taken <= 3 * r.size for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source][0] += r.taken
        by[r.source][1], by[r.source][2] = r.target, r.source_size
    assert all(abs(a - b) <= 0.02 * b + 3 for a, b, _ in by.values()) and abs(sum(b for _, b, _ in by.values()) - sum(size.values())) < 1e-3
    rest = mixing.mixed_documents(docs, shard_words=900).collect()
    assert sum(len(words_of(r.text)) for r in rest) == sum(r.taken for r in got)
    assert mixing.mix(nothing).count() == 0


def test_quality_rules(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(60)], "doc_id long, good boolean")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for i, t, *_ in rows:
        w = [x.decode() for x in words_of(t)]
        tri, lines = Counter(zip(w, w[1:], w[2:])), [x for x in (t or "").split("\n") if words_of(x)]
        cover = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), sum(x in lines[:k] for k, x in enumerate(lines)))
        assert r.base_failed == (len(w) < 50 or 2 * len(cover) > len(w)) and (not r.kept or not r.base_failed)
    assert quality_rules.judge(nothing, labels).count() == 0


def test_each_stratum_has_its_own_bound(spark):
    """The smallest of 66 strata has good texts that look worse than other strata's bad ones; one stratum proves nothing."""
    text = lambda i, longer: " ".join(f"w{i}x{j}" + "y" * longer for j in range(60))
    rows = [(f"s{k}", i % 8 > 0, 0 if i % 8 else 25) for k in range(64) for i in range(450)]
    rows += [(None, True, 30)] * 340 + [("tiny", True, 30)] * 5
    rows = [(i, text(i, x), s, good) for i, (s, good, x) in enumerate(rows)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    got = quality_rules.judge(made.select("doc_id", "text", "lang"), made.select("doc_id", "good")).collect()
    assert len(got) == len(rows)
    kept, cutoffs = defaultdict(list), defaultdict(set)
    for r in got:
        kept[r.stratum, rows[r.doc_id][3]].append(r.kept)
        cutoffs[r.stratum].add(r.cutoff)
    assert all(kept[None, True]) and all(kept["tiny", True])
    assert cutoffs["tiny"] == {None} and None not in cutoffs[None] and all(len(x) == 1 for x in cutoffs.values())
    assert all(all(kept[f"s{k}", True]) and not any(kept[f"s{k}", False]) for k in range(64))


def test_places_among_many_siblings():
    for k in (399, 400, 1000):
        nodes, x = html_extract.features(html_extract.parse("<html><body>" + "".join(f"<p>text {i}</p>" for i in range(k)) + "</body></html>")[0])
        at = [x[i, 8] for i, n in enumerate(nodes) if n.tag == "p"]
        assert at == [i / k for i in range(k)]


def test_exact_bounds_and_cutoffs():
    assert abs(quality_rules.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-6
    good, bad = [0] * (len(quality_rules.CUTOFFS) + 1), [0] * (len(quality_rules.CUTOFFS) + 1)
    good[3], bad[100] = 1000, 50
    c = quality_rules.choose_cutoff(good, bad, 0.05, 0.01)
    assert 4 < quality_rules.CUTOFFS.index(c) < 100
    assert quality_rules.choose_cutoff([5] + good[1:3] + [0] * (len(good) - 3), bad, 0.05, 0.01) is None


def test_substring_removal(spark, docs, rows, nothing, monkeypatch):
    def brute(items, length=100):
        seen, out = set(), {}
        for i, t in items:
            b = (t or "").encode()
            gone = bytearray(len(b))
            for p in range(len(b) - length + 1):
                if b[p : p + length] in seen:
                    gone[p : p + length] = b"\1" * length
                seen.add(b[p : p + length])
            out[i] = (len(b), sum(gone), sum(1 for x in range(len(b)) if gone[x] and (not x or not gone[x - 1])), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
        return out

    want = brute([(i, t) for i, t, *_ in rows])
    assert sum(x[1] for x in want.values()) > 1000
    for wide in (50_000, 2):
        assert {r[0]: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs, wide=wide).collect()} == want
    twice = spark.createDataFrame([(5, "q" * 120), (5, "q" * 120), (None, "q" * 120)], "doc_id long, text string")
    # of 120 equal letters the windows from the second on repeat the first
    assert sorted(r.n_removed for r in substring_dedup.substring_dedup(twice).collect()) == [119, 120, 120]
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 3000)
    r = Random(4)
    text = bytes(r.choice(b"abcdef ") for _ in range(20_000))
    whole, _, _, _ = substring_dedup.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))
    seen = set()
    for raw, ends, _, offsets in substring_dedup.parts([1], [text], 100):
        q = substring_dedup.anchors(raw, ends)[0]
        of = np.searchsorted(ends, q, side="right")
        seen |= set((q - np.concatenate([[0], ends[:-1]])[of] + offsets[of]).tolist())
    assert set(whole.tolist()) == seen


def test_texts_over_a_part(spark):
    """Parts of a text of over 1 MiB show anchors near their borders twice: unique text there stays, real repeats go."""
    r = Random(5)
    step = substring_dedup.PART - 400
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    long = " ".join(word() for _ in range(substring_dedup.PART // 10 + 20_000)).encode()
    texts = [long, " ".join(word() for _ in range(60)).encode() + long[step - 150 : step + 150], long[1000:1180], b"x" + long[: step + 9000]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if (w := hash(t[p : p + 100])) in seen:
                gone[p : p + 100] = True
            seen.add(w)
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    assert want[0][1] == 0 and want[1][1] == 300
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x[0]: tuple(x)[1:] for x in substring_dedup.substring_dedup(df).collect()} == want


def test_classifier_finds_planted_words(spark, nothing):
    r = Random(3)
    pool = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(pool) for _ in range(80)]
        kind = i % 5
        if kind == 1:
            w[7] = r.choice(("vileword", "badword"))
        if kind == 2:
            w = [f"{x}***" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0, 1))
        if i < 500:
            labels.append((i, 0 if kind == 2 else 1, int(kind == 1)))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality_classifier.classify(docs, marks).collect()}
    assert sum(got[i] == (i % 5 not in (1, 2)) for i in range(500, 700)) >= 196
    assert quality_classifier.keep_good(docs, marks).columns == docs.columns
    assert quality_classifier.classify(nothing, marks).count() == 0
    assert quality_classifier.classify(docs, marks.limit(0)).filter("kept").count() == 700


def test_packing_round_trip(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(nothing, path).count() == 0
    odd = ["a<|endoftext|>b x", "é́", "İX ΣΑΣ x", "a b c \x1cd", "don't, I'LL. 9.5, x.", "", "!!, a… , b.", "<|STARTOFTEXT|> Y."]
    o, _ = packing.WordTokens(path).encode(odd)
    assert o.tolist() == [i for x in odd for i in [*tok.encode(x, add_special_tokens=False).ids, 1]]


def test_nnls_solves_a_known_system():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.nnls(a, np.array([4.0, 3.0]), 3000)
    assert np.abs(a @ x - [4, 3]).max() < 1e-3 and (x >= 0).all()


def test_word_cache_ages(monkeypatch):
    """A cache that overflows again and again gives the ids of a fresh one."""
    path, r = packing.default_tokenizer(), Random(5)
    common = [f"common{i}" for i in range(30)]
    texts = [" ".join(r.choice(common) if r.random() < 0.5 else f"w{r.randrange(10**9)}é" for _ in range(50)) for _ in range(40)]
    want = packing.WordTokens(path).encode(texts)
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    small, ids, sizes = packing.WordTokens(path), [], []
    for i in range(0, len(texts), 4):
        a, b = small.encode(texts[i : i + 4])
        ids.append(a), sizes.append(b)
    assert np.array_equal(np.concatenate(ids), want[0]) and np.array_equal(np.concatenate(sizes), want[1])
    small._age()
    assert 0 < len(small.words) < 100


def test_html_extraction(spark):
    page = """<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Head &amp;
      line</h1><p>First para is long enough to be content here. <p><b>Second one follows, also with words.<br>More.</article><div class="comments"><p>Reader says hi there friends.</p></div><footer>&copy; x</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert got == {1: "Head & line\n\nFirst para is long enough to be content here.\n\nSecond one follows, also with words. More.", 2: "", 3: ""}


def test_html_held_out_pages():
    r, model, good = Random(77), html_extract.train(), 0
    for _ in range(60):
        page = html_extract.synthetic_page(r)
        _, runs = html_extract.parse(re.sub(r" data-c=[01]", "", page))
        want = html_extract.blocks(runs, {o for o, v in html_extract._marked(page).items() if v})
        good += html_extract.extract(re.sub(r" data-c=[01]", "", page), model) == want
    assert good >= 54


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n)]

    def code(self, *symbols):
        """A simple code of one or two symbols."""
        self.put(1, 1), self.put(len(symbols) - 1, 1), self.put(1, 1), self.put(symbols[0], 8)
        if len(symbols) > 1:
            self.put(symbols[1], 8)

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def head(w, width, height):
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)


def test_reader_palette_subtract_green_and_predictors():
    w = Writer()
    head(w, 8, 1)
    w.put(1, 1), w.put(3, 2), w.put(1, 8), w.put(0, 1)  # palette of two, as differences
    for s in ((10, 20), (1, 2), (3, 3), (255, 0), (0,)):
        w.code(*s)
    for bit in (0, 0, 1, 1, 1, 0):  # green 10, red 1, alpha 255; then plus 20, 2 and 0 (blue: 3 and 3)
        w.put(bit, 1)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)  # no more transforms, no cache, one group
    w.code(0b10110010), w.code(0), w.code(0), w.code(0), w.code(0)
    _, _, p = webp.decode_stream(w.bytes())
    a, b = 0xFF010A03, 0xFF031E06
    assert p.tolist() == [b if 0b10110010 >> k & 1 else a for k in range(8)]


def test_reader_back_reference_and_cache():
    w = Writer()
    head(w, 6, 1)
    w.put(0, 1), w.put(1, 1), w.put(2, 4), w.put(0, 1)  # no transforms, a cache of four, one group
    # green: 7, a length symbol (256 + 2: three pixels) and cache entries 280.. by a normal code of four equal lengths
    value = 0xFF050709
    slot = 280 + ((webp.HASH * value & 0xFFFFFFFF) >> 30)
    lengths = [0] * 284
    for s in sorted({7, 258, slot, 281 if slot != 281 else 282}):
        lengths[s] = 2
    w.put(0, 1), w.put(6 - 4 + 0, 4)
    for s in webp.LENGTH_ORDER[:6]:
        w.put(1 if s in (0, 2) else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(n // 2, 1)
    w.code(5), w.code(9), w.code(255), w.code(1)  # distance symbol 1: code 2, the pixel before
    order = sorted(s for s in range(284) if lengths[s])
    for s in (7, slot, 258, 7):
        k = order.index(s)
        w.put(k >> 1, 1), w.put(k & 1, 1)
    assert webp.decode_stream(w.bytes())[2].tolist() == [value] * 6
    with pytest.raises(ValueError):
        webp.decode_stream(w.bytes()[:8])


def test_cross_colour_and_gradient_predictor_invert():
    r = np.random.default_rng(5)
    pixels = r.integers(0, 2**32, 30, dtype=np.uint32)
    e = np.array([0xFF102030], np.uint32)
    signed = lambda v: (v & 255 ^ 128) - 128
    c = webp._split(pixels)
    red = (c[:, 1] - (signed(np.int64(0x30)) * signed(c[:, 2]) >> 5)) & 255
    blue = (c[:, 3] - (signed(np.int64(0x20)) * signed(c[:, 2]) >> 5) - (signed(np.int64(0x10)) * signed(c[:, 1]) >> 5)) & 255
    coded = webp._join(np.stack([c[:, 0], red, c[:, 2], blue], -1))
    assert (webp.undo_cross_colour(coded, e, 6, 5, 3) == pixels).all()


def test_line_dedup(docs, rows, nothing):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, ratio=0.05, min_pages=3).collect()}
    pages, total = Counter(), Counter(r[3] for r in rows)
    for _, t, _, s, *_ in rows:
        pages.update({(s, x) for x in (t or "").split("\n") if words_of(x)})
    for i, t, _, s, *_ in rows:
        want = None if t is None else "\n".join(x for x in t.split("\n") if not (pages[s, x] >= 3 and pages[s, x] > 0.05 * total[s]))
        assert got[i].text == want and got[i]["_x"] == 7
    assert any(r.n_dropped for r in got.values()) and line_dedup.line_dedup(nothing).count() == 0


def links_of(rows, k, percent):
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words_of((t or "").lower())) else set() for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs, rows, nothing):
    want = links_of(rows, 4, 80)
    got = near_dedup.near_duplicates(docs, k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.one_each(docs, k=4).count() == len({c for _, c in want.values()})
    assert near_dedup.near_duplicates(nothing).count() == 0
    odd = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in odd) == [("4", "4", True), ("4", "4", True), ("None", "None", True)]


def test_a_chain_of_near_copies_and_far_members(spark):
    """A hub with near copies, a far copy of the hub that only links through a middle one, and many far ones apart."""
    r = Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(40):
        w, edits = list(base), r.choice((1, 2, 3, 5, 8, 12))
        for p in r.sample(range(150), edits):
            w[p] = f"x{r.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(df, k=4).collect()} == links_of(rows, 4, 80)


def test_passages(docs, rows, nothing):
    got = passage_windows.passage_links(docs).collect()
    w = {i: words_of((t or "").lower()) for i, t, *_ in rows}
    where = defaultdict(set)
    for i, x in w.items():
        for j in range(len(x) - 49):
            where[tuple(x[j : j + 50])].add(i)
    later = {i for s in where.values() for i in s - {min(s)}}
    assert later and later <= {r.doc_id for r in got}
    shingles = lambda x: set(zip(*(x[q:] for q in range(5))))
    for r in got:
        a, b = shingles(w[r.doc_id][r.start : r.start + r.n_words]), shingles(w[r.other_id][r.other_start : r.other_start + r.other_words])
        assert r.other_id < r.doc_id and len(a & b) == r.shared and len(a | b) == r.together and 5 * r.shared >= 4 * r.together
    assert passage_windows.passage_links(nothing).count() == 0


def test_passages_after_an_earlier_partial_copy_and_in_chains(spark):
    """B and C repeat a passage of which the earlier A has only a part; in a chain of variants each shares 52 words with the one before."""
    r = Random(8)
    fresh = lambda k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(k)]
    rows, later = [], set()
    for t in range(150):
        passage, cut, at = fresh(50), 44 if t % 2 else 40, 10 * t
        for i, middle in enumerate((passage[:cut], passage, passage)):
            rows.append((at + i, " ".join(fresh(40) + middle + fresh(40))))
        later |= {at + 2, at + 4, at + 5, at + 6}
        version = fresh(60)
        for i in range(3, 7):
            rows.append((at + i, " ".join(fresh(40) + version + fresh(40))))
            version = version[:7] + fresh(1) + version[8:] if i % 2 else version[:52] + fresh(1) + version[53:]
    shingles = lambda x: set(zip(*(x[q:] for q in range(5))))
    w = {i: t.split() for i, t in rows}
    where = defaultdict(set)
    for i, x in w.items():
        for j in range(len(x) - 49):
            where[tuple(x[j : j + 50])].add(i)
    assert later == {i for s in where.values() for i in s - {min(s)}}
    got = passage_windows.passage_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert later <= {x.doc_id for x in got}
    for x in got:
        a, b = shingles(w[x.doc_id][x.start : x.start + x.n_words]), shingles(w[x.other_id][x.other_start : x.other_start + x.other_words])
        assert x.other_id < x.doc_id and len(a & b) == x.shared and len(a | b) == x.together and 5 * x.shared >= 4 * x.together


def test_prefixes_of_similar_stretches_meet():
    r = np.random.default_rng(3)
    for _ in range(200):
        x = r.permutation(300)[: r.integers(46, 80)]
        y = x.copy()
        y[r.integers(0, len(y), r.integers(0, 8))] = r.integers(300, 400)
        near = passage_windows.similar_at(x.astype(np.uint64), y.astype(np.uint64), range(len(x)), 0, 46, 80)
        if near:
            assert set(passage_windows.prefix_ranks(x, 46, 80)) & set(passage_windows.prefix_ranks(y, 46, 80))


def test_stages_with_repeated_and_null_ids(spark):
    """Rows that share an id or have none are documents of their own in the pipeline's mix and near-dedup."""
    r = Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = text(40), text(40), text(40)
    rows = [(1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (4, c), (5, text(40)), (None, text(40)), (None, None)]
    df = spark.createDataFrame([(i, t, None, "s1", len(t or ""), 7) for i, t in rows], SCHEMA)
    got = sorted(((x.doc_id, x.text) for x in near_dedup.one_each(df, k=4).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (4, c), rows[7], rows[8], (None, None)], key=str)
    rows = [((7, None, i)[i % 3], text(20 + i % 5), None, ("s1", "s2", "s3")[i % 7 % 3], 0, i) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    size = {x: len(words_of(t)) for _, t, _, _, _, x in rows}
    took, total = Counter(), sum(size.values())
    for x in mixing.mixed_documents(df).collect():
        took[x._x] += len(words_of(x.text))
    assert all(took[x] <= 3 * size[x] for x in size) and abs(sum(took.values()) - total) <= 256
    # by source: 1, 2, 3, none above three times its words
    of = {x: s for _, _, _, s, _, x in rows}
    for i, s in enumerate(("s1", "s2", "s3")):
        want = mixing.capped_targets([sum(size[x] for x in size if of[x] == q) for q in ("s1", "s2", "s3")], [1, 2, 3])[i]
        assert abs(sum(n for x, n in took.items() if of[x] == s) - want) <= 0.02 * total
