"""Near-duplicate passages by compact windows of min-hashes.

Tokens are five-word shingles. For each of `functions` hash functions the Cartesian tree of a document's token hashes
groups its subsequences: all subsequences that hold node m and stay in m's span [l, r] share the min-hash of m. Nodes
whose span holds `least` tokens are the compact windows; they are found by sliding minima, and a span is kept as the
range of starts of the `least`-token subsequences whose minimum is m (longer ones are unions of these).

1. Windows go to buckets of their min-hash. Occurrences of a min-hash that also agree in a second function are linked with
   the first such occurrence, and the firsts of these groups with the first of all: a passage in n documents costs n links.
2. Per pair of documents the windows' start ranges are joined as intervals along their diagonal; where at least
   `enough` functions agree, the passages under them are candidates.
3. Candidates are verified on their token sets, in whole or, where that fails, at each start along their diagonals.
4. A start of a stretch of `least` tokens is open if later occurrences of `most` functions hold it and no verified link
   covers it: the first partners may hold only a part of the passage. Open stretches are compared with all earlier ones
   that share a min-hash with them and can be similar: with tokens ordered from rare to frequent, similar stretches share
   one so early that the rest suffices for their intersection. Earlier ones that are similar at the place of that token are
   linked until no open start is left, and beyond that all whose class is another: similarity does not carry over, so a link
   with the first partner does not stand for those with others. For that, starts are compared too, covered or not, at which
   `most` functions have occurrences in several classes of the links so far. Stretches of common phrases whose other tokens
   are rarer fall out before anything is compared.

Fingerprints of the verified sets have 64 bits. What a task holds is a bucket's share; buckets follow the input's splits.
A link is one row: (doc_id, start, n_words, other_id, other_start, other_words, shared, together, class_id), words counted
from 0, other_id the earlier document. Each open or covered passage has a row with an earlier document that has it, and similar passages
of two documents put these into one class, by their own row or by those of others, so documents are not expanded into all
pairs; class_id, the smallest id that links reach, groups them.

Defined cases: null text, empty text and texts of fewer than `least_words` words have no passages; null ids are left out;
ids of any type, ordered as the type orders them; rows with one id and links between them are told apart inside and
left out at the end; repeats inside one document are no links; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.blobs import by_bucket, joined, joined_ragged, ragged
from siltstone.llm.common import numbered, release, table, trim, working, written
from siltstone.llm.components import components
from siltstone.llm.shingles import M1, M2, mixed, overlap, shingle_codes

SHINGLE, PERCENT, LEAST_WORDS, FUNCTIONS, ENOUGH, MOST, DRIFT, SEED = 5, 80, 50, 5, 2, 3, 8, 11
PART, FOLD = 400_000, 3_000_000
ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("d", pa.int64()), ("data", pa.binary())])
SPARK = "bucket int, kind int, d long, data binary"
TEXT, WINDOWS, PAIRS, BOXES, SIDES, MEMBERS, COVERED, HOPE, OPEN, PLACES, HELD, COUNT, AROUND, CLASS = range(14)
LINK = "doc_id long, start long, n_words long, other_id long, other_start long, other_words long, shared long, together long"
LINKS = pa.schema([(x.split()[0], pa.int64()) for x in LINK.split(", ")])


def compact_windows(tokens: np.ndarray, ends: np.ndarray, salt: np.uint64, least: int):
    """(m, first start, last start) of the compact windows of texts one after another, and the hashes.

    Starts are those of `least`-token subsequences whose leftmost minimum is m.
    """
    h = mixed(tokens ^ salt)
    none = np.zeros(0, np.int64)
    if len(tokens) < least:
        return none, none, none, h
    bits = np.uint64((1 << 23) - 1)
    v = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while 2 * have <= least:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < least:
        v = np.minimum(v[: len(v) - (least - have)], v[least - have :])
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(v) + 1, np.int32)
    long = ends - starts >= least
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - least + 1, -1)
    p = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(p):
        return none, none, none, h
    m = (v[p] & bits).astype(np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(m)) + 1, [len(m)]])
    return m[edge[:-1]], p[edge[:-1]], p[edge[1:] - 1], h


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)


def _find(batches, k: int, least: int, functions: int, buckets: int):
    """Documents -> WINDOWS by min-hash bucket."""
    working("passages")
    salts = mixed(np.arange(1, functions + 1, dtype=np.uint64) * M1 + np.uint64(SEED))
    own = np.arange(functions, dtype=np.uint64) * M2
    store: list[tuple] = []
    count = 0

    def flush():
        v, w, d, m, s, e, f = (np.concatenate(c) for c in zip(*store, strict=True))
        store.clear()
        return _rows([(b, WINDOWS, None, x) for b, x in by_bucket((v % np.uint64(buckets)).astype(np.int64), v, w, d, m, s, e, f)])

    def work(ids: list[int], tokens: list[np.ndarray]):
        nonlocal count
        raw, ends, names = np.concatenate(tokens), np.cumsum([len(t) for t in tokens]), np.array(ids, np.int64)
        begin = np.concatenate([[0], ends[:-1]])
        found = [compact_windows(raw, ends, s, least) for s in salts]
        for i, (m, s, e, h) in enumerate(found):
            if not len(m):
                continue
            # the second function's min-hash of the middle subsequence of the span
            m2, s2, _, h2 = found[(i + 1) % functions]
            at = np.searchsorted(s2, (s + e) >> 1, side="right") - 1
            of = np.searchsorted(ends, m, side="right")
            shift = begin[of]
            store.append((mixed(h[m] + own[i]), (h2[m2[at]] >> np.uint64(40)).astype(np.uint32), names[of], *((x - shift).astype(np.uint32) for x in (m, s, e)), np.full(len(m), i, np.uint8)))
            count += len(m)

    ids, tokens, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column("d").to_pylist(), batch.column("data"), strict=True):
            x = shingle_codes(t.as_py(), k)
            if len(x) < least:
                continue
            ids.append(d), tokens.append(x)
            size += len(x)
            if size >= PART:
                work(ids, tokens)
                ids, tokens, size = [], [], 0
            if count >= FOLD:
                yield flush()
                count = 0
    if ids:
        work(ids, tokens)
    if store:
        yield flush()


def _gathered(batches) -> dict[int, list[bytes]]:
    """Blobs by kind."""
    got: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for k, x in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            got[k].append(x.as_py())
    return got


def _pair(batches, buckets: int):
    """WINDOWS of a bucket -> PAIRS of occurrences (later document, earlier one), and MEMBERS: the occurrences of min-hashes
    of several documents, those after the first document marked, by document bucket."""
    trim()
    blobs = _gathered(batches)[WINDOWS]
    if not blobs:
        return
    v, w, d, m, s, e, f = joined(blobs)
    order = np.lexsort((m, d, w, v))
    v, w, d, m, s, e, f = (x[order] for x in (v, w, d, m, s, e, f))
    n = len(v)
    new_v = np.concatenate([[True], v[1:] != v[:-1]])
    new_w = new_v | np.concatenate([[True], w[1:] != w[:-1]])
    index = np.arange(n)
    first_w = np.maximum.accumulate(np.where(new_w, index, 0))  # smallest (d, m) of its (v, w)
    # smallest (d, m) of v: among the firsts of its (v, w)
    heads = np.flatnonzero(new_w)
    by_place = heads[np.lexsort((m[heads], d[heads], v[heads]))]
    start = np.concatenate([[True], v[by_place][1:] != v[by_place][:-1]])
    first_v = np.empty(n, np.int64)
    first_v[by_place] = by_place[np.maximum.accumulate(np.where(start, np.arange(len(by_place)), 0))]
    a = np.concatenate([index[~new_w], heads])
    b = np.concatenate([first_w[~new_w], first_v[heads]])
    good = d[a] != d[b]
    a, b = a[good], b[good]
    later = d != d[first_v[first_w]]  # than the first document of its min-hash
    several = np.repeat(np.add.reduceat(later.astype(np.int64), np.flatnonzero(new_v)) > 0, np.diff(np.append(np.flatnonzero(new_v), n)))
    rest = (x[several] for x in (d, v, s, e, later.astype(np.uint8)))
    yield _rows([(k, MEMBERS, None, x) for k, x in by_bucket(d[several] % buckets, *rest)])
    rows = mixed(d[a].astype(np.uint64) * M2 + d[b].astype(np.uint64)) % np.uint64(buckets)
    yield _rows([(k, PAIRS, None, x) for k, x in by_bucket(rows.astype(np.int64), d[a], d[b], m[a], s[a], e[a], m[b], f[a])])


def candidate_boxes(d, o, m, s, e, m2, f, least: int, enough: int):
    """Interval join per (document, other): (d, o, start, end, shift at start, shift at end) in tokens, where at least
    `enough` functions agree on the subsequences that start in a stretch of one diagonal (with DRIFT of play)."""
    order = np.lexsort((m, (m2.astype(np.int64) - m) // (4 * DRIFT), o, d))
    d, o, m, s, e, f = (x[order] for x in (d, o, m, s, e, f))
    shift = m2[order].astype(np.int64) - m
    out = []
    # chains along neighbouring diagonals: first by coarse diagonal, then joined where they touch
    key_new = np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])]) if len(d) else np.zeros(0, bool)
    for a, b in zip(np.flatnonzero(key_new), np.append(np.flatnonzero(key_new)[1:], len(d)), strict=True):
        if b - a < enough or len(set(f[a:b].tolist())) < enough:
            continue
        inner = np.lexsort((s[a:b], shift[a:b])) + a
        rows = inner.tolist()
        # diagonals less than DRIFT apart are one
        lanes, now = [], [rows[0]]
        for i in rows[1:]:
            if shift[i] - shift[now[-1]] <= DRIFT:
                now.append(i)
            else:
                lanes.append(now)
                now = [i]
        lanes.append(now)
        for lane in lanes:
            if len(lane) < enough or len({int(f[i]) for i in lane}) < enough:
                continue
            events = sorted([(int(s[i]), 1, i) for i in lane] + [(int(e[i]) + 1, -1, i) for i in lane], key=lambda x: (x[0], x[1]))
            active: dict[int, int] = defaultdict(int)
            open_, at_open, at_close = None, 0, 0
            for p, sign, i in events:
                g = int(f[i])
                active[g] += sign
                if not active[g]:
                    del active[g]
                if len(active) >= enough:
                    if open_ is None:
                        open_, at_open = p, int(shift[i])
                    at_close = int(shift[i])
                elif open_ is not None:
                    if out and out[-1][:2] == (int(d[a]), int(o[a])) and open_ <= out[-1][3] and abs(out[-1][5] - at_open) <= DRIFT:
                        out[-1] = (*out[-1][:3], p - 1 + least, out[-1][4], at_close)
                    else:
                        out.append((int(d[a]), int(o[a]), open_, p - 1 + least, at_open, at_close))
                    open_ = None
    return np.array(out, np.int64).reshape(-1, 6)


def _boxes(batches, least: int, enough: int, buckets: int):
    """PAIRS of a bucket -> BOXES, each to the buckets of both documents."""
    trim()
    blobs = _gathered(batches)[PAIRS]
    if not blobs:
        return
    d, o, m, s, e, m2, f = joined(blobs)
    box = candidate_boxes(d, o, m, s, e, m2, f, least, enough)
    if not len(box):
        return
    d, o, a, b, sa, sb = box.T
    name = mixed(mixed(d.astype(np.uint64) * M2 + o.astype(np.uint64)) * M1 + (a << 20 ^ b).astype(np.uint64) + (sa - sb).astype(np.uint64) * M2)
    rows = [(k, BOXES, None, x) for k, x in by_bucket(d % buckets, d, name, a, b, np.zeros(len(d), np.int64), d, o, sa, sb)]
    rows += [(k, BOXES, None, x) for k, x in by_bucket(o % buckets, o, name, np.maximum(0, a + sa), b + sb, np.ones(len(d), np.int64), d, o, sa, sb)]
    yield _rows(rows)


def _sides(batches, k: int, buckets: int):
    """TEXT and BOXES of a document bucket -> SIDES: the boxes' tokens, by box bucket."""
    working("passages")
    texts, blobs = {}, []
    for batch in batches:
        for kind, d, x in zip(batch.column("kind").to_pylist(), batch.column("d").to_pylist(), batch.column("data"), strict=True):
            if kind == TEXT:
                texts[d] = x
            else:
                blobs.append(x.as_py())
    if not blobs:
        return
    own, name, a, b, side, d, o, sa, sb = joined(blobs)
    order = np.argsort(own, kind="stable")
    last, tokens, store, size = None, None, [], 0

    def flush():
        *columns, parts = zip(*store, strict=True)
        columns = [np.array(x, np.uint64 if k == 0 else np.int64) for k, x in enumerate(columns)]
        out = _rows([(b, SIDES, None, x) for b, x in ragged((columns[0] % np.uint64(buckets)).astype(np.int64), columns, list(parts))])
        store.clear()
        return out

    for i in order:
        if own[i] != last:
            last = own[i]
            tokens = shingle_codes(texts[int(last)].as_py(), k)
        x = tokens[a[i] : b[i]]
        store.append((name[i], side[i], d[i], o[i], a[i], sa[i], sb[i], x))
        size += len(x)
        if size > 1_000_000:
            yield flush()
            size = 0
    if store:
        yield flush()


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values: as np.unique, which takes several times as long for the few tokens of a stretch."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def all_distinct(x: np.ndarray) -> bool:
    x = np.sort(x)
    return not (x[1:] == x[:-1]).any()


def similar_starts(x: np.ndarray, y: np.ndarray, shift: int, least: int, percent: int) -> np.ndarray:
    """The starts a at which the stretches of x at a and of y at a + shift, `least` tokens each, are similar."""
    first, count = max(0, -shift), min(len(x), len(y) - shift) - least + 1
    if count <= first:
        return np.zeros(0, np.int64)
    order = np.argsort(y)
    known = y[order]
    if all_distinct(x) and (known[1:] != known[:-1]).all():
        # a token's places i and j are both in the stretches from max(i, j - shift) - least + 1 to min(i, j - shift)
        at = np.minimum(np.searchsorted(known, x), len(y) - 1)
        i = np.flatnonzero(known[at] == x)
        j = order[at[i]] - shift
        low, high = np.maximum(np.maximum(i, j) - least + 1, 0), np.minimum(np.minimum(i, j), count - 1)
        good = low <= high
        both = np.cumsum(np.bincount(low[good], minlength=count + 1) - np.bincount(high[good] + 1, minlength=count + 1))[first:count]
        return first + np.flatnonzero(100 * both >= percent * (2 * least - both))
    starts = np.arange(first, count)
    u, w = distinct_counts(x, starts, least), distinct_counts(y, starts + shift, least)
    good = np.zeros(len(starts), bool)
    for i, a in enumerate(starts.tolist()):
        both = overlap(np.unique(x[a : a + least]), np.unique(y[a + shift : a + shift + least]))
        good[i] = 100 * both >= percent * (u[i] + w[i] - both)
    return starts[good]


def similar_runs(x: np.ndarray, y: np.ndarray, starts: np.ndarray, shift: int, least: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, other start, other end, shared, together) of the runs of starts, each of which is similar, cut where a run is
    not so as one."""
    out: list[tuple] = []

    def add(first: int, last: int) -> None:
        u, v = distinct(x[first : last + least]), distinct(y[first + shift : last + shift + least])
        both = overlap(u, v)
        every = len(u) + len(v) - both
        if every and 100 * both >= percent * every:
            out.append((first, last + least, first + shift, last + shift + least, both, every))
        elif first < last:  # similar at each start, but not as one
            add(first, (first + last) // 2), add((first + last) // 2 + 1, last)

    if len(starts):
        edge = np.flatnonzero(starts[1:] - starts[:-1] > 1)
        for first, last in zip([int(starts[0]), *starts[edge + 1].tolist()], [*starts[edge].tolist(), int(starts[-1])], strict=True):
            add(first, last)
    return out


def verified(x: np.ndarray, y: np.ndarray, shifts: list[int], least: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, other start, other end, shared, together) of the similar passages of two token sequences: the whole
    where it is similar, else runs of similar stretches along the diagonals y = x + shift."""

    u, v = np.unique(x), np.unique(y)
    both = overlap(u, v)
    if (every := len(u) + len(v) - both) and 100 * both >= percent * every:
        return [(0, len(x), 0, len(y), both, every)]
    out: list[tuple] = []
    if len(u) == len(x) and 100 * both < percent * least:  # each stretch of x has `least` tokens, of which too few are in y
        return out

    for shift in dict.fromkeys(shifts):
        out += similar_runs(x, y, similar_starts(x, y, shift, least, percent), shift, least, percent)
    return out


def _verify(batches, k: int, least: int, percent: int):
    """SIDES of a bucket -> links, and where not all of a box is linked, the box with nothing shared: what was compared."""
    trim()
    blobs = _gathered(batches)[SIDES]
    if not blobs:
        return
    (name, side, d, o, at, sa, sb), edge, flat = joined_ragged(blobs)
    order = np.lexsort((side, name))
    rows = []
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        if side[a] or name[b] != name[a]:
            continue
        x, y = flat[edge[a] : edge[a + 1]], flat[edge[b] : edge[b + 1]]
        found = verified(x, y, [int(z + at[a] - at[b]) for z in (sa[a], sb[a])], least, percent)
        if [z[:2] for z in found] != [(0, len(x))]:
            rows.append((d[a], at[a], len(x) + k - 1, o[a], at[b], len(y) + k - 1, 0, 0))
        for s, t, u, v, both, every in found:
            rows.append((d[a], at[a] + s, t - s + k - 1, o[a], at[b] + u, v - u + k - 1, both, every))
    columns = np.array(rows, np.int64).reshape(-1, 8).T
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=LINKS)


def _covers(batches, k: int, buckets: int):
    """Links and compared boxes -> COVERED by document bucket."""
    for batch in batches:
        d, a, n, o, both = (batch.column(c).to_numpy() for c in ("doc_id", "start", "n_words", "other_id", "shared"))
        if len(d):
            yield _rows([(b, COVERED, None, x) for b, x in by_bucket(d % buckets, d, a, a + n - k + 1, o, (both > 0).astype(np.uint8))])


def _classes(batches, buckets: int):
    """(node, component) -> CLASS by document bucket."""
    for batch in batches:
        d, c = (batch.column(x).to_numpy() for x in ("node", "component"))
        if len(d):
            yield _rows([(b, CLASS, None, x) for b, x in by_bucket(d % buckets, d, c)])


def class_of(docs: np.ndarray, blobs: list[bytes]) -> np.ndarray:
    """The class of each document, by CLASS blobs: itself where it has none."""
    out = docs.astype(np.int64)
    if blobs:
        d, c = joined(blobs)
        order = np.argsort(d, kind="stable")
        d, c = d[order], c[order]
        at = np.minimum(np.searchsorted(d, docs), len(d) - 1)
        out = np.where(d[at] == docs, c[at], out)
    return out


def shared_least(u, w, percent: int):
    """The least intersection of similar sets of sizes u and w."""
    return -(-percent * (u + w) // (100 + percent))


def _open(batches, least: int, enough: int, percent: int, buckets: int):
    """MEMBERS, COVERED and CLASS of a document bucket -> HOPE: the open starts, each with a document it was compared with (-1:
    none), and OPEN by min-hash bucket: all members with their class, those marked that hold an open start.

    A start is open where `enough` functions have a later occurrence and its stretch is not, but for as many tokens as
    similar sets may differ in, inside a verified link.
    """
    trim()
    got = _gathered(batches)
    if not got[MEMBERS]:
        return
    d, v, s, e, later = joined(got[MEMBERS])
    order = np.argsort(d, kind="stable")
    d, v, s, e, later = (c[order] for c in (d, v, s, e, later))
    s, e = s.astype(np.int64), e.astype(np.int64)
    docs, first = np.unique(d, return_index=True)
    tops = np.maximum.reduceat(e, first) + 2  # a free place closes each document's starts
    base = np.cumsum(tops) - tops
    shift = np.repeat(base, np.diff(np.append(first, len(d))))
    total = int(tops.sum())

    def depth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(a, minlength=total + 1) - np.bincount(b + 1, minlength=total + 1))[:total]

    hope = depth((s + shift)[later > 0], (e + shift)[later > 0]) >= enough
    partner = np.full(total, -1, np.int64)
    if got[COVERED]:
        c, a, b, other, linked = joined(got[COVERED])
        slack = np.where(linked > 0, least - shared_least(least, least, percent), 0)
        at = np.searchsorted(docs, c)
        known = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == c)
        at, a, b, other, linked = at[known], np.maximum(0, a - slack)[known], (b - least + slack)[known], other[known], linked[known] > 0
        b = np.minimum(b, tops[at] - 2)
        low, high = base[at] + a, base[at] + b
        good = linked & (a <= b)
        hope &= depth(low[good], high[good]) == 0
        for x, y, o in zip(low[~linked].tolist(), high[~linked].tolist(), other[~linked].tolist(), strict=True):
            partner[x : y + 1] = o
    key = np.where(hope, partner, -2)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(edge[1:], total) - 1
    low, high = edge[hope[edge]], last[hope[edge]]
    of = np.searchsorted(base, low, side="right") - 1
    yield _rows([(k, HOPE, None, x) for k, x in by_bucket(docs[of] % buckets, docs[of], low - base[of], high - base[of], partner[low])])
    seen = np.concatenate([[0], np.cumsum(hope)])
    marked = ((seen[e + shift + 1] > seen[s + shift]) & (later > 0)).astype(np.uint8)
    yield _rows([(k, OPEN, None, x) for k, x in by_bucket((v % np.uint64(buckets)).astype(np.int64), v, d, s.astype(np.uint32), e.astype(np.uint32), marked, np.repeat(class_of(docs, got[CLASS]), np.diff(np.append(first, len(d)))))])


def _places(batches, buckets: int):
    """OPEN of a bucket -> PLACES by document bucket: the occurrences of min-hashes with a marked one (1), with several classes
    (2) or both (3)."""
    trim()
    blobs = _gathered(batches)[OPEN]
    if not blobs:
        return
    v, d, s, e, marked, c = joined(blobs)
    order = np.argsort(v, kind="stable")
    v, d, s, e, marked, c = (x[order] for x in (v, d, s, e, marked, c))
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    several = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    kind = np.repeat((np.maximum.reduceat(marked, first) > 0) + 2 * several, np.diff(np.append(first, len(v)))).astype(np.uint8)
    keep = kind > 0
    yield _rows([(k, PLACES, None, x) for k, x in by_bucket(d[keep] % buckets, d[keep], s[keep], e[keep], kind[keep])])


def _mask(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Over 0..n-1: how many ranges low..high hold each."""
    return np.cumsum(np.bincount(low, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(high + 1, n), minlength=n + 1)[: n + 1])[:n]


def last_places(tokens: np.ndarray) -> np.ndarray:
    """Of each place, the last earlier one of the same token; -1 for none."""
    before = np.full(len(tokens), -1, np.int64)
    if all_distinct(tokens):  # which is known sooner than their stable order
        return before
    order = np.argsort(tokens, kind="stable")
    same = tokens[order][1:] == tokens[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    return before


def distinct_counts(tokens: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Distinct tokens of the stretches at the starts."""
    before = last_places(tokens)
    if not (before >= 0).any():
        return np.full(len(starts), least, np.int64)
    # a place counts in the stretches that hold it and start behind the last earlier one of its token
    at = np.arange(len(tokens))
    low = np.maximum(before, at - least) + 1
    return np.cumsum(np.bincount(np.maximum(low, 0), minlength=len(tokens) + 1) - np.bincount(at + 1, minlength=len(tokens) + 1))[starts]


def like_the_one_before(tokens: np.ndarray, least: int) -> np.ndarray:
    """Of each start, whether its stretch has the same set of tokens as that of the start before it."""
    n = len(tokens) - least + 1
    out, before = np.zeros(n, bool), last_places(tokens)
    if (before >= 0).any():
        after = len(tokens) - 1 - last_places(tokens[::-1])[::-1]  # the next place; len(tokens) for none
        out[1:] = (after[: n - 1] < np.arange(1, n) + least) & (before[least:] >= np.arange(n - 1))
    return out


def _over(x: np.ndarray, least: int, fold, none: int) -> np.ndarray:
    """At each place the fold of x over the starts whose stretches reach it."""
    x, have = np.concatenate([np.full(least - 1, none, x.dtype), x]), 1
    while 2 * have <= least:
        x, have = fold(x[:-have], x[have:]), 2 * have
    return fold(x[: len(x) - (least - have)], x[least - have :]) if have < least else x


def _by_document(blobs: list[bytes]) -> dict[int, list[np.ndarray]]:
    """Columns of each document (the first column), rows in the order in which they came."""
    if not blobs:
        return {}
    columns = joined(blobs)
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(columns[0])) + 1, [len(order)]])
    return {int(columns[0][a]): [c[a:b] for c in columns[1:]] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)}


def _tokens(batches, k: int, least: int, enough: int, buckets: int, few: int):
    """TEXT, HOPE and PLACES of a document bucket -> HELD: the tokens of the stretches in question, and COUNT by token bucket.

    Stretches that start where `enough` functions have a place by a marked min-hash, or by one of several classes, are in
    question. A token of HELD has the number of distinct
    tokens of the stretch that starts there (0: none is in question), whether that start is open (2) or may lead to another class (1), and how many next starts
    have the same set and are left out for it; one of COUNT has
    (by 32 bits of its hash, which at worst counts two tokens as one) the least such number of the stretches over it, whether an open one is among them, and the document with which all
    those were compared (-1: none or several).
    """
    working("passages")
    texts, blobs = {}, defaultdict(list)
    for batch in batches:
        for kind, d, x in zip(batch.column("kind").to_pylist(), batch.column("d").to_pylist(), batch.column("data"), strict=True):
            if kind == TEXT:
                texts[d] = x
            else:
                blobs[kind].append(x.as_py())
    hope = _by_document(blobs[HOPE])
    held, counts, size = [], [], 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        rows = [(b, HELD, None, x) for b, x in by_bucket(columns[0] % buckets, *columns)]
        h, d, w, o, other = (np.concatenate(c) for c in zip(*counts, strict=True))
        rows += [(b, COUNT, None, x) for b, x in by_bucket((h % np.uint32(few)).astype(np.int64), h, d, w, o, other)]
        held.clear(), counts.clear()
        return _rows(rows)

    for d, (s, e, kind) in _by_document(blobs[PLACES]).items():
        n = int(e.max()) + 1
        open_, leads = (_mask(n, s[kind & bit > 0].astype(np.int64), e[kind & bit > 0].astype(np.int64)) >= enough for bit in (1, 2))
        starts = np.flatnonzero(open_ | leads)
        if not len(starts):
            continue
        tokens = shingle_codes(texts[d].as_py(), k)
        u, o = np.zeros(len(tokens), np.uint32), np.zeros(len(tokens), np.uint8)
        u[starts] = distinct_counts(tokens, starts, least)
        partner, more = np.full(len(tokens), -1, np.int64), np.zeros(len(tokens), np.uint32)
        for low, high, other in zip(*(c.tolist() for c in hope.get(d, ())), strict=True):
            o[low : high + 1], partner[low : high + 1] = 2 * (u[low : high + 1] > 0), other
        partner[:n][leads] = -1
        o[:n][leads & (o[:n] == 0)] = 1
        like = like_the_one_before(tokens, least)
        if like.any():  # of neighbouring starts with the same set, the first stands for all
            n = len(like)
            like[1:] &= (u[1:n] > 0) & (u[: n - 1] > 0) & (o[1:n] == o[: n - 1]) & (partner[1:n] == partner[: n - 1])
            heads = np.maximum.accumulate(np.where(like, 0, np.arange(n)))
            more[:n] = np.where(like, 0, np.bincount(heads, minlength=n) - 1)
            u[:n][like], o[:n][like] = 0, 0
            starts = np.flatnonzero(u)
        q = np.flatnonzero(_mask(len(tokens), starts, starts + least - 1))
        w, any_open = _over(np.where(u > 0, u, least).astype(np.uint32), least, np.minimum, least)[q], _over(o, least, np.maximum, 0)[q]
        most = np.iinfo(np.int64).max
        low, high = _over(np.where(o > 0, partner, most), least, np.minimum, most)[q], _over(np.where(o > 0, partner, -1), least, np.maximum, -1)[q]
        names = np.full(len(q), d, np.int64)
        held.append((names, q.astype(np.uint32), tokens[q], u[q], o[q], more[q]))
        order = np.lexsort((w, tokens[q]))
        h = tokens[q][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
        counts.append(((h[first] >> np.uint64(32)).astype(np.uint32), names[: len(first)], w[order][first], np.maximum.reduceat(any_open[order], first), np.where(low == high, low, -1)))
        size += len(q)
        if size > 1_000_000:
            yield flush()
            size = 0
    if held:
        yield flush()


def _frequencies(batches, buckets: int):
    """COUNT of a token bucket -> COUNT by document bucket: (document, token, documents that have it, least number of
    distinct tokens of a stretch with it) of tokens of several documents; that number is 0 unless an open stretch of the
    document shares the token with an earlier one, or any stretch with an open one of a later document, where the two
    were not compared before."""
    trim()
    blobs = _gathered(batches)[COUNT]
    if not blobs:
        return
    h, d, w, o, partner = joined(blobs)
    order = np.lexsort((d, h))
    h, d, w, o, partner = (c[order] for c in (h, d, w, o, partner))
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    n = np.diff(np.append(first, len(h)))
    each, index = (lambda x: x[group]), np.arange(len(h))
    open_ = o > 0
    # where an open one's partner stands in its group
    names, name = np.unique(d, return_inverse=True)
    at = np.minimum(np.searchsorted(names, partner), len(names) - 1)
    known = open_ & (names[at] == partner)
    key = group * len(names) + name
    to = np.minimum(np.searchsorted(key, group * len(names) + at), len(key) - 1)
    known &= (key[to] == group * len(names) + at) & (to < index)
    total = np.cumsum(open_)
    later = each(total[first + n - 1]) - total - np.bincount(to[known], minlength=len(h))
    need = (open_ & (index - each(first) > known)) | (later > 0)
    least = np.where(need, each(np.minimum.reduceat(w, first)), 0).astype(np.uint32)
    keep = each(n) > 1
    yield _rows([(k, COUNT, None, x) for k, x in by_bucket(d[keep] % buckets, d[keep], h[keep], each(n)[keep].astype(np.uint32), least[keep])])


def prefix_places(rank: np.ndarray, use: np.ndarray, w: np.ndarray, starts: np.ndarray, u: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, token position) of the tokens by which the stretches at the starts are found: those to use that stand, by
    rank, so early among the stretch's u distinct tokens that a similar set of w tokens or more can share what follows."""
    windows, rank = np.lib.stride_tricks.sliding_window_view, rank.astype(np.int32)
    most = least - shared_least(least, -(-least * percent // 100), percent) + 1
    # stretches with a token to use that comes early enough: not after `most` others
    first = np.sort(rank[use])[0] if use.any() else 0
    used, before = (np.concatenate([[0], np.cumsum(x)]) for x in (use, rank < first))
    good = (used[starts + least] > used[starts]) & (before[starts + least] - before[starts] < most)
    starts, u = starts[good], u[good]
    out_p, out_q = [], []
    for a in range(0, len(starts), 20_000):
        p, size = starts[a : a + 20_000], u[a : a + 20_000]
        plain = size == least
        if plain.any():
            x = windows(rank, least)[p[plain]]
            at = np.argpartition(x, most, axis=1)[:, : most + 1]
            at = np.take_along_axis(at, np.argsort(np.take_along_axis(x, at, 1), axis=1), 1)
            q = p[plain][:, None] + at
            place = np.arange(q.shape[1])[None, :]
            need = shared_least(least, np.maximum(w[q], -(-least * percent // 100)), percent)
            hit = use[q] & (least - place >= need)
            out_p.append(np.broadcast_to(p[plain][:, None], q.shape)[hit]), out_q.append(q[hit])
        for start, n in zip(p[~plain].tolist(), size[~plain].tolist(), strict=True):
            _, at = np.unique(rank[start : start + least], return_index=True)
            need = shared_least(n, np.maximum(w[start + at], -(-n * percent // 100)), percent)
            hit = use[start + at] & (n - np.arange(len(at)) >= need)
            out_q.append(start + at[hit]), out_p.append(np.full(int(hit.sum()), start))
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_p), np.concatenate(out_q)) if out_p else (none, none)


def _around(batches, least: int, percent: int, buckets: int):
    """HELD, COUNT and CLASS of a document bucket -> AROUND by token bucket: for each token by which stretches are found, the
    tokens of those stretches, with the first and last of them that is open or may lead to another class (1, 0: none), the starts
    left out after the last, whether one is open, and the document's class."""
    trim()
    got = _gathered(batches)
    count = _by_document(got[COUNT])
    store, size = [], 0

    def flush():
        *columns, parts = zip(*store, strict=True)
        columns = [np.concatenate(c) for c in columns]
        out = _rows([(b, AROUND, None, x) for b, x in ragged((columns[0] % np.uint64(buckets)).astype(np.int64), columns, [x for r in parts for x in r])])
        store.clear()
        return out

    for d, (place, h, u, o, more) in _by_document(got[HELD]).items():
        if d not in count:
            continue
        order = np.argsort(place, kind="stable")
        place, h, u, o, more = place[order].astype(np.int64), h[order], u[order].astype(np.int64), o[order], more[order]
        known, n, w = (c[np.argsort(count[d][0], kind="stable")] for c in count[d])
        short = (h >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        hit = known[at] == short
        n, w = np.where(hit, n[at], 1).astype(np.int64), np.where(hit, w[at], 0).astype(np.int64)
        if not w.any():
            continue
        order = np.lexsort((h, n))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], h[order][1:] != h[order][:-1]]))
        starts = np.flatnonzero(u)
        p, q = prefix_places(rank, w > 0, w, starts, u[starts], least, percent)
        if not len(q):
            continue
        order = np.lexsort((p, q))
        p, q = p[order], q[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        s, e = np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)
        bare = np.maximum.reduceat(o[p], first) > 1
        low = np.minimum.reduceat(np.where(o[p] > 0, p, len(h)), first)
        high = np.maximum.reduceat(np.where(o[p] > 0, p, -1), first)
        none = high < 0
        q = q[first]
        low, high = np.where(none, 1, place[np.minimum(low, len(h) - 1)]), np.where(none, 0, place[high])
        store.append((h[q], np.full(len(q), d, np.int64), *(x.astype(np.uint32) for x in (place[q], place[s], low, high, more[e])), bare.astype(np.uint8), np.full(len(q), class_of(np.array([d]), got[CLASS])[0]), [h[a : b + least] for a, b in zip(s.tolist(), e.tolist(), strict=True)]))
        size += int((e - s + least).sum())
        if size > 500_000:
            yield flush()
            size = 0
    if store:
        yield flush()


def prefix_ranks(ranks: np.ndarray, least: int, percent: int, lowest: int = 0) -> np.ndarray:
    """The ranks (rare first), from the lowest on, of which two similar stretches of `least` tokens must share one, over all stretches."""
    if not len(ranks) or ranks.max() < lowest:
        return ranks[:0]
    count = len(ranks) - least + 1
    if all_distinct(ranks):
        n = least - -(-least * percent // 100) + 1
        stretches = ranks[np.arange(count)[:, None] + np.arange(least)] if count > 1 else ranks[None, :]
        out = np.partition(stretches, n - 1, axis=1)[:, :n].ravel()
        return distinct(out[out >= lowest])
    out = []
    for a in range(count):
        x = distinct(ranks[a : a + least])
        out.append(x[: len(x) - -(-len(x) * percent // 100) + 1])
    out = np.concatenate(out)
    return distinct(out[out >= lowest])


def _repair(batches, k: int, least: int, percent: int):
    """AROUND of a bucket -> links of occurrences with earlier ones that have similar stretches: in order, until no open start is
    without one, and beyond that with each whose class is another."""
    trim()
    blobs = _gathered(batches)[AROUND]
    if not blobs:
        return
    columns, edge, flat = joined_ragged(blobs)
    order = np.lexsort((columns[2], columns[1], columns[0]))
    v, d, m, s, low, high, more, bare, of = (c[order] for c in columns)
    d, m, s, low, high, more = (c.astype(np.int64) for c in (d, m, s, low, high, more))
    of, up = of.tolist(), {}  # classes that links of this bucket join

    def top(c: int) -> int:
        while c in up:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    first_of_group = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    rows = []
    for g, h in zip(first_of_group.tolist(), [*first_of_group[1:].tolist(), len(v)], strict=True):
        if d[g] == d[h - 1] or not (low[g:h] <= high[g:h]).any():
            continue
        tokens = [flat[edge[i] : edge[i + 1]] for i in order[g:h].tolist()]
        _, at, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        ranks, single = np.split(rank[at], np.cumsum([len(x) for x in tokens])[:-1]), int((count == 1).sum())
        earlier: dict[int, list[int]] = defaultdict(list)
        same: dict[bytes, int] = {}  # the first occurrence of each content stands for it
        prefixes: dict[int, list[int]] = {}  # of the first occurrences
        for i in range(g, h):
            mine = ranks[i - g]
            content = mine.tobytes() + int(m[i] - s[i]).to_bytes(4, "little")
            first = same.setdefault(content, i)
            if first == i:
                prefixes[i] = prefix_ranks(mine, least, percent, single).tolist()
            prefix = prefixes[first]
            if low[i] <= high[i]:
                x, a, b = tokens[i - g], int(low[i] - s[i]), int(high[i] - s[i])
                left = np.zeros(max(len(x) - least + 1, b + 1), bool)
                left[a : b + 1] = bare[i] > 0
                for j in sorted({j for r in prefix for j in earlier[r]}):
                    if d[j] == d[i]:
                        continue
                    other = top(of[i]) != top(of[j])
                    if not other and not left.any():
                        continue
                    y, shift = tokens[j - g], int(m[j] - s[j] - m[i] + s[i])
                    starts = similar_starts(x, y, shift, least, percent)
                    starts = starts[(starts >= a) & (starts <= b)]
                    if not len(starts) or not (other or left[starts].any()):
                        continue
                    for p, q, c, e, both, every in similar_runs(x, y, starts, shift, least, percent):
                        rest = more[i] if q == len(x) else 0  # words that add nothing to the set
                        rows.append((d[i], s[i] + p, q - p + k - 1 + rest, d[j], s[j] + c, e - c + k - 1, both, every))
                    left[starts] = False
                    if other:
                        up[max(top(of[i]), top(of[j]))] = min(top(of[i]), top(of[j]))
            if first == i:
                for r in prefix:
                    earlier[r].append(i)
    columns = np.array(rows, np.int64).reshape(-1, 8).T
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=LINKS)


def _links(rows: DataFrame, k: int, percent: int, least: int, functions: int, enough: int, most: int) -> DataFrame:
    """Links of rows (d long, data): ids unique, nothing null."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    few = max(1, buckets // 2)  # for the small part of the tokens that open stretches hold
    deal = lambda df: df.repartition(buckets, "bucket")
    windows = deal(rows.mapInArrow(lambda it: _find(it, k, least, functions, buckets), SPARK))
    paired = written(windows.mapInArrow(lambda it: _pair(it, buckets), SPARK), "paired")
    release(windows)
    pairs, members = deal(paired.filter(f"kind = {PAIRS}")), paired.filter(f"kind = {MEMBERS}")
    boxes = pairs.mapInArrow(lambda it: _boxes(it, least, enough, buckets), SPARK)
    texts = rows.selectExpr(f"cast(pmod(d, {buckets}) as int) bucket", f"{TEXT} kind", "d", "cast(data as binary) data")
    sides = deal(deal(texts.union(boxes)).mapInArrow(lambda it: _sides(it, k, buckets), SPARK))
    compared = written(sides.mapInArrow(lambda it: _verify(it, k, least, percent), LINK).distinct(), "compared")
    release(sides)
    links = compared.filter("shared > 0")
    # what the first partners did not settle
    found = components(links.select(F.col("doc_id").alias("u"), F.col("other_id").alias("v")))
    classes = written(found.mapInArrow(lambda it: _classes(it, buckets), SPARK), "classes")
    covers = compared.mapInArrow(lambda it: _covers(it, k, buckets), SPARK)
    open_ = written(deal(members.union(covers).union(classes)).mapInArrow(lambda it: _open(it, least, most, percent, buckets), SPARK), "open")
    release(paired)
    places = deal(open_.filter(f"kind = {OPEN}")).mapInArrow(lambda it: _places(it, buckets), SPARK)
    asked = texts.union(open_.filter(f"kind = {HOPE}")).union(places)
    held = written(deal(asked).mapInArrow(lambda it: _tokens(it, k, least, most, buckets, few), SPARK), "held")
    release(open_)
    counts = deal(held.filter(f"kind = {COUNT}")).mapInArrow(lambda it: _frequencies(it, buckets), SPARK)
    around = deal(held.filter(f"kind = {HELD}").union(counts).union(classes)).mapInArrow(lambda it: _around(it, least, percent, few), SPARK)
    more = deal(around).mapInArrow(lambda it: _repair(it, k, least, percent), LINK)
    out = written(links.union(more).distinct(), "links")
    release(held, compared, classes)
    return out


def passage_links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, least_words: int = LEAST_WORDS, functions: int = FUNCTIONS, enough: int = ENOUGH, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The links, each with the class of its documents: class_id, the smallest id that links reach; see the module."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("data"))
    named = numbered(rows, "d", "passage_rows", ["doc_id", "data"])
    rows = rows.select(F.col("doc_id").cast("long").alias("d"), "data") if named is None else named.select("d", "data")
    links = _links(rows, k, percent, least_words - k + 1, functions, enough, most)
    classes = components(links.select(F.col("doc_id").alias("u"), F.col("other_id").alias("v")))
    out = links.join(classes.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")), "doc_id")
    if named is None:
        return out.select(*(F.col(c).cast(kind) if c.endswith("_id") else F.col(c) for c in out.columns))
    names = named.select("d", F.col("doc_id").alias("name"))
    for c in ("doc_id", "other_id", "class_id"):
        out = out.join(names.withColumnRenamed("d", c), c).drop(c).withColumnRenamed("name", c)
    return out.filter("doc_id <> other_id").select(*LINKS.names, "class_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the links of all documents: passages of 50 words or more, five-word shingles, similarity 0.8."""
    return passage_links(table(spark, sf_dir, "documents"))
