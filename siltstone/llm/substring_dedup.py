"""Exact removal of repeated byte strings by longest-previous-factor (LPF) arrays.

A byte goes if a string of `length` bytes over it also starts earlier in the corpus. That is: some window start p over
it has LPF[p] >= length. A suffix array of everything cannot be held, and need not be: suffixes are compared only with
those that can share `length` bytes with them, each such set in one bucket, with its own suffix order, LCP and LPF array.

1. Anchors: each window of `length` bytes has an anchor, its leftmost 32-byte string of least hash. Equal windows have
   equal anchors at equal places. A text has an anchor every 35 bytes or so. Tasks fold anchors with equal surroundings
   (all bytes that its windows can reach) before anything moves, then send hashes and positions, in buckets of the anchor's hash.
2. Of anchors with equal hash and surroundings all but the earliest are settled: each window around them is one around
   the earliest, so its LPF is at least `length`. Both hashes together have 128 bits: over 10^13 anchors (some 300 TB) two
   different ones agree with a chance below 10^-12. Anchors whose hash has several surroundings are contested, the earliest of each is kept.
3. The surroundings of contested anchors go to their bucket. There the windows of one alignment are brought into suffix
   order, their LCP array is counted on the bytes, and LPF follows from the previous and the next smaller position.
4. Documents cut the union of the windows with LPF >= length.

A hash with more than `wide` different surroundings is not compared in one task: its windows are dealt by their own
128-bit hash instead, again folded before they move, and settled there; the result is the same.

Position order is document id, then start. Defined cases: null text is empty; null ids come last and repeated ids are ordered
by text (equal rows: either first); texts shorter than `length` stay whole; very long texts are worked through in parts without a loss at their
borders; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.blobs import by_bucket, joined, pack
from siltstone.llm.common import numbered, release, table, written
from siltstone.llm.shingles import M1, M2, mixed

LENGTH, GRAM, WIDE = 100, 32, 50_000
#: Texts of about this many bytes are worked on at once; anchors of about FOLD positions are folded at once.
PART, FOLD = 1 << 20, 1_500_000
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * M1)
PLACE = (1 << 22) - 1  # low bits of a rank that hold the position in a part
DATA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("d", pa.int64()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
SPARK = "bucket int, kind int, d long, data binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXT, ANCHORS, SETTLED, CONTESTED, AROUND, HELD, DONE, SPANS, WINDOWS = range(9)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position, by doubling."""
    h = BYTE[raw]
    for k in (1, 2, 4, 8, 16):
        h = h[:-k] * (M2 + np.uint64(2 * k)) + h[k:]
        h ^= h >> np.uint64(29)
    return h * M1


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """For texts one after another (ends: where each ends): anchor positions, first and last window start of each, and the gram hashes.

    Texts shorter than `length` have none.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(raw)
    v = (mixed(h) & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
    starts = np.concatenate([[0], ends[:-1]])
    good = np.zeros(len(v) + 1, np.int8)
    long = ends - starts >= length
    np.add.at(good, starts[long], 1)
    np.add.at(good, ends[long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(good[:-1]))
    if not len(p):
        return none, none, none, h
    q = (v[p] & np.uint64(PLACE)).astype(np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1, [len(q)]])
    return q[edge[:-1]], p[edge[:-1]], p[edge[1:] - 1], h


def _around(h: np.ndarray, q: np.ndarray, start: np.ndarray, end: np.ndarray, length: int):
    """Bytes before and after each anchor that its windows can reach, and their hash."""
    left, right = np.minimum(length - GRAM, q - start), np.minimum(length, end - q)
    size, c = left + right, (left * 256 + right).astype(np.uint64)
    for i in range(-(-(2 * length - GRAM) // GRAM)):
        c = mixed(c * M2 + h[q - left + np.minimum(GRAM * i, size - GRAM)])
    return left, right, c


def owned_parts(ids: list[int], texts: list[bytes], length: int):
    """(raw, ends, ids, offset of each text in its document, first and end of the positions it owns) of about PART bytes.

    Long texts come in overlapping parts. Each position of a text is owned by one part, and the surroundings of the
    anchors there lie wholly inside that part or stop at the text's real ends.
    """
    held: list[bytes] = []
    places: list[tuple[int, int, int, int]] = []
    size = 0

    def flush():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), *(np.array(c, np.int64) for c in zip(*places, strict=True))

    for d, t in zip(ids, texts, strict=True):
        # the reach of an anchor's surroundings on both sides stays inside a part
        step = PART - 4 * length
        for a in range(0, max(1, len(t) - 2 * length), step) if len(t) > PART else (0,):
            start, end = (max(0, a - 2 * length), min(len(t), a + step + 2 * length)) if len(t) > PART else (0, len(t))
            held.append(t[start:end]), places.append((d, start, a, a + step if end < len(t) else len(t)))
            size += end - start
            if size >= PART:
                yield flush()
                held, places, size = [], [], 0
    if held:
        yield flush()


def parts(ids: list[int], texts: list[bytes], length: int):
    """(raw, ends, ids, offset of each text in its document) of owned_parts."""
    for raw, ends, names, offsets, _, _ in owned_parts(ids, texts, length):
        yield raw, ends, names, offsets


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    short = [pa.array(c, f.type) for c, f in zip(columns, DATA, strict=False)]
    return pa.RecordBatch.from_arrays([*short, *(pa.nulls(len(rows), f.type) for f in list(DATA)[4:])], schema=DATA)


def _first_of(order_by_position: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices sorted by keys then position, and whether each is the first of its keys."""
    order = order_by_position[np.lexsort([k[order_by_position] for k in reversed(keys)])]
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, first


def _find(batches, length: int, buckets: int):
    """Documents -> ANCHORS by hash bucket, SETTLED by document bucket."""
    store: list[tuple] = []
    count = 0

    def fold():
        d, q, h, c = (np.concatenate(x) for x in zip(*store, strict=True))
        order, first = _first_of(np.lexsort((q, d)), h, c)
        rows = []
        keep = np.sort(order[first])
        for b, blob in by_bucket((h[keep] % np.uint64(buckets)).astype(np.int64), d[keep], q[keep], h[keep], c[keep]):
            rows.append((b, ANCHORS, None, blob))
        gone = np.sort(order[~first])
        for b, blob in by_bucket(d[gone] % buckets, d[gone], q[gone]):
            rows.append((b, SETTLED, None, blob))
        store.clear()
        return _rows(rows)

    for batch in batches:
        for raw, ends, ids, offsets, low, high in owned_parts(batch.column("d").to_pylist(), batch.column("data").to_pylist(), length):
            q, _, _, h = anchors(raw, ends, length)
            of = np.searchsorted(ends, q, side="right")
            start = np.concatenate([[0], ends[:-1]])[of]
            # an anchor near a part's border is in two parts, and only its owner sees all its surroundings
            at = q - start + offsets[of]
            own = (low[of] <= at) & (at < high[of])
            q, of, start = q[own], of[own], start[own]
            if not len(q):
                continue
            _, _, c = _around(h, q, start, ends[of], length)
            store.append((ids[of], (q - start + offsets[of]).astype(np.uint32), h[q], c))
            count += len(q)
            if count >= FOLD:
                yield fold()
                count = 0
    if store:
        yield fold()


def _gathered(batches) -> dict[tuple[int, int], list[bytes]]:
    got: dict[tuple[int, int], list[bytes]] = defaultdict(list)
    for batch in batches:
        for b, k, x in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            got[b, k].append(x.as_py())
    return got


def _settle(batches, buckets: int, wide: int):
    """ANCHORS of a bucket -> SETTLED, CONTESTED by document bucket; SETTLED pass."""
    for (b, kind), blobs in _gathered(batches).items():
        if kind == SETTLED:
            yield _rows([(b, SETTLED, None, x) for x in blobs])
            continue
        d, q, h, c = joined(blobs)
        order, first = _first_of(np.lexsort((q, d)), h, c)
        d, q, h = d[order], q[order], h[order]
        rows = [(k, SETTLED, None, x) for k, x in by_bucket(d[~first] % buckets, d[~first], q[~first])]
        d, q, h = d[first], q[first], h[first]
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        open_ = n[at] > 1
        d, q, h, big = d[open_], q[open_], h[open_], (n[at] > wide)[open_].astype(np.uint8)
        rows += [(k, CONTESTED, None, x) for k, x in by_bucket(d % buckets, d, q, h, big)]
        yield _rows(rows)


def spans(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, sha256 of the rest) for the union of [start, end)."""
    if not len(starts):
        return 0, 0, hashlib.sha256(text).hexdigest()
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()


def _done(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    d, *rest = (pa.array(c, f.type) for c, f in zip(columns, [DATA.field("d"), *list(DATA)[4:]], strict=True))
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array([DONE] * n, pa.int32()), d, pa.nulls(n, pa.binary()), *rest], schema=DATA)


def _texts_and_blobs(batches) -> tuple[dict[int, bytes], dict[int, list[bytes]]]:
    texts, blobs = {}, defaultdict(list)
    for batch in batches:
        for k, d, x in zip(batch.column("kind").to_pylist(), batch.column("d").to_pylist(), batch.column("data"), strict=True):
            if k == TEXT:
                texts[d] = x.as_py()
            else:
                blobs[k].append(d if k == HELD else x.as_py())
    return texts, blobs


def _runs_of(d: np.ndarray) -> dict[int, slice]:
    """Slices of the equal values of a sorted array."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]]) if len(d) else np.zeros(1, int)
    return {int(d[a]): slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)}


def _surround(batches, length: int, buckets: int):
    """TEXT with SETTLED and CONTESTED -> DONE, or HELD (the document's number) with spans so far and AROUND (or WINDOWS) for
    the comparison."""
    texts, blobs = _texts_and_blobs(batches)
    settled = defaultdict(list)
    if blobs[SETTLED]:
        d, q = joined(blobs[SETTLED])
        order = np.argsort(d, kind="stable")
        d, q = d[order], q[order].astype(np.int64)
        for k, s in _runs_of(d).items():
            n = len(texts[k])
            settled[k] = [np.maximum(0, q[s] - (length - GRAM)), np.minimum(n, q[s] + length)]
    contested = {}
    if blobs[CONTESTED]:
        d, q, h, big = joined(blobs[CONTESTED])
        order = np.lexsort((q, d))
        d, q, h, big = d[order], q[order].astype(np.int64), h[order], big[order]
        contested = {k: (q[s], h[s], big[s]) for k, s in _runs_of(d).items()}
    done, held, store, wide = [], [], [], []
    for k, text in texts.items():
        a, b = settled.get(k, (np.zeros(0, np.int64),) * 2)
        if k not in contested:
            done.append((k, len(text), *spans(text, a, b)))
            if len(done) >= 2000:
                yield _done(done)
                done = []
            continue
        held.append((k % buckets, HELD, k, None))
        if len(a):
            held.append((k % buckets, SPANS, None, pack(np.full(len(a), k, np.int64), a, b)))
        if sum(len(x[3] or b"") for x in held) > 16_000_000 or len(held) > 2000:
            yield _rows(held)
            held = []
        q, h, big = contested[k]
        # the anchors' windows, found again part by part
        where, low, high = [], [], []
        for raw, ends, _, offsets in parts([k], [text], length):
            x, p0, p1, _ = anchors(raw, ends, length)
            of = np.searchsorted(ends, x, side="right")
            shift = offsets[of] - np.concatenate([[0], ends[:-1]])[of]
            where.append(x + shift), low.append(p0 + shift), high.append(p1 + shift)
        where, low, high = (np.concatenate(x) for x in (where, low, high))
        order = np.argsort(where, kind="stable")
        where, low, high = where[order], low[order], high[order]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(where) > 0]))
        where, low, high = where[edge], np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)
        at = np.searchsorted(where, q)
        low, high = low[at], high[at]
        raw = np.frombuffer(text, np.uint8)
        small = big == 0
        padded = np.concatenate([np.zeros(length, np.uint8), raw, np.zeros(length, np.uint8)])
        if small.any():
            reach = np.arange(-(length - GRAM), length)
            store.append((h[small], np.full(small.sum(), k, np.int64), q[small], padded[q[small][:, None] + reach + length], (q - high)[small].astype(np.uint8), (q - low)[small].astype(np.uint8)))
        for i in np.flatnonzero(~small):
            p = np.arange(low[i], high[i] + 1)
            x = [mixed(gram_hashes(raw[p[0] : p[-1] + length]) ^ s) for s in (np.uint64(0), M1)]
            places = [*range(0, length - GRAM, GRAM), length - GRAM]
            w = [np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)]
            for o in places:
                w = [mixed(w[j] * M2 + x[j][o : o + len(p)] + np.uint64(j)) for j in (0, 1)]
            wide.append((w[0], w[1], np.full(len(p), k, np.int64), p))
        if sum(len(x[0]) for x in store) > 60_000:
            yield _rows(_around_rows(store, buckets))
            store = []
        if sum(len(x[0]) for x in wide) > 2_000_000:
            yield _rows(_fold_windows(wide, buckets, length))
            wide = []
    yield _done(done)
    yield _rows(held)
    if store:
        yield _rows(_around_rows(store, buckets))
    if wide:
        yield _rows(_fold_windows(wide, buckets, length))


def _around_rows(store: list[tuple], buckets: int) -> list[tuple]:
    h, d, q, x, low, high = (np.concatenate(c) for c in zip(*store, strict=True))
    return [(b, AROUND, None, blob) for b, blob in by_bucket((h % np.uint64(buckets)).astype(np.int64), h, d, q, x, low, high)]


def _fold_windows(wide: list[tuple], buckets: int, length: int) -> list[tuple]:
    w, x, d, p = (np.concatenate(c) for c in zip(*wide, strict=True))
    order, first = _first_of(np.lexsort((p, d)), w, x)
    gone, keep = order[~first], order[first]
    rows = [(b, SPANS, None, blob) for b, blob in by_bucket(d[gone] % buckets, d[gone], p[gone], p[gone] + length)]
    return rows + [(b, WINDOWS, None, blob) for b, blob in by_bucket((w[keep] % np.uint64(buckets)).astype(np.int64), w[keep], x[keep], d[keep], p[keep])]


def lcp_of(rows: np.ndarray) -> np.ndarray:
    """For sorted rows of bytes: the common prefix of each with the one before (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _suffix_ranks(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group, then bytes; LCP with the one before, -1 at a group's start."""
    words = np.ascontiguousarray(np.pad(side, ((0, 0), (0, -side.shape[1] % 8)))).view(">u8")
    order = np.lexsort([*(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), group])
    lcp = lcp_of(side[order])
    g = group[order]
    lcp[1:][g[1:] != g[:-1]] = -1
    lcp[:1] = -1
    return order, lcp


def longest_previous_factors(lcp: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """LPF of suffixes in suffix order, from their LCP with the one before (-1: nothing in common, a new group) and places.

    A suffix's longest previous factor is the longer of what it shares with the nearest suffixes of smaller place before and
    after it. Both are found by jumps: a neighbour of larger place hands on its own. A walk ends where less than `least` is
    shared, so of values below that only the fact counts.
    """
    out = np.zeros(len(lcp), np.int64)
    for side in (1, -1):
        shared = lcp.copy() if side > 0 else np.append(lcp[1:], -1)[::-1].copy()
        at = place[::side]
        to = np.arange(len(lcp)) - 1
        walk = np.flatnonzero((to >= 0) & (shared >= least))
        while len(walk):
            walk = walk[at[to[walk]] > at[walk]]
            by = to[walk]
            shared[walk], to[walk] = np.minimum(shared[walk], shared[by]), to[by]
            shared[walk[to[walk] < 0]] = -1
            walk = walk[shared[walk] >= least]
        out = np.maximum(out, shared[::side])
    return out


def repeated_windows(h, d, q, x, low, high, length: int = LENGTH) -> np.ndarray:
    """Matrix (anchor, alignment): whether the window that starts `alignment` bytes before the anchor has LPF >= length.

    Alignments low..high of each anchor are asked; x holds the bytes around it. Windows of one alignment are brought into
    suffix order by the ranks of their bytes before and after the anchor, and their LCPs are counted on the bytes themselves.
    """
    reach = length - GRAM
    _, group = np.unique(h, return_inverse=True)
    after, _ = _suffix_ranks(group, x[:, reach:])
    before, lcp_before = _suffix_ranks(group, x[:, reach - 1 :: -1])
    place, rank, left = (np.empty(len(h), np.int64) for _ in range(3))
    place[np.lexsort((q, d))] = np.arange(len(h))
    rank[after] = np.arange(len(h))
    found = np.zeros((len(h), reach + 1), bool)
    for o in range(reach + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        left[before] = np.cumsum(lcp_before < o)
        rows = rows[np.argsort(left[rows] * len(h) + rank[rows], kind="stable")]
        lcp = lcp_of(x[rows, reach - o : reach - o + length])
        lcp[1:][group[rows[1:]] != group[rows[:-1]]] = -1
        found[rows, o] = longest_previous_factors(lcp, place[rows], length) >= length
    return found


def _compare(batches, length: int, buckets: int):
    """AROUND and WINDOWS of a bucket -> SPANS by document bucket."""
    for (_, kind), blobs in _gathered(batches).items():
        if kind == WINDOWS:
            w, x, d, p = joined(blobs)
            order, first = _first_of(np.lexsort((p, d)), w, x)
            gone = order[~first]
            d, a, b = d[gone], p[gone], p[gone] + length
        else:
            h, d, q, x, low, high = joined(blobs)
            found = np.pad(repeated_windows(h, d, q, x, low, high, length), ((0, 0), (1, 1))).astype(np.int8)
            step = np.diff(found, axis=1)
            (i, first), (j, last) = np.nonzero(step == 1), np.nonzero(step == -1)
            assert (i == j).all()
            # alignments first..last-1 are windows that start at q - last + 1 .. q - first
            d, a, b = d[i], q[i] - last + 1, q[i] - first + length
        yield _rows([(k, SPANS, None, blob) for k, blob in by_bucket(d % buckets, d, a, b)])


def _finish(batches):
    """TEXT with SPANS -> DONE of the documents that are HELD."""
    texts, blobs = _texts_and_blobs(batches)
    if not texts:
        return
    by = {}
    if blobs[SPANS]:
        d, a, b = joined(blobs[SPANS])
        order = np.argsort(d, kind="stable")
        d, a, b = d[order], a[order], b[order]
        by = {k: (a[s], b[s]) for k, s in _runs_of(d).items()}
    none = np.zeros(0, np.int64)
    yield _done([(k, len(texts[k]), *spans(texts[k], *by.get(k, (none, none)))) for k in blobs[HELD]])


def substring_dedup(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs; length is 64 to 150."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    # null, repeated or text ids: numbers in position order stand for them
    named = numbered(rows, "u", "numbered", [F.asc_nulls_last("d"), F.asc_nulls_first("t")], "d")
    rows = rows.select(F.col("d").cast("long").alias("d"), "t") if named is None else named.select(F.col("u").alias("d"), "t")
    rows = rows.select("d", F.coalesce(F.col("t"), F.lit("")).cast("binary").alias("data"))
    # buckets follow the input's splits, so that one holds a bounded part of it
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    deal = lambda df: df.repartition(buckets, "bucket")
    found = deal(rows.mapInArrow(lambda it: _find(it, length, buckets), SPARK))
    settled = found.mapInArrow(lambda it: _settle(it, buckets, wide), SPARK)
    nothing = ", ".join(f"cast(null as {t}) {n}" for n, t in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")))
    texts = rows.selectExpr(f"cast(pmod(d, {buckets}) as int) bucket", f"{TEXT} kind", "d", "data", *nothing.split(", "))
    around = written(deal(texts.union(settled)).mapInArrow(lambda it: _surround(it, length, buckets), SPARK), "around")
    release(settled)
    compared = deal(around.filter(F.col("kind").isin(AROUND, WINDOWS))).mapInArrow(lambda it: _compare(it, length, buckets), SPARK)
    # texts move once more from where they lie rather than being written with what was found in them
    last = deal(around.filter(F.col("kind").isin(HELD, SPANS)).union(compared).union(texts)).mapInArrow(_finish, SPARK)
    out = around.filter(F.col("kind") == DONE).union(last).select("d", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    if named is not None:
        out = out.join(named.select("u", F.col("d").alias("_ss_id")), F.col("d") == F.col("u")).drop("d").withColumnRenamed("_ss_id", "d")
    return out.select(F.col("d").cast(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents at 100 bytes."""
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM d WHERE length(h) >= 200),
 f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM w)),
 g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM f WHERE k > 1)),
 runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
 cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM runs GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN k IS NULL THEN h ELSE array_to_string(list_transform(range(0, k + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE ends[j] END) + 1, 2 * (CASE WHEN j = k THEN length(h) // 2 ELSE starts[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE ends[j] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
