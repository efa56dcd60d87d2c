"""Alignment of two tokenizers' tokens over a corpus, by a cogroup of postings.

A text is encoded by a byte-level vocabulary (A, with a space before it) and by a piece vocabulary (B, which adds that
space). Where both end a token they end a group; an A and a B token whose bytes overlap are linked. How often a pair of ids
is linked in the whole corpus then weighs every document's links.

    1. Each document is encoded where it is read. Its pairs of ids with their multiplicities are written, beside its own
       counts, in the shared folder.
    2. Postings (B id, A id, document, multiplicity) are shuffled by B id, as are the partial counts of pairs of each task.
       Buckets are ranges of (B id, hash of the document) with equal numbers of postings, by the B ids' exact histogram,
       which the vocabulary bounds; a B id with more than a bucket's share is dealt over several, and its counts go to each.
    3. A bucket is one stream that Spark has sorted, and spills: counts first, which give totals and each B id's highest,
       then postings block by block, which give contributions to documents. Those are summed by document.

The tasks hold the pairs of one bucket's B ids and one block. White space is proven to begin a token in B
where a piece never holds it after another character (A's rules say so for every vocabulary of that kind); then texts are
cut there and each stretch is encoded once a cache period. Otherwise texts are encoded whole.

Defined cases: null and empty texts, and texts whose tokens' bytes are not the space and the text, have no tokens: zeros and an
empty hash. Repeated rows and rows with one id or none are documents of their own and all count. An empty table gives an
empty result. Columns of the input stay apart from the text; a new column whose name is taken ends in an underscore.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import blobs
from siltstone.llm.common import CACHES, free_name, table, working, written

CACHE_CHARS, AT_ONCE, CHUNK, BUCKET, PAIRS_HELD = 6_000_000, 4 << 20, 2_000_000, 8_000_000, 4_000_000
#: A space after a character that is no white space begins a token of A, and of B where that is proven.
CUT = re.compile(r" (?<=\S )")
SPACE = "▁"
FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class Aligner:
    """Encodes texts by both vocabularies and aligns them, stretch by stretch."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        spaced = "".join(self.b.encode(" a  b ", out_type=str)) == SPACE + " a  b ".replace(" ", SPACE)
        self.cut = CUT if spaced and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) else None
        self.space = self.b.piece_to_id(SPACE)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        #: How an id is written before a comma and before what ends its side of a group.
        self.written = [f"{i}{s}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for s in ends for i in range(n)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.chars = self.used = 0
        self.good, self.start = np.zeros(1 << 16, bool), np.zeros(1 << 16, np.int64)
        self.counts = [np.zeros(1 << 16, np.int64) for _ in range(4)]  # of A, B, groups, links
        self.flat = np.zeros(1 << 18, np.uint32)

    def _learn(self, new: list[str]) -> None:
        """Encode stretches, each standing for a space and itself, and keep their counts, their groups as text and their links."""
        a_ids = [e.ids for e in self.a.encode_batch_fast([f" {x}" for x in new], add_special_tokens=False)]
        b_ids = [ids or [self.space] for ids in self.b.encode(new, num_threads=1)]  # of a space alone B's library gives nothing
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.chars += sum(map(len, new))
        want = [f" {x}".encode() for x in new]
        good = [b"".join(map(self.a_bytes.__getitem__, a)) == w == b"".join(map(self.b_bytes.__getitem__, b)) for a, b, w in zip(a_ids, b_ids, want, strict=True)]
        at = np.flatnonzero(good)
        a_ids, b_ids = [a_ids[i] for i in at], [b_ids[i] for i in at]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum(np.array([len(want[i]) for i in at], np.int64))  # the stretches', in bytes
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        either = np.union1d(a_end, b_end)  # between two of these lies one link
        a_of, b_of = np.searchsorted(a_end, either), np.searchsorted(b_end, either)
        keys = (b[b_of].astype(np.uint32) << np.uint32(16)) | a[a_of].astype(np.uint32)
        n_links, n_groups = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (either, both))
        # the groups as text: A's ids of a group, then B's
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        codes = np.zeros(len(a) + len(b), np.int64)
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        codes[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a + len(self.a_bytes) * last(a_group)
        codes[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * len(self.a_bytes) + b + len(self.b_bytes) * last(b_group)
        out = list(map(self.written.__getitem__, codes.tolist()))
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        texts = [b""] * len(new)
        for i, s, e in zip(at.tolist(), bounds[:-1], bounds[1:], strict=True):
            texts[i] = b"".join(out[s:e])[:-1]
        self.texts += texts
        n, total = first + len(new), int(n_links.sum())
        self.good, self.start = _grown(self.good, n), _grown(self.start, n)
        self.good[first:n] = good
        for k, x in enumerate((n_a, n_b, n_groups, n_links)):
            self.counts[k] = _grown(self.counts[k], n)
            self.counts[k][first + at] = x
        self.flat = _grown(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = keys
        self.start[first + at] = self.used + np.cumsum(n_links) - n_links
        self.used += total

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys of linked ids, their multiplicities) of each text."""
        if self.chars > CACHE_CHARS:
            self._forget()
        split = [(self.cut.split(t) if self.cut else [t]) if t else [] for t in texts]
        new = [x for x in dict.fromkeys(chain.from_iterable(split)) if x not in self.known]
        if new:
            self._learn(new)
        out, nothing = [], (0, 0, 0, 0, "", np.zeros(0, np.uint32), np.zeros(0, np.int64))
        for parts in split:
            numbers = list(map(self.known.__getitem__, parts))
            at = np.array(numbers, np.int64)
            if not parts or not self.good[at].all():
                out.append(nothing)
                continue
            size = self.counts[3][at]
            ends = np.cumsum(size)
            keys = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])]
            found, n = np.unique(keys, return_counts=True)
            digest = hashlib.sha256(b";".join(map(self.texts.__getitem__, numbers))).hexdigest()
            out.append((*(int(c[at].sum()) for c in self.counts), digest, found, n))
        return out


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process, kept over its tasks."""
    return Aligner(a_path, b_path)


CACHES["alignment"] = aligner.cache_clear


def packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys, by their differences, with a number each."""
    return blobs.pack(np.diff(keys, prepend=keys.dtype.type(0)), n.astype(np.uint8 if len(n) and n.max() < 256 else np.int64))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    delta, n = blobs.unpack(blob)
    return np.cumsum(delta, dtype=np.uint32), n.astype(np.int64)


def _by_bytes(array: pa.Array) -> Iterator[list[str | None]]:
    """The array's texts, about AT_ONCE bytes at a time."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = done = 0
    while a < len(array):
        b = max(a + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        yield array.slice(a, b - a).to_pylist()
        a, done = b, int(ends[b - 1])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n[order], first)


class _Totals:
    """Counts of pairs, summed as they come."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > PAIRS_HELD:
            self.parts = [self.all()]
            self.held = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, n): postings of each B id in the task."""
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        keys = [unpacked(p)[0] for p in batch.column(0).to_pylist()]
        if keys:
            n += np.bincount(np.concatenate(keys) >> np.uint32(16), minlength=1 << 16)
    b = np.flatnonzero(n)
    yield pa.record_batch([pa.array(b.astype(np.int32)), pa.array(n[b])], names=["b", "n"])


class Layout:
    """Buckets as ranges of (B id, hash of the document), `share` postings each."""

    def __init__(self, histogram: list[tuple[int, int]], buckets: int):
        self.n = np.zeros(1 << 16, np.int64)
        for b, n in histogram:
            self.n[b] = n
        total = int(self.n.sum())
        self.share = max(1, -(-total // max(buckets, -(-total // BUCKET))))
        self.begin = np.cumsum(self.n) - self.n
        self.count = max(1, -(-total // self.share))
        self.first, self.last = self.begin // self.share, (self.begin + np.maximum(self.n, 1) - 1) // self.share

    def bucket(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        b = keys >> np.uint32(16)
        place = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)  # a hash below 2**32
        within = (self.n[b].astype(np.float64) * (place.astype(np.float64) / 2**32)).astype(np.int64)
        return (self.begin[b] + within) // self.share


def _deal(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """(bucket, side, blob): postings of about CHUNK documents' pairs a block (side 1), and at the end the task's counts (side 0)."""
    totals = _Totals()

    def rows_of(side: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """columns, sorted by key, as one blob a bucket."""
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        out = []
        for at in np.split(order, edges):
            keys, *rest = (c[at] for c in columns)
            out.append((int(bucket[at[0]]), blobs.pack(np.diff(keys, prepend=np.uint32(0)), *rest)))
        return pa.record_batch([pa.array([b for b, _ in out], pa.int64()), pa.array([side] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "side", "blob"])

    def flush(held: list) -> pa.RecordBatch:
        size = np.array([len(k) for _, k, _ in held], np.int64)
        rows = np.repeat(np.array([r for r, _, _ in held], np.int64), size)
        keys, n = np.concatenate([k for _, k, _ in held]), np.concatenate([n for _, _, n in held])
        order = np.argsort(keys, kind="stable")
        keys, n, rows = keys[order], n[order], rows[order]
        totals.add(*summed(keys, n))
        return rows_of(1, layout.bucket(keys, rows), keys, rows, n)

    held, size = [], 0
    for batch in batches:
        for row, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((row, *unpacked(blob)))
            size += len(held[-1][1])
            if size >= CHUNK:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)
    keys, n = totals.all()
    if len(keys):
        b = keys >> np.uint32(16)
        copies = layout.last[b] - layout.first[b] + 1  # a B id that is dealt over several buckets is counted in each
        bucket = np.repeat(layout.first[b], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        yield rows_of(0, bucket, np.repeat(keys, copies), np.repeat(n, copies))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, count_sum, n_best) of each block of postings, from rows (bucket, side, blob) in order of bucket and side."""
    now, totals, counts = None, _Totals(), None
    for batch in batches:
        for bucket, side, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if bucket != now:
                now, totals, counts = bucket, _Totals(), None
            delta, *rest = blobs.unpack(blob)
            keys = np.cumsum(delta, dtype=np.uint32)
            if side == 0:
                totals.add(keys, rest[0])
                continue
            if counts is None:
                known, counts = totals.all()
                b = known >> np.uint32(16)
                first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(b))))
            rows, n = rest
            at = np.searchsorted(known, keys)
            found, place = np.unique(rows, return_inverse=True)
            weight, top = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            np.add.at(weight, place, n * counts[at])
            np.add.at(top, place, n * best[at])
            yield pa.record_batch([pa.array(found), pa.array(weight), pa.array(top)], names=["row", "count_sum", "n_best"])


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", buckets: int | None = None) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose pair is, of those of its B id, a most frequent one in the corpus; count_sum adds the
    pair's frequency over all links.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != text]

    @F.arrow_udf(f"struct<{FACTS.replace(' ', ':').replace(',:', ',')}>")
    def facts_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        working("alignment")
        of = aligner(a_path, b_path)
        names = [c.split()[0] for c in FACTS.split(", ")]
        for array in arrays:
            out = []
            for texts in _by_bytes(array):
                out += [(*x[:5], packed(*x[5:])) for x in of.align(texts)]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True)], names)

    held, row, back, sum_of = (free_name(docs, n) for n in ("alignment", "alignment_row", "alignment_back", "alignment_sum"))
    facts = docs.withColumn(held, facts_of(F.col(text))).drop(text).withColumn(row, F.monotonically_increasing_id())
    facts = written(facts, "alignment")
    postings = facts.filter(F.col(f"{held}.n_links") > 0)
    histogram = postings.select(f"{held}.pairs").mapInArrow(_histogram, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    layout = Layout([tuple(r) for r in histogram.collect()], buckets or 2 * spark.sparkContext.defaultParallelism)  # a row a B id
    dealt = postings.select(F.col(row).alias("row"), f"{held}.pairs").mapInArrow(lambda it: _deal(it, layout), "bucket long, side int, blob binary")
    sorted_ = dealt.repartitionById(layout.count, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "side")
    parts = sorted_.mapInArrow(_contributions, "row long, count_sum long, n_best long")
    sums = parts.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out, c = facts.join(sums.select(F.col("row").alias(back), F.struct("count_sum", "n_best").alias(sum_of)), F.col(row) == F.col(back), "left"), F.col
    new = {n: c(f"{held}.{n}") for n in ("n_a", "n_b", "n_groups", "n_links")}
    new |= {n: F.coalesce(c(f"{sum_of}.{n}"), F.lit(0)).cast("long") for n in ("n_best", "count_sum")}
    new["groups_sha256"] = c(f"{held}.groups_sha256")
    return out.select(*kept, *(v.alias(free_name(docs.select(*kept), n)) for n, v in new.items()))


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_vocabularies())
