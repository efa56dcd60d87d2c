"""Packing token documents into sequences by non-negative least squares over length combinations.

Documents are tokenized once and packed where they are read: no shuffle. A task takes its rows in chunks of about
`chunk_tokens` tokens. Whole windows are cut off a document first. The remainders' length histogram (in bins) is
matched by shallow combinations of at most `depth` lengths that fill a window: min |A x - h|, x >= 0, rounded down.
Remainders left over are packed greedily, best fit first. What space is left in any sequence is filled by cutting a left-over remainder,
and the chunk's last one is cut into power-of-two sequences, which need no padding.

Defined cases: a null or empty text is the document [eos]; repeated rows are independent documents; an empty
table gives an empty result; very long documents are cut; sequence ids are task id * 2**33 + number in the task.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import CACHES, table, working

WINDOW, BINS, DEPTH, CHUNK_TOKENS, EOS, CACHE_WORDS = 2048, 32, 4, 2_000_000, 1, 1_000_000


class _Words(dict):
    """word -> number, given at first sight; `new` lists the words not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


#: A comma or full stop between an ASCII letter or digit and white space is a token group of its own in the vocabulary's rules.
#: What is looked for stands first, what must stand before it after that: so the search runs from mark to mark.
STOP = re.compile(rb"([.,])(?<=[a-z0-9][.,])(?=[\x20\x09-\x0D]|\Z)")


class WordTokens:
    """Token ids by a word cache. The vocabulary's rules lower-case, drop white space and never join across it, so the
    ids of a text are those of its words in order; a word is encoded once a cache period."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only hold memory
        self.tokenizer, self.words = Tokenizer.from_file(path), _Words()
        self.starts, self.sizes, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0
        self.seen = np.zeros(1 << 16, np.int64)

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        n = len(self.words) - len(new)
        for a in range(0, len(new), 10_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new[a : a + 10_000]], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(size.sum())
            while len(self.starts) < n + len(ids):
                self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
            while len(self.flat) < self.used + total:
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.starts[n : n + len(ids)] = self.used + np.cumsum(size) - size
            self.sizes[n : n + len(ids)] = size
            self.used += total
            n += len(ids)

    def _age(self) -> None:
        """Words not seen twice in the period go; all go where that frees less than half of the cache."""
        n = len(self.words)
        keep = np.flatnonzero(self.seen[:n] > 1)
        if 2 * len(keep) > CACHE_WORDS:
            keep = keep[:0]
        old, self.words = list(self.words), _Words()
        self.words.update((old[i], j) for j, i in enumerate(keep.tolist()))
        size, start = self.sizes[keep], self.starts[keep]
        begin = np.cumsum(size) - size
        flat = self.flat[np.repeat(start - begin, size) + np.arange(int(size.sum()))]
        self.used = len(flat)
        self.flat[: self.used] = flat
        self.starts[: len(keep)], self.sizes[: len(keep)] = begin, size
        self.seen[:] = 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by EOS, and each text's number of ids."""
        if len(self.words) > CACHE_WORDS:
            self._age()
        split = [_prepared(t).split() if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self._learn()
        seen = np.bincount(at, minlength=len(self.words))
        if len(seen) > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros(len(seen), np.int64)])
        self.seen[: len(seen)] += seen
        size = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        n = ends[bounds[1:]] - ends[bounds[:-1]]
        take = np.repeat(self.starts[at] - ends[:-1], size) + np.arange(ends[-1])
        ids = self.flat[take]
        out = np.full(len(ids) + len(texts), EOS, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
        return out, n + 1


def _prepared(text: str) -> bytes:
    raw = text.encode()
    return raw if b"<|" in raw else STOP.sub(rb" \1", raw.lower())  # the names of special tokens are matched as they stand


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One cache a worker process, kept over its tasks."""
    return WordTokens(path)


CACHES["tokens"] = word_tokens.cache_clear


@lru_cache(maxsize=4)
def combinations(window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Columns: how many pieces of each length bin (by its upper end) fill a window with less than two bins to spare."""
    found: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int, least: int) -> None:
        if prefix and left < 2:
            found.append(prefix)
        if len(prefix) < depth:
            for b in range(least, left + 1):
                grow((*prefix, b), left - b, b)

    grow((), bins, 1)
    out = np.zeros((bins, len(found)))
    for j, x in enumerate(found):
        for b in x:
            out[b - 1, j] += 1
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - h| with x >= 0 by accelerated projected gradients."""
    step = 1 / max(np.linalg.norm(a @ a.T, 2), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - h)))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (old - 1) / t * (new - x)
    return x


def plan_chunk(lengths: np.ndarray, window: int = WINDOW, bins: int = BINS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; every token in one piece."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    for d in np.flatnonzero(lengths >= window):
        for k in range(int(lengths[d]) // window):
            out.append((int(d), k * window, window, seq, 0))
            seq += 1
    rest, bin_size = lengths % window, window // bins
    shelves: list[list[int]] = [[] for _ in range(bins)]
    for d in np.flatnonzero(rest)[::-1]:
        shelves[(int(rest[d]) - 1) // bin_size].append(int(d))
    a = combinations(window, bins)
    counts = np.floor(nnls(a, np.array([len(x) for x in shelves], float)) + 1e-6).astype(int)
    open_: list[list[int]] = []
    for j in np.flatnonzero(counts):
        need = [(b, int(n)) for b, n in enumerate(a[:, j]) if n]
        for _ in range(min([counts[j], *(len(shelves[b]) // n for b, n in need)])):
            open_.append([shelves[b].pop() for b, n in need for _ in range(n)])
    # left over: best fit, longest first, into sequences by the space they have
    left = sorted((d for x in shelves for d in x), key=lambda d: (-rest[d], d))
    spare = left[-(len(left) // 4) :] if len(left) >= 4 else []  # the shortest quarter is kept for filling by cuts
    space: list[list[int]] = [[] for _ in range(window + 1)]
    groups = open_
    for i, g in enumerate(groups):
        space[window - int(sum(rest[d] for d in g))].append(i)
    largest = [i for i in range(window + 1) if space[i]]
    for d in left[: len(left) - len(spare)]:
        n = int(rest[d])
        k = bisect.bisect_left(largest, n)
        if k < len(largest):
            room = largest[k]
            g = space[room].pop()
            if not space[room]:
                largest.pop(k)
            groups[g].append(d)
        else:
            room, g = window, len(groups)
            groups.append([d])
        room -= n
        if not space[room]:
            bisect.insort(largest, room)
        space[room].append(g)
    stock, used = list(reversed(spare)), {}
    whole = lambda d: int(lengths[d]) - int(rest[d])
    pieces: list[list[tuple[int, int, int]]] = [[(d, whole(d), int(rest[d])) for d in g] for g in groups]
    fill = [sum(n for _, _, n in p) for p in pieces]
    # fullest first; when the stock runs out, the emptiest sequence is broken up and becomes stock
    queue = sorted(range(len(pieces)), key=lambda g: -fill[g])
    parts = [(d, whole(d), int(rest[d])) for d in stock]
    lo, hi = 0, len(queue)
    done: list[list[tuple[int, int, int]]] = []
    while lo < hi:
        g = queue[lo]
        lo += 1
        p, room = pieces[g], window - fill[g]
        while room:
            if not parts:
                if lo >= hi:
                    break
                hi -= 1
                parts = pieces[queue[hi]]
            d, at, n = parts.pop()
            cut = min(n, room)
            p.append((d, at, cut))
            room -= cut
            if cut < n:
                parts.append((d, at + cut, n - cut))
        done.append(p)
    tail = parts
    if done and sum(n for _, _, n in done[-1]) < window:
        tail = done.pop() + tail
    total = sum(n for _, _, n in tail)
    while total:
        size = min(window, 1 << (total.bit_length() - 1))
        p, room = [], size
        while room:
            d, at, n = tail.pop()
            cut = min(n, room)
            p.append((d, at, cut))
            room -= cut
            if cut < n:
                tail.append((d, at + cut, n - cut))
        done.append(p)
        total -= size
    for p in done:
        offset = 0
        for d, at, n in p:
            out.append((d, at, n, seq, offset))
            offset += n
        seq += 1
    return out


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, window: int, extra: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    working("tokens")
    tokens, base, number = word_tokens(path), TaskContext.get().partitionId() << 33, 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nonlocal number, held
        ids_of = pa.concat_arrays([x[0] for x in held])
        ids, sizes = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        held = []
        starts = np.cumsum(sizes) - sizes
        plan = np.array(plan_chunk(sizes, window), np.int64).reshape(-1, 5)
        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip((starts[plan[:, 0]] + plan[:, 1]).tolist(), plan[:, 2].tolist(), strict=True)), np.int64, len(plan))
        seq = plan[:, 3] + number + base
        number += int(plan[:, 3].max()) + 1
        columns = [ids_of.take(pa.array(plan[:, 0])), plan[:, 1], plan[:, 2], crc, sizes[plan[:, 0]], seq, plan[:, 4]]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=extra)

    waiting = 0
    for batch in batches:
        texts = batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):  # a slice of about 2 MB of text at a time
            b = 1 + int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2_000_000))
            b = min(b, len(texts))
            ids, sizes = tokens.encode(texts.slice(a, b - a).to_pylist())
            held.append((batch.column(0).slice(a, b - a), ids, sizes))
            waiting += len(ids)
            a = b
            if waiting >= CHUNK_TOKENS:
                yield flush()
                waiting = 0
    if held:
        yield flush()


#: Text with what a vocabulary's rules may treat apart: case, accents, marks, digits, white space, controls, special names.
SAMPLE = ("Some Words, and more.  The END...\n\ttwo tabs\t\t(3.14, 1,000) don't re-enter a/b_c e.g. x=y; caf\u00e9 CAF\u00c9 \u00dcber na\u00efve", "\u4e2d\u6587 \u65e5\u672c\u8a9e. \U0001f600 ok\u00a0no-break \u2028 line \x0b\x0c end.", "", " ", "a.b, c", "<|x|> done. 12.5%, A.B.C.")


def checked(path: str) -> None:
    """Raise ValueError where the vocabulary's rules join or tell apart what the word cache does not: SAMPLE's ids differ."""
    tokens = WordTokens(path)
    ids, sizes = tokens.encode(list(SAMPLE))
    for text, a, n in zip(SAMPLE, (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        if ids[a : a + n].tolist() != [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, EOS]:
            raise ValueError(f"{path}: ids of words are not the ids of their text, as in {text!r}")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), all bigint but doc_id's own type.

    Raises ValueError for a vocabulary whose rules do not go word by word; see checked().
    """
    from pyspark.sql.pandas.types import to_arrow_type

    checked(tokenizer_path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([pa.field("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), *(pa.field(n, pa.int64()) for n in names)])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _pack_batches(it, tokenizer_path, window, schema), f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """op5: the pieces of all documents at 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer())
