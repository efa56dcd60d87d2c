"""Token counts of texts by a byte-level vocabulary, by the whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proven once for a vocabulary, before any text is read: each
is encoded by itself. A text is split into pre-tokens by an expression of the standard library; a pre-token that is
proven counts one, and only the others are merged, each once a cache period. Where that expression splits as the library
does is proven too, code point by code point over the basic plane and the pictographs; a stretch between two spaces
that holds any other code point is counted by the library.

Every row is counted where it was read: no shuffle, and no state but the cache of a worker, which `CACHE` bounds.

Defined cases: a null or empty text has 0 bytes and 0 tokens; the names of special tokens in a text are such tokens, as the
library has it by default; repeated rows are counted each; an empty table gives an empty result; texts of any length are
counted whole, in pieces that end where every rule ends a pre-token. Input columns stay; a new column whose name is
taken ends in an underscore.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import CACHES, free_name, table, working

LIMIT, CACHE, PIECE, AT_ONCE, LONG_WORD = 512, 400_000, 1 << 20, 4 << 20, 128
#: Pre-tokens: contractions, and runs of letters, digits or other characters with a space before them; white space, of
#: which the last one before a character is left to what follows.
PRE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: A space after a character that is no white space always begins a pre-token.
CUT = re.compile(r" (?<=\S )")
PROVEN_RANGES = ((0, 0xD800), (0xE000, 0x10000), (0x1F000, 0x20000))


@dataclass(frozen=True)
class Proof:
    """What holds for a vocabulary: strings that are one token each, a character class of code points on which PRE is not
    proven to split as the library does, and the names of special tokens."""

    whole: frozenset
    odd: str
    special: tuple


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(path)


def _split(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PRE.finditer(text)]


def _beside(c: int) -> str:
    x = chr(c)
    return f"a{x}1{x}!{x} {x}{x}  {x}b"


def _odd(split_by_library) -> str:
    """Ranges of code points next to which PRE splits otherwise than the library, or that are not tried."""
    bad = []
    for low, high in PROVEN_RANGES:
        for block in range(low, high, 256):
            points = range(block, min(block + 256, high))
            text = "\n".join(map(_beside, points))
            if _split(text) != split_by_library(text):
                bad += [c for c in points if _split(_beside(c)) != split_by_library(_beside(c))]
    ranges, last = [], -2
    for c in bad:
        if c == last + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
        last = c
    ranges += [[a, b - 1] for (_, a), (b, _) in zip(PROVEN_RANGES, [*PROVEN_RANGES[1:], (0x110000, 0)], strict=True) if a < b and (a, b) != (0xD800, 0xE000)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=4)
def proof(path: str) -> Proof:
    """Raises ValueError for vocabularies whose rules are not those that PRE stands for."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    pre, added = rules["pre_tokenizer"] or {}, rules["added_tokens"]
    if rules["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or rules["truncation"] or rules["padding"]:
        raise ValueError(f"not a plain byte-level vocabulary: {path}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"special tokens that take more than their name: {path}")
    tokenizer = _tokenizer(path)
    names = {t["content"] for t in added}
    strings = [s for s in tokenizer.decode_batch([[i] for i in tokenizer.get_vocab(with_added_tokens=False).values()], skip_special_tokens=False) if s and s not in names]
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    whole = frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and _split(s) == [(0, len(s))])
    odd = _odd(lambda text: [at for _, at in tokenizer.pre_tokenizer.pre_tokenize_str(text)])
    return Proof(whole, odd, tuple(sorted(names, key=len, reverse=True)))


class TokenCounter:
    """Counts tokens of texts; `merged` keeps the counts of pre-tokens that are no whole token."""

    def __init__(self, path: str, proven: Proof):
        self.tokenizer, self.whole, self.merged = _tokenizer(path), proven.whole, {}
        self.odd = re.compile(f"[{proven.odd}]") if proven.odd else None
        self.special = re.compile("|".join(map(re.escape, proven.special))) if proven.special else None

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters, cut where a pre-token begins whatever stands around."""
        a = 0
        while len(text) - a > PIECE and (m := CUT.search(text, a + PIECE)):
            yield text[a : m.start()]
            a = m.start()
        yield text[a:] if a else text

    def _parts(self, text: str, strange: list[str]) -> tuple[int, list[str]]:
        """(tokens counted already, pre-tokens that are not whole); what the library must split goes to strange."""
        n, rest = 0, []
        found = self.special.split(text) if self.special else [text]
        n += len(found) - 1
        for part in found:
            for piece in self._pieces(part):
                runs = [piece]
                if strays := self.odd and self.odd.search(piece) is not None:
                    runs = [" " + r if i else r for i, r in enumerate(CUT.split(piece))]
                for run in runs:
                    if strays and self.odd.search(run):
                        strange.append(run)
                        continue
                    every = PRE.findall(run)
                    left = [p for p in every if p not in self.whole]
                    n += len(every) - len(left)
                    rest += left
        return n, rest

    def _sizes(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        counts, rests, stranges = [], [], []
        for t in texts:
            strange: list[str] = []
            n, rest = self._parts(t, strange) if t else (0, [])
            counts.append(n)
            rests.append(rest)
            stranges.append(strange)
        new = [p for p in {p for rest in rests for p in rest} if p not in self.merged]
        self.merged.update(zip(new, self._sizes(new), strict=True))
        counts = [n + sum(map(self.merged.__getitem__, rest)) for n, rest in zip(counts, rests, strict=True)]
        for i, strange in enumerate(stranges):
            if strange:
                counts[i] += sum(self._sizes(strange))
        if len(self.merged) > CACHE:
            self.merged.clear()
        else:
            for p in new:
                if len(p) > LONG_WORD:
                    del self.merged[p]
        return counts


@lru_cache(maxsize=1)
def counter(path: str, proven: Proof) -> TokenCounter:
    """One a worker process, kept over its tasks."""
    return TokenCounter(path, proven)


CACHES["token_counts"] = counter.cache_clear


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows from a to b of about AT_ONCE bytes."""
    a = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= AT_ONCE:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of their texts."""
    proven = proof(path)

    @F.arrow_udf("long")
    def tokens_of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        working("token_counts")
        of = counter(path, proven)
        for array in arrays:
            sizes = pc.fill_null(pc.binary_length(array), 0).to_pylist()
            yield pa.array([n for a, b in _slices(sizes) for n in of.count(array.slice(a, b - a).to_pylist())], pa.int64())

    bytes_, n, over = (free_name(docs, c) for c in ("n_bytes", "n_tokens", "over_limit"))
    out = docs.withColumn(bytes_, F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn(n, tokens_of(F.col(text)))
    return out.withColumn(over, F.col(n) > limit)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, default_vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
