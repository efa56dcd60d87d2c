"""What a viewer shows of texts: line differences of changed symbols, and lines split into runs of equal highlights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources import snapshot as S

LINE = "op string, old_line int, new_line int, text string"
SPAN = ["start_line", "start_character", "end_line", "end_character"]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each beginning of b the length of the longest subsequence that it has in common with a; one row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, by halves of a, in space that grows with the lengths alone."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            out.append((k - 1, m - 1))
            k, m = k - 1, m - 1
        if i == k or j == m:
            continue
        if k - i == 1:
            at = np.flatnonzero(b[j:m] == a[i])
            out += [(i, j + int(at[0]))] if len(at) else []
            continue
        half = (i + k) // 2
        cut = j + int(np.argmax(_lengths(a[i:half], b[j:m]) + _lengths(a[half:k][::-1], b[j:m][::-1])[::-1]))
        todo += [(i, half, j, cut), (half, k, cut, m)]
    return sorted(out)


def script(before: str | None, after: str | None) -> list[tuple]:
    """(op, old_line, new_line, text) of a shortest edit script by lines: ` ` what stays, `-` what goes, `+` what comes; lines
    count from 1, and what goes stands before what comes in its place. A null text has no lines, an empty one has one."""
    old, new = ([] if t is None else t.split("\n") for t in (before, after))
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in y], np.int64) for y in (old, new))
    out, i, j = [], 0, 0
    for x, y in [*common(a, b), (len(old), len(new))]:
        out += [("-", n + 1, None, old[n]) for n in range(i, x)] + [("+", None, n + 1, new[n]) for n in range(j, y)]
        if x < len(old):
            out.append((" ", x + 1, y + 1, old[x]))
        i, j = x + 1, y + 1
    return out


def line_diff(texts: DataFrame, before: str, after: str) -> DataFrame:
    """texts with `lines`, the edit script from one text column to the other. Equal texts are not gone through: all stays."""
    kept = [c for c in texts.columns if c not in (before, after)]

    @F.arrow_udf(f"array<struct<{LINE.replace(' ', ':').replace(',:', ',')}>>")
    def scripts(old: pa.Array, new: pa.Array) -> pa.Array:
        of = pa.struct([("op", pa.string()), ("old_line", pa.int32()), ("new_line", pa.int32()), ("text", pa.string())])
        names = of.names
        rows = [[dict(zip(names, x, strict=True)) for x in script(a.as_py(), b.as_py())] for a, b in zip(old, new, strict=True)]
        return pa.array(rows, pa.list_(of))

    stays = F.transform(F.split(before, "\n", -1), lambda x, i: F.struct(F.lit(" ").alias("op"), (i + 1).alias("old_line"), (i + 1).alias("new_line"), x.alias("text")))
    same = texts.filter(F.col(before) == F.col(after)).select(*kept, stays.alias("lines"))
    others = texts.filter(~F.col(before).eqNullSafe(F.col(after)) | (F.col(before).isNull() & F.col(after).isNull()))
    return same.unionByName(others.select(*kept, scripts(F.col(before), F.col(after)).alias("lines")))


def _symbol_texts(facts: DataFrame, paths: DataFrame, name: str) -> DataFrame:
    """(path, symbol_id, text) of the symbols in these files, the last of an id, cut out of the source by bytes."""
    c = F.col
    symbols = S.symbols(facts.join(paths, "path", "left_semi")).filter("kind <> 'module'")
    last = symbols.groupBy("path", "symbol_id").agg(F.max_by(F.struct(*SPAN), F.struct("file_ord", "sym_ord")).alias("s"))
    rows = last.join(facts.select("path", "source"), "path")
    lines = F.slice(F.split("source", "\n", -1), c("s.start_line"), c("s.end_line") - c("s.start_line") + 1)
    whole = F.encode(F.array_join(lines, "\n"), "UTF-8")
    tail = F.octet_length(F.element_at(lines, -1)) - c("s.end_character")
    text = F.substring(whole, c("s.start_character") + 1, F.octet_length(whole) - c("s.start_character") - tail).cast("string")
    return rows.select("path", "symbol_id", text.alias(name))


def diff_view(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, symbol_id, change, op, old_line, new_line, text): the lines of changed symbols (path, symbol_id, change), from the
    facts of both snapshots. Lines count from the symbol's first."""
    paths = changes.select("path").distinct()
    rows = changes.join(_symbol_texts(before, paths, "_old"), ["path", "symbol_id"], "left").join(_symbol_texts(after, paths, "_new"), ["path", "symbol_id"], "left")
    found = line_diff(rows.select("path", "symbol_id", "change", "_old", "_new"), "_old", "_new")
    return found.select("path", "symbol_id", "change", F.explode("lines").alias("x")).select("path", "symbol_id", "change", "x.*")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs between neighbouring places of a line at which a highlight begins or ends, with the labels that cover them, of
    events sorted by line and place."""
    now, last, open_ = None, 0, {}
    for b in batches:
        out = []
        for path, line, at, begins, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (path, line) != now:
                now, last, open_ = (path, line), at, {}
            if at > last:
                if open_:
                    out.append((path, line, last, at, sorted(open_)))
                last = at
            n = open_.pop(label, 0) + (1 if begins else -1)
            if n:
                open_[label] = n
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "line", "start_character", "end_character", "labels"])


def highlight_runs(files: DataFrame, highlights: DataFrame) -> DataFrame:
    """(path, line, start_character, end_character, labels, text): the highlighted parts of the lines of files (path, source), cut so
    that no two overlap, each with the sorted labels of all highlights (path, span, label) that cover it.

    Characters are UTF-8 bytes, as spans are. A highlight over several lines reaches to their ends; one that ends beyond a
    line ends with it. Empty highlights, those in no file and those without a label show nothing.
    """
    c = F.col
    lines = files.select("path", F.posexplode(F.split("source", "\n", -1)).alias("line", "whole")).withColumn("line", c("line") + 1)
    parts = highlights.filter("label is not null").select("path", "label", *SPAN, F.explode(F.when(c("end_line") >= c("start_line"), F.sequence("start_line", "end_line"))).alias("line"))
    parts = parts.join(lines.select("path", "line", F.octet_length("whole").alias("bytes")), ["path", "line"])
    start = F.when(c("line") == c("start_line"), c("start_character")).otherwise(0)
    end = F.least("bytes", F.when(c("line") == c("end_line"), c("end_character")).otherwise(c("bytes")))
    parts = parts.select("path", "line", "label", start.alias("a"), end.alias("b")).filter("a < b")
    ends = F.explode(F.array(F.struct(c("a").alias("at"), F.lit(True).alias("begins")), F.struct(c("b").alias("at"), F.lit(False).alias("begins"))))
    events = parts.select("path", "line", ends.alias("x"), "label").select("path", "line", "x.at", "x.begins", "label")
    runs = events.repartition("path", "line").sortWithinPartitions("path", "line", "at").mapInArrow(_runs, "path string, line int, start_character int, end_character int, labels array<string>")
    cut = F.substring(F.encode("whole", "UTF-8"), c("start_character") + 1, c("end_character") - c("start_character"))
    text = F.make_valid_utf8(cut.cast("string"))  # a span may end within a character
    return runs.join(lines, ["path", "line"]).select("path", "line", "start_character", "end_character", "labels", text.alias("text"))
