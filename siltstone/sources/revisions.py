"""Revisions of a working tree: its head, the files changed since a base, and the review of their symbols."""

from __future__ import annotations

import hashlib
import logging
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import diff as D
from siltstone.sources import snapshot as S

CHANGES = "path string, change string"


def _git(root: str, *words: str) -> bytes:
    return subprocess.run(["git", "-C", root, *words], check=True, capture_output=True).stdout


def head(root: str) -> str:
    """The head's commit; `worktree:<commit>:<16 digits of the difference's hash>` where tracked files differ; `unversioned` without one."""
    try:
        commit = _git(root, "rev-parse", "HEAD").decode().strip()
        difference = _git(root, "diff", "HEAD")
    except (OSError, subprocess.CalledProcessError):
        return "unversioned"
    return f"worktree:{commit}:{hashlib.sha256(difference).hexdigest()[:16]}" if difference else commit


def changed_files(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, change) of source files since base: added, removed, or modified by any other letter. Renames are a removal
    and an addition; files that are not tracked are not seen."""
    known = {e for x in S.EXTENSIONS.values() for e in x}
    words = _git(root, "diff", "--name-status", "--no-renames", "-z", base).decode("utf-8", "replace").split("\0")
    rows = [(p, {"A": "added", "D": "removed"}.get(c[:1], "modified")) for c, p in zip(words[::2], words[1::2], strict=False) if p.rsplit(".", 1)[-1] in known]
    return spark.createDataFrame(rows, CHANGES)


def base_files(changed: DataFrame, root: str, base: str) -> DataFrame:
    """(path, content) at base of the changed files that were there; those that cannot be read are warned of and left out."""
    rows = []
    for r in changed.filter("change <> 'added'").collect():  # one review's files
        try:
            rows.append((r.path, bytearray(_git(root, "show", f"{base}:{r.path}"))))
        except subprocess.CalledProcessError:
            logging.getLogger(__name__).warning("not readable at %s: %s", base, r.path)
    return changed.sparkSession.createDataFrame(rows, "path string, content binary")


def review(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, symbol_id, change) of the symbols in changed files, modules left out, from the facts of both snapshots.

    An added file has no symbols before and a removed one none after, whatever the snapshots hold.
    """
    sides = []
    for facts, absent in ((before, "added"), (after, "removed")):
        there = changed.filter(F.col("change") != absent).select("path")
        rows = S.symbols(facts.join(there, "path", "left_semi")).filter("kind <> 'module'")
        sides.append(rows.groupBy("path", "symbol_id").agg(F.max_by("content_hash", F.struct("file_ord", "sym_ord")).alias("content_hash")))
    return D.snapshot_diff(*sides, ["path", "symbol_id"], "content_hash")


def review_changes(changed: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) of a review from the facts of both snapshots: files (path, change, base_source), the text at the base
    of those that were there and could be read, and the symbols of review()."""
    there = changed.filter("change <> 'added'").select("path")
    base = before.join(there, "path", "left_semi").select("path", F.col("source").alias("base_source"))
    return changed.join(base, "path", "left").select("path", "change", "base_source"), review(changed, before, after)


def commit(root: str, base: str) -> str:
    """The commit that a name stands for; raises CalledProcessError where it is none."""
    return _git(root, "rev-parse", base).decode().strip()
