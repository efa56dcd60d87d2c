"""The review document: the index of a working tree about what changed since a base, with the changes themselves."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import index as I
from siltstone.sources import revisions as R
from siltstone.sources import snapshot as S


def review_document(spark: SparkSession, root: str, base: str, entries: list[str] | None = None, hops: int = 2, excludes: list[str] | None = None, **more) -> DataFrame:
    """(json) of the working tree at root: changed files are entries after those named, and their symbols are compared with
    the base's. Each snapshot is parsed once: the tree for the index and the comparison, the base for its changed files.

    more: what build() takes besides. Raises CalledProcessError where base is no commit and ValueError where nothing is an entry.
    """
    commit = R.commit(root, base)
    changed = R.changed_files(spark, root, commit)
    after = S.facts(S.files(S.scan(spark, root, excludes)))
    before = S.facts(S.files(R.base_files(changed, root, commit)))
    index = I.build(after, entries or [], hops, changed=changed, facts=after, **more)
    name = os.path.basename(os.path.abspath(root))
    repository = {"id": name, "root": os.path.abspath(root), "head_commit": R.head(root), "base_commit": commit}
    return I.document(index, repository, hops, excludes, R.review_changes(changed, before, after))
