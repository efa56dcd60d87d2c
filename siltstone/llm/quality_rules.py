"""Quality rules with risk-controlled thresholds.

Base rules are fixed. Beyond them each document gets one severity: the largest of its rule values over that rule's
scale, so the rules form a nested family with a single cutoff. Labelled documents that pass the base rules, equal texts of a stratum
once, are split by a seeded hash of the text, so copies never stand on both sides. One half
of the good ones sets the scales (a high quantile of each value, per rule). The other half is the holdout: per stratum
the cutoffs are tried from lenient to strict (fixed-sequence testing, so no correction over cutoffs), each by the exact
binomial (Clopper-Pearson) upper bound of the share of good documents it rejects; the strata share the error `delta`
by Bonferroni. Among cutoffs whose bound is at most `alpha`, the most lenient that still rejects `enough` of the bad
holdout documents which the strictest of them rejects is used. So with probability 1 - delta no stratum rejects by severity more
than `alpha` of its good documents that pass the base rules. The error is shared by all strata with a holdout label, however many
there are. In strata without a provable cutoff only the base rules apply: a cutoff of other strata's rows would prove nothing there.

Histograms (stratum x severity bins) and cutoffs stay distributed; the driver sees the scales and the number of strata.

Defined cases: null or empty text has no words, fails the base rule and is not kept; a null stratum is a stratum of its own;
documents without a label are only judged; labels without a document are unused; repeated rows are judged alike; no labels, or too few to prove
anything: only base rules apply; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import table, written

#: Fixed values of the base rules.
SYMBOLS, MIN_WORDS, REPEAT_PERCENT = "#*$%&|<>", 50, 50
ALPHA, DELTA, SCALE_QUANTILE, ENOUGH, SEED = 0.05, 0.05, 0.995, 0.98, 29
#: Severity cutoffs: 0.5 to 64 in steps of a sixteenth of a doubling.
CUTOFFS = [2 ** (k / 16 - 1) for k in range(113)]
RULES = ("symbols", "repeats", "dup_lines", "capitals", "long_words")


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    key = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capitals."""
    if not text:
        return (0, 0, 0, 0, 0, 0, 0)
    words = text.encode().split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return (len(words), len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines), _capitals(text))


def _capitals(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(((raw >= 65) & (raw <= 90)).sum())


def _measured(batches, schema: pa.Schema):
    for batch in batches:
        got = list(zip(*map(measure, (x.as_py() for x in batch.column("text"))), strict=True)) or [()] * 7
        rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, pa.int64()) for x in got)], schema=schema)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, _qr_copy: the text's hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.xxhash64(text).alias("_qr_copy"), F.col(text).alias("text"))
    out = StructType(rows.schema.fields[:3])
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"):
        out = out.add(n, LongType())
    arrow = to_arrow_schema(out)
    df = rows.mapInArrow(lambda it: _measured(it, arrow), out)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def rule_values(df: DataFrame) -> DataFrame:
    """One column r_<rule> a rule, larger is worse; 0 for documents without words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    values = {"symbols": share("n_symbols", "word_chars"), "repeats": share("n_repeat_words", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "capitals": share("n_capitals", "word_chars"), "long_words": share("word_chars", "n_words")}
    return df.withColumns({f"r_{k}": v for k, v in values.items()})


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial(n, p): the incomplete beta function of 1 - p at n - k and k + 1, by its continued fraction
    on the side of the mean where that converges fast."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), k + 1.0, 1.0 - p
    other = x > (a + 1) / (a + b + 2)
    if other:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # modified Lentz: the odd and the even step of each m
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h, m = d, 1
    while True:
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
        m += 1
    return 1 - front * h if other else front * h


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p under which k or fewer of n still have probability delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(k, n, min(max(mid, 1e-12), 1 - 1e-12)) > delta else (low, mid)
    return high


def choose_cutoff(good: list[int], bad: list[int], alpha: float, delta: float, enough: float = ENOUGH) -> float | None:
    """good[i], bad[i]: holdout documents of severity bin i (above i cutoffs). None if no cutoff can be proven."""
    n, over = sum(good), lambda h, c: sum(h[c + 1 :])
    valid = []
    for c in range(len(CUTOFFS) - 1, -1, -1):
        if upper_bound(over(good, c), n, delta) > alpha:
            break
        valid.append(c)
    if not valid:
        return None
    most = over(bad, valid[-1])
    return CUTOFFS[next(c for c in valid if over(bad, c) >= enough * most)]


def _chosen(batches, alpha: float, share: float):
    for batch in batches:
        strata, cutoffs = [], []
        for r in batch.to_pylist():
            by = {True: [0] * (len(CUTOFFS) + 1), False: [0] * (len(CUTOFFS) + 1)}
            for x in r["bins"]:
                by[x["good"]][x["bin"]] += x["count"]
            c = choose_cutoff(by[True], by[False], alpha, share)
            if c is not None:
                strata.append(r["stratum"])
                cutoffs.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(strata, pa.string()), pa.array(cutoffs, pa.float64())], names=["_qr_s", "cutoff"])


def fit(values: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, seed: int = SEED):
    """(scales by rule, rows (_qr_s, cutoff) of the strata with a provable cutoff) from values (measured, rule_values) and labels (doc_id, good boolean)."""
    known = values.filter(~F.col("base_failed")).join(labels.select(F.col("doc_id").alias("_qr_id"), "good"), F.col("doc_id") == F.col("_qr_id"))
    known = known.dropDuplicates(["stratum", "_qr_copy", "good"]).withColumn("half", F.expr(f"pmod(xxhash64({seed}, _qr_copy), 2)"))
    known = written(known.select("stratum", "good", "half", *(f"r_{r}" for r in RULES)), "rules")
    row = known.filter((F.col("half") == 0) & F.col("good")).agg(F.count("*").alias("n"), *(F.percentile_approx(f"r_{r}", SCALE_QUANTILE, 10_000).alias(r) for r in RULES)).first()
    if not row["n"]:
        return None, None
    scales = {r: max(float(row[r]), 0.01) for r in RULES}
    held = known.filter("half = 1").withColumn("bin", _bin(severity(scales)))
    counts = held.groupBy("stratum", "good", "bin").count()
    counts = written(counts.groupBy("stratum").agg(F.collect_list(F.struct("good", "bin", "count")).alias("bins")), "histograms")
    share = delta / max(1, counts.count())
    return scales, written(counts.mapInArrow(lambda it: _chosen(it, alpha, share), "_qr_s string, cutoff double"), "cutoffs")


def severity(scales: dict[str, float]):
    return F.greatest(*(F.col(f"r_{r}") / F.lit(scales[r]) for r in RULES))


def _bin(value):
    """How many cutoffs lie below the value."""
    k = F.ceil((F.log2(F.greatest(value, F.lit(1e-9))) + 1) * 16)
    return F.least(F.greatest(k, F.lit(0)), F.lit(len(CUTOFFS))).cast("int")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", **options) -> DataFrame:
    """measured() with severity, cutoff (null: base rules only) and kept."""
    values = written(rule_values(measured(docs, doc_id, text, stratum)), "measured")
    scales, cutoffs = fit(values, labels, **options)
    if scales is None:
        out = values.withColumn("severity", F.lit(None).cast("double")).withColumn("cutoff", F.lit(None).cast("double"))
    else:
        out = values.withColumn("severity", severity(scales)).join(cutoffs, F.col("stratum").eqNullSafe(F.col("_qr_s")), "left").drop("_qr_s")
    # by bin, as the counts were made
    above = F.coalesce(_bin(F.col("severity")) > F.round((F.log2("cutoff") + 1) * 16).cast("int"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~above)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, severity, cutoff."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")).filter("good is not null")
    out = judge(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "severity", "cutoff")
