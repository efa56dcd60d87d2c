"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence comes from two logistic heads (low quality, toxic) over hashed word presence and binned style
measures. Its host and path add theirs: the heads' mean badness is aggregated per (host, path) and per host in partial
aggregates, and each level is shrunk toward the one above, global -> host -> path, with prior strengths fitted to the
between-group variance (moments of the beta-binomial). The path posterior's log odds against the global prior, clipped
to `max_shift`, move the document's log odds; a sparse site moves nothing.

The heads are fitted on at most `max_train` labelled documents (those of lowest seeded hash, near copies by their
smallest word hashes counted once); only their word hashes reach the driver. Host and path statistics cover all rows.

Defined cases: null or empty text has no words and is judged by style and site; null hosts and paths are groups of
their own; ids may be null or repeated, since rows keep their columns and no join is by id outside the fit; no labels: every document
is kept with null scores; an empty table gives an empty result; helper columns carry a prefix, and input columns stay as they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, table, trim, working, written

MAX_TRAIN, SEED, BUCKETS, TERMS, LEAST_DOCS, BINS, MAX_SHIFT, MAX_BROADCAST_SITES = 8000, 41, 1 << 22, 400, 4, 8, 1.0, 50_000
STYLE = 8
#: A document goes at this posterior probability of being low quality or toxic. The heads separate widely; the gap is below a half.
CUTOFF = 0.25


def words_of(text: str | None) -> set[bytes]:
    """Distinct words, A-Z lower-cased, without punctuation at their ends."""
    return {w.strip(b".,;:!?\"'()[]") for w in set((text or "").encode().lower().split())}


def style_of(text: str | None) -> tuple[float, ...]:
    t = text or ""
    raw = np.frombuffer(t.encode(), np.uint8)
    n, words = max(1, len(raw)), t.encode().split()
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, int)
    lines = [x for x in t.split("\n") if x]
    return (
        float(sum(counts[ord(c)] for c in "#*$%&<>_~^=@")) / n,
        float(counts[65:91].sum()) / n,
        float(counts[33]) / n,
        float(counts[124]) / n,
        float(counts[48:58].sum()) / n,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        n / max(1, len(words)),
    )


def _hashes(words: set[bytes]) -> list[int]:
    return sorted({zlib.crc32(w) & (BUCKETS - 1) for w in words})


def _examples(batches):
    schema = pa.schema([("words", pa.list_(pa.int32())), ("style", pa.list_(pa.float32()))])
    for batch in batches:
        texts = [x.as_py() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([_hashes(words_of(t)) for t in texts], pa.list_(pa.int32())), pa.array([style_of(t) for t in texts], pa.list_(pa.float32())), batch.column("low"), batch.column("toxic")], schema=pa.schema([*schema, ("low", pa.int32()), ("toxic", pa.int32())]))


class Head:
    """A logistic model: word bucket -> weight, style bins with weights, bias."""

    def __init__(self, examples: list, y: np.ndarray, edges: list[np.ndarray]):
        words = [np.asarray(e[0], np.int64) for e in examples]
        every = np.concatenate(words) if words else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        terms, at, df = np.unique(every, return_inverse=True, return_counts=True)
        pos = np.bincount(at, weights=y[owner], minlength=len(terms))
        n, n1 = len(y), y.sum()
        expect = df * n1 / n
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(pos > 0, pos * np.log(pos / expect), 0) + np.where(df > pos, (df - pos) * np.log((df - pos) / (df - expect)), 0))
        g2 = np.where((df >= LEAST_DOCS) & (pos > expect) & (g2 > 16), g2, 0)
        keep = np.argsort(-g2, kind="stable")[:TERMS]
        keep = np.sort(keep[g2[keep] > 0])
        column = np.full(len(terms), -1)
        column[keep] = np.arange(len(keep))
        style = np.stack([e[1] for e in examples])
        x = np.zeros((n, len(keep) + STYLE * (BINS + 1)), np.float32)
        hit = column[at] >= 0
        x[owner[hit], column[at][hit]] = 1
        for k in range(STYLE):
            x[np.arange(n), len(keep) + k * (BINS + 1) + np.searchsorted(edges[k], style[:, k], side="right")] = 1
        w, self.bias = _logistic(x, y)
        self.words = dict(zip(terms[keep].tolist(), w[: len(keep)].tolist(), strict=True))
        self.style, self.edges = w[len(keep) :].reshape(STYLE, BINS + 1), edges

    def logit(self, hashed: list[int], style: np.ndarray) -> float:
        got = self.bias + sum(self.words[h] for h in self.words.keys() & set(hashed))
        return float(got + sum(self.style[k][np.searchsorted(self.edges[k], style[k], side="right")] for k in range(STYLE)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, rounds: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularized logistic regression by accelerated gradients; classes weighted toward balance."""
    n, d = x.shape
    n1 = max(1.0, float(y.sum()))
    weight = np.where(y > 0, np.sqrt(n / n1), 1.0).astype(np.float32)
    w, b, vw, vb, t = np.zeros(d, np.float32), float(np.log(n1 / max(1.0, n - n1))), np.zeros(d, np.float32), 0.0, 1.0
    row = float((x * x).sum(1).max()) + 1
    top = x.T @ (x @ np.ones(d, np.float32))
    step = 1 / (0.25 * max(float(top.max()), row) * float(weight.max()) + l2)
    vw, vb = w.copy(), b
    for _ in range(rounds):
        e = weight * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y)
        nw, nb = vw - step * (x.T @ e + l2 * vw), vb - step * float(e.sum())
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        vw, vb = nw + (old - 1) / t * (nw - w), nb + (old - 1) / t * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = SEED) -> list[Head] | None:
    """Heads (low quality, toxic) from labels (doc_id, quality, toxic); None without labels of either kind."""
    known = labels.filter("quality is not null and toxic is not null").select("doc_id", F.expr("cast(quality = 0 as int)").alias("low"), F.expr("cast(toxic = 1 as int)").alias("toxic"))
    chosen = known.filter("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "low", "toxic")
    out = rows.mapInArrow(_examples, "words array<int>, style array<float>, low int, toxic int").toArrow().to_pandas()
    found = sorted(zip(out["words"], out["style"], out["low"], out["toxic"], strict=True), key=lambda r: (r[0].tobytes(), r[2], r[3]))
    once = {(*r[0][:3].tolist(), r[2], r[3]): r for r in found}
    examples = [(r[0], np.asarray(r[1], float)) for r in once.values()]
    if not examples:
        return None
    edges = [np.unique(np.quantile([e[1][k] for e in examples], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(STYLE)]
    edges = [np.concatenate([e, np.full(BINS - len(e), np.inf)]) for e in edges]
    return [Head(examples, np.array([float(r[y]) for r in once.values()]), edges) for y in (2, 3)]


def _score_batches(batches, heads: list[Head], schema: pa.Schema, text: str):
    working("classifier")
    for batch in batches:
        z = np.zeros((2, batch.num_rows))
        for i, x in enumerate(batch.column(text)):
            t = x.as_py()
            hashed, style = [zlib.crc32(w) & (BUCKETS - 1) for w in words_of(t)], style_of(t)
            for k, head in enumerate(heads):
                z[k, i] = head.logit(hashed, style)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z[0]), pa.array(z[1])], schema=schema)


def scored(docs: DataFrame, heads: list[Head], text: str = "text") -> DataFrame:
    """docs with _qc_low and _qc_toxic, the heads' log odds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    out = StructType([*docs.schema.fields]).add("_qc_low", DoubleType()).add("_qc_toxic", DoubleType())
    arrow = to_arrow_schema(out)
    return docs.mapInArrow(lambda it: _score_batches(it, heads, arrow, text), out)


def badness():
    """1 - P(good quality) P(not toxic) from the two log odds."""
    return F.expr("1 - (1 / (1 + exp(_qc_low))) * (1 / (1 + exp(_qc_toxic)))")


def _strength(groups: DataFrame, mean: str) -> float:
    """Prior strength by moments: how little group means vary about `mean` beyond what their sizes explain."""
    r = groups.agg(F.sum(F.expr(f"n * pow(s / n - {mean}, 2)")).alias("v"), F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.expr(f"{mean} * (1 - {mean})")).alias("w"), F.sum(F.expr(f"n * {mean} * (1 - {mean})")).alias("p")).first()
    if not r["n"] or r["g"] < 2 or r["p"] <= 0:
        return 1e6
    between = (r["v"] - r["w"]) / r["n"]
    return float(np.clip(r["p"] / r["n"] / max(between, 1e-9) - 1, 5, 1e6))


def site_posteriors(scores: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(_qc_host, _qc_path, _qc_host_rate, _qc_path_rate, n) for each site, and the global rate, from scored rows."""
    paths = written(scores.groupBy(F.col(host).alias("_qc_host"), F.col(path).alias("_qc_path")).agg(F.count("*").alias("n"), F.sum(badness()).alias("s")), "sites")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = float(np.clip((total["s"] or 0.0) / max(1, total["n"] or 0), 1e-6, 1 - 1e-6))
    hosts = paths.groupBy("_qc_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k = _strength(hosts, f"{rate!r}D")
    hosts = hosts.select(F.col("_qc_host").alias("_qc_h"), F.expr(f"({k}D * {rate}D + s) / ({k}D + n)").alias("_qc_host_rate"))
    both = paths.join(hosts, F.col("_qc_host").eqNullSafe(F.col("_qc_h"))).drop("_qc_h")
    k = _strength(both, "_qc_host_rate")
    return both.select("_qc_host", "_qc_path", "_qc_host_rate", F.expr(f"({k}D * _qc_host_rate + s) / ({k}D + n)").alias("_qc_path_rate"), "n"), rate


def _posterior(scores: DataFrame, sites: DataFrame, rate: float, host: str, path: str, max_shift: float, cutoff: float) -> DataFrame:
    few = sites.limit(MAX_BROADCAST_SITES + 1).count() <= MAX_BROADCAST_SITES
    sites = sites.drop("n")
    out = scores.join(F.broadcast(sites) if few else sites, F.col(host).eqNullSafe(F.col("_qc_host")) & F.col(path).eqNullSafe(F.col("_qc_path")), "left").drop("_qc_host", "_qc_path")
    shift = F.greatest(F.lit(-max_shift), F.least(F.lit(max_shift), F.expr("ln(_qc_path_rate / (1 - _qc_path_rate))") - float(np.log(rate / (1 - rate)))))
    own = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), badness()))
    out = out.withColumn("_qc_posterior", 1 / (1 + F.exp(-(F.ln(own / (1 - own)) + shift))))
    return out.withColumn("_qc_kept", F.col("_qc_posterior") < cutoff)


def _judged(docs: DataFrame, labels: DataFrame, host: str, path: str, text: str, max_shift: float, cutoff: float, keep_text: bool, options: dict) -> DataFrame:
    """docs (without `text` unless keep_text) with _qc_low, _qc_toxic (log odds), _qc_host_rate, _qc_path_rate, _qc_posterior, _qc_kept."""
    heads = fit(docs, labels, **options)
    trim()  # the labelled sample's memory on the driver
    if heads is None:
        out = docs.withColumns({f"_qc_{c}": F.lit(None).cast("double") for c in ("low", "toxic", "host_rate", "path_rate", "posterior")}).withColumn("_qc_kept", F.lit(True))
        return out if keep_text else out.drop(text)
    rows = scored(docs, heads, text)
    scores = written(rows if keep_text else rows.drop(text), "scores")  # each text is scored once
    sites, rate = site_posteriors(scores, host, path)
    return _posterior(scores, written(sites, "posteriors"), rate, host, path, max_shift, cutoff)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", max_shift: float = MAX_SHIFT, cutoff: float = CUTOFF, **options) -> DataFrame:
    """docs without `text`, with _qc_low, _qc_toxic (log odds), host_rate, path_rate, posterior, kept; where docs has
    such columns, the new ones end in underscores."""
    out = _judged(docs, labels, host, path, text, max_shift, cutoff, False, options)
    return out.withColumnsRenamed({f"_qc_{c}": free_name(docs, c) for c in ("host_rate", "path_rate", "posterior", "kept")})


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: str = "text", max_shift: float = MAX_SHIFT, cutoff: float = CUTOFF, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, columns unchanged."""
    return _judged(docs, labels, host, path, text, max_shift, cutoff, True, options).filter("_qc_kept").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: doc_id, source, lang, p_low, p_toxic, host_rate, path_rate, posterior, kept for all documents."""
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "labels"))
    p = lambda c: F.expr(f"1 / (1 + exp(-{c}))")
    return out.select("doc_id", "source", "lang", p("_qc_low").alias("p_low"), p("_qc_toxic").alias("p_toxic"), "host_rate", "path_rate", "posterior", "kept")
