"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic classifier on surface features, fitted on a bounded labelled sample, gives each document a
log-likelihood ratio. Grouped sums of its probabilities give every host, and every path below it, a
Beta posterior: a path is shrunk toward its host and a host toward the global rate, by strengths that
the spread between sites determines (method of moments). A document's own share is left out of the
prior that its site gives it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import fit_logistic, fold, logits, sample_ids
from .scratch import Scratch
from .wordvec import BLANK_SPLIT, split_batches, text_bytes, word_hashes

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 20_000
KEEP = 0.5
_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "line": [10],
    "stop": [ord(c) for c in ".?"], "comma": [ord(c) for c in ",;:"], "bang": [ord("!")],
    "symbol": [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]()\"-"],
}
_TABLE = np.zeros(256, np.int64)
for _k, _v in enumerate(_CLASSES.values(), 1):
    _TABLE[_v] = _k
N_FEATURES = 14


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; zeros for an empty one."""
    data, off = text_bytes(texts)
    n = len(off) - 1
    k = len(_CLASSES) + 1
    count = np.zeros(n * k)
    for a in range(0, len(data), 1 << 20):
        b = min(a + (1 << 20), len(data))
        doc = np.repeat(np.arange(n), np.clip(np.minimum(off[1:], b) - np.maximum(off[:-1], a), 0, None))
        count += np.bincount(doc * k + _TABLE[data[a:b]], minlength=n * k)
    count = count.reshape(n, k)
    size = np.maximum(1, np.diff(off)).astype(float)
    h, first = word_hashes(texts, BLANK_SPLIT)
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, n)
    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    if len(h):
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], fresh, n)
    w = np.maximum(1, words)
    per = lambda k: count[:, k] / size
    out = np.column_stack([
        per(1), per(3), per(8), per(7) * 10, count[:, 4] / w, count[:, 5] / w, count[:, 6] / w, repeats / w,
        (w - distinct) / w / np.log2(w + 2), np.minimum(size / w, 60), np.log(w), np.sqrt(per(8)),
        np.sqrt(repeats / w), np.sqrt(count[:, 1] / np.maximum(1, count[:, 1] + count[:, 2])),
    ])
    out[np.diff(off) == 0] = 0
    return out


def _score(model, rate: float, text: int):
    """Replace the text, which is the last column, number ``text``, by the log-likelihood ratio."""
    base = np.log(rate / (1 - rate))

    def run(batches):
        for b in split_batches(batches, text):
            x = features(b.column(text))
            ratio = np.clip(logits(x, model) - base, -20, 20)
            ratio[~x.any(1)] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[:text], pa.array(ratio)], names=[*b.schema.names[:text], "llr"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Model and base rate from at most ``sample`` labelled documents. No labels: a rate of one half."""
    ids = sample_ids(labels, "quality", sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in split_batches(batches, 1):
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["target", "x"]
            )

    got = rows.join(F.broadcast(ids), "doc_id").select("target", "text").mapInArrow(run, "target int, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(-1, N_FEATURES)
    y = got.column("target").to_numpy().astype(float)
    rate = float((y.sum() + 1) / (len(y) + 2))
    return fit_logistic(x, y), rate


def judge(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    host: Column | None = None,
    path: Column | None = None,
    sample: int = SAMPLE,
    keep: float = KEEP,
    whole: bool = False,
) -> DataFrame:
    """doc_id, host, path, llr, site_prior, quality (posterior, 0 to 1), kept, for every row.

    host and path default to the columns source and lang (a null is the site ''). whole: also doc, a struct
    of all columns of docs, so that rows are decided on as such, whatever their ids. Empty and null texts
    have no evidence: their posterior is their site's. Repeated rows count as rows of their site. Very long
    texts are measured whole. Empty tables give no rows.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model, rate = fit(docs, labels, sample)
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = docs.select(
        *carried, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"),
    )
    schema = rows.drop("text").schema.add("llr", "double")
    scored = scratch.table(rows.mapInArrow(_score(model, rate, len(schema) - 1), schema), "evidence")
    return posterior(scored, rate, scratch, keep)


def posterior(scored: DataFrame, rate: float, scratch: Scratch, keep: float = KEEP) -> DataFrame:
    """Combine (host, path, llr) of every row with the sites' posteriors; ``rate`` is the classifier's base rate. Other columns stay."""
    base = float(np.log(rate / (1 - rate)))
    p = 1 / (1 + F.exp(-(F.col("llr") + F.lit(base))))
    scored = scored.withColumn("p", p)
    paths = scratch.table(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("ss"), F.sum(F.col("hn") * F.col("hn")).alias("nn"),
    ).first()
    mean = (total.s + 1) / (total.n + 2) if total.n else 0.5
    strength = _strength(total.n or 0, total.s or 0.0, total.k or 0, total.ss or 0.0, total.nn or 0)
    hosts = hosts.withColumn("hm", (F.col("hs") + F.lit(strength * mean)) / (F.col("hn") + F.lit(strength)))
    # strength of hosts over their paths, from the spread of paths around their hosts
    within = paths.join(hosts, "host").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.countDistinct("host").alias("h"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)).alias("q"),
        F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("nh"),
    ).first()
    spread = 0.0
    if within.n and within.k > within.h:
        noise = mean * (1 - mean) * (within.k - within.h)
        spread = max(0.0, (within.q - noise) / max(1e-9, within.n - within.nh))
    below = _from_spread(mean, spread)
    sites = paths.join(hosts, "host").select("host", "path", "n", "s", "hm")
    out = scored.join(sites, ["host", "path"])
    prior = (F.col("s") - F.col("p") + F.lit(below) * F.col("hm")) / (F.col("n") - 1 + F.lit(below))
    prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
    out = out.withColumn("site_prior", prior)
    odds = F.col("llr") + F.log(F.col("site_prior") / (1 - F.col("site_prior")))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    out = out.withColumn("kept", F.col("quality") >= keep)
    return out.select(*[c for c in scored.columns if c != "p"], "site_prior", "quality", "kept")


def _from_spread(mean: float, spread: float) -> float:
    """Strength of a Beta prior whose variance is ``spread``, within 1 and a million."""
    return float(min(1e6, max(1.0, mean * (1 - mean) / spread - 1))) if spread > 1e-12 else 1e6


def _strength(n: float, s: float, k: int, ss: float, nn: float) -> float:
    """Strength of the global prior over k hosts: between-host variance by moments, weighted by size."""
    if k < 2 or not n:
        return 1e6
    mean = s / n
    q = ss - 2 * mean * s + mean * mean * n
    spread = max(0.0, (q - mean * (1 - mean) * (k - 1)) / max(1e-9, n - nn / n))
    return _from_spread(mean, spread)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where(fold("doc_id", 4) != 2)  # the rest measures accuracy
    return judge(docs, train, Scratch(spark, "quality"))
