"""Quality classifier by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes score over hashed words and text
shapes. The mean evidence of a host, and of a path below it, gives that
site's rate: path rates are shrunk to their host's and host rates to the
global prior, the more the fewer documents they have; how much follows from
the spread between sites. A document's posterior then takes its path's rate
as prior, taken without the document itself, which is evidence already. All
site numbers come from grouped aggregation over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

#: Most labelled documents to learn from: those with the smallest hash of their id.
MAX_LABELLED = 20_000
FEATURES = 1 << 18
#: A feature counts if its likelihood-ratio statistic reaches this.
MIN_G2 = 18.0
TARGETS = ("quality", "toxic")
_MARKS = b"#$%&*|!"


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text: its lower-case words and some shapes of the whole."""
    raw = (text or "").encode("utf-8", "replace")
    ws = raw.split()
    n = len(ws)
    distinct = {w.strip(b".,;:!?\"'()").lower() for w in ws}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    step = lambda x, k=8: int(min(max(x, 0), 1) * k)
    shapes = [
        f"\0n{n.bit_length()}",
        f"\0m{min(40, len(raw) // max(n, 1))}",
        f"\0s{step(sum(w[-1] in _MARKS for w in ws) / max(n, 1))}",
        f"\0u{step(sum(w.isupper() for w in ws) / max(n, 1))}",
        f"\0d{step(len(distinct) / max(n, 1))}",
        f"\0l{step(len(set(lines)) / max(len(lines), 1))}",
    ]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(w) % FEATURES for w in [*distinct, *(s.encode() for s in shapes)]), np.int64))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [features(t.as_py()) for t in b.column(0)]
        rows = np.repeat(np.arange(b.num_rows), [len(x) for x in f])
        yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows)), b.column(2).take(pa.array(rows)), pa.array(np.concatenate(f))], ["quality", "toxic", "feature"])


def log_odds(counts: pd.DataFrame, target: str, ones: int, rows: int) -> tuple[np.ndarray, float]:
    """Weights of the features that tell the target's classes apart, and the prior's log odds.

    counts has, by feature, n documents and how many of them are of class 1.
    Weights are for presence, with half a document added to each cell.
    """
    w = np.zeros(FEATURES)
    n, a = counts["n"].to_numpy(float), counts[target].to_numpy(float)
    b, zeros = n - a, rows - ones
    if not ones or not zeros:
        return w, math.log((ones + 0.5) / (zeros + 0.5))
    cell = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)
    g2 = 2 * (cell(a, n * ones / rows) + cell(b, n * zeros / rows) + cell(ones - a, (rows - n) * ones / rows) + cell(zeros - b, (rows - n) * zeros / rows))
    use = g2 >= MIN_G2
    w[counts["feature"].to_numpy()[use]] = np.log((a[use] + 0.5) / (ones + 1)) - np.log((b[use] + 0.5) / (zeros + 1))
    return w, math.log((ones + 0.5) / (zeros + 0.5))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, tuple[np.ndarray, float]]:
    """Weights and prior of each target, from at most max_labelled labelled documents.

    Of conflicting labels of an id the smaller quality and the larger toxic
    count; of documents that share an id, one.
    """
    ids = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = materialize(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).withColumnRenamed("doc_id", "id"), "labelled")
    known = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id"))  # max_labelled ids at most
    # One row an id, so that repeated documents do not exceed the bound: the text with the smallest hash.
    known = known.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *[F.min(t).alias(t) for t in TARGETS])
    known = materialize(known.select("text", *TARGETS), "known")
    totals = known.agg(*[F.count(t).alias(t + "_n") for t in TARGETS], *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
    each = known.select("text", *[F.col(t).cast("int").alias(t) for t in TARGETS]).mapInArrow(_training, "quality int, toxic int, feature long")
    # A row for each of the FEATURES numbers at most.
    counts = each.groupBy("feature").agg(*[F.count(t).alias(t + "_n") for t in TARGETS], *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).toPandas()
    return {t: log_odds(counts.rename(columns={t + "_n": "n"}), t, int(totals[t]), int(totals[t + "_n"])) for t in TARGETS}


def _evidence(model: dict[str, tuple[np.ndarray, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py()) for t in b.column(3)]
            odds = [pa.array([float(np.clip(prior + w[x].sum(), -30, 30)) for x in f], pa.float64()) for w, prior in (model[t] for t in TARGETS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *odds], ["doc_id", "host", "path", "quality", "toxic"])

    return run


def _spread(groups: DataFrame, mean: str, total: str, n: str) -> Column:
    """How many documents the prior is worth, by moments: mean*(1-mean) / (variance between sites) - 1, in 1 .. 1e6."""
    rate = F.col(total) / F.col(n)
    var = F.sum(F.col(n) * F.pow(rate - F.col(mean), 2)) / F.sum(n)
    m = F.first(mean)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.coalesce(m * (1 - m) / F.when(var > 0, var) - 1, F.lit(1e6))))


def site_rates(evidence: DataFrame) -> DataFrame:
    """host, path, n, host_n and, for each target t, the sums of its posteriors (t, host_t), the global rate
    (t_prior) and how many documents that is worth (t_k)."""
    p = lambda t: 1 / (1 + F.exp(-F.col(t)))
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(p(t)).alias(t) for t in TARGETS])
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(t).alias("host_" + t) for t in TARGETS])
    top = hosts.agg(*[(F.sum("host_" + t) / F.sum("host_n")).alias(t + "_prior") for t in TARGETS])
    hosts = hosts.crossJoin(F.broadcast(top))  # one row
    worth = hosts.agg(*[_spread(hosts, t + "_prior", "host_" + t, "host_n").alias(t + "_k") for t in TARGETS])
    hosts = hosts.crossJoin(F.broadcast(worth)).withColumnRenamed("host", "h")  # one row
    return paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")


def path_rate(target: str, own: Column | float = 0.0, docs: int = 0) -> Column:
    """A path's rate, shrunk to its host's, which is shrunk to the global rate; without `docs` documents whose posteriors sum to own."""
    c = lambda x: F.col(x)
    k = c(target + "_k")
    host = (c("host_" + target) - own + k * c(target + "_prior")) / (c("host_n") - docs + k)
    return (c(target) - own + k * host) / (c("n") - docs + k)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, doc_quality, doc_toxic (own evidence), site_quality, site_toxic (its path's rate by the other
    documents), p_quality, p_toxic, kept.

    A row for each row of docs. An empty or null text has only the shape of
    an empty one; null hosts and paths are sites of their own. Without labels
    of both classes the evidence is the prior. Repeated rows are documents of
    their own. kept: p_quality of a half or more, and p_toxic below a half.
    """
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", *TARGETS))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), "text")
    found = materialize(held.mapInArrow(_evidence(model), "doc_id long, host string, path string, quality double, toxic double"), "evidence")
    site = F.xxhash64(F.struct("host", "path")).alias("site")
    sites = materialize(site_rates(found).withColumn("of_site", site).drop("host", "path"), "sites")
    sure = lambda x: 1 / (1 + F.exp(-x))
    own = found.select("doc_id", site, *[F.col(t).alias("odds_" + t) for t in TARGETS], *[sure(F.col(t)).alias("doc_" + t) for t in TARGETS])
    out = join_counted(own, sites, "site", "of_site", "n", found.count())
    out = out.withColumns({"site_" + t: path_rate(t, F.col("doc_" + t), 1) for t in TARGETS})
    logit = lambda c: F.ln(c / (1 - c))
    return out.select(
        "doc_id",
        *["doc_" + t for t in TARGETS],
        *["site_" + t for t in TARGETS],
        *[sure(F.col("odds_" + t) + logit(F.col("site_" + t)) - logit(F.col(t + "_prior"))).alias("p_" + t) for t in TARGETS],
    ).withColumn("kept", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5))
