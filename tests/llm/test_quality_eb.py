import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from countloom.llm import quality_eb as eb

from .cases import DOCS, some_docs

LABELS = "doc_id long, quality int, toxic int"


def planted(n=600):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        ws = [f"word{rng.randrange(300)}" for _ in range(80)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            ws = [w + "###" for w in ws]
        if toxic:
            ws[10:10] = ["nastyword"] * 2
        docs.append((i, " ".join(ws), "en" if i % 2 else "fr", f"s{i % 4}", 1, "x", "y"))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_finds_planted_kinds_beyond_the_labels(spark):
    docs, labels = planted()
    got = eb.classify(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    wrong = [r.doc_id for r in got if r.kept != bool(r.doc_id % 5 and r.doc_id % 7)]
    assert len(got) == len(docs) and len(wrong) <= len(docs) * 0.01


EVIDENCE = "doc_id long, host string, path string, quality double, toxic double"


def brute_rates(rows, at):
    """Path rates of one target, without and with leaving a row out, by plain sums."""
    p = [1 / (1 + math.exp(-r[at])) for r in rows]
    paths, hosts = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        paths[r[1], r[2]].append(x), hosts[r[1]].append(x)
    prior = sum(p) / len(p)
    var = sum(len(v) * (sum(v) / len(v) - prior) ** 2 for v in hosts.values()) / len(p)
    k = min(1e6, max(1.0, prior * (1 - prior) / var - 1)) if var else 1e6
    rate = lambda r, own, docs: (sum(paths[r[1], r[2]]) - own + k * (sum(hosts[r[1]]) - own + k * prior) / (len(hosts[r[1]]) - docs + k)) / (len(paths[r[1], r[2]]) - docs + k)
    return prior, [rate(r, 0, 0) for r in rows], [rate(r, x, 1) for r, x in zip(rows, p, strict=True)]


def test_site_rates_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["p", "q", None]), rng.gauss(1, 2), rng.gauss(-3, 1)) for i in range(300)] + [(900, "alone", "p", 3.0, -5.0)]
    df = spark.createDataFrame(rows, EVIDENCE)
    own = {t: 1 / (1 + F.exp(-F.col("own_" + t))) for t in eb.TARGETS}
    sites = eb.site_rates(df).withColumnsRenamed({"host": "h", "path": "q"})
    joined = df.withColumnsRenamed({t: "own_" + t for t in eb.TARGETS}).join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    got = {r.doc_id: r for r in joined.select("doc_id", "quality_prior", *[eb.path_rate(t).alias(t + "_rate") for t in eb.TARGETS], *[eb.path_rate(t, own[t], 1).alias(t + "_without") for t in eb.TARGETS]).collect()}
    for at, t in ((3, "quality"), (4, "toxic")):
        prior, rates, without = brute_rates(rows, at)
        for r, x, y in zip(rows, rates, without, strict=True):
            assert abs(got[r[0]][t + "_rate"] - x) < 1e-9 and abs(got[r[0]][t + "_without"] - y) < 1e-9
    assert abs(got[900].quality_without - got[900].quality_prior) < 1e-9  # an only document's site knows nothing else


def test_weights_against_brute_force(spark):
    """The evidence is a naive Bayes sum over the features whose likelihood ratio counts."""
    docs, labels = planted(200)
    model = eb.learn(spark.createDataFrame(docs, DOCS).select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    of = {d[0]: set(eb.features(d[1]).tolist()) for d in docs}
    for at, t in ((1, "quality"), (2, "toxic")):
        ones, rows = sum(x[at] for x in labels), len(labels)
        want = {}
        for f in set().union(*(of[x[0]] for x in labels)):
            a, b = sum(x[at] for x in labels if f in of[x[0]]), sum(1 - x[at] for x in labels if f in of[x[0]])
            cells = [(a, ones * (a + b) / rows), (b, (rows - ones) * (a + b) / rows), (ones - a, ones * (rows - a - b) / rows), (rows - ones - b, (rows - ones) * (rows - a - b) / rows)]
            if 2 * sum(x * math.log(x / e) for x, e in cells if x) >= eb.MIN_G2:
                want[f] = math.log((a + 0.5) / (ones + 1)) - math.log((b + 0.5) / (rows - ones + 1))
        w, prior = model[t]
        assert want and {int(f): round(w[f], 9) for f in np.flatnonzero(w)} == {f: round(x, 9) for f, x in want.items()}
        assert abs(prior - math.log((ones + 0.5) / (rows - ones + 0.5))) < 1e-12


def test_conflicting_labels_and_repeated_documents(spark):
    docs, labels = planted(100)
    twice = labels + [(i, 1, 0) for i, _, _ in labels]
    d = spark.createDataFrame(docs + docs[:30], DOCS).select("doc_id", "text")
    model, again = eb.learn(d, spark.createDataFrame(labels, LABELS)), eb.learn(d, spark.createDataFrame(twice, LABELS))
    assert all((model[t][0] == again[t][0]).all() and model[t][1] == again[t][1] for t in eb.TARGETS)


def test_awkward_rows_and_no_labels(spark):
    rows = some_docs()
    out = eb.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(rows) and all(0 <= r.p_quality <= 1 for r in out)
    assert eb.classify(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
