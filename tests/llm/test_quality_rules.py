import math
import random
import re
from collections import Counter

from countloom.llm import quality_rules as qr

from .cases import DOCS, some_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count = Counter(wins)
    hit = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_against_brute_force(spark):
    rows = some_docs() + [(200, "a b c d e f g h " * 3 + "x y", "en", "s", 1, "x", "y"), (201, "p\nq\n\np\nq ", "en", "s", 1, "x", "y")]
    got = qr.with_text_stats(spark.createDataFrame(rows, DOCS)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(r.text), r.doc_id


def planted(n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        ws = [f"word{rng.randrange(500)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            ws = [w + "###" for w in ws] if i % 8 else [w.upper() + "!!" for w in ws]
        docs.append((i, " ".join(ws), "en", "s", 1, "x", "y"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_learns_the_planted_kinds(spark):
    docs, labels = planted()
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in qr.judge_documents(d, la).where("kept").collect()}
    assert kept == {i for i in range(len(docs)) if i % 4}
    good = qr.keep_good(d, la)
    assert good.columns == d.columns and {r.doc_id for r in good.collect()} == kept


def test_no_labels_and_no_rows(spark):
    la = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = some_docs()
    out = qr.judge_documents(spark.createDataFrame(rows, DOCS), la).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (not r.base_failed) for r in out)
    assert qr.judge_documents(spark.createDataFrame([], DOCS), la).count() == 0


def brute_rules(rows):
    """The decision list by plain loops over rows of (grow, bad, features)."""
    names = list(qr.rule_features())
    exact = lambda v, p: sorted(v)[max(0, math.ceil(round(p * len(v), 9)) - 1)]
    cuts = {}
    for f in range(len(names)):
        seen = sorted({exact([x[f] for g, b, x in rows if b == kind], i / (qr.THRESHOLDS - 1)) for kind in (0, 1) for i in range(qr.THRESHOLDS)})
        if len(seen) > 1:
            cuts[f] = [((a + b) / 2, (b - a) / (seen[-1] - seen[0])) for a, b in zip(seen, seen[1:], strict=False)]
    hold = lambda x, rule: all((x[f] > c) == above for f, above, c in rule)
    count = lambda rs, rule: tuple(sum(b == kind and hold(x, rule) for _, b, x in rs) for kind in (1, 0))
    left, rules = rows, []
    while len(rules) < qr.MAX_RULES:
        grow, prune = [r for r in left if r[0]], [r for r in left if not r[0]]
        rule, (p, n) = (), count(grow, ())
        while p and n and len(rule) < qr.MAX_CONDITIONS:
            best, most = None, (0.0, 0.0)
            for f, cs in cuts.items():
                for c, gap in cs:
                    for above in (True, False):
                        pp, nn = count(grow, (*rule, (f, above, c)))
                        g = qr._gain(pp, nn, p, n)
                        if pp and g > 1e-9 and (round(g, 9), gap) > most:
                            best, most = ((f, above, c), pp, nn), (round(g, 9), gap)
            if not best:
                break
            rule, p, n = (*rule, best[0]), best[1], best[2]
        if not rule:
            break
        scored = [count(prune, rule[: k + 1]) for k in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in scored]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = scored[k]
        if p + n < qr.MIN_COVERED or p < qr.MIN_PRECISION * (p + n):
            break
        rules.append(rule[: k + 1])
        left = [r for r in left if not hold(r[2], rule[: k + 1])]
    return [[(names[f], above, round(c, 9)) for f, above, c in r] for r in rules]


def test_learned_rules_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for i in range(240):
        ws = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        kind = rng.randrange(4)
        if kind == 1:
            ws = [w + "#" * rng.randrange(3) for w in ws]
        if kind == 2 and rng.random() < 0.8:
            ws = [w.upper() + "!" for w in ws]
        rows.append((i, " ".join(ws), int(kind in (1, 2) and rng.random() < 0.9)))
    held = qr.with_text_stats(spark.createDataFrame(rows, "doc_id long, text string, bad int"))
    flat = held.select((F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(3)) < 2).alias("g"), "bad", F.array(*qr.rule_features().values()).alias("x")).collect()
    want = brute_rules([(r.g, r.bad, list(r.x)) for r in flat])
    assert want and [[(c.feature, c.above, round(c.threshold, 9)) for c in r] for r in qr.learn_rules(held)] == want


def test_repeated_and_conflicting_labels(spark):
    docs, labels = planted()
    d = spark.createDataFrame(docs + docs[:40] * 3, DOCS)
    la = spark.createDataFrame(labels + [(i, 1, 0) for i, q, _ in labels if not q], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in qr.judge_documents(d, la).where("kept").collect()} == {i for i in range(len(docs)) if i % 4}
