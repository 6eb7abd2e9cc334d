import math
import random
import re
import zlib
from collections import Counter

from countloom.llm import lm

from .cases import DOCS, some_docs


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_KEYS", 50)
    rows = some_docs()
    got = lm.score_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    part = lambda d: zlib.crc32(b"" if d is None else str(d).encode())
    train = [r for r in rows if part(r[0]) % 5 != 1]
    c = Counter(t for r in train for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        ts = tokens(r[1])
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        want.append((r[0], part(r[0]) % 5 == 1, len(ts), sum(c[t] > 0 for t in ts), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    # The model: rebuilt from plain counts with the weights it learned.
    keep = [r for r in train if part(r[0]) // 5 % 5 != 0]
    held = [r for r in train if part(r[0]) // 5 % 5 == 0]
    pairs = lambda rs: [p for r in rs for p in zip([None, *tokens(r[1])], tokens(r[1]))]
    ck, pk = Counter(t for r in keep for t in tokens(r[1])), Counter(pairs(keep))
    kept = sum(ck.values())
    bucket = lambda x: x.bit_length()
    cell = lambda a, b: round(math.log(a / b) / lm.CELL) if a else 1
    hist = Counter((bucket(ck[u]), cell(pk[u, w], ck[u]), cell(ck[w], kept)) for u, w in pairs(held))
    import pandas as pd

    weights = lm.fit_weights(pd.DataFrame([(*k, n) for k, n in hist.items()], columns=["bucket", "bigram", "unigram", "n"]), len(ck))
    ct, pt = c, Counter(pairs(train))
    for r in got:
        if sum(q[0] == r.doc_id for q in rows) > 1:
            continue
        text = next(q[1] for q in rows if q[0] == r.doc_id)
        s = 0.0
        for u, w in pairs([(r.doc_id, text)]):
            lam = weights.get(bucket(ct[u]), weights[-1])
            s += math.log10(lam[0] * (pt[u, w] / ct[u] if ct[u] else 0) + lam[1] * ct[w] / n + lam[2] / (v + 1))
        assert abs(s - r.score) < 1e-6 * max(1, abs(s))


def test_beats_the_base_on_texts_it_has_not_seen(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(200)]
    follow = {w: rng.sample(vocab, 4) for w in vocab}
    rows = []
    for i in range(300):
        ws = [rng.choice(vocab)]
        while len(ws) < 60:
            ws.append(rng.choice(follow[ws[-1]]) if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}" if rng.random() < 0.3 else rng.choice(vocab))
            follow.setdefault(ws[-1], vocab)
        rows.append((i, " ".join(ws), "en", "s", 1, "x", "y"))
    held = lm.score_documents(spark.createDataFrame(rows, DOCS)).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > 0.8 * held["sum(base_score)"] and held["sum(score)"] < 0


def test_unknown_words_are_the_dearest(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda i: " ".join(rng.choices(vocab, k=50)) + f" own{i}"
    rows = [(i, text(i), "en", "s", 1, "x", "y") for i in range(200)]
    rows += [(1000 + i, " ".join(f"x{rng.random()}" for _ in range(50)), "en", "s", 1, "x", "y") for i in range(40)]
    got = lm.score_documents(spark.createDataFrame(rows, DOCS)).where("held_out").collect()
    each = {known: [r.score / r.n_tokens for r in got if (r.doc_id < 1000) == known] for known in (True, False)}
    assert each[True] and each[False] and max(each[False]) < min(each[True])


def test_probabilities_sum_to_one():
    """Over all known words and the unknown type, after seen and unseen contexts."""
    import pandas as pd

    cells = pd.DataFrame([(0, 1, -20, 30), (0, 1, 1, 9), (3, -5, -20, 40), (3, 1, 1, 3)], columns=["bucket", "bigram", "unigram", "n"])
    weights = lm.fit_weights(cells, 4)
    c, follows = [6, 3, 2, 1], [2, 1, 0, 0]
    for bucket, pairs in ((3, follows), (0, None)):
        lam = weights[bucket]
        p = [lam[1] * c[w] / sum(c) + lam[2] / 5 + (lam[0] * pairs[w] / sum(pairs) if pairs else 0) for w in range(4)]
        assert abs(sum(p) + lam[2] / 5 - 1) < 1e-12
    assert weights[0][0] == 0


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0
