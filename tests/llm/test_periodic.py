import hashlib
import random
import zlib

import numpy as np
import pytest

from countloom.llm import periodic

from .cases import DOCS, some_docs


def slow_runs(w):
    """All runs, by every lag and every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= max(q, 12 - q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def texts(seed):
    rng = random.Random(seed)
    for vocab in (1, 2, 3, 5, 30):
        for _ in range(25):
            w = []
            while len(w) < rng.choice((0, 5, 11, 12, 40, 150)):
                if rng.random() < 0.4:
                    w += [rng.choice(range(vocab)) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
                else:
                    w += [rng.randrange(vocab) if rng.random() < 0.8 else 1000 + len(w) for _ in range(rng.randrange(1, 12))]
            yield [str(x).encode() for x in w]
    yield [b"a"] * 700
    yield [b"a", b"b"] * 300 + [b"c"] + [b"a", b"b"] * 300
    fib = [b"a"], [b"a", b"b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("places", [7, 1_000_000])
def test_runs_against_brute_force(seed, places, monkeypatch):
    monkeypatch.setattr(periodic, "PLACES_AT_ONCE", places)
    docs = list(texts(seed))
    doc, start, length, period, dropped = periodic.runs_of(docs)
    at = 0
    for k, w in enumerate(docs):
        mine = doc == k
        got = list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
        want = slow_runs(w)
        assert got == want
        gone = dropped[at : at + len(w)]
        assert [x for x, g in zip(w, gone, strict=True) if not g] == slow_kept(w, want)
        at += len(w)


def test_splitting_leaves_no_rare_word():
    rng = random.Random(4)
    words = np.array([rng.randrange(60) for _ in range(3000)])
    segment = periodic.split_by_frequency(words, np.repeat(np.arange(6), 500))
    for s in set(segment[segment >= 0].tolist()):
        at = np.flatnonzero(segment == s)
        assert len(at) >= 12 and (np.diff(at) == 1).all()
        assert np.bincount(words[at])[words[at]].min() > 1


def test_a_long_text_of_one_word():
    doc, start, length, period, dropped = periodic.runs_of([[b"x"] * 300_000])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1])
    assert dropped.sum() == 299_999


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_report_against_brute_force(spark):
    rows = some_docs()
    again = " ".join(["p q r s"] * 9)
    rows += [(300 + i, f"start here {again} and {again} end", "en", "s", 1, "x", "y") for i in range(40)]
    got = periodic.run_report(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want, changed = [], 0
    for r in rows:
        w = (r[1] or "").encode().split()
        w = [x.decode() for x in w]
        n = len(w)
        if r[0] is not None and n:
            h = zlib.crc32(str(r[0]).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
                changed += 1
        runs = slow_runs(w) if n < 3000 else None
        if runs is None:
            want.append((r[0], None))
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        want.append((r[0], len(runs), *head, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(slow_kept(w, runs)))))
    assert changed > 3
    long = {r[0] for r in want if len(r) == 2}
    assert sorted((tuple(r) for r in got if r.doc_id not in long), key=str) == sorted((r for r in want if len(r) > 2), key=str)
    assert len(got) == len(rows)


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("a " * 20, 1, "k"), (None, 2, None)], "text string, runs int, `x.y` string")
    got = periodic.collapse_runs(docs)
    assert got.columns == ["x.y", "n_words", "runs", "collapsed"]
    a, b = sorted(got.collect(), key=lambda r: r["n_words"], reverse=True)
    assert (a["x.y"], a.n_words, a.collapsed, [tuple(x) for x in a.runs]) == ("k", 20, "a", [(0, 20, 1)])
    assert (b["x.y"], b.n_words, b.collapsed, b.runs) == (None, 0, "", [])
    assert periodic.run_report(spark.createDataFrame([], DOCS)).count() == 0
