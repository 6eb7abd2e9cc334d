import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from countloom.llm import merkle

from .cases import DOCS, some_docs

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(hashes, k):
    """Root, and for each leaf its steps (before, after)."""
    steps, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for s, i in zip(steps, at, strict=True):
            lo = i - i % k
            s.append(("".join(hashes[lo:i]), "".join(hashes[i + 1 : lo + k])))
        hashes = [H(*hashes[i : i + k]) for i in range(0, len(hashes), k)]
        at = [i // k for i in at]
    return hashes[0], steps


def brute(leaves, k):
    """leaves: (tree, order, hash). The same with subroot, root and steps."""
    keys = sorted({t for t, _, _ in leaves}, key=lambda t: (t is not None, (t or "").encode()))
    rows = {t: sorted((x for x in leaves if x[0] == t), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for t in keys}
    subs = {t: tree([x[2] for x in rows[t]], k) for t in keys}
    root, chains = tree([subs[t][0] for t in keys], k)
    return [(*x, subs[t][0], root, s + c) for t, c in zip(keys, chains, strict=True) for x, s in zip(rows[t], subs[t][1], strict=True)]


@pytest.mark.parametrize(("fanout", "height"), [(2, 1), (2, 2), (3, 1), (4, 2)])
def test_proofs_against_brute_force(spark, fanout, height):
    sizes = {None: 1, "a": 2, "b": 9, "é": 23, "z": 40, "Z": 13}
    rows = [(t, None if i == 3 else i // 2, H(str(t), str(i // 3))) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "t string, o long, leaf string").selectExpr("*", "'r' AS root", "'p' AS `x.y`", "1 AS pos", "2 AS rest").repartition(3)
    got = merkle.prove(df, "t", ["o"], fanout=fanout, height=height)
    assert got.columns == ["t", "o", "leaf", "x.y", "pos", "rest", "subroot", "root", "proof"]
    made = [(r.t, r.o, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got.collect()]
    assert sorted(made, key=str) == sorted(brute(rows, fanout), key=str)
    assert got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    doc, text, lang, source, n = r[:5]
    return H(*map(field, (doc, source, lang, None if n is None else n + more, text)))


def test_report_against_brute_force(spark):
    rows = [*some_docs(), (200, "x", "fr", "s", 1, "x", "y"), (201, "ü", None, None, None, None, None)]
    got = merkle.tampering_report(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    held = {}
    for lang, doc, h, sub, root, steps in brute([(r[2], r[0], leaf(r)) for r in rows], 2):
        held.setdefault((doc, h), []).append((sub, root, steps))
    want = []
    for r in sorted(rows, key=str):
        sub, root, steps = held[(r[0], leaf(r))].pop()
        f = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
        for b, a in steps:
            f = H(b, f, a)
        want.append((r[0], leaf(r), sub, root, H(*(x for s in steps for x in s)), f, f == root))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < sum(not r.verified for r in got) < len(rows) / 3


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(5, "a", "en", "s", 1, "", "")], DOCS)
    r = merkle.tampering_report(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H()
    assert merkle.tampering_report(one.where("doc_id < 0")).collect() == []
