import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from countloom.llm import packing
from countloom.llm.queries import tokenizer_path

from .cases import DOCS, some_docs


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_those_of_tokenizers(tokenizer):
    texts = ["", " ", "a", " a  b\n c \n", "don't I'll x's", "Été naïve ñ 12 345", "<|endoftext|> x", "x <|endoftext|>", "a b<|endoftext|>c <|endoftext|><|endof text|> d", "tab\there  x　y", "x\x1c y", "日本 語 😀 🎉!", "a\n\nb c  ", "é a"]
    texts += [r[1] for r in some_docs() if r[1]]
    got = packing.Encoder(tokenizer_path()).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("lengths,targets", [([5000, 70_000, 0, 13], [5000, 70_000, 0, 13]), ([10_000, 90_000, 3], [0.7, 0.3, 0.0]), ([0, 0], [1, 1]), ([1], [1.0]), ([1024, 1024], [1, 1])])
def test_schedule_gives_out_every_token_once(lengths, targets):
    phases = packing.schedule(lengths, targets)
    filled = defaultdict(list)
    for q, n in enumerate(lengths):
        pieces = list(packing.cut(0, n, q, phases))
        assert [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist() and sum(p[1] for p in pieces) == n
        for _, k, seq, off in pieces:
            filled[seq].append((off, k, q))
    for seq, parts in filled.items():
        at = 0
        for off, k, _ in sorted(parts):
            assert off == at
            at += k
        assert at == packing.WINDOW or seq == max(filled)
    whole, share = sum(targets) or 1, {q: t for q, t in enumerate(targets)}
    if phases and phases[0].count > 1:  # while all queues have tokens, each window has the target shares
        for seq in range(phases[0].count):
            for q, t in share.items():
                got = sum(k for _, k, qq in filled[seq] if qq == q)
                assert abs(got - packing.WINDOW * t / whole) <= 2


@pytest.mark.parametrize("small,targets", [([1015, 900, 513, 7, 1, 0], None), ([1015, 900, 513, 7, 1, 0], [0.35, 0.0002, 0.0003, 0.64, 0.0001, 0.0, 0.0094, 1e-7]), ([300] * 500, None)])
def test_small_queues_over_many_windows(small, targets):
    lengths = [1_800_000, *small, 3_300_000]
    phases = packing.schedule(lengths, targets or [float(n) for n in lengths])
    assert len(phases) <= 1 + len(lengths) * bool(targets)
    spans, whole = [], sum(lengths)
    for q, n in enumerate(lengths):
        pieces = [p for a in range(0, n, 700) for p in ((a + s, k, w, off) for s, k, w, off in packing.cut(a, min(700, n - a), q, phases))]
        assert [p[0] for p in pieces] == np.cumsum([0, *[p[1] for p in pieces]])[:-1].tolist() and sum(p[1] for p in pieces) == n
        spans += [(w * packing.WINDOW + off, k) for _, k, w, off in pieces]
        assert all(k > 0 and 0 <= off and off + k <= packing.WINDOW for _, k, _, off in pieces)
        if targets is None:  # the carried deficit stays small at any place of the queue
            assert all(abs(s - w * packing.WINDOW * n / whole) <= packing.WINDOW * n / whole + 5 for s, _, w, _ in pieces)
    spans.sort()
    assert [a for a, _ in spans] == np.cumsum([0, *[k for _, k in spans]])[:-1].tolist()


def test_documents_against_their_ids(spark, tokenizer):
    rows = some_docs() + [(109, "null source", None, None, 1, "x", "y")]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), tokenizer_path(), {"s0": 0.5, "s1": 0.5}, with_ids=True).collect()
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    seqs = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    for s, parts in seqs.items():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[k for _, k in sorted(parts)]])[:-1].tolist()
        assert s == max(seqs) or sum(k for _, k in parts) == 1024
    once = {r[0]: x for r, x in zip(rows, ids, strict=True) if sum(q[0] == r[0] for q in rows) == 1}
    for doc, x in once.items():
        pieces = sorted((r.start, r.ids) for r in got if r.doc_id == doc)
        assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == x


def test_each_of_many_sources_keeps_its_share(spark):
    text = "some words of a text " * 40
    rows = [(i, text, "en", f"s{i % 80}", 1, "x", "y") for i in range(800)] + [(1000 + i, text, "en", "rare", 1, "x", "y") for i in range(5)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = packing.pack(df, tokenizer_path()).collect()
    whole = sum(r.length for r in got)
    of = Counter((r.sequence_id, r.source) for r in got for _ in range(r.length))
    for seq in range(whole // packing.WINDOW):  # every window has every source in proportion
        assert all(abs(of[seq, f"s{k}"] - packing.WINDOW * 10 / 805) <= 4 for k in range(80)), seq
    got = packing.pack(df, tokenizer_path(), {"rare": 0.5, "s3": 0.5}).collect()
    of = Counter((r.sequence_id, r.source) for r in got for _ in range(r.length))
    assert abs(of[0, "rare"] - 512) <= 2 and abs(of[0, "s3"] - 512) <= 2
    assert sum(r.length for r in got) == whole == sum({r.doc_id: r.doc_tokens for r in got}.values())


@pytest.mark.parametrize("targets", [None, {"s3": 0.5, "absent": 0.5}])
def test_groups_of_sources_keep_their_sources_apart(spark, targets, monkeypatch):
    """With few groups, each of many sources; every one is still a queue of its own, and all tokens are given out once."""
    monkeypatch.setattr(packing, "GROUPS", 3)
    text = "some words of a text " * 30
    rows = [(i, text * (1 + i % 3), "en", f"s{i % 40}", 1, "x", "y") for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), tokenizer_path(), targets).collect()
    spans = sorted((r.sequence_id * packing.WINDOW + r.offset, r.length) for r in got)
    assert [a for a, _ in spans] == np.cumsum([0, *[k for _, k in spans]])[:-1].tolist()
    whole = sum(r.length for r in got)
    assert whole == sum({r.doc_id: r.doc_tokens for r in got}.values())
    total, of = Counter(), Counter()
    for r in got:
        total[r.source] += r.length
        of[r.sequence_id, r.source] += r.length
    if targets is None:
        for seq in range(whole // packing.WINDOW):
            assert all(abs(of[seq, s] - packing.WINDOW * n / whole) <= 6 for s, n in total.items()), seq
    else:
        assert of[0, "s3"] == packing.WINDOW


def test_one_very_long_text(spark, tokenizer):
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    got = packing.pack(spark.createDataFrame([(1, text, "en", "a", 1, "x", "y"), (2, "short", "en", "b", 1, "x", "y")], DOCS), tokenizer_path(), with_ids=True).collect()
    ids = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start))
    assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_a_vocabulary_that_is_too_large(tmp_path):
    import json

    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 70_000}}}))
    with pytest.raises(ValueError, match="above 65535"):
        packing.Encoder(f"{tmp_path}/t.json")


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_tasks_that_cut_get_few_documents_at_once(spark, monkeypatch):
    cut, most = packing._cut, packing.TEXTS_AT_ONCE

    def watched(with_ids):
        run = cut(with_ids)

        def few(batches):
            for b in batches:
                assert b.num_rows <= most
                yield b

        return lambda batches: run(few(batches))

    monkeypatch.setattr(packing, "_cut", watched)
    df = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('some words of ', id) AS text", "'a' AS source")
    assert packing.pack(df, tokenizer_path()).select("doc_id").distinct().count() == 3000


def test_the_schedule_starts_no_python_tasks_of_its_own(spark, monkeypatch):
    df = spark.range(20).selectExpr("id AS doc_id", "concat('some words of ', id) AS text", "concat('s', id % 3) AS source")
    targets = {"s1": 0.5, "absent": 0.5}
    usual = sorted(packing.pack(df, tokenizer_path(), targets).collect())

    def none(*args, **kwargs):
        raise AssertionError("rows went through Python tasks")

    monkeypatch.setattr(spark.sparkContext, "parallelize", none)
    assert sorted(packing.pack(df, tokenizer_path(), targets).collect()) == usual
    packing.pack(df, tokenizer_path()).collect()


def test_ids_that_are_cut_do_not_stay(spark):
    from urllib.parse import urlparse

    df = spark.range(20).selectExpr("id AS doc_id", "concat('some words of ', id) AS text", "'a' AS source")
    folder = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = packing.pack(df, tokenizer_path())
    assert not any(x.startswith("tokens-") for x in set(os.listdir(folder)) - before)
    assert sum(r.length for r in got.collect()) == sum({r.doc_id: r.doc_tokens for r in got.collect()}.values())


def test_encoded_words_do_not_stay_in_the_worker():
    import tracemalloc

    encoder = packing.Encoder(tokenizer_path())
    encoder.encode(["a first text"])
    tracemalloc.start()
    try:
        for i in range(0, 40_000, 4000):
            encoder.encode([" ".join(f"w{k}" for k in range(i, i + 4000))])
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()
