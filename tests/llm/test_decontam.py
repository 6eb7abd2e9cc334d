import random

import numpy as np
import pytest

from countloom.llm import decontam

from .cases import DOCS, some_docs

ITEM = "item_id long, text string, extra string"


def planted(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 40))) + ".", "x") for i in range(20)]
    items += [(50, "four short words only", "x"), (51, "too short", "x"), (52, None, "x"), (53, "", "x"), (None, items[3][1], "x")]
    docs, want = [], set()
    for i in range(80):
        ws = [word() for _ in range(rng.randrange(0, 200))]
        if i % 4 == 0:
            k = rng.randrange(20)
            part = items[k][1].upper().replace(".", "!").split() if i % 8 else items[k][1].split()
            for j in range(0 if i % 16 else 2, len(part), 6) if i % 8 == 0 else []:
                part[j] = word()  # every sixth word replaced
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part
            want.add((1000 + i, k))
        elif i % 4 == 1:
            ws[3:3] = items[i % 20][1].split()[:6]  # too little to be a leak
        docs.append((1000 + i, " ".join(ws), "en", "s", 1, "x", "y"))
    docs.append((2000, "And then four: SHORT words only; too short", "en", "s", 1, "x", "y"))
    want |= {(2000, 50)} | {(d, None) for d, k in want if k == 3}
    return items, docs, want


@pytest.mark.parametrize("block_words", [10**6, 100])
def test_finds_all_planted_and_nothing_else(spark, block_words):
    items, docs, want = planted()
    d, b = spark.createDataFrame(docs + some_docs(), DOCS).repartition(3), spark.createDataFrame(items, ITEM)
    got = decontam.find_leaks(d, b, block_words=block_words).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    left = decontam.drop_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r[0]) for r in docs + some_docs() if r[0] not in {x for x, _ in want})


def test_a_mask_ignores_its_gaps():
    h = decontam.word_hashes("a b c d e f g")
    other = decontam.word_hashes("a b c X e f g")
    gap = ["1110111"]
    assert np.array_equal(next(decontam.seed_hashes(h, gap)), next(decontam.seed_hashes(other, gap)))
    assert not np.array_equal(next(decontam.seed_hashes(h, ["1111111"])), next(decontam.seed_hashes(other, ["1111111"])))


@pytest.mark.parametrize("block_words", [10**6, 100])
def test_long_short_and_unspaced_items(spark, block_words):
    long = [f"w{i}" for i in range(2000)]
    han = "".join(chr(0x4E00 + i) for i in range(40))
    items = [(1, " ".join(long), "x"), (2, han, "x"), (3, "Grand Slam!", "x"), (4, "!?", "x"), (5, "天地", "x")]
    texts = {10: "a b " + " ".join(long[50:950]), 11: "q " + " ".join(long[700:713]) + " r", 12: "q " + " ".join(long[700:710]) + " r",
             13: f"見{han[:30]}終", 14: "first line\ngrand  slam\nend", 15: "a grand slam it was", 16: "!?", 17: "x\n天地。\n", 18: "見天地終"}
    docs = [(i, t, "en", "s", 1, "x", "y") for i, t in texts.items()]
    got = decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEM), block_words=block_words).collect()
    assert sorted(tuple(r) for r in got) == [(10, 1, 900, 2000, 2, 901), (11, 1, 13, 2000, 1, 13), (13, 2, 30, 40, 1, 30), (14, 3, 2, 2, 2, 3), (17, 5, 2, 2, 1, 2)]


def test_a_clean_text_stays_beside_a_leak_of_the_same_id(spark):
    items, _, _ = planted()
    leak = items[3][1]
    docs = [(i, t, "en", "s", 1, "x", "y") for i, t in ((None, leak), (None, "nothing of note here"), (None, None), (7, leak), (7, "quite another text"), (7, leak))]
    left = decontam.drop_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEM)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [(None, "nothing of note here"), (None, None), (7, "quite another text")]))


def test_the_join_gives_what_the_block_gives(spark):
    items, docs, _ = planted(9)
    items += [(60, "same two words", "x"), (61, "same two words", "x"), (None, "same two words", "x"), (62, items[0][1], "x"), (63, "five words stand in here", "x")]
    docs += [(3000 + i, "a b\nSame two words\nc d e f\nsame two WORDS.", "en", "s", 1, "x", "y") for i in range(5)]
    docs += [(3000, "a b\nSame two words\nc d e f\nsame two WORDS.", "en", "s", 1, "x", "y"), (None, items[4][1] + " " + items[5][1], "en", "s", 1, "x", "y"), (3100, "say: five words stand in here", "en", "s", 1, "x", "y")]
    d, b = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEM)
    whole, joined = (sorted((str(tuple(r)) for r in decontam.find_leaks(d, b, block_words=w).collect())) for w in (10**6, 1))
    assert whole == joined and len(whole) > 20


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BITS", 1 << 10)
    items, docs, want = planted()
    got = decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEM), block_words=1).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_empty(spark):
    items, docs, _ = planted()
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEM)
    for words in (10**6, 1):
        assert decontam.find_leaks(no_docs, spark.createDataFrame(items, ITEM), block_words=words).count() == 0
    assert decontam.find_leaks(spark.createDataFrame(docs, DOCS), no_items).count() == 0
    assert decontam.drop_leaks(spark.createDataFrame(docs, DOCS), no_items).count() == len(docs)


def slow_leaks(docs, items, shared=None):
    """Leaks by comparing words themselves: every place of a text with every place of an item under every mask."""
    import re

    shared = decontam.SHARED if shared is None else shared
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    words = [split(t) for _, t in items]
    masks = [m for m in decontam.MASKS] + ["1" * n for n in sorted({len(w) for w in words}) if decontam.MIN_WORDS <= n < decontam.SHORTEST]
    of = lambda w: [m for m in masks if len(w) == len(m) or (len(w) >= decontam.SHORTEST and m in decontam.MASKS)]
    at = lambda w, m, p: (m, tuple(w[p + j] for j, c in enumerate(m) if c == "1"))
    having = {}
    for w in {tuple(w) for w in words}:
        for m in of(w):
            for p in range(len(w) - len(m) + 1):
                having.setdefault(at(w, m, p), set()).add(w)
    out = []
    for doc, text in docs:
        h = split(text)
        seen = {}
        for m in masks:
            for p in range(len(h) - len(m) + 1):
                seen.setdefault(at(h, m, p), []).append(p)
        for (item, _), w in zip(items, words, strict=True):
            if len(w) < decontam.MIN_WORDS:
                continue
            windows = [(at(w, m, p), p, len(m)) for m in of(w) for p in range(len(w) - len(m) + 1)]
            common = [x for x in windows if len(having[x[0]]) > shared]
            own = [not any(p <= i < p + n for _, p, n in common) for i in range(len(w))]
            own = own if any(own) else [True] * len(w)
            offsets = {q - p for k, p, _ in windows if len(having[k]) <= shared for q in seen.get(k, [])}
            matched, most = set(), 0
            for d in offsets:
                pairs = [i for i in range(len(w)) if 0 <= i + d < len(h)]
                same = [h[i + d] == w[i] for i in pairs]
                best, seg = 0, None
                for a in range(len(pairs)):
                    total = 0
                    for b in range(a, len(pairs)):
                        total += 1 if same[b] else -1
                        if total > best:
                            best, seg = total, (a, b + 1)
                if seg:
                    hit = {pairs[j] for j in range(*seg) if same[j]}
                    matched |= hit
                    most = max(most, sum(own[i] for i in hit))
            m_own = sum(own[i] for i in matched)
            if len(matched) >= decontam.MIN_WORDS and m_own and (m_own >= decontam.MIN_COVERAGE * sum(own) or most >= decontam.MIN_ALIGNED):
                out.append((doc, item, len(matched), len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [0, 10**9])
@pytest.mark.parametrize("shared", [2, 20])
def test_against_a_quadratic_aligner(spark, block_words, shared, monkeypatch):
    monkeypatch.setattr(decontam, "SHARED", shared)
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    some = lambda n: rng.choices(vocab, k=n)
    prompt, tail = some(15), some(9)
    items = []
    for i in range(24):
        w = some(rng.choice((5, 6, 9, 14, 25)))
        items.append((i, " ".join((prompt if i % 2 else []) + w + (tail if i % 5 == 0 else []))))
    docs = []
    for i in range(40):
        w = some(30)
        if i % 3 == 0:  # an item, with some words replaced
            quote = items[rng.randrange(24)][1].split()
            for _ in range(rng.randrange(0, 4)):
                quote[rng.randrange(len(quote))] = rng.choice(vocab)
            cut = rng.randrange(0, 4)
            w = w[:10] + quote[cut:] + w[10:]
        if i % 7 == 0:
            w += prompt
        docs.append((i, " ".join(w)))
    want = slow_leaks(docs, items)
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert sorted((r.doc_id, r.item_id, r.matched_words, r.item_words) for r in got.collect()) == want
    assert len(want) >= 8


@pytest.mark.parametrize("block_words", [0, 10**9])
def test_a_shared_prompt_leaks_nothing(spark, block_words):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choices([f"v{i}" for i in range(5000)], k=n))
    prompt = some(14)
    items = [(i, f"{prompt} {some(20)}") for i in range(300)]
    # Items of a template: each differs from the others by two words far apart, so that no window is rare.
    a, b = some(12), some(12)
    items += [(1000 + i, f"{a} x{i // 30} {b} y{i % 30} {a}") for i in range(900)]
    docs = [(i, f"{some(30)} {prompt} {some(30)}") for i in range(20)]
    docs += [(100 + i, f"{some(10)} {items[i][1]} {some(5)}") for i in range(5)]
    docs += [(200, items[301][1]), (300, " ".join(items[7][1].split()[14:]))]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.item_id)
    assert {k: v for k, v in found.items() if k < 200} == {100 + i: {i} for i in range(5)}
    assert 1001 in found[200] and found[300] == {7}
    assert len(got) < 1200  # the template's items among themselves, and no item by its prompt


@pytest.mark.parametrize("block_words", [0, 10**9])
def test_an_item_without_rare_windows_is_found_by_any_of_them(spark, block_words):
    """The document has most words of a template, but none of the windows that the fewest items share."""
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices([f"v{i}" for i in range(5000)], k=n))
    a, b, c = some(12), some(12), some(12)
    items = [(i, f"{a} x{i // 25} {b} y{i % 25} {c}") for i in range(625)]
    docs = [(1, f"{some(20)} {b} z {c} {some(20)}"), (2, f"{some(20)} {b[: len(b) // 2]} {some(20)}")]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert sorted((r.doc_id, r.item_id, r.matched_words) for r in got) == [(1, i, 24) for i in range(625)]
