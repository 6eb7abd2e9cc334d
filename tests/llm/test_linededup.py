import hashlib
from collections import defaultdict

import pytest

from countloom.llm import linededup

from .cases import DOCS, some_docs

BLANK = " \t\x0b\f\r"


def brute(rows, ratio, min_pages):
    total, seen, long = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in rows:
        total[r[3]].add(r[1])
        for x in {y.strip(BLANK) for y in (r[1] or "").split("\n")} - {""}:
            seen[r[3], x].add(r[1])
            if len(x.split()) > linededup.LONG_WORDS:
                long[x].add(r[1])
    common = {k for k, n in seen.items() if len(n) >= min_pages and len(n) > ratio * len(total[k[0]])}
    # One text keeps a passage: the one with the smallest key.
    passages = {x: min(n, key=lambda t: hashlib.md5(t.encode()).hexdigest()[:15]) for x, n in long.items() if len(n) >= linededup.LONG_PAGES}
    want = []
    for r in rows:
        if r[1] is None:
            want.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        keep = [x for x in lines if (r[3], x.strip(BLANK)) not in common and passages.get(x.strip(BLANK), r[1]) == r[1]]
        want.append((r[0], "\n".join(keep), sum(bool(x.strip(BLANK)) for x in lines), len(lines) - len(keep)))
    return want, common, passages


@pytest.mark.parametrize("ratio,min_pages", [(linededup.RATIO, linededup.MIN_PAGES), (0.3, 2)])
def test_against_brute_force(spark, ratio, min_pages):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(r[0], ("common line \n" if i % 2 else "") + (f" {passage}\n" if i % 9 == 0 else "") + (r[1] or "") if r[1] is not None else None, *r[2:]) for i, r in enumerate(some_docs())]
    want, common, passages = brute(rows, ratio, min_pages)
    assert any(x == "common line" for _, x in common) and passage in passages
    got = linededup.drop_boilerplate(spark.createDataFrame(rows, DOCS).repartition(4), ratio=ratio, min_pages=min_pages).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == sorted(want, key=str)
    assert set(got[0].asDict()) == {*spark.createDataFrame(rows, DOCS).columns, "n_lines", "n_dropped"}


def test_copies_count_once(spark):
    """A page that occurs many times keeps its lines; a line on many different pages goes."""
    long = " ".join(f"q{i}" for i in range(80))
    rows = [(i, f"a page of its own\n{long}", "en", "s", 1, "x", "y") for i in range(40)] + [(100 + i, f"foot\npage {i}", "en", "s", 1, "x", "y") for i in range(10)]
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == rows[0][1] and got[104] == "page 4"


def test_columns_with_clashing_names(spark):
    names = ["doc_id", "text", "source", "n_chars", "n_lines", "n_dropped", "kept", "row", "host", "page", "x.y", "of_page"]
    rows = [(i, f"same\nown {i}", "s", 9, "mine", "own", "k", "r", "h", "p", f"dot {i}", "o") for i in range(6)] + [(9, None, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, n_lines string, n_dropped string, kept string, row string, host string, page string, `x.y` string, of_page string")
    out = linededup.clean_documents(df)
    assert out.columns == names and out.schema == df.schema
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got[3] == (3, "own 3", "s", 5, *rows[3][4:]) and got[9] == rows[6]


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert linededup.drop_boilerplate(empty).count() == 0 and linededup.clean_documents(empty).count() == 0


def test_a_passage_of_near_copies_stays_once(spark):
    """Three near copies on three sources, through line dedup and near duplicates: the corpus keeps the long paragraph once."""
    from countloom.llm import simhash

    passage = " ".join(f"q{i}" for i in range(300))
    docs = [(i, f"title {i}\n{passage}\nend {i}", "en", f"s{i}", 1, "x", "y") for i in range(3)]
    rest = [(10 + i, " ".join(f"w{i}x{k}" for k in range(60)), "en", f"s{i % 3}", 1, "x", "y") for i in range(20)]
    clean = linededup.clean_documents(spark.createDataFrame(docs + rest, DOCS))
    left = simhash.keep_one(clean).collect()
    assert sum(passage in r.text for r in left) == 1
    assert {r.doc_id: r.text for r in left if r.doc_id >= 10} == {r[0]: r[1] for r in rest}


def test_very_long_texts_and_the_spectrum(spark):
    lines = [f"line {i} " + " ".join(f"v{i}y{k}" for k in range(8)) for i in range(60_000)]
    rows = [(i, "\n".join([*(["site foot"] if i % 2 else []), *lines]) if i < 2 else f"site foot\nown {i}", "en", "s", 1, "x", "y") for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df).collect()}
    assert got[1].text == "\n".join(lines) == got[0].text and (got[1].n_lines, got[1].n_dropped) == (60_001, 1) and got[9].text == "own 9"
    bins = {round(r.from_share, 3): (r.lines, r.pages) for r in linededup.spectrum(df).collect()}
    assert bins == {0.707: (1, 29), 0.062: (60_000, 120_000)}
