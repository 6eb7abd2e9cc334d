from collections import Counter, defaultdict

import pytest

from countloom.llm import html_template as ht

PAGES = "page_id long, url string, html string, text string, host string"


def page(i, body, host="a.example.com"):
    html = f'<!DOCTYPE html><html><head><title>T {i}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/{i}">menu {i}</a></ul></nav>{body}<footer>&copy; {host}</footer></body></html>'
    return (i, f"https://{host}/p/{i}?x=1", html, "x", "y")


def extract(spark, rows, **kw):
    return {r.page_id: r.text for r in ht.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3), **kw).collect()}


def test_article_is_kept_whole(spark):
    art = '<div class="ad">buy</div><article><h1>Head &amp; {i}</h1><p><b>first<br>same line\n on all pages<p>own   text {i} &lt;b&gt;<form>f</form><div class="comments"><p>nice</div><aside>side</aside></article>'
    rows = [page(i, art.replace("{i}", str(i))) for i in range(8)]
    rows += [(100, None, None, "x", "y"), (101, "odd", "", "x", "y"), (102, "https://a.example.com/cut", "<html><body><article><p>open &am", "x", "y"), rows[0]]
    got = ht.extract_pages(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Head & 3 first same line on all pages own text 3 <b>"
    assert (text[100], text[101], text[102]) == ("", "", "open &am")
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_the_template_decides_with_and_without_an_article(spark, tag, times):
    """A byline box that is the same on all pages is template, also within an article; no name tells so."""
    body = f'<{tag}><h1>Title {{i}}</h1><div class="byline">Our staff writers</div><p>story {{i}} of the day, told at length, with all that came of it in the end</p><p>and more of {{i}}</p></{tag}><div class="x7">other stories of day {{i}}</div>'
    rows = [page(i, body.replace("{i}", str(i))) for i in range(8)]
    whole = "Title 2 {by}story 2 of the day, told at length, with all that came of it in the end and more of 2"
    assert extract(spark, rows * times)[2] == whole.format(by="")
    # With the template emptied, each page is read by its own elements, and the box stays.
    assert "Our staff writers" in extract(spark, rows * times, min_pages=1000)[2]


def test_template_texts_go_where_no_article_is_marked(spark):
    rows = [page(i, f"<div class=\"w\"><p>Welcome to our site</p></div><div><p>story {i} of the day, some more of it, and the end</p></div>", "b.example.com") for i in range(6)]
    rows += [page(50, "<div><p>Welcome to our site</p></div><div><p>alone</p></div>", "c.example.com")]
    text = extract(spark, rows)
    assert text[2] == "story 2 of the day, some more of it, and the end"
    assert text[50] == "Welcome to our site alone"  # one page shows no template


def test_repeated_paragraphs_are_content(spark):
    """Copies share vectors among their texts, but no element occurs on just these pages."""
    rows = [page(i, f"<article><h1>t{i}</h1><p>{'the same long passage' if i % 2 else f'own {i}'}</p><p>end {i}</p></article>") for i in range(10)]
    assert extract(spark, rows)[3] == "t3 the same long passage end 3"
    copies = [page(i, "<article><h1>one</h1><p>copy of a page</p></article>") for i in range(10)]
    assert extract(spark, copies)[3] == "one copy of a page"


def test_names_near_those_of_asides(spark):
    body = '<article><div class="post-header"><h1>Title {i}</h1></div><div class="share-price"><p>price story {i}</p></div><ul class="share-buttons"><li>Like {i}</li></ul><div id="comment-list">me {i}</div></article>'
    rows = [page(i, body.replace("{i}", str(i))) for i in range(5)] + [page(99, body, "alone.example.com")]
    text = extract(spark, rows)
    assert text[2] == "Title 2 price story 2" and text[99] == "Title {i} price story {i}"


def brute_classes(rows, share, min_pages):
    """Classes of tokens with equal vectors, by looking at all pages of a host at once."""
    pages = [Counter(ht.read_page(r[2] or "").keys()) for r in rows]
    tag = {k: kind != ht.TEXT for r in rows for p in [ht.read_page(r[2] or "")] for k, kind in zip(p.keys(), p.kinds, strict=True)}
    by = defaultdict(set)
    for k in tag:
        v = tuple(p[k] for p in pages)
        if sum(n > 0 for n in v) >= max(min_pages, share * len(rows)):
            by[v].add(k)
    return {frozenset(ks) for ks in by.values() if len(ks) > 1 and any(tag[k] for k in ks)}


@pytest.mark.parametrize("times", [1, 2])
def test_classes_equal_brute_force(spark, times):
    rows = [page(i, (f"<section><p>fixed</p><p>t{i}</p></section>" if i % 3 else f"<p>t{i}</p>") + "<div class=k>a<div>b</div></div>" * (i % 4), "d.example.com") for i in range(12)] * times
    got = ht.token_classes(ht.page_tokens(spark.createDataFrame(rows, PAGES).repartition(4))).collect()
    assert {frozenset(t.key for t in r.tokens) for r in got} == brute_classes(rows, ht.SHARE, ht.MIN_PAGES)
    assert {r.pages for r in got} >= {12 * times, 8 * times, 9 * times}


def strip(html):
    """The page without what names its parts: article and footer are divs, and no element has a class, an id or a role."""
    import re

    html = re.sub(r'\s(?:class|id|role)="[^"]*"', "", html)
    return re.sub(r"(</?)(?:article|footer|nav)\b", r"\1div", html)


def test_given_pages_without_names(spark):
    """On the given tables the slots alone tell story from advert, menu and footer; with the template emptied they do not."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    named = {r.page_id: r.text for r in ht.extract_pages(given).collect()}
    bare = spark.createDataFrame([(r.page_id, r.url, strip(r.html)) for r in given.collect()], given.schema)
    got = {r.page_id: r.text for r in ht.extract_pages(bare).collect()}
    per_host = Counter(r.url.split("/")[2].lower() for r in given.collect())
    enough = {r.page_id for r in given.collect() if per_host[r.url.split("/")[2].lower()] >= ht.MIN_PAGES}
    assert len(enough) > 200 and {k: got[k] for k in enough} == {k: named[k] for k in enough}
    empty = {r.page_id: r.text for r in ht.extract_pages(bare, min_pages=10**9).collect()}
    assert not any(empty[k] == named[k] for k in enough)


def test_like_children_by_their_place(spark):
    """Two boxes on every page are told apart by their place; paragraphs, of which there are more and fewer, are not."""
    rows = [page(i, f"<div>buy {i}</div><div><h1>Story {i}</h1>" + "".join(f"<p>part {k} of {i} of the story, with words enough</p>" for k in range(1 + i % 3)) + f"</div><div>all rights {i}</div>") for i in range(9)]
    placed = ht.placed_children(ht._hosted(spark.createDataFrame(rows, PAGES))).collect()
    assert {x.path: x.times for x in placed[0].placed} == {"/html/body/div": 3}
    text = extract(spark, rows)
    assert text[4] == "Story 4 part 0 of 4 of the story, with words enough part 1 of 4 of the story, with words enough"
    p = ht.read_page("<div>a</div><div>b</div><div>c</div>", {"/div": 2})
    assert p.paths == ["/div[1]", "/div[2]", "/div"] and p.children == {}
    assert ht.read_page("<ul><li>a<li>b</ul><ul><li>c</ul>").children == {"/ul/li": (1, 2)}


@pytest.mark.parametrize("box", ['<div class="commentlist">{}</div>', '<div id="disqus_thread">{}</div>', '<div class="related-articles">{}</div>', '<div class="newsletter-signup">{}</div>', '<div class="responses">{}</div>'])
def test_boxes_within_the_article_go(spark, box):
    for times in (1, 60):  # also where they are longer than the story
        body = '<article><h1>Title {i}</h1><p>story {i} with some words</p>' + box.format("<p>said by a reader of {i}</p>" * times) + "</article>"
        rows = [page(i, body.replace("{i}", str(i))) for i in range(6)] + [page(99, body.replace("{i}", "z"), "alone.example.com")]
        text = extract(spark, rows)
        assert text[3] == "Title 3 story 3 with some words" and text[99] == "Title z story z with some words"


def test_comments_and_link_lists_without_names(spark):
    """A block that comes often on a page with a text of its own is a list of records; a box of links on all pages is no story."""
    reply = "<div class=q><p>opinion {k} on {i}, and it is a long one, longer than the story</p><span>Reply to this</span></div>"
    rows = []
    for i in range(12):
        said = "".join(reply.replace("{k}", str(k)).replace("{i}", str(i)) for k in range(2 + i % 4))
        links = "".join(f"<li><a href=/{i}{k}>read about {k} and {i}</a></li>" for k in range(3 + i % 2))
        story = "".join(f"<p>part {k} of story {i}, told at some length for once</p>" for k in range(2 + i % 3))
        rows.append(page(i, f"<div class=w><h1>Head {i}</h1>{story}<ul>{links}</ul>{said}</div>"))
    assert extract(spark, rows)[4] == "Head 4 " + " ".join(f"part {k} of story 4, told at some length for once" for k in range(3))
    # A list of links that only few pages have is the story's own.
    rows = [page(i, f"<div class=w><h1>Head {i}</h1><p>a story of {i} with words</p><p>and of {i} more</p>{'<ul><li><a href=/s>source of it</a></li></ul>' if i == 3 else ''}</div>") for i in range(12)]
    assert extract(spark, rows)[3] == "Head 3 a story of 3 with words and of 3 more source of it"


def test_slots_and_validity():
    """Classes nest; one that comes in another order, or that crosses another, is bad on that page."""
    p = ht.read_page("<body><div class=a>x</div><p>one<p>two<div class=b>y</div></body>")
    keys = p.keys()
    of = {(k, p.paths[a]): key for key, k, a in zip(keys, p.kinds, p.at, strict=True)}
    outer = [of[k, x] for k, x in ((0, "/body"), (0, "/body/div.a"), (1, "/body/div.a"), (0, "/body/div.b"), (1, "/body/div.b"), (1, "/body"))]
    para = [of[0, "/body/p"], of[1, "/body/p"]]
    places = {k: (1, i, 6) for i, k in enumerate(outer)} | {k: (2, i, 2) for i, k in enumerate(para)}
    got = ht.walk(keys, p.kinds, p.at, p.paths, places)
    assert not got.bad and got.of_text == [(1, 1, "/body/div.a"), (2, 0, "/body/p"), (2, 0, "/body/p"), (1, 3, "/body/div.b")]
    swapped = ht.read_page("<body><div class=b>y</div><p>one<div class=a>x</div></body>")
    assert ht.walk(swapped.keys(), swapped.kinds, swapped.at, swapped.paths, places).bad == {1}
    crossing = places | {k: (2, i, 3) for i, k in enumerate([*para, outer[3]])}
    assert ht.walk(keys, p.kinds, p.at, p.paths, crossing).bad == {1, 2}


def test_a_bad_class_gives_no_constant_texts():
    classes = [{"class": 5, "pages": 10, "tokens": [{"key": 1, "is_tag": True}, {"key": 2, "is_tag": False}]}]
    found = [{"kind": ht._SLOT, "class": 0, "path": "/body", "n": 900}, {"kind": ht._CONSTANT, "class": 5, "path": "/body", "n": 100}]
    assert ht.host_template(classes, found).constant == {5}
    assert ht.host_template(classes, [*found, {"kind": ht._BAD, "class": 5, "path": "", "n": 2}]).constant == frozenset()


def test_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    rows = [page(i, f"<article><h1>h{i}</h1><p>{words if i == 1 else i}</p></article>") for i in range(4)]
    assert extract(spark, rows)[1] == "h1 " + words


def test_empty(spark):
    assert ht.extract_pages(spark.createDataFrame([], PAGES)).count() == 0
