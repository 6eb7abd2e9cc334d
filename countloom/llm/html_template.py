"""Main text by equivalence-class template deduction over the pages of a host.

A page is a sequence of tokens: start and end of each block element, with the
path of block elements around it, and whole block texts with that path. Where
an element has the same number of like children on all pages of a host, these
are tokens of their own, by their place: a box beside the story is not the
story's, though neither has a name. Tokens with the same occurrence vector over the pages of their host (how often on
which page) form an equivalence class. A class that is on enough pages makes
up the host's template if it is valid: its tokens come in one order on each
page and its occurrences nest in those of other classes without crossing.
What stands between two neighbouring tokens of a class is a slot, named by the
class and the gap. A text that is itself a token of a valid class of elements
is template; all other text is content of the slot it stands in. The slots'
amounts of text, spread over pages and shares of links, summed over all pages
of the host, tell which slots hold the main text, and these are extracted.
Names of tags and classes only take texts out again (menus, adverts, comments).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A class is part of the template if so large a share of the host's pages has it, and so many pages.
SHARE, MIN_PAGES = 0.3, 3
#: A class with a larger share of pages on which it is out of order or crosses another is not valid.
MAX_BAD = 0.1
#: The main element is the deepest one that holds so large a share of the slots' text.
MAIN_SHARE = 0.75
#: A slot that so large a share of the pages has and that is links by more than LINKED is a list of other pages.
SPREAD, LINKED = 0.8, 0.5
#: Records (see record_classes) are main text only if nothing else has so large a share of the text.
LEAST_STORY = 0.1
#: Tags that carry no text of a page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist".split())
#: Tags that stand around the article.
ASIDE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
#: Tags that can hold a page's main text as a whole.
HOLDERS = frozenset("html body div section center td".split()) | MAIN
#: Tags that run within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Tags whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol p pre section table ul".split())
_LIMITS = frozenset("ul ol dl table select div section".split()) | MAIN | ASIDE
#: Words of a class, id or role that tell what is not content, and words that may stand beside them.
ASIDE_WORDS = frozenset("ad ads advert advertisement banner sponsor sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent notice popup modal share sharing social related comment comments commentlist commentform reply replies response responses respond disqus discussion newsletter signup subscribe subscription login search toolbar widget pagination pager recommended recommendations".split())
HEADER_WORDS = frozenset("header masthead".split())
BESIDE_WORDS = frozenset("site page main top bottom left right box bar block list item items wrap wrapper container area section slot unit button buttons link links post posts article articles entry stories story news more thread threads user users reader readers form inner outer count body content".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(script|style|noscript|template|svg|math|iframe|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[\s_-]+")
OPEN, CLOSE, TEXT = 0, 1, 2
#: Marks at the end of an element's label: never content, not content by its name, content only inside the main element.
_NEVER, _NAMED, _HEADER = "!", "~", "^"


def _label(name: str, tag: str) -> str:
    """name.class with a mark of the element's role, for paths."""
    marks = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(tag[len(name) + 1 :])} if len(tag) > len(name) + 2 else {}
    kinds = [k for k in marks.get("class", "").lower().replace("/", "_").split() if sum(map(str.isdigit, k)) < 2]  # numbered names are the page's own
    out = ".".join([name, *sorted(kinds)])
    if name in SILENT or "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", ""):
        return out + _NEVER
    if name in ASIDE:
        return out + _NAMED
    for said in [*kinds, marks.get("id", "").lower(), marks.get("role", "").lower()] if marks and name not in ("html", "body", *MAIN) else ():
        parts = set(_PARTS.split(said))
        if parts & ASIDE_WORDS and parts <= ASIDE_WORDS | BESIDE_WORDS:
            return out + _NAMED
        if parts & HEADER_WORDS and parts <= HEADER_WORDS | BESIDE_WORDS:
            return out + _HEADER
    return out + _HEADER if name == "header" else out


@dataclass
class Page:
    """A page's tokens: for each its kind, the number of its path and, for texts, the text."""

    paths: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    #: The characters of each text that are a link's, and by plain path how many like children parents have, least and most.
    links: list[int] = field(default_factory=list)
    children: dict[str, tuple[int, int]] = field(default_factory=dict)

    def keys(self) -> list[int]:
        """A signed 64-bit hash for each token."""
        h = xxhash.xxh64_intdigest
        tags = [(h(p) - (1 << 63), h("/" + p) - (1 << 63)) for p in self.paths]
        said = iter(self.texts)
        return [h(f"{self.paths[a]}\0{next(said)}") - (1 << 63) if k == TEXT else tags[a][k] for k, a in zip(self.kinds, self.at, strict=True)]


def read_page(html: str, placed: dict[str, int] | None = None) -> Page:
    """The tokens of a page; texts are whole blocks, decoded, with single spaces. Unclosed elements end where they must.

    placed has, by plain path, how many like children a parent has on the host's pages; the path of such a child has its place.
    """
    page, known, placed = Page(), {}, placed or {}
    stack: list[tuple[str, int, str, dict[str, int]]] = []  # name, number of the path, plain path, children by plain path
    top: dict[str, int] = {}
    line: list[str] = []
    linked, in_link = 0, False

    def number(path: str) -> int:
        if path not in known:
            known[path] = len(page.paths)
            page.paths.append(path)
        return known[path]

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            page.kinds.append(TEXT), page.at.append(stack[-1][1] if stack else number("")), page.texts.append(text), page.links.append(min(linked, len(text)))
        linked = 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            _, path, _, children = stack.pop()
            page.kinds.append(CLOSE), page.at.append(path)
            for plain, n in children.items():
                low, high = page.children.get(plain, (n, n))
                page.children[plain] = min(low, n), max(high, n)

    for m in _TOKEN.finditer(html):
        t = m[0]
        if t[0] != "<":
            said = unescape(t) if "&" in t else t
            line.append(said)
            if in_link:
                linked += len(said)
            continue
        named = _NAME.match(t)
        if not named:
            if t == "<":
                line.append(t)
            continue
        name = named[1].lower()
        if name == "a":
            in_link = t[1] != "/"
        if m[1] or name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if t[1] == "/":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None:
                close(at)
            continue
        if name in SELF_CLOSING:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] in _LIMITS), None)
            if at is not None and stack[at][0] == name:
                close(at)
        elif name in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        _, above, plain, like = stack[-1] if stack else ("", -1, "", top)
        label = _label(name, t)
        plain = f"{plain}/{label}"
        k = like[plain] = like.get(plain, 0) + 1
        if plain in placed and k <= placed[plain]:
            label = f"{name}[{k}]{label[len(name) :]}"
        stack.append((name, number(f"{page.paths[above] if above >= 0 else ''}/{label}"), plain, {}))
        page.kinds.append(OPEN), page.at.append(stack[-1][1])
    flush()
    close(0)
    return page


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, times (0 where it differs within a page), pages: like children of a parent, summed over the batch's pages."""
    for b in batches:
        sums: dict[tuple[str, str, int], int] = defaultdict(int)
        for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for plain, (low, high) in read_page(html.as_py() or "").children.items():
                sums[host, plain, low if low == high else 0] += 1
        cols = list(zip(*((*k, n) for k, n in sums.items()), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["host", "path", "times", "pages"])


def placed_children(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """of_host, placed (array of path and times): elements of which each parent has the same number, two or more, on all but a few pages."""
    counts = pages.select("host", "html").mapInArrow(_children, "host string, path string, times int, pages long")
    best = counts.groupBy("host", "path", "times").agg(F.sum("pages").alias("pages")).groupBy("host", "path").agg(F.sum("pages").alias("all"), F.max_by("times", "pages").alias("times"), F.max("pages").alias("pages"))
    use = best.where((F.col("times") > 1) & (F.col("pages") >= min_pages) & (F.col("pages") >= F.lit(1 - MAX_BAD) * F.col("all")))
    # A host has at most some such paths: each is on most of the pages that have its parent.
    return use.groupBy(F.col("host").alias("of_host")).agg(F.collect_list(F.struct("path", "times")).alias("placed"))


_TOKENS = "page_id long, url string, host string, mark long, keys array<long>, kinds array<int>, at array<int>, chars array<int>, paths array<string>, texts array<string>, links array<int>, types array<long>, times array<int>, firsts array<int>, tags array<boolean>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as its tokens, and its distinct tokens with their number, first place and kind."""
    lists = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())]
    names = [x.split()[0] for x in _TOKENS.split(", ")]
    for b in batches:
        known: dict[str, dict[str, int]] = {}
        for start in range(0, b.num_rows, 256):
            c = b.slice(start, 256)
            cols: list[list] = [[] for _ in lists]
            for host, html, placed in zip(c.column(2).to_pylist(), c.column(3), c.column(5), strict=True):
                if host not in known:
                    known[host] = {x["path"]: x["times"] for x in placed.as_py() or []}
                p = read_page(html.as_py() or "", known[host])
                keys = p.keys()
                types, first, times = np.unique(np.array(keys, np.int64), return_index=True, return_counts=True)
                kinds = np.array(p.kinds, np.int64)
                row = (keys, p.kinds, p.at, [len(t) for t in p.texts], p.paths, p.texts, p.links, types, times, first, kinds[first] != TEXT if len(keys) else [])
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), c.column(4), *[pa.array(v, t) for v, t in zip(cols, lists, strict=True)]], names)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), "html", F.xxhash64("page_id", "url", "html").alias("mark"))


def page_tokens(pages: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """The tokens of each row of pages (page_id, url, html); equal rows share a mark. placed is what placed_children gives."""
    held = _hosted(pages)
    if placed is None:
        held = held.withColumn("placed", F.lit(None).cast("array<struct<path:string,times:int>>"))
    else:
        held = held.join(placed, F.col("host") == F.col("of_host"), "left").drop("of_host")
    return held.mapInArrow(_read, _TOKENS)


def token_classes(tokens: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, class, pages, n (occurrences), tokens (array of key and is_tag, by mean place): the classes that are on enough pages.

    The occurrence vector of a token is kept as sums, over its pages, of two
    28-bit hashes of the page and the number of times; sums add up by parts on
    any number of machines and count repeated pages as often as they occur.
    Tokens are of one class if sums, pages and occurrences are equal. Only
    classes with a tag are returned: texts that merely occur on the same
    pages, as in copies, are content.
    """
    each = tokens.select("host", "mark", F.explode(F.arrays_zip("types", "times", "firsts", "tags")).alias("t"))
    each = each.select("host", F.col("t.types").alias("key"), F.col("t.times").alias("n"), F.col("t.firsts").alias("place"), F.col("t.tags").alias("is_tag"), F.xxhash64("mark", "t.times").alias("h"))
    half = lambda by: F.sum(F.shiftrightunsigned("h", by).bitwiseAND(F.lit((1 << 28) - 1)))
    vectors = each.groupBy("host", "key").agg(half(0).alias("v0"), half(28).alias("v1"), F.count("*").alias("pages"), F.sum("n").alias("n"), F.avg("place").alias("place"), F.first("is_tag").alias("is_tag"))
    totals = tokens.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("total"))
    often = vectors.where(F.col("pages") >= min_pages).join(totals, F.col("host") == F.col("of_host")).where(F.col("pages") >= F.lit(share) * F.col("total"))
    # A host has at most (mean distinct tokens a page) / share such tokens.
    found = often.groupBy("host", "v0", "v1", "pages", "n").agg(F.array_sort(F.collect_list(F.struct("place", "key", "is_tag"))).alias("t"))
    found = found.where(F.exists("t", lambda x: x.is_tag) & (F.size("t") > 1))
    return found.select("host", F.xxhash64("v0", "v1", "pages", "n").alias("class"), "pages", "n", F.transform("t", lambda x: F.struct(x.key.alias("key"), x.is_tag.alias("is_tag"))).alias("tokens"))


#: A token's class, its place in it and the class's size.
Places = dict[int, tuple[int, int, int]]


@dataclass
class Slots:
    """What a walk over a page finds: by number of the text, its class and gap, and the innermost template element;
    and the classes that are out of order or cross others."""

    of_text: list[tuple[int, int, str]]
    constant: list[int | None]
    bad: set[int]
    recorded: list[bool] = field(default_factory=list)


def record_classes(classes: list[dict]) -> frozenset[int]:
    """Classes that come several times on a page and have texts of their own, as a comment has its "Reply": lists of records, not a story."""
    return frozenset(c["class"] for c in classes if 2 * c.get("n", 0) > 3 * c["pages"] and not all(t["is_tag"] for t in c["tokens"]))


def walk(keys: list[int], kinds: list[int], at: list[int], paths: list[str], places: Places, records: frozenset[int] = frozenset()) -> Slots:
    """Nest the occurrences of the classes on a page; each text falls in the gap after the last template token."""
    out = Slots([], [], set())
    open_classes: list[tuple[int, int]] = []
    elements: list[str] = []
    for key, kind, a in zip(keys, kinds, at, strict=True):
        found = places.get(key)
        if kind == TEXT:
            top = open_classes[-1] if open_classes else (0, -1)
            out.of_text.append((*top, elements[-1] if elements else ""))
            out.constant.append(found[0] if found else None)
            out.recorded.append(any(c in records for c, _ in open_classes))
        if found is None:
            continue
        cls, place, size = found
        if place and (not open_classes or open_classes[-1] != (cls, place - 1)):
            # Out of order, or another class is still open where this one goes on.
            out.bad.add(cls)
            depth = next((i for i in range(len(open_classes) - 1, -1, -1) if open_classes[i][0] == cls), None)
            if depth is not None:
                out.bad.update(c for c, _ in open_classes[depth + 1 :])
                del open_classes[depth + 1 :]
        if place and open_classes and open_classes[-1][0] == cls:
            open_classes.pop()
        if place < size - 1:
            open_classes.append((cls, place))
        if kind == OPEN:
            elements.append(paths[a])
        elif kind == CLOSE and elements:
            elements.pop()
    out.bad.update(c for c, _ in open_classes)
    return out


def _places(classes: list[dict]) -> Places:
    return {t["key"]: (c["class"], i, len(c["tokens"])) for c in classes for i, t in enumerate(c["tokens"])}


_FOUND = "host string, kind int, class long, gap int, path string, n long, pages long, links long"
_BAD, _SLOT, _CONSTANT, _RECORD = 0, 1, 2, 3


def _try_template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a host and class, on how many pages it is bad; for a slot, its characters, pages and characters of links; for
    the constant texts of a class and element, their characters."""
    for b in batches:
        sums: dict[tuple, list[int]] = {}
        known: dict[str, tuple[Places, frozenset[int]]] = {}
        cols = [b.column(i) for i in range(8)]
        for i, host in enumerate(cols[0].to_pylist()):
            if host not in known:
                classes = cols[7][i].as_py()
                known[host] = _places(classes), record_classes(classes)
            keys, kinds, at, chars, paths, links = (c[i].as_py() for c in cols[1:7])
            got = walk(keys, kinds, at, paths, *known[host])
            on_page = {(host, _BAD, c, -1, ""): [1, 1, 0] for c in got.bad}
            for (cls, gap, path), constant, recorded, n, linked in zip(got.of_text, got.constant, got.recorded, chars, links, strict=True):
                key = (host, _RECORD if recorded else _SLOT, cls, gap, path) if constant is None else (host, _CONSTANT, constant, -1, path)
                on_page.setdefault(key, [0, 1, 0])
                on_page[key][0] += n
                on_page[key][2] += linked
            for key, more in on_page.items():
                sums[key] = [x + y for x, y in zip(sums[key], more, strict=True)] if key in sums else more
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        rows = list(zip(*((*k, *n) for k, n in sums.items()), strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])


def _inside(path: str, holder: str) -> bool:
    return path == holder or path.startswith(holder + "/")


def is_aside(path: str, holder: str = "") -> bool:
    """An element that is not content stands on the path; headers inside the holder are content."""
    if any(s.endswith((_NEVER, _NAMED)) for s in path.split("/")):
        return True
    return any(s.endswith(_HEADER) for s in (holder or path).split("/"))


def _tag(path: str) -> str:
    return re.split(r"[.!~^\[]", path.rsplit("/", 1)[-1], maxsplit=1)[0]


def main_element(slots: dict[str, int]) -> str:
    """The path of the element that holds the main text, from the characters of the slots by path.

    The deepest element that holds MAIN_SHARE of the text outside asides.
    Titles belong to it: it is widened to hold the first-level headings. An
    article or main element around it or within it, with most of such
    elements' text, takes its place.
    """
    use = {p: n for p, n in slots.items() if n and not any(s.endswith((_NEVER, _NAMED)) for s in p.split("/"))} or {p: n for p, n in slots.items() if n and _NEVER not in p}
    total = sum(use.values())
    above: dict[str, int] = defaultdict(int)
    for p, n in use.items():
        steps = p.split("/")
        for k in range(1, len(steps) + 1):
            above["/".join(steps[:k])] += n
    holders = {p: n for p, n in above.items() if p and _tag(p) in HOLDERS and not is_aside(p)}
    main = max((p for p, n in holders.items() if n >= MAIN_SHARE * total), key=lambda p: (p.count("/"), p), default="")
    named = {p: n for p, n in holders.items() if _tag(p) in MAIN}
    if around := [p for p in named if _inside(main, p)]:
        return max(around, key=len)
    if within := {p: n for p, n in named.items() if _inside(p, main)}:
        top = max(within.values())
        return max((p for p, n in within.items() if 2 * n >= top), key=lambda p: (p.count("/"), p))
    for p in sorted(use):
        if _tag(p) == "h1" and not is_aside(p):
            while main and not _inside(p, main):
                main = main.rpartition("/")[0]
    return main


@dataclass
class Template:
    """A host's template: its tokens' places, the classes whose texts are constant, the main element and the slots of the main text."""

    places: Places
    constant: frozenset[int]
    main: str
    slots: frozenset[tuple[int, int, str]] = frozenset()


def main_slots(slots: dict[tuple[int, int, str], tuple[int, int, int]], main: str, pages: int) -> frozenset[tuple[int, int, str]]:
    """The slots inside the main element, but those that most pages have as a list of links beside other text."""
    inside = {k: v for k, v in slots.items() if _inside(k[2], main) and not is_aside(k[2], main)}
    total = sum(n for n, _, _ in inside.values())
    lists = {k for k, (n, on, linked) in inside.items() if on >= SPREAD * pages and linked > LINKED * n and 2 * n < total}
    return frozenset(set(inside) - lists)


def host_template(classes: list[dict], found: list[dict]) -> Template:
    """What is valid, what is the main element and which are its slots, from the sums over a host's pages.

    A class that is bad on too many pages keeps its elements, which nest by
    themselves, but its texts are content. Constant texts are never most of
    the main element: where they are, pages are copies and show no template.
    Records count as text only where there is hardly any other.
    """
    pages = {c["class"]: c["pages"] for c in classes}
    bad = {f["class"] for f in found if f["kind"] == _BAD and f["n"] > MAX_BAD * pages[f["class"]]}
    slots: dict[tuple[int, int, str], tuple[int, int, int]] = {}
    records: dict[tuple[int, int, str], tuple[int, int, int]] = {}
    fixed: dict[str, int] = defaultdict(int)
    for f in found:
        of = (f["class"], f.get("gap", -1), f["path"])
        if f["kind"] in (_SLOT, _RECORD):
            (slots if f["kind"] == _SLOT else records)[of] = f["n"], f.get("pages", 1), f.get("links", 0)
        elif f["kind"] == _CONSTANT:
            fixed[f["path"]] += f["n"] if f["class"] not in bad else 0
    in_bad = {f["path"]: f["n"] for f in found if f["kind"] == _CONSTANT and f["class"] in bad}
    counted = lambda of: sum(n for (_, _, p), (n, _, _) in of.items() if not is_aside(p))
    if counted(slots) < LEAST_STORY * (counted(slots) + counted(records)):
        slots |= records
    amounts: dict[str, int] = defaultdict(int)
    for (_, _, p), (n, _, _) in slots.items():
        amounts[p] += n
    for p, n in in_bad.items():
        amounts[p] += n
    main = main_element(amounts)
    held = lambda of: sum(n for p, n in of.items() if _inside(p, main) and not is_aside(p, main))
    most = max(pages.values(), default=1)
    if held(fixed) > held(amounts):
        main = main_element({p: amounts[p] + fixed[p] for p in {*amounts, *fixed}})
        return Template(_places(classes), frozenset(), main, main_slots(slots | records, main, most + 1))
    return Template(_places(classes), frozenset(set(pages) - bad), main, main_slots(slots, main, most))


def extract_slots(keys: list[int], kinds: list[int], at: list[int], paths: list[str], texts: list[str], template: Template | None) -> str:
    """The texts of the template's main slots, in page order, joined by a space.

    Without a template, the page's own elements are one and its own amounts
    of text tell the main element. The same holds for a page that has
    nothing in the template's main element.
    """
    own = [paths[a] for k, a in zip(kinds, at, strict=True) if k == TEXT]
    if template:
        got = walk(keys, kinds, at, paths, template.places)
        if any(_inside(path, template.main) for _, _, path in got.of_text):
            # A text that is constant by a class which is not valid has no slot of its own; its element decides.
            use = [
                (slot in template.slots or (c is not None and _inside(slot[2], template.main))) and c not in template.constant for slot, c in zip(got.of_text, got.constant, strict=True)
            ]
            return " ".join(t for p, t, u in zip(own, texts, use, strict=True) if u and not is_aside(p, template.main))
    amounts: dict[str, int] = defaultdict(int)
    for p, t in zip(own, texts, strict=True):
        amounts[p] += len(t)
    main = main_element(amounts)
    return " ".join(t for p, t in zip(own, texts, strict=True) if _inside(p, main) and not is_aside(p, main))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        known: dict[str, Template | None] = {}
        texts = []
        cols = [b.column(i) for i in range(2, 10)]
        for i, host in enumerate(cols[0].to_pylist()):
            if host not in known:
                classes = cols[6][i].as_py()
                known[host] = host_template(classes, cols[7][i].as_py() or []) if classes else None
            texts.append(extract_slots(*(c[i].as_py() for c in cols[1:6]), known[host]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text (empty if none), n_chars for each row of pages, over the whole html.

    A null html is empty; a null or odd url has the empty host. Repeated rows
    count as pages of their own. A host with fewer than 3 pages has no
    template: each page is read by its own elements. Broken markup is read as
    it stands: what is not closed ends with what is around it. Texts of any
    length are kept whole; a page has to fit in a row. Columns other than
    page_id, url and html are not used.
    """
    # A row a host; joined as its file size allows.
    placed = materialize(placed_children(_hosted(pages), min_pages), "placed")
    tokens = materialize(page_tokens(pages, placed), "page-tokens")
    classes = token_classes(tokens, share, min_pages).groupBy("host").agg(F.collect_list(F.struct("class", "pages", "n", "tokens")).alias("classes"))
    # One row a host, of bounded size (see token_classes); joined as the table's file size allows.
    classes = materialize(classes.withColumnRenamed("host", "of_host"), "classes")
    seen = tokens.select("host", "keys", "kinds", "at", "chars", "paths", "links").join(classes, F.col("host") == F.col("of_host")).drop("of_host")
    found = seen.mapInArrow(_try_template, _FOUND).groupBy("host", "kind", "class", "gap", "path").agg(*[F.sum(c).alias(c) for c in ("n", "pages", "links")])
    # At most one row for each gap, template element and class of a host.
    found = found.groupBy("host").agg(F.collect_list(F.struct("kind", "class", "gap", "path", "n", "pages", "links")).alias("found")).withColumnRenamed("host", "with_host")
    templates = materialize(classes.join(found, F.col("of_host") == F.col("with_host"), "left").drop("with_host"), "templates")
    joined = tokens.select("page_id", "url", "host", "keys", "kinds", "at", "paths", "texts").join(templates, F.col("host") == F.col("of_host"), "left").drop("of_host")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


ORACLE_SQL = r"""
WITH art AS (SELECT page_id, url, regexp_replace(html, '^.*?<article>', '', 's') AS a FROM pages),
body AS (SELECT page_id, url, regexp_replace(a, '</article>.*$', '', 's') AS a FROM art),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS a FROM body),
plain AS (SELECT page_id, url, replace(replace(replace(replace(a, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', '''') AS a FROM bare),
done AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(a, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM done
"""
