"""Line dedup by site-relative frequency.

Lines are grouped by host; the pages that have a line, divided by the host's
page total, tell boilerplate from text. A long line does not come twice by
chance, so for those the whole corpus is one more site, with an absolute
number of pages as its limit; there one text keeps the line, so nothing is
lost to the corpus. Pages with equal texts count as one page: a group of
copies is not a reason to empty all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, words

#: A line goes if more than this share of its host's pages have it; spectrum() shows where a corpus has the gap between
#: what a site puts on its pages and what is repeated by chance ...
RATIO = 0.05
#: ... and at least so many pages; on a small host, a share alone says little.
MIN_PAGES = 5
#: A line of more words than this goes from all texts but one if so many different texts of the corpus have it.
LONG_WORDS, LONG_PAGES = 50, 3
_BLANK = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """What makes two lines equal: the text without white space at its ends."""
    return F.xxhash64(F.btrim(line, F.lit(_BLANK)))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK)) == ""


def _is_long(line: Column) -> Column:
    """So many words have as many characters and as many spaces at least; only then they are counted."""
    return F.when(F.length(line) > 2 * LONG_WORDS, F.size(words(line)) > LONG_WORDS).otherwise(False)


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5; a null text counts as one of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("\0null"))), 1, 15), 16, 10).cast("long")


def page_lines(pages: DataFrame) -> DataFrame:
    """host, page (a hash of the text), line (its key), is_long: each line once for each different text of a host."""
    # Not array_distinct: on structs it compares each with each; the distinct below starts within the task.
    each = F.transform(F.filter(_lines(F.col("text")), lambda x: ~_is_blank(x)), lambda x: F.struct(_key(x).alias("line"), _is_long(x).alias("is_long")))
    # The key in a step of its own, or it would be worked out again for each line.
    lines = pages.select("host", text_key(F.col("text")).alias("page"), each.alias("ls")).select("host", "page", F.explode("ls").alias("l"))
    return lines.select("host", "page", "l.line", "l.is_long").distinct()


def _totals(pages: DataFrame) -> DataFrame:
    """of_host and its number of different texts."""
    return pages.select(F.col("host").alias("of_host"), text_key(F.col("text")).alias("page")).distinct().groupBy("of_host").agg(F.count("*").alias("total"))


def spectrum(pages: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """from_share, lines, pages: how many lines of a host lie between from_share and the root of 2 times it, as a share of its pages.

    The lines that a site puts on its pages stand apart from those that recur
    by chance, by a range of shares that hardly a line has: RATIO belongs there.
    """
    given = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    seen = page_lines(given).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    totals = _totals(given)
    shares = seen.join(totals, seen.host.eqNullSafe(totals.of_host)).select((F.floor(F.log2(F.col("n") / F.col("total")) * 2) / 2).alias("b"), "n")
    return shares.groupBy("b").agg(F.count("*").alias("lines"), F.sum("n").alias("pages")).select(F.pow(F.lit(2.0), "b").alias("from_share"), "lines", "pages")


def boilerplate_lines(lines: DataFrame, pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and the keys of its boilerplate lines, one row a host that has any.

    A host has at most (mean lines a page) / ratio such lines, which bounds the array.
    """
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = _totals(pages)
    common = seen.join(totals, seen.host.eqNullSafe(totals.of_host)).where(F.col("n") > F.lit(ratio) * F.col("total"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def repeated_passages(lines: DataFrame, long_pages: int = LONG_PAGES) -> DataFrame:
    """page and the keys of its long lines that so many pages of the corpus have, one row a page that has any.

    Of the pages that have a line, the one with the smallest key is left out: it keeps it.
    """
    long = materialize(lines.where("is_long").select("page", "line").distinct(), "long-lines")
    often = long.groupBy(F.col("line").alias("key")).agg(F.count("*").alias("n"), F.min("page").alias("keeper")).where(F.col("n") >= long_pages)
    found = join_counted(long, materialize(often, "passages"), "line", "key", "n", long.count())
    return found.where("page <> keeper").groupBy("page").agg(F.collect_list("line").alias("lines"))


def _cleaned(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """row (all columns as a struct), clean, n_lines, n_dropped."""
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    lines = materialize(page_lines(given), "lines")
    found = materialize(boilerplate_lines(lines, given, ratio, min_pages), "boilerplate").select(F.col("host").alias("of_host"), F.col("lines").alias("of_site"))
    passages = materialize(repeated_passages(lines), "repeated").select(F.col("page").alias("of_page"), F.col("lines").alias("of_text"))
    # The tables' sizes are known from their files: Spark broadcasts them below the threshold and shuffles beyond.
    joined = given.join(found, F.col("host").eqNullSafe(F.col("of_host")), "left").join(passages, text_key(F.col("text")) == F.col("of_page"), "left")
    none = F.array().cast("array<bigint>")
    drop = F.concat(F.coalesce("of_site", none), F.coalesce("of_text", none))
    kept = F.when(F.col("of_site").isNull() & F.col("of_text").isNull(), _lines(F.col("text"))).otherwise(
        F.filter(_lines(F.col("text")), lambda x: _is_blank(x) | ~F.array_contains(drop, _key(x)))
    )
    out = joined.select("row", "text", kept.alias("kept"))
    return out.select(
        "row",
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("clean"),
        F.size(F.filter(_lines(F.col("text")), lambda x: ~_is_blank(x))).cast("long").alias("n_lines"),
        (F.size(_lines(F.col("text"))) - F.size("kept")).cast("long").alias("n_dropped"),
    )


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with boilerplate lines and repeated passages taken out of text, and n_lines, n_dropped added.

    A repeated passage stays in one text (and in exact copies of it).

    All pages stay, also those that lose all lines (empty text). A null text
    stays null, with no lines; blank lines count as none and stay. Null is a
    host of its own. Pages of a host with equal texts count as one page.
    Columns of pages named n_lines or n_dropped are replaced; all others stay.
    """
    out = _cleaned(pages, host, text, ratio, min_pages)
    names = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("clean").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], "n_lines", "n_dropped")


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs with the same columns: text is cleaned, and n_chars, where there is one, follows a text that is not null."""
    out = _cleaned(docs, host, "text", RATIO, MIN_PAGES)
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("row").getField("n_chars"))
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, text without its source's boilerplate, n_lines, n_dropped."""
    return drop_boilerplate(docs.select("doc_id", "source", "text"))


ORACLE_SQL = f"""
WITH blank AS (SELECT ' ' || chr(9) || chr(11) || chr(12) || chr(13) AS b),
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
lines AS (
  SELECT rid, source, text, i, line, trim(line, b) AS k FROM blank, (
    SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
),
totals AS (SELECT source, count(DISTINCT md5(coalesce(text, 'null'))) AS total FROM docs GROUP BY source),
seen AS (SELECT source, k, count(DISTINCT md5(text)) AS n FROM lines WHERE k <> '' GROUP BY source, k),
boiler AS (SELECT s.source, s.k FROM seen s JOIN totals t USING (source) WHERE n >= {MIN_PAGES} AND n > {RATIO} * total),
passages AS (
  SELECT k, min(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)) AS keeper FROM lines WHERE length(regexp_extract_all(k, '[^\\x20\\x09-\\x0D]+')) > {LONG_WORDS}
  GROUP BY k HAVING count(DISTINCT md5(text)) >= {LONG_PAGES}),
marked AS (SELECT l.*, b.k IS NOT NULL OR (p.k IS NOT NULL AND CAST('0x' || substr(md5(l.text), 1, 15) AS BIGINT) <> p.keeper) AS gone FROM lines l LEFT JOIN boiler b USING (source, k) LEFT JOIN passages p ON l.k = p.k),
made AS (
  SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE k <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM marked GROUP BY rid)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE m.text END AS text,
       coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dropped, 0) AS n_dropped
FROM docs d LEFT JOIN made m USING (rid)
"""
