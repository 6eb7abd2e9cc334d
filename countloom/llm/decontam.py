"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some positions of a window of words and ignore the others,
so a window still matches where a word at an ignored position was replaced.
Window hashes of the documents are joined with those of the benchmark; around
each hit the words are aligned and the overlap is verified with substitutions
allowed. A window that more than SHARED different items have is a prompt's: it
finds no item, and its words count for none, unless an item has nothing else.
The seeds of a benchmark of at most BLOCK_WORDS words go to every
task. Those of a larger one stay a table: one pass over the documents keeps
the windows that a Bloom filter of bounded size lets through, these are joined
with the seeds by hash, and the texts with hits are read again to verify.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_AT_ONCE, join_counted, materialize

#: The masks; 1 marks a position that counts.
MASKS = ("1110111", "11011011", "110100111", "1011010011", "1100110101", "10110100111")
SHORTEST = min(map(len, MASKS))
#: Items with fewer words are common within text and leak only as a line of their own.
MIN_WORDS = 4
#: A leak: so much of the item's words in place ...
MIN_COVERAGE = 0.5
#: ... or so many of them in one aligned stretch, however long the item is.
MIN_ALIGNED = 13
#: A window in more different items than this belongs to what they share, such as a prompt; an item that has no other is looked up by all of its own.
SHARED = 20
#: Most words of benchmark text whose seeds are sent to every task: about 330 bytes a word.
BLOCK_WORDS = 200_000
#: Bits of the Bloom filter for each seed, and the most bits in all (64 MB); a fuller filter only lets more windows through.
SEED_BITS, MAX_BITS = 32, 1 << 29
#: Scripts written without spaces (Thai to Tibetan, Burmese, Khmer, kana, Han); each character is a word.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{UNSPACED}]")
_WORD, _MIXED = re.compile(r"\w+"), re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
_ODD = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(16)], dtype=np.uint64)


#: Entries of a worker's table of word hashes; it is emptied when full.
_CACHE = 250_000


class _Known(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_known = _Known()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word (letters and digits, lower case; or a character of an unspaced script), in order."""
    low = (text or "").lower()
    found = (_WORD if low.isascii() or not _UNSPACED.search(low) else _MIXED).findall(low)
    return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))


def seed_hashes(h: np.ndarray, masks: list[str]) -> Iterator[np.ndarray]:
    """For each mask, the hash of each window."""
    times = [h * _ODD[k] for k in range(max(m.count("1") for m in masks))]
    for mask in masks:
        n = len(h) - len(mask) + 1
        out = np.full(max(n, 0), np.uint64(int(mask, 2) * 2 + 1))
        for k, j in enumerate(j for j, c in enumerate(mask) if c == "1"):
            if n > 0:
                out += times[k][j : j + n]
        yield out


def masks_for(lengths: set[int]) -> list[str]:
    """The masks, and for items shorter than any of them one of all their words."""
    return [*MASKS, *("1" * n for n in sorted(lengths) if MIN_WORDS <= n < SHORTEST)]


def masks_of(n: int, masks: list[str]) -> list[str]:
    """The masks that an item of n words is found by."""
    return [m for m in masks if n == len(m) or (n >= SHORTEST and m in MASKS)]


class Block:
    """The seeds of some benchmark items, for lookup in tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        self.lines: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < MIN_WORDS:
                self.lines.setdefault(w.tobytes(), []).append(k)
        self.masks = masks_for({len(w) for w in self.words})
        # Items with the same words are one when windows are counted.
        same: dict[bytes, int] = {}
        group = np.array([same.setdefault(w.tobytes(), len(same)) for w in self.words], np.int64)
        seeds = []
        for mask in self.masks:
            use = [k for k, w in enumerate(self.words) if mask in masks_of(len(w), self.masks)]
            parts = [(next(seed_hashes(self.words[k], [mask])), k) for k in use]
            keys = np.concatenate([np.empty(0, np.uint64), *(h for h, _ in parts)])
            item = np.concatenate([np.empty(0, np.int64), *(np.full(len(h), k) for h, k in parts)])
            at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(h)) for h, _ in parts)])
            _, name = np.unique(keys, return_inverse=True)
            pairs = np.unique(name * (len(same) + 1) + group[item] if len(item) else name) // (len(same) + 1)
            seeds.append((mask, keys, item, at, np.bincount(pairs, minlength=1)[name]))  # and in how many different items
        self.own = [np.ones(len(w), bool) for w in self.words]
        looked_up = np.zeros(len(self.words), np.int64)
        for mask, _, item, at, n in seeds:
            for k, p in zip(item[n > SHARED].tolist(), at[n > SHARED].tolist(), strict=True):
                self.own[k][p : p + len(mask)] = False
            looked_up += np.bincount(item[n <= SHARED], minlength=len(looked_up))
        for own in self.own:
            own[:] |= not own.any()
        self.tables = []
        for mask, keys, item, at, n in seeds:
            use = (n <= SHARED) | (looked_up[item] == 0)
            keys, item, at = keys[use], item[use], at[use]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = max(16, int(len(keys) * 32).bit_length())
            filt = np.zeros(1 << bits, bool)
            filt[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables.append((mask, keys, item[order], at[order], filt, np.uint64(64 - bits)))

    def hits(self, texts: list[np.ndarray]) -> dict[int, set[tuple[int, int]]]:
        """By number of the text, (item, position in the text minus position in the item) of every seed hit."""
        starts = np.cumsum([0, *map(len, texts)])
        out: dict[int, set[tuple[int, int]]] = {}
        for (mask, keys, item, at, filt, shift), s in zip(self.tables, seed_hashes(np.concatenate([np.empty(0, np.uint64), *texts]), self.masks), strict=True):
            if not len(keys):
                continue
            for p in np.flatnonzero(filt[(s >> shift).astype(np.int64)]).tolist():
                lo, hi = np.searchsorted(keys, s[p], "left"), np.searchsorted(keys, s[p], "right")
                if lo < hi and (i := int(np.searchsorted(starts, p, "right")) - 1) is not None and p + len(mask) <= starts[i + 1]:
                    out.setdefault(i, set()).update((int(item[k]), p - int(starts[i]) - int(at[k])) for k in range(lo, hi))
        return out

    def own_lines(self, text: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """As overlaps, for the shortest items that are a line of the text."""
        found: dict[int, tuple[int, int, int]] = {}
        at = 0
        for line in (text or "").splitlines() if self.lines else ():
            w = word_hashes(line)
            for k in self.lines.get(w.tobytes(), ()) if len(w) < MIN_WORDS else ():
                found[k] = len(w), found[k][1] if k in found else at, at + len(w) - 1
            at += len(w)
        for k, (n, first, last) in sorted(found.items()):
            yield k, n, n, first, last

    def overlaps(self, h: np.ndarray, hits: set[tuple[int, int]], min_coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, and what overlap gives) of each item that leaks."""
        offsets: dict[int, list[int]] = {}
        for k, d in hits:
            offsets.setdefault(k, []).append(d)
        for k, ds in sorted(offsets.items()):
            if (out := overlap(h, self.words[k], self.own[k], ds, min_coverage)) is not None:
                yield k, *out


def overlap(h: np.ndarray, w: np.ndarray, own: np.ndarray, offsets: list[int], min_coverage: float) -> tuple[int, int, int, int] | None:
    """Matched words, item words, first and last word in the document, if the item's words w leak at these offsets of the text h.

    Only words marked in own decide.
    """
    matched, first, last, most = np.zeros(len(w), bool), len(h), 0, 0
    for d in offsets:
        lo, hi = max(0, -d), min(len(w), len(h) - d)
        same = h[lo + d : hi + d] == w[lo:hi]
        if (seg := _best_segment(same)) is None:
            continue
        a, b = seg
        matched[lo + a : lo + b] |= same[a:b]
        first, last, most = min(first, lo + a + d), max(last, lo + b + d - 1), max(most, int((same & own[lo:hi])[a:b].sum()))
    m, m_own = int(matched.sum()), int((matched & own).sum())
    return (m, len(w), first, last) if m >= MIN_WORDS and m_own and (m_own >= min_coverage * own.sum() or most >= MIN_ALIGNED) else None


def _best_segment(same: np.ndarray) -> tuple[int, int] | None:
    """The stretch with the best sum of +1 for a match and -1 for a substitution."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -1))))
    low = np.minimum.accumulate(total)
    b = int(np.argmax(total - low))
    if total[b] <= low[b]:
        return None
    return int(np.argmin(total[: b + 1])), b


def _search(block: Block, min_coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for start in range(0, b.num_rows, 200):  # some texts at a time, as one array
                c = b.slice(start, 200)
                docs, raw = list(zip(c.column(0).to_pylist(), c.column(2).to_pylist(), strict=True)), c.column(1).to_pylist()
                texts = [word_hashes(t) for t in raw]
                for i, hits in sorted(block.hits(texts).items()):
                    rows += [(*docs[i], block.ids[k], *x) for k, *x in block.overlaps(texts[i], hits, min_coverage)]
                if block.lines:
                    rows += [(*doc, block.ids[k], *x) for doc, t in zip(docs, raw, strict=True) for k, *x in block.own_lines(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_hash", "item_id", "matched_words", "item_words", "first_word", "last_word"])
        _known.clear()  # the worker lives on and other operators use its memory

    return run


_FOUND = "matched_words long, item_words long, first_word long, last_word long"
_SCHEMA = f"doc_id long, text_hash long, item_id long, {_FOUND}"


def _line_key(words: np.ndarray) -> int:
    """The seed of an item that leaks as a line of its own."""
    return xxhash.xxh64_intdigest(words.tobytes(), 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a text's words, as bytes, beside its key."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_hashes(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["key", "words"])


def _item_seeds(masks: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """hash, item, at, span (its words) of every seed of the items; the span is 0 for an item that is looked for as a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.frombuffer(raw, np.uint64)
                used = masks_of(len(w), masks)
                seeds = zip(seed_hashes(w, used), map(len, used), strict=True) if len(w) >= MIN_WORDS else [(np.array([_line_key(w)], np.uint64), 0)]
                for s, span in seeds:
                    yield pa.RecordBatch.from_arrays([_signed(s), pa.array([item] * len(s), pa.int64()), pa.array(np.arange(len(s))), pa.array(np.full(len(s), span))], ["hash", "item", "at", "span"])

    return run


def own_words(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of an item's n words lie in none of the shared windows (place and length); all, if none is left."""
    own = np.ones(n, bool)
    for at, span in spans:
        own[at : at + span] = False
    return own | (not own.any())


def _lookups(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The seeds that find items (hash, item, at), and each item's shared windows (of, spans).

    A seed is one in at most SHARED items; an item without such a one has all of its own.
    """
    counts = materialize(seeds.groupBy(F.col("hash").alias("key")).agg(F.count_distinct("item").alias("n"), F.count("*").alias("rows")), "seed-counts")
    counted = materialize(join_counted(seeds, counts, "hash", "key", "rows", seeds.count()).select("hash", "item", "at", "span", "n"), "counted-seeds")
    spans = counted.where(F.col("n") > SHARED).groupBy(F.col("item").alias("of")).agg(F.collect_set(F.struct("at", "span")).alias("spans"), F.count("*").alias("shared"))
    alone = counted.groupBy(F.col("item").alias("all")).agg(F.count("*").alias("seeds"))
    spans = materialize(spans.join(alone, F.col("of") == F.col("all")).select("of", "spans", (F.col("shared") == F.col("seeds")).alias("only")), "shared-windows")
    rest = counted.join(spans.where("only").select("of"), F.col("item") == F.col("of"), "left_semi")
    return counted.where(F.col("n") <= SHARED).unionByName(rest).select("hash", "item", "at"), spans.select("of", "spans")


def _filter_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places in a filter of so many bits (a power of two) for each hash."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [h >> shift, (h * np.uint64(0x9E3779B97F4A7C15)) >> shift]


def _filter_words(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_filter_places(b.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([_signed(at >> np.uint64(6)), _signed(np.uint64(1) << (at & np.uint64(63)))], ["word", "set"])

    return run


def _passing(h: np.ndarray, filt: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter lets through."""
    both = [filt[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) for p in _filter_places(h, bits)]
    return np.flatnonzero(both[0] & both[1])


def _windows(filt: Broadcast, bits: int, masks: list[str], lines: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """hash, text_hash, place of every window, and every short line, that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 200):  # some texts at a time, as one array
                c = b.slice(start, 200)
                names, raw = c.column(0).to_numpy(), c.column(1).to_pylist()
                texts = [word_hashes(t) for t in raw]
                starts = np.cumsum([0, *map(len, texts)])
                for mask, s in zip(masks, seed_hashes(np.concatenate([np.empty(0, np.uint64), *texts]), masks), strict=True):
                    p = _passing(s, filt.value, bits)
                    i = np.searchsorted(starts, p, "right") - 1
                    inside = p + len(mask) <= starts[i + 1]
                    p, i = p[inside], i[inside]
                    yield pa.RecordBatch.from_arrays([_signed(s[p]), pa.array(names[i]), pa.array(p - starts[i])], ["hash", "text_hash", "place"])
                for name, text in zip(names.tolist(), raw, strict=True) if lines else ():
                    keys, places, at = [], [], 0
                    for line in (text or "").splitlines():
                        w = word_hashes(line)
                        if 0 < len(w) < MIN_WORDS:
                            keys.append(_line_key(w))
                            places.append(at)
                        at += len(w)
                    h = np.array(keys, np.uint64)
                    p = _passing(h, filt.value, bits)
                    yield pa.RecordBatch.from_arrays([_signed(h[p]), pa.array([name] * len(p), pa.int64()), pa.array(np.array(places, np.int64)[p])], ["hash", "text_hash", "place"])

    return run


def _verify(min_coverage: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The leaks of one text, from its candidate items with their words and offsets, and its own words."""

    def run(hits: pd.DataFrame, text: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(text):
            h = np.frombuffer(text["words"].iloc[0], np.uint64)
            for hit in hits.itertuples():
                w, offsets = np.frombuffer(hit.words, np.uint64), [int(d) for d in hit.offsets]
                n = len(w)
                if n >= MIN_WORDS:
                    out = overlap(h, w, own_words(n, [(x["at"], x["span"]) for x in hit.spans] if hit.spans is not None else []), offsets, min_coverage)
                else:
                    there = [d for d in offsets if d >= 0 and np.array_equal(h[d : d + n], w)]
                    out = (n, n, min(there), max(there) + n - 1) if there else None
                if out is not None:
                    rows.append((hit.text_hash, hit.item, *out))
        return pd.DataFrame(rows, columns=["text_hash", "item", "matched_words", "item_words", "first_word", "last_word"])

    return run


def _counted(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left joined with a table of distinct keys; keys that are frequent in left are spread (join_counted)."""
    n = left.groupBy(F.col(left_key).alias("__k")).agg(F.count("*").alias("__n"))
    known = right.join(n, F.col(right_key) == F.col("__k")).drop("__k")
    return join_counted(left, known, left_key, right_key, "__n", left.count()).drop("__n")


def _find_joined(text: DataFrame, items: DataFrame, min_coverage: float) -> DataFrame:
    """The leaks of a benchmark of any size. Equal items, and equal texts, are looked for once.

    Items and texts go by 64-bit hashes of their words and characters.
    """
    spark = text.sparkSession
    worded = items.select("item_id", "text").mapInArrow(_words_of, "key long, words binary").where(F.length("words") > 0)
    worded = materialize(worded.select(F.col("key").alias("item_id"), F.xxhash64("words").alias("item"), "words"), "items-words")
    distinct = materialize(worded.groupBy("item").agg(F.first("words").alias("words")), "distinct-items")
    lengths = {r[0] for r in distinct.select((F.length("words") / 8).cast("int")).where(F.length("words") < 8 * SHORTEST).distinct().collect()}  # six at most
    masks, lines = masks_for(lengths), any(n < MIN_WORDS for n in lengths)
    seeds = materialize(distinct.select("item", "words").mapInArrow(_item_seeds(masks), "hash long, item long, at long, span long"), "seeds")
    seeds, spans = _lookups(seeds)
    distinct = materialize(distinct.join(spans, F.col("item") == F.col("of"), "left").select("item", "words", "spans"), "items-spans")
    places = materialize(seeds.groupBy("hash").agg(F.collect_list(F.struct("item", "at")).alias("places")), "places")
    bits = min(MAX_BITS, 1 << max(16, (places.count() * SEED_BITS - 1).bit_length()))
    # At most MAX_BITS / 64 rows come to the driver.
    words = places.select("hash").mapInArrow(_filter_words(bits), "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    filt = np.zeros(bits >> 6, np.uint64)
    filt[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    windows = text.select("text_hash", "text").mapInArrow(_windows(spark.sparkContext.broadcast(filt), bits, masks, lines), "hash long, text_hash long, place long")
    windows = materialize(windows.select(F.col("hash").alias("seen"), "text_hash", "place"), "windows")
    hits = _counted(windows, places, "seen", "hash").select("text_hash", "place", F.explode("places").alias("p"))
    hits = hits.groupBy("text_hash", F.col("p.item").alias("found")).agg(F.collect_set(F.col("place") - F.col("p.at")).alias("offsets"))
    hits = materialize(hits, "hits")
    candidates = _counted(hits, distinct, "found", "item").select("text_hash", "item", "offsets", "words", "spans")
    once = text.join(hits.select(F.col("text_hash").alias("__h")).distinct(), F.col("text_hash") == F.col("__h"), "left_semi").dropDuplicates(["text_hash"])
    texts = once.select("text_hash", "text").mapInArrow(_words_of, "key long, words binary")
    leaks = candidates.groupBy("text_hash").cogroup(texts.groupBy("key")).applyInPandas(_verify(min_coverage), f"text_hash long, item long, {_FOUND}")
    leaks = materialize(leaks, "text-leaks")
    # A row for each row of the benchmark and each row of the documents.
    each = worded.groupBy(F.col("item").alias("of")).agg(F.collect_list(F.coalesce(F.struct("item_id"), F.struct(F.lit(None).cast("long").alias("item_id")))).alias("ids"))
    named = _counted(leaks, each, "item", "of").select("text_hash", F.explode("ids").alias("i"), "matched_words", "item_words", "first_word", "last_word")
    named = named.select("text_hash", F.struct("i.item_id", "matched_words", "item_words", "first_word", "last_word").alias("leak"))
    by_text = materialize(named.groupBy(F.col("text_hash").alias("leaking")).agg(F.collect_list("leak").alias("leaks")), "leaks-by-text")
    rows = text.select("doc_id", "text_hash")
    return _counted(rows, by_text, "text_hash", "leaking").select("doc_id", "text_hash", F.explode("leaks").alias("l")).select("doc_id", "text_hash", "l.*")


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, matched_words, item_words, first_word, last_word for each document row and item it leaks.

    A leak has at least min_coverage of the item's words in place (4 at
    least), or 13 of them in one aligned stretch. Words that lie in windows
    of more than 20 different items are not an item's own and decide
    nothing, so a document that quotes but a common prompt leaks no item. An item of 1 to 3 words leaks
    where a line of the document has just these words. Texts are compared by
    their words of letters and digits, in lower case, and scripts without
    spaces by character; null and empty texts match nothing. Documents and items may have
    null ids (null in the result). A repeated document row gives its leaks
    each time, a repeated item is one item for each row. Whole texts of any length
    are searched; a text has to fit in a row.
    """
    return _find(docs, benchmark, min_coverage, block_words).drop("text_hash")


def _find(docs: DataFrame, benchmark: DataFrame, min_coverage: float, block_words: int = BLOCK_WORDS) -> DataFrame:
    """find_leaks with a hash of the document's text."""
    # Words as they are looked up: of letters and digits, and characters of unspaced scripts.
    n = F.regexp_count("text", F.lit(r"(?U)\w+")) + F.length("text") - F.length(F.regexp_replace("text", f"[{UNSPACED}]", ""))
    items = materialize(benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text", n.alias("n")), "items")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    if (items.agg(F.sum("n")).first()[0] or 0) > block_words:
        return _find_joined(text, items, min_coverage)
    block = Block([tuple(r) for r in items.select("item_id", "text").collect()])
    return text.mapInArrow(_search(block, min_coverage), _SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """docs without the documents that leak an item, found by doc_id and text; null ids count as one id."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    bad = materialize(_find(docs, benchmark, min_coverage).select(F.col("doc_id").alias("bad"), "text_hash").distinct(), "leaks", TEXTS_AT_ONCE)
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad")) & (F.col("th") == F.col("text_hash")), "left_anti").select("row.*")
