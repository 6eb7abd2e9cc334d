"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run of smallest period q has at least two whole periods, so each of its
words occurs twice or more inside it. A word that occurs once in a segment is
in no run: it ends the segment on both sides. In the smaller segments more
words have become rare, so they are counted and split again until nothing
changes; segments shorter than the shortest run go. Of natural text hardly
anything is left.

What survives is scanned lag by lag. Words q apart are equal along at least q
places of a run of period q, so one of the places 0, q, 2q, ... of the segment
lies among them: only these are looked at, some n log n for all lags, and
where both words agree, the agreement is followed to both sides. It is
followed in steps of powers of two, over names that equal stretches of 2^k
words share, so that long runs take no longer than short ones.

All of it works on arrays of many documents at once; a document is not
shuffled, and its words are never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words

#: A run has this many words at least, and two periods.
SHORTEST = 12
#: Words of the documents that are looked at together, and places of a lag scan held at once.
WORDS_AT_ONCE, PLACES_AT_ONCE = 200_000, 1_000_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def split_by_frequency(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The segment of each place after splitting to stability, -1 for places in none; segments lie side by side."""
    out = np.full(len(words), -1, np.int64)
    at = np.arange(len(words))
    while len(at):
        # Names of (segment, word) pairs, and how often each occurs.
        names, _ = pd.factorize(segment * (int(words.max()) + 1) + words)
        often = np.bincount(names)[names] > 1
        # A new segment begins after a gap in the places or at another old segment.
        at_kept, old = at[often], segment[often]
        starts = np.ones(len(at_kept), bool)
        starts[1:] = (np.diff(at_kept) > 1) | (np.diff(old) != 0)
        new = np.cumsum(starts) - 1
        long = np.bincount(new, minlength=1)[new] >= SHORTEST
        stable = long.all() and often.all()
        at, segment, words = at_kept[long], new[long], words[often][long]
        if stable:
            out[at] = segment
            break
    return out


def stretch_names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ...: a name for the 2^k words from each place, as far as they fit, the same where these are equal."""
    names = [words]
    while 2 << (len(names) - 1) <= longest:
        half, last = 1 << (len(names) - 1), names[-1]
        pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
        names.append(pd.factorize(pairs)[0])
    return names


def agreement(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree before the places i < j (i not below low), and how many from them on (j below high)."""
    left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):  # the binary digits of what is left, so each step is taken once at most
        name, step = names[k], 1 << k
        fits = np.flatnonzero(j + right + step <= high)
        fits = fits[name[i[fits] + right[fits]] == name[j[fits] + right[fits]]]
        right[fits] += step
        fits = np.flatnonzero(i - left - step >= low)
        fits = fits[name[i[fits] - left[fits] - step] == name[j[fits] - left[fits] - step]]
        left[fits] += step
    return left, right


def scan_lags(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs inside segments of words, which do not touch each other."""
    found: list[tuple[np.ndarray, ...]] = []
    names = stretch_names(words, int((ends - starts).max(initial=1)))
    most = (ends - starts) // 2
    of = np.repeat(np.arange(len(starts)), most)
    lag = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (ends - starts)[of] // lag - ((ends - starts)[of] % lag == 0)  # 0, q, 2q, ... with a partner inside
    total = np.cumsum(places)
    a = 0
    while a < len(of):
        b = max(a + 1, int(np.searchsorted(total, total[a] - places[a] + PLACES_AT_ONCE, "right")))
        n = places[a:b]
        q = np.repeat(lag[a:b], n)
        s = np.repeat(of[a:b], n)
        i = starts[s] + q * (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n))
        use = np.flatnonzero(words[i] == words[i + q])
        i, q, s = i[use], q[use], s[use]
        left, right = agreement(names, i, i + q, starts[s], ends[s])
        use = left + right >= np.maximum(q, SHORTEST - q)
        found.append((i[use] - left[use], (left + right + q)[use], q[use]))
        a = b
    start, length, period = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))
    # All periods of a stretch up to half its length are multiples of the smallest.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of documents given as words, and for each word of all whether it is dropped."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    firsts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    ids: dict[bytes, int] = {}
    names = np.fromiter((ids.setdefault(w, len(ids)) for d in docs for w in d), np.int64, total)
    segment = split_by_frequency(names, np.repeat(np.arange(len(docs)), sizes))
    at = np.flatnonzero(segment >= 0)
    dropped = np.zeros(total, bool)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, dropped
    # The surviving segments next to each other, with a place between them that equals no other.
    change = np.diff(segment[at], prepend=-1) != 0
    place = np.arange(len(at)) + np.cumsum(change) - 1
    packed = np.full(place[-1] + 1, -1, np.int64)
    packed[place] = names[at]
    gaps = np.flatnonzero(packed < 0)
    packed[gaps] = len(ids) + np.arange(len(gaps))
    origin = np.zeros(len(packed), np.int64)
    origin[place] = at
    starts = place[change]
    ends = np.append(starts[1:] - 1, len(packed))
    start, length, period = scan_lags(packed, starts, ends)
    start = origin[start]
    # Dropped: all words of a run after its first period, marked at their ends and summed up.
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    dropped = np.cumsum(marks)[:-1] > 0
    doc = np.searchsorted(firsts, start, "right") - 1
    return doc, start - firsts[doc], length, period, dropped


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        a = 0
        while a < len(texts):
            docs: list[list[bytes]] = []
            held = 0
            while a < len(texts) and held < WORDS_AT_ONCE:
                docs.append((texts[a].as_py() or "").encode().split())
                held += len(docs[-1])
                a += 1
            doc, start, length, period, dropped = runs_of(docs)
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            counts = np.bincount(doc, minlength=len(docs))
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), runs)
            kept, at = [], 0
            for d in docs:
                gone = dropped[at : at + len(d)]
                kept.append(b" ".join([w for w, g in zip(d, gone.tolist(), strict=True) if not g] if gone.any() else d).decode())
                at += len(d)
            rows = batch.slice(a - len(docs), len(docs))
            sizes = pa.array(np.fromiter(map(len, docs), np.int64, len(docs)))
            yield pa.RecordBatch.from_arrays([sizes, runs, pa.array(kept, pa.string()), rows.column(0)], ["n_words", "runs", "collapsed", "row"])


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with text replaced by n_words, runs (array of struct<start, length, period>, by start and period) and collapsed.

    runs are all stretches of words with smallest period q and at least
    max(12, 2 q) words that no neighbouring word extends; start counts words
    from 0. collapsed holds the words, joined by one space, without those that
    a run contains after its first period. A null or empty text has no words,
    no runs and an empty collapsed text. A row stays a row, repeated or not;
    columns of docs named n_words, runs or collapsed are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(True).alias("given"))
    given = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    out = given.mapInArrow(_looked_at, T.StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string").add("row", given.schema["row"].dataType))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_words", "runs", "collapsed")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a periodic tail in every tenth document, by the CRC-32 of its id; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    sized = lambda w: F.struct(w.alias("w"), F.size(w).alias("n"), (g % F.greatest(F.size(w), F.lit(1))).cast("int").alias("a"))
    period = lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).cast("int").alias("p"))
    tail = lambda x: F.transform(F.sequence(x["a"], x["n"] - 1), lambda i: F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))
    made = _bind(words(text), lambda w: _bind(sized(w), lambda s: _bind(period(s), lambda x: F.when(x["n"] > 0, F.concat_ws(" ", F.slice(x["w"], F.lit(1), x["a"]), tail(x))))))
    return F.when(h % 10 == 0, made).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls without one), runs_sha256, collapsed_sha256."""
    found = collapse_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # Greatest length, then smallest start, then smallest period.
    longest = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(
            (r["length"] > best["length"]) | ((r["length"] == best["length"]) & ((r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"])))), r
        ).otherwise(best),
    )
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("longest", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
