"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of up to ORDER bytes holds how often
each byte followed. A byte costs what an arithmetic coder with these frozen
counts would spend: in the longest context that the tree has, a byte seen n
times of N, with d different ones, has probability n / (N + d) and the escape
to the context one byte shorter d / (N + d). There the bytes of the longer
context are left out of the counts, as they would have been coded already;
the last resort is an even choice between all bytes not yet left out. The
language whose code for the text is shortest is predicted.

Counts come from all learnable documents by grouped sums. A byte's cost
depends on itself and the ORDER bytes before alone, so each task works out
the costs of the different stretches that it meets once and adds them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ORDER = 4
#: A stretch of bytes is a number in this base, a byte one digit of 1 to 256; 0 stands before a text's begin.
BASE = 257
#: All trees together hold at most so many nodes, those counted most. A node's suffix is counted as often or more, so it stays too.
MAX_NODES = 1_000_000
#: Bytes that a task looks at together, and different stretches that it holds before it passes their counts on.
BYTES_AT_ONCE, STRETCHES_HELD = 4_000_000, 1_000_000


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def stretches(texts: list[bytes], order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, number of the stretch) for every byte, some at a time: the byte with the order bytes before it."""
    gap = b"\0" * order
    joined = np.frombuffer(gap + gap.join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + order)
    for a in range(order, len(joined), BYTES_AT_ONCE):
        b = min(a + BYTES_AT_ONCE, len(joined))
        at = np.arange(a - order, b)
        text = np.searchsorted(ends, at, "right")
        real = at - (ends - sizes)[np.minimum(text, len(texts) - 1)] >= 0
        digits = np.where(real, joined[a - order : b].astype(np.int64) + 1, 0)
        number = np.zeros(b - a, np.int64)
        for k in range(order + 1):
            number = number * BASE + digits[k : k + b - a]
        use = real[order:]
        yield text[order:][use], number[use]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with the lower-case bytes of their texts (the last column), some megabytes at a time."""
    for batch in batches:
        texts, a = batch.column(batch.num_columns - 1), 0
        while a < batch.num_rows:
            held: list[bytes] = []
            size, first = 0, a
            while a < batch.num_rows and size < BYTES_AT_ONCE:
                held.append(lowered(texts[a].as_py()))
                size += len(held[-1])
                a += 1
            yield batch.slice(first, a - first), held


def _counted(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, numbers = pd.factorize(np.concatenate([n for n, _ in parts]))
            return numbers, np.bincount(codes, np.concatenate([c for _, c in parts])).astype(np.int64)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                numbers, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers), pa.string()), pa.array(numbers), pa.array(counts)], ["lang", "stretch", "n"])
            held.clear()

        for rows, texts in _together(batches):
            langs, names = pd.factorize(np.array(rows.column(0).to_pylist(), object))
            for text, number in stretches(texts, order):
                lang = langs[text]
                for k in np.unique(lang):
                    codes, numbers = pd.factorize(number[lang == k])
                    parts = held.setdefault(names[k], [])
                    parts.append((numbers, np.bincount(codes)))
                    if len(parts) > 8:
                        parts[:] = [merged(parts)]
            if sum(len(n) for parts in held.values() for n, _ in parts) > STRETCHES_HELD:
                yield from passed_on()
        yield from passed_on()

    return run


def count_stretches(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, length (1 to order + 1), stretch, n over all rows of labelled (lang, text)."""
    partial = labelled.select("lang", "text").mapInArrow(_counted(order), "lang string, stretch long, n long")
    full = materialize(partial.groupBy("lang", "stretch").agg(F.sum("n").alias("n")), "stretches")
    # Each byte is in one stretch of each length, so shorter ones are sums of longer ones.
    suffixes = F.array(*[F.struct(F.lit(k).alias("length"), (F.col("stretch") % BASE**k).alias("stretch")) for k in range(1, order + 2)])
    return full.select("lang", F.explode(suffixes).alias("s"), "n").groupBy("lang", "s.length", "s.stretch").agg(F.sum("n").alias("n"))


def most_counted(counts: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """The rows of counts with at least as many occurrences as leaves at most so many rows."""
    # Eight steps to each doubling: some hundred different values at any size.
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = {r["step"]: r["rows"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()}
    total, least = 0, None
    for s in sorted(steps, reverse=True):
        if total + steps[s] > most:
            break
        total, least = total + steps[s], s
    return counts.where(step >= F.lit(least if least is not None else 0)) if steps and least is not None else counts.limit(0)


class Tree:
    """The byte contexts of one language as sorted arrays: for each length, stretches with the cost of their last byte, and contexts."""

    def __init__(self, length: np.ndarray, stretch: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.order = order
        self.nodes, self.contexts = [], []
        for k in range(order + 1):  # contexts of k bytes, stretches of k + 1
            mine = length == k + 1
            by = np.argsort(stretch[mine], kind="stable")
            key, count = stretch[mine][by], n[mine][by]
            context, starts = np.unique(key // BASE, return_index=True)
            total = np.add.reduceat(count, starts) if len(starts) else np.empty(0, np.int64)
            kinds = np.diff(np.append(starts, len(key)))
            self.nodes.append((key, np.log2(count)))
            up_log, up_escape = np.empty(0), np.empty(0)
            if k and len(key):
                # After an escape from a context: its bytes are left out of the counts of the context one shorter.
                below_key, below_log = self.nodes[k - 1]
                below_context, below_total, below_kinds = self.contexts[k - 1][:3]
                suffix = np.searchsorted(below_key, key % BASE**k)
                left_out = np.add.reduceat(np.rint(np.exp2(below_log[suffix])).astype(np.int64), starts)
                parent = np.searchsorted(below_context, context % BASE ** (k - 1))
                others = below_kinds[parent] - kinds
                # No other byte is left: the escape is certain and costs nothing.
                up = np.maximum(below_total[parent] - left_out + others, 1)
                up_log, up_escape = np.log2(up), np.where(others > 0, np.log2(up) - np.log2(np.maximum(others, 1)), 0.0)
            self.contexts.append((context, total, kinds, np.log2(total + kinds), np.log2(total + kinds) - np.log2(kinds), up_log, up_escape))

    def bits(self, number: np.ndarray) -> np.ndarray:
        """What the last byte of each stretch costs after the bytes before it."""
        cost = np.zeros(len(number))
        open_ = np.arange(len(number))
        child = np.full(len(number), -1)  # the context escaped from, by its place one length up
        for k in range(self.order, -1, -1):
            key, log = self.nodes[k]
            context, _, _, first_log, first_escape = self.contexts[k][:5]
            if not len(key):
                continue
            number_k = number[open_] % BASE ** (k + 1)
            at = np.minimum(np.searchsorted(context, number_k // BASE), len(context) - 1)
            has = context[at] == number_k // BASE
            node = np.minimum(np.searchsorted(key, number_k), len(key) - 1)
            seen = has & (key[node] == number_k)
            came = child[open_] >= 0
            if k < self.order and came.any():
                up_log, up_escape = self.contexts[k + 1][5:]
                c = np.where(came, child[open_], 0)
                this_log = np.where(came, up_log[c], first_log[at])
                this_escape = np.where(came, up_escape[c], first_escape[at])
            else:
                this_log, this_escape = first_log[at], first_escape[at]
            cost[open_] += np.where(seen, this_log - log[node], np.where(has, this_escape, 0.0))
            child[open_] = np.where(has, at, -1)
            open_ = open_[~seen]
        known = int(self.contexts[0][2][0]) if len(self.contexts[0][2]) else 0
        cost[open_] += np.log2(256 - known)
        return cost


def _scored(trees: object, langs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = trees.value
        for rows, texts in _together(batches):
            bits = np.zeros((len(langs), len(texts)))
            for text, number in stretches(texts, models[0].order if models else ORDER):
                codes, numbers = pd.factorize(number, sort=True)
                for k, model in enumerate(models):
                    bits[k] += np.bincount(text, model.bits(numbers)[codes], len(texts))
            letters = [has_letter(t.as_py()) for t in rows.column(rows.num_columns - 1)]
            best = bits.argmin(axis=0) if langs else np.zeros(len(texts), np.int64)
            odds = np.exp2(np.minimum(bits.min(axis=0) - bits, 0.0)).sum(axis=0) if langs else np.ones(len(texts))
            sure = [x and bool(langs) for x in letters]
            lang = pa.array([langs[b] if s else "und" for b, s in zip(best, sure, strict=True)], pa.string())
            score = pa.array([round(1 / o, 9) if s else 0.0 for o, s in zip(odds.tolist(), sure, strict=True)], pa.float64())
            code = pa.array([round(float(bits[b, i]), 6) if s else None for i, (b, s) in enumerate(zip(best, sure, strict=True))], pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lang, score, code], [*rows.schema.names[:-1], "lang_pred", "score", "code_bits"])

    return run


def learn(labelled: DataFrame, order: int = ORDER, most: int = MAX_NODES) -> dict[str, Tree]:
    """A tree for each language from all rows of labelled (lang, text); rows with a null in either teach nothing.

    What comes to the driver, and later to every task, is at most `most` nodes
    of three numbers and their language.
    """
    counts = materialize(count_stretches(labelled.where("lang IS NOT NULL AND text IS NOT NULL"), order), "counts")
    nodes = most_counted(counts, most).toArrow()
    lang = np.array(nodes.column("lang").to_pylist(), object)
    length, stretch, n = (nodes.column(c).to_numpy() for c in ("length", "stretch", "n"))
    return {k: Tree(length[lang == k], stretch[lang == k], n[lang == k], order) for k in sorted(set(lang.tolist()))}


def identify(docs: DataFrame, trees: dict[str, Tree], text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred, score and code_bits, the length of the shortest code.

    score is the probability of lang_pred if a text of each language were
    equally likely. A text that is null or has no letter, or any text where
    nothing was learned, is `und` with score 0 and no code; of equal codes the
    first language wins. Columns of docs of these names are replaced; rows
    stay as they are, repeated or not, and only the text decides.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score", "code_bits")]
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").alias("text"))
    schema = given.drop("text").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("code_bits", "double")):
        schema = schema.add(name, kind)
    shared = spark.sparkContext.broadcast(list(trees.values()))
    out = given.mapInArrow(_scored(shared, list(trees)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "lang_pred", "score", "code_bits")


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, code_bits for every document, learned from those that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    trees = learn(docs.where(~held_out).select("lang", "text"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), trees)
