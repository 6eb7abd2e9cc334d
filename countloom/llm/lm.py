"""Deleted interpolation: bigram, unigram and uniform estimates mixed by context frequency.

Training documents are split in a kept part, whose counts give maximum
likelihood estimates, and a deleted part, on which expectation-maximisation
learns the weights, one set for each power of two of the context's count.
Scores then use the counts of both parts with these weights.

Counting: documents are cut into chunks of bounded size, whose distinct words
and word pairs are sorted 64-bit hashes. Each chunk's hashes go, as blocks by
hash range, to the task that sums that range over all chunks, and the sums go
back as arrays in the same order. So a word or pair crosses the network once
a chunk in each direction, however often it occurs, and a very common one is
one entry a chunk.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spark_partitions

#: Tokens of a chunk, at least, before it is closed; a longer text is a chunk of its own.
CHUNK_TOKENS = 1_500_000
#: Hashes that one counting task holds, about.
RANGE_KEYS = 2_000_000
KEEP, HELD, TEST = 0, 1, 2
#: Width of a histogram cell, in natural log of a probability.
CELL = 0.1
#: Weight of the pooled mixture in a bucket's own, in tokens.
POOL = 50.0
_END = b""


def part_of(doc_id: int | None) -> int:
    """TEST if crc32(doc_id as text) mod 5 is 1; a fifth of the rest is HELD. A null id counts as empty text."""
    c = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return TEST if c % 5 == 1 else HELD if c // 5 % 5 == 0 else KEEP


_CHUNK = "chunk long, doc_ids binary, lens binary, ids binary, vocab binary, tokens long, words long"
_CHUNK_COLUMNS = ["chunk", "doc_ids", "lens", "ids", "vocab", "tokens", "words"]


class _Open:
    """A chunk that still takes documents."""

    def __init__(self):
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.vocab: dict[bytes, int] = defaultdict(count().__next__)
        self.total = 0

    def add(self, doc: int | None, tokens: list[bytes]) -> None:
        self.docs.append(doc)
        self.ids.append(np.fromiter(map(self.vocab.__getitem__, tokens), np.int32, len(tokens)))
        self.total += len(tokens)

    def row(self, number: int) -> pa.RecordBatch:
        """Words are numbered in the order of their hashes, which are kept as differences; ids as byte planes."""
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocab), np.uint64, len(self.vocab))
        order = np.argsort(words)
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        ids = place[np.concatenate(self.ids)]
        planes = zlib.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
        known = np.array([d is not None for d in self.docs])
        docs = np.array([d or 0 for d in self.docs], np.int64).tobytes() + known.tobytes()
        lens = np.array([len(x) for x in self.ids], np.int64).tobytes()
        row = [pa.array([x], pa.binary()) for x in (docs, lens, planes, _pack_keys(words[order]))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *row, pa.array([self.total], pa.int64()), pa.array([len(words)], pa.int64())], _CHUNK_COLUMNS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with odd numbers hold the deleted part, those with even numbers the rest."""
    first, made = TaskContext.get().partitionId() << 32, count()
    opened = [_Open(), _Open()]
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            tokens = (text.as_py() or "").encode("utf-8", "replace").lower().split()
            tokens.append(_END)
            held = part_of(doc) == HELD
            opened[held].add(doc, tokens)
            if opened[held].total >= CHUNK_TOKENS:
                yield opened[held].row(first + 2 * next(made) + held)
                opened[held] = _Open()
    for held, chunk in enumerate(opened):
        if chunk.docs:
            yield chunk.row(first + 2 * next(made) + held)


class Chunk:
    """A chunk's documents with its sorted distinct words and pairs."""

    def __init__(self, row):
        raw = bytes(row.doc_ids)
        n = len(raw) // 9
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, np.int64, n), np.frombuffer(raw, bool, n, n * 8), strict=True)]
        self.lens = np.frombuffer(bytes(row.lens), np.int64)
        self.words = _unpack_keys(bytes(row.vocab))
        planes = np.frombuffer(zlib.decompress(bytes(row.ids)), np.uint8).reshape(4, -1)
        self.word = np.ascontiguousarray(planes.T).view(np.int32).ravel()  # each token's place in words
        ends = np.cumsum(self.lens)
        end_word = self.word[ends - 1][0]
        self.context = np.concatenate(([end_word], self.word[:-1]))  # the end of the text before stands for a start
        pair = self.words[self.context] * np.uint64(0x9E3779B97F4A7C15) ^ (self.words[self.word] + (self.words[self.context] >> np.uint64(29)))
        pair *= np.uint64(0xD6E8FEB86659FD93)
        self.pairs, self.pair = np.unique(pair ^ (pair >> np.uint64(32)), return_inverse=True)
        self.part = np.array([part_of(d) for d in self.doc_ids], np.int8)
        self.token_part = np.repeat(self.part, self.lens)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)

    def sums(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, at = (self.words, self.word) if kind == 0 else (self.pairs, self.pair)
        count_of = lambda p: np.bincount(at[self.token_part == p], minlength=len(keys)).astype(np.int64)
        return keys, count_of(KEEP), count_of(HELD)


_BLOCK = "kind int, range long, chunk long, keys binary, keep binary, held binary"


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.int64).tobytes() if x.max(initial=0) >= 1 << 16 else b"s" + x.astype(np.uint16).tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    raw = zlib.decompress(x)
    return np.frombuffer(raw, np.uint16, offset=1).astype(np.int64) if len(raw) % 2 else np.frombuffer(raw, np.int64)


def _pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys as six bytes of each difference; larger gaps make it eight."""
    d = np.diff(x, prepend=np.uint64(0))
    if len(d) > 1 and int(d[1:].max()) < 1 << 48:
        return b"d" + x[:1].tobytes() + d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"k" + x.tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    if raw[:1] == b"k":
        return np.frombuffer(raw, np.uint64, offset=1)
    first, rest = np.frombuffer(raw, np.uint64, 1, 1), np.frombuffer(raw, np.uint8, offset=9).reshape(-1, 6)
    wide = np.zeros((len(rest), 8), np.uint8)
    wide[:, :6] = rest
    return np.cumsum(np.concatenate((first, wide.view("<u8").ravel())), dtype=np.uint64)


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n hash ranges begins in sorted keys; n + 1 places."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _blocks(ranges: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pandas().itertuples():
                chunk = Chunk(row)
                for kind in (0, 1):
                    keys, keep, held = chunk.sums(kind)
                    cuts = _ranges(keys, ranges[kind])
                    out = [(kind, r, row.chunk, _pack_keys(keys[i:j]), _pack(keep[i:j]), _pack(held[i:j])) for r, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)],
                        ["kind", "range", "chunk", "keys", "keep", "held"],
                    )

    return run


_SUMS = "kind int, range long, chunk long, keep binary, held binary, new_words long, new_kept long, tokens long, kept_tokens long"


def _sum_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts over all chunks for one range of hashes, given back to each chunk in its order."""
    keys = [_unpack_keys(k) for k in pdf["keys"]]
    all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = pdf[["kind", "range", "chunk"]].copy()
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    total = {}
    for name in ("keep", "held"):
        total[name] = np.bincount(at, np.concatenate([_unpack(x) for x in pdf[name]]), minlength=len(all_keys)).astype(np.int64)
        out[name] = [_pack(total[name][i]) for i in np.split(at, cuts)]
    train = total["keep"] + total["held"]
    for name, x in (("new_words", (train > 0).sum()), ("new_kept", (total["keep"] > 0).sum()), ("tokens", train.sum()), ("kept_tokens", total["keep"].sum())):
        out[name] = [int(x), *[0] * (len(out) - 1)]  # once a range
    return out


def _with_counts(row, blocks: pd.DataFrame) -> tuple[Chunk, dict[tuple[int, str], np.ndarray]]:
    chunk, counts = Chunk(row), {}
    blocks = blocks.sort_values("range")
    for kind in (0, 1):
        own = blocks[blocks["kind"] == kind]
        for name in ("keep", "held"):
            counts[kind, name] = np.concatenate([_unpack(x) for x in own[name]])
    return chunk, counts


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _histogram(left: pd.DataFrame, blocks: pd.DataFrame, kept: int) -> pd.DataFrame:
    """Tokens of the deleted part by context bucket and by rounded logs of their bigram and unigram estimates."""
    cells = []
    for row in left.itertuples():
        chunk, n = _with_counts(row, blocks)
        at = chunk.token_part == HELD
        w, c, p = chunk.word[at], chunk.context[at], chunk.pair[at]
        context, pair, word = n[0, "keep"][c], n[1, "keep"][p], n[0, "keep"][w]
        log = lambda a, b: np.where(a > 0, np.round(np.log(np.maximum(a, 1) / np.maximum(b, 1)) / CELL), 1).astype(np.int64)
        cell = np.stack([_bucket(context), log(pair, context), log(word, kept)])
        got, num = np.unique(cell, axis=1, return_counts=True)
        cells.append(pd.DataFrame({"bucket": got[0], "bigram": got[1], "unigram": got[2], "n": num}))
    return pd.concat(cells)


def fit_weights(cells: pd.DataFrame, types: int, rounds: int = 60) -> dict[int, np.ndarray]:
    """Mixture weights (bigram, unigram, uniform) of each bucket, by expectation-maximisation; -1: of all.

    The uniform estimate is over the known words and one type for all others,
    so an unknown word costs its share of that. After a context that was not
    seen (bucket 0) there is no bigram estimate, and the others share all.
    """

    def run(rows: pd.DataFrame, first: np.ndarray, prior: float) -> np.ndarray:
        p = np.stack(
            [
                np.where(rows["bigram"] < 1, np.exp(np.minimum(rows["bigram"], 0) * CELL), 0),
                np.where(rows["unigram"] < 1, np.exp(np.minimum(rows["unigram"], 0) * CELL), 0),
                np.full(len(rows), 1 / (types + 1)),
            ],
            axis=1,
        )
        weight, n = first, rows["n"].to_numpy(float)[:, None]
        for _ in range(rounds):
            post = p * weight
            post /= post.sum(axis=1, keepdims=True)
            weight = ((post * n).sum(axis=0) + prior * first) / (n.sum() + prior)
        return weight

    unseen = lambda w: w * [0, 1, 1] / w[1:].sum()
    start = np.array([0.3, 0.5, 0.2])
    pooled = run(cells, start, 1.0) if len(cells) else start
    own = {int(b): run(rows, pooled if b else unseen(pooled), POOL) for b, rows in cells.groupby("bucket")}
    return {-1: pooled, 0: unseen(pooled)} | own


def _scores(left: pd.DataFrame, blocks: pd.DataFrame, tokens: int, types: int, weights: dict[int, np.ndarray]) -> pd.DataFrame:
    out = []
    table = np.stack([weights.get(b, weights[-1]) for b in range(64)])
    for row in left.itertuples():
        chunk, n = _with_counts(row, blocks)
        words, pairs = n[0, "keep"] + n[0, "held"], n[1, "keep"] + n[1, "held"]
        c, context = words[chunk.word], words[chunk.context]
        w = table[_bucket(context)]
        p = w[:, 0] * pairs[chunk.pair] / np.maximum(context, 1) + w[:, 1] * c / max(tokens, 1) + w[:, 2] / (types + 1)
        base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
        docs = len(chunk.lens)
        out.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array(chunk.doc_ids, dtype="Int64"),
                    "held_out": chunk.part == TEST,
                    "n_tokens": chunk.lens,
                    "n_known": np.bincount(chunk.doc, c > 0, docs).astype(np.int64),
                    "train_tokens": tokens,
                    "base_score": np.bincount(chunk.doc, base, docs),
                    "score": np.bincount(chunk.doc, np.log10(p), docs),
                }
            )
        )
    return pd.concat(out)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    The end of a text is a token, and the context of the next text's first
    word. Unknown words are one type beside the known ones, with the uniform
    estimate's probability. A null or empty
    text is its end alone; a null doc_id counts as the empty text in the
    split. Repeated rows count and score each. Without training documents,
    every word is unknown and the counts are 0.
    """
    chunks = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_chunks, _CHUNK), "chunks")
    size = chunks.agg(F.sum("words"), F.sum("tokens")).first()
    ranges = tuple(max(1, int((x or 0) // RANGE_KEYS) + 1) for x in size)
    blocks = chunks.mapInArrow(_blocks(ranges), _BLOCK).repartition(max(spark_partitions(docs), sum(ranges)), "kind", "range")
    sums = materialize(blocks.groupBy("kind", "range").applyInPandas(_sum_range, _SUMS), "sums")
    got = sums.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("new_words", "new_kept", "tokens", "kept_tokens")]).first()
    types, kept_types, tokens, kept = (int(x) for x in got)
    back = sums.select("kind", "range", "chunk", "keep", "held")
    # As many tasks as the corpus needs, whatever the session's setting: some chunks each.
    tasks = max(spark_partitions(docs), int(size[1] or 0) // (4 * CHUNK_TOKENS) + 1)
    dealt, returned = chunks.repartition(tasks, "chunk"), back.repartition(tasks, "chunk")
    together = dealt.groupBy("chunk").cogroup(returned.groupBy("chunk"))
    odd = "chunk % 2 = 1"
    deleted = chunks.where(odd).repartition(tasks, "chunk").groupBy("chunk").cogroup(back.where(odd).repartition(tasks, "chunk").groupBy("chunk"))
    cells = deleted.applyInPandas(lambda a, b: _histogram(a, b, kept), "bucket long, bigram long, unigram long, n long")
    # Cells are buckets by rounded logs: at most 64 x 700 x 700, and some thousands in practice, for any input.
    cells = cells.groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n")).toPandas()
    weights = fit_weights(cells, kept_types)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.applyInPandas(lambda a, b: _scores(a, b, tokens, types, weights), schema)
