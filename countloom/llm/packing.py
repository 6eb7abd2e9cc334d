"""Mixture-controlled packing by deficit round-robin over source queues.

The documents of a source are one queue of tokens. Every window of 1024
tokens takes from each queue its share; what rounding leaves over is carried
to the next window. For that the queues are the leaves of a binary tree: of
the first c tokens of a node, its left child has its share of c, rounded
down, and its right child the others. So one more token is always one more
of exactly one queue, none is given twice, and a queue can be found without
the others by its path from the root. The tree is Huffman's: an inner node
has at most two thirds of its parent's weight, so rounding adds up to a
deficit of a few tokens at most, however many queues there are. When a queue
runs dry, its share goes to the others in proportion. The whole schedule
follows from the queues' lengths, so each task cuts its own documents:
neither windows nor deficits stop at partitions, and no tokens are shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import TEXTS_AT_ONCE, discard, materialize

WINDOW, END_ID = 1024, 0
#: Sources without a target stand in so many groups, each a queue of the schedule; a tree within each tells its sources apart.
GROUPS = 4096
#: Texts that are encoded, and documents that are cut, at once.
_AT_ONCE = 250
#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by the vocabulary of a tokenizers file (byte-level BPE, ids below 65536 in merge order).

    The merges run in tiktoken, built from the same file: it gives the same
    ids in less time (tests hold it against tokenizers). The file's added
    tokens have the ids of the file. Nothing is kept from text to text: a
    table of words that were seen takes longer than the merges, and memory.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, special = file["model"]["vocab"], {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        of = _byte_of()
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in vocab.items() if all(c in of for c in t) and t not in special}
        if max([*vocab.values(), *special.values()]) > 65535:
            raise ValueError(f"{path} has ids above 65535, which are kept in 16 bits")
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 16-bit values."""
        return [self.bpe.encode_to_numpy(t, allowed_special="all").astype(np.uint16).tobytes() for t in texts]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for a worker: it serves all tasks that the worker runs."""
    return Encoder(path)


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sofar = _encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], np.uint16).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):  # small batches out: ids of long texts add up
                c = b.slice(at, _AT_ONCE)
                ids = [x + end for x in encoder.encode([t or "" for t in c.column(2).to_pylist()])]
                n = [len(x) // 2 for x in ids]
                start = []
                for s, k in zip(c.column(1).to_pylist(), n, strict=True):
                    start.append(sofar.get(s, 0))
                    sofar[s] = start[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), pa.array([part] * len(n), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "start_in_part", "n", "ids"],
                )

    return run


@dataclass(frozen=True)
class Phase:
    """The tokens first .. first + size - 1 of all sequences laid end to end. of has, for each queue that gives
    tokens, how many it gave before, how many it gives, and its path in the tree of queues from the root: a step
    to the left child is the left child's share, a step to the right one is that share negated (in parts of ONE)."""

    first: int
    size: int
    of: dict[int, tuple[int, int, tuple[int, ...]]]

    @property
    def count(self) -> int:
        """Whole windows of the phase."""
        return max(0, (self.first + self.size) // WINDOW - -(-self.first // WINDOW))


#: Shares of a tree's left children are whole parts of this.
_BITS = 62
ONE = 1 << _BITS
_HALF = _BITS // 2


def _paths(weights: dict[int, int]) -> dict[int, tuple[int, ...]]:
    """The path of each queue in the Huffman tree of the weights (all positive)."""
    heap: list[tuple] = [(w, q, None) for q, w in sorted(weights.items())]
    heapify(heap)
    name = max(weights) + 1
    while len(heap) > 1:
        a, b = heappop(heap), heappop(heap)
        heappush(heap, (a[0] + b[0], name, (a, b)))
        name += 1
    out, todo = {}, [(heap[0], ())]
    while todo:
        (w, q, children), path = todo.pop()
        if children is None:
            out[q] = path
            continue
        share = -(-(children[0][0] << _BITS) // w)
        todo += [(children[0], (*path, share)), (children[1], (*path, -share))]
    return out


def _given(c: int, path: tuple[int, ...]) -> int:
    """Tokens of the queue among a phase's first c."""
    for s in path:
        c = c * s >> _BITS if s > 0 else c - (c * -s >> _BITS)
    return c


def _until(m: int, path: tuple[int, ...]) -> int:
    """The largest number of a phase's tokens that has at most m of the queue."""
    for s in reversed(path):
        m = ((m + 1 << _BITS) - 1) // s if s > 0 else (m << _BITS) // (ONE + s)
    return m


def schedule(lengths: list[int], targets: list[float]) -> list[Phase]:
    """The phases that give out all tokens: at most one for each queue with a target, and one for the rest."""
    left, taken = dict(enumerate(lengths)), [0] * len(lengths)
    top = max(targets, default=0.0)
    phases, first = [], 0
    while left := {q: n for q, n in left.items() if n}:
        live = {q: max(1, round(targets[q] / top * (1 << 50))) for q in left if targets[q] > 0}
        # Weights in proportion to what is left end all queues together: the shares are rounded up, so that
        # all of a node's tokens give its left child exactly the child's.
        if not live or all(targets[q] == n for q, n in left.items()):
            live = dict(left)
        paths = _paths(live)
        size = min(_until(left[q], p) for q, p in paths.items())
        give = {q: _given(size, p) for q, p in paths.items()}
        phases.append(Phase(first, size, {q: (taken[q], g, paths[q]) for q, g in give.items() if g}))
        first += size
        for q, g in give.items():
            taken[q], left[q] = taken[q] + g, left[q] - g
    return phases


def _part(c: np.ndarray, share: int) -> np.ndarray:
    """c * share / ONE rounded down, by halves of 31 bits."""
    s1, s0 = np.uint64(share >> _HALF), np.uint64(share & (1 << _HALF) - 1)
    h, mask = np.uint64(_HALF), np.uint64((1 << _HALF) - 1)
    c1, c0 = c >> h, c & mask
    return c1 * s1 + (c1 * s0 + c0 * s1 + (c0 * s0 >> h) >> h)


def cut_in_phase(starts: list[int], ends: list[int], first: int, size: int, base: int, path: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(number of the stretch, place in the queue, length, sequence, offset) of the pieces of some stretches of a
    queue, all within the phase."""
    window = lambda i: (first + _until(i - base, path)) // WINDOW
    each = []
    for a, b in zip(starts, ends, strict=True):
        w0, w1 = window(a), window(b - 1)
        # A rare source's tokens can be many windows apart.
        each.append(np.arange(w0, w1 + 1) if w1 - w0 < b - a else np.unique([window(i) for i in range(a, b)]))
    w = np.concatenate(each)
    who = np.repeat(np.arange(len(starts)), [len(x) for x in each])
    lo = np.clip(w * WINDOW - first, 0, size).astype(np.uint64)
    hi = np.clip((w + 1) * WINDOW - first, 0, size).astype(np.uint64)
    off = np.maximum(first - w * WINDOW, 0).astype(np.uint64)
    for s in path:
        x, y = _part(lo, abs(s)), _part(hi, abs(s))
        if s < 0:
            off += y - x
            x, y = lo - x, hi - y
        lo, hi = x, y
    at, to, off = lo.astype(np.int64) + base, hi.astype(np.int64) + base, off.astype(np.int64)
    s, e = np.maximum(at, np.array(starts, np.int64)[who]), np.minimum(to, np.array(ends, np.int64)[who])
    use = e > s
    return who[use], s[use], (e - s)[use], w[use], (off + s - at)[use]


def cut(a: int, n: int, q: int, phases: list[Phase]) -> Iterator[tuple[int, int, int, int]]:
    """(tokens before, length, sequence, offset) of each piece of the document at a .. a+n-1 of queue q."""
    for p in phases:
        base, size, path = p.of.get(q, (0, 0, ()))
        lo, hi = max(a, base), min(a + n, base + size)
        if lo < hi:
            _, s, k, seq, off = cut_in_phase([lo], [hi], p.first, p.size, base, path)
            yield from zip((s - a).tolist(), k.tolist(), seq.tolist(), off.tolist(), strict=True)


def _inner_paths(t: pa.Table) -> pa.Table:
    """The path of each source of a group in the group's own tree."""
    t = t.sort_by("source")
    n = t.column("n").to_pylist()
    paths = _paths(dict(enumerate(n)))
    return pa.table({"g": t.column("g"), "source": t.column("source"), "gives": t.column("n"), "inner": pa.array([list(paths[i]) for i in range(len(n))], pa.list_(pa.int64()))})


def _shares(rows: list[tuple], key: str, kind: pa.DataType) -> pa.Table:
    """What each queue gives in each phase, by its key: a source or a group."""
    kinds = {key: kind, "first": pa.int64(), "size": pa.int64(), "base": pa.int64(), "gives": pa.int64(), "path": pa.list_(pa.int64())}
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


_PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(x.split()[0] for x in _PIECES.split(", ")), "ids"]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
        for b in (given.slice(at, _AT_ONCE) for given in batches for at in range(0, given.num_rows, _AT_ONCE)):
            docs, sources, starts, firsts = (b.column(c).to_pylist() for c in ("doc_id", "source", "start", "first"))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(sources, firsts, strict=True)):
                groups.setdefault(key, []).append(i)
            rows: list[tuple] = []
            for (source, first), rs in groups.items():
                size, base, gives, path = (b.column(c)[rs[0]].as_py() for c in ("size", "base", "gives", "path"))
                whole = [np.frombuffer(b.column("ids")[i].as_py(), np.uint16).astype("<u4") for i in rs]
                lo = [max(starts[i], base) for i in rs]
                hi = [min(starts[i] + len(x), base + gives) for i, x in zip(rs, whole, strict=True)]
                for k, s, n, seq, off in zip(*(x.tolist() for x in cut_in_phase(lo, hi, first, size, base, path)), strict=True):
                    s -= starts[rs[k]]
                    piece = whole[k][s : s + n].tobytes()
                    rows.append((docs[rs[k]], source, s, n, zlib.crc32(piece), len(whole[k]), seq, off, piece if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            use = len(names) - (not with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:use], kinds[:use], strict=True)], names[:use])

    return run


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (with_ids: and ids, little-endian unsigned 32-bit).

    targets: the wanted share of each source; those not named have none until
    the named ones are used up, and then go in proportion to their tokens.
    Without targets, each source's share is its part of all tokens, so that
    all queues end together. Every source has a queue of its own; the driver
    makes the schedule from the named sources and from at most 4096 groups of
    the others, whose sources are told apart by trees that tasks make.

    A null text is empty (its end id alone), a null source is the empty one.
    Repeated rows are documents of their own; an empty table has no pieces.
    Only the last sequence can be shorter than 1024. A vocabulary with ids
    above 65535 is an error.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), "text")
    schema = "doc_id long, source string, part long, start_in_part long, n long, ids binary"
    tokens = materialize(given.mapInArrow(_encode(tokenizer), schema), "tokens", TEXTS_AT_ONCE)
    parts = materialize(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "parts")
    sizes = materialize(parts.groupBy("source").agg(F.sum("n").alias("n")).withColumn("g", F.pmod(F.xxhash64("source"), F.lit(GROUPS))), "sizes")
    named = F.col("source").isin(list(targets or {}))
    lengths = {(False, r["source"]): r["n"] for r in sizes.where(named).collect()} if targets else {}
    rest = sizes.where(~named) if targets else sizes
    lengths |= {(True, r["g"]): r["n"] for r in rest.groupBy("g").agg(F.sum("n").alias("n")).collect()}  # GROUPS rows at most
    queues = sorted(lengths, key=str)
    wanted = [float(lengths[q]) if targets is None else 0.0 if q[0] else targets[q[1]] for q in queues]
    phases = schedule([lengths[q] for q in queues], wanted)
    rows = [(*queues[q], p.first, p.size, base, gives, list(path)) for p in phases for q, (base, gives, path) in p.of.items()]
    # A group gives all its tokens in one phase, the last, in which all queues end together; so do its sources.
    if any(grouped and (base or gives != lengths[True, name]) for grouped, name, _, _, base, gives, _ in rows):
        raise RuntimeError("a group of sources was cut by a phase")
    # As Arrow tables: rows in Python lists would start Python processes of their own beside the ones that encode.
    of_named = spark.createDataFrame(_shares([r[1:] for r in rows if not r[0]], "source", pa.string()))
    of_groups = spark.createDataFrame(_shares([r[1:] for r in rows if r[0]], "g", pa.int64())).drop("gives")
    inner = rest.groupBy("g").applyInArrow(_inner_paths, "g long, source string, gives long, inner array<long>")
    of_rest = inner.join(F.broadcast(of_groups), "g")  # GROUPS rows at most
    of_rest = of_rest.select("source", "first", "size", "base", "gives", F.concat("path", "inner").alias("path"))
    plan = materialize(of_named.unionByName(of_rest), "plan")
    # A row for each source and input partition: at most the partitions of one read for a source. The window orders them within a queue.
    order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("source", "part", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # ... and for each phase in which it gives tokens.
    inside = (F.col("base") < F.col("before") + F.col("n")) & (F.col("base") + F.col("gives") > F.col("before"))
    starts = materialize(starts.join(plan, "source").where(inside).drop("n"), "starts")
    start = F.col("before") + F.col("start_in_part")
    placed = tokens.join(starts, ["source", "part"]).where((F.col("base") < start + F.col("n")) & (F.col("base") + F.col("gives") > start))
    placed = placed.select("doc_id", "source", start.alias("start"), "ids", "first", "size", "base", "gives", "path")
    # Written here, as only so do the tasks that cut get few documents at once; with that the ids have been read for the last time.
    pieces = materialize(placed.mapInArrow(_cut(with_ids), _PIECES + (", ids binary" if with_ids else "")), "pieces", TEXTS_AT_ONCE)
    discard(tokens)
    return pieces
