"""SimHash near-dedup through an inverted index of fingerprint bytes.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of
their 8 bytes, so at least 4 bytes are equal at the same position. A list of
all fingerprints that share one byte would hold a 256th of the corpus; the
index therefore posts each fingerprint under its 70 sets of 4 positional
bytes, of which a linked pair shares one at least. Within a list the shared
positional bytes of each pair are tallied, pairs with 4 or more stay, and
the differing bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_AT_ONCE, discard, join_counted, materialize, spark_partitions

SHINGLE, MAX_BITS = 4, 4
MIN_BYTES = 8 - MAX_BITS
SETS = list(combinations(range(8), MIN_BYTES))
#: Longer lists are split by common neighbours instead of by pairs (see `_far_links`).
MAX_LIST = 2048
#: Fingerprints that one task posts, about.
POSTED = 20_000


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles, by the majority of each bit of XXH64 (seed 42).

    A-Z count as lower case; fewer than 4 words make one shingle of all;
    a text without words (or null) has fingerprint 0.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text in blocks
        bits += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(t.as_py()) for t in b.column(2)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f.view(np.int64))], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a signed long), a row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        split = fp.view(np.uint8).reshape(-1, 8).astype(np.int64)
        for n, at in enumerate(SETS):
            key = np.full(len(fp), n, np.int64)
            for p in at:
                key = (key << 8) | split[:, p]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _star(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the linked fingerprints of one list: each to the first of its group."""
    n = len(fps)
    label = np.arange(n)
    raw = fps.view(np.uint8).reshape(-1, 8)
    for i in range(n - 1):
        x = raw[i + 1 :] ^ raw[i]
        shared = (x == 0).sum(axis=1) >= MIN_BYTES  # the tally of positional bytes
        near = np.flatnonzero(shared)
        near = near[_POP[x[near]].sum(axis=1) <= MAX_BITS] + i + 1
        if len(near):
            ls = np.unique(label[near])
            low = min(label[i], ls[0])
            label[np.isin(label, np.append(ls, label[i]))] = low
    at = np.flatnonzero(label != np.arange(n))
    return fps[at], fps[label[at]]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The lists of a partition sorted by key, as they pass."""
    held: list[np.ndarray] = []
    last = None
    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        edges = np.concatenate(([0], cuts, [len(key)]))
        if last is not None and key[0] != last:
            yield last, np.concatenate(held)
            held = []
        last = key[-1]
        if len(edges) > 2:
            yield key[0], np.concatenate([*held, fp[: edges[1]]])
            held = []
            for k in np.flatnonzero(np.diff(edges[1:-1]) > 1) + 1:
                yield key[edges[k]], fp[edges[k] : edges[k + 1]]
        held.append(fp[edges[-2] :])
    if last is not None:
        yield last, np.concatenate(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, fps in _lists(batches):
        if 1 < len(fps):
            x, y = _star(fps)
            a.append(x), b.append(y)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _near_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For members of long lists: the values that differ from the fingerprint in at most 2 bits outside the list's bytes."""
    one = np.int64(1)
    for b in batches:
        for key, fp in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), strict=True):
            free = [8 * p + j for p in range(8) if p not in SETS[key >> 32] for j in range(8)]
            flips = np.array([one << np.int64(j) for j in free])
            i, j = np.triu_indices(len(flips), 1)
            near = np.concatenate(([fp], fp ^ flips, fp ^ flips[i] ^ flips[j]))
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.full(len(near), fp))], ["value", "fp"])


def _far_links(long_lists: DataFrame) -> DataFrame:
    """Links within lists of any length, without pairs.

    Fingerprints that share a value within 2 bits of each are at most 4 bits
    apart, and any two at most 4 apart share one. Each value links its
    fingerprints to the smallest, so the rows are 529 a member at most.
    """
    near = long_lists.mapInArrow(_near_values, "value long, fp long")
    least = near.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Links (a, b) over distinct fingerprints (column fp) that give the same components as all pairs at most 4 bits apart."""
    tasks = max(spark_partitions(fps), fps.count() // POSTED + 1)
    posted = materialize(fps.repartition(tasks, "fp").mapInArrow(_postings, "key long, fp long"), "postings")
    long_keys = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_LIST).select("key"), "long-lists")
    short = posted.join(long_keys, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    links = short.mapInArrow(_links, "a long, b long")
    if not long_keys.isEmpty():
        links = links.unionByName(_far_links(posted.join(long_keys, "key", "left_semi")))
    return materialize(links.distinct(), "links")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that links lead to, for every node that has a link.

    Each round sends every node the smallest label among its neighbours and
    then follows labels of labels (pointer jumping), so chains shorten by
    more than half a round. Stops when no label changes; the tables are
    written once a round, and nothing but a flag comes to the driver.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = materialize(edges.unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u <> v").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root"), F.count("*").alias("degree")), "labels")
    total, ends = labels.count(), edges.count()
    for _ in range(max_rounds):
        near = join_counted(edges, labels, "v", "node", "degree", ends).groupBy(F.col("u").alias("n1")).agg(F.min("root").alias("near"))
        # A root also hears from the nodes below it, so that whole stars move at once.
        heard = labels.join(near, F.col("node") == F.col("n1")).select("node", "degree", "root", F.least("root", "near").alias("low"))
        heard = materialize(heard, "heard")
        roots = heard.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("r_low"), F.count("*").alias("below"))
        jump = join_counted(heard, roots, "root", "r", "below", total).select("node", "degree", "root", F.least("low", "r_low").alias("low"))
        jump = materialize(jump, "jump")
        # A label is a node itself; its own label is the next one.
        lows = jump.groupBy(F.col("low").alias("l")).agg(F.count("*").alias("below"))
        up = lows.join(jump.select(F.col("node").alias("up"), F.col("low").alias("up_low")), F.col("l") == F.col("up"))
        moved = join_counted(jump, up, "low", "up", "below", total).select("node", "degree", F.col("root").alias("old"), F.col("up_low").alias("root"))
        moved = materialize(moved, "labels")
        for done in (labels, heard, jump):
            discard(done)
        labels = moved.select("node", "root", "degree")
        if moved.where("root <> old").isEmpty():
            discard(edges)
            return labels.select("node", "root")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _nodes(rows: DataFrame) -> DataFrame:
    """fp, n (rows that have it), first_id (their smallest doc_id) and root, the smallest fingerprint reachable; one row a fingerprint."""
    nodes = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "nodes")
    found = components(link_fingerprints(nodes.select("fp")))
    # Both sides have a node once; those without a link are their own root.
    return materialize(nodes.join(found, nodes.fp == found.node, "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")), "roots")


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), a row for each row of docs.

    Texts without words, empty or null, share fingerprint 0, which links like
    any other. A null doc_id gets a component but never names one, unless all
    ids of the component are null (then null). Equal fingerprints meet first,
    so a group of copies of any size is one node.
    """
    rows = materialize(fingerprints(docs), "fingerprints", TEXTS_AT_ONCE)
    nodes = _nodes(rows)
    named = nodes.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes"))
    names = join_counted(nodes, named, "root", "r", "nodes", nodes.count())
    names = materialize(names.select(F.col("fp").alias("node"), F.col("n").alias("of_node"), "component_id"), "names")
    out = join_counted(rows, names, "fp", "node", "of_node", rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then of the smallest hash of its text.

    A row with a null doc_id stays only where its component has no other id.
    Of rows equal in doc_id and text, one stays. What goes is found on ids and
    hashes alone; whole rows move only where a row that stays is repeated.
    """
    rows = materialize(fingerprints(docs), "fingerprints", TEXTS_AT_ONCE)
    nodes = _nodes(rows).select(F.col("fp").alias("node"), F.col("n").alias("of_node"), "root")
    # Rows equal in id and text have one fingerprint, so a key belongs to one component.
    keys = rows.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("times"))
    keys = materialize(join_counted(keys, nodes, "fp", "node", "of_node", rows.count()).select("doc_id", "text_hash", "root", "times"), "keys")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("times").alias("times"))
    first = keys.groupBy(F.col("root").alias("r")).agg(F.min(order).alias("k"), F.count("*").alias("held"))
    marked = materialize(join_counted(keys, first, "root", "r", "held", keys.count()).select("doc_id", "text_hash", "times", (F.col("doc_id").eqNullSafe(F.col("k.id")) & (F.col("text_hash") == F.col("k.hash"))).alias("stays")), "marked")
    gone, repeated = (materialize(marked.where(x).select("doc_id", "text_hash"), t) for x, t in (("NOT stays", "gone"), ("stays AND times > 1", "repeated")))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    on = lambda t: given.id.eqNullSafe(t.doc_id) & (given.th == t.text_hash)
    kept = given.join(gone, on(gone), "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(repeated, on(repeated), "left_anti")
    return once.unionByName(given.join(repeated, on(repeated), "left_semi").dropDuplicates(["id", "th"])).select("row.*")
