"""Merkle manifest of a dataset by a butterfly exchange.

Documents are leaves, ordered by id within their language. Leaves are cut in
aligned blocks of fanout ** BLOCK_LEVELS; each block is hashed up to its root
in one task. Then the blocks of a language meet round by round: in round r
those whose numbers differ in digit r alone (to the base of the fanout) send
each other the roots they have, and every one of them hashes the common
ancestor itself. After the last round each block knows its language's root
and all siblings on the way, so no pass leads down again. The languages'
roots are the leaves of a tree of their own, built in the same way.

A block that is missing at the ragged end of a tree takes part without a root
of its own, so that every partner exists and none is asked by many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .sharding import number_rows

FANOUT, BLOCK_LEVELS = 2, 12
#: Rounds of the exchange between two written tables.
ROUNDS_AT_ONCE = 4
STEP = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def levels(hashes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of each level from the leaves up: height levels above them, or (None) as many as lead to one node."""
    out = [hashes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _block(t: pa.Table, fanout: int, height: int) -> tuple[pa.Table, list[list[str]]]:
    """The rows of a block by position and the levels above them; a block that is a whole tree ends at its root."""
    t = t.sort_by("pos")
    blocks = -(-t.column("size")[0].as_py() // fanout**height)
    return t, levels(t.column("hash").to_pylist(), fanout, height if blocks > 1 else None)


def _roots(fanout: int, height: int) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t, up = _block(t, fanout, height)
        blocks = -(-t.column("size")[0].as_py() // fanout**height)
        return pa.table({"tree": t.column("tree")[:1], "block": t.column("block")[:1], "blocks": pa.array([blocks], pa.int64()), "hash": [up[-1][0]]})

    return run


def exchange(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """tree, block, top (the tree's root), upper (the siblings from the block's root to it) from tree, block, blocks (their number), hash."""
    deepest = blocks.agg(F.max("blocks")).first()[0] or 1
    rounds = 0
    while fanout**rounds < deepest:
        rounds += 1
    # The blocks that a tree lacks to a full power of the fanout.
    width = F.lit(1).cast("long")
    for r in range(rounds):
        width = F.when(F.col("blocks") > fanout**r, F.lit(fanout ** (r + 1))).otherwise(width)
    missing = F.filter(F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda j: F.col("block") + j * F.col("blocks")), lambda p: p < width)
    none = F.array().cast(STEP)
    state = blocks.select("tree", "block", "blocks", "hash", none.alias("upper"))
    if rounds:
        state = state.unionByName(blocks.select("tree", F.explode(missing).alias("block"), "blocks", F.lit(None).cast("string").alias("hash"), none.alias("upper")))
    for r in range(rounds):
        step = fanout**r
        digit = F.expr(f"block div {step} % {fanout}")
        # A tree that has its root already only keeps what it knows.
        digits = F.when(F.col("blocks") > step, F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(digit.cast("int")))
        sent = state.withColumn("digit", digit).select(
            "tree", "blocks", "digit", "hash", "upper", F.col("block").alias("by"), F.explode(F.transform(digits, lambda d: F.col("block") + (d - F.col("digit")) * step)).alias("block")
        )
        own = F.col("by") == F.col("block")
        met = sent.groupBy("tree", "blocks", "block").agg(
            F.array_sort(F.collect_list(F.struct("digit", "hash"))).alias("met"),
            F.first(F.when(own, F.col("upper")), ignorenulls=True).alias("upper"),
            F.first(F.when(own, F.col("digit")), ignorenulls=True).alias("digit"),
            F.first(F.when(own, F.col("hash")), ignorenulls=True).alias("hash"),
        )
        said = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x.hash), "")
        active = F.col("blocks") > step
        above = F.when(F.exists("met", lambda x: x.hash.isNotNull()), F.sha2(said(lambda x: x.hash.isNotNull()).cast("binary"), 256))
        siblings = F.struct(said(lambda x: x.digit < F.col("digit")).alias("before"), said(lambda x: x.digit > F.col("digit")).alias("after"))
        state = met.select(
            "tree",
            "block",
            "blocks",
            F.when(active, above).otherwise(F.col("hash")).alias("hash"),
            F.when(active, F.concat("upper", F.array(siblings))).otherwise(F.col("upper")).alias("upper"),
        )
        if r % ROUNDS_AT_ONCE == ROUNDS_AT_ONCE - 1:
            state = materialize(state, "exchange")
    return state.where("block < blocks").select("tree", "block", F.col("hash").alias("top"), "upper")


def _tops(nodes: DataFrame, fanout: int, height: int) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, size, pos, hash, ...) with their block, and what each block knows after the exchange."""
    nodes = materialize(nodes.withColumn("block", F.expr(f"pos div {fanout**height}L")), "nodes")
    roots = nodes.select("tree", "size", "pos", "hash", "block").groupBy("tree", "block").applyInArrow(_roots(fanout, height), "tree long, block long, blocks long, hash string")
    return nodes, materialize(exchange(materialize(roots, "blocks"), fanout), "tops")


def _proofs(fanout: int, height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(t: pa.Table, top: pa.Table) -> pa.Table:
        t, up = _block(t, fanout, height)
        shared = [(s["before"], s["after"]) for s in top.column("upper")[0].as_py()]
        before, after = [], []
        for i in range(t.num_rows):
            for level in up[:-1]:
                first = i - i % fanout
                before.append("".join(level[first:i]))
                after.append("".join(level[i + 1 : first + fanout]))
                i //= fanout
            before += [b for b, _ in shared]
            after += [a for _, a in shared]
        deep = len(up) - 1 + len(shared)
        steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array([deep * i for i in range(t.num_rows + 1)], pa.int32()), steps)
        same = {c: pa.array([top.column(c)[0].as_py()] * t.num_rows, pa.string()) for c in ("subroot", "root")}
        return pa.table({"pos": t.column("pos"), "tree": t.column("tree"), "leaf": t.column("hash"), **same, "proof": proof, "rest": t.column("rest")})

    return run


def prove(leaves: DataFrame, tree: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT, height: int = BLOCK_LEVELS) -> DataFrame:
    """leaves with subroot, root and proof: array of struct<before, after>, the siblings on each side from the leaf to the root.

    One tree for each value of column tree (null is a value, and the first),
    its leaves in the order of the columns given and then of their hashes;
    the trees' roots, by value, are the leaves of the last tree. A tree of one
    leaf has that as its root. Columns of leaves named subroot, root or proof
    are replaced; an empty table stays empty.
    """
    names = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    given = leaves.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"))
    part = lambda c: F.col("rest").getField(c)
    keyed = given.select("rest", part(tree).alias("t"), *[part(c).alias(f"o{i}") for i, c in enumerate(order)], part(leaf).alias("hash"))
    rows, total = number_rows(keyed, ["t", *[f"o{i}" for i in range(len(order))], "hash"])
    if not total:
        return leaves.select(*names, F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(STEP).alias("proof")).limit(0)
    trees, n_trees = number_rows(rows.groupBy("t").agg(F.min("row_no").alias("first"), F.count("*").alias("size")), ["t"], "tree")
    trees = materialize(trees, "trees")
    # The table of trees is broadcast while small, by its file size, and joined by key beyond.
    placed = rows.join(trees.withColumnRenamed("t", "of"), F.col("t").eqNullSafe(F.col("of")))
    nodes, tops = _tops(placed.select("tree", "size", (F.col("row_no") - F.col("first")).alias("pos"), "hash", "rest"), fanout, height)
    subroots = tops.groupBy("tree").agg(F.first("top").alias("hash"))
    last = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("pos"), "hash", F.struct(F.lit(1).alias("one")).alias("rest"))
    of_trees, root = _tops(last, fanout, height)
    root = root.select("tree", "block", F.lit("").alias("subroot"), F.col("top").alias("root"), "upper")
    schema = lambda rest: T.StructType.fromDDL("pos long, tree long, leaf string, subroot string, root string, proof " + STEP).add("rest", rest)
    chains = of_trees.groupBy("tree", "block").cogroup(root.groupBy("tree", "block")).applyInArrow(_proofs(fanout, height), schema(of_trees.schema["rest"].dataType))
    chains = materialize(chains.select(F.col("pos").alias("of"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("chain")), "chains")
    known = tops.join(chains, F.col("tree") == F.col("of")).select("tree", "block", "subroot", "root", F.concat("upper", "chain").alias("upper"))
    out = nodes.groupBy("tree", "block").cogroup(known.groupBy("tree", "block")).applyInArrow(_proofs(fanout, height), schema(nodes.schema["rest"].dataType))
    return out.select(*[part(c).alias(c) for c in names], "subroot", "root", "proof")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def altered_leaf(every: int = 7) -> Column:
    """The leaf of a document of which n_chars grew by 1, for ids whose CRC-32 every divides; else the leaf as it is."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return leaf_hash(*[changed if c == "n_chars" else F.col(c) for c in FIELDS])


def manifest(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, lang, leaf, further columns of docs, subroot, root, proof; a row for each row of docs.

    Any column may be null (written as `-`); rows equal in language and id are
    leaves in the order of their hashes; null ids come first.
    """
    return prove(docs.select("doc_id", "lang", leaf_hash(*[F.col(c) for c in FIELDS]).alias("leaf"), *more), "lang", ["doc_id"])


def tampering_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: does the document, tampered with or not, still lead to the root?"""
    held = manifest(docs, altered_leaf().alias("now")).withColumn("folded_root", fold(F.col("now"), F.col("proof")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return held.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars, n_chars + 1 AS more,
         list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x // 2, (x % 2) * 3988292384))) AS raw
  FROM documents
),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(more AS VARCHAR)) || ':' || more, '-') || tail) AS changed, xor(raw, 4294967295) % 7 = 0 AS tampered
  FROM given
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed
),
nodes(tree, lvl, i, h, n) AS (
  SELECT tree, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 2, n
),
subroots AS (SELECT tree, lvl AS top, h FROM nodes WHERE n = 1),
upper(lvl, i, h, n) AS (
  SELECT 0, tree, h, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY lvl, i // 2, n
),
path(rid, tree, lvl, i, top, h, proof) AS (
  SELECT l.tree * 1000000000000 + l.i, l.tree, 0, l.i, s.top, CASE WHEN tampered THEN changed ELSE leaf END, ''
  FROM leaves l JOIN subroots s ON l.tree = s.tree
  UNION ALL
  SELECT p.rid, p.tree, p.lvl + 1, p.i // 2, p.top,
         sha256(CASE WHEN p.i % 2 = 1 THEN coalesce(b.h, '') || p.h ELSE p.h || coalesce(b.h, '') END), p.proof || coalesce(b.h, '')
  FROM path p LEFT JOIN nodes b ON b.tree = p.tree AND b.lvl = p.lvl AND b.i = xor(p.i, 1) WHERE p.lvl < p.top
),
chain(rid, lvl, i, h, proof) AS (
  SELECT rid, 0, tree, h, proof FROM path WHERE lvl = top
  UNION ALL
  SELECT c.rid, c.lvl + 1, c.i // 2, sha256(CASE WHEN c.i % 2 = 1 THEN coalesce(b.h, '') || c.h ELSE c.h || coalesce(b.h, '') END), c.proof || coalesce(b.h, '')
  FROM chain c LEFT JOIN upper b ON b.lvl = c.lvl AND b.i = xor(c.i, 1) WHERE c.lvl < (SELECT max(lvl) FROM upper)
)
SELECT l.doc_id, l.leaf, s.h AS subroot, u.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = u.h AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN chain c ON c.rid = l.tree * 1000000000000 + l.i AND c.lvl = (SELECT max(lvl) FROM upper), upper u
WHERE u.n = 1
"""
