"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get their rank in key order (`number_rows`), a keyed permutation of
0..n-1 scatters the ranks (`permute`), and place p is slot p div k of shard
p mod k. Shard sizes differ by one row at most, and both directions can be
computed for any row number without a table.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, text_crc32

ROUNDS = 6
#: The round function works modulo this prime (2^31 - 1), so that products fit in 64 bits.
PRIME = 2147483647


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and summand of each round."""
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Half the width of the smallest even-width domain that holds 0..n-1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: list[tuple[int, int]], back: bool) -> np.ndarray:
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for a, b in reversed(keys) if back else keys:
        basis = left if back else right
        t = (basis * a + b) % PRIME
        mixed = (t * t % PRIME) & mask
        left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
    return (left << half) | right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (back: its inverse) at x, by cycle walking.

    A place outside 0..n-1 is sent through the network again until it falls
    inside; the walk ends because it runs along a cycle that starts inside.
    n may be up to 2^62.
    """
    keys, half = round_keys(seed), half_bits(n)
    out = _feistel(np.asarray(x, dtype=np.int64), half, keys, back)
    while (outside := out >= n).any():
        out[outside] = _feistel(out[outside], half, keys, back)
    return out


def place(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, keys: list[str], out: str = "row_no") -> tuple[DataFrame, int]:
    """df with each row's rank (from 0) in key order, and the number of rows.

    The rows are sorted by range over all tasks and counted by partition; no
    window runs over the whole table. Rows equal in all keys rank by their
    position in df, which also splits them when they are a third of the
    table. Only the counts, one a partition, meet in one place. A column of
    df with the name of the new one is replaced; no other name clashes.
    """
    base = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), "rows").withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("row").getField(k).asc_nulls_first() for k in keys] + [F.col("tie")]
    low = (1 << 33) - 1
    ranked = base.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranked = ranked.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(low))})
    ranked = materialize(ranked, "ranked")
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    n = starts.agg(F.sum("n")).first()[0] or 0
    # One row for each shuffle partition: at most some MB even for a million partitions.
    rows = ranked.join(F.broadcast(starts.select("part", "start")), "part")
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c != out]
    return rows.select(*kept, (F.col("start") + F.col("at")).alias(out)), n


def permuted(row_no: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def scatter(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return scatter(row_no)


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 20) -> DataFrame:
    """df with row_no, shard (0..shards-1) and slot (gapless from 0).

    Any columns may be null (nulls rank first). Repeated rows are rows of
    their own. An empty table stays empty. Columns of df named row_no, shard
    or slot are replaced.
    """
    df = df.drop("row_no", "shard", "slot")
    rows, n = number_rows(df, keys)
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    at = rows.select(kept, permuted(F.col("row_no"), n, seed).alias("at"))
    return at.select("row.*", (F.col("at") % shards).cast("int").alias("shard"), F.expr(f"at div {shards}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """Place each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no.

    size is the UTF-8 bytes of the text plus 8 (null: 8), text_crc32 the
    checksum of those bytes (null: that of none). Rows are numbered by
    doc_id, checksum and size; null ids come first. The law is `rows`, so
    grown_shard is null.
    """
    text = F.col("text")
    digest = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        text_crc32(text).alias("text_crc32"),
    )
    placed = shard_rows(digest, ["doc_id", "text_crc32", "size"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
