"""Drift of many columns at once against saved references.

A reference is a row: the column's name, its number of finite values, the
inner edges of its quantile bins (the outer bins are open) and the parts of
the values in each bin. References are small tables that are saved with a
model; recent rows are counted against all of them in one grouped pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import arrays, order_stats

#: Where drift is moderate and significant, and the least part of a bin.
DRIFT_MODERATE, DRIFT_SIGNIFICANT, EPS = 0.10, 0.25, 1e-6
REFERENCE = "name string, n long, inner array<double>, fractions array<double>"


def inner_edges(q: list[float]) -> list[float]:
    """The bins' edges from quantiles: without repeats and without the outer two, which are open."""
    return sorted(set(q))[1:-1]


def bucket_of(x: Column, inner: Column) -> Column:
    """Bin number by inner edges: [a, b), the outer bins open."""
    return F.size(F.filter(inner, lambda e: x >= e))


def long_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """name and x, the values of the columns that df has."""
    have = [c for c in columns if c in df.columns]
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x")) for c in have])
    return df.select(F.explode(values).alias("v")).select("v.*") if have else df.sparkSession.createDataFrame([], "name string, x double")


def _counts(long: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n and counts (a map from bin to values) of finite values."""
    finite = long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    # edges: a row for each reference.
    held = finite.join(F.broadcast(edges.select("name", "inner")), "name").groupBy("name", bucket_of(F.col("x"), F.col("inner")).alias("bin")).agg(F.count("*").alias("c"))
    return _by_name(held)


def _by_name(bins: DataFrame) -> DataFrame:
    return bins.groupBy("name").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("counts"))


def _counts_of(df: DataFrame, columns: list[str], inner: dict[str, list[float]]) -> DataFrame:
    """As _counts, of columns: each task counts the finite values of all of them by their inner edges."""
    edges = [np.array(inner[c], float) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(e) + 1, np.int64) for e in edges]
        for table in arrays.held(batches, order_stats.BLOCK):
            for of, e, v in zip(total, edges, np.ascontiguousarray(arrays.matrix(table.column(0).combine_chunks(), len(edges)).T), strict=True):
                of += np.bincount(np.searchsorted(e, v[np.isfinite(v)], side="right"), minlength=len(of))
        for c, of in zip(columns, total, strict=True):
            at = np.flatnonzero(of)
            yield pa.RecordBatch.from_pydict({"name": pa.array([c] * len(at), pa.string()), "bin": at.astype(np.int32), "c": of[at]})

    found = df.select(arrays.row_of(columns)).mapInArrow(run, "name string, bin int, c long")
    return _by_name(found.groupBy("name", "bin").agg(F.sum("c").alias("c")))


def _parts(counts: str, n: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("inner")), lambda b: F.coalesce(F.try_element_at(counts, b), F.lit(0)) / F.col(n))


def references(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """A reference of each column; fractions are null where there are less than two finite values."""
    return references_and_medians(df, columns, bins)[0]


def references_and_medians(df: DataFrame, columns: list[str], bins: int = 10) -> tuple[DataFrame, dict[str, float]]:
    """The references, and the median of each column that has a finite value, from the same passes."""
    spark = df.sparkSession
    held = written(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), "reference")
    found = order_stats.select(held, {c: [*[i / bins for i in range(bins + 1)], 0.5] for c in columns})
    inner = {c: inner_edges(found["", c][1][:-1]) if ("", c) in found else [] for c in columns}
    edges = spark.createDataFrame([*inner.items()], "name string, inner array<double>")
    counts = _counts_of(held, columns, inner).withColumnRenamed("name", "of")
    out = edges.join(counts, F.col("name") == F.col("of"), "left")
    out = out.select("name", F.coalesce("n", F.lit(0)).alias("n"), "inner", F.when(F.col("n") >= 2, _parts("counts", "n")).alias("fractions"))
    return out, {c: float(found["", c][1][-1]) for c in columns if ("", c) in found}


def status(psi: Column) -> Column:
    return F.when(psi.isNull(), "unavailable").when(psi >= DRIFT_SIGNIFICANT, "significant").when(psi >= DRIFT_MODERATE, "moderate").otherwise("stable")


def stability(recent: DataFrame, reference: DataFrame) -> DataFrame:
    """name, n_reference, n_recent, bins, psi and status of each reference, for recent values (name, x).

    psi is null and the status unavailable where the reference has no bins or
    there are less than two recent finite values.
    """
    return _stability(_counts(recent, reference), reference)


def stability_of(recent: DataFrame, columns: list[str], reference: DataFrame) -> DataFrame:
    """As stability, for the columns of recent that have a reference."""
    inner = {r["name"]: r["inner"] for r in reference.collect()}  # a row a column
    return _stability(_counts_of(recent, [c for c in columns if c in inner], inner), reference)


def _stability(counts: DataFrame, reference: DataFrame) -> DataFrame:
    counts = counts.select(F.col("name").alias("of"), F.col("n").alias("n_recent"), "counts")
    out = reference.join(counts, F.col("name") == F.col("of"), "left")
    at_least = lambda x: F.greatest(x, F.lit(EPS))
    terms = F.zip_with(_parts("counts", "n_recent"), "fractions", lambda p, q: (at_least(p) - at_least(q)) * F.ln(at_least(p) / at_least(q)))
    psi = F.when((F.col("n_recent") >= 2) & F.col("fractions").isNotNull(), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    out = out.select("name", F.col("n").alias("n_reference"), F.coalesce("n_recent", F.lit(0)).alias("n_recent"), (F.size("inner") + 1).cast("long").alias("bins"), psi.alias("psi"))
    return out.withColumn("status", status(F.col("psi")))
