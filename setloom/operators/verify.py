"""Exact verification and de-duplication of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passes(sim: Column, threshold: float, strict: bool) -> Column:
    return sim > threshold if strict else sim >= threshold


def scored(counted: DataFrame, threshold: float | None, strict: bool) -> DataFrame:
    """(rid1, rid2, overlap, sim) of pairs (rid1, rid2, n1, n2, overlap) that pass; all of them without a threshold."""
    out = counted.select("rid1", "rid2", F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / (F.col("n1") + F.col("n2") - F.col("overlap"))).alias("sim"))
    return out if threshold is None else out.where(passes(F.col("sim"), threshold, strict))


def verify(pairs: DataFrame, r: DataFrame, s: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Attaches both token arrays to distinct candidates and counts what they share."""
    sides = [x.select(F.col("rid").alias(f"rid{k}"), F.col("n").alias(f"n{k}"), F.col("toks").alias(f"toks{k}")) for k, x in ((1, r), (2, s))]
    both = pairs.join(sides[0], "rid1").join(sides[1], "rid2")
    return scored(both.select("rid1", "rid2", "n1", "n2", F.size(F.array_intersect("toks1", "toks2")).alias("overlap")), threshold, strict)


def canonical(pairs: DataFrame, a: str = "rid1", b: str = "rid2") -> DataFrame:
    """Distinct pairs, the smaller id first, without pairs of an id with itself."""
    return pairs.select(F.least(a, b).alias("rid1"), F.greatest(a, b).alias("rid2")).where("rid1 < rid2").distinct()


def missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of ``expected`` that aren't among ``found``, in either order; the reverse call gives the extra ones."""
    return canonical(expected).join(canonical(found), ["rid1", "rid2"], "left_anti")


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(rid1, rid2, what): ``missing`` or ``extra`` pairs; empty if both agree."""
    return missing(expected, found).withColumn("what", F.lit("missing")).unionByName(missing(found, expected).withColumn("what", F.lit("extra")))


def union_results(*results: DataFrame) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return canonical(out)
