"""Statistics of collections and of candidate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_stats(posts: DataFrame) -> DataFrame:
    """(records, tokens, min_len, max_len) of postings; tokens counts the distinct ones."""
    sizes = posts.groupBy("rid").agg(F.count("*").alias("n")).agg(F.count("*").alias("records"), F.min("n").alias("min_len"), F.max("n").alias("max_len"))
    return sizes.crossJoin(posts.agg(F.countDistinct("tok").alias("tokens"))).select("records", "tokens", "min_len", "max_len")


def _histogram(values: DataFrame, buckets: int) -> DataFrame:
    ends = values.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / buckets), F.lit(1)).cast("long")
    placed = values.crossJoin(ends).select(F.floor((F.col("n") - F.col("lo")) / width).cast("long").alias("bucket"), "lo", width.alias("w"))
    lower = F.col("lo") + F.col("bucket") * F.col("w")
    return placed.groupBy("bucket", "lo", "w").agg(F.count("*").alias("records")).select("bucket", lower.cast("long").alias("lower"), (lower + F.col("w") - 1).cast("long").alias("upper"), "records")


def length_histogram(posts: DataFrame, buckets: int = 20) -> DataFrame:
    """(bucket, lower, upper, records): set sizes in buckets of equal width; empty ones are left out."""
    return _histogram(posts.groupBy("rid").agg(F.count("*").alias("n")), buckets)


def frequency_histogram(posts: DataFrame, buckets: int = 10) -> DataFrame:
    """The same of token frequencies."""
    return _histogram(posts.groupBy("tok").agg(F.count("*").alias("n")), buckets)


def length_stats(posts: DataFrame) -> DataFrame:
    """(n, records) by set size."""
    return posts.groupBy("rid").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("records"))


def expected_length(posts: DataFrame) -> DataFrame:
    return posts.groupBy("rid").agg(F.count("*").alias("n")).agg(F.avg("n").alias("expected"))


def replication_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, rows, min_rows, max_rows, avg_rows) of the rows that each key of a shuffle gets."""
    load = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return load.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"))


def cardinality(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records"))


def cell_sizes(cells: DataFrame) -> DataFrame:
    """(pivot, records) of records at home in each metric cell."""
    return cells.where("home").groupBy("pivot").agg(F.count("*").alias("records"))


def average_runtimes(runs: DataFrame) -> DataFrame:
    """(algorithm, dataset, threshold, seconds, runs): repeated experiments averaged, by algorithm."""
    return runs.groupBy("algorithm", "dataset", "threshold").agg(F.avg("seconds").alias("seconds"), F.count("*").alias("runs")).orderBy("algorithm", "dataset", "threshold")


def zipf_sets(spark, records: int = 100, tokens: int = 1000, max_length: int = 100, exponent: float = 0.5, seed: int = 1) -> DataFrame:
    """(rid, tokens): bags whose lengths and tokens follow Zipf's law by inverse distribution; repeats happen."""

    def inverse(u, size: int):
        # The continuous law: F(x) = (x^(1-e) - 1) / (size^(1-e) - 1), for an exponent other than 1.
        e = 1 - exponent if exponent != 1 else 1e-9
        return F.least(F.floor(F.pow(u * (float(size + 1) ** e - 1) + 1, F.lit(1 / e))), F.lit(size)).cast("int")

    lengths = spark.range(1, records + 1).select(F.col("id").alias("rid"), inverse(F.rand(seed), max_length).alias("n"))
    each = lengths.select("rid", F.explode(F.sequence(F.lit(1), "n")).alias("i")).withColumn("tok", inverse(F.rand(seed + 1), tokens))
    return each.groupBy("rid").agg(F.collect_list("tok").alias("tokens"))
