"""Reading and writing token sets and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of a line: integer tokens, integer tokens and text, raw text, none of these.
INTEGERS, INTEGERS_AND_TEXT, RAW, UNKNOWN = "integers", "integers_and_text", "raw", "unknown"


def line_kind(line: Column) -> Column:
    line = F.trim(line)
    return F.when(line.rlike(r"^-?\d+\s+-?\d+(,-?\d+)*$"), INTEGERS).when(line.rlike(r"^-?\d+\s+-?\d+(,-?\d+)*\s+\S"), INTEGERS_AND_TEXT).when(line.rlike(r"\S"), RAW).otherwise(UNKNOWN)


def input_kind(lines: DataFrame) -> str:
    """The kind of the first line that isn't blank (of the first partition that has one)."""
    row = lines.where(F.trim("value") != "").select(line_kind(F.col("value")).alias("kind")).limit(1).collect()
    return row[0]["kind"] if row else UNKNOWN


def parse_sets(lines: DataFrame) -> DataFrame:
    """(rid, tokens, text) of lines ``rid tokens [text]``, tokens being integers between commas; other lines go."""
    parts = F.split(F.trim("value"), r"\s+", 3)
    rid = parts[0].try_cast("long")
    tokens = F.transform(F.filter(F.split(F.get(parts, F.lit(1)), ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    out = lines.select(rid.alias("rid"), tokens.alias("tokens"), F.get(parts, F.lit(2)).alias("text"))
    return out.where("rid is not null and size(tokens) > 0 and not exists(tokens, t -> t is null)")


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_sets(spark.read.text(path))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(value): one record a line, without ids."""
    return spark.read.text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one line."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.trim(F.regexp_replace("value", r"[\r\n]+", " ")).alias("text"))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each mail's body, from its first blank line on."""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", r"^(?s).*?\r?\n\r?\n", "")
    return whole.select(F.input_file_name().alias("path"), F.trim(F.regexp_replace(body, r"[\r\n]+", " ")).alias("text"))


def parse_keyed(lines: DataFrame) -> DataFrame:
    """(rid, line) of lines that begin with an id."""
    return lines.select(F.split(F.trim("value"), r"\s+", 2)[0].try_cast("long").alias("rid"), F.col("value").alias("line")).where("rid is not null")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return parse_keyed(spark.read.text(path))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(rid1, rid2) of lines of two ids, the smaller first, once each."""
    parts = F.split(F.trim("value"), r"\s+")
    both = spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("long").alias("a"), F.get(parts, F.lit(1)).try_cast("long").alias("b")).where("a is not null and b is not null")
    return both.select(F.least("a", "b").alias("rid1"), F.greatest("a", "b").alias("rid2")).distinct()


def write_sets(sets: DataFrame, path: str) -> None:
    sets.select(F.concat_ws("\t", F.col("rid").cast("string"), F.array_join(F.col("tokens").cast("array<string>"), ","))).write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, path: str, with_similarity: bool = False) -> None:
    columns = ["rid1", "rid2", *(["sim"] if with_similarity else [])]
    pairs.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])).write.mode("overwrite").text(path)
