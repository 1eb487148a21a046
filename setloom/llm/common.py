"""Shared kernels: lineage cuts, Arrow batches, word hashing, components, positions along a global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of ids up to which a list of ids is broadcast (about 24 bytes a row); above it, it is shuffled.
BROADCAST_IDS = 2_000_000
#: Bytes of text that a kernel takes at once; a longer text is taken alone and whole.
SLICE_BYTES = 1 << 19

#: Bytes of an Arrow batch, and Spark's default, from which on it is lowered.
BATCH_BYTES, DEFAULT_BYTES = 8 << 20, 64 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

U = np.uint64
_P, _P_INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# ---------------------------------------------------------------- lineage


def cut(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Only a ``local`` master without the setting gets a
    folder of its own; any other session without it is an error, since a local folder isn't shared.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="setloom-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder, which all executors share."""
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """df, written to a folder as Parquet and read again."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def semi(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is among ids: by broadcast up to BROADCAST_IDS ids, else by a shuffled semi-join."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")


# ---------------------------------------------------------------- Arrow


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow, with batches of fewer bytes unless the session already has less than the default: texts may be long."""
    conf = df.sparkSession.conf
    if int(conf.get(_BYTES).rstrip("bB")) >= DEFAULT_BYTES:
        conf.set(_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(kernel, schema)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        wide = np.frombuffer(column.buffers()[1], np.int64)
    elif len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    else:
        wide = np.frombuffer(column.buffers()[1], np.int32)
    offs = wide[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of a single longer row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def add_vectors(parts: DataFrame, kind: str, tasks: int) -> dict[object, tuple[float, np.ndarray]]:
    """{piece: (sum of n, sum of vectors)} of rows (piece, n long, vector binary) that ``tasks`` tasks sent.

    Sums go in two steps of about the square root of the tasks' number, so that no task holds all of a piece's vectors.
    """
    first, second = np.dtype(kind), np.dtype(np.int64 if np.dtype(kind).kind == "i" else np.float64)
    schema = f"piece {dict(parts.dtypes)['piece']}, n long, vector binary"

    def add(dtype: np.dtype) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            total = None
            for v in table.column("vector"):
                one = np.frombuffer(v.as_buffer(), dtype).astype(second)
                total = one if total is None else total + one
            return pa.table({"piece": table.column("piece").slice(0, 1).combine_chunks(), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "vector": pa.array([total.tobytes()], pa.binary())})

        return run

    fan = max(1, round(tasks**0.5))
    some = parts.groupBy("piece", F.pmod(F.spark_partition_id(), F.lit(fan)).alias("part")).applyInArrow(add(first), schema)
    rows = some.groupBy("piece").applyInArrow(add(second), schema).collect()
    return {r["piece"]: (r["n"], np.frombuffer(r["vector"], second)) for r in rows}


# ---------------------------------------------------------------- words


def _fold_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            t[c] = ord(chr(c).lower())
    t[128:] = np.arange(128, 256)
    return t


_FOLD = _fold_table()


def fold(raw: np.ndarray) -> np.ndarray:
    """UTF-8 in small letters with 0 for what is no letter or digit (ASCII and Latin-1 letters are folded;
    other characters count as letters, save the general and CJK punctuation blocks)."""
    b = _FOLD[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    lead = lead[lead < len(raw) - 1]
    if len(lead):
        first, second = raw[lead], raw[lead + 1]
        upper = lead[(first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        b[upper + 1] += 0x20
        sign = lead[(first == 0xC2) & (second >= 0xA0) & ~np.isin(second, (0xAA, 0xB5, 0xBA))]
        b[sign] = b[sign + 1] = 0
        wide = lead[((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))]
        wide = wide[wide < len(raw) - 2]
        b[wide] = b[wide + 1] = b[wide + 2] = 0
    return b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _P), ("down", _P_INV)):
            a = np.full(size, base, U)
            a[0] = U(1)
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of words by text) of the words in folded bytes; no word spans two texts."""
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = b != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    at = offs[:-1]
    before[at[at < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    at = offs[1:] - 1
    after[at[at >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(b))
    total = np.empty(len(b) + 1, U)
    total[0] = U(0)
    np.cumsum((b.astype(U) + U(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, offsets by text)."""
    b = fold(raw)
    starts, ends, woff = word_spans(b, offs)
    return word_hashes(b, starts, ends), woff


def shingles_of(words: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, offsets by text). A text of fewer words, but at least one, is one shingle."""
    n = len(words)
    counts = np.diff(woff)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(woff), np.int64)
    h = words.copy()
    if k > 1:
        rot = words
        for j in range(1, k):
            step = np.zeros(n, U)
            step[: n - j] = rot[j:]
            left = np.repeat(woff[1:], counts) - np.arange(n)
            h = mix(h * U(0xD6E8FEB86659FD93) + np.where(left > j, step, U(j)))
    keep = np.repeat(woff[1:], counts) - np.arange(n) >= k
    short = woff[:-1][(counts > 0) & (counts < k)]
    keep[short] = True
    soff = np.concatenate(([0], np.cumsum(np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64)))))
    return h[keep], soff


def rows_of(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node it is connected with.

    Alternates the large-star and small-star steps, each an aggregate and a join, until nothing changes: rounds
    grow with the logarithm of a component's size, and no step gathers a node's neighbours in one row.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ---------------------------------------------------------------- positions


def running(df: DataFrame, keys: list[str], weight: Column, name: str) -> DataFrame:
    """df in a global order by keys, with the weight of all rows before each as ``name``; written once.

    Ranges of keys go to tasks, each adds up its own rows, and the few sums of the tasks before are joined on:
    no task sees all rows, and one very frequent value is spread over tasks by the later keys.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranged = df.withColumn("_weight", weight.cast("long")).repartitionByRange(parts, *keys)
    ranged = cut(ranged.sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    inner = ranged.withColumn("_inner", F.coalesce(F.sum("_weight").over(own), F.lit(0)))
    sums = ranged.groupBy("_part").agg(F.sum("_weight").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return inner.join(F.broadcast(sums), "_part").withColumn(name, F.col("_inner") + F.col("_before")).drop("_part", "_weight", "_inner", "_before")


def unused(prefix: str, columns: list[str]) -> str:
    """prefix, with underscores added until no column's name starts with it."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def pick(df: DataFrame, columns: dict[str, Callable[[Column], Column] | None]) -> DataFrame:
    """Only these columns of df, under these names: what else it holds can't clash with a working column."""
    return df.select(*[(f(F.col(c)) if f else F.col(c)).alias(c) for c, f in columns.items()])
