"""Sharding by a Hilbert curve: documents that are alike in several metadata columns share few files.

Each dimension is quantised into ``2^bits`` cells of about equal weight in rows: the value v is in cell
``floor(rows with a smaller value * 2^bits / rows)``, exactly, over all rows. The cells' point on the Hilbert curve (Skilling's
transform) orders the documents, then their id, then a hash of the whole row; a shard is a run of that order:
``floor(characters before / shard_chars)``. Rows equal in curve index and id share the shard of the first.
A file of one shard then has a narrow range in every dimension, so a reader's min/max statistics prune files.

What comes to the driver: at most ``2^bits - 1`` cuts a dimension, and one boundary for each part of the output: of ``PART_SHARDS``
shards, or of as many more as leave ``MAX_PARTS`` parts. Documents are sent to their parts, and shards told by a
join with the boundaries of the part, which are never gathered as a whole.

Cases: a null dimension sorts before all values, a null id before all ids; a null or negative ``n_chars`` weighs 0. Repeated
rows go together. An empty table has no shard. Texts are not read. Of other columns, those named like the two
results (``hilbert``, ``shard``) are an error in ``shard_documents``, which adds them; the others pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import cut, running, unused

DIMENSIONS, BITS, SHARD_CHARS = ("lang", "source", "n_chars"), 4, 4_000_000
PART_SHARDS, MAX_PARTS = 8, 100_000


def curve(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indexes of integer points (rows) in [0, 2^bits)^d."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(d):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[d - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_table(d: int, bits: int) -> list[int]:
    """The Hilbert index of each cell, by the cells' coordinates read as one number."""
    side = 1 << bits
    grid = np.indices((side,) * d).reshape(d, -1).T
    return curve(grid, bits).tolist()


def cell_cuts(docs: DataFrame, column: str, bits: int) -> list:
    """The least value of each cell from 1 on; None where no value reaches the cell."""
    side = 1 << bits
    counts = running(docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), ["value"], F.col("n"), "before")
    size = docs.agg(F.count("*"), F.count(column)).first()
    nulls, total = size[0] - size[1], size[0]
    if not total:
        return [None] * (side - 1)
    cell = F.floor((F.col("before") + F.lit(nulls)) * side / F.lit(total))
    firsts = {int(r["cell"]): r["value"] for r in counts.groupBy(cell.cast("int").alias("cell")).agg(F.min("value").alias("value")).collect()}
    out, least = [None] * (side - 1), None
    for c in range(side - 1, 0, -1):
        least = firsts.get(c, least)
        out[c - 1] = least
    return out


def _cell(column: Column, cuts: list) -> Column:
    out = F.lit(0)
    for value in cuts:
        if value is not None:
            out = out + F.coalesce((column >= F.lit(value)).cast("int"), F.lit(0))
    return out


def hilbert_index(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> Column:
    """The curve index of a row of docs, as a column expression over fixed cuts."""
    code = F.lit(0)
    for name in dimensions:
        code = code * (1 << bits) + _cell(F.col(name), cell_cuts(docs, name, bits))
    return F.get(F.lit(curve_table(len(dimensions), bits)), code).cast("long")


def _placed(docs: DataFrame, index: Column, id_col: str, chars_col: str, shard_chars: int) -> DataFrame:
    """(hilbert, id, before) of every row, in curve order, written once."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    narrow = docs.select(index.alias("hilbert"), key.alias("id"), F.greatest(F.coalesce(F.col(chars_col).cast("long"), F.lit(0)), F.lit(0)).alias("chars"))
    return running(narrow, ["hilbert", "id"], F.col("chars"), "before")


def shard_bounds(placed: DataFrame, shard_chars: int) -> DataFrame:
    """(shard, first): the (hilbert, id) of the first row of each shard."""
    same = placed.groupBy("hilbert", "id").agg(F.min("before").alias("before"))
    return same.groupBy(F.floor(F.col("before") / shard_chars).cast("long").alias("shard")).agg(F.min(F.struct("hilbert", "id")).alias("first"))


def shards(docs: DataFrame, id_col: str = "doc_id", chars_col: str = "n_chars", *, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id_col, hilbert, shard) of each row of docs. A null id is given back as null."""
    placed = _placed(docs, hilbert_index(docs, dimensions, bits), id_col, chars_col, shard_chars)
    same = placed.groupBy("hilbert", "id").agg(F.min("before").alias("before"), F.count("*").alias("n"))
    out = same.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col), "hilbert", F.floor(F.col("before") / shard_chars).cast("long").alias("shard"), F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(id_col, "hilbert", "shard")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", chars_col: str = "n_chars", *, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, shard_chars: int = SHARD_CHARS, part_shards: int = PART_SHARDS, max_parts: int = MAX_PARTS) -> DataFrame:
    """docs with ``hilbert`` and ``shard``, all of a shard in one task, in curve order: one shuffle of the texts."""
    clash = {"hilbert", "shard"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}")
    index = hilbert_index(docs, dimensions, bits)
    bounds = cut(shard_bounds(_placed(docs, index, id_col, chars_col, shard_chars), shard_chars))
    most = bounds.agg(F.max("shard")).first()[0]
    if most is None:
        return docs.withColumns({"hilbert": index, "shard": F.lit(None).cast("long")})
    own = unused("_curve", docs.columns)
    key, part, low, ids, parts, fine = (f"{own}_{x}" for x in ("key", "part", "low", "ids", "parts", "fine"))
    per = max(part_shards, -(-(most + 1) // max_parts))
    bounds = bounds.withColumn(part, F.floor(F.col("shard") / per).cast("int"))
    coarse = sorted((r["f"]["hilbert"], r["f"]["id"], r[part]) for r in bounds.groupBy(part).agg(F.min("first").alias("f")).collect())

    by_cell: dict[int, list[tuple[int, int]]] = {}
    for h, i, p in coarse:
        by_cell.setdefault(h, []).append((i, p))
    rows, last = [], coarse[0][2]
    for h in range(1 << (bits * len(dimensions))):
        here = by_cell.get(h, [])
        rows.append((h, last, [i for i, _ in here], [p for _, p in here]))
        last = here[-1][1] if here else last
    cells = docs.sparkSession.createDataFrame(rows, f"hilbert long, {low} int, {ids} array<long>, {parts} array<int>")
    at = F.size(F.filter(ids, lambda i: i <= F.col(key)))
    placed = docs.withColumn("hilbert", index).withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).join(F.broadcast(cells), "hilbert", "left")
    placed = placed.withColumn(part, F.when(at > 0, F.get(parts, at - 1)).otherwise(F.col(low))).repartition(len(coarse), part)

    inner = bounds.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(F.col("first.hilbert").alias("h"), F.col("first.id").alias("i"), "shard"))).alias(fine))
    joined = placed.join(inner.hint("shuffle_hash"), part)
    reached = F.filter(fine, lambda b: (b["h"] < F.col("hilbert")) | ((b["h"] == F.col("hilbert")) & (b["i"] <= F.col(key))))
    out = joined.withColumn("shard", F.element_at(reached, -1)["shard"])
    return out.select(*docs.columns, "hilbert", "shard").sortWithinPartitions("shard", "hilbert", F.col(id_col).asc_nulls_first())


def oracle_sql(dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, shard_chars: int = SHARD_CHARS) -> str:
    """The SQL of ``shards`` over documents: ranks give the cells, a list the curve, running sums the shards."""
    side = 1 << bits
    code = "0"
    for d in dimensions:
        code = f"({code}) * {side} + ((rank() OVER (ORDER BY {d} NULLS FIRST) - 1) * {side}) // count(*) OVER ()"
    curve_list = ", ".join(map(str, curve_table(len(dimensions), bits)))
    return f"""
WITH c AS (SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS id, greatest(coalesce(n_chars, 0), 0) AS chars, {code} AS code FROM documents),
     h AS (SELECT doc_id, id, chars, CAST(([{curve_list}])[code + 1] AS BIGINT) AS hilbert FROM c),
     b AS (SELECT *, coalesce(sum(chars) OVER (ORDER BY hilbert, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT doc_id, hilbert, CAST(min(before) OVER (PARTITION BY hilbert, id) // {shard_chars} AS BIGINT) AS shard FROM b
"""
