"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Weights. A text's features are its runs of ``shingle`` words; a feature weighs ``(1 + ln tf) * idf``, where
``idf = max(ln((1 + N) / (1 + df)), 0.05)`` and df counts all texts. df is kept in ``df_slots`` counters that
shingle hashes share, so its size does not depend on the corpus; what other shingles add to a counter on average is taken off.

Sampling. For each of ``bands * rows`` hash functions, every feature has fixed r, c ~ Gamma(2, 1) and
beta ~ U(0, 1), drawn once per slot of a table that feature hashes index; the sample is the feature of least
``ln c - r * (t - beta + 1)`` with ``t = floor(ln w / r + beta)``. Two texts agree in one sample, (feature, t), with
the probability of their weighted Jaccard similarity.

Groups. Texts with equal features are joined at once. Of the others, those that share a band are candidates:
first each against the least id of its bucket, then every pair of a bucket whose texts that left in different
groups. Pairs at ``threshold`` or above are edges; a group is a connected component. A pair whose ends are
already connected cannot change a component, so no pair is left out for the size of its bucket. A pair at
the threshold of 0.5 shares one of 40 bands of 4 samples with probability 0.92, one at 0.6 with 0.996.

Skew. A bucket is cut into chunks of ``CHUNK`` texts, and pairs of chunks meet; a text that is in very many pairs has its features
sent to several tasks, its pairs dealt among them. So no task holds a bucket or all pairs of a text. What
is still quadratic are buckets of texts that are unlike their leader and each other.

``links`` counts the links found at a row: of equal texts, those between each and the least id; of others, verified pairs.

Cases: a null, empty or wordless text is in no group, nor is a row without an id. Of rows that repeat an id, the one of least
text hash counts. Ties go to the least id. Very long texts are taken whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import BROADCAST_IDS, U, add_vectors, arrow_map, components, cut, mix, rows_of, semi, shingles_of, slices, texts_of, words_of

SHINGLE, BANDS, ROWS, THRESHOLD, DF_SLOTS, SLOTS, SEED = 2, 40, 4, 0.5, 1 << 20, 1 << 15, 20251
#: Texts of a bucket's chunk, and pairs of a text that one task takes.
CHUNK, SPLIT = 512, 4096
_PIECE = 1 << 14
_tables: dict[tuple, tuple] = {}


def sampling_tables(n_hashes: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, beta, ln c + r * beta - r) by slot and hash function; kept by the worker process."""
    key = (n_hashes, slots, seed)
    if key not in _tables:
        g = np.random.Generator(np.random.PCG64(seed))
        r = g.gamma(2.0, 1.0, (slots, n_hashes)).astype(np.float32)
        r = np.maximum(r, np.float32(1e-4))
        c = g.gamma(2.0, 1.0, (slots, n_hashes)).astype(np.float32)
        beta = g.random((slots, n_hashes), dtype=np.float32)
        _tables.clear()
        _tables[key] = (r, beta, np.log(np.maximum(c, 1e-12)) + r * beta - r)
    return _tables[key]


def features(raw: np.ndarray, offs: np.ndarray, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes, their counts) of each text."""
    h, soff = shingles_of(*words_of(raw, offs), shingle)
    for lo, hi in zip(soff[:-1].tolist(), soff[1:].tolist()):
        s = np.sort(h[lo:hi])
        if hi - lo > 1:
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            yield s[at], np.diff(np.append(at, len(s)))
        else:
            yield s, np.ones(len(s), np.int64)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf[(h & U(len(idf) - 1)).astype(np.int64)]


def sample(h: np.ndarray, w: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The consistent sample of each hash function as one 64-bit value; long feature lists go in pieces."""
    r_all, beta_all, a_all = tables
    slots, n = r_all.shape
    best = np.full(n, np.inf, np.float32)
    out = np.zeros(n, U)
    cols = np.arange(n)
    lw = np.log(w).astype(np.float32)[:, None]
    slot = ((h >> U(24)) & U(slots - 1)).astype(np.int64)
    for lo in range(0, len(h), 512):
        s = slot[lo : lo + 512]
        r = r_all[s]
        t = lw[lo : lo + 512] / r
        t += beta_all[s]
        np.floor(t, out=t)
        r *= t
        cost = a_all[s]
        cost -= r
        at = cost.argmin(0)
        least = cost[at, cols]
        better = least < best
        best = np.where(better, least, best)
        value = mix(h[lo + at] + t[at, cols].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15))
        out = np.where(better, value, out)
    return out


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted feature lists."""
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha
    low = float(np.minimum(wa[same], wb[at[same]]).sum())
    return low / (float(wa.sum()) + float(wb.sum()) - low)


def _count_df(shingle: int, df_slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(df_slots, np.int32), 0
        for batch in batches:
            raw, offs = texts_of(batch.column(0))
            for lo, hi in slices(offs):
                for h, _ in features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], shingle):
                    if len(h):
                        n += 1
                        counts[np.unique(h & U(df_slots - 1)).astype(np.int64)] += 1
        if n:
            pieces = [counts[i : i + _PIECE].tobytes() for i in range(0, df_slots, _PIECE)]
            yield rows_of(_DF, piece=range(len(pieces)), n=[n] * len(pieces), vector=pieces)

    return run


_DF = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("vector", pa.binary())])


def document_frequencies(texts: DataFrame, shingle: int, df_slots: int) -> np.ndarray:
    """idf by counter, from all texts. Each task sends its counters once (4 bytes each); they are added by piece."""
    parts = arrow_map(texts, _count_df(shingle, df_slots), "piece int, n long, vector binary")
    counts, n = np.zeros(max(df_slots, _PIECE), np.int64), 0
    for piece, (rows, part) in add_vectors(parts, "int32", texts.rdd.getNumPartitions()).items():
        counts[piece * _PIECE :][: len(part)] = part
        n = rows
    return idf_of_counts(counts[:df_slots], n)


def idf_of_counts(counts: np.ndarray, n: int) -> np.ndarray:
    """idf by counter: df is the counter less the mean of the others, which is what unrelated shingles add to it."""
    others = np.rint((counts.sum() - counts) / max(len(counts) - 1, 1))
    return np.maximum(np.log((1 + n) / (1 + np.maximum(counts - others, 1))), 0.05).astype(np.float32)


_SIG = pa.schema([("id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sign(idf_of, shingle: int, bands: int, rows: int, slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_of.value
        tables = sampling_tables(bands * rows, slots, seed)
        band = mix(np.arange(1, bands + 1, dtype=U))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, offs = texts_of(batch.column(1))
            out = []
            for lo, hi in slices(offs):
                for i, (h, tf) in enumerate(features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], shingle), lo):
                    if not len(h):
                        continue
                    one = mix(h * U(0xA24BAED4963EE407) + tf.astype(U))
                    v = sample(h, weights(h, tf, idf), tables).reshape(bands, rows)
                    key = band.copy()
                    for j in range(rows):
                        key = mix(key * U(0xD6E8FEB86659FD93) + v[:, j])
                    out.append((ids[i], one.sum(dtype=U), np.bitwise_xor.reduce(mix(one + U(7))), key))
            if out:
                keys = np.concatenate([x[3] for x in out]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands, dtype=np.int32)), pa.array(keys))
                sums = [np.array([x[j] for x in out], U).view(np.int64) for j in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in out], pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists], schema=_SIG)

    return run


_FEAT = pa.schema([("id", pa.int64()), ("h", pa.binary()), ("w", pa.binary())])


def _weigh(idf_of, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_of.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offs = texts_of(batch.column(1))
            for lo, hi in slices(offs):
                found = [(h.astype(np.uint32), weights(h, tf, idf).astype(np.float32)) for h, tf in features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], shingle)]
                order = [np.argsort(h, kind="stable") for h, _ in found]
                yield rows_of(_FEAT, id=ids[lo:hi], h=[h[o].tobytes() for (h, _), o in zip(found, order)], w=[w[o].tobytes() for (_, w), o in zip(found, order)])

    return run


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, s = [], [], []
            columns = [batch.column(c) for c in ("a", "b", "ha", "wa", "hb", "wb")]
            for i in range(batch.num_rows):
                x, y, ha, wa, hb, wb = (c[i] for c in columns)
                f = [np.frombuffer(v.as_buffer(), t) for v, t in ((ha, np.uint32), (wa, np.float32), (hb, np.uint32), (wb, np.float32))]
                sim = similarity(*f)
                if sim >= threshold:
                    a.append(x.as_py()), b.append(y.as_py()), s.append(round(sim, 6))
            yield rows_of(_EDGE, a=a, b=b, similarity=s)

    return run


def _attached(pairs: DataFrame, feats: DataFrame, side: str, other: str) -> DataFrame:
    """pairs with the features of one side. An id in more than SPLIT pairs goes to several tasks, with its features."""
    load = pairs.groupBy(side).agg(F.count("*").alias("_n")).where(F.col("_n") > SPLIT)
    heavy = cut(load.select(side, F.ceil(F.col("_n") / SPLIT).cast("int").alias("_parts")))
    own = feats.select(F.col("id").alias(side), F.col("h").alias(f"h{side}"), F.col("w").alias(f"w{side}"))
    if not heavy.count():
        return pairs.join(own, side)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(heavy, side, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts.cast("long")).cast("int")).drop("_parts")
    copies = own.join(heavy, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [side, "_part"]).drop("_part")


def verified(docs: DataFrame, pairs: DataFrame, idf_of, shingle: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at the threshold or above; ids of docs differ. Only the texts of candidates are shuffled."""
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    own = semi(docs, ids, "id", ids.count())
    feats = cut(arrow_map(own, _weigh(idf_of, shingle), "id long, h binary, w binary"))
    both = _attached(_attached(pairs.select("a", "b"), feats, "a", "b"), feats, "b", "a")
    return arrow_map(both.select("a", "b", "ha", "wa", "hb", "wb"), _verify(threshold), "a long, b long, similarity double")


def one_row_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each repeated id: that of least hash of its text, then of the whole row. Rows without an id all stay."""
    again = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    n_again = again.count()
    if n_again == 0:
        return docs
    side = F.broadcast(again) if n_again <= BROADCAST_IDS else again
    once = docs.join(side, F.col(id_col) == F.col("_again"), "left_anti")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(F.col(text_col)), F.xxhash64(*plain), F.hash(*plain)))
    many = docs.join(side, F.col(id_col) == F.col("_again"), "left_semi").groupBy(F.col(id_col).alias("_again")).agg(first.alias("_row"))
    return once.unionByName(many.select("_row.*"))


def pairs_of_chunks(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b), distinct and a < b, of members (key, rep, root) of one key and different roots."""
    size = members.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_c"))
    own = members.join(size, "key").withColumn("_k", F.pmod(F.xxhash64("rep"), F.col("_c").cast("long")).cast("int"))
    left = own.select("key", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("_k").alias("_i"), F.explode(F.sequence("_k", F.col("_c") - 1)).alias("_j"))
    right = own.select("key", F.col("rep").alias("b"), F.col("root").alias("rb"), F.explode(F.sequence(F.lit(0), "_k")).alias("_i"), F.col("_k").alias("_j"))
    met = left.join(right, ["key", "_i", "_j"]).where("ra <> rb and (a < b or _i <> _j)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, df_slots: int = DF_SLOTS, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(id_col, group_id, links) for every text that has a near duplicate; group_id is the least id of its group."""
    spark = docs.sparkSession
    own = one_row_each(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null"), "id", "text")
    idf_of = spark.sparkContext.broadcast(document_frequencies(own.select("text"), shingle, df_slots))
    signed = cut(arrow_map(own, _sign(idf_of, shingle, bands, rows, slots, seed), "id long, f1 long, f2 long, keys array<long>"))
    same = signed.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    same = cut(same)
    equal = signed.join(same.where("n > 1").select("f1", "f2", "rep"), ["f1", "f2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    member = same.select("rep", F.explode("keys").alias("key"))
    size = member.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    bucket = cut(member.join(size.select("key", "leader"), "key").distinct())
    star = cut(bucket.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    first = cut(verified(own, star, idf_of, shingle, threshold))

    root = components(first.select("a", "b"))
    placed = bucket.join(root.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("key")
    rest = cut(placed.join(mixed, "key").select("key", "rep", "root"))
    cross = cut(pairs_of_chunks(rest).join(star, ["a", "b"], "left_anti"))
    edges = equal.unionByName(first.select("a", "b")).unionByName(verified(own, cross, idf_of, shingle, threshold).select("a", "b"))
    edges = cut(edges)
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("links"))
    return components(edges).join(links, "node").select(F.col("node").alias(id_col), F.col("root").alias("group_id"), "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: object) -> DataFrame:
    """docs without the texts of a group save the one of least id; a repeated id keeps one row.

    Columns and other rows are unchanged. Of rows that repeat an id, the one of least hash of its text, then of the whole
    row, stays; rows without an id all stay.
    """
    docs = one_row_each(docs, id_col, text_col)
    groups = near_duplicates(docs, id_col, text_col, **parameters)
    gone = cut(groups.where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias("_gone")))
    n_gone = gone.count()
    side = F.broadcast(gone) if n_gone <= BROADCAST_IDS else gone
    return docs.join(side, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")
