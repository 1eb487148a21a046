"""Nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors go to shards of about ``shard_rows`` by id hash, and each shard's vectors form a graph: starting from random links, every
vector is searched for greedily from the shard's medoid; what the search saw are candidate neighbours, of which relaxed pruning
keeps the closest and drops those that a kept one is ``alpha`` times closer to, so that links go in all directions. Links are
returned, and lists that grow too long pruned. Pruning looks at the ``max(4 * degree, 64)`` nearest candidates, as it keeps
``degree`` at most. Every vector is in a graph.

Queries are the vectors whose id is divisible by ``query_every`` (1: all), against all vectors: a beam search in every
shard, all searches of a chunk in step, then the best k. Queries are broadcast in blocks of at most ``block_bytes`` on average, the
graphs stream past each block, and a task sends on only the best k of all the shards it saw. Work is linear in
the vectors for building, and queries times shards for searching.

Distances are Euclidean. Equal vectors of a shard are one vertex with several ids, so that copies neither crowd out links
nor part the graph. A vector is not its own neighbour; its copies are.

Cases: a null id or vector, a vector with a null or non-finite element, or of another length than most (the shorter of
equally frequent lengths) is left out. Rows that repeat an id count once, the one of least hash. Ties in
distance go to the lower id. A table of fewer than k + 1 vectors gives each query all others. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setloom.llm.common import arrow_map, cut

K, QUERY_EVERY, SHARD_ROWS, DEGREE, BEAM, ALPHA, WIDTH, CHUNK, SEED = 10, 100, 16384, 32, 128, 1.2, 3, 256, 5
#: The beam of the searches that build the graph, and bytes of query vectors that are broadcast at once.
BUILD_BEAM, BLOCK_BYTES = 64, 32 << 20


def search(x: np.ndarray, norm: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, beam: int, width: int = WIDTH, seen_too: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of each query's beam, sorted; or of all vertices seen, -1 where fewer, if ``seen_too``."""
    n, b, rows = len(x), len(q), np.arange(len(q))[:, None]
    qn = (q * q).sum(1)
    ids = np.full((b, beam), -1)
    ids[:, 0] = entry
    dist = np.full((b, beam), np.inf, np.float32)
    dist[:, 0] = norm[entry] + qn - 2 * (q @ x[entry])
    open_ = ids >= 0
    visited = np.zeros((b, n), bool)
    visited[:, entry] = True
    trail = [(ids[:, :1].copy(), dist[:, :1].copy())]
    active = np.arange(b)
    while len(active):
        o = open_[active]
        rank = np.where(o, np.arange(beam), beam)
        rank = np.sort(rank, axis=1)[:, :width]
        have = rank < beam
        at = np.where(have, rank, 0)
        r = active[:, None]
        nodes = np.where(have, ids[r, at], -1)
        open_[np.broadcast_to(r, at.shape)[have], at[have]] = False
        nb = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
        ok = nb >= 0
        safe = np.where(ok, nb, 0)
        ok &= ~visited[r, safe]
        order = np.argsort(safe + np.where(ok, 0, n), axis=1, kind="stable")
        safe, ok = np.take_along_axis(safe, order, 1), np.take_along_axis(ok, order, 1)
        ok[:, 1:] &= ~((safe[:, 1:] == safe[:, :-1]) & ok[:, :-1])
        most = int(ok.sum(1).max()) if ok.size else 0
        if most:
            keep = np.argsort(~ok, axis=1, kind="stable")[:, :most]
            safe, ok = np.take_along_axis(safe, keep, 1), np.take_along_axis(ok, keep, 1)
            rr = np.broadcast_to(r, safe.shape)
            visited[rr[ok], safe[ok]] = True
            d = norm[safe] + qn[active][:, None] - 2 * np.matmul(x[safe], q[active][:, :, None])[:, :, 0]
            d = np.where(ok, d, np.inf).astype(np.float32)
            if seen_too:
                one = np.full((b, most), -1), np.full((b, most), np.inf, np.float32)
                one[0][active], one[1][active] = np.where(ok, safe, -1), d
                trail.append(one)
            all_d = np.concatenate((dist[active], d), 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(ok, safe, -1)), 1), best, 1)
            dist[active] = np.take_along_axis(all_d, best, 1)
            open_[active] = np.take_along_axis(np.concatenate((open_[active], ok), 1), best, 1)
        active = active[open_[active].any(1)]
    if not seen_too:
        return ids, dist
    return np.concatenate([t[0] for t in trail], 1), np.concatenate([t[1] for t in trail], 1)


def prune(x: np.ndarray, norm: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates (-1: none) at squared distance ``dist``, the links that relaxed pruning keeps."""
    order = np.argsort(dist, axis=1, kind="stable")[:, : max(4 * degree, 64)]
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    alive = (cand >= 0) & np.isfinite(dist)
    v = x[np.maximum(cand, 0)]
    nv = norm[np.maximum(cand, 0)]
    between = nv[:, :, None] + nv[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    rows = np.arange(len(cand))
    out = np.full((len(cand), degree), -1, np.int32)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        out[some, k] = cand[rows, at][some]
        alive &= ~(alpha * alpha * between[rows, at] <= dist)
        alive[rows, at] = False
        alive &= cand != np.where(some, cand[rows, at], -2)[:, None]
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, int]:
    """(links by vertex, -1 where fewer; the entry vertex) of distinct vectors."""
    n = len(x)
    norm = (x * x).sum(1)
    g = np.random.Generator(np.random.PCG64(seed))
    room = degree + degree // 2
    links = np.full((n, room), -1, np.int32)
    if n > 1:
        links[:, : min(degree, n - 1)] = (np.arange(n)[:, None] + 1 + g.integers(0, n - 1, (n, min(degree, n - 1)))) % n
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    for batch in np.array_split(g.permutation(n), max(1, n // CHUNK)):
        cand, dist = search(x, norm, links, entry, x[batch], beam, seen_too=True)
        own = links[batch]
        far = norm[np.maximum(own, 0)] + norm[batch][:, None] - 2 * np.matmul(x[np.maximum(own, 0)], x[batch][:, :, None])[:, :, 0]
        cand, dist = np.concatenate((cand, own), 1), np.concatenate((dist, np.where(own >= 0, far, np.inf)), 1)
        dist = np.where(cand == batch[:, None], np.inf, dist)
        kept = prune(x, norm, cand, dist, degree, alpha)
        links[batch] = -1
        links[batch, :degree] = kept
        src, dst = np.repeat(batch, degree), kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        new = ~(links[dst] == src[:, None]).any(1)
        src, dst = src[new], dst[new]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        if not len(dst):
            continue
        first = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1])))
        to, count = dst[first], np.diff(np.append(first, len(dst)))
        used = (links[to] >= 0).sum(1)
        links[to] = np.take_along_axis(links[to], np.argsort(links[to] < 0, axis=1, kind="stable"), 1)
        fits = used + count <= room
        spot = np.repeat(used, count) + np.arange(len(dst)) - np.repeat(first, count)
        easy = np.repeat(fits, count)
        links[dst[easy], spot[easy]] = src[easy]
        over = np.flatnonzero(~fits)
        if len(over):
            wide = int(count[over].max())
            more = np.full((len(over), wide), -1)
            for i, o in enumerate(over.tolist()):
                more[i, : count[o]] = src[first[o] : first[o] + count[o]]
            cand = np.concatenate((links[to[over]], more), 1)
            p = x[to[over]]
            dist = norm[np.maximum(cand, 0)] + norm[to[over]][:, None] - 2 * np.matmul(x[np.maximum(cand, 0)], p[:, :, None])[:, :, 0]
            links[to[over]] = -1
            links[to[over], :degree] = prune(x, norm, cand, np.where(cand >= 0, dist, np.inf), degree, alpha)
    return links, entry


_GRAPH = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("entry", pa.int32()), ("ids", pa.binary()), ("first", pa.binary()), ("x", pa.binary()), ("links", pa.binary())])
_NEAR = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64())])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _build(dim: int, degree: int, beam: int, alpha: float, seed: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], _matrix(table.column("v"), dim)[order]
        x, vertex = np.unique(v, axis=0, return_inverse=True)
        vertex = vertex.ravel()
        by = np.argsort(vertex, kind="stable")
        first = np.searchsorted(vertex[by], np.arange(len(x) + 1))
        links, entry = build(np.ascontiguousarray(x), degree, beam, alpha, seed)
        row = [[table.column("shard")[0].as_py()], [dim], [entry], [ids[by].tobytes()], [first.astype(np.int64).tobytes()], [x.astype(np.float32).tobytes()], [links.astype(np.int32).tobytes()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(row, _GRAPH)], schema=_GRAPH)

    return run


Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def best(found: Best, k: int) -> Best:
    """Of (query, neighbour, distance) rows, the k nearest of each query, ties to the lower id."""
    who, near, dist = found
    order = np.lexsort((near, dist, who))
    who = who[order]
    kept = order[np.arange(len(who)) - np.searchsorted(who, who) < k]
    return found[0][kept], near[kept], dist[kept]


def search_shard(x: np.ndarray, links: np.ndarray, entry: int, ids: np.ndarray, first: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, beam: int) -> Iterator[Best]:
    """(place of the query, neighbour, distance) rows of each chunk of queries; ids of vertex i are ids[first[i]:first[i + 1]]."""
    norm = (x * x).sum(1)
    for lo in range(0, len(q), CHUNK):
        at, dist = search(x, norm, links, entry, q[lo : lo + CHUNK], max(beam, k + 1))
        at, dist = at[:, : max(2 * k, k + 1)], dist[:, : max(2 * k, k + 1)]
        who, col = np.nonzero(at >= 0)
        vertex = at[who, col]
        n = np.minimum(first[vertex + 1] - first[vertex], k + 1)
        post = np.repeat(first[vertex], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        who, near, vertex = np.repeat(who, n) + lo, ids[post], np.repeat(vertex, n)
        other = near != qids[who]
        who, near, vertex = who[other], near[other], vertex[other]
        exact = np.round(np.sqrt(((x[vertex].astype(np.float64) - q[who]) ** 2).sum(1)), 6)
        yield best((who, near, exact), k)


def _query(queries_of, dim: int, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, raw = queries_of.value
        q = np.frombuffer(raw, np.float32).reshape(-1, dim)
        held: Best | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                array = lambda name, kind, row=row: np.frombuffer(row[name].as_buffer(), kind)
                x = array("x", np.float32).reshape(-1, dim)
                parts = list(search_shard(x, array("links", np.int32).reshape(len(x), -1), row["entry"].as_py(), array("ids", np.int64), array("first", np.int64), qids, q, k, beam))
                parts += [held] if held is not None else []
                if parts:
                    held = best(tuple(np.concatenate([p[c] for p in parts]) for c in range(3)), k)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(qids[held[0]]), pa.array(held[1]), pa.array(held[2])], schema=_NEAR)

    return run


def neighbours(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, query_every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, build_beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, neighbour, rank, distance): the k nearest others of every query vector, rank from 1."""
    own = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = own.where(sound & (F.size("v") > 0))
    sizes = own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    spark = table.sparkSession
    if not sizes:
        return spark.createDataFrame([], f"{id_col} long, neighbour long, rank int, distance double")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    n_shards = max(1, math.ceil(n / shard_rows))
    own = own.where(F.size("v") == dim).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_shards)))
    least = F.row_number().over(Window.partitionBy("shard", "id").orderBy(F.xxhash64("v"), F.hash("v")))
    once = lambda rows: rows.withColumn("_r", least).where("_r = 1").select("shard", "id", "v")
    # Rows of an id are of one shard, so that one shuffle serves both the choice of a row and the graphs.
    graphs = once(own.repartitionByRange(n_shards, "shard")).groupBy("shard").applyInArrow(_build(dim, degree, build_beam, alpha, seed), "shard long, dim int, entry int, ids binary, first binary, x binary, links binary")
    graphs = cut(graphs)
    asked = cut(once(own.where(F.pmod("id", F.lit(query_every)) == 0)))
    blocks = max(1, math.ceil(asked.count() * (4 * dim + 8) / block_bytes))
    found = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(blocks)) == i).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        queries_of = spark.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("v"), dim).tobytes()))
        one = arrow_map(graphs, _query(queries_of, dim, k, beam), "id long, neighbour long, distance double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"{id_col} long, neighbour long, rank int, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(id_col), "neighbour", "rank", "distance")
