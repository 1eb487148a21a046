"""The join in blocks: no candidate is shuffled or written.

Records, with tokens as ranks, are written once to the shared folder in blocks of like lengths. A task takes a pair of blocks whose
lengths may match, compares their records in memory and returns only pairs that reach the threshold. So what is shuffled and
written grows with the input; what is computed is at worst every pair of records of matching lengths.

Records with few tokens in their prefixes are dealt by those instead: tokens fall into buckets by rank, and a record goes to each bucket
that a token of its prefix is in. Only records of one bucket are compared, and a pair counts at the first token that it shares, so
comparisons grow with the input, too, unless tokens get more frequent. A bucket too large for a block is several, compared in pairs.

A record may hold fewer tokens than its set has: those that no record it is compared with has are left out, and count in its size only.
In the order of tokens they come first, so its prefix is the shorter for them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.functions.bounds import GUARD
from setloom.operators.base import shared_folder

#: Tokens of a block, hits of a token join and pairs of a tile that a task has in memory at once.
BLOCK, HITS, TILE = 8_000_000, 1_000_000, 1024
#: Tokens of a dense product at once; words of 64 bits of a record's sketch (of small records: one).
SLAB, WORDS = 4096, 8
#: How many times as many tokens as the records have may be written to deal records by the tokens of their prefixes.
COPIES = 4
#: Seconds that a hit, a pair of a dense tile and a multiplication of it take, to choose between the two.
HIT_S, PAIR_S, FLOP_S = 40e-9, 10e-9, 1e-10
SCHEMA = "rid1 long, rid2 long, n1 int, n2 int, overlap long"


class Block:
    """Records by ascending size: ids, sizes, how many tokens they hold (all of them without ``n``), and these (ascending in each
    record) one after the other."""

    def __init__(self, rid: np.ndarray, k: np.ndarray, tok: np.ndarray, n: np.ndarray | None = None) -> None:
        n = k if n is None else n
        by = np.argsort(n, kind="stable")
        start = np.cumsum(k) - k
        self.rid, self.n, self.k = rid[by], n[by].astype(np.int64), k[by].astype(np.int64)
        self.start = np.cumsum(self.k) - self.k
        self.tok = tok[np.repeat(start[by] - self.start, self.k) + np.arange(len(tok))].astype(np.int64)
        self._codes, self._sketches = None, {}
        self._prefixes: dict[tuple, tuple[np.ndarray, ...]] = {}

    def __len__(self) -> int:
        return len(self.rid)

    @functools.cached_property
    def vocabulary(self) -> np.ndarray:
        return np.unique(self.tok)

    def of(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all tokens of the records, and which of the records each belongs to (by its place in the argument)."""
        k = self.k[records]
        which = np.repeat(np.arange(len(records)), k)
        return np.arange(len(which)) + np.repeat(self.start[records] - (np.cumsum(k) - k), k), which

    def prefixes(self, share: float, bucket: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
        """(token, record, position) of the first tokens of each record, of which ``share`` need not be looked at; by token.
        With a bucket (its number, how many there are), only of tokens in it."""
        if (share, bucket) not in self._prefixes:
            length = np.maximum(_prefix_length(self.n, share) - (self.n - self.k), 0)
            record = np.repeat(np.arange(len(self)), length)
            pos = np.arange(len(record)) - np.repeat(np.cumsum(length) - length, length)
            tok = self.tok[self.start[record] + pos]
            if bucket:
                own = tok % bucket[1] == bucket[0]
                tok, record, pos = tok[own], record[own], pos[own]
            by = np.argsort(tok, kind="stable")
            self._prefixes[share, bucket] = tok[by], record[by], pos[by]
        return self._prefixes[share, bucket]

    def codes(self, top: int) -> np.ndarray:
        """record * top + token, ascending."""
        if self._codes is None:
            self._codes = np.repeat(np.arange(len(self)) * top, self.k) + self.tok
        return self._codes

    def sketches(self, words: int) -> np.ndarray:
        """Bits of each record, one for the parity of the tokens that fall on it: sets differ in as many tokens at least as in bits."""
        if words not in self._sketches:
            at = ((self.tok.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(words * 64)
            bit, word = np.uint64(1) << (at & np.uint64(63)), at >> np.uint64(6)
            self._sketches[words] = np.stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), self.start) for k in range(words)], axis=1)
        return self._sketches[words]


def _prefix_length(n: np.ndarray, share: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(n * share - GUARD).astype(np.int64) + 1)


def _least(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    return np.maximum(np.ceil((na + nb) * (t / (1 + t)) - GUARD), 1)


def _counted(a: Block, b: Block, ra: np.ndarray, rb: np.ndarray, tok: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps of pairs, and whether ``tok`` is the first token that a pair shares."""
    codes, overlap, first = b.codes(top), np.zeros(len(ra), np.int64), np.zeros(len(ra), bool)
    upto, lo = np.cumsum(a.k[ra]), 0
    while lo < len(ra):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + HITS, "right")))
        places, which = a.of(ra[lo:hi])
        own = a.tok[places]
        want = rb[lo:hi][which] * top + own
        found = codes[np.minimum(np.searchsorted(codes, want), len(codes) - 1)] == want
        overlap[lo:hi] = np.bincount(which[found], minlength=hi - lo)
        before = found & (own < tok[lo:hi][which])
        first[lo:hi] = np.bincount(which[before], minlength=hi - lo) == 0
        lo = hi
    return overlap, first


def _by_tokens(a: Block, b: Block, t: float, same: bool, prefixes: tuple, low: np.ndarray, hits: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs that meet in a token of their prefixes, in the order of tokens: a pair counts at the first that it shares."""
    (ta, ra_of, pa_of), (tb, rb_of, pb_of) = prefixes
    used = np.flatnonzero(hits)
    upto, begin = np.cumsum(hits[used]), 0
    words = WORDS if min(a.k.mean(), b.k.mean()) >= 16 else 1
    while begin < len(used):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
        slot = used[begin:end]
        begin = end
        k = hits[slot]
        ib = np.repeat(slot, k)
        ia = np.arange(len(ib)) + np.repeat(low[slot] - (np.cumsum(k) - k), k)
        ra, rb = ra_of[ia], rb_of[ib]
        ka, kb = a.k[ra], b.k[rb]
        least = _least(a.n[ra], b.n[rb], t)
        ok = (1 + np.minimum(ka - pa_of[ia] - 1, kb - pb_of[ib] - 1) >= least) & (np.minimum(ka, kb) >= least)
        if same:
            ok &= ra < rb
        ra, rb, least, tok = ra[ok], rb[ok], least[ok], tb[ib[ok]]
        if t > 0 and len(ra):
            apart = np.bitwise_count(a.sketches(words)[ra] ^ b.sketches(words)[rb]).sum(axis=1, dtype=np.int64)
            ok = apart <= a.k[ra] + b.k[rb] - 2 * least
            ra, rb, least, tok = ra[ok], rb[ok], least[ok], tok[ok]
        _, at = np.unique(ra * len(b) + rb, return_index=True)
        ra, rb, least, tok = ra[at], rb[at], least[at], tok[at]
        overlap, first = _counted(a, b, ra, rb, tok, top)
        ok = first & (overlap >= least)
        yield ra[ok], rb[ok], overlap[ok]


def _dense(block: Block, lo: int, hi: int, shared: np.ndarray) -> np.ndarray:
    places, which = block.of(np.arange(lo, hi))
    tok = block.tok[places]
    at = np.minimum(np.searchsorted(shared, tok), len(shared) - 1)
    ok = shared[at] == tok
    out = np.zeros((hi - lo, len(shared)), np.float32)
    out[which[ok], at[ok]] = 1
    return out


def _by_product(a: Block, b: Block, t: float, same: bool, shared: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All pairs, tile by tile, as a product of 0-1 matrices over the shared tokens."""
    for i in range(0, len(a), TILE):
        i_end = min(i + TILE, len(a))
        left = [_dense(a, i, i_end, shared[k : k + SLAB]) for k in range(0, len(shared), SLAB)] if len(shared) <= 4 * SLAB else None
        for j in range(i if same else 0, len(b), TILE):
            j_end = min(j + TILE, len(b))
            na, nb = a.n[i:i_end], b.n[j:j_end]
            if na[-1] < nb[0] * t - GUARD or nb[-1] < na[0] * t - GUARD:
                continue
            overlap = sum((left[s] if left else _dense(a, i, i_end, shared[k : k + SLAB])) @ _dense(b, j, j_end, shared[k : k + SLAB]).T for s, k in enumerate(range(0, len(shared), SLAB)))
            least = np.maximum((na[:, None] + nb[None, :]).astype(np.float32) * np.float32(t / (1 + t)) - np.float32(0.01), np.float32(1))
            x, y = np.nonzero(overlap >= least)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            yield x + i, y + j, overlap[x, y].astype(np.int64)


def similar(a: Block, b: Block, t: float, same: bool, top: int, bucket: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(records of a, records of b, overlaps) of all pairs of at least t, each once; of one block with itself, a pair's shorter record
    first. By the tokens of prefixes or by a product of matrices, whichever costs less. With a bucket, of the pairs whose first shared
    token is in it."""
    if not len(a) or not len(b):
        return
    shorter = same or a.n[-1] <= b.n[0]
    prefixes = a.prefixes(2 * t / (1 + t) if shorter else t, bucket), b.prefixes(t, bucket)
    low = np.searchsorted(prefixes[0][0], prefixes[1][0], "left")
    hits = np.searchsorted(prefixes[0][0], prefixes[1][0], "right") - low
    if not hits.any():
        return
    if bucket:
        yield from _by_tokens(a, b, t, same, prefixes, low, hits, top)
        return
    shared = np.intersect1d(a.vocabulary, b.vocabulary, assume_unique=True)
    if len(a) * len(b) * (PAIR_S + len(shared) * FLOP_S) < hits.sum() * HIT_S:
        yield from _by_product(a, b, t, same, shared)
    else:
        yield from _by_tokens(a, b, t, same, prefixes, low, hits, top)


def layout(lengths: list[tuple[int, int]], room: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """From (n, records) to (n, first block, blocks that share the length) and each block's least and greatest n, ascending."""
    places, ends, left = [], [], 0
    for n, k in sorted(lengths):
        if n * k > room:
            parts = math.ceil(n * k / room)
            places.append((n, len(ends), parts))
            ends += [(n, n)] * parts
            left = 0
        else:
            if n * k > left:
                ends.append((n, n))
                left = room
            left -= n * k
            ends[-1] = (ends[-1][0], n)
            places.append((n, len(ends) - 1, 1))
    return places, ends


def _folder(blocks: DataFrame, count: int) -> str:
    """A folder with (rid, n, toks, block), a folder in it for each block."""
    folder = shared_folder(blocks.sparkSession)
    blocks.select("rid", "n", "toks", "block").repartition(count, "block").sortWithinPartitions("block").write.option("compression", "zstd").partitionBy("block").parquet(folder)
    return folder


def _part(of: DataFrame, sets: DataFrame, by: str) -> DataFrame:
    at = (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts").cast("long"))).cast("int")
    return sets.join(F.broadcast(of), by).withColumn("block", at)


def _written(sets: DataFrame, lengths: list[tuple[int, int]], room: int) -> tuple[str, list[tuple[int, int]]]:
    places, ends = layout(lengths, room)
    return _folder(_part(sets.sparkSession.createDataFrame(places, "n int, first int, parts int"), sets, "n"), len(ends)), ends


def _dealt(sets: DataFrame, t: float, buckets: int, room: int) -> tuple[str, dict[int, range]]:
    """The folder of records dealt by the tokens of their prefixes, and each bucket's blocks."""
    prefix = F.slice("toks", 1, F.greatest(F.lit(0), F.least(F.size("toks"), F.size("toks") - F.ceil(F.col("n") * t - GUARD) + 1)).cast("int"))
    dealt = sets.select("rid", "n", "toks", F.explode(F.array_distinct(F.transform(prefix, lambda x: F.pmod(x, F.lit(buckets)).cast("int")))).alias("bucket"))
    places, of, first = [], {}, 0
    for row in dealt.groupBy("bucket").agg(F.sum("n").alias("tokens")).collect():
        parts = math.ceil(row["tokens"] / room)
        places.append((row["bucket"], first, parts))
        of[row["bucket"]] = range(first, first + parts)
        first += parts
    return _folder(_part(sets.sparkSession.createDataFrame(places, "bucket int, first int, parts int"), dealt, "bucket"), first), of


def _read(folder: str, block: int) -> Block:
    system, path = fs.FileSystem.from_uri(folder)
    where = f"{path}/block={block}"
    if system.get_file_info(where).type == fs.FileType.NotFound:  # no id was dealt to it
        return Block(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    table = ds.dataset(where, filesystem=system, format="parquet").to_table(columns=["rid", "n", "toks"]).combine_chunks()
    toks = table.column("toks").combine_chunks()
    toks = toks.combine_chunks() if isinstance(toks, pa.ChunkedArray) else toks
    return Block(table.column("rid").to_numpy(), np.diff(toks.offsets.to_numpy()).astype(np.int64), toks.flatten().to_numpy(), table.column("n").to_numpy())


def _cells(cells: list[tuple[int, int, tuple[int, int] | None]], left: str, right: str, t: float, self_join: bool, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, a = None, None
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                i, j, bucket = cells[cell]
                if kept != i:
                    kept, a = i, _read(left, i)
                same = self_join and i == j
                b = a if same else _read(right, j)
                for ra, rb, overlap in similar(a, b, t, same, top, bucket):
                    for lo in range(0, len(ra), 100_000):
                        x, y = ra[lo : lo + 100_000], rb[lo : lo + 100_000]
                        one, two, n1, n2 = a.rid[x], b.rid[y], a.n[x], b.n[y]
                        if self_join:
                            turn = one > two
                            one, two, n1, n2 = (np.where(turn, p, q) for p, q in ((two, one), (one, two), (n2, n1), (n1, n2)))
                        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n1, pa.int32()), pa.array(n2, pa.int32()), pa.array(overlap[lo : lo + 100_000], pa.int64())], names=["rid1", "rid2", "n1", "n2", "overlap"])

    return run


def buckets_of(lengths: list[tuple[int, int]], t: float, room: int, least: int) -> int:
    """Into how many buckets tokens fall if records are dealt by their prefixes, which have ``room`` tokens then; 0 if that copies too much."""
    if not t or not lengths:
        return 0
    n, k = (np.array(x, np.int64) for x in zip(*lengths))
    copied = int((n * k * _prefix_length(n, t)).sum())
    return max(least, math.ceil(copied / room)) if copied <= COPIES * int((n * k).sum()) else 0


def join(r: DataFrame, s: DataFrame, self_join: bool, t: float, block: int = BLOCK) -> DataFrame:
    """(rid1, rid2, n1, n2, overlap) of the pairs of (rid, n, toks) whose similarity is at least t, give or take rounding; toks are
    ascending integers, one at least, of a set of size n; those left out are in no record of the other side. At t = 0, of all pairs with a common token. Blocks hold ``block`` tokens, fewer if cores would lie idle."""
    spark = r.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sides = (r,) if self_join else (r, s)
    lengths = [[(row["n"], row["k"]) for row in x.groupBy("n").agg(F.count("*").alias("k")).collect()] for x in sides]
    top = max([-1, *(x.agg(F.max(F.array_max("toks"))).first()[0] or 0 for x in sides)]) + 1
    buckets = buckets_of([x for own in lengths for x in own], t, max(1, block // 2), 2 * cores) if all(lengths) else 0
    if buckets:
        # Cells of a bucket are at most so many tokens as a block of the other kind has.
        dealt = [_dealt(x, t, buckets, block) for x in sides]
        (left, of), (right, of_s) = dealt[0], dealt[-1]
        cells = [(i, j, (p, buckets)) for p in sorted(of.keys() & of_s.keys()) for i in of[p] for j in of_s[p] if i <= j or not self_join]
    else:
        least = math.ceil(math.sqrt(8 * cores))
        totals = [sum(n * k for n, k in own) for own in lengths]
        written = [_written(x, own, max(1, min(block, -(-total // least)))) if total else ("", []) for x, own, total in zip(sides, lengths, totals)]
        (left, ends), (right, ends_s) = written[0], written[-1]
        cells = [(i, j, None) for i, (lo, hi) in enumerate(ends) for j, (lo_s, hi_s) in enumerate(ends_s) if (i <= j or not self_join) and hi >= lo_s * t - GUARD and hi_s >= lo * t - GUARD]
    return spark.range(0, len(cells), 1, max(1, min(len(cells), 4000))).mapInArrow(_cells(cells, left, right, t, self_join, top), SCHEMA)
