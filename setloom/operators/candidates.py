"""Candidate strategies of the similarity join.

Each takes two encoded collections (rid, n, toks), whether they are one and the same, and the threshold, and returns
distinct pairs (rid1, rid2) that include every pair of Jaccard similarity at least the threshold (or, where noted, the pairs'
overlaps). Of a self-join, rid1 < rid2. A strategy differs in what it shuffles, never in the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from setloom.functions import bounds
from setloom.operators.base import cut
from setloom.operators.kernel import PrefixIndex
from setloom.operators.order import group_histograms, hash_sample, token_groups, token_order
from setloom.operators.stats import cell_sizes

Strategy = Callable[..., DataFrame]


def _side(df: DataFrame, s: str, *keys: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else f"{c}{s}") for c in df.columns])


def _order(self_join: bool) -> Column:
    return (F.col("rid1") < F.col("rid2")) if self_join else F.lit(True)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("rid1", "rid2").distinct()


def _exploded(sets: DataFrame, length: Column) -> DataFrame:
    return sets.select("rid", "n", F.posexplode(F.slice("toks", 1, length)).alias("pos", "tok"))


def _all(sets: DataFrame) -> DataFrame:
    return sets.select("rid", "n", F.explode("toks").alias("tok"))


def full(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """Every pair with a common token, counted: no filter. Returns overlaps."""
    both = _side(_all(r), "1", "tok").join(_side(_all(s), "2", "tok"), "tok").where(_order(self_join))
    return both.groupBy("rid1", "rid2", "n1", "n2").agg(F.count("*").alias("overlap"))


def chunked(r: DataFrame, s: DataFrame, self_join: bool, t: float, chunk_size: int = 1000) -> DataFrame:
    """As ``full``, but a frequent token's postings are cut into chunks, and pairs of chunks meet: no task holds a
    whole posting list. A row goes to as many tasks as its token has chunks. Returns overlaps."""
    a, b = _all(r), _all(s)
    freq = a.unionByName(b).groupBy("tok").agg(F.count("*").alias("f"))
    chunks = F.ceil(F.col("f") / chunk_size).cast("int")
    own = F.pmod(F.xxhash64("rid"), F.col("c")).cast("int")
    a, b = (x.join(freq, "tok").withColumn("c", chunks).select("rid", "n", "tok", "c", own.alias("k")) for x in (a, b))
    every = F.sequence(F.lit(0), F.col("c") - 1)
    left = a.select("rid", "n", "tok", F.col("k").alias("i"), F.explode(every).alias("j"))
    right = b.select("rid", "n", "tok", F.explode(every).alias("i"), F.col("k").alias("j"))
    both = _side(left, "1", "tok", "i", "j").join(_side(right, "2", "tok", "i", "j"), ["tok", "i", "j"]).where(_order(self_join))
    return both.groupBy("rid1", "rid2", "n1", "n2").agg(F.count("*").alias("overlap"))


#: Prefix postings of a token up to which it is joined as a whole; more are cut into chunks of as many.
HEAVY = 2000


def _met(a: DataFrame, b: DataFrame, condition: Column, heavy: int = HEAVY) -> DataFrame:
    """a and b, sides 1 and 2 of postings, joined by token. Chunks of heavy tokens' postings meet pairwise, so no task holds one whole."""
    load = a.select("tok").unionByName(b.select("tok")).groupBy("tok").agg(F.count("*").alias("f")).where(F.col("f") > 2 * heavy)
    large = cut(load.select("tok", F.ceil(F.col("f") / (2 * heavy)).cast("int").alias("c")))
    if not large.count():
        return a.join(b, "tok").where(condition)
    left, right = (x.join(large, "tok").withColumn("_k", F.pmod(F.xxhash64(r), F.col("c").cast("long")).cast("int")) for x, r in ((a, "rid1"), (b, "rid2")))
    every = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    left, right = left.withColumn("_j", every).withColumnRenamed("_k", "_i").drop("c"), right.withColumn("_i", every).withColumnRenamed("_k", "_j").drop("c")
    small = a.join(large, "tok", "left_anti").join(b, "tok").where(condition)
    return small.unionByName(left.join(right, ["tok", "_i", "_j"]).where(condition).select(*small.columns))


def prefix(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """Pairs that share one of their first tokens in the order of frequency, within the length and position filters.

    Of a self-join, the shorter set of a pair is looked for by its index prefix alone.
    """
    n1, n2, i, j = (F.col(c) for c in ("n1", "n2", "pos1", "pos2"))
    p = bounds.prefix_length(F.col("n"), t)
    first = bounds.index_prefix_length(F.col("n"), t) if self_join else p
    a, b = _side(_exploded(r, first), "1", "tok"), _side(_exploded(s, p), "2", "tok")
    near = bounds.length_filter(n1, n2, t) & bounds.position_filter(n1, i, n2, j, t)
    if self_join:
        near = ((n1 < n2) | ((n1 == n2) & (F.col("rid1") < F.col("rid2")))) & near
    met = _met(a, b, near).select("rid1", "rid2")
    if self_join:
        met = met.select(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"))
    return met.distinct()


def _ranked(r: DataFrame, s: DataFrame) -> list[DataFrame]:
    """(rid, ranks) of both: tokens as numbers in one order, sorted, for filters that compare tokens."""
    posts = [x.select("rid", F.explode("toks").alias("tok")) for x in (r, s)]
    ids = cut(token_order(posts[0].unionByName(posts[1])).select(F.col("token").alias("tok"), "rank"))
    return [p.join(ids, "tok").groupBy("rid").agg(F.array_sort(F.collect_list("rank")).alias("ranks")) for p in posts]


def _with_suffix_bound(df: DataFrame, a: str, b: str, depth: int, name: str) -> DataFrame:
    """df with ``bounds.suffix_bound`` of two columns as ``name``, level by level: each half is made once."""
    if depth == 0:
        return df.withColumn(name, F.abs(F.size(a) - F.size(b)))
    middle = F.get(b, F.floor(F.size(b) / 2).cast("int"))
    at = F.size(F.filter(a, lambda t: t < F.col(f"{name}_m")))
    there = F.get(a, F.col(f"{name}_at")) == F.col(f"{name}_m")
    df = df.withColumn(f"{name}_m", middle).withColumn(f"{name}_at", at).withColumn(f"{name}_in", F.coalesce(there, F.lit(False)).cast("int"))
    half, found = F.floor(F.size(b) / 2).cast("int"), F.col(f"{name}_at")
    end = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
    halves = {f"{name}_la": F.slice(a, 1, found), f"{name}_lb": F.slice(b, 1, half), f"{name}_ra": end(a, found + F.col(f"{name}_in")), f"{name}_rb": end(b, half + 1)}
    df = df.withColumns(halves)
    for side in "lr":
        df = _with_suffix_bound(df, f"{name}_{side}a", f"{name}_{side}b", depth - 1, f"{name}_{side}")
    whole = F.col(f"{name}_l") + F.col(f"{name}_r") + 1 - F.col(f"{name}_in")
    return df.withColumn(name, F.when(F.size(b) == 0, F.size(a)).otherwise(whole))


def prefix_suffix(r: DataFrame, s: DataFrame, self_join: bool, t: float, depth: int = 2) -> DataFrame:
    """Prefix pairs that pass the suffix filter: halving both sets, too many tokens are in one only."""
    found = prefix(r, s, self_join, t)
    ranks = _ranked(r, s)
    for k, x in (("1", ranks[0]), ("2", ranks[1])):
        found = found.join(x.select(F.col("rid").alias(f"rid{k}"), F.col("ranks").alias(f"ranks{k}")), f"rid{k}")
    bounded = _with_suffix_bound(found, "ranks1", "ranks2", depth, "_b")
    n, m = F.size("ranks1"), F.size("ranks2")
    return bounded.where(F.col("_b") <= n + m - 2 * bounds.min_overlap(n, m, t)).select("rid1", "rid2")


def two_sided(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """Prefix pairs whose last tokens in reverse order meet as well: each test holds for every answer, so both may be asked for."""
    p = bounds.prefix_length(F.col("n"), t)
    back = F.slice(F.reverse("toks"), 1, p)
    found = prefix(r, s, self_join, t)
    backs = [x.select(F.col("rid").alias(f"rid{k}"), back.alias(f"back{k}")) for k, x in ((1, r), (2, s))]
    return found.join(backs[0], "rid1").join(backs[1], "rid2").where(F.arrays_overlap("back1", "back2")).select("rid1", "rid2")


def remainder(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """Prefixes are counted by the join; what the side whose prefix ends first has beyond it is intersected
    with the other's tokens. Returns overlaps."""
    p = bounds.prefix_length(F.col("n"), t)
    pairs = _side(_exploded(r, p), "1", "tok").join(_side(_exploded(s, p), "2", "tok"), "tok")
    n1, n2 = F.col("n1"), F.col("n2")
    shared = pairs.where(_order(self_join) & bounds.length_filter(n1, n2, t)).groupBy("rid1", "rid2", "n1", "n2").agg(F.count("*").alias("common"))
    sides = [x.select(F.col("rid").alias(f"rid{k}"), F.col("toks").alias(f"toks{k}"), F.slice("toks", 1, p).alias(f"pre{k}")) for k, x in ((1, r), (2, s))]
    both = shared.join(sides[0], "rid1").join(sides[1], "rid2")
    beyond = lambda k: F.slice(f"toks{k}", F.size(f"pre{k}") + 1, F.size(f"toks{k}"))
    # The remainder of the side whose prefix ends first counts. Either way counts a part of the overlap and that one all
    # of it, so the larger is exact, and no token order is needed here.
    one = F.col("common") + F.size(F.array_intersect(beyond(2), F.col("toks1")))
    two = F.col("common") + F.size(F.array_intersect(beyond(1), F.col("toks2")))
    return both.select("rid1", "rid2", "n1", "n2", F.greatest(one, two).cast("long").alias("overlap"))


def group(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """Tokens fall in ``floor((1 - t) / t * l) + 1`` groups of a record of length l; similar sets agree on a whole group.
    Groups without tokens count as well, since two sets may agree on nothing else."""

    def keyed(sets: DataFrame, length: Column) -> DataFrame:
        out = sets.withColumn("l", F.explode(length)).withColumn("g", bounds.most_differences(F.col("l"), t) + 1)
        each = out.select("rid", "n", "l", "g", F.explode("toks").alias("x"))
        each = each.select("rid", "n", "l", F.pmod(F.xxhash64("x"), F.col("g").cast("long")).cast("int").alias("i"), F.xxhash64("x", F.lit(1)).alias("h"), F.lit(1).alias("m"))
        none = out.select("rid", "n", "l", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("m"))
        return each.unionByName(none).groupBy("rid", "n", "l", "i").agg(F.bit_xor("h").alias("key"), F.sum("m").alias("m"))

    top = F.col("n") if self_join else bounds.max_length(F.col("n"), t)
    a = keyed(r, F.array("n"))
    b = keyed(s, F.sequence(F.greatest(bounds.min_length(F.col("n"), t), F.lit(1)), top))
    both = _side(a, "1", "l", "i", "key", "m").join(_side(b, "2", "l", "i", "key", "m"), ["l", "i", "key", "m"])
    if self_join:
        both = both.where("n1 < n2 or (n1 = n2 and rid1 < rid2)").select(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"))
    return _pairs(both)


def segment(r: DataFrame, s: DataFrame, self_join: bool, t: float, groups: int = 0) -> DataFrame:
    """Sorted records are cut into one segment more than they may differ by; one of them stands whole in any similar
    record, not far from its place. Probes enumerate substrings for all lengths that a partner may have. With ``groups``, pairs
    go whose tokens, counted by so many groups of level frequency, differ too much."""

    def shape(a: Column) -> Column:
        return F.least(bounds.most_differences(a, t) + 1, a)

    def start(i: Column, a: Column, d: Column) -> Column:
        base, more = F.floor(a / d).cast("int"), F.pmod(a, d)
        return i * base + F.greatest(i - (d - more), F.lit(0))

    def size(i: Column, a: Column, d: Column) -> Column:
        return F.floor(a / d).cast("int") + F.when(i >= d - F.pmod(a, d), 1).otherwise(0)

    a, d, i, p = (F.col(c) for c in ("a", "d", "i", "p"))
    own = r.select("rid", "n", "toks", F.col("n").alias("a")).withColumn("d", shape(a)).withColumn("i", F.explode(F.sequence(F.lit(0), d - 1)))
    own = own.select("rid", "n", "a", "i", F.slice("toks", start(i, a, d) + 1, size(i, a, d)).alias("sig"))
    top = F.col("n") if self_join else bounds.max_length(F.col("n"), t)
    probe = s.withColumn("a", F.explode(F.sequence(F.greatest(bounds.min_length(F.col("n"), t), F.lit(1)), top))).withColumn("d", shape(a))
    probe = probe.withColumn("i", F.explode(F.sequence(F.lit(0), d - 1))).withColumn("m", size(i, a, d)).where("m <= n")
    far = bounds.most_differences(a, t)
    low, high = F.greatest(start(i, a, d) - far, F.lit(0)), F.least(start(i, a, d) + far, F.col("n") - F.col("m"))
    probe = probe.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").withColumn("p", F.explode(F.sequence("lo", "hi")))
    probe = probe.select("rid", "n", "a", "i", F.slice("toks", p + 1, F.col("m")).alias("sig")).distinct()
    both = _side(own, "1", "a", "i", "sig").join(_side(probe, "2", "a", "i", "sig"), ["a", "i", "sig"])
    if groups:
        both = _light(both, r, s, self_join, t, groups)
    if self_join:
        both = both.where("n1 < n2 or (n1 = n2 and rid1 < rid2)").select(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"))
    return _pairs(both)


def _light(pairs: DataFrame, r: DataFrame, s: DataFrame, self_join: bool, t: float, groups: int) -> DataFrame:
    """Pairs (rid1, n1, rid2, n2) whose histograms over token groups are near enough."""
    posts = [x.select("rid", F.explode("toks").alias("tok")) for x in ((r,) if self_join else (r, s))]
    every = posts[0] if self_join else posts[0].unionByName(posts[1])
    of = cut(token_groups(cut(token_order(every)), groups))
    hist = [group_histograms(p, of, groups) for p in posts]
    out = pairs.select("rid1", "n1", "rid2", "n2").distinct()
    for k, x in (("1", hist[0]), ("2", hist[-1])):
        out = out.join(x.select(F.col("rid").alias(f"rid{k}"), F.col("hist").alias(f"hist{k}")), f"rid{k}")
    most = F.col("n1") + F.col("n2") - 2 * bounds.min_overlap(F.col("n1"), F.col("n2"), t)
    return out.where(bounds.histogram_difference(F.col("hist1"), F.col("hist2")) <= most)


def fragment(r: DataFrame, s: DataFrame, self_join: bool, t: float, fragments: int = 11, horizontal: int = 3) -> DataFrame:
    """Records are cut at fixed token ranks into fragments; overlaps are counted by fragment, dropped where even the rest
    could not reach the threshold, and added up. Records are also dealt to ``horizontal`` bands of lengths, one side to the
    bands of all lengths that a partner may have, so that only records of near lengths meet. Returns overlaps."""
    posts = _all(r).unionByName(_all(s)) if not self_join else _all(r)
    freq = posts.groupBy("tok").agg(F.count("*").alias("f"))
    total = freq.agg(F.sum("f")).first()[0] or 1
    edges = freq.groupBy("f").agg((F.sum("f")).alias("w")).orderBy("f").collect()
    bound, cuts = 0, []
    for row in edges:
        bound += row["w"]
        if bound >= total * (len(cuts) + 1) / fragments:
            cuts.append(row["f"])
    place = F.lit(0)
    for c in cuts[:-1]:
        place = place + F.when(F.col("f") > c, 1).otherwise(0)

    lengths = r.select("n") if self_join else r.select("n").unionByName(s.select("n"))
    upto, band_ends = 0, []
    sizes = lengths.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").collect()
    for row in sizes:
        upto += row["k"]
        if upto >= sum(x["k"] for x in sizes) * (len(band_ends) + 1) / horizontal:
            band_ends.append(row["n"])

    def band(n: Column) -> Column:
        out = F.lit(0)
        for end in band_ends[:-1]:
            out = out + F.when(n > end, 1).otherwise(0)
        return out

    def cutted(sets: DataFrame, bands: Column) -> DataFrame:
        # Places in the order of these frequencies, which need not be that of toks.
        at = F.row_number().over(Window.partitionBy("rid").orderBy("f", "tok")) - 1
        out = _all(sets).join(freq, "tok").withColumn("pos", at).select("rid", "n", "tok", place.alias("frag"), "pos")
        ends = out.groupBy("rid", "frag").agg(F.min("pos").alias("before"), F.max("pos").alias("last"))
        return out.join(ends, ["rid", "frag"]).select("rid", "n", "tok", "frag", "before", (F.col("n") - F.col("last") - 1).alias("after"), F.explode(bands).alias("band"))

    least, most = bounds.min_length(F.col("n"), t), bounds.max_length(F.col("n"), t)
    left = cutted(r, F.sequence(band(least), band(most)))
    right = cutted(s, F.array(band(F.col("n"))))
    keys = ["tok", "frag", "band"]
    both = _side(left, "1", *keys).join(_side(right, "2", *keys), keys).where(_order(self_join) & bounds.length_filter(F.col("n1"), F.col("n2"), t))
    parts = both.groupBy("rid1", "rid2", "n1", "n2", "frag", "before1", "before2", "after1", "after2").agg(F.count("*").alias("o"))
    parts = parts.where(bounds.fragment_bound(F.col("before1"), F.col("before2"), F.col("o"), F.col("after1"), F.col("after2")) >= bounds.min_overlap(F.col("n1"), F.col("n2"), t))
    return parts.groupBy("rid1", "rid2", "n1", "n2").agg(F.sum("o").alias("overlap"))


def _distance(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return 1 - shared / (F.size(a) + F.size(b) - shared)


def _cells(sets: DataFrame, pivots: DataFrame, eps: float, keys: list[str]) -> DataFrame:
    """(…keys, rid, n, toks, pivot, home, dist): a row for the cell of the nearest pivot and each cell whose window it is in."""
    pv = pivots.select(*keys, F.col("rid").alias("pivot"), F.col("toks").alias("ptoks"))
    near = sets.join(pv, keys).withColumn("dist", _distance(F.col("toks"), F.col("ptoks"))).groupBy(*keys, "rid", "n").agg(F.first("toks").alias("toks"), F.array_sort(F.collect_list(F.struct("dist", "pivot"))).alias("all"))
    near = near.withColumn("best", F.col("all")[0]).withColumn("one", F.explode("all"))
    return near.where((F.col("one.dist") - F.col("best.dist")) / 2 <= eps + 1e-12).select(*keys, "rid", "n", "toks", F.col("one.pivot").alias("pivot"), (F.col("one.pivot") == F.col("best.pivot")).alias("home"), F.col("one.dist").alias("dist"))


def pivot_cells(sets: DataFrame, pivots: list, eps: float) -> DataFrame:
    """The same around a few pivots (rows rid, toks), which go with the plan: no join, and token arrays stay where they are."""
    of = F.array(*[F.struct(F.lit(p["rid"]).alias("pivot"), F.lit(p["toks"]).alias("ptoks")) for p in pivots])
    near = sets.withColumn("all", F.array_sort(F.transform(of, lambda p: F.struct(_distance(F.col("toks"), p["ptoks"]).alias("dist"), p["pivot"].alias("pivot")))))
    near = near.withColumn("best", F.col("all")[0]).withColumn("one", F.explode("all"))
    return near.where((F.col("one.dist") - F.col("best.dist")) / 2 <= eps + 1e-12).select("rid", "n", F.col("one.pivot").alias("pivot"), (F.col("one.pivot") == F.col("best.pivot")).alias("home"), F.col("one.dist").alias("dist"))


def chosen_pivots(sets: DataFrame, pivots: int, samples: int) -> list:
    """The first ``pivots`` ids of a sample of ``samples`` records."""
    return hash_sample(sets.select("rid", "toks"), ["rid"], samples).orderBy("rid").limit(pivots).collect()


def pivot(r: DataFrame, s: DataFrame, self_join: bool, t: float, pivots: int = 16, samples: int = 200, max_cell: int = 2000) -> DataFrame:
    """Metric cells around sampled pivots: a record meets, in the cell of its nearest pivot, the records at home there and
    those near enough to its border. Lengths and the triangle inequality filter pairs within a cell. Cells of more than
    ``max_cell`` records at home are cut into a grid of chunks, so that no task holds a large cell."""
    rows = chosen_pivots(r, pivots, samples)
    if not rows:
        return r.select(F.col("rid").alias("rid1"), F.col("rid").alias("rid2")).limit(0)
    a = cut(pivot_cells(r, rows, 1 - t))
    b = a if self_join else cut(pivot_cells(s, rows, 1 - t))
    parts = cell_sizes(a).select("pivot", F.ceil(F.col("records") / max_cell).cast("int").alias("c"))
    own = F.pmod(F.xxhash64("rid"), F.col("c").cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    left = a.where("home").join(F.broadcast(parts), "pivot").select("rid", "n", "pivot", "dist", own.alias("i"), every.alias("j"))
    right = b.join(F.broadcast(parts), "pivot").select("rid", "n", "pivot", "dist", every.alias("i"), own.alias("j"))
    keys = ["pivot", "i", "j"]
    near = F.abs(F.col("dist1") - F.col("dist2")) <= 1 - t + 1e-9
    both = _side(left, "1", *keys).join(_side(right, "2", *keys), keys).where(bounds.length_filter(F.col("n1"), F.col("n2"), t) & near)
    if self_join:
        both = both.where("rid1 <> rid2").select(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"))
    return _pairs(both)


def recursive_pivot(r: DataFrame, s: DataFrame, self_join: bool, t: float, pivots: int = 8, max_cell: int = 500, rounds: int = 4) -> DataFrame:
    """Cells as in ``pivot``, those of more than ``max_cell`` records cut again around pivots of their own. A cell
    whose cut would more than double its records (they are alike far from all pivots), and all after the last
    round, are joined as they are."""
    every = r.select("rid", "n", "toks", F.lit(1).alias("side"))
    if not self_join:
        every = every.unionByName(s.select("rid", "n", "toks", F.lit(2).alias("side")))
    # rid and side make one key, as the two collections may share ids
    work = cut(every.select(F.lit("").alias("cell"), "rid", "n", "toks", "side"))
    done = None
    for _ in range(rounds):
        sizes = cut(work.groupBy("cell").agg(F.count("*").alias("size")))
        large = cut(sizes.where(F.col("size") > max_cell).select("cell"))
        small = work.join(large, "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.count() == 0:
            work = None
            break
        big = work.join(large, "cell")
        rank = F.row_number().over(_by_hash("cell"))
        pv = cut(big.withColumn("_k", rank).where(F.col("_k") <= pivots).select("cell", F.col("rid"), "toks"))
        parts = [_cells(big.where(F.col("side") == k).select("cell", "rid", "n", "toks"), pv, 1 - t, ["cell"]).withColumn("side", F.lit(k)) for k in ((1,) if self_join else (1, 2))]
        next_cells = cut(parts[0] if self_join else parts[0].unionByName(parts[1]))
        grown = next_cells.groupBy("cell").agg(F.count("*").alias("rows")).join(sizes, "cell")
        split = cut(grown.where(F.col("rows") <= 2 * F.col("size")).select("cell"))
        done = done.unionByName(big.join(split, "cell", "left_anti"))
        work = cut(next_cells.join(split, "cell").select(F.concat_ws("/", "cell", F.col("pivot").cast("string")).alias("cell"), "rid", "n", "toks", "side").distinct())
    if work is not None:
        done = done.unionByName(work)
    done = cut(done.select("cell", "rid", "n", "side"))
    left = _side(done.where("side = 1").drop("side"), "1", "cell")
    right = _side(done.where(F.col("side") == (1 if self_join else 2)).drop("side"), "2", "cell")
    return _pairs(left.join(right, "cell").where(_order(self_join) & bounds.length_filter(F.col("n1"), F.col("n2"), t)))


def _by_hash(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.xxhash64("rid"), "rid", "side")


def grid(r: DataFrame, s: DataFrame, self_join: bool, t: float, side: int = 4) -> DataFrame:
    """The whole cross product, cut into cells of a grid of record groups; only lengths filter."""
    cell = F.pmod(F.xxhash64("rid"), F.lit(side)).cast("int")
    a = r.select("rid", "n", cell.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("j"))
    b = s.select("rid", "n", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("i"), cell.alias("j"))
    both = _side(a, "1", "i", "j").join(_side(b, "2", "i", "j"), ["i", "j"])
    return both.where(_order(self_join) & bounds.length_filter(F.col("n1"), F.col("n2"), t)).select("rid1", "rid2")


def length_bucket(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """A record probes the bucket of every length that a partner may have."""
    a = r.select("rid", "n", F.col("n").alias("l"))
    b = s.select("rid", "n", F.explode(F.sequence(F.greatest(bounds.min_length(F.col("n"), t), F.lit(1)), bounds.max_length(F.col("n"), t))).alias("l"))
    return _side(a, "1", "l").join(_side(b, "2", "l"), "l").where(_order(self_join)).select("rid1", "rid2")


def _deletions(t: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sig = [], []
            for x, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                toks = sorted(map(str, toks))
                least = max(1, -int(-(t * len(toks) - bounds.GUARD) // 1))
                for k in range(least, len(toks) + 1):
                    for part in combinations(toks, k):
                        rid.append(x), sig.append("\x1f".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(sig, pa.string())], names=["rid", "sig"])

    return run


def deletion_ball(r: DataFrame, s: DataFrame, self_join: bool, t: float) -> DataFrame:
    """Every subset that a similar set may have in common with a record is a signature; similar sets share their
    intersection. Exponential in what may be deleted: for small sets only."""
    a, b = (x.select("rid", "toks").mapInArrow(_deletions(t), "rid long, sig string") for x in (r, s))
    return _pairs(_side(a, "1", "sig").join(_side(b, "2", "sig"), "sig").where(_order(self_join)))


def _ball(t: float, universe_of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        universe = universe_of.value
        for batch in batches:
            rid, sig = [], []
            for x, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(map(str, toks))
                others = [u for u in universe if u not in own]
                n = len(own)
                for kept in range(1, n + 1):
                    most = int(kept / t + bounds.GUARD) - n
                    for part in combinations(own, kept) if most >= 0 else ():
                        for k in range(0, most + 1):
                            for new in combinations(others, k):
                                rid.append(x), sig.append("\x1f".join(sorted(part + new)))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(sig, pa.string())], names=["rid", "sig"])

    return run


def full_ball(r: DataFrame, s: DataFrame, self_join: bool, t: float, max_universe: int = 64) -> DataFrame:
    """A record's signatures are all sets similar to it, tokens inserted from the whole universe; partners match as they
    are. Only for a universe of at most ``max_universe`` tokens: a larger one is an error."""
    universe = sorted(str(x[0]) for x in _all(r).unionByName(_all(s)).select("tok").distinct().limit(max_universe + 1).collect())
    if len(universe) > max_universe:
        raise ValueError(f"full_ball needs a universe of at most {max_universe} tokens")
    ball = r.select("rid", "toks").mapInArrow(_ball(t, r.sparkSession.sparkContext.broadcast(universe)), "rid long, sig string")
    own = s.select("rid", F.array_join(F.array_sort(F.col("toks").cast("array<string>")), "\x1f").alias("sig"))
    return _pairs(_side(ball, "1", "sig").join(_side(own, "2", "sig"), "sig").where(_order(self_join)))


_COUNTED = "rid1 long, rid2 long, n1 int, n2 int, overlap long"


def _asymmetric(t: float, self_join: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index = PrefixIndex(t)
        for rid, toks in zip(left.column("rid").to_pylist(), left.column("toks").to_pylist()):
            index.add(rid, toks)
        out = []
        for rid, toks, same in zip(right.column("rid").to_pylist(), right.column("toks").to_pylist(), [c == k for c, k in zip(right.column("i").to_pylist(), right.column("j").to_pylist())]):
            for other, shared, _ in index.probe(toks):
                if self_join and (other == rid or (same and other > rid)):
                    continue
                pair = (other, rid, len(index.sets[other]), len(toks))
                out.append((rid, other, pair[3], pair[2], shared) if self_join and other > rid else (*pair, shared))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rid1", "rid2", "n1", "n2", "overlap"])

    return run


def probe(r: DataFrame, s: DataFrame, self_join: bool, t: float, chunk: int = 2000) -> DataFrame:
    """Chunks of R of about ``chunk`` records are indexed by prefix in memory, and records of S stream past each; of a self-join,
    a chunk probes itself and those of lower number. Returns overlaps. A record goes to as many tasks as there are chunks."""
    m = max(1, -(-r.count() // chunk))
    k = max(1, -(-s.count() // chunk))
    number = lambda c: F.pmod(F.xxhash64("rid"), F.lit(c)).cast("int")
    left = r.select("rid", "toks", number(m).alias("i"), F.explode(F.sequence(number(m) if self_join else F.lit(0), F.lit(k - 1))).alias("j"))
    right = s.select("rid", "toks", number(k).alias("j"), F.explode(F.sequence(F.lit(0), number(k) if self_join else F.lit(m - 1))).alias("i"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_asymmetric(t, self_join), _COUNTED)


STRATEGIES: dict[str, Strategy] = {f.__name__: f for f in (full, chunked, prefix, prefix_suffix, two_sided, remainder, group, segment, fragment, pivot, recursive_pivot, grid, length_bucket, deletion_ball, full_ball, probe)}
#: Strategies that return overlaps and need no verification.
COUNTED = {"full", "chunked", "remainder", "fragment", "probe"}
#: Strategies whose natural comparison is >=; the others' is >.
INCLUSIVE = {"prefix", "prefix_suffix", "probe", "pivot", "recursive_pivot", "deletion_ball", "full_ball"}
