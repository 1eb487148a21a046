"""The similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.functions import bounds
from setloom.operators import blocks
from setloom.operators.base import cut
from setloom.operators.candidates import COUNTED, INCLUSIVE, STRATEGIES
from setloom.operators.order import classes, distinct_sets, encode_ranks, encode_shared, records
from setloom.operators.verify import passes, scored, verify

#: Pairs of records up to which a strategy shuffles its candidates; more are joined in blocks. The balls never are.
FEW_PAIRS = 20_000_000
BALLS = {"deletion_ball", "full_ball"}


def similarity_join(df: DataFrame, df_s: DataFrame | None = None, *, threshold: float, algorithm: str = "prefix", strict: bool | None = None, rid: str = "rid", tokens: str = "tokens", by_class: bool = False, in_blocks: bool | None = None, **options: object) -> DataFrame:
    """(rid1, rid2, overlap, sim) of the pairs whose Jaccard similarity is above (strict) or at least the threshold.

    One collection is joined with itself, rid1 < rid2; of two, rid1 is of the first. ``strict`` defaults to the
    algorithm's own comparison. Repeated tokens of a record count once, empty records match nothing, records that
    repeat an id are one record with all their tokens.

    Of a self-join, equal sets are compared once, as a class named by its least id. ``by_class`` gives pairs of classes, and
    each other member's pair with its class, from which all pairs follow; without it, members are paired too, and a
    class of k copies has k (k - 1) / 2 rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if algorithm not in STRATEGIES:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {sorted(STRATEGIES)}")
    if strict is None:
        strict = algorithm not in INCLUSIVE
    self_join = df_s is None
    own = [distinct_sets(x, rid, tokens) for x in ((df,) if self_join else (df, df_s))]
    if not self_join and algorithm not in BALLS and (own[0].count() * own[1].count() > FEW_PAIRS if in_blocks is None else in_blocks):
        sets = encode_shared(*own, threshold)
        if sets is not None:
            return _two(*sets, threshold, strict)
    # What two sets share is at least t times either size.
    enough = F.col("shared") >= bounds.min_length(F.col("n"), threshold)
    sets = [x.where(enough).drop("shared") for x in encode_ranks(*[x.select("rid", F.explode("toks").alias("tok")) for x in own])]
    r, s = sets[0], sets[-1]
    members = None
    if self_join:
        r, members = classes(r)
        s = r
    if in_blocks is None:
        in_blocks = algorithm not in BALLS and r.count() * (s.count() / 2 if self_join else s.count()) > FEW_PAIRS
    if in_blocks:
        pairs = scored(blocks.join(r, s, self_join, threshold), threshold, strict)
    else:
        found = STRATEGIES[algorithm](r, s, self_join, threshold, **options)
        pairs = scored(found, threshold, strict) if algorithm in COUNTED else verify(cut(found), r, s, threshold, strict)
    if members is None:
        return pairs
    equal = lambda d: d.select("rid1", "rid2", F.col("n").cast("long").alias("overlap"), F.lit(1.0).alias("sim")).where(passes(F.col("sim"), threshold, strict))
    if by_class:
        return pairs.unionByName(equal(members.select(F.col("rep").alias("rid1"), F.col("rid").alias("rid2"), "n")))
    pairs = cut(pairs)
    every = members.select("rep", "rid", "n").unionByName(members.select("rep", F.col("rep").alias("rid"), "n").distinct())
    a, b = (every.select("rep", F.col("rid").alias(f"rid{k}"), "n") for k in (1, 2))
    within = equal(a.join(b.drop("n"), "rep").where("rid1 < rid2").select("rid1", "rid2", "n"))
    for k, side in ((1, a), (2, b)):
        also = side.select(F.col("rep").alias(f"rid{k}"), F.col(f"rid{k}").alias("_member"))
        pairs = pairs.join(also, f"rid{k}", "left").withColumn(f"rid{k}", F.coalesce("_member", f"rid{k}")).drop("_member")
    return pairs.select(F.least("rid1", "rid2").alias("rid1"), F.greatest("rid1", "rid2").alias("rid2"), "overlap", "sim").unionByName(within)


def _two(r: DataFrame, s: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """The join of two collections in blocks. Records of one that have the same size and hold the same tokens have the same pairs, so one of
    them is compared and the others get what it has."""
    heads = [classes(x) for x in (r, s)]
    pairs = scored(blocks.join(heads[0][0], heads[1][0], False, threshold), threshold, strict)
    if heads[0][1] is heads[1][1] is None:
        return pairs
    pairs = cut(pairs)
    for k, (_, members) in enumerate(heads, 1):
        if members is not None:
            also = members.select(F.col("rep").alias(f"rid{k}"), F.col("rid").alias("_member"))
            pairs = pairs.unionByName(pairs.join(also, f"rid{k}").withColumn(f"rid{k}", F.col("_member")).drop("_member"))
    return pairs.select("rid1", "rid2", "overlap", "sim")


def all_similarities(df: DataFrame, rid: str = "rid", tokens: str = "tokens", by_class: bool = False) -> DataFrame:
    """(rid1, rid2, overlap, sim) of every pair with a common token, compared in blocks: pairs are returned, never shuffled. ``by_class``
    gives pairs of classes of equal sets, and each other member's pair with its class, as ``similarity_join`` does."""
    sets, members = encode_ranks(records(df, rid, tokens))[0].drop("shared"), None
    if by_class:
        sets, members = classes(sets)
    pairs = scored(blocks.join(sets, sets, True, 0.0), None, True)
    if members is None:
        return pairs
    return pairs.unionByName(members.select(F.col("rep").alias("rid1"), F.col("rid").alias("rid2"), F.col("n").cast("long").alias("overlap"), F.lit(1.0).alias("sim")))
