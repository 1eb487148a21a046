"""Token orders and encodings of collections (rid, tokens)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setloom.functions.bounds import GUARD
from setloom.operators.base import cut, running_sum, stored


def postings(df: DataFrame, rid: str = "rid", tokens: str = "tokens") -> DataFrame:
    """(rid, tok): each distinct token of each record. Null ids, null tokens and empty records leave no row."""
    return df.where(F.col(rid).isNotNull()).select(F.col(rid).cast("long").alias("rid"), F.explode(tokens).alias("tok")).where("tok is not null").distinct()


def token_frequencies(posts: DataFrame) -> DataFrame:
    """(token, freq): in how many records each token is."""
    return posts.groupBy(F.col("tok").alias("token")).agg(F.count("*").alias("freq"))


def token_order(posts: DataFrame) -> DataFrame:
    """(token, freq, rank): ranks from 0 by ascending frequency, ties by token."""
    return running_sum(token_frequencies(posts), ["freq", "token"], F.lit(1), "rank")


def vocabulary(posts: DataFrame) -> DataFrame:
    """(token, id): ids from 0 in the order of tokens."""
    return running_sum(posts.select(F.col("tok").alias("token")).distinct(), ["token"], F.lit(1), "id")


def collect_sets(posts: DataFrame, order: Column) -> DataFrame:
    """(rid, n, toks) with toks sorted by ``order``, a column of posts."""
    sets = posts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("tok")))).alias("toks"))
    return sets.select("rid", F.size("toks").alias("n"), F.transform("toks", lambda t: t["tok"]).alias("toks"))


#: Tokens whose frequencies are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_TOKENS = 500_000


def encode(*collections: DataFrame) -> list[DataFrame]:
    """Each collection of postings as (rid, n, toks), rare tokens first (by frequency in all of them, ties by token).

    The order needs no ranks: a token's frequency goes with it to its record, where (frequency, token) sorts.
    """
    every = collections[0]
    for other in collections[1:]:
        every = every.unionByName(other)
    freq = cut(every.groupBy("tok").agg(F.count("*").alias("freq")))
    side = F.broadcast(freq) if freq.count() <= BROADCAST_TOKENS else freq
    return [cut(collect_sets(p.join(side, "tok"), F.col("freq"))) for p in collections]


def encode_ranks(*collections: DataFrame) -> list[DataFrame]:
    """Each collection of postings as (rid, n, toks, shared): toks are the tokens' ranks, ascending, in the order of ``encode``, as integers;
    shared counts those that are in a record of the other collection or, if there is one collection, in another record."""
    every = collections[0].select("tok", F.lit(1).alias("side"))
    for other in collections[1:]:
        every = every.unionByName(other.select("tok", F.lit(2).alias("side")))
    freq = every.groupBy("tok").agg(F.count("*").alias("freq"), (F.min("side") < F.max("side")).alias("both"))
    shared = F.col("freq") > 1 if len(collections) == 1 else F.col("both")
    ids = stored(running_sum(freq, ["freq", "tok"], F.lit(1), "rank").select("tok", F.col("rank").cast("int").alias("rank"), shared.cast("int").alias("shared")))
    rare = ids.count() - BROADCAST_TOKENS
    sets = [_ranked(p, ids, rare).groupBy("rid").agg(F.sort_array(F.collect_list("rank")).alias("toks"), F.sum("shared").alias("shared")) for p in collections]
    return [stored(x.select("rid", F.size("toks").alias("n"), "toks", "shared")) for x in sets]


def _ranked(posts: DataFrame, ids: DataFrame, rare: int) -> DataFrame:
    """Postings with their tokens' ids. Those of the most frequent tokens are broadcast, so only postings of ``rare`` others are shuffled."""
    often = F.broadcast(ids.where(F.col("rank") >= rare))
    if rare <= 0:
        return posts.join(often, "tok")
    seldom = posts.join(often, "tok", "left_anti").join(ids.where(F.col("rank") < rare), "tok")
    return posts.join(often, "tok").unionByName(seldom)


def distinct_sets(df: DataFrame, rid: str = "rid", tokens: str = "tokens") -> DataFrame:
    """(rid, toks), stored: each token of a record once, no empty records, rows that repeat an id as one."""
    own = stored(df.where(F.col(rid).isNotNull()).select(F.col(rid).cast("long").alias("rid"), F.array_distinct(F.array_compact(tokens)).alias("toks")).where("size(toks) > 0"))
    again = own.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return stored(own.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("toks"))) if again else own


def records(df: DataFrame, rid: str = "rid", tokens: str = "tokens") -> DataFrame:
    """Postings of records, each token of a record once."""
    return distinct_sets(df, rid, tokens).select("rid", F.explode("toks").alias("tok"))


def encode_shared(r: DataFrame, s: DataFrame, t: float) -> list[DataFrame] | None:
    """Both collections of (rid, toks) as (rid, n, toks), where toks are the ranks, ascending, of the tokens that are in both collections and
    n counts all tokens; without records of which fewer than a share t of tokens are in both. Rare tokens have low ranks. No posting is
    shuffled: the lesser side's vocabulary is sent to all records. None if that is too large to send."""
    tokens = [x.agg(F.sum(F.size("toks"))).first()[0] or 0 for x in (r, s)]
    less, more = (r, s) if tokens[0] < tokens[1] else (s, r)
    posts = lambda x: x.select(F.explode("toks").alias("tok"))
    known = cut(posts(less).groupBy("tok").agg(F.count("*").alias("freq")))
    if known.count() > BROADCAST_TOKENS:
        return None
    both = posts(more).join(F.broadcast(known), "tok").groupBy("tok").agg((F.first("freq") + F.count("*")).alias("freq"))
    vocabulary = both.toArrow().sort_by([("freq", "ascending"), ("tok", "ascending")]).column("tok").combine_chunks()
    sent = r.sparkSession.sparkContext.broadcast(vocabulary)
    return [stored(x.mapInArrow(_to_ranks(sent, t), "rid long, n int, toks array<int>")) for x in (r, s)]


def _to_ranks(sent: Broadcast, t: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            toks = batch.column("toks")
            n = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = pc.fill_null(pc.index_in(toks.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            k = np.bincount(row[rank >= 0], minlength=len(n))
            kept = k >= np.maximum(np.ceil(n * t - GUARD), 1)
            own = (rank >= 0) & kept[row]
            rank, row = rank[own], row[own]
            rank = rank[np.lexsort((rank, row))]
            offsets = np.concatenate([[0], np.cumsum(k[kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rid").filter(pa.array(kept)), pa.array(n[kept], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(rank, pa.int32()))], names=["rid", "n", "toks"])

    return run


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(sets without those equal to one of a lower id, (rep, rid, n) of those left out; None if there are none)."""
    key = F.xxhash64("n", "toks")
    keys = cut(sets.groupBy("n", key.alias("h")).agg(F.count("*").alias("c")).where("c > 1").select("n", "h"))
    few = keys.count()
    if not few:
        return sets, None
    alike = sets.withColumn("h", key).join(F.broadcast(keys) if few <= BROADCAST_TOKENS else keys, ["n", "h"], "left_semi")
    reps = alike.groupBy("n", "toks").agg(F.min("rid").alias("rep"))
    members = cut(alike.join(reps, ["n", "toks"]).where("rid <> rep").select("rep", "rid", "n"))
    return stored(sets.join(members.select("rid"), "rid", "left_anti")), members


def with_ranks(posts: DataFrame) -> DataFrame:
    """(rid, tokens) with tokens replaced by their ranks, sorted."""
    order = token_order(posts).select(F.col("token").alias("tok"), "rank")
    return posts.join(order, "tok").groupBy("rid").agg(F.array_sort(F.collect_list("rank")).alias("tokens"))


def remove_frequent(posts: DataFrame, share: float = 0.01) -> DataFrame:
    """Postings without the most frequent ``share`` of the vocabulary (ties by token); emptied records vanish."""
    order = cut(token_order(posts))
    size = order.count()
    kept = order.where(F.col("rank") < size - int(size * share)).select(F.col("token").alias("tok"))
    return posts.join(kept, "tok", "left_semi").select("rid", "tok")


def numbered_tokens(df: DataFrame, tokens: Column, rid: str = "rid", separator: str = "_") -> DataFrame:
    """(rid, tok) with each token tagged by the number of its occurrence in the record: bags as sets, for long texts."""
    each = df.select(F.col(rid).alias("rid"), F.posexplode(tokens).alias("pos", "tok"))
    k = F.row_number().over(Window.partitionBy("rid", "tok").orderBy("pos"))
    return each.select("rid", F.concat_ws(separator, "tok", k.cast("string")).alias("tok"))


def remove_singletons(posts: DataFrame) -> DataFrame:
    """Postings whose token is in more than one record: the only ones that can match."""
    n = token_frequencies(posts).where("freq > 1").select(F.col("token").alias("tok"))
    return posts.join(n, "tok", "left_semi").select("rid", "tok")


def assign_rids(df: DataFrame, keys: list[str], factor: int = 1) -> DataFrame:
    """df with rid = 1, 1 + factor, 1 + 2 factor... in the order of keys."""
    return running_sum(df, keys, F.lit(1), "_place").withColumn("rid", F.col("_place") * factor + 1).drop("_place")


def scale_out(sets: DataFrame, factor: int, max_token: int) -> DataFrame:
    """``factor`` copies of each record: copy i has rid + i and tokens (t + i) mod (max_token + 1)."""
    copies = sets.select("rid", "tokens", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("i"))
    return copies.select((F.col("rid") + F.col("i")).alias("rid"), F.array_sort(F.transform("tokens", lambda t: F.pmod(t + F.col("i"), F.lit(max_token + 1)))).alias("tokens"))


def tokenize(df: DataFrame, tokens: Column, rid: str = "rid") -> DataFrame:
    """From texts to integer sets: (rid, tokens) with sorted vocabulary ids."""
    posts = cut(postings(df.select(F.col(rid).alias("rid"), tokens.alias("tokens"))))
    ids = vocabulary(posts).select(F.col("token").alias("tok"), "id")
    return posts.join(ids, "tok").groupBy("rid").agg(F.array_sort(F.collect_list("id")).alias("tokens"))


def token_groups(order: DataFrame, groups: int = 30) -> DataFrame:
    """(token, grp): tokens in order, each to the group of least total frequency so far (ties to the lower group).

    Tokens of one frequency are a run. Once the totals of a run differ by less than its frequency, groups take turns; so the driver
    needs a row for each different frequency and a step for each token before that, and no task sees the vocabulary.
    """
    runs = order.groupBy("freq").agg(F.min("rank").alias("start"), F.count("*").alias("n")).orderBy("freq").collect()
    totals, rows = [0] * groups, []
    for r in runs:
        first, left = [], r["n"]
        while left and max(totals) - min(totals) >= r["freq"]:
            g = totals.index(min(totals))
            totals[g] += r["freq"]
            first.append(g)
            left -= 1
        turns = sorted(range(groups), key=lambda g: (totals[g], g))
        for i, g in enumerate(turns):
            totals[g] += r["freq"] * (left // groups + (i < left % groups))
        rows.append((r["freq"], r["start"], first, turns))
    about = order.sparkSession.createDataFrame(rows, "freq long, start long, first array<int>, turns array<int>")
    at = (F.col("rank") - F.col("start")).cast("int")
    later = F.get("turns", F.pmod(at - F.size("first"), F.lit(groups)).cast("int"))
    return order.join(F.broadcast(about), "freq").select("token", F.when(at < F.size("first"), F.get("first", at)).otherwise(later).alias("grp"))


def group_histograms(posts: DataFrame, groups_of: DataFrame, groups: int = 30) -> DataFrame:
    """(rid, hist): how many tokens of each group a record has."""
    own = posts.join(groups_of.select(F.col("token").alias("tok"), "grp"), "tok").groupBy("rid", "grp").agg(F.count("*").cast("int").alias("k"))
    each = own.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("grp", "k"))).alias("m"))
    return each.select("rid", F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.coalesce(F.try_element_at("m", g), F.lit(0))).alias("hist"))


def descending(sets: DataFrame) -> DataFrame:
    """(rid, tokens) with the tokens of each set from the largest down."""
    return sets.select("rid", F.sort_array("tokens", asc=False).alias("tokens"))


def prefix_tokens(sets: DataFrame, length: Column) -> DataFrame:
    """(rid, pos, tok) of the first ``length`` tokens of each set."""
    return sets.select("rid", F.posexplode(F.slice("toks", 1, length)).alias("pos", "tok"))


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A deterministic sample: the n rows of least hash of their keys."""
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)
