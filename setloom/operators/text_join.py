"""Texts back onto result pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.operators.base import cut

#: Bytes that a pair of ids takes when broadcast, and the bytes up to which pairs are.
PAIR_BYTES, BROADCAST_BYTES = 48, 256 << 20


def attach_text(pairs: DataFrame, texts: DataFrame, texts_s: DataFrame | None = None, rid: str = "rid", text: str = "text") -> DataFrame:
    """(rid1, rid2, text1, text2) by two joins on ids."""
    sides = [x.select(F.col(rid).alias(f"rid{k}"), F.col(text).alias(f"text{k}")) for k, x in ((1, texts), (2, texts_s or texts))]
    return pairs.select("rid1", "rid2").join(sides[0], "rid1").join(sides[1], "rid2").select("rid1", "rid2", "text1", "text2")


def attach_text_map_side(pairs: DataFrame, texts: DataFrame, texts_s: DataFrame | None = None, rid: str = "rid", text: str = "text") -> DataFrame:
    """The same, with the pairs broadcast to the texts if they are few enough; else by ``attach_text``."""
    own = cut(pairs.select("rid1", "rid2"))
    if own.count() * PAIR_BYTES > BROADCAST_BYTES:
        return attach_text(own, texts, texts_s, rid, text)
    first = texts.select(F.col(rid).alias("rid1"), F.col(text).alias("text1")).join(F.broadcast(own), "rid1")
    second = (texts_s or texts).select(F.col(rid).alias("rid2"), F.col(text).alias("text2")).join(F.broadcast(own), "rid2")
    return first.join(second, ["rid1", "rid2"]).select("rid1", "rid2", "text1", "text2")
