"""Similarity of sets and strings, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def jaccard_of_sizes(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of two arrays' elements; null for two empty ones."""
    shared = overlap(a, b)
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, shared / total)


def bag_jaccard(a: Column, b: Column) -> Column:
    """Distinct common elements over the arrays' full lengths."""
    return jaccard_of_sizes(overlap(a, b), F.size(a), F.size(b))


def jaccard_at_least(a: Column, b: Column, t: float) -> Column:
    """The similarity, or -1 below the threshold."""
    return F.when(jaccard(a, b) >= t, jaccard(a, b)).otherwise(-1.0)


def cosine_like(a: Column, b: Column) -> Column:
    """``(1 / (|a| |b|)) ^ overlap``, a quantity that falls with the overlap; not the cosine."""
    return F.pow(F.lit(1.0) / (F.size(a) * F.size(b)), overlap(a, b))


def euclidean_like(a: Column, b: Column) -> Column:
    """``sqrt(|a| + |b| - 2 o) / (|a| + |b| - o)`` for an overlap o."""
    o = overlap(a, b)
    return F.sqrt(F.size(a) + F.size(b) - 2 * o) / (F.size(a) + F.size(b) - o)


def overlap_at_least(a: Column, b: Column, k: int) -> Column:
    return overlap(a, b) >= k


def smallest_common(a: Column, b: Column) -> Column:
    return F.array_min(F.array_intersect(a, b))


def partial_overlap(a: Column, b: Column, stop: Column) -> Column:
    """Common elements of two sorted arrays up to and with ``stop``."""
    upto = lambda x: F.filter(x, lambda e: e <= stop)
    return overlap(upto(a), upto(b))


def partial_intersect(a: Column, b: Column, stop: Column) -> Column:
    """(overlap, at1, at2): common elements of two sorted arrays up to and with ``stop``, and its place in each from 1 (0: not there)."""
    return F.struct(partial_overlap(a, b, stop).alias("overlap"), F.array_position(a, stop).alias("at1"), F.array_position(b, stop).alias("at2"))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance; with ``most``, -1 above it."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def edit_distance_folded(a: Column, b: Column, most: int | None = None) -> Column:
    return edit_distance(F.lower(a), F.lower(b), most)


def edit_distance_bytes(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance of the UTF-8 bytes in small letters: what differs by one accented letter differs by its bytes."""
    raw = lambda c: F.decode(F.encode(F.lower(c), "UTF-8"), "ISO-8859-1")
    return edit_distance(raw(a), raw(b), most)


#: Tokens of two arrays up to which each can be a character of its own, below the surrogates.
CHARACTERS = 0xD000


def token_edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance of two token arrays; with ``most``, -1 above it.

    Tokens of one character are joined and compared as strings. Else each token becomes a character, by the place where it is first
    in both arrays. Arrays with nulls, which equal nothing, and very long ones go by rows of the dynamic program."""
    both = F.concat(a, b)
    word = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda t: F.lpad(F.hex(F.array_position(both, t) + 0xFF), 4, "0")), "")), "UTF-16BE")
    plain = (F.size(both) <= CHARACTERS) & ~F.exists(both, lambda t: t.isNull())
    exact = _edits_by_rows(a, b)
    if most is not None:
        exact = F.when(F.abs(F.size(a) - F.size(b)) > most, -1).when(exact > most, -1).otherwise(exact)
    texts = [F.array_join(x.cast("array<string>"), "") for x in (a, b)]
    short = F.forall(both.cast("array<string>"), lambda t: F.char_length(t) == 1)
    return F.when(short, edit_distance(*texts, most)).when(plain, edit_distance(word(a), word(b), most)).otherwise(exact)


def _edits_by_rows(a: Column, b: Column) -> Column:
    start = F.transform(F.sequence(F.lit(0), F.size(b)), lambda x: x.cast("int"))

    def row(before: Column, x: Column) -> Column:
        first = F.array(F.element_at(before, 1) + 1)
        return F.aggregate(
            F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>")),
            first,
            lambda own, j: F.concat(own, F.array(F.least(F.element_at(before, j + 1) + 1, F.element_at(own, -1) + 1, F.element_at(before, j) + F.when(x == F.element_at(b, j), 0).otherwise(1)))),
        )

    return F.element_at(F.aggregate(a, start, row), -1)


METRICS: dict[str, Callable[..., Column]] = {"jaccard": jaccard, "bag_jaccard": bag_jaccard, "cosine_like": cosine_like, "euclidean_like": euclidean_like, "overlap": overlap}


def metric(name: str) -> Callable[..., Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]
