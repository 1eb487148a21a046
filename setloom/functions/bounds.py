"""Bounds of the Jaccard similarity, as column expressions. Products are rounded after a guard of 1e-9, so that one that
lands just above an integer does not shorten a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-9


def ceil_guarded(x: Column) -> Column:
    return F.ceil(x - F.lit(GUARD)).cast("int")


def floor_guarded(x: Column) -> Column:
    return F.floor(x + F.lit(GUARD)).cast("int")


def prefix_length(n: Column, t: float) -> Column:
    """How many first tokens of a set of size n meet those of any set that is similar enough; 0 for no tokens."""
    return F.when(n > 0, n - ceil_guarded(n * t) + 1).otherwise(0)


def index_prefix_length(n: Column, t: float) -> Column:
    """The same if only sets that are no shorter probe."""
    return F.when(n > 0, n - ceil_guarded(n * (2 * t / (1 + t))) + 1).otherwise(0)


def min_overlap(a: Column, b: Column, t: float) -> Column:
    return ceil_guarded((a + b) * (t / (1 + t)))


def min_length(n: Column, t: float) -> Column:
    return ceil_guarded(n * t)


def max_length(n: Column, t: float) -> Column:
    return floor_guarded(n / t)


def length_filter(a: Column, b: Column, t: float) -> Column:
    return (a >= min_length(b, t)) & (b >= min_length(a, t))


def max_overlap(a: Column, i: Column, b: Column, j: Column) -> Column:
    """The most that sets of sizes a and b share if they share the tokens at positions i and j (from 0)."""
    return F.least(i, j) + 1 + F.least(a - i - 1, b - j - 1)


def position_filter(a: Column, i: Column, b: Column, j: Column, t: float) -> Column:
    return max_overlap(a, i, b, j) >= min_overlap(a, b, t)


def fragment_bound(before_a: Column, before_b: Column, shared: Column, after_a: Column, after_b: Column) -> Column:
    """The most that two sets share, from what one fragment shares and the tokens before and after it."""
    return F.least(before_a, before_b) + shared + F.least(after_a, after_b)


def most_differences(n: Column, t: float) -> Column:
    """The most tokens that are in one only of a set of size n and a similar one."""
    return floor_guarded(n * ((1 - t) / t))


def histogram_difference(a: Column, b: Column) -> Column:
    """The sum of differences of two histograms of tokens by group: sets differ in so many tokens at least."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)


def suffix_bound(a: Column, b: Column, depth: int = 2) -> Column:
    """The least number of tokens that are in one only of two sorted arrays of comparable tokens, by halving: b's middle token
    cuts both arrays, and what is left and right of it can only match on its own side."""
    if depth == 0:
        return F.abs(F.size(a) - F.size(b))
    middle = F.get(b, F.floor(F.size(b) / 2).cast("int"))
    left, right = (lambda x: F.filter(x, lambda t: t < middle)), (lambda x: F.filter(x, lambda t: t > middle))
    there = F.when(F.array_contains(a, middle), 0).otherwise(1)
    whole = suffix_bound(left(a), left(b), depth - 1) + there + suffix_bound(right(a), right(b), depth - 1)
    return F.when(F.size(b) == 0, F.size(a)).otherwise(whole)


def suffix_filter(a: Column, b: Column, t: float, depth: int = 2) -> Column:
    """Whether sorted sets may still be similar enough by ``suffix_bound``."""
    n, m = F.size(a), F.size(b)
    return suffix_bound(a, b, depth) <= n + m - 2 * min_overlap(n, m, t)
