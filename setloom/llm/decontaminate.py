"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, verified by banded alignment.

Texts are compared as their folded words, joined by single spaces. A benchmark item is cut into windows of
``window`` characters every ``stride`` (its last one ends with it; a shorter item is one window). A window of m
characters has an edit budget of ``k = floor(rate * m)``. If it occurs in a document with at most k edits, then at least
``m - q + 1 - k * q`` of its q-grams occur there unchanged, on diagonals that differ by k at most; so of
bands of ``step + k`` diagonals, one every ``step``, some band holds that many. Bands that reach the bound are
aligned within their diagonals; a document leaks an item if some window's distance is within its budget.

A passage taken over without edits is sure to be found from ``window + stride - 1`` characters on, a whole item always.
q-grams that many windows share are looked up in steps of ``PLACES`` places, so memory does not grow with them.

Cases: a null or empty text leaks nothing; an item under ``min_chars`` folded characters, or null, is too short to tell
and leaks nowhere (``too_short`` lists them). Items without an id count as one item of null id. Each row of the documents is judged by itself, so repeated rows give repeated results.
Whole texts are searched, however long. Other columns are ignored; an empty benchmark finds nothing.

The benchmark is what is broadcast. It is taken in parts of at most ``part_bytes``, one pass over the documents
each, so that a larger benchmark takes more passes and no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import U, arrow_map, fold, powers, rows_of, slices, texts_of

Q, WINDOW, STRIDE, RATE, STEP, MIN_CHARS, PART_BYTES = 12, 100, 25, 0.06, 16, 32, 16_000_000
#: Places of shared q-grams that are looked at at once.
PLACES = 1 << 21
_BITS = 20


def normalised(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes with one space for each run of separators, offsets). A text neither starts nor, by what is
    compared, ends with a space."""
    b = fold(raw)
    if not len(b):
        return b, offs
    word = b != 0
    keep = word.copy()
    gap = ~word[1:] & word[:-1]
    keep[1:] |= gap
    at = offs[:-1]
    at = at[at < len(b)]
    keep[at] = word[at]
    total = np.concatenate(([0], np.cumsum(keep)))
    out = b[keep]
    out[out == 0] = 0x20
    return out, total[offs]


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q-gram at each position at which one fits."""
    n = len(text)
    if n < q:
        return np.zeros(0, U)
    up, down = powers(n)
    total = np.empty(n + 1, U)
    total[0] = U(0)
    np.cumsum((text.astype(U) + U(1)) * up, out=total[1:])
    return (total[q:] - total[:-q]) * down[: n - q + 1]


@dataclass
class Index:
    """A part of the benchmark: distinct q-grams and where the windows have them."""

    q: int
    step: int
    gram: np.ndarray
    first: np.ndarray
    window_of: np.ndarray
    place_of: np.ndarray
    items: list
    text: list
    length: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    seen: np.ndarray


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * U(0x9E3779B97F4A7C15)) >> U(64 - _BITS)).astype(np.int64)


def index(rows: list[tuple[object, str | None]], q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE, step: int = STEP, min_chars: int = MIN_CHARS) -> Index:
    items, text, h, w, p, budget = [], [], [], [], [], []
    for item, t in rows:
        raw, offs = texts_of(pa.array([t or ""], pa.string()))
        n, _ = normalised(raw, offs)
        n = n[:-1] if len(n) and n[-1] == 0x20 else n
        if len(n) < max(min_chars, q):
            continue
        for lo in sorted({*range(0, max(1, len(n) - window + 1), stride), max(0, len(n) - window)}):
            part = n[lo : lo + window]
            g = grams(part, q)
            k = int(rate * len(part))
            while k and len(part) - q + 1 - k * q < 1:
                k -= 1
            h.append(g), w.append(np.full(len(g), len(items))), p.append(np.arange(len(g)))
            items.append(item), text.append(part), budget.append(k)
    length = np.array([len(t) for t in text], np.int64)
    budget = np.array(budget, np.int64)
    h, w, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h, U), (w, np.int64), (p, np.int64)))
    order = np.argsort(h, kind="stable")
    gram, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[_slot(gram)] = True
    return Index(q, step, gram, np.append(first, len(h)), w[order], p[order], items, text, length, budget, length - q + 1 - budget * q, seen)


def align(ix: Index, text: np.ndarray, start: np.ndarray, end: np.ndarray, window: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Edit distance of each window to the closest part of its document, within ``width`` diagonals from ``low``."""
    n = len(window)
    best = np.full(n, 1 << 20)
    m = ix.length[window]
    longest = int(m.max())
    pattern = np.zeros((n, longest), np.uint8)
    for i, w in enumerate(window):
        pattern[i, : m[i]] = ix.text[w]
    d = np.arange(width)
    cost = np.zeros((n, width), np.int32)
    for i in range(longest):
        j = low[:, None] + d + i
        inside = (j >= start[:, None]) & (j < end[:, None])
        same = inside & (text[np.where(inside, j, 0)] == pattern[:, i, None])
        step = cost + ~same
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - d, axis=1) + d
        done = m == i + 1
        if done.any():
            best[done] = cost[done].min(axis=1)
    return best


def _counted(ix: Index, at: np.ndarray, to: np.ndarray, doc: np.ndarray, widest: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window, band) as one number, and how many q-grams they share, from hits in steps of PLACES places."""
    n = ix.first[to + 1] - ix.first[to]
    upto = np.cumsum(n)
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PLACES, "right")))
        k = n[lo:hi]
        post = np.repeat(ix.first[to[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        w = ix.window_of[post]
        diagonal = np.repeat(at[lo:hi], k) - ix.place_of[post] + widest
        band = diagonal // ix.step
        base = (np.repeat(doc[lo:hi], k) * len(ix.items) + w) * bands
        again = (diagonal % ix.step <= ix.budget[w]) & (band > 0)
        new, times = np.unique(np.concatenate((base + band, base[again] + band[again] - 1)), return_counts=True)
        if len(key):
            new, first = np.unique(np.concatenate((key, new)), return_inverse=True)
            times = np.bincount(first, weights=np.concatenate((count, times))).astype(np.int64)
        key, count = new, times
        lo = hi
        if lo < len(at) and doc[lo] != doc[lo - 1]:  # what is short of its bound in texts done with can go
            pair = key // bands
            kept = (count >= ix.bound[pair % len(ix.items)]) | (pair // len(ix.items) >= doc[lo])
            key, count = key[kept], count[kept]
    return key, count


def found(ix: Index, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, object, int, int]]:
    """(text, item, windows within their budget, least edits) of what the texts leak."""
    text, noff = normalised(raw, offs)
    g = grams(text, ix.q)
    at = np.flatnonzero(ix.seen[_slot(g)])
    if not len(at) or not len(ix.gram):
        return []
    h = g[at]
    to = np.searchsorted(ix.gram, h)
    to[to == len(ix.gram)] = 0
    hit = ix.gram[to] == h
    at, to = at[hit], to[hit]
    doc = np.searchsorted(noff, at, "right") - 1
    whole = at + ix.q <= noff[doc + 1]
    at, to, doc = at[whole], to[whole], doc[whole]
    widest = int(ix.length.max())
    bands = (len(text) + widest) // ix.step + 2
    key, count = _counted(ix, at, to, doc, widest, bands)
    pair = key // bands
    kept = count >= ix.bound[pair % len(ix.items)]
    if not kept.any():
        return []
    key, pair = key[kept], pair[kept]
    doc, w = pair // len(ix.items), pair % len(ix.items)
    low = (key % bands) * ix.step - widest
    most = int(ix.budget.max())
    out: dict[tuple[int, int], list] = {}
    for lo in range(0, len(key), 2048):
        s = slice(lo, lo + 2048)
        edits = align(ix, text, noff[doc[s]], noff[doc[s] + 1], w[s], low[s] - most, ix.step + 3 * most + 1)
        for x, y, e in zip(doc[s].tolist(), w[s].tolist(), edits.tolist()):
            if e <= ix.budget[y]:
                one = out.setdefault((x, y), [e])
                one[0] = min(one[0], e)
    items: dict[tuple[int, object], list] = {}
    for (x, y), (e,) in out.items():
        one = items.setdefault((x, ix.items[y]), [0, e])
        one[0] += 1
        one[1] = min(one[1], e)
    return [(x, item, n, e) for (x, item), (n, e) in sorted(items.items(), key=lambda v: (v[0][0], str(v[0][1])))]


def parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int, **parameters: object) -> list:
    """The benchmark's indexes as broadcasts, each of a part within part_bytes (on average)."""
    own = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total // part_bytes)
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(index([(r["item"], r["text"]) for r in (own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else own).collect()], **parameters)) for i in range(n)]


_LEAK = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int32()), ("edits", pa.int32())])


def _leaks(ix_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = ix_of.value
        for batch in batches:
            ids = batch.column(0)
            raw, offs = texts_of(batch.column(1))
            rows = []
            for lo, hi in slices(offs):
                rows += [(ids[lo + x].as_py(), item, n, e) for x, item, n, e in found(ix, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])]
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            yield rows_of(_LEAK, id=a, item_id=b, windows=c, edits=d)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, part_bytes: int = PART_BYTES, **parameters: object) -> DataFrame:
    """(id_col, item_id, windows, edits) for each document and item that it leaks: how many windows, the least edits."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ix in parts(benchmark, item_col, item_text_col, part_bytes, **parameters):
        one = arrow_map(own, _leaks(ix), "id long, item_id long, windows int, edits int")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def _clean(ix_of, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = ix_of.value
        for batch in batches:
            raw, offs = texts_of(batch.column(place))
            keep = np.ones(batch.num_rows, bool)
            for lo, hi in slices(offs):
                for x, *_ in found(ix, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
                    keep[lo + x] = False
            yield batch.filter(pa.array(keep))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, part_bytes: int = PART_BYTES, **parameters: object) -> DataFrame:
    """The rows of docs, with all columns, that leak no item. No shuffle."""
    for ix in parts(benchmark, item_col, item_text_col, part_bytes, **parameters):
        docs = arrow_map(docs, _clean(ix, docs.columns.index(text_col)), docs.schema)
    return docs


def too_short(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(item_col, chars) of the items that are too short to tell, in folded characters; null texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded, offs = normalised(*texts_of(batch.column(1)))
            size = np.diff(offs)
            size -= (size > 0) & (folded[np.maximum(offs[1:] - 1, 0)] == 0x20) if len(folded) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int64))], names=["item", "chars"])

    own = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(own, run, "item long, chars long").where(F.col("chars") < max(min_chars, Q)).withColumnRenamed("item", item_col)
