"""Language identification by hyperdimensional profiles.

Each symbol (26 letters, the gap between words, and 37 classes of other letters) has a random vector of +1 and -1.
An n-gram's vector binds its letters' vectors, each permuted (rotated) once more than the next: for n = 3
``rot(rot(a)) * rot(b) * c``. A text's vector bundles (adds) those of all its n-grams; a language's prototype
bundles the texts that carry its label, all of them. A text gets the language of the largest cosine.

Bundling is linear, so a task counts n-grams and multiplies counts by the n-grams' vectors, ``GRAMS`` at a time and for so few texts at
once that no table of counts has more than ``CELLS`` numbers. A task sends one vector a language, of whole numbers, so
that prototypes do not depend on the order of adding; the driver holds the prototypes.

Cases: a null, empty or letterless text gets a null language and score. Rows without a language label add to
no prototype; without any labelled text every language is null. Ties go to the language first in
order. Rows are judged one by one (repeated rows repeat), texts are taken whole, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import add_vectors, arrow_map, rows_of, slices, texts_of

DIMENSIONS, SEED, SYMBOLS = 1024, 7, 64
_N_GRAMS = SYMBOLS**3
#: Numbers in a table of counts, n-grams whose vectors are made at once, and languages whose counts a task holds.
CELLS, GRAMS, HELD = 1 << 22, 8192, 16


def _symbols() -> np.ndarray:
    t = np.zeros(0x10000, np.int64)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            t[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 0x9E3779B1 % (1 << 32) >> 16) % 37
    return t


_cache: dict[object, np.ndarray] = {}


def symbol_table() -> np.ndarray:
    if "symbols" not in _cache:
        _cache["symbols"] = _symbols()
    return _cache["symbols"]


def letter_vectors(dimensions: int, seed: int) -> np.ndarray:
    key = (dimensions, seed)
    if key not in _cache:
        _cache[key] = np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.float32), (SYMBOLS, dimensions))
    return _cache[key]


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The bound vector of each n-gram id."""
    v = letter_vectors(dimensions, seed)
    a, b, c = grams // (SYMBOLS * SYMBOLS), grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def gram_ids(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ids in order, offsets by text), with each text between gaps and runs of other characters as one gap."""
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offs]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    table = symbol_table()
    s = np.where(points < 0x10000, table[np.minimum(points, 0xFFFF)], 27)
    n_texts = len(offs) - 1
    length = np.diff(starts)
    owner = np.repeat(np.arange(n_texts), length)
    letter = s != 0
    keep = letter.copy()
    if len(s):
        keep[:-1] |= letter[1:] & (owner[1:] == owner[:-1])  # the gap before a word
    first = starts[:-1][length > 0]
    lead = np.zeros(n_texts, np.int64)
    lead[length > 0] = letter[first]
    trail = np.zeros(n_texts, np.int64)
    any_letter = np.bincount(owner[letter], minlength=n_texts) > 0
    trail[any_letter] = 1
    kept_owner = owner[keep]
    size = np.bincount(kept_owner, minlength=n_texts) + lead + trail
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if n_texts else 0, np.int64)
    begin = ends - size
    own_start = np.concatenate(([0], np.cumsum(np.bincount(kept_owner, minlength=n_texts))))[:-1]
    out[(begin + lead - own_start)[kept_owner] + np.arange(len(kept_owner))] = s[keep]
    if len(out) < 3:
        return np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
    g = out[:-2] * (SYMBOLS * SYMBOLS) + out[1:-1] * SYMBOLS + out[2:]
    valid = np.ones(len(out), bool)
    for back in (1, 2):
        at = ends[size >= back] - back
        valid[at] = False
    number = np.maximum(size - 2, 0)
    return g[valid[:-2]], np.concatenate(([0], np.cumsum(number)))


_SUMS = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("vector", pa.binary())])


def bundled(grams: np.ndarray, counts: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Sums of the n-grams' vectors by their counts (a row each, or one), ``GRAMS`` n-grams at a time."""
    out = np.zeros((*counts.shape[:-1], dimensions), counts.dtype)
    for lo in range(0, len(grams), GRAMS):
        out += counts[..., lo : lo + GRAMS] @ gram_vectors(grams[lo : lo + GRAMS], dimensions, seed)
    return out


def _bundle(dimensions: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            vectors = []
            for counts in total.values():
                at = np.flatnonzero(counts)
                vectors.append(np.rint(bundled(at, counts[at].astype(np.float64), dimensions, seed)).astype(np.int64).tobytes())
            return rows_of(_SUMS, piece=list(total), n=[1] * len(total), vector=vectors)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            raw, offs = texts_of(batch.column(1))
            for lo, hi in slices(offs):
                g, goff = gram_ids(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                names, code = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                label = np.repeat(code, np.diff(goff))
                for i, name in enumerate(names.tolist()):
                    if name not in total:
                        if len(total) >= HELD:
                            yield sent()
                            total.clear()
                        total[name] = np.zeros(_N_GRAMS, np.int64)
                    total[name] += np.bincount(g[label == i], minlength=_N_GRAMS)
        if total:
            yield sent()

    return run


def prototypes(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes of length 1)."""
    own = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sums = add_vectors(arrow_map(own, _bundle(dimensions, seed), "piece string, n long, vector binary"), "int64", own.rdd.getNumPartitions())
    langs = sorted(lang for lang, (_, v) in sums.items() if v.any())
    out = np.array([sums[lang][1] for lang in langs], float).reshape(-1, dimensions)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def cosines(raw: np.ndarray, offs: np.ndarray, protos: np.ndarray, seed: int) -> np.ndarray:
    """The cosine of each text with each prototype; NaN for a text without an n-gram."""
    g, goff = gram_ids(raw, offs)
    out = np.full((len(offs) - 1, len(protos)), np.nan)
    if len(g) and len(protos):
        _cosines(g, goff, 0, len(out), protos, seed, out)
    return out


def _cosines(g: np.ndarray, goff: np.ndarray, lo: int, hi: int, protos: np.ndarray, seed: int, out: np.ndarray) -> None:
    """Fills rows lo to hi, in halves until their table of counts is small enough."""
    own = g[goff[lo] : goff[hi]]
    present = np.zeros(_N_GRAMS, bool)
    present[own] = True
    ids = np.flatnonzero(present)
    if hi - lo > 1 and (hi - lo) * len(ids) > CELLS:
        mid = (lo + hi) // 2
        _cosines(g, goff, lo, mid, protos, seed, out)
        _cosines(g, goff, mid, hi, protos, seed, out)
        return
    place = np.zeros(_N_GRAMS, np.int64)
    place[ids] = np.arange(len(ids))
    size = np.diff(goff[lo : hi + 1])
    row = np.repeat(np.arange(hi - lo), size)
    counts = np.bincount(row * len(ids) + place[own], minlength=(hi - lo) * len(ids)).reshape(hi - lo, len(ids)).astype(np.float32)
    v = bundled(ids, counts, protos.shape[1], seed)
    length = np.linalg.norm(v, axis=1)
    some = (size > 0) & (length > 0)
    out[lo:hi][some] = (v[some] @ protos.T.astype(np.float32)) / length[some, None]


_LANG = pa.schema([("id", pa.int64()), ("language", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])


def _identify(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, protos, seed = model_of.value
        for batch in batches:
            raw, offs = texts_of(batch.column(1))
            names, scores, margins = [], [], []
            for lo, hi in slices(offs):
                c = cosines(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], protos, seed)
                for row in c:
                    if not len(langs) or np.isnan(row[0]):
                        names.append(None), scores.append(None), margins.append(None)
                        continue
                    best = int(row.argmax())
                    others = np.delete(row, best)
                    names.append(langs[best]), scores.append(round(float(row[best]), 4))
                    margins.append(round(float(row[best] - others.max()), 4) if len(others) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], schema=_LANG)

    return run


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(id_col, language, score, margin over the next language) for each row of docs. No shuffle."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model_of = docs.sparkSession.sparkContext.broadcast((*model, seed))
    return arrow_map(own, _identify(model_of), "id long, language string, score double, margin double").withColumnRenamed("id", id_col)
