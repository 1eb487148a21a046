"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Positives are documents labelled of good quality; every other document is unlabelled web text, whatever labels it
may have. With a class prior p the risk of a scorer g is
``p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])`` with the logistic loss l; where the second part
is negative, a step goes against its gradient instead. g is a network of one hidden layer over form features of
a text: shares of kinds of characters, word lengths, repetition of words and lines.

The prior is estimated by the mixture-proportion bound: the least ratio of the unlabelled to the positive share above
a cut of a first scorer (positives against unlabelled), over cuts that leave three tenths of the positives; the scorer learns from rows of
even hash, the shares are those of all rows of odd hash.

Features of all rows are written once (80 bytes a row). Their means and deviations, the prior's shares, the gradients of the last
``polish`` steps and the quantile of the positives' scores cover all rows; only the steps before start from at most
``max_positives`` and ``max_unlabelled`` rows, those of least hash. Scoring covers all rows.
A document is rejected if it scores ``margin`` below the smaller of 0 and the ``max_loss`` quantile of the positives.

Toxic texts, if ``toxic_col`` names their label, are told by words; of good form they stay positives of the form scorer, whose
score the words overrule. Labelled documents (at most ``max_labelled``, those of least id hash), whole, are counted by word; a word counts as a sign if its share of toxic documents is above theirs by a
likelihood-ratio test, corrected for the number of words. A document is rejected too if the odds of toxic, by naive Bayes over its
signs, are above 1; its score is then lowered below the cut. The sample's labels are broadcast (9 bytes each), never the texts moved.

Cases: a null, empty or wordless text has a null score and is rejected. Rows without an id are not learnt from. Without any positive, or with no unlabelled
text, nothing can be learnt and every text with a word is kept at score 0. Rows are judged one by one;
repeated rows repeat. Whole texts count, however long. Other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import add_vectors, arrow_map, cut, fold, rows_of, slices, texts_of, word_hashes, word_spans

#: What the test of a sign must pass besides twice the log of the number of words: 10 is the 0.0016 quantile of chi-square.
SIGN = 10.0
MAX_POSITIVES, MAX_UNLABELLED, MAX_LABELLED, MAX_LOSS, MARGIN, HIDDEN, STEPS, POLISH, SEED = 8000, 16000, 200_000, 0.001, 1.5, 16, 1500, 8, 11

_KINDS = ["small", "capital", "digit", "blank", "line", "stop", "mark", "sign", "other"]


def _kind_table() -> np.ndarray:
    t = np.full(256, 8, np.int64)
    for c in range(128):
        x = chr(c)
        t[c] = 0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 4 if x == "\n" else 3 if x.isspace() else 5 if x in ".,;:?'\"()-" else 6 if x == "!" else 7
    return t


_KIND = _kind_table()
N_FEATURES = 20


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(form features, words) of each text."""
    return _features(raw, offs)[:2]


def _features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(form features, words of each text; hash and text of each different word of a text)."""
    n = len(offs) - 1
    size = np.diff(offs)
    kind = np.bincount(np.repeat(np.arange(n) * 9, size) + _KIND[raw], minlength=9 * n).reshape(n, 9)
    b = fold(raw)
    starts, ends, woff = word_spans(b, offs)
    h = word_hashes(b, starts, ends)
    words = np.diff(woff)
    owner = np.repeat(np.arange(n), words)
    count = np.maximum(words, 1)
    length = ends - starts
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((h, owner))
    s, o = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    caps = (_KIND[raw[starts]] == 1) if len(starts) else np.zeros(0, bool)
    second = np.minimum(starts + 1, max(len(raw) - 1, 0))
    loud = caps & (_KIND[raw[second]] == 1) & (length > 1) if len(starts) else caps
    glued = (_KIND[raw[np.minimum(ends, len(raw) - 1)]] >= 6) & (_KIND[raw[np.minimum(ends, len(raw) - 1)]] != 8) & (ends < len(raw)) if len(starts) else caps
    share = kind / np.maximum(size, 1)[:, None]
    per = lambda x: np.bincount(owner, weights=x, minlength=n) / count
    out = np.column_stack([
        share,
        per(length.astype(float)) / 10,
        np.sqrt(np.maximum(per(length.astype(float) ** 2) - per(length.astype(float)) ** 2, 0)) / 10,
        per(again), np.bincount(o[new], minlength=n) / count, top / count,
        per(caps), per(loud), per(glued),
        np.sqrt(share[:, 6]), np.sqrt(share[:, 7]), np.log1p(words) / 10,
    ])
    return out.astype(np.float32), words, s[new], o[new]


def _forward(w: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, h @ w[2] + w[3]


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, hidden: int, seed: int) -> tuple:
    """Weights by Adam; prior None: positives against unlabelled, the first scorer."""
    g = np.random.Generator(np.random.PCG64(seed))
    w = [g.normal(0, 0.3, (pos.shape[1], hidden)), np.zeros(hidden), g.normal(0, 0.3, hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        p, u = pos[g.integers(0, len(pos), 512)], unl[g.integers(0, len(unl), 1024)]
        x = np.concatenate((p, u))
        h, z = _forward(w, x)
        zp, zu = z[:512], z[512:]
        if prior is None:
            d = np.concatenate((-sig(-zp) / 512, sig(zu) / 1024))
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            d_neg = np.concatenate((-prior * sig(zp) / 512, sig(zu) / 1024))
            d = np.concatenate((-prior * sig(-zp) / 512, np.zeros(1024))) + d_neg if negative >= 0 else -d_neg
        dh = d[:, None] * w[2] * (1 - h * h)
        grad = [x.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum()]
        for i in range(4):
            m[i] = 0.9 * m[i] + 0.1 * grad[i]
            v[i] = 0.999 * v[i] + 0.001 * grad[i] ** 2
            w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def prior_bound(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in the unlabelled rows, at most; from histograms of a first scorer's scores."""
    if not pos.sum() or not unl.sum():
        return 0.5
    above_p, above_u = (np.cumsum(h[::-1])[::-1] / h.sum() for h in (pos, unl))
    some = above_p >= 0.3
    return float(np.clip((above_u[some] / above_p[some]).min(initial=1.0), 0.05, 0.99))


#: Scores are counted in bins of 1/256 from -40 to 40.
_BINS, _LOW, _STEP = 80 * 256, -40.0, 1 / 256


def _bins(z: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip((z - _LOW) / _STEP, 0, _BINS - 1).astype(np.int64), minlength=_BINS)


def _flat(w: tuple) -> np.ndarray:
    return np.concatenate([np.ravel(a) for a in w])


def _shaped(v: np.ndarray, like: tuple) -> tuple:
    ends = np.cumsum([np.size(a) for a in like])
    return tuple(v[e - np.size(a) : e].reshape(np.shape(a)) for e, a in zip(ends, like))


def _slopes(w: tuple, x: np.ndarray, d: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The gradient of sum(d * score) by all weights, as one row."""
    dh = d[:, None] * w[2] * (1 - h * h)
    return _flat((x.T @ dh, dh.sum(0), h.T @ d, d.sum()))


def risk_parts(w: tuple, x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Sums over rows: losses l(g), l(-g) of positives and l(-g) of the others, then the gradients of the three."""
    out = []
    h, z = _forward(w, x)
    sig = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for rows, sign in ((good, 1), (good, -1), (~good, -1)):
        d = (sig - 1) if sign > 0 else sig
        out.append((np.logaddexp(0, -sign * z[rows]).sum(), _slopes(w, x[rows], d[rows], h[rows])))
    return np.concatenate([[o[0] for o in out], *[o[1] for o in out]])


def polished(w: tuple, sums, prior: float, n_pos: int, n_unl: int, steps: int) -> tuple:
    """w after steps of Adam on the non-negative risk; sums(w) gives risk_parts over all rows."""
    v = _flat(w)
    m, s = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, steps + 1):
        total = sums(_shaped(v, w))
        loss, grads = total[:3], total[3:].reshape(3, -1)
        negative = loss[2] / n_unl - prior * loss[1] / n_pos
        d = grads[2] / n_unl - prior * grads[1] / n_pos
        g = prior * grads[0] / n_pos + d if negative >= 0 else -d
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        v = v - 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return _shaped(v, w)


def standard(x: np.ndarray, model: dict) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8)


def scores(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None or "w" not in model:
        return np.zeros(len(x))
    return _forward(model["w"], standard(x, model))[1]


_COUNT = pa.schema([("hash", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, t, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(t[order], first), np.add.reduceat(c[order], first)


def _count(labelled_of):
    """Toxic and clean documents by word, of a task's labelled rows; hash 0 has all that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = labelled_of.value
        parts: list = []
        held = 0
        for batch in batches:
            own = batch.column(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            mine = ids[at] == own
            flags = toxic[at[mine]]
            raw, offs = texts_of(batch.filter(pa.array(mine)).column(1))
            for lo, hi in slices(offs):
                words, h, owner = _features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])[1:]
                if not len(h):
                    continue
                some = flags[lo:hi][words > 0]
                t = np.append(flags[lo:hi][owner], some).astype(np.int64)
                parts.append(_merge([(np.append(h.view(np.int64), np.zeros(len(some), np.int64)), t, 1 - t)]))
                held += len(parts[-1][0])
                if held > 1_500_000:
                    parts = [_merge(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield rows_of(_COUNT, **dict(zip(("hash", "toxic", "clean"), parts[0])))
                        parts, held = [], 0
        if parts:
            yield rows_of(_COUNT, **dict(zip(("hash", "toxic", "clean"), _merge(parts))))

    return run


def toxic_signs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict | None:
    """The signs of toxic documents: sorted hashes, the log-odds each adds, the log-odds before any; None if there are none."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    flags = labels.select(F.col(id_col).cast("long").alias("id"), (F.col(toxic_col) == 1).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    said = flags.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_labelled).toArrow()
    ids, toxic = said.column("id").to_numpy(), said.column("toxic").to_numpy()
    if not toxic.any() or toxic.all():
        return None
    order = np.argsort(ids)
    labelled_of = docs.sparkSession.sparkContext.broadcast((ids[order], toxic[order].astype(np.int8)))
    counts = arrow_map(own, _count(labelled_of), "hash long, toxic long, clean long").groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts.where("toxic > 0 or hash = 0"))
    all_of = counts.where("hash = 0").first()
    if all_of is None or not all_of["toxic"] or not all_of["clean"]:
        return None
    n_toxic, n_clean = all_of["toxic"], all_of["clean"]
    share, t, c = n_toxic / (n_toxic + n_clean), F.col("toxic"), F.col("clean")
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((t + c) * p))).otherwise(0.0)
    passes = 2 * (part(t, share) + part(c, 1 - share)) > 2 * float(np.log(counts.count())) + SIGN
    signs = counts.where("hash <> 0").where((t / (t + c) > share) & passes).toArrow()
    if not signs.num_rows:
        return None
    h, t, c = (signs.column(k).to_numpy() for k in ("hash", "toxic", "clean"))
    order = np.argsort(h)
    gain = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    return {"hash": h[order], "gain": gain[order], "before": float(np.log(n_toxic / n_clean))}


def _toxic_odds(signs: dict, h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of toxic of each of n texts, from the different words of each."""
    h = h.view(np.int64)
    at = np.minimum(np.searchsorted(signs["hash"], h), len(signs["hash"]) - 1)
    found = signs["hash"][at] == h
    return signs["before"] + np.bincount(owner[found], weights=signs["gain"][at[found]], minlength=n)


_ROW = pa.schema([("id", pa.int64()), ("x", pa.binary())])
_SUM = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("vector", pa.binary())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offs = texts_of(batch.column(1))
        for lo, hi in slices(offs):
            x, words = features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            at = np.flatnonzero(words)
            yield rows_of(_ROW, id=batch.column(0).slice(lo, hi - lo).take(pa.array(at)).to_pylist(), x=[x[i].tobytes() for i in at])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _added(feats: DataFrame, f, pieces: int) -> list[np.ndarray]:
    """Sums over all rows of f(features, positive), ``pieces`` rows of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = f(_matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False).astype(bool))
                total = one if total is None else [a + b for a, b in zip(total, one)]
        if total is not None:
            yield rows_of(_SUM, piece=range(pieces), n=[1] * pieces, vector=[np.asarray(t, np.float64).tobytes() for t in total])

    sums = add_vectors(arrow_map(feats.select("good", "x"), run, "piece int, n long, vector binary"), "float64", feats.rdd.getNumPartitions())
    return [sums[i][1] for i in range(pieces)] if sums else []


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str | None = None, *, max_labelled: int = MAX_LABELLED, **parameters: object) -> dict | None:
    """The model, or None if there is nothing to learn from. toxic_col: also learns the signs of toxic documents."""
    signs = toxic_signs(docs, labels, id_col, text_col, toxic_col, max_labelled) if toxic_col else None
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    rows = arrow_map(own, _extract, "id long, x binary").join(good.withColumn("good", F.lit(True)), "id", "left")
    model = fit(rows.select("id", F.coalesce("good", F.lit(False)).alias("good"), "x"), **parameters)
    if signs:
        model = (model or {"cut": 0.0}) | {"toxic": signs}
    return model


def fit(rows: DataFrame, *, prior: float | None = None, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, max_loss: float = MAX_LOSS, margin: float = MARGIN, steps: int = STEPS, polish: int = POLISH, hidden: int = HIDDEN, seed: int = SEED) -> dict | None:
    """The form scorer of rows (id, good, x), or None if there is nothing to learn from."""
    feats = cut(rows.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))))
    counted = _added(feats, lambda x, good: [np.concatenate(([good.sum(), (~good).sum()], x.sum(0), (x * x).sum(0)))], 1)
    if not counted or not counted[0][:2].all():
        return None
    n_pos, n_unl = (int(v) for v in counted[0][:2])
    n = n_pos + n_unl
    mean = counted[0][2 : 2 + N_FEATURES] / n
    model = {"mean": mean, "scale": np.sqrt(np.maximum(counted[0][2 + N_FEATURES :] / n - mean * mean, 0)) + 1e-3}

    def sample(of: DataFrame, most: int) -> np.ndarray:
        table = of.orderBy(F.xxhash64("id", "x"), "id", "x").limit(most).select("x").toArrow()
        x = standard(_matrix(table.column("x")), model)
        return x[np.random.Generator(np.random.PCG64(SEED)).permutation(len(x))]

    def bins(w: tuple, of: DataFrame) -> list[np.ndarray]:
        found = _added(of, lambda x, good: [_bins(_forward(w, standard(x[g], model))[1]) for g in (good, ~good)], 2)
        return found or [np.zeros(_BINS)] * 2

    pos, unl = sample(feats.where("good"), max_positives), sample(feats.where("not good"), max_unlabelled)
    if prior is None:
        even = feats.where("half = 0")
        first = [sample(even.where(c), m) for c, m in (("good", max_positives // 2), ("not good", max_unlabelled // 2))]
        if len(first[0]) and len(first[1]):
            prior = prior_bound(*bins(_fit(*first, None, steps, hidden, seed), feats.where("half = 1")))
        else:
            prior = prior_bound(*bins(_fit(pos, unl, None, steps, hidden, seed), feats))
    w = _fit(pos, unl, prior, steps, hidden, seed + 1)
    w = polished(w, lambda at: _added(feats, lambda x, good: [risk_parts(at, standard(x, model), good)], 1)[0], prior, n_pos, n_unl, polish)
    below = np.cumsum(bins(w, feats)[0])
    low = _LOW + _STEP * int(np.searchsorted(below, max(max_loss * n_pos, 1e-9)))
    return model | {"w": w, "cut": min(0.0, low) - margin, "prior": prior}


def _judge(raw: np.ndarray, offs: np.ndarray, model: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, keep, has words)"""
    n = len(offs) - 1
    score, some = np.zeros(n), np.zeros(n, bool)
    for lo, hi in slices(offs):
        x, words, h, owner = _features(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        score[lo:hi] = scores(model, x)
        some[lo:hi] = words > 0
        if model and "toxic" in model:
            odds = _toxic_odds(model["toxic"], h, owner, hi - lo)
            score[lo:hi] = np.where(odds > 0, np.minimum(score[lo:hi], model["cut"] - odds), score[lo:hi])
    return score, some & (score >= (model["cut"] if model else 0.0)), some


_SCORE = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_())])


def score_quality(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, keep) for each row of docs. No shuffle."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, keep, some = _judge(*texts_of(batch.column(1)), model_of.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 6), mask=~some), pa.array(keep)], schema=_SCORE)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(own, run, "id long, score double, keep boolean").withColumnRenamed("id", id_col)


def drop_rejected(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that the model keeps. No shuffle."""
    model_of, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(*texts_of(batch.column(place)), model_of.value)[1]))

    return arrow_map(docs, run, docs.schema)
