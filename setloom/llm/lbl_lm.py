"""Language-model scoring by a log-bilinear model, trained by noise-contrastive estimation.

Every word of the corpus is in the vocabulary. P(word) is P(class) by the model times P(word | class) by the full counts.
The ``HEADS`` most frequent words are classes of their own; every other word falls in one of ``SPELLINGS`` classes by its last two
bytes. Of a class of N tokens and D words, a word seen n times has (n - d) / N, and the d * D / N so left are shared evenly by as
many unseen words and one more; d is Ney's estimate from the words seen once and twice. All words seen and those
unseen ones add up to 1 in each context.

Model. With context words u (last) and v (the one before), the score of a class c is ``(E[u] C1 + E[v] C2) . R[c] + b[c]``.
E[u] is the vector of u's spelling plus, for the ``words`` most frequent words (as many as are as frequent as the last of
them), one of its own. Training tells a class from noise classes drawn by frequency (noise-contrastive estimation), in numpy.

Rounds. Texts are dealt by the hash of id and text to ``rounds * shards`` parts, shards of about ``shard_tokens`` words, and
shuffled there as numbers of two bytes a word. In each round every shard of it trains on its own texts, from the same
start and in the order of the hash; parameters are averaged, rows of vectors by how often each was met, and the average is where the
next round starts. The whole corpus is trained on once, and the result depends on the texts, not on how the input is
partitioned (but for the rounding of sums). What a shard sends is the size of the model.

Scoring. Matrix products turn the model into tables of ``exp(E C1 R' + b)`` and ``exp(E C2 R')``, by symbol and class, so the exact
normaliser of a context is a product of two rows. The shares of the ``known`` most frequent words are broadcast; those of
rarer words are joined on by hash, which shuffles these words alone, and a corpus of no more words is scored without.

Cases: a null, empty or wordless text has 0 tokens, a log-probability of 0 and a null perplexity. An empty corpus
gives no rows. Rows are scored one by one (repeated rows repeat) and whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import U, add_vectors, arrow_map, cut, fold, mix, rows_of, slices, texts_of, word_hashes, word_spans

WORDS, HEADS, SPELLINGS, KNOWN = 32768, 64, 192, 1 << 18
CLASSES = HEADS + SPELLINGS
DIM, NOISE, BATCH, RATE, ROUNDS, SHARD_TOKENS, SEED = 32, 64, 2048, 0.05, 4, 4_000_000, 3


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, spelling, offsets by text) of the words."""
    b = fold(raw)
    starts, ends, woff = word_spans(b, offs)
    h = word_hashes(b, starts, ends)
    last = b[ends - 1].astype(U) << U(8) | np.where(ends - starts > 1, b[ends - 2], 0).astype(U) if len(h) else h
    return h, ((mix(last + U(1)) >> U(40)) % U(SPELLINGS)).astype(np.int64), woff


_COUNT = pa.schema([("hash", pa.int64()), ("cls", pa.int32()), ("n", pa.int64())])


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, c, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(h, kind="stable")
    h, c, n = h[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], c[first], np.add.reduceat(n, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts, added up; sent on when many."""
    parts: list = []
    held = 0
    for batch in batches:
        raw, offs = texts_of(batch.column(0))
        for lo, hi in slices(offs):
            h, c, _ = _words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            if not len(h):
                continue
            parts.append(_merge([(h, c, np.ones(len(h), np.int64))]))
            held += len(parts[-1][0])
            if held > 1_500_000:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > 1_000_000:
                    yield rows_of(_COUNT, hash=parts[0][0].view(np.int64), cls=parts[0][1], n=parts[0][2])
                    parts, held = [], 0
    if parts:
        h, c, n = _merge(parts)
        yield rows_of(_COUNT, hash=h.view(np.int64), cls=c, n=n)


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, cls, n) of each word of all texts."""
    return cut(arrow_map(texts, _count, "hash long, cls int, n long").groupBy("hash", "cls").agg(F.sum("n").alias("n")))


class Vocabulary:
    """The words with vectors of their own: sorted hashes, the symbol (rank) of each, spelling and class by symbol, counts by class."""

    def __init__(self, h: np.ndarray, spelling: np.ndarray, by_class: np.ndarray) -> None:
        order = np.argsort(h)
        self.hashes, self.numbers, self.size = h[order], order, len(h)
        self.spelling = np.concatenate((spelling, np.arange(SPELLINGS + 1)))  # the last symbol stands before a text
        self.cls = np.concatenate((np.where(np.arange(len(h)) < HEADS, np.arange(len(h)), HEADS + spelling), HEADS + np.arange(SPELLINGS)))
        self.counts = by_class

    @property
    def start(self) -> int:
        return self.size + SPELLINGS


class Shares:
    """log P(word | class): of known words by sorted hash, of an unseen word by class; log(1 / N) by class; the discount."""

    def __init__(self, hashes: np.ndarray, share: np.ndarray, unseen: np.ndarray, inverse: np.ndarray, discount: float) -> None:
        self.hashes, self.share, self.unseen, self.inverse, self.discount = hashes, share, unseen, inverse, discount


def _least(tally: list[tuple[int, int]], most: int) -> int:
    """The least count such that at most ``most`` words are as frequent; tally: (least count, words) of ranges of counts."""
    least, total = 1 << 62, 0
    for n, k in sorted(tally, reverse=True):
        total += k
        if total > most:
            break
        least = n
    return least


def choose(counts: DataFrame, words: int = WORDS, known: int = KNOWN) -> tuple[Vocabulary, Shares, DataFrame | None]:
    """(vocabulary, shares, counts of the words whose shares are in neither, or None if there are none).

    At most ``known`` rows of counts come to the driver, and one for each range of counts, of which there are some hundred.
    """
    if not HEADS <= words <= 60_000:
        raise ValueError(f"words must be from {HEADS} to 60000")
    # Ranges of a sixteenth of an octave; up to 64, each count by itself.
    size_of = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 16) + 64)
    ranges = counts.groupBy(size_of.alias("range")).agg(F.min("n").alias("n"), F.count("*").alias("k")).collect()
    tally = [(r["n"], r["k"]) for r in ranges]
    seen = dict(tally)
    n1, n2 = seen.get(1, 0), seen.get(2, 0)
    discount = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
    least = _least(tally, max(known, words))
    some = counts.where(F.col("n") >= least).toArrow()
    h, c, n = (some.column(x).to_numpy() for x in ("hash", "cls", "n"))
    h = h.view(U)
    order = np.lexsort((h, -n))
    h, c, n = h[order], c[order].astype(np.int64), n[order]

    size, kinds = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        size[r["cls"]], kinds[r["cls"]] = r["n"], r["words"]
    np.subtract.at(size, c[:HEADS], n[:HEADS])
    np.subtract.at(kinds, c[:HEADS], 1)
    heads = np.zeros(HEADS)
    heads[: min(HEADS, len(n))] = n[:HEADS]
    own = (n >= _least(tally, words)) | (np.arange(len(n)) < HEADS)
    vocab = Vocabulary(h[own], c[own], np.concatenate((heads, size)))

    inverse = -np.log(np.maximum(size, 1))
    unseen = np.where(size > 0, np.log(np.maximum(discount * kinds, 1e-9) / (kinds + 1)) + inverse, 0.0)
    share = np.log(n - discount) + inverse[c]
    share[:HEADS] = 0.0
    by = np.argsort(h)
    if known < len(h):  # no more words are broadcast than asked for; the vocabulary's may be more
        fit = n >= _least(tally, known)
        fit[:HEADS] = True
        by = by[fit[by]]
        least = _least(tally, known)
    rest = counts.where(F.col("n") < least) if kinds.sum() + min(HEADS, len(n)) > len(by) else None
    if rest is not None and len(n) and least > n[:HEADS].min():
        rest = rest.where(~F.col("hash").isin(h[:HEADS].view(np.int64).tolist()))
    return vocab, Shares(h[by], share[by], unseen, inverse, discount), rest


def _found(h: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted hashes, whether it is there) of each of h."""
    if not len(hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(hashes, h)
    at[at == len(hashes)] = 0
    return at, hashes[at] == h


def symbols(h: np.ndarray, spelling: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The symbol of each word: its rank, or that of its spelling."""
    at, known = _found(h, vocab.hashes)
    out = vocab.size + spelling
    out[known] = vocab.numbers[at[known]]
    return out


def contexts(s: np.ndarray, woff: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(last, the one before) of each token; ``start`` stands before a text."""
    u, v = np.full(len(s), start), np.full(len(s), start)
    u[1:], v[2:] = s[:-1], s[:-2]
    first = woff[:-1][np.diff(woff) > 0]
    u[first] = v[first] = start
    second = woff[:-1][np.diff(woff) > 1] + 1
    v[second] = start
    return u, v


# ---------------------------------------------------------------- training


def start_model(vocab: Vocabulary, dim: int, seed: int) -> list[np.ndarray]:
    """Own vectors, spelling vectors, C1, C2, R, b: small random vectors, and the log frequencies as biases."""
    g = np.random.Generator(np.random.PCG64(seed))
    own = np.zeros((vocab.start + 1, dim))
    own[: vocab.size] = g.normal(0, 0.1, (vocab.size, dim))
    eye = np.eye(dim)
    share = (vocab.counts + 0.5) / (vocab.counts + 0.5).sum()
    return [a.astype(np.float32) for a in (own, g.normal(0, 0.1, (SPELLINGS + 1, dim)), eye, eye * 0.5, g.normal(0, 0.1, (CLASSES, dim)), np.log(share))]


def _summed(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ascending, the sum of g over the places where ``at`` is that row). Rows are symbols or classes, fewer than 2^16, which sort by digits."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    a = at[order]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return a[first], np.add.reduceat(g.take(order, 0), first, axis=0)


def _step(w: np.ndarray, acc: np.ndarray, rows: np.ndarray, total: np.ndarray, rate: float) -> None:
    """One Adagrad step on different rows of w with gradients total."""
    by = total * total
    by += acc.take(rows, 0)
    acc[rows] = by
    np.sqrt(by, out=by)
    np.divide(total, by, out=by)
    by *= np.float32(rate)
    w[rows] = w.take(rows, 0) - by


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train_on(model: list[np.ndarray], acc: list[np.ndarray], spelling: np.ndarray, c: np.ndarray, u: np.ndarray, v: np.ndarray, noise_log: np.ndarray, noise_cdf: np.ndarray, g: np.random.Generator, noise: int, rate: float) -> None:
    """One noise-contrastive step over a batch, in place."""
    own, spell, c1, c2, r_w, b = model
    k = np.minimum(np.searchsorted(noise_cdf, g.random(noise)), len(b) - 1)
    uv = np.concatenate((u, v))
    e = own.take(uv, 0)
    e += spell.take(spelling.take(uv), 0)
    eu, ev = e[: len(u)], e[len(u) :]
    q = eu @ c1
    q += ev @ c2
    rw, rk = r_w.take(c, 0), r_w.take(k, 0)
    shift = np.float32(np.log(noise))
    dp = _logistic(np.einsum("ij,ij->i", q, rw) + b[c] - noise_log[c] - shift) - 1
    dn = q @ rk.T
    dn += b[k] - noise_log[k] - shift
    dn = _logistic(dn)
    scale = np.float32(1 / len(c))
    dp *= scale
    dn *= scale
    dq = dn @ rk
    dq += dp[:, None] * rw
    ck = np.concatenate((c, k))
    _step(r_w, acc[4], *_summed(ck, np.concatenate((dp[:, None] * q, dn.T @ q))), rate)
    bias = np.bincount(ck, weights=np.concatenate((dp, dn.sum(0))), minlength=len(b)).astype(np.float32)
    acc[5] += bias * bias
    b -= rate * bias / np.sqrt(acc[5])
    d = np.concatenate((dq @ c1.T, dq @ c2.T))
    for i, x in ((2, eu), (3, ev)):
        grad = x.T @ dq
        acc[i] += grad * grad
        model[i] -= rate * grad / np.sqrt(acc[i])
    # A symbol has one spelling: what a spelling gets is the sum of what its symbols get.
    rows, total = _summed(uv, d)
    _step(own, acc[0], rows, total, rate)
    _step(spell, acc[1], *_summed(spelling.take(rows), total), rate)


_ENCODED = pa.schema([("slot", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])
#: Words that are put in random order at once, and numbers in a piece of a model.
_MIXED, _PIECE = 1 << 17, 1 << 16
_PARTS = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("vector", pa.binary())])


def _encode(vocab_of, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocab_of.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            raw, offs = texts_of(batch.column(1))
            for lo, hi in slices(offs):
                h, spelling, woff = _words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                s = symbols(h, spelling, vocab).astype(np.uint16)
                own = keys[lo:hi]
                yield rows_of(_ENCODED, slot=(mix(own.view(U)) % U(slots)).astype(np.int32), h=own, words=[s[a:b].tobytes() for a, b in zip(woff[:-1], woff[1:])])

    return run


class Trainer:
    """One shard of a round: trains as texts arrive; gives its parameters with how often each row was met."""

    def __init__(self, model: list[np.ndarray], vocab: Vocabulary, noise: int, batch: int, rate: float, seed: int) -> None:
        self.model, self.vocab = [a.copy() for a in model], vocab
        self.acc = [np.full_like(a, 1e-6) for a in model]
        share = (vocab.counts + 0.5) / (vocab.counts + 0.5).sum()
        self.noise_log, self.noise_cdf = np.log(share).astype(np.float32), np.cumsum(share)
        self.noise, self.batch, self.rate = noise, batch, rate
        self.g = np.random.Generator(np.random.PCG64(seed))
        self.met = np.zeros(vocab.start + 1, np.int64)
        self.seen, self.held, self.parts = 0, 0, []

    def add(self, s: np.ndarray) -> None:
        self.parts.append(s)
        self.held += len(s)
        if self.held >= _MIXED:
            self._run()

    def _run(self) -> None:
        if not self.held:
            return
        s = np.concatenate(self.parts).astype(np.int64)
        woff = np.concatenate(([0], np.cumsum([len(p) for p in self.parts])))
        self.parts, self.held = [], 0
        u, v = contexts(s, woff, self.vocab.start)
        c = self.vocab.cls[s]
        order = self.g.permutation(len(s))
        for lo in range(0, len(s), self.batch):
            at = order[lo : lo + self.batch]
            train_on(self.model, self.acc, self.vocab.spelling, c[at], u[at], v[at], self.noise_log, self.noise_cdf, self.g, self.noise, self.rate)
        self.met += np.bincount(u, minlength=len(self.met)) + np.bincount(v, minlength=len(self.met))
        self.seen += len(s)

    def weighted(self) -> np.ndarray:
        """All parameters times their weights, and the weights of the vectors' rows, as one row of numbers."""
        self._run()
        spell = np.bincount(self.vocab.spelling, weights=self.met, minlength=SPELLINGS + 1)
        own, spelling, *dense = self.model
        flat = [(own * self.met[:, None]).ravel(), self.met, (spelling * spell[:, None]).ravel(), spell, *[a.ravel() * self.seen for a in dense]]
        return np.concatenate(flat).astype(np.float32)


def averaged(model: list[np.ndarray], total: np.ndarray, seen: float) -> list[np.ndarray]:
    """The model of added-up weighted parameters; rows that no shard met stay as they are."""
    out, at = [], 0
    for i, a in enumerate(model):
        part = total[at : at + a.size].reshape(a.shape)
        at += a.size
        if i < 2:
            weight = total[at : at + len(a)][:, None]
            at += len(a)
            out.append(np.where(weight > 0, part / np.maximum(weight, 1), a).astype(np.float32))
        else:
            out.append((part / seen).astype(np.float32))
    return out


def _train(state_of, noise: int, batch: int, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocab = state_of.value
        slot, trainer = None, None

        def sent() -> Iterator[pa.RecordBatch]:
            if trainer is not None:
                flat = trainer.weighted()
                pieces = [flat[i : i + _PIECE].tobytes() for i in range(0, len(flat), _PIECE)]
                if trainer.seen:
                    yield rows_of(_PARTS, piece=range(len(pieces)), n=[trainer.seen] * len(pieces), vector=pieces)

        for b in batches:
            for own, words in zip(b.column(0).to_pylist(), b.column(1)):
                if own != slot:
                    yield from sent()
                    slot, trainer = own, Trainer(model, vocab, noise, batch, rate, seed + own)
                trainer.add(np.frombuffer(words.as_buffer(), np.uint16))
        yield from sent()

    return run


def train(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", *, dim: int = DIM, noise: int = NOISE, batch: int = BATCH, rate: float = RATE, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> list[np.ndarray]:
    model = start_model(vocab, dim, seed)
    sc = docs.sparkSession.sparkContext
    shards = max(1, math.ceil(vocab.counts.sum() / rounds / shard_tokens))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("h"), F.col(text_col).cast("string").alias("text"))
    encoded = arrow_map(texts, _encode(sc.broadcast(vocab), rounds * shards), "slot int, h long, words binary")
    dealt = cut(encoded.repartitionByRange(rounds * shards, "slot").sortWithinPartitions("slot", "h").select("slot", "words"))
    for r in range(rounds):
        own = dealt.where((F.col("slot") >= r * shards) & (F.col("slot") < (r + 1) * shards))
        state_of = sc.broadcast((model, vocab))
        sums = add_vectors(arrow_map(own, _train(state_of, noise, batch, rate, seed), "piece int, n long, vector binary"), "float32", shards)
        if sums:
            model = averaged(model, np.concatenate([sums[i][1] for i in sorted(sums)]), sums[0][0])
    return model


# ---------------------------------------------------------------- scoring


def tables(model: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores by last word with the bias, and by the word before, each row's largest being 1."""
    own, spell, c1, c2, r_w, b = model
    e = own + spell[vocab.spelling]
    one, two = e @ c1 @ r_w.T + b, e @ c2 @ r_w.T
    return tuple(np.exp(np.maximum(x - x.max(1, keepdims=True), -80)).astype(np.float32) for x in (one, two))


#: Tokens whose rows of the tables are multiplied at once; their products stay in a core's cache.
_ROWS = 512


def class_log_probs(s: np.ndarray, woff: np.ndarray, vocab: Vocabulary, made: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log P(class) of each token's class, exactly normalised."""
    one, two = made
    u, v = contexts(s, woff, vocab.start)
    c = vocab.cls[s]
    out = np.empty(len(s))
    for lo in range(0, len(s), _ROWS):
        x, y, z = u[lo : lo + _ROWS], v[lo : lo + _ROWS], c[lo : lo + _ROWS]
        a, b = one.take(x, 0), two.take(y, 0)
        rows = np.arange(len(x))
        out[lo : lo + _ROWS] = np.log(a[rows, z]) + np.log(b[rows, z]) - np.log(np.einsum("ij,ij->i", a, b))
    return out


def word_log_probs(raw: np.ndarray, offs: np.ndarray, vocab: Vocabulary, shares: Shares, made: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-probability of each token, offsets by text, places of the words outside shares, their hashes). Such a word counts as unseen."""
    h, spelling, woff = _words(raw, offs)
    s = symbols(h, spelling, vocab)
    lp = class_log_probs(s, woff, vocab, made)
    at, known = _found(h, shares.hashes)
    lp[known] += shares.share[at[known]]
    rare = np.flatnonzero(~known)
    lp[rare] += shares.unseen[spelling[rare]]
    return lp, woff, rare, h[rare]


_PART = pa.schema([("row", pa.int64()), ("hash", pa.int64()), ("times", pa.int64()), ("id", pa.int64()), ("tokens", pa.int64()), ("log_prob", pa.float64())])
#: The tables of the model that a worker scores by, by the model's name.
_made: dict[str, tuple] = {}


def _score(state_of, with_rare: bool):
    """A row for each text; with_rare: and one, of ``times`` > 0, for each word of it outside the shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, vocab, shares, model = state_of.value
        if name not in _made:
            _made.clear()
            _made[name] = tables(model, vocab)
        made = _made[name]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, offs = texts_of(batch.column(1))
            for lo, hi in slices(offs):
                lp, woff, rare, h = word_log_probs(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], vocab, shares, made)
                total = np.diff(np.concatenate(([0.0], np.cumsum(lp)))[woff])
                rows = np.arange(row, row + hi - lo)
                row += hi - lo
                # A text's own row has a hash of its number, so that these rows spread over the join's tasks.
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(mix(rows.astype(U)).view(np.int64)), pa.array(np.zeros(hi - lo, np.int64)), batch.column(0).slice(lo, hi - lo), pa.array(np.diff(woff)), pa.array(total)], schema=_PART)
                if with_rare and len(rare):
                    owner = np.searchsorted(woff, rare, "right") - 1
                    order = np.lexsort((h, owner))
                    h, owner = h[order], owner[order]
                    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
                    none = pa.nulls(len(first), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(rows[owner[first]]), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h)))), none, none, pa.nulls(len(first), pa.float64())], schema=_PART)

    return run


def score(docs: DataFrame, vocab: Vocabulary, shares: Shares, rest: DataFrame | None, model: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, tokens, log_prob, perplexity) for each row of docs. Shuffles words of rest only."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    state_of = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocab, shares, model))
    rows = arrow_map(own, _score(state_of, rest is not None), "row long, hash long, times long, id long, tokens long, log_prob double")
    if rest is not None:
        more = F.element_at(F.lit((shares.inverse - shares.unseen).tolist()), F.col("cls") + 1)
        gains = rest.select("hash", (F.log(F.col("n") - shares.discount) + more).alias("gain"))
        rows = rows.join(gains, "hash", "left").groupBy("row").agg(F.max("id").alias("id"), F.max("tokens").alias("tokens"), F.sum(F.coalesce("log_prob", F.lit(0.0)) + F.col("times") * F.coalesce("gain", F.lit(0.0))).alias("log_prob"))
    perplexity = F.when(F.col("tokens") > 0, F.round(F.exp(F.least(-F.col("log_prob") / F.col("tokens"), F.lit(700.0))), 4))
    return rows.select(F.col("id").alias(id_col), "tokens", F.round("log_prob", 4).alias("log_prob"), perplexity.alias("perplexity"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, known: int = KNOWN, **parameters: object) -> DataFrame:
    """Trains on all texts of docs, then scores them."""
    vocab, shares, rest = choose(word_counts(docs.select(F.col(text_col).cast("string").alias("text"))), words, known)
    return score(docs, vocab, shares, rest, train(docs, vocab, id_col, text_col, **parameters), id_col, text_col)
