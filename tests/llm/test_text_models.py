import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from setloom.llm import language_id, lbl_lm, quality_pu
from setloom.llm.common import texts_of

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"


# ---------------------------------------------------------------- language


def grams(text):
    s = [language_id.symbol_table()[ord(c)] for c in text]
    if not any(s):
        return []
    squeezed = [0]
    for x in s:
        if x or squeezed[-1]:
            squeezed.append(int(x))
    squeezed += [0] if squeezed[-1] else []
    return [tuple(squeezed[i : i + 3]) for i in range(len(squeezed) - 2)]


def test_ngrams_are_those_of_brute_force():
    texts = ["Ab, c!", "", "  é  ", "...", "xyz", "a" * 50 + " b"]
    ids, off = language_id.gram_ids(*texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        own = [(int(g) // 4096, int(g) // 64 % 64, int(g) % 64) for g in ids[off[i] : off[i + 1]]]
        assert own == grams(t), t


def test_cosines_are_those_of_bound_and_bundled_vectors():
    v = language_id.letter_vectors(256, 7)
    bundle = lambda t: sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in grams(t)), np.zeros(256))
    protos = np.array([bundle("the cat and the dog"), bundle("der hund und die katze")])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    text = "the hound and die cat"
    want = protos @ (bundle(text) / np.linalg.norm(bundle(text)))
    assert np.allclose(language_id.cosines(*texts_of(pa.array([text])), protos, 7)[0], want, atol=1e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.prototypes(docs.where("doc_id % 2 = 0"))
    both = language_id.identify(docs.where("doc_id % 2 = 1"), model).join(docs, "doc_id").collect()
    assert sum(r.language == r.lang for r in both) >= 0.97 * len(both)


def test_many_short_texts_need_little_memory(monkeypatch):
    g = np.random.default_rng(2)
    texts = ["".join(chr(int(c)) for c in g.integers(97, 1400, 15)) for _ in range(400)]
    protos = g.normal(0, 1, (3, 256))
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    want = language_id.cosines(*texts_of(pa.array(texts)), protos, 7)
    monkeypatch.setattr(language_id, "CELLS", 2000)
    monkeypatch.setattr(language_id, "GRAMS", 50)
    widest = []
    inner = language_id.bundled
    monkeypatch.setattr(language_id, "bundled", lambda ids, counts, *a: (widest.append(counts.size), inner(ids, counts, *a))[1])
    assert np.allclose(language_id.cosines(*texts_of(pa.array(texts)), protos, 7), want, atol=1e-4, equal_nan=True)
    assert max(widest) <= 2000


def test_prototypes_are_bundles_of_all_labelled_texts(spark, monkeypatch):
    rows = [(i, t, f"l{i % 20}") for i, t in enumerate(["the cat and dog", "der hund", "le chat", "x y z", "un perro"] * 12)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    langs, protos = language_id.prototypes(df, dimensions=64)
    v = language_id.letter_vectors(64, language_id.SEED)
    for lang, proto in zip(langs, protos):
        want = sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for _, t, name in rows if name == lang for a, b, c in grams(t)), np.zeros(64))
        assert np.allclose(proto, want / np.linalg.norm(want))


def test_language_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "en"), (None, "the dog", None), (7, "the dog " * 50000, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "0 AS score", "0 AS language", "0 AS id")
    got = sorted((((r.doc_id or 0), r.language) for r in language_id.identify(df, language_id.prototypes(df)).collect()), key=str)
    assert got == [(0, "en"), (1, "en"), (2, "de"), (2, "de"), (3, None), (4, None), (5, None), (7, "en")]
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty, language_id.prototypes(empty)).count() == 0
    assert [r.language for r in language_id.identify(df.where("doc_id = 1"), language_id.prototypes(empty)).collect()] == [None]


# ---------------------------------------------------------------- language model


def lm(docs, **options):
    vocab, shares, rest = lbl_lm.choose(lbl_lm.word_counts(docs.select("text")))
    return vocab, shares, rest, lbl_lm.train(docs, vocab, **options)


def test_probabilities_add_up_to_one(spark):
    g = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(i, " ".join(words[min(int(g.exponential(18)), 124)] for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab, shares, rest, model = lm(df)
    assert rest is None
    counts = Counter(w for _, t in rows for w in t.split())
    seen = sorted(counts)
    n1, n2 = (sum(n == k for n in counts.values()) for k in (1, 2))
    assert np.isclose(shares.discount, np.clip(n1 / (n1 + 2 * n2), 0.1, 0.9))
    made = lbl_lm.tables(model, vocab)
    lp = lambda t: lbl_lm.word_log_probs(*texts_of(pa.array([t])), vocab, shares, made)[0]
    one, two = made
    # Words in their classes, by brute force from the model's own scores.
    own, spell, c1, c2, r_w, bias = model
    e = own + spell[vocab.spelling]
    h, spelling, _ = lbl_lm._words(*texts_of(pa.array(seen)))
    s = lbl_lm.symbols(h, spelling, vocab)
    kinds = np.bincount(vocab.cls[s], minlength=lbl_lm.CLASSES)
    for context in (["afk", "bgl"], ["zzz", "afk"]):
        v, u = lbl_lm.symbols(*lbl_lm._words(*texts_of(pa.array(context)))[:2], vocab)
        z = (e[u] @ c1 + e[v] @ c2) @ r_w.T + bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        got = np.array([lp(" ".join([*context, w]))[2] for w in seen])
        within = np.exp(got) / p[vocab.cls[s]]
        by = np.bincount(vocab.cls[s], weights=within, minlength=lbl_lm.CLASSES)
        spelt = np.flatnonzero(kinds)[np.flatnonzero(kinds) >= lbl_lm.HEADS]
        by[spelt] += np.exp(shares.unseen[spelt - lbl_lm.HEADS]) * (kinds[spelt] + 1)
        assert np.allclose(by[kinds > 0], 1, atol=1e-4)
        most = max(counts.items(), key=lambda kv: kv[1])[0]
        assert vocab.cls[s[seen.index(most)]] < lbl_lm.HEADS


def test_production_training_beats_frequencies_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text")
    seen = docs.where("doc_id % 10 <> 1")
    raw, offs = texts_of(pa.array([r.text for r in docs.where("doc_id % 10 = 1").collect()]))
    h, spelling, woff = lbl_lm._words(raw, offs)
    counts = {np.int64(r.hash): r.n for r in lbl_lm.word_counts(seen.select("text")).collect()}
    total = sum(counts.values())
    found = []
    for n in (2, 32):
        vocab, shares, rest, model = lm(seen.repartition(n))
        assert rest is None
        assert len(vocab.hashes) > 20_000
        found.append(lbl_lm.word_log_probs(raw, offs, vocab, shares, lbl_lm.tables(model, vocab))[0].mean())
        spare = shares.discount * len(counts) / total / (len(counts) + 1)
        plain = np.mean([np.log((counts[x] - shares.discount) / total if x in counts else spare) for x in h.view(np.int64).tolist()])
        assert found[-1] > plain + 0.2
    assert abs(found[0] - found[1]) < 0.01


def test_averaged_shards_learn_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "text")
    raw, offs = texts_of(pa.array([r.text for r in docs.where("doc_id % 10 = 5").collect()]))
    vocab, shares, _, model = lm(docs.where("doc_id % 10 = 0"), shard_tokens=25_000)
    start = lbl_lm.start_model(vocab, lbl_lm.DIM, lbl_lm.SEED)
    ours, before = (lbl_lm.word_log_probs(raw, offs, vocab, shares, lbl_lm.tables(m, vocab))[0].mean() for m in (model, start))
    assert ours > before + 0.2


def test_contexts():
    u, v = lbl_lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 4, 5]), 9)
    assert u.tolist() == [9, 1, 2, 9, 9]
    assert v.tolist() == [9, 9, 1, 9, 9]


def test_ranges_of_counts():
    assert lbl_lm._least([(1, 50), (2, 20), (3, 5)], 30) == 2
    assert lbl_lm._least([(1, 50), (2, 20), (3, 5)], 4) == 1 << 62


def test_language_model_cases(spark):
    rows = [(1, "a b a b a"), (1, "a b a b a"), (2, None), (3, ""), (4, "?!"), (None, "a"), (6, "a b " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS id", "3 AS perplexity", "4 AS h", "5 AS slot")
    got = {r.doc_id: r for r in lbl_lm.lm_scores(df).collect()}
    assert [got[i].tokens for i in (1, 2, 3, 4, None, 6)] == [5, 0, 0, 0, 1, 200000]
    assert got[2].perplexity is None
    assert got[2].log_prob == 0
    assert got[1].perplexity > 1
    assert lbl_lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="words must be"):
        lbl_lm.lm_scores(df, words=10)


def test_shares_that_are_joined_on_count_as_those_that_are_broadcast(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counts = lbl_lm.word_counts(docs.select("text"))
    vocab, shares, rest = lbl_lm.choose(counts)
    assert rest is None
    model = lbl_lm.start_model(vocab, lbl_lm.DIM, 1)
    want = {r.doc_id: (r.tokens, r.log_prob) for r in lbl_lm.score(docs, vocab, shares, rest, model).collect()}
    assert len(want) == docs.count()
    for known in (0, 300):
        few, less, rest = lbl_lm.choose(counts, known=known)
        assert rest is not None
        assert len(less.hashes) <= max(known, lbl_lm.HEADS)
        got = {r.doc_id: (r.tokens, r.log_prob) for r in lbl_lm.score(docs, few, less, rest, model).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 0.01 for i in want)


# ---------------------------------------------------------------- quality


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_pu.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality_pu.score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.keep for r in got if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in got)
    assert sum(not r.keep for r in got if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in got)


def test_prior_and_risk_on_mixed_gaussians(spark):
    g = np.random.default_rng(0)
    draw = lambda m, n: np.concatenate((g.normal(m, 1, (n, 2)), np.zeros((n, quality_pu.N_FEATURES - 2))), 1)
    x = np.concatenate((draw(2, 2000), draw(2, 1400), draw(-2, 600))).astype(np.float32)
    rows = spark.createDataFrame([(i, i < 2000, v.tobytes()) for i, v in enumerate(x)], "id long, good boolean, x binary")
    model = quality_pu.fit(rows, margin=0)
    assert abs(model["prior"] - 0.7) < 0.12
    assert (quality_pu.scores(model, draw(2, 500)) >= model["cut"]).mean() > 0.95
    assert (quality_pu.scores(model, draw(-2, 500)) < model["cut"]).mean() > 0.95
    # What covers all rows, by brute force.
    assert np.allclose(model["mean"], x.mean(0), atol=1e-5)
    assert np.allclose(model["scale"], x.std(0) + 1e-3, atol=1e-4)
    at = np.quantile(quality_pu.scores(model, x[:2000]), quality_pu.MAX_LOSS, method="inverted_cdf")
    assert abs(model["cut"] - min(0, at)) < 0.01
    # Rows over a sample's bound are in the risk: without the last steps, other weights.
    few = quality_pu.fit(rows, margin=0, max_positives=50, max_unlabelled=50, polish=0)
    more = quality_pu.fit(rows, margin=0, max_positives=50, max_unlabelled=50, polish=8)

    def risk(m):
        total = quality_pu.risk_parts(m["w"], quality_pu.standard(x.astype(float), m), np.arange(len(x)) < 2000)
        return m["prior"] * total[0] / 2000 + max(0, total[2] / 2000 - m["prior"] * total[1] / 2000)

    assert risk(more) < risk(few)


def test_gradients_of_the_risk():
    g = np.random.default_rng(1)
    w = (g.normal(0, 1, (3, 4)), g.normal(0, 1, 4), g.normal(0, 1, 4), np.array(0.3))
    x, good = g.normal(0, 1, (20, 3)), np.arange(20) % 3 == 0
    total = quality_pu.risk_parts(w, x, good)
    flat = quality_pu._flat(w)
    for part in range(3):
        for i in range(len(flat)):
            e = np.zeros_like(flat)
            e[i] = 1e-5
            up, down = (quality_pu.risk_parts(quality_pu._shaped(flat + k * e, w), x, good)[part] for k in (1, -1))
            assert np.isclose((up - down) / 2e-5, total[3:].reshape(3, -1)[part, i], atol=1e-5)


def test_features_are_those_of_brute_force():
    text = "Big big WORD### x\n12 big!"
    x, words = quality_pu.features(*texts_of(pa.array([text, ""])))
    w = re.findall(r"\w+", text.lower())
    assert words.tolist() == [len(w), 0]
    share = lambda f: sum(map(f, text)) / len(text)
    assert np.allclose(x[0][:8], [share(str.islower), share(str.isupper), share(str.isdigit), share(lambda c: c == " "), share(lambda c: c == "\n"), 0, share(lambda c: c == "!"), share(lambda c: c == "#")])
    assert np.isclose(x[0][11], 1 / len(w))
    assert np.isclose(x[0][12], len(set(w)) / len(w))
    assert np.isclose(x[0][13], 3 / len(w))
    assert not x[1].any()


def test_quality_cases(spark):
    rows = [(1, "some good text here"), (2, None), (3, ""), (4, "more text"), (4, "more text"), (None, "x y"), (7, "long text " * 50000), (8, "#!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS keep", "3 AS id", "4 AS good")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality_pu.train(docs, labels), quality_pu.train(docs, labels.limit(0)), None):
        got = quality_pu.score_quality(docs, model).collect()
        assert len(got) == len(rows)
        assert all(not r.keep and r.score is None for r in got if r.doc_id in (2, 3, 8))
        kept = quality_pu.drop_rejected(docs, model)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r.keep for r in got)
    assert all(r.keep for r in quality_pu.score_quality(docs, None).collect() if r.score is not None)
    assert quality_pu.train(docs.limit(0), labels) is None
    assert quality_pu.score_quality(docs.limit(0), None).count() == 0


def test_toxic_documents_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_pu.train(docs, labels.where("doc_id % 2 = 0"), toxic_col="toxic")
    got = quality_pu.score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    insults = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}
    toxic = [r for r in got if r.toxic == 1]
    told = [r for r in toxic if insults & set(re.findall(r"\w+", r.text.lower()))]
    clean = [r for r in got if r.toxic == 0 and r.quality == 1]
    junk = [r for r in got if r.quality == 0]
    assert sum(not r.keep for r in told) >= 0.98 * len(told)
    assert sum(not r.keep for r in toxic) >= 0.55 * len(toxic)
    assert sum(r.keep for r in clean) >= 0.98 * len(clean)
    assert sum(not r.keep for r in junk) >= 0.9 * len(junk)


def test_a_training_step_is_that_of_the_plain_formulas_and_scoring_holds_few_rows():
    g = np.random.Generator(np.random.PCG64(5))
    vocab = lbl_lm.Vocabulary(np.unique(g.integers(1, 1 << 60, 300).astype(np.uint64)), g.integers(0, lbl_lm.SPELLINGS, 300), g.integers(1, 1000, lbl_lm.CLASSES).astype(float))
    model = [x + g.normal(0, 0.1, x.shape).astype(np.float32) for x in lbl_lm.start_model(vocab, 8, 1)]
    c, u, v = g.integers(0, lbl_lm.CLASSES, 500), g.integers(0, vocab.start + 1, 500), g.integers(0, 20, 500)
    share = vocab.counts / vocab.counts.sum()
    noise_log, noise_cdf = np.log(share).astype(np.float32), np.cumsum(share)
    got, acc = [x.copy() for x in model], [np.full_like(x, 1e-6) for x in model]
    lbl_lm.train_on(got, acc, vocab.spelling, c, u, v, noise_log, noise_cdf, np.random.Generator(np.random.PCG64(9)), 16, 0.05)

    own, spell, c1, c2, r_w, b = (x.astype(np.float64) for x in model)
    k = np.minimum(np.searchsorted(noise_cdf, np.random.Generator(np.random.PCG64(9)).random(16)), len(b) - 1)
    eu, ev = (own[x] + spell[vocab.spelling[x]] for x in (u, v))
    q = eu @ c1 + ev @ c2
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    dp = (sigmoid((q * r_w[c]).sum(1) + b[c] - noise_log[c] - np.log(16)) - 1) / 500
    dn = sigmoid(q @ r_w[k].T + b[k] - noise_log[k] - np.log(16)) / 500
    dq = dp[:, None] * r_w[c] + dn @ r_w[k]
    grads = [np.zeros_like(x) for x in (own, spell, c1, c2, r_w, b)]
    for x, d in ((u, dq @ c1.T), (v, dq @ c2.T)):
        np.add.at(grads[0], x, d)
        np.add.at(grads[1], vocab.spelling[x], d)
    grads[2], grads[3] = eu.T @ dq, ev.T @ dq
    for at, d in ((c, dp[:, None] * q), (k, dn.T @ q)):
        np.add.at(grads[4], at, d)
    for at, d in ((c, dp), (k, dn.sum(0))):
        np.add.at(grads[5], at, d)
    # A step's length is the rate wherever the gradient is well above 0; next to 0 its rounding shows.
    for a, start, grad in zip(got, model, grads):
        want = start - 0.05 * grad / np.sqrt(1e-6 + grad * grad)
        assert np.allclose(a, want, atol=2e-4)

    made = lbl_lm.tables(got, vocab)
    s = g.integers(0, vocab.size, 8192)
    tracemalloc.start()
    lp = lbl_lm.class_log_probs(s, np.array([0, 5000, 8192]), vocab, made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    before, last = lbl_lm.contexts(s, np.array([0, 5000, 8192]), vocab.start)[::-1]
    e = (got[0] + got[1][vocab.spelling]).astype(np.float64)
    z = (e[last] @ got[2] + e[before] @ got[3]) @ got[4].T + got[5]
    assert np.allclose(lp, z[np.arange(8192), vocab.cls[s]] - np.log(np.exp(z).sum(1)), atol=1e-3)
