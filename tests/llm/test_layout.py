import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from setloom.llm import hilbert, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, n=300, seed=1):
    g = np.random.default_rng(seed)
    words = ["".join(g.choice(list("abcdefg"), g.integers(2, 8))) for _ in range(200)]
    rows = []
    for i in range(n):
        text = " ".join(g.choice(words, g.integers(1, 30)))
        rows.append((i, text, str(g.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), f"s{min(int(g.exponential(2)), 6)}", len(text)))
    return spark.createDataFrame(rows, SCHEMA), rows


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 2), (3, 4)])
def test_the_curve_visits_every_cell_by_single_steps(d, bits):
    index = np.array(hilbert.curve_table(d, bits))
    assert sorted(index.tolist()) == list(range(1 << (d * bits)))
    cells = np.indices((1 << bits,) * d).reshape(d, -1).T[np.argsort(index)]
    assert (np.abs(np.diff(cells, axis=0)).sum(1) == 1).all()


def brute_shards(rows, shard_chars, bits=4):
    side, total = 1 << bits, len(rows)
    low = lambda v: (v is not None, v if v is not None else 0)

    def cells(values):
        less = {v: sum(low(x) < low(v) for x in values) for v in set(values)}
        return [0 if v is None else less[v] * side // total for v in values]

    dims = [cells([r[c] for r in rows]) for c in (2, 3, 4)]
    table = hilbert.curve_table(3, bits)
    keyed = sorted(((table[(x * side + y) * side + z], r[0] if r[0] is not None else -(1 << 63)), max(r[4] or 0, 0)) for x, y, z, r in zip(*dims, rows))
    out, before, first = [], 0, {}
    for key, chars in keyed:
        first.setdefault(key, before // shard_chars)
        out.append((None if key[1] == -(1 << 63) else key[1], key[0], first[key]))
        before += chars
    return Counter(out)


def test_shards_are_those_of_brute_force(spark):
    df, rows = frame(spark)
    assert Counter(tuple(r) for r in hilbert.shards(df, shard_chars=700).collect()) == brute_shards(rows, 700)
    for options in ({"part_shards": 1}, {"max_parts": 3}):
        assert Counter((r.doc_id, r.hilbert, r.shard) for r in hilbert.shard_documents(df, shard_chars=700, **options).collect()) == brute_shards(rows, 700)
    done = hilbert.shard_documents(df, shard_chars=700)
    assert Counter((r.doc_id, r.hilbert, r.shard) for r in done.collect()) == brute_shards(rows, 700)
    assert done.columns == [*df.columns, "hilbert", "shard"]
    parts = done.rdd.glom().collect()
    seen = [{r.shard for r in p} for p in parts if p]
    assert sum(map(len, seen)) == len(set().union(*seen))
    assert all(list(p) == sorted(p, key=lambda r: (r.shard, r.hilbert, r.doc_id)) for p in parts)


def test_shard_cases(spark):
    rows = [(1, "a", "en", "s", 5), (1, "a", "en", "s", 5), (None, None, None, None, None), (2, "", "de", None, 0), (3, "b", None, "t", -4), (4, "x" * 100000, "en", "s", 100000), (4, "y", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS before", "2 AS id", "3 AS low", "4 AS shards")
    assert Counter(tuple(r) for r in hilbert.shards(df, shard_chars=4).collect()) == brute_shards(rows, 4)
    assert Counter((r.doc_id, r.hilbert, r.shard) for r in hilbert.shard_documents(df, shard_chars=4).collect()) == brute_shards(rows, 4)
    empty = spark.createDataFrame([], SCHEMA)
    assert hilbert.shards(empty).count() == 0
    assert hilbert.shard_documents(empty).count() == 0
    with pytest.raises(ValueError, match="already has"):
        hilbert.shard_documents(df.withColumnRenamed("low", "shard"))


# ---------------------------------------------------------------- mixing


def brute_probabilities(rows, targets, keep):
    """Plain proportional fitting under the bound of 1, a value at a time, by bisection."""
    cells = defaultdict(float)
    for r in rows:
        if r.tokens:
            cells[r.source, r.lang, r.topic] += r.tokens
    factor = [defaultdict(lambda: 1.0) for _ in range(3)]
    of = lambda c: factor[0][c[0]] * factor[1][c[1]] * factor[2][c[2]]
    for _ in range(60):
        for d in range(3):
            for v, goal in targets[d].items():
                own = [(c, t) for c, t in cells.items() if c[d] == v]
                rest = [(of(c) / factor[d][v], t) for c, t in own]
                low, high = 0.0, 1e6
                for _ in range(45):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(t * min(1, w * mid) for w, t in rest) < goal * (1 - 1e-12) else (low, mid)
                factor[d][v] = high
    return {c: min(1, of(c)) for c in cells}


def test_probabilities_are_those_of_brute_force(spark):
    df, _ = frame(spark, 600)
    want = {"en": 0.5, "de": 0.3, "fr": 0.2}
    options = {"langs": want, "keep": 0.3, "topics": 3}
    got = mixing.mixed(df, **options).collect()
    total = sum(r.tokens for r in got)
    targets = [{}, {}, {}]
    for r in mixing.marginals(df, **options).collect():
        targets[mixing.DIMENSIONS.index(r.dimension)][r.value] = r.target * 0.3 * total
    for v, share in want.items():
        assert np.isclose(targets[1][v], share * 0.3 * total)
    brute = brute_probabilities(got, targets, 0.3)
    assert all(abs(r.probability - brute[r.source, r.lang, r.topic]) < 1e-3 for r in got)
    for r in got:
        u = int(hashlib.md5(f"{r.doc_id}:mix".encode()).hexdigest()[:13], 16) / 2**52
        assert abs(u - r.probability) < 1e-5 or r.selected == (u < r.probability)
    kept = mixing.draw_documents(df, **options)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.selected}


def test_drawn_shares_meet_the_targets_as_registered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.marginals(docs).collect()
    assert {r.dimension for r in got} == set(mixing.DIMENSIONS)
    assert max(abs(r.drawn - r.target) for r in got) < 1e-3
    for d in mixing.DIMENSIONS:
        assert np.isclose(sum(r.target for r in got if r.dimension == d), 1)
    rows = mixing.mixed(docs).collect()
    assert np.isclose(sum(r.tokens * r.probability for r in rows), mixing.KEEP * sum(r.tokens for r in rows), rtol=1e-3)


def test_topics_are_those_of_planted_vocabularies(spark):
    g = np.random.default_rng(5)
    fields = [[f"w{''.join(g.choice(list('abcdefghij'), 6))}" for _ in range(40)] for _ in range(3)]
    shared = [f"c{''.join(g.choice(list('abcdefghij'), 6))}" for _ in range(30)]
    rows = [(i, " ".join([*g.choice(fields[i % 3], 30), *g.choice(shared, 15)]), "en" if i % 2 else "de", "s", 1) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.topic for r in mixing.mixed(df, topics=3).collect()}
    seen = [Counter(got[i] for i in range(k, 240, 3)) for k in range(3)]
    assert len({c.most_common(1)[0][0] for c in seen}) == 3
    assert sum(c.most_common(1)[0][1] for c in seen) >= 230
    again = {r.doc_id: r.topic for r in mixing.mixed(df.repartition(7), topics=3).collect()}
    assert again == got
    given = mixing.mixed(df.withColumn("kind", df.doc_id % 4), topic_col="kind").collect()
    assert {r.topic for r in given} == {"0", "1", "2", "3"}


@pytest.mark.parametrize("kind", ["string", "boolean", "double"])
def test_many_cells_are_drawn_alike(spark, kind):
    rows = []
    for i in range(600):
        source = {"string": f"s{i % 3}", "boolean": bool(i % 3), "double": float(i % 3) * 1e20}[kind]
        rows.append((None if i % 2 else 7, f"words number {i % 11} of this text", "en" if i % 5 else None, source, i, i % 2))
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source {kind}, n_chars long, kind int")
    options = {"keep": 0.4, "topic_col": "kind"}
    one = Counter(tuple(r) for r in mixing.draw_documents(df, **options).collect())
    picked = Counter((r.doc_id, r.source, r.lang, r.topic) for r in mixing.mixed(df, **options).collect() if r.selected)
    text = df.selectExpr("n_chars", "cast(source as string)", "coalesce(lang, '')", "cast(kind as string)").collect()
    of = {r[0]: tuple(r)[1:] for r in text}
    assert picked == Counter((r[0], *of[r[4]]) for r in one.elements())
    if kind == "string":
        many = mixing.draw_documents(df, driver_cells=0, **options)
        assert Counter(tuple(r) for r in many.collect()) == one


def test_targets_beyond_what_there_is_are_lowered():
    natural = np.array([0.01, 0.09, 0.9])
    want = mixing.wanted_shares(natural, np.array([0.5, 0.25, 0.25]), 0.5, 0.0)
    assert np.allclose(want, [0.02, 0.18, 0.8])
    assert np.allclose(mixing.wanted_shares(natural, np.full(3, np.nan), 0.7, 0.0), natural)
    assert np.isclose(mixing.wanted_shares(natural, np.zeros(3), 1.0, 0.3).sum(), 1)


def test_mixing_cases(spark):
    rows = [(1, "some words here", "en", "a", 1), (1, "some words here", "en", "a", 1), (2, None, None, None, None), (3, "", "de", "b", 0), (None, "another text", "en", None, 3), (5, "word " * 50000, "fr", "a", 9), (6, "longer " * 50000, "fr", "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS topic", "2 AS tokens", "3 AS probability", "4 AS id", "5 AS _mixtopic", "6 AS value", "7 AS factor")
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    assert all(r.probability is not None and 0 <= r.probability <= 1 for r in got)
    assert all(r.probability == mixing.KEEP for r in got if r.doc_id in (2, 3))
    assert {r.doc_id: r.topic for r in got}[5] == "none"
    assert {r.doc_id: r.topic for r in got}[6] != "none"
    assert len({r.selected for r in got if r.doc_id == 1}) == 1
    assert mixing.draw_documents(df).columns == df.columns
    assert mixing.draw_documents(df).count() == sum(r.selected for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0
    assert mixing.draw_documents(empty).count() == 0
    blank = df.where("doc_id in (2, 3)")
    assert mixing.mixed(blank).count() == 2
    assert mixing.draw_documents(blank, keep=1.0).count() == 2
