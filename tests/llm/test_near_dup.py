import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from setloom.llm import near_dup
from setloom.llm.common import components, shingles_of, texts_of, words_of

SCHEMA = "doc_id long, text string"


def corpus(seed=1, n=60):
    g = random.Random(seed)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 7))) for _ in range(400)]
    out = {}
    for i in range(n):
        if i % 3 and out:
            w = out[g.choice(list(out))].split()
            for _ in range(g.randint(0, 3)):
                w[g.randrange(len(w))] = g.choice(words)
            out[i] = " ".join(w)
        else:
            out[i] = " ".join(g.choice(words) for _ in range(g.randint(20, 60)))
    return out


def brute(docs, t, k=near_dup.SHINGLE):
    """Components of all pairs at the threshold, by Python's own words and weights."""
    tf = {}
    for i, text in docs.items():
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if w:
            tf[i] = Counter(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
    df = Counter(s for c in tf.values() for s in c)
    weight = {i: {s: (1 + np.log(n)) * max(np.log((1 + len(tf)) / (1 + df[s])), 0.05) for s, n in c.items()} for i, c in tf.items()}
    root = {i: i for i in tf}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in tf:
        for b in tf:
            if a < b:
                keys = weight[a].keys() | weight[b].keys()
                low = sum(min(weight[a].get(s, 0), weight[b].get(s, 0)) for s in keys)
                if low / sum(max(weight[a].get(s, 0), weight[b].get(s, 0)) for s in keys) >= t:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    groups = defaultdict(list)
    for i in tf:
        groups[find(i)].append(i)
    return {(i, r) for r, m in groups.items() if len(m) > 1 for i in m}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_brute_force(spark, seed):
    docs = corpus(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()
    assert {(r.doc_id, r.group_id) for r in got} == brute(docs, near_dup.THRESHOLD)
    assert all(r.links >= 1 for r in got)


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.5 to 0.6, by brute force, with the registered parameters."""
    g = random.Random(8)
    word = lambda: "".join(g.choice("abcdefghijklmnopqrst") for _ in range(6))
    docs = {}
    for i in range(0, 400, 2):
        base = [word() for _ in range(80)]
        docs[i] = " ".join(base)
        docs[i + 1] = " ".join(base[: 80 - 28 + g.randint(0, 6)] + [word() for _ in range(25)])
    want = brute(docs, near_dup.THRESHOLD)
    loose = brute(docs, 0.6)
    border = {i for i, _ in want} - {i for i, _ in loose}
    assert len(border) > 150
    found = {r.doc_id for r in near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert found <= {i for i, _ in brute(docs, near_dup.THRESHOLD - 0.01)}
    assert len(border & found) >= 0.9 * len(border)


def test_repeated_ids_keep_the_row_of_least_hash(spark):
    docs = corpus(3, 40)
    rows = [(i % 20, f"{t} {'x' * k}", k) for i, t in docs.items() for k in range(3)]
    results = []
    for order, n in ((1, 3), (-1, 7)):
        df = spark.createDataFrame(rows[::order], SCHEMA + ", k int").repartition(n)
        kept = sorted(tuple(r) for r in near_dup.drop_near_duplicates(df).collect())
        assert len({r[0] for r in kept}) == len(kept)
        results.append((kept, sorted(tuple(r) for r in near_dup.near_duplicates(df).collect())))
    assert results[0] == results[1]


def test_chunks_and_split_pairs_change_nothing(spark, monkeypatch):
    g = random.Random(6)
    members = [(k, i, i if g.random() < 0.5 else k * 100) for k in range(4) for i in range(k * 100, k * 100 + 30)]
    want = {(a, b) for k, a, x in members for q, b, y in members if k == q and a < b and x != y}
    df = spark.createDataFrame(members, "key long, rep long, root long")
    for chunk in (512, 7, 1):
        rows = near_dup.pairs_of_chunks(df, chunk).collect()
        assert {tuple(r) for r in rows} == want
        assert len(rows) == len(want)
    docs = corpus(1)
    monkeypatch.setattr(near_dup, "SPLIT", 2)
    monkeypatch.setattr(near_dup, "CHUNK", 2)
    got = near_dup.near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()
    assert {(r.doc_id, r.group_id) for r in got} == brute(docs, near_dup.THRESHOLD)


def test_shared_counters_are_set_right():
    counts = np.full(1000, 40) + np.eye(1, 1000, 3, dtype=np.int64)[0] * 500
    idf = near_dup.idf_of_counts(counts, 10_000)
    assert np.isclose(idf[3], np.log(10_001 / 501), atol=0.01)
    assert np.allclose(np.delete(idf, 3), np.log(10_001 / 2), atol=0.01)


def test_samples_agree_as_often_as_weights_overlap():
    g = np.random.default_rng(3)
    h = np.sort(g.integers(0, 1 << 62, 60).astype(np.uint64))
    wa, wb = g.uniform(0.2, 3, 60), g.uniform(0.2, 3, 60)
    tables = near_dup.sampling_tables(4000, 1 << 10, 9)
    same = (near_dup.sample(h, wa, tables) == near_dup.sample(h, wb, tables)).mean()
    assert abs(same - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_defined_cases(spark):
    same = "one two three four five six seven"
    rows = [(1, same, 0), (1, same, 0), (2, same, 0), (3, None, 0), (4, "", 0), (5, "!!", 0), (6, None, 0), (None, same, 0), (8, "x", 0), (9, "X!", 0), (10, "word " * 60000, 0), (11, "word " * 60000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").selectExpr("*", "1 AS id", "2 AS rep", "3 AS n", "4 AS group_id")
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == {(1, 1, 1), (2, 1, 1), (8, 8, 1), (9, 8, 1), (10, 10, 1), (11, 10, 1)}
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 10]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.drop_near_duplicates(empty).count() == 0


def test_components(spark):
    g = random.Random(4)
    edges = [(g.randrange(60), g.randrange(60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: r for x, r in root.items() if x in got}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_words_hash_alike_wherever_they_stand():
    texts = ["Été, ÉTÉ; a-b “q” x", "", "b", "été q"]
    h, off = words_of(*texts_of(pa.array(texts)))
    words = [w for t in texts for w in re.findall(r"[^\W_]+", t.lower())]
    assert np.diff(off).tolist() == [len(re.findall(r"[^\W_]+", t)) for t in texts]
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
    s, soff = shingles_of(h, off, 2)
    assert np.diff(soff).tolist() == [5, 0, 1, 1]
    assert len(s) == 7
