import random
from pathlib import Path

import numpy as np
import pytest

from setloom.functions import bounds
from setloom.operators import blocks, candidates, order
from setloom.operators.candidates import STRATEGIES
from setloom.operators.kernel import self_join as kernel_join
from setloom.operators.verify import differences
from setloom.plans import join, queries
from setloom.plans.join import all_similarities, similarity_join


def brute(a, b, t, strict, same):
    out = set()
    for i, x in a.items():
        for j, y in b.items():
            if (same and i >= j) or not x or not y:
                continue
            o = len(x & y)
            s = o / (len(x) + len(y) - o)
            if o and (s > t or (s == t and not strict)):
                out.add((i, j, o, s))
    return out


def collection(seed, universe, longest, records=120):
    g = random.Random(seed)
    out = {}
    for i in range(records):
        if i % 3 and out:
            x = set(out[g.choice(list(out))])
            for _ in range(g.randint(0, 3)):
                x ^= {g.randrange(universe)}
        else:
            x = {g.randrange(universe) for _ in range(g.randint(1, longest))}
        out[i] = x
    return out


def frame(spark, sets):
    return spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "rid long, tokens array<int>")


def got(df):
    return {(r.rid1, r.rid2, r.overlap, r.sim) for r in df.collect()}


GENERAL = sorted(set(STRATEGIES) - {"full_ball", "deletion_ball"})


@pytest.mark.parametrize("algorithm", GENERAL)
@pytest.mark.parametrize(("universe", "longest", "t"), [(60, 15, 0.5), (400, 40, 0.9)])
def test_self_join_is_exact(spark, algorithm, universe, longest, t):
    sets = collection(7, universe, longest)
    options = {"recursive_pivot": {"max_cell": 30}, "chunked": {"chunk_size": 5}, "segment": {"groups": 6}, "pivot": {"max_cell": 7, "samples": 40}, "probe": {"chunk": 30}}.get(algorithm, {})
    for strict in (True, False):
        assert got(similarity_join(frame(spark, sets), threshold=t, algorithm=algorithm, strict=strict, **options)) == brute(sets, sets, t, strict, True)


@pytest.mark.parametrize("algorithm", GENERAL)
def test_two_collections(spark, algorithm):
    a, b = collection(1, 50, 12, 60), collection(2, 50, 12, 70)
    for i in range(0, 60, 7):
        b[i] = set(a[i])
    assert got(similarity_join(frame(spark, a), frame(spark, b), threshold=0.6, algorithm=algorithm, strict=False)) == brute(a, b, 0.6, False, False)


@pytest.mark.parametrize("algorithm", ["full_ball", "deletion_ball"])
def test_balls(spark, algorithm):
    a, b = collection(3, 9, 5, 40), collection(4, 9, 5, 40)
    assert got(similarity_join(frame(spark, a), threshold=0.7, algorithm=algorithm)) == brute(a, a, 0.7, False, True)
    assert got(similarity_join(frame(spark, a), frame(spark, b), threshold=0.7, algorithm=algorithm)) == brute(a, b, 0.7, False, False)


@pytest.mark.parametrize("n", [17, 18, 26])
def test_segments_at_lengths_where_ends_alone_lose_pairs(spark, n):
    sets = {1: set(range(n)), 2: set(range(1, n)), 3: set(range(n)) | {99}}
    assert got(similarity_join(frame(spark, sets), threshold=0.9, algorithm="segment", strict=False)) == brute(sets, sets, 0.9, False, True)


def test_boundary_and_large_ids(spark):
    big = 1 << 40
    sets = {big: set(range(20)), big + 1: set(range(19))}
    assert got(similarity_join(frame(spark, sets), threshold=0.95, strict=False)) == {(big, big + 1, 19, 0.95)}
    assert got(similarity_join(frame(spark, sets), threshold=0.95, strict=True)) == set()


def test_defined_cases(spark):
    rows = [(1, [1, 2, 2, None]), (2, [2, 1]), (3, []), (4, None), (None, [1, 2]), (5, []), (2, [1])]
    df = spark.createDataFrame(rows, "rid long, tokens array<int>").selectExpr("*", "1 AS n", "2 AS tok", "3 AS overlap")
    assert got(similarity_join(df, threshold=0.5)) == {(1, 2, 2, 1.0)}
    empty = spark.createDataFrame([], "rid long, tokens array<int>")
    for algorithm in GENERAL:
        assert got(similarity_join(empty, threshold=0.5, algorithm=algorithm)) == set()
    with pytest.raises(ValueError, match="unknown algorithm"):
        similarity_join(df, threshold=0.5, algorithm="none")
    with pytest.raises(ValueError, match="threshold"):
        similarity_join(df, threshold=0)


def test_equal_sets_are_one_class(spark):
    sets = collection(7, 60, 15, 60)
    sets |= {100 + i: set(sets[i]) for i in range(0, 40, 3)} | {200 + i: set(sets[0]) for i in range(5)}
    for algorithm in ("prefix", "fragment", "probe"):
        assert got(similarity_join(frame(spark, sets), threshold=0.6, strict=True, algorithm=algorithm)) == brute(sets, sets, 0.6, True, True)
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    heads = {i: sets[i] for i in least.values()}
    want = brute(heads, heads, 0.6, True, True) | {(least[frozenset(x)], i, len(x), 1.0) for i, x in sets.items() if i not in heads and x}
    assert got(similarity_join(frame(spark, sets), threshold=0.6, strict=True, by_class=True)) == want
    assert got(similarity_join(frame(spark, sets), threshold=1.0, strict=True)) == set()


def test_heavy_tokens_are_joined_in_chunks(spark, monkeypatch):
    sets = {i: {0, 1, 2 + i % 5} for i in range(60)} | {100: {0}, 101: {1, 0}}
    monkeypatch.setattr(candidates._met, "__defaults__", (3,))
    assert got(similarity_join(frame(spark, sets), threshold=0.5, strict=False)) == brute(sets, sets, 0.5, False, True)


def test_suffix_bounds_are_below_the_distance(spark):
    g = random.Random(4)
    rows = [(sorted(g.sample(range(40), g.randint(0, 15))), sorted(g.sample(range(40), g.randint(0, 15)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    both = candidates._with_suffix_bound(df, "a", "b", 2, "_b").withColumn("c", bounds.suffix_bound(df.a, df.b)).collect()
    for r in both:
        assert r["_b"] == r.c <= len(set(r.a) ^ set(r.b))
    assert sum(r.c > abs(len(r.a) - len(r.b)) for r in both) > 100


def test_kernel_and_all_pairs(spark):
    sets = collection(5, 60, 15)
    ordered = [(i, sorted(x)) for i, x in sets.items()]
    for strict in (True, False):
        assert set(kernel_join(ordered, 0.5, strict)) == brute(sets, sets, 0.5, strict, True)
    assert got(all_similarities(frame(spark, sets))) == brute(sets, sets, 0.0, True, True)


@pytest.mark.parametrize(("universe", "longest", "t"), [(60, 15, 0.5), (400, 40, 0.9), (3000, 120, 0.3)])
@pytest.mark.parametrize("by", ["tokens", "product"])
def test_blocks_are_exact(spark, monkeypatch, by, universe, longest, t):
    sets = collection(9, universe, longest, 150)
    sets |= {300 + i: set(sets[i]) for i in range(0, 40, 3)}
    other = collection(2, universe, longest, 60) | {i: set(sets[i]) for i in range(0, 60, 7)}
    monkeypatch.setattr(blocks, "HIT_S", 1.0 if by == "product" else 0.0)
    monkeypatch.setattr(blocks, "HITS", 50)
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "SLAB", 32)
    r, s = (order.encode_ranks(order.postings(frame(spark, x)))[0] for x in (sets, other))
    one = [blocks.Block(*(np.array(c) for c in ([x.rid for x in rows], [x.n for x in rows], [y for x in rows for y in x.toks]))) for rows in (r.collect(), )][0]
    pairs = [p for x, y, o in blocks.similar(one, one, t, True, 10**6) for p in zip(one.rid[x].tolist(), one.rid[y].tolist(), o.tolist())]
    assert len(pairs) == len({frozenset(p[:2]) for p in pairs})
    want = {(i, j): o for i, j, o, _ in brute(sets, sets, t, False, True)}
    assert {(min(p[:2]), max(p[:2])): p[2] for p in pairs if p[2] >= (len(sets[p[0]]) + len(sets[p[1]]) - p[2]) * t} == want
    for strict in (True, False):
        assert got(similarity_join(frame(spark, sets), threshold=t, strict=strict, in_blocks=True)) == brute(sets, sets, t, strict, True)
        assert got(similarity_join(frame(spark, sets), frame(spark, other), threshold=t, strict=strict, in_blocks=True)) == brute(sets, other, t, strict, False)


def test_layout_of_blocks():
    places, ends = blocks.layout([(1, 10), (2, 4), (3, 100), (5, 1), (9, 3)], 30)
    assert places == [(1, 0, 1), (2, 0, 1), (3, 1, 10), (5, 11, 1), (9, 12, 1)]
    assert ends == [(1, 2), *[(3, 3)] * 10, (5, 5), (9, 9)]


@pytest.mark.parametrize(("universe", "longest", "t"), [(60, 15, 0.5), (400, 40, 0.9), (6, 4, 0.3)])
@pytest.mark.parametrize("room", [400, 10_000])
def test_records_dealt_by_tokens_are_exact(spark, monkeypatch, room, universe, longest, t):
    sets = collection(3, universe, longest, 150)
    other = collection(2, universe, longest, 60) | {i: set(sets[i]) for i in range(0, 60, 7)}
    monkeypatch.setattr(blocks, "COPIES", 1000)
    monkeypatch.setattr(blocks, "HITS", 50)
    monkeypatch.setattr(blocks.join, "__defaults__", (room,))
    monkeypatch.setattr(blocks, "_written", lambda *a: pytest.fail("not dealt by tokens"))
    for b in (None, other):
        found = similarity_join(frame(spark, sets), b and frame(spark, b), threshold=t, strict=False, in_blocks=True).collect()
        assert len(found) == len({(x.rid1, x.rid2) for x in found})
        assert {tuple(x) for x in found} == brute(sets, b or sets, t, False, not b)


def test_comparisons_of_small_records_grow_with_the_input(spark, monkeypatch):
    seen, cells = [], blocks._cells
    monkeypatch.setattr(blocks, "_cells", lambda c, *a: seen.append(len(c)) or cells(c, *a))
    monkeypatch.setattr(blocks.join, "__defaults__", (160,))
    for copies in (4, 16):
        sets = {1000 * c + i: {1000 * c + i, 1000 * c + i + 1, 1000 * c + i + 2} for c in range(copies) for i in range(100)}
        assert got(similarity_join(frame(spark, sets), threshold=0.5, strict=False, in_blocks=True)) == brute(sets, sets, 0.5, False, True)
    assert seen[1] <= 5 * seen[0]
    assert blocks.buckets_of([(4, 9_000_000)], 0.5, 4_000_000, 16) * 6 == blocks.buckets_of([(4, 54_000_000)], 0.5, 4_000_000, 16)
    assert blocks.buckets_of([(600, 9_000_000)], 0.5, 4_000_000, 16) == 0


@pytest.mark.parametrize("algorithm", GENERAL)
def test_many_pairs_are_not_shuffled(spark, monkeypatch, algorithm):
    sets = {i: {1, 2, 3, 4, 10 + i} for i in range(400)}
    monkeypatch.setattr(join, "FEW_PAIRS", 1000)
    monkeypatch.setitem(STRATEGIES, algorithm, lambda *a, **k: pytest.fail("candidates are shuffled"))
    assert got(similarity_join(frame(spark, sets), threshold=0.6, algorithm=algorithm, strict=False)) == brute(sets, sets, 0.6, False, True)


def test_records_that_share_too_few_tokens_are_left_out(spark, monkeypatch):
    parts, users = {i: {i % 50, *range(1000 + 30 * i, 1029 + 30 * i)} for i in range(200)} | {500: {1, 2, 3}}, {i: {i % 50, 1, 2, 3} for i in range(200)}
    seen = []
    full = STRATEGIES["full"]
    monkeypatch.setitem(STRATEGIES, "full", lambda r, s, *a: seen.append(r.count()) or full(r, s, *a))
    assert got(similarity_join(frame(spark, parts), frame(spark, users), threshold=0.3, algorithm="full", strict=False)) == brute(parts, users, 0.3, False, False)
    assert seen == [1]


@pytest.mark.parametrize("name", [f"{a}_users_{b}" for a in ("pivot", "prefix") for b in ("ge", "strict")] + ["group_users_half"])
def test_joins_of_copies_of_users_grow_with_the_users(spark, tmp_path, name):
    sets = {i: set(range(3 * i % 17, 3 * i % 17 + 12)) for i in range(10)}
    many = {}
    for copies in (2, 6):
        of = {100 * c + i: x for c in range(copies) for i, x in sets.items()}
        spark.createDataFrame([(i, f'{{"k": {k}}}') for i, x in of.items() for k in x], "user_id long, props string").write.parquet(f"{tmp_path}/{copies}/events.parquet")
        found = got(queries.QUERIES[name](spark, f"{tmp_path}/{copies}"))
        of_class = {i: i for i in of}
        of_class |= {b: a for a, b, _, sim in found if sim == 1.0}
        want = brute(of, of, 0.5, not name.endswith("ge"), True)
        links = {(min(of_class[a], of_class[b]), max(of_class[a], of_class[b]), o, s) for a, b, o, s in want if of_class[a] != of_class[b]}
        assert {x for x in found if x[3] < 1} == links
        assert {(a, b) for a, b, _, sim in want if sim == 1.0} == {(a, b) for a in of for b in of if a < b and of_class[a] == of_class[b]}
        many[copies] = len(found)
    assert many[6] <= 3 * many[2]


def test_differences(spark):
    a = spark.createDataFrame([(1, 2), (4, 3)], "rid1 long, rid2 long")
    b = spark.createDataFrame([(2, 1), (5, 6), (7, 7)], "rid1 long, rid2 long")
    assert {tuple(r) for r in differences(a, b).collect()} == {(3, 4, "missing"), (5, 6, "extra")}


def test_order_is_by_frequency_then_token(spark):
    sets = {1: {"a", "b"}, 2: {"b", "c"}, 3: {"b"}}
    posts = order.postings(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "rid long, tokens array<string>"))
    assert {tuple(r) for r in order.token_order(posts).collect()} == {("a", 1, 0), ("c", 1, 1), ("b", 3, 2)}
    assert {(r.rid, tuple(r.toks)) for r in order.encode(posts)[0].collect()} == {(1, ("a", "b")), (2, ("c", "b")), (3, ("b",))}
    g = random.Random(2)
    freqs = sorted(g.choice([1, 1, 2, 3, 8, 40]) for _ in range(200))
    df = spark.createDataFrame([(f"t{i:03}", f, i) for i, f in enumerate(freqs)], "token string, freq long, rank long")
    for groups in (2, 7):
        totals, want = [0] * groups, {}
        for i, f in enumerate(freqs):
            k = totals.index(min(totals))
            totals[k] += f
            want[f"t{i:03}"] = k
        assert {r.token: r.grp for r in order.token_groups(df, groups).collect()} == want


def test_wide_rows_are_stored_compressed(spark):
    g = random.Random(1)
    rows = [(i, sorted({f"word{g.randrange(3000)}" for _ in range(220)})) for i in range(300)]
    folder = lambda: Path(order.cut(spark.range(0)).sparkSession.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder().rglob("*") if f.is_file())
    before = size()
    assert similarity_join(spark.createDataFrame(rows, "rid long, tokens array<string>"), threshold=0.7, in_blocks=True).count() == 0
    assert size() - before < 16 * sum(len(x) for _, x in rows)


def test_copies_in_two_collections_are_compared_once(spark, monkeypatch):
    a, b = collection(1, 60, 12, 40), collection(2, 60, 12, 30)
    b |= {i: set(a[i]) for i in range(0, 30, 7)} | {40: {1, 2, 3}}
    b[29] = a[29] | {1000}
    a, b = ({100 * c + i: x for c in range(5) for i, x in sets.items()} for sets in (a, b))
    seen, cells = [], blocks.join
    monkeypatch.setattr(blocks, "join", lambda r, s, *rest: seen.extend([r, s]) or cells(r, s, *rest))
    monkeypatch.setattr(join, "FEW_PAIRS", 100)
    found = similarity_join(frame(spark, a), frame(spark, b), threshold=0.3, algorithm="full", strict=False).collect()
    assert len(found) == len({(x.rid1, x.rid2) for x in found})
    assert {tuple(x) for x in found} == brute(a, b, 0.3, False, False)
    assert seen[0].count() <= 40 and seen[1].count() <= 31


def test_postings_of_two_collections_are_not_shuffled(spark, monkeypatch):
    words = {i: {f"own{i}.{k}" for k in range(30)} | {f"word{k}" for k in range(i % 7, 30, 7)} for i in range(60)}
    items = {i: {f"word{k}" for k in range(i, 30, 7)} | {f"item{i}"} for i in range(7)} | {50: set()}
    frames = [spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "rid long, tokens array<string>") for sets in (words, items)]
    want = brute(words, items, 0.1, False, False)
    assert len(want) == 60
    assert got(similarity_join(*frames, threshold=0.1, strict=False, in_blocks=True)) == want
    # A vocabulary too large to send is joined with the postings.
    monkeypatch.setattr(order, "BROADCAST_TOKENS", 10)
    assert got(similarity_join(*frames, threshold=0.1, strict=False, in_blocks=True)) == want
    monkeypatch.undo()
    monkeypatch.setattr(join, "encode_ranks", lambda *a: pytest.fail("postings are shuffled"))
    assert got(similarity_join(*frames, threshold=0.1, strict=False, in_blocks=True)) == want


def test_all_similarities_of_copies_grow_with_the_users(spark, tmp_path):
    sets = {i: set(range(3 * i % 17, 3 * i % 17 + 12)) for i in range(10)} | {10: {90}}
    many = {}
    for copies in (1, 3):
        of = {100 * c + i: x for c in range(copies) for i, x in sets.items()}
        spark.createDataFrame([(i, f'{{"k": {k}}}') for i, x in of.items() for k in x], "user_id long, props string").write.parquet(f"{tmp_path}/{copies}/events.parquet")
        found = queries.QUERIES["all_similarities_users"](spark, f"{tmp_path}/{copies}").collect()
        assert {tuple(x) for x in found} == brute(sets, sets, 0.0, True, True) | {(i, 100 * c + i, len(x), 1.0) for i, x in sets.items() for c in range(1, copies)}
        many[copies] = len(found)
    assert many[3] == many[1] + 2 * len(sets)


def test_only_postings_of_rare_tokens_are_shuffled(spark, monkeypatch):
    sets = {i: {f"often{k}" for k in range(i % 9, 12)} | {f"rare{i}", f"rare{i // 2}"} for i in range(80)}
    monkeypatch.setattr(order, "BROADCAST_TOKENS", 12)
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "rid long, tokens array<string>")
    seen, ranked = [], order._ranked
    monkeypatch.setattr(order, "_ranked", lambda posts, ids, rare: seen.append((ids.where(ids.rank >= rare).count(), {r.tok for r in ids.where(ids.rank >= rare).collect()})) or ranked(posts, ids, rare))
    for in_blocks in (True, False):
        assert got(similarity_join(df, threshold=0.6, strict=False, in_blocks=in_blocks)) == brute(sets, sets, 0.6, False, True)
    assert seen == [(12, {f"often{k}" for k in range(12)})] * 2
