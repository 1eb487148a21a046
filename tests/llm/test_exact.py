import random

import numpy as np
import pyarrow as pa
import pytest

from setloom.llm import chat_events, decontaminate, graph_ann, token_prefix
from setloom.llm.common import texts_of

# ---------------------------------------------------------------- token counts

CASES = ["", "a  b", "a \n\n b\n c", "  x  ", "it's we're I'll 'really 'lx' don't a'r 're 'l", "éèê ñandú 123 4567!!! ###", "\t\t hi\t\tz", "-" * 70 + "=" * 9, "'", "<|endoftext|> x", "日本語 テキスト 🙂🙂", "supercalifragilistic antidisestablishmentarianism", "   x"]


@pytest.fixture(scope="module")
def counter():
    return token_prefix.PrefixCounter(token_prefix.rank_lines(token_prefix.RANKS))


@pytest.mark.parametrize("text", CASES)
def test_every_prefix_counts_as_if_encoded(counter, text):
    want = [len(counter.coder.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)]
    assert counter.counts(text).tolist() == want
    packed = token_prefix.pack(counter.counts(text))
    assert token_prefix.counts_of(packed).tolist() == want
    for n in (0, 1, len(text) // 2, len(text) + 5):
        assert token_prefix.count_at(packed, n) == len(counter.coder.encode_ordinary(text[:n]))
    for budget in (0, 1, 3, 10**6):
        assert token_prefix.longest_within(np.array(want), budget) == max([i + 1 for i, c in enumerate(want) if c <= budget], default=0)


def test_random_texts(counter):
    g = random.Random(1)
    for _ in range(150):
        text = "".join(g.choice("aeiou th'sre  \n!1é") for _ in range(g.randint(1, 40)))
        assert counter.counts(text).tolist() == [len(counter.coder.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)], repr(text)


def test_pieces_are_forgotten(counter):
    few = token_prefix.PrefixCounter(token_prefix.rank_lines(token_prefix.RANKS), remembered_chars=50)
    for text in ["one two three " * 5, "abcdefgh" * 20, "one two three " * 5]:
        assert few.counts(text).tolist() == counter.counts(text).tolist()
        assert few.used <= 50 + 2 * len(text)


def test_token_cases(spark, tmp_path):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (5, "word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS id")
    got = {r.doc_id: r for r in token_prefix.token_prefixes(df).collect()}
    assert (got[1].tokens, got[2].tokens, got[3].tokens, got[None].tokens, got[5].tokens) == (2, None, 0, 1, 30001)
    assert (got[1].chars_256, got[5].chars_1024, got[2].chars_256) == (11, 1024 * 5 - 1, None)
    assert token_prefix.token_prefixes(df.limit(0)).count() == 0
    # Only the driver needs the rank file.
    (tmp_path / "ranks").write_bytes(token_prefix.rank_lines(token_prefix.RANKS))
    planned = token_prefix.token_prefixes(df, ranks=str(tmp_path / "ranks"))
    (tmp_path / "ranks").unlink()
    assert planned.where("doc_id = 1").first().tokens == 2


# ---------------------------------------------------------------- chats


def fold_all(events):
    """Replays a log for each prefix of its life, by a list of messages."""
    out = []
    for kind, message, role, text in events:
        at = next((i for i, m in enumerate(out) if m[0] == message), None)
        if kind == "message" and at is not None:
            out[at][2] = text
        elif kind in ("message", "delta") and at is None:
            out.append([message, None, text])
            at = len(out) - 1
        elif kind == "delta":
            out[at][2] += text
        elif at is None or kind not in ("edit", "regenerate", "delete"):
            continue
        elif kind == "delete":
            del out[at]
            continue
        else:
            del out[at + 1 :]
            out[at][2] = text
        if role is not None:
            out[at][1] = role
    return "".join(f"<|im_start|>{'unknown' if r is None else r}\n{t}<|im_end|>\n" for _, r, t in out)


EVENTS = "conv_id long, seq long, kind string, message_id string, role string, text string"


def test_folds_are_those_of_a_replay(spark):
    g = random.Random(3)
    rows, want = [], {}
    for c in range(60):
        log = [(g.choice(["message", "delta", "delta", "edit", "regenerate", "delete", "other"]), g.choice("abcd"), g.choice(["user", "assistant", "", None]), g.choice(["x", "yy ", "", "z\n"])) for _ in range(g.randint(1, 14))]
        want[c] = fold_all(log)
        rows += [(c, i, *e) for i, e in enumerate(log)]
    rows += rows[::3]
    g.shuffle(rows)
    assert {r.conv_id: r.rendered for r in chat_events.chats(spark.createDataFrame(rows, EVENTS).repartition(7)).collect()} == want


def test_chat_cases(spark):
    rows = [(1, 0, None, None, None, None), (2, None, "message", "a", "user", "first"), (2, 1, "delta", "a", None, "<|im_end|>"), (None, 1, "message", "a", "user", "lost"), (3, 1, "edit", "gone", "user", "x"), (4, 1, "message", "m", "user", "t" * 200000), (5, 1, "message", "m", "", "x"), (5, 2, "", "m", "user", "y")]
    got = {r.conv_id: (r.messages, r.rendered) for r in chat_events.chats(spark.createDataFrame(rows, EVENTS).selectExpr("*", "1 AS messages", "2 AS rendered")).collect()}
    assert got[1] == (1, "<|im_start|>unknown\n<|im_end|>\n")
    assert got[2] == (1, "<|im_start|>user\nfirst<| im_end|><|im_end|>\n")
    assert got[3] == (0, "")
    assert len(got[4][1]) > 200000
    assert got[5] == (1, "<|im_start|>\nx<|im_end|>\n")
    assert set(got) == {1, 2, 3, 4, 5}
    assert chat_events.chats(spark.createDataFrame([], EVENTS)).count() == 0


# ---------------------------------------------------------------- neighbours


def vectors(n, d=24, seed=0):
    g = np.random.default_rng(seed)
    centre = g.normal(0, 1, (10, d))
    return (centre[g.integers(0, 10, n)] + g.normal(0, 0.8, (n, d))).astype(np.float32)


def recall(got, x, ids):
    d = ((x[ids].astype(np.float64)[:, None, :] - x[None]) ** 2).sum(-1) ** 0.5
    d[np.arange(len(ids)), ids] = np.inf
    best = np.argsort(d, axis=1)[:, :10]
    for at, i in enumerate(ids):
        assert [k for k, _, _ in sorted(got[i])] == list(range(1, 11))
        assert all(abs(d[at, n] - dist) < 1e-4 for _, n, dist in got[i])
    return np.mean([len({n for _, n, _ in got[i]} & set(best[at].tolist())) / 10 for at, i in enumerate(ids)])


@pytest.mark.parametrize(("n", "d", "options"), [(3000, 24, {"shard_rows": 800, "query_every": 1}), (18000, 32, {}), (18000, 32, {"block_bytes": 4000})])
def test_recall_against_brute_force(spark, n, d, options):
    x = vectors(n, d)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in graph_ann.neighbours(df, **options).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour, r.distance))
    ids = np.arange(0, n, options.get("query_every", 100))
    assert set(got) == set(ids.tolist())
    assert recall(got, x, ids[:: max(1, len(ids) // 400)].tolist()) >= 0.9


def test_recall_on_the_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(df.collect(), key=lambda r: r.vec_id)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = {}
    for r in graph_ann.neighbours(df).collect():
        got.setdefault(at[r.vec_id], []).append((r["rank"], at[r.neighbour], r.distance))
    asked = [at[r.vec_id] for r in rows if r.vec_id % 100 == 0]
    assert sorted(got) == asked
    assert recall(got, np.array([r.embedding for r in rows], np.float32), asked) >= 0.9


def test_neighbour_cases(spark):
    same = [0.5, 0.5]
    rows = [(i, same) for i in range(30)] + [(40, [1.0, 0.0]), (40, [1.0, 0.0]), (41, None), (None, same), (42, [1.0]), (43, [float("nan"), 1.0]), (44, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS shard", "4 AS rank")
    got = {}
    for r in graph_ann.neighbours(df, k=3, query_every=1).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour, r.distance))
    assert set(got) == {*range(30), 40}
    assert sorted(got[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)]
    assert sorted(got[2]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 3, 0.0)]
    assert [n for _, n, _ in sorted(got[40])] == [0, 1, 2]
    few = graph_ann.neighbours(df.where("vec_id in (1, 40)"), k=3, query_every=1).collect()
    assert {(r.vec_id, r.neighbour) for r in few} == {(1, 40), (40, 1)}
    assert {r.vec_id for r in graph_ann.neighbours(df, k=3, query_every=20).collect()} == {0, 20, 40}
    assert graph_ann.neighbours(df.where("vec_id = 1")).count() == 0
    assert graph_ann.neighbours(df.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def distance_within(pattern, text):
    """Edit distance of a pattern to the closest part of a text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, x in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x))
        row = new
    return int(row.min())


def test_leaks_are_those_of_brute_force(monkeypatch):
    g = random.Random(5)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(g.randint(8, 40)))) for i in range(12)]
    docs = []
    for k in range(40):
        passage = list(items[k % 12][1])
        for _ in range(k // 4):
            p = g.randrange(len(passage))
            passage[p : p + g.choice([0, 1, 1])] = g.choice(["", "x", "qz"])
        docs.append(" ".join(word() for _ in range(g.randint(0, 40))) + " " + "".join(passage) + ". " + " ".join(word() for _ in range(20)))
    docs += [" ".join(word() for _ in range(60)) for _ in range(10)]
    ix = decontaminate.index(items)
    raw, offs = texts_of(pa.array(docs))
    got = {(d, item): e for d, item, _, e in decontaminate.found(ix, raw, offs)}
    monkeypatch.setattr(decontaminate, "PLACES", 400)
    assert {(d, item): e for d, item, _, e in decontaminate.found(ix, raw, offs)} == got
    want = {}
    for d, text in enumerate(docs):
        n = " ".join("".join(c if c.isalnum() else " " for c in text).split())
        for w, item in enumerate(ix.items):
            e = distance_within(bytes(ix.text[w]).decode(), n)
            if e <= ix.budget[w]:
                want[d, item] = min(e, want.get((d, item), 99))
    assert got == want
    assert len(want) > 15


def test_leak_cases(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away from the angry bear"
    bench = spark.createDataFrame([(1, passage), (2, "short"), (3, None), (4, ""), (None, passage), (5, passage)], "item_id long, text string")
    rows = [(1, "Before: " + passage.upper() + "!"), (1, "Before: " + passage.upper() + "!"), (2, None), (3, ""), (None, passage), (5, "word " * 100000 + passage), (6, "short and clean"), (7, passage[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS id", "3 AS edits")
    want = sorted([(1, i, 1, 0) for i in (0, 1, 5)] * 2 + [(i, j, 1, 0) for i in (0, 5) for j in (0, 1, 5)])
    for size in (decontaminate.PART_BYTES, 40):
        assert sorted(((r.doc_id or 0), r.item_id or 0, r.windows, r.edits) for r in decontaminate.leaks(docs, bench, part_bytes=size).collect()) == want
        clean = decontaminate.drop_leaks(docs, bench, part_bytes=size)
        assert clean.columns == docs.columns
        assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 6, 7]
    only = bench.where("item_id is null")
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, only).collect()) == [2, 3, 6, 7]
    assert {tuple(r) for r in decontaminate.too_short(bench).collect()} == {(2, 5), (3, 0), (4, 0)}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_a_pair_of_tokens_is_tried_once():
    own = token_prefix.PrefixCounter(token_prefix.rank_lines(token_prefix.RANKS))
    asked, can_follow = [], own.can_follow
    own.can_follow = lambda one, raw, two: asked.append((one, two)) or can_follow(one, raw, two)
    words = ["xqzvkworble", "unthinkxqzable", "xqzvkworbles", "Zrgblthinkyx"]
    for w in words:
        assert own.piece(w.encode()) == [len(own.coder.encode_ordinary(w[: i + 1])) for i in range(len(w))]
    assert asked and len(asked) == len(set(asked))
