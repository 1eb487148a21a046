import random

from pyspark.sql import functions as F

from setloom.functions import metrics, tokenizers
from setloom.operators import order, stats
from setloom.operators.text_join import attach_text, attach_text_map_side
from setloom.sources import sets as io


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first().x


def test_tokenizers(spark):
    assert one(spark, "The first line.\nSecond line don't", tokenizers.stopped) == ["first", "line", "second", "don", "t"]
    assert one(spark, "On Set-Joins. v1.2 A joins/join", tokenizers.title_words) == ["on", "set-joins", "v12", "joins", "join"]
    assert one(spark, "joins Joins joins.", tokenizers.title_words) == ["joins", "joins1", "joins11"]
    assert one(spark, "The dog's owners don't pay 3.14 or 1,000 a_b U.S.A", tokenizers.english) == ["dog", "owner", "don't", "pai", "3.14", "1,000", "a_b", "u.s.a"]
    assert one(spark, "Été", tokenizers.utf8_token) == b"\x00\x05\xc3\xa9t\xc3\xa9"
    assert one(spark, "ab", lambda c: F.size(tokenizers.hashed_ngrams(c))) == 4
    assert one(spark, "x", lambda c: tokenizers.polynomial_hash([F.lit(-5), F.lit(7)], 1000)) == 158
    assert one(spark, " Don't stop, a_1 x", tokenizers.basic) == ["Don", "t", "stop", "a_1", "x"]
    assert one(spark, "The cat and the HAT cat", tokenizers.stopped) == ["cat", "hat"]
    assert one(spark, "7 Été, été b", lambda c: tokenizers.occurrences(c)) == ["7_1", "été_1", "été_2", "b_1"]
    assert one(spark, "7 a a", lambda c: tokenizers.occurrences(c, with_rid=True)) == ["a_1", "a_2"]
    assert one(spark, "aaa", lambda c: tokenizers.ngrams(c, 2)) == ["$a1", "aa1", "aa2", "a$1"]
    assert one(spark, "", tokenizers.ngrams) == []
    assert one(spark, "caresses ponies relational hopping the", tokenizers.english) == ["caress", "poni", "relat", "hop"]
    assert one(spark, None, tokenizers.english) == []
    assert one(spark, "Hello", lambda c: tokenizers.string_hash(c)) == 99162322
    assert one(spark, "hello", lambda c: tokenizers.hashed_words(c)) == [(99162322 * 31 + 1) % 2**32 - (2**32 if (99162322 * 31 + 1) % 2**32 >= 2**31 else 0)]
    assert set(tokenizers.TOKENIZERS) >= {"basic", "stopped", "english", "occurrences"}


def test_long_texts_number_alike(spark):
    df = spark.createDataFrame([(1, "a b a a"), (2, None)], "rid long, t string")
    assert {(r.rid, r.tok) for r in order.numbered_tokens(df, F.split("t", " ")).collect()} == {(1, "a_1"), (1, "b_1"), (1, "a_2"), (1, "a_3")}


def test_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3, 3], [2, 3, 4])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    row = df.select(metrics.jaccard(a, b), metrics.bag_jaccard(a, b), metrics.overlap(a, b), metrics.jaccard_at_least(a, b, 0.6), metrics.smallest_common(a, b), metrics.partial_overlap(a, b, F.lit(2)), metrics.cosine_like(a, b)).first()
    assert tuple(row) == (0.5, 2 / 5, 2, -1.0, 2, 1, (1 / 12) ** 2)
    words = spark.createDataFrame([(["k", "i", "t"], ["s", "i", "t", "t"]), ([], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in words.select(metrics.token_edit_distance(a, b)).collect()] == [2, 1, 1]
    assert [r[0] for r in words.select(metrics.token_edit_distance(a, b, 1)).collect()] == [-1, 1, 1]
    accents = spark.createDataFrame([("Été", "ete")], "a string, b string")
    assert tuple(accents.select(metrics.edit_distance_folded(a, b), metrics.edit_distance_bytes(a, b)).first()) == (2, 4)
    assert metrics.metric("jaccard") is metrics.jaccard


def test_sources(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1\t3,4\n2 5  some words\n\nx y\n3 a,b\n")
    lines = spark.read.text(str(tmp_path / "in.txt"))
    assert io.input_kind(lines) == io.INTEGERS
    assert {(r.rid, tuple(r.tokens), r.text) for r in io.parse_sets(lines).collect()} == {(1, (3, 4), None), (2, (5,), "some words")}
    assert io.input_kind(spark.createDataFrame([("some text",)], "value string")) == io.RAW
    assert io.input_kind(spark.createDataFrame([], "value string")) == io.UNKNOWN
    io.write_sets(io.parse_sets(lines), str(tmp_path / "sets"))
    assert io.read_sets(spark, str(tmp_path / "sets")).count() == 2
    pairs = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.5)], "rid1 long, rid2 long, sim double")
    io.write_pairs(pairs, str(tmp_path / "pairs"), with_similarity=True)
    assert [tuple(r) for r in io.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [(1, 2)]
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "1").write_text("From: x\nTo: y\n\nline one\nline two\n")
    assert [r.text for r in io.read_mail(spark, str(tmp_path / "mail")).collect()] == ["line one line two"]
    assert io.read_files(spark, str(tmp_path / "mail")).first().text.startswith("From: x To: y")


def test_text_join_and_stats(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "rid long, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "rid1 long, rid2 long")
    for f in (attach_text, attach_text_map_side):
        assert {tuple(r) for r in f(pairs, texts).collect()} == {(1, 2, "a", "b"), (2, 3, "b", None)}
    posts = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "rid long, tok int")
    assert tuple(stats.dataset_stats(posts).first()) == (2, 2, 1, 2)
    assert tuple(stats.replication_stats(posts, "tok").first()) == (2, 3, 1, 2, 1.5)
    bags = stats.zipf_sets(spark, 20, 50, 10)
    assert bags.count() == 20
    assert all(1 <= t <= 50 for r in bags.collect() for t in r.tokens)
    runs = spark.createDataFrame([("a", "d", 0.5, 1.0), ("a", "d", 0.5, 3.0)], "algorithm string, dataset string, threshold double, seconds double")
    assert tuple(stats.average_runtimes(runs).first()) == ("a", "d", 0.5, 2.0, 2)


def test_token_edit_distance_by_characters(spark):
    g = random.Random(8)
    some = lambda: [g.choice(tokens if g.random() < 0.9 else [*tokens, None]) for _ in range(g.randint(0, 9))]
    rows = []
    for tokens in (["a", "bb", "", "ccc"], ["a", "b", "é", "\U0001f600"]):
        rows += [(some(), some()) for _ in range(100)]
    df = spark.createDataFrame(rows + [(None, ["a"])], "a array<string>, b array<string>")

    def by_hand(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a):
            own = [i + 1]
            for j, y in enumerate(b):
                own.append(min(last[j + 1] + 1, own[-1] + 1, last[j] + (x is None or x != y)))
            last = own
        return last[-1]

    out = df.select("a", "b", metrics.token_edit_distance(df.a, df.b).alias("d"), metrics.token_edit_distance(df.a, df.b, 3).alias("d3"))
    for r in out.collect():
        want = None if r.a is None else by_hand(r.a, r.b)
        assert (r.d, r.d3) == (want, want if want is None or want <= 3 else -1)
    assert "levenshtein" in out._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_file_are_counted_by_many_tasks(spark, tmp_path, monkeypatch):
    from setloom.plans import queries

    spark.range(1000).selectExpr("id AS p_partkey", "concat('large ring ', id) AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(queries, "TEXTS", 50, raising=False)
    out = queries.queries()["tokens_ngrams"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 20 and out.count() == out.agg({"n": "sum"}).first()[0]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange hashpartitioning(rid" in plan and plan.count("Exchange") == 1
