"""Mixing to target weights by iterative proportional fitting.

Tokens (words) are added up by (source, language, topic). A document is drawn with probability ``min(1, a * b * c)``, factors of
its source, language and topic; the draw compares it with a number that only the id and the seed decide. Raking adjusts
the factors of one dimension after the other, under the bound of 1, until the expected tokens drawn of every value are ``keep``
of all tokens times the value's target share. So it is the drawn shares that meet the targets, not weights before a cut at 1.

Targets are maps from a value to a weight; a value that the map lacks, or every value without a map, weighs its mean share:
``blend`` of an even and the rest of its natural share. A target beyond what a value has (all its tokens drawn) is
lowered to that, and the others share the difference. ``marginals`` reports natural, target and drawn shares; targets of different
dimensions that exclude each other are met as closely as ``rounds`` come.

Topics. ``topic_col`` names a column of topics, taken as strings. Without one, documents are clustered: TF-IDF weights of the words
of five letters or more, with document frequencies of all texts (in ``2^16`` hashed slots), projected on 64 random signs, less
the mean of the document's language, so that a topic is not just a language again; then ``topics`` clusters by
cosine (k-means, its sums over all documents; only the starting centres come from ``STARTS`` rows of least hash). Vectors are
whole numbers and their sums exact, so topics do not depend on partitions. Documents without such a word have topic "none".

The table of cells goes to the driver up to ``driver_cells`` rows; a larger one is raked by Spark to the same factors, up
to ``TOLERANCE``. Either way the factors are joined to every row by its own values: nothing depends on the size.

Cases: a null source or language counts as "", a null or empty text as no topic; a document without a word has no weight to
calibrate and is drawn with probability ``keep``. A null id draws like the id 0; repeated rows share their draw. An
empty table gives an empty result. Values are compared as Spark casts them to strings. Other columns are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import U, add_vectors, arrow_map, cut, fold, rows_of, slices, texts_of, unused, word_hashes, word_spans

TOPICS, ROUNDS, TOLERANCE, KEEP, BLEND, SEED, DRIVER_CELLS = 8, 200, 1e-6, 0.7, 0.3, "mix", 500_000
DIMENSIONS = ("source", "lang", "topic")
NO_TOPIC = "none"
SLOTS, WIDTH, STARTS, PASSES, UNIT = 1 << 16, 64, 4096, 4, 1 << 12
#: Rows of factors that are broadcast (about 50 bytes each); more are joined by a shuffle.
BROADCAST_VALUES = 1_000_000
_cache: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- topics


def _long_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; text, slot and count of each different long word of a text)."""
    b = fold(raw)
    starts, ends, woff = word_spans(b, offs)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(woff))
    letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    long = letters[ends] - letters[starts] >= 5
    slot = (word_hashes(b, starts[long], ends[long]) >> U(40)).astype(np.int64) & (SLOTS - 1)
    key, tf = np.unique(owner[long] * SLOTS + slot, return_counts=True)
    return np.diff(woff), key // SLOTS, key % SLOTS, tf


def _signs() -> np.ndarray:
    if "signs" not in _cache:
        _cache["signs"] = np.random.Generator(np.random.PCG64(17)).choice(np.array([-1, 1], np.float32), (SLOTS, WIDTH))
    return _cache["signs"]


def text_vectors(raw: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(projected TF-IDF vector of each text, of length UNIT and in whole numbers, or 0; words of each text)."""
    words, owner, slot, tf = _long_words(raw, offs)
    out = np.zeros((len(words), WIDTH), np.float32)
    weight = ((1 + np.log(tf)) * idf[slot]).astype(np.float32)
    for lo in range(0, len(owner), 1 << 16):
        o = owner[lo : lo + (1 << 16)]
        first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        out[o[first]] += np.add.reduceat(_signs()[slot[lo : lo + (1 << 16)]] * weight[lo : lo + (1 << 16), None], first, axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.rint(out / np.maximum(norm, 1e-9) * UNIT).astype(np.int64), words


_VECTOR = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("vector", pa.binary())])


def _count_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        raw, offs = texts_of(batch.column(0))
        for lo, hi in slices(offs):
            _, owner, slot, _ = _long_words(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            counts += np.bincount(slot, minlength=SLOTS)
            n += len(np.unique(owner))
    yield rows_of(_VECTOR, piece=[""], n=[n], vector=[counts.tobytes()])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """idf by slot, from all texts."""
    sums = add_vectors(arrow_map(texts, _count_df, "piece string, n long, vector binary"), "int64", texts.rdd.getNumPartitions())
    n, counts = sums.get("", (0, np.zeros(SLOTS, np.int64)))
    return np.log((1 + n) / (1 + counts)).clip(0.05).astype(np.float32)


def centred(x: np.ndarray, langs: list[str], means: dict[str, np.ndarray]) -> np.ndarray:
    """Vectors (whole numbers) less their languages' means, of length 1 where they aren't 0."""
    names, code = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    zero = np.zeros(WIDTH)
    mean = np.array([means.get(name, zero) for name in names.tolist()]).reshape(-1, WIDTH)
    out = x - mean[code] if len(x) else x.astype(float)
    out[~x.any(1)] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def nearest(x: np.ndarray, langs: list[str], model: dict) -> np.ndarray:
    """The cluster of each vector, -1 for none."""
    return np.where(x.any(1), (centred(x, langs, model["means"]) @ model["centres"].T).argmax(1), -1)


def _vectors_in(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, WIDTH).astype(np.int64)


def _sums(model: dict | None):
    """Sums of vectors by language; with a model, of centred ones (in UNITs) by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            langs, x = batch.column(0).to_pylist(), _vectors_in(batch.column(1))
            some = x.any(1)
            keys = np.array(langs, object).astype(str) if model is None else nearest(x, langs, model).astype(str)
            v = x if model is None else np.rint(centred(x, langs, model["means"]) * UNIT).astype(np.int64)
            for k in np.unique(keys[some]).tolist():
                own = total.setdefault(k, [0, np.zeros(WIDTH, np.int64)])
                at = some & (keys == k)
                own[0] += int(at.sum())
                own[1] += v[at].sum(0)
        yield rows_of(_VECTOR, piece=list(total), n=[t[0] for t in total.values()], vector=[t[1].tobytes() for t in total.values()])

    return run


def topic_model(vectors: DataFrame, topics: int) -> dict:
    """Means by language and centres, from (lang, vector) of all documents."""
    schema, tasks = "piece string, n long, vector binary", vectors.rdd.getNumPartitions()
    means = {k: v / n for k, (n, v) in add_vectors(arrow_map(vectors, _sums(None), schema), "int64", tasks).items()}
    some = vectors.where(F.col("vector") != F.lit(bytes(2 * WIDTH))).select("lang", "vector").distinct()
    start = some.orderBy(F.xxhash64("vector", "lang"), "vector", "lang").limit(STARTS).toArrow()
    if not start.num_rows:
        return {"means": means, "centres": np.zeros((1, WIDTH))}
    x = centred(_vectors_in(start.column("vector").combine_chunks()), start.column("lang").to_pylist(), means)
    centres = [x[0]]
    while len(centres) < topics:  # each next one is the row least like those before
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    model = {"means": means, "centres": np.array(centres)}
    for _ in range(PASSES):
        sums = add_vectors(arrow_map(vectors, _sums(model), schema), "int64", tasks)
        centres = model["centres"].copy()
        for k, (_, v) in sums.items():
            length = np.linalg.norm(v)
            if length > 0:
                centres[int(k)] = v / length
        model = model | {"centres": centres}
    return model


# ---------------------------------------------------------------- describing


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def describer(docs: DataFrame, text_col: str, lang_col: str, topic_col: str | None, topics: int) -> dict | None:
    """What tells a text's topic: {idf, means, centres}, or None with a topic column."""
    if topic_col is not None:
        return None
    idf = document_frequencies(docs.select(F.col(text_col).cast("string")))
    idf_of = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = texts_of(batch.column(1))
            found = [text_vectors(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], idf_of.value)[0] for lo, hi in slices(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for f in found for v in f.astype(np.int16)], pa.binary())], names=["lang", "vector"])

    vectors = cut(arrow_map(docs.select(_text(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")), run, "lang string, vector binary"))
    return topic_model(vectors, topics) | {"idf": idf}


def describe(batch: pa.RecordBatch, text_at: int, lang_at: int, topic_at: int | None, model: dict | None) -> tuple[pa.Array, pa.Array]:
    """(topic, words) of each row."""
    raw, offs = texts_of(batch.column(text_at))
    langs = batch.column(lang_at).to_pylist()
    topic, words = [], []
    for lo, hi in slices(offs):
        part = raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        if model is None:
            words.append(np.diff(word_spans(fold(part[0]), part[1])[2]))
            continue
        x, n = text_vectors(*part, model["idf"])
        words.append(n)
        topic += [str(t) if t >= 0 else NO_TOPIC for t in nearest(x, langs[lo:hi], model).tolist()]
    tokens = pa.array(np.concatenate(words) if words else np.zeros(0), pa.int64())
    return pa.array(topic, pa.string()) if topic_at is None else batch.column(topic_at), tokens


def described(docs: DataFrame, model: dict | None, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> DataFrame:
    """(id, source, lang, topic, tokens) of each row. Written once: counting and drawing both read it."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    topic = _text(topic_col) if topic_col else F.lit(None).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), _text(source_col).alias("source"), _text(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), topic.alias("topic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = describe(batch, 3, 2, None if topic_col is None else 4, model_of.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], t, n], names=["id", "source", "lang", "topic", "tokens"])

    return cut(arrow_map(own, run, "id long, source string, lang string, topic string, tokens long"))


# ---------------------------------------------------------------- targets and raking


def wanted_shares(natural: np.ndarray, given: np.ndarray, keep: float, blend: float) -> np.ndarray:
    """Target shares, adding to 1: the weights given (NaN: the mean share), lowered to natural / keep where above it."""
    mean = blend / len(natural) + (1 - blend) * natural
    want = np.where(np.isnan(given), mean, given)
    want = want / want.sum() if want.sum() > 0 else mean
    most = natural / min(keep, 1.0)
    for _ in range(len(natural)):
        over = want > most
        rest = want[~over].sum()
        if not (want > most * (1 + 1e-12)).any() or rest <= 0:
            break
        want = np.where(over, most, want * (1 - most[over].sum()) / rest)
    return np.minimum(want, most)


def step(f: np.ndarray, got: np.ndarray, slope: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Newton's step for the factor at which a concave amount is the target; the chord's where that leads below 0."""
    newton = f + np.divide(target - got, slope, out=np.full_like(f, -1.0), where=slope > 0)
    chord = f * np.divide(target, got, out=np.ones_like(f), where=got > 0)
    return np.clip(np.where((newton > 0) & (slope > 0), newton, chord), 1e-12, 1e12)


def rake(codes: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], rounds: int, tolerance: float) -> list[np.ndarray]:
    """Factors by value of each dimension with ``sum(tokens * min(1, product)) = targets``; codes: value numbers of each cell."""
    factors = [np.ones(len(t)) for t in targets]
    factors[0] *= targets[0].sum() / tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for d, target in enumerate(targets):
            for inner in range(6):
                w = np.prod([f[codes[:, i]] for i, f in enumerate(factors)], axis=0)
                got = np.bincount(codes[:, d], weights=tokens * np.minimum(1, w), minlength=len(target))
                if not inner:
                    worst = max(worst, float(np.abs(got - target).max()) / tokens.sum())
                f = factors[d]
                slope = np.bincount(codes[:, d], weights=np.where(w < 1, tokens * w, 0), minlength=len(target)) / f
                factors[d] = step(f, got, slope, target)
        if worst < tolerance:
            break
    return factors


def _product(names: list[str]) -> Column:
    out = F.lit(1.0)
    for name in names:
        out = out * F.coalesce(F.col(name), F.lit(1.0))
    return out


def _joined(df: DataFrame, factors: list[DataFrame], columns: tuple[str, ...] = DIMENSIONS, prefix: str = "_f") -> DataFrame:
    """df with the factor of each of its values; few factors are broadcast, many joined (AQE splits hot values)."""
    for i, (d, f) in enumerate(zip(columns, factors)):
        side = f.select(F.col("value").alias(f"{prefix}v{i}"), F.col("factor").alias(f"{prefix}{i}"))
        df = df.join(F.broadcast(side) if f.count() <= BROADCAST_VALUES else side, F.col(d) == F.col(f"{prefix}v{i}"), "left").drop(f"{prefix}v{i}")
    return df


def rake_by_spark(cells: DataFrame, targets: list[DataFrame], total: int, rounds: int, tolerance: float) -> list[DataFrame]:
    """The same by Spark: (value, factor) of each dimension; targets (value, target) in tokens. Cells stay distributed."""
    size = targets[0].agg(F.sum("target")).first()[0]
    factors = [cut(t.select("value", F.lit(size / total if not i else 1.0).alias("factor"))) for i, t in enumerate(targets)]
    newton = F.col("factor") + (F.col("target") - F.col("got")) / F.col("slope")
    chord = F.col("factor") * F.when(F.col("got") > 0, F.col("target") / F.col("got")).otherwise(1.0)
    better = F.least(F.greatest(F.when((F.col("slope") > 0) & (newton > 0), newton).otherwise(chord), F.lit(1e-12)), F.lit(1e12))
    for _ in range(rounds):
        worst = 0.0
        for i, d in enumerate(DIMENSIONS):
            w = _joined(cells, factors).withColumn("_w", _product(["_f0", "_f1", "_f2"]))
            got = w.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("_w"))).alias("got"), F.sum(F.when(F.col("_w") < 1, F.col("tokens") * F.col("_w")).otherwise(0.0)).alias("_s"))
            now = cut(got.join(targets[i], "value").join(factors[i], "value").withColumn("slope", F.col("_s") / F.col("factor")))
            worst = max(worst, (now.agg(F.max(F.abs(F.col("got") - F.col("target")))).first()[0] or 0.0) / total)
            factors[i] = cut(now.select("value", better.alias("factor")))
        if worst < tolerance:
            break
    return factors


def _targets_by_spark(cells: DataFrame, d: str, given: dict | None, total: int, keep: float, blend: float) -> DataFrame:
    shares = cut(cells.groupBy(F.col(d).alias("value")).agg((F.sum("tokens") / F.lit(float(total))).alias("natural")))
    mean = F.lit(blend / shares.count()) + (1 - blend) * F.col("natural")
    if given:
        rows = shares.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], "value string, given double")
        shares = shares.join(F.broadcast(rows), "value", "left").withColumn("want", F.coalesce("given", mean))
        if not shares.agg(F.sum("want")).first()[0] > 0:
            shares = shares.withColumn("want", mean)
    else:
        shares = shares.withColumn("want", mean)
    most = F.col("natural") / min(keep, 1.0)
    size = shares.agg(F.sum("want")).first()[0]
    out = cut(shares.select("value", "natural", (F.col("want") / F.lit(size)).alias("want")))
    over = F.col("want") > most
    for _ in range(200):
        s = out.agg(F.sum(F.when(over, most)).alias("most"), F.sum(F.when(~over, F.col("want"))).alias("rest"), F.max(F.col("want") > most * (1 + 1e-12)).alias("some")).first()
        if not s["some"] or not s["rest"]:
            break
        out = cut(out.withColumn("want", F.when(over, most).otherwise(F.col("want") * F.lit((1 - s["most"]) / s["rest"]))))
    return out.select("value", (F.least("want", most) * F.lit(min(keep, 1.0) * total)).alias("target"))


def calibrated(table: DataFrame, *, sources: dict | None = None, langs: dict | None = None, topic_weights: dict | None = None, keep: float = KEEP, blend: float = BLEND, rounds: int = ROUNDS, tolerance: float = TOLERANCE, driver_cells: int = DRIVER_CELLS) -> tuple[list[DataFrame], list[DataFrame]]:
    """((value, factor), (value, target in tokens)) of each dimension of a described table."""
    spark = table.sparkSession
    cells = cut(table.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        none = spark.createDataFrame([], "value string, factor double")
        return [none] * 3, [none.withColumnRenamed("factor", "target")] * 3
    asked = (sources, langs, topic_weights)
    if n > driver_cells:
        targets = [cut(_targets_by_spark(cells, d, given, total, keep, blend)) for d, given in zip(DIMENSIONS, asked)]
        return rake_by_spark(cells, targets, total, rounds, tolerance), targets
    rows = cells.toArrow()
    tokens = rows.column("tokens").to_numpy().astype(float)
    values, codes, targets = [], [], []
    for d, given in zip(DIMENSIONS, asked):
        names, code = np.unique(np.array(rows.column(d).to_pylist(), object).astype(str), return_inverse=True)
        natural = np.bincount(code, weights=tokens) / total
        said = {str(k): float(v) for k, v in (given or {}).items()}
        want = wanted_shares(natural, np.array([said.get(v, np.nan) for v in names.tolist()]), keep, blend)
        values.append(names.tolist()), codes.append(code), targets.append(want * min(keep, 1.0) * total)
    # One order of the cells, whatever the order of their arrival, so that sums are the same each time.
    order = np.lexsort(codes)
    factors = rake(np.column_stack(codes)[order], tokens[order], targets, rounds, tolerance)
    table_of = lambda parts, name: [spark.createDataFrame(list(zip(v, map(float, p))), f"value string, {name} double") for v, p in zip(values, parts)]
    return table_of(factors, "factor"), table_of(targets, "target")


# ---------------------------------------------------------------- drawing


def draw(id_column: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the id and the seed decide: the first 52 bits of an MD5 sum."""
    code = F.md5(F.concat_ws(":", F.coalesce(id_column, F.lit(0)).cast("string"), F.lit(seed)).cast("binary"))
    return F.conv(F.substring(code, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _probability(tokens: str, keep: float, prefix: str = "_f") -> Column:
    return F.when(F.col(tokens) > 0, F.least(F.lit(1.0), _product([f"{prefix}{i}" for i in range(3)]))).otherwise(F.lit(min(1.0, keep)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, *, topics: int = TOPICS, seed: str = SEED, keep: float = KEEP, **parameters: object) -> DataFrame:
    """(id_col, source, lang, topic, tokens, probability, selected) for each row of docs."""
    model = describer(docs, text_col, lang_col, topic_col, topics)
    table = described(docs, model, id_col, text_col, source_col, lang_col, topic_col)
    factors = calibrated(table, keep=keep, **parameters)[0]
    p = _probability("tokens", keep)
    return _joined(table, factors).select(F.col("id").alias(id_col), *DIMENSIONS, "tokens", F.round(p, 6).alias("probability"), (draw(F.col("id"), seed) < p).alias("selected"))


def marginals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, *, topics: int = TOPICS, keep: float = KEEP, **parameters: object) -> DataFrame:
    """(dimension, value, natural, target, drawn): shares of tokens, the drawn ones expected, of what is drawn."""
    table = described(docs, describer(docs, text_col, lang_col, topic_col, topics), id_col, text_col, source_col, lang_col, topic_col)
    factors, targets = calibrated(table, keep=keep, **parameters)
    cells = cut(_joined(table.where("tokens > 0"), factors).select(*DIMENSIONS, "tokens", (F.col("tokens") * _probability("tokens", keep)).alias("expected")))
    total, expected = cells.agg(F.sum("tokens"), F.sum("expected")).first()
    out = None
    for d, target in zip(DIMENSIONS, targets):
        goal = target.agg(F.sum("target")).first()[0]
        own = cells.groupBy(F.col(d).alias("value")).agg((F.sum("tokens") / F.lit(float(total or 1))).alias("natural"), (F.sum("expected") / F.lit(float(expected or 1))).alias("drawn"))
        one = own.join(target, "value").select(F.lit(d).alias("dimension"), "value", "natural", (F.col("target") / F.lit(goal or 1.0)).alias("target"), "drawn")
        out = one if out is None else out.unionByName(one)
    return out


def draw_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, *, topics: int = TOPICS, seed: str = SEED, keep: float = KEEP, **parameters: object) -> DataFrame:
    """The rows of docs, with all columns, that are drawn, each by its own values. Texts are shuffled only if factors are too many to broadcast."""
    model = describer(docs, text_col, lang_col, topic_col, topics)
    factors = calibrated(described(docs, model, id_col, text_col, source_col, lang_col, topic_col), keep=keep, **parameters)[0]
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    columns, mark = docs.columns, unused("_mix", docs.columns)
    more = [f"{mark}{x}" for x in ("source", "lang", "topic", "tokens")]
    n, text_at = len(columns), columns.index(text_col)
    topic = _text(topic_col) if topic_col else F.lit(NO_TOPIC)
    wide = docs.select("*", _text(source_col).alias(more[0]), _text(lang_col).alias(more[1]), topic.alias(more[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, words = describe(batch, text_at, n + 1, None if topic_col is None else n + 2, model_of.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n + 2)], t, words], names=[*columns, *more])

    kinds = wide.withColumn(more[3], F.lit(0).cast("long")).schema
    for field in kinds.fields[n:]:
        field.nullable = True
    out = _joined(arrow_map(wide, run, kinds), factors, tuple(more[:3]), f"{mark}f")
    return out.where(draw(F.col(id_col).cast("long"), seed) < _probability(more[3], keep, f"{mark}f")).select(*columns)
