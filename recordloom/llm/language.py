"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams (one to three characters) of a text, in lower case and with every run of other characters than letters as
one blank, are hashed into ``WIDTH`` numbers. A text's value for an n-gram is its share of the text's n-grams times its inverse document
frequency, which is counted over all rows to learn from. Weights are trained with follow-the-regularised-leader (the
proximal form, with a rate of its own for each coordinate) under an elastic net, on a bounded sample: about
``per_language`` rows of every language, picked by the hash of the id, or
all rows where there are fewer. A part of the sample that is not trained on sets the temperature that calibrates the
probabilities.

Defined results. A text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to
learn from. A null id is in fold 0. Equal rows get equal results; an empty table gives an empty result; further columns
are not looked at. Texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, map_batches, table

WIDTH = 1 << 16
_STEP, _SPREAD = np.uint64(0x110003), np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


_tables: list[np.ndarray] = []


def _code_tables() -> list[np.ndarray]:
    """For every code point its lower-case form if it is a letter, else a blank; made once in a worker."""
    if not _tables:
        lower = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x110000))]
        letter = [c.isalpha() for c in map(chr, range(0x110000))]
        _tables.append(np.where(letter, lower, 32).astype(np.uint64))
    return _tables


def text_grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a text, with repeats; None for a text without a letter.

    Letters are taken in lower case and every run of other characters is one blank, as is each end of the text.
    """
    if not text:
        return None
    codes = _code_tables()[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    blank = codes == 32
    codes = codes[np.append(True, ~(blank[1:] & blank[:-1]))]
    if len(codes) < 2:
        return None
    two = codes[:-1] * _STEP + codes[1:]
    three = two[:-1] * _STEP + codes[2:]
    return np.concatenate([((g * _SPREAD) >> np.uint64(48)).astype(np.int32) for g in (codes, two + np.uint64(1 << 40), three + np.uint64(1 << 41))])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # idf times weight, a row for each n-gram
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = text_grams(text) if self.languages else None
        if grams is None:
            return UNKNOWN, 0.0
        p = softmax((self.weights[grams].sum(axis=0) / len(grams) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 2.0, beta: float = 1.0,
    l1: float = 1e-4, l2: float = 1e-4, epochs: int = 3, seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from sparse (columns, values) rows."""
    z, n = np.zeros((WIDTH + 1, classes)), np.zeros((WIDTH + 1, classes))

    def weights(cols):
        zc = z[cols]
        return -np.sign(zc) * np.maximum(np.abs(zc) - l1, 0) / ((beta + np.sqrt(n[cols])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            cols, values = np.append(rows[i][0], WIDTH), np.append(rows[i][1], 1.0)
            w = weights(cols)
            slope = softmax(values @ w)
            slope[labels[i]] -= 1
            g = values[:, None] * slope
            sigma = (np.sqrt(n[cols] + g * g) - np.sqrt(n[cols])) / alpha
            z[cols] += g - sigma * w
            n[cols] += g * g
    w = weights(np.arange(WIDTH + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, out of a fine grid, with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _frequencies(batches):
    """How many texts of a partition hold each n-gram."""
    counts = np.zeros(WIDTH, np.int64)
    for batch in batches:
        for text in batch.column(0):
            grams = text_grams(text.as_py())
            if grams is not None:
                seen = np.zeros(WIDTH, bool)
                seen[grams] = True
                counts += seen
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], names=["gram", "n"])


def _gram_counts():
    def work(cols):
        grams, counts = [], []
        for text in cols["_text"]:
            found = text_grams(text)
            g, c = ([], []) if found is None else np.unique(found, return_counts=True)
            grams.append(g)
            counts.append(c)
        return {"_id": cols["_id"], "lang": cols["lang"], "grams": grams, "counts": counts}

    return work


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 1000) -> Model:
    """Fit on about ``per_language`` rows of every language that occurs in ``docs``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and lang <> 'und'")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((WIDTH, 0)), np.zeros(0))
    frequencies = rows.select("_text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = frequencies.toPandas()  # at most WIDTH rows
    idf = np.zeros(WIDTH)
    idf[found.gram.to_numpy(np.int64)] = np.log((1 + sum(sizes.values())) / (1 + found.n.to_numpy(np.float64))) + 1
    shares = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    share = shares[F.col("lang")]
    picked = rows.where(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30)) < share * (1 << 30))
    # Of several rows of an id in a language the one with the least text is taken, whatever came first.
    picked = picked.groupBy("_id", "lang").agg(F.min("_text").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, lang string, grams array<int>, counts array<int>"
    sample = map_batches(picked, _gram_counts, schema).orderBy("_id", "lang").select("lang", "grams", "counts").toArrow()
    columns = [sample.column(c).combine_chunks() for c in ("grams", "counts")]
    starts = [c.offsets.to_numpy() - c.offsets[0].as_py() for c in columns]
    flat = [c.flatten().to_numpy() for c in columns]  # kept as arrays: Python numbers would take ten times the memory
    data, labels = [], []
    for i, lang in enumerate(sample.column("lang").to_pylist()):
        cols, counts = (x[o[i] : o[i + 1]] for x, o in zip(flat, starts))
        if len(cols):
            data.append((cols, counts / counts.sum() * idf[cols]))
            labels.append(languages.index(lang))
    if not data:
        return Model([], np.zeros((WIDTH, 0)), np.zeros(0))
    labels = np.array(labels)
    # The sample is in the order of ids, so every fifth row is as good as a random part.
    held = np.arange(len(data)) % 5 == 4
    held = held if held.any() else ~held
    trained = [d for d, h in zip(data, held) if not h] or data
    w, bias = fit_ftrl(trained, labels[~held] if (~held).any() else labels, len(languages))
    logits = np.array([v @ w[c] + bias for (c, v), h in zip(data, held) if h])
    return Model(languages, w * idf[:, None], bias, best_temperature(logits, labels[held]))


def _predictions(model):
    def make():
        m = model.value

        def work(cols):
            pairs = [m.predict(t) for t in cols["_text"]]
            return {"_id": cols["_id"], "lang_pred": [p for p, _ in pairs], "score": [s for _, s in pairs]}

        return work

    return make


def predict_languages(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """The id, ``lang_pred`` and ``score`` (the calibrated probability) of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, _predictions(sent), f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def keep_known_languages(df: DataFrame, text_col: str, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``df`` in a learned language with a score of at least ``least``, with their columns as they are.

    If no language could be learned, nothing tells against a text that has a letter, and all of those stay.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            if m.languages:
                found = [m.predict(t.as_py()) for t in texts]
                kept = [lang != UNKNOWN and p >= least for lang, p in found]
            else:
                kept = [text_grams(t.as_py()) is not None for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)


LEARN_FOLDS, HELD_OUT = 3, 1


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds of ids."""
    docs = table(spark, sf_dir, "documents")
    held = id_fold(F.col("doc_id"), LEARN_FOLDS) == HELD_OUT
    model = train(docs.where(~held), "doc_id", "text", "lang")
    found = predict_languages(docs, "doc_id", "text", model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
